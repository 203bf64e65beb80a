"""Frames with world coordinates brought onto one grid and co-added, at once, in increments, or as a mosaic.

A frame table has one row a frame: its key, crval1/2, crpix1/2 (1-based), cd11..cd22 and naxis1/2. A grid is a dict of the
same names with numbers. Frames whose coordinates are not celestial are dropped. Between two tangent planes straight
lines stay straight, so the corners of a frame bound the cells that it can reach, and only those are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack.functions import wcs
from lumenstack.operators import project, robust

WCS = ("crval1", "crval2", "crpix1", "crpix2", "cd11", "cd12", "cd21", "cd22")
#: Cells that the corners miss by less are still looked at.
SLACK = 1e-6


def columns(names: tuple[str, ...] = WCS) -> dict[str, Column]:
    return {c: F.col(c) for c in names}


def numbers(grid: dict[str, float]) -> dict[str, Column]:
    return {c: F.lit(float(grid[c])) for c in WCS}


def corners(frames: DataFrame) -> DataFrame:
    """frames, four rows each, with the position (px, py) of a corner's centre."""
    at = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    out = frames.withColumn("c", F.explode(at))
    return out.withColumns({"px": F.col("c.a") * (F.col("naxis1") - 1.0), "py": F.col("c.b") * (F.col("naxis2") - 1.0)}).drop("c")


def targets(frames: DataFrame, frame: str, grid: dict[str, float]) -> DataFrame:
    """(frame, ty, tx, sx, sy): the grid's cells that each frame can reach, and where they fall in it."""
    own, out = columns(), numbers(grid)
    good = frames.where(wcs.is_celestial(own)).select(frame, *WCS, "naxis1", "naxis2")
    at = corners(good)
    x, y = wcs.sky_to_pixel(*wcs.pixel_to_sky(F.col("px"), F.col("py"), own), out)
    box = at.select(frame, x.alias("ox"), y.alias("oy")).groupBy(frame).agg(*(f(F.col(c)).alias(n) for n, f, c in (("x0", F.min, "ox"), ("x1", F.max, "ox"), ("y0", F.min, "oy"), ("y1", F.max, "oy"))))
    cells = good.join(box, frame)
    for axis, size in (("y", grid["naxis2"]), ("x", grid["naxis1"])):
        low = F.greatest(F.ceil(F.col(f"{axis}0") - SLACK), F.lit(0)).cast("int")
        high = F.least(F.floor(F.col(f"{axis}1") + SLACK), F.lit(int(size) - 1)).cast("int")
        cells = cells.where(low <= high).withColumn(f"t{axis}", F.explode(F.sequence(low, high)))
    sx, sy = wcs.sky_to_pixel(*wcs.pixel_to_sky(F.col("tx").cast("double"), F.col("ty").cast("double"), out), own)
    return cells.select(frame, "ty", "tx", sx.alias("sx"), sy.alias("sy")).where("sx is not null")


def reproject(px: DataFrame, frames: DataFrame, frame: str, grid: dict[str, float]) -> DataFrame:
    """(frame, ch, y, x, v): each frame's samples on the grid, bilinear, where the frame covers the cell."""
    made = project.reproject_bilinear(px, [frame], targets(frames, frame, grid), ("ch",))
    return made.select(frame, "ch", F.col("ty").alias("y"), F.col("tx").alias("x"), F.col("value").alias("v"))


def matched(projected: DataFrame, frame: str) -> DataFrame:
    """projected less each frame's background correction: the pairs' median differences over common cells, solved."""
    pairs = robust.pairwise_offsets(projected, frame, ["ch", "y", "x"])
    solved = robust.solve_offsets(pairs, projected, frame)
    (off,) = robust.free_names(projected, ("correction",))
    return projected.join(solved.withColumnRenamed("correction", off), frame).withColumn("v", F.col("v") - F.col(off)).drop(off)


def reproject_and_coadd(px: DataFrame, frames: DataFrame, frame: str, grid: dict[str, float], weight: str | None = None, match_background: bool = False) -> DataFrame:
    """(ch, y, x, value, coverage): sum(v w) / sum(w) over the frames that cover a cell. weight: a column of frames."""
    projected = reproject(px, frames, frame, grid)
    if match_background:
        projected = matched(projected, frame)
    if weight:
        projected = projected.join(frames.select(frame, F.col(weight).cast("double").alias("weight")), frame)
    else:
        projected = projected.withColumn("weight", F.lit(1.0))
    return project.coadd(projected, ["ch", "y", "x"], "v", "weight").where("coverage > 0")


def covered(coadded: DataFrame, weight: str = "coverage") -> DataFrame:
    """coadded; RuntimeError if its weights are zero everywhere, so that no empty image is ever saved."""
    if not coadded.where(F.col(weight) > 0).limit(1).count():
        raise RuntimeError("no cell has any weight")
    return coadded


def with_channels(px: DataFrame, frame: str, colour: bool) -> DataFrame:
    """All frames in colour (the channel of a mono frame three times) or all in mono (the mean of the channels)."""
    key = [c for c in (frame, "y", "x")]
    if not colour:
        return px.groupBy(*key).agg(F.avg("v").alias("v")).withColumn("ch", F.lit(0)).select(frame, "ch", "y", "x", "v")
    mono = px.groupBy(frame).agg((F.max("ch") == 0).alias("mono"))
    copies = F.when(F.col("mono"), F.array(*map(F.lit, (0, 1, 2)))).otherwise(F.array("ch"))
    return px.select(frame, "ch", "y", "x", "v").join(mono, frame).withColumn("ch", F.explode(copies)).select(frame, "ch", "y", "x", "v")


def master_of(batch: DataFrame, pixel: list[str], image: str = "img", coverage: str = "cov") -> DataFrame:
    """(pixel, sum, coverage) of one batch's image and coverage; what is missing or not a number counts as 0."""
    clean = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    return batch.select(*pixel, (clean(image) * clean(coverage)).alias("sum"), clean(coverage).alias("coverage"))


def merge_masters(masters: list[DataFrame], pixel: list[str]) -> DataFrame:
    """Masters added up, in any order and grouping."""
    whole = masters[0]
    for m in masters[1:]:
        whole = whole.unionByName(m)
    return whole.groupBy(*pixel).agg(F.sum("sum").alias("sum"), F.sum("coverage").alias("coverage"))


def master_image(master: DataFrame, pixel: list[str]) -> DataFrame:
    return master.select(*pixel, F.when(F.col("coverage") > 0, F.col("sum") / F.col("coverage")).otherwise(0.0).alias("value"), "coverage")


def assemble_mosaic(projected: DataFrame, frame: str, match_background: bool = True, reference: int | None = None, weight: str | None = None) -> DataFrame:
    """(ch, y, x, value, coverage) of projected tiles in three passes: how many tiles cover a cell, which tile's
    background is the reference (or the given one), and the sum with each tile's channels brought to its medians."""
    counts = projected.groupBy("ch", "y", "x").agg(F.count("*").alias("n"))
    share = projected.join(counts, ["ch", "y", "x"]).groupBy(frame).agg(F.avg((F.col("n") >= 2).cast("double")).alias("fraction"))
    tiles = projected
    if match_background:
        if reference is None:
            best = robust.background_reference(robust.plane_metrics(projected, [frame]), share, frame).select(F.col(frame).alias("best"))
        else:
            best = projected.select(F.lit(reference).alias("best")).limit(1)
        medians = projected.groupBy(frame, "ch").agg(F.median("v").alias("med"))
        wanted = medians.join(F.broadcast(best), F.col(frame) == F.col("best")).select("ch", F.col("med").alias("ref"))  # a row a channel
        shift = medians.join(F.broadcast(wanted), "ch").select(frame, "ch", (F.col("ref") - F.col("med")).alias("shift"))
        tiles = projected.join(shift, [frame, "ch"]).withColumn("v", F.col("v") + F.col("shift")).drop("shift")
    tiles = tiles.withColumn("weight", F.col(weight).cast("double") if weight else F.lit(1.0))
    return project.coadd(tiles, ["ch", "y", "x"], "v", "weight")


def _on_grid(at: DataFrame, centre: DataFrame, cd: tuple[Column, ...]) -> DataFrame:
    """Corners with their position (gx, gy) on a plane at centre (ra0, dec0) with CRPIX 0 and a CD matrix."""
    plane = dict(zip(WCS, (F.col("ra0"), F.col("dec0"), F.lit(0.0), F.lit(0.0), *cd)))
    x, y = wcs.sky_to_pixel(F.col("ra"), F.col("dec"), plane)
    return at.join(F.broadcast(centre)).withColumns({"gx": x, "gy": y})  # centre is one row


def mosaic_grid(frames: DataFrame, factor: float = 1.0, least: int = 10) -> DataFrame:
    """One row (crval1/2, crpix1/2, cd11..cd22, naxis1/2, dropped): a grid around all celestial frames, centred on the
    median of their corners (right ascension wrapped at 180 degrees), at their mean scale over factor."""
    own = columns()
    good = frames.withColumn("celestial", wcs.is_celestial(own))
    ra, dec = wcs.pixel_to_sky(F.col("px"), F.col("py"), own)
    at = corners(good.where("celestial")).withColumns({"ra": ra, "dec": dec})
    wrapped = F.pmod(F.col("ra") + 180.0, F.lit(360.0)) - 180.0
    step = (F.abs("cd11") + F.abs("cd22")) / 2
    centre = at.agg(F.median(wrapped).alias("ra0"), F.median("dec").alias("dec0"), (F.avg(step) / factor).alias("step"))
    put = _on_grid(at, centre, (-F.col("step"), F.lit(0.0), F.lit(0.0), F.col("step")))
    box = put.agg(*(F.first(c).alias(c) for c in ("ra0", "dec0", "step")), *(f(c).alias(n) for n, f, c in (("x0", F.min, "gx"), ("x1", F.max, "gx"), ("y0", F.min, "gy"), ("y1", F.max, "gy"))))
    side = lambda a: F.greatest(F.lit(least), F.ceil(F.col(f"{a}1") - F.col(f"{a}0") + 1)).cast("int")
    grid = box.select(F.col("ra0").alias("crval1"), F.col("dec0").alias("crval2"), (F.lit(0.0) - F.col("x0")).alias("crpix1"), (F.lit(0.0) - F.col("y0")).alias("crpix2"), (-F.col("step")).alias("cd11"), F.lit(0.0).alias("cd12"), F.lit(0.0).alias("cd21"), F.col("step").alias("cd22"), side("x").alias("naxis1"), side("y").alias("naxis2"))
    return grid.join(F.broadcast(good.agg(F.count(F.when(~F.col("celestial"), 1)).alias("dropped"))))


def rotated_grid(frames: DataFrame, scale: float = 1.0) -> DataFrame:
    """One row (crval1/2, crpix1/2, cd11..cd22, naxis1/2, angle, dropped): as the bounding box of all corners about the
    medians of the frames' centres, turned by the principal axis of the corners, at the least scale over `scale`."""
    own = columns()
    good = frames.withColumn("celestial", wcs.is_celestial(own))
    ra, dec = wcs.pixel_to_sky(F.col("px"), F.col("py"), own)
    at = corners(good.where("celestial")).withColumns({"ra": ra, "dec": dec})
    one, two = wcs.plane_scales(own)
    centre = good.where("celestial").agg(F.median("crval1").alias("ra0"), F.median("crval2").alias("dec0"), (F.min((one + two) / 2) / max(scale, 1.0)).alias("step"))
    put = _on_grid(at, centre, (-F.col("step"), F.lit(0.0), F.lit(0.0), F.col("step")))
    spread = put.agg(F.covar_samp("gx", "gx").alias("xx"), F.covar_samp("gy", "gy").alias("yy"), F.covar_samp("gx", "gy").alias("xy"))
    turned = put.join(F.broadcast(spread.select((0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))).alias("angle"))))
    c, s = F.cos("angle"), F.sin("angle")
    turned = turned.withColumns({"u": c * F.col("gx") + s * F.col("gy"), "w": c * F.col("gy") - s * F.col("gx")})
    box = turned.agg(*(F.first(k).alias(k) for k in ("ra0", "dec0", "step", "angle")), *(f.alias(n) for n, f in (("x0", F.floor(F.min("u")) - 1), ("x1", F.ceil(F.max("u")) + 1), ("y0", F.floor(F.min("w")) - 1), ("y1", F.ceil(F.max("w")) + 1))))
    step = F.col("step")
    grid = box.select(F.col("ra0").alias("crval1"), F.col("dec0").alias("crval2"), (1.0 - F.col("x0")).alias("crpix1"), (1.0 - F.col("y0")).alias("crpix2"), (-step * c).alias("cd11"), (step * s).alias("cd12"), (step * s).alias("cd21"), (step * c).alias("cd22"), (F.col("x1") - F.col("x0")).cast("int").alias("naxis1"), (F.col("y1") - F.col("y0")).cast("int").alias("naxis2"), F.degrees("angle").alias("angle"))
    return grid.join(F.broadcast(good.agg(F.count(F.when(~F.col("celestial"), 1)).alias("dropped"))))


def fixed_orientation(w: dict[str, float], scale: float = 1.0) -> dict[str, float]:
    """A reference's grid with north up: no rotation in its CD matrix, sizes times the scale."""
    one, two = (abs(complex(w[a], w[b])) for a, b in (("cd11", "cd21"), ("cd12", "cd22")))
    return w | {"cd11": -one / scale, "cd12": 0.0, "cd21": 0.0, "cd22": two / scale} | {k: w[k] * scale for k in ("crpix1", "crpix2")} | {k: round(w[k] * scale) for k in ("naxis1", "naxis2")}
