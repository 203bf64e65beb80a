"""Drizzle of many frames, each by the transform and coordinates of its own header, and the image that a run saves at its end.

Frames are a table of one row each with a map of header cards; their samples are joined to it, so that no frame's
solution passes through the driver. A frame that cannot be placed adds nothing, and refusals() says why.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack import model
from lumenstack.functions import stretch, wcs
from lumenstack.operators import drizzle, project, robust, spatial
from lumenstack.plans import lifecycle
from lumenstack.sources import bands
from lumenstack.work import materialise

#: Keywords of a frame's transform onto its anchor.
MATRIX = ("M11", "M12", "M13", "M21", "M22", "M23")
SKY = ("crval1", "crval2", "crpix1", "crpix2", "cd11", "cd12", "cd21", "cd22")
#: Names of the kernels.
KERNELS = ("square", "gaussian", "point", "tophat", "turbo", "lanczos2", "lanczos3")


def placement(header: Column, local: bool, anchored: bool, optics: bool = False) -> Column:
    """struct(sky, matrix, exposure, reason) of a header. sky: its coordinates; those of its pointing and optics where it
    states none and `optics` is asked for. local: a matrix onto the anchor is needed; anchored: the anchor's
    coordinates come from elsewhere. reason: why the frame cannot be placed, else null. An exposure is 1 where it is
    missing or no number, and 1e-6 at least."""
    fields = lambda s: {k: s[k] for k in SKY}
    packed = lambda w: F.struct(*(w[k].alias(k) for k in SKY))
    matrix = F.array(*(wcs.header_number(header, k) for k in MATRIX))
    no_matrix = F.exists(matrix, lambda v: v.isNull()) if local else F.lit(False)
    exposure = F.greatest(F.coalesce(wcs.header_number(header, "EXPTIME"), F.lit(1.0)), F.lit(1e-6))
    sky = packed(wcs.of_header(header))
    if optics:
        sky = _let(sky, lambda s: F.when(wcs.is_solution(fields(s)), s).otherwise(packed(wcs.of_optics(header))))

    def judged(s: Column) -> Column:
        no_sky = F.lit(False) if anchored else ~wcs.is_solution(fields(s))
        reason = F.when(header.isNull(), "no header").when(no_matrix, "no matrix").when(no_sky, "no celestial coordinates")
        return F.struct(s.alias("sky"), matrix.alias("matrix"), exposure.alias("exposure"), reason.alias("reason"))

    return _let(sky, judged)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is made once however often body names it."""
    return F.transform(F.array(value), body)[0]


def refusals(frames: DataFrame, frame: str, header: str = "header", local: bool = False, anchored: bool = False, optics: bool = False) -> DataFrame:
    """(frame, reason) of the frames that cannot be placed."""
    return frames.select(frame, placement(F.col(header), local, anchored, optics)["reason"].alias("reason")).where("reason is not null")


def drizzle_frames(px: DataFrame, frames: DataFrame, frame: str, key: list[str], output: dict[str, float], kernel: str = "square", pixfrac: float = 1.0, units: str = "cps", local: bool = False, anchor: dict[str, float] | None = None, weight: str | None = None, missing: float | None = 0.0, header: str = "header", optics: bool = False) -> DataFrame:
    """(key, y, x, sum, wht, sci) of all frames that can be placed on the output grid (with naxis1 and naxis2).

    px: frame, key (as the channel), y, x, v and weight. frames: frame, header. A sample goes through the frame's matrix
    onto its anchor (local), through the sky of the anchor (the one given, else that of the frame's own header), and
    onto the output. Counts are divided by the exposure, "cps" are as they are. An unknown kernel is square; pixfrac is
    kept within [0.01, 1]. A missing sample counts as the number `missing`, and not at all if that is None.
    Raises ValueError if no frame can be placed. Repeated rows of frames are one; of unlike headers of one frame the least
    as JSON counts.
    """
    if units not in ("cps", "counts"):
        raise ValueError(f"no units {units}")
    placed, sample = robust.free_names(px, ("placed_frame", "sample"))
    kernel, pixfrac = kernel.lower() if kernel.lower() in KERNELS else "square", min(max(pixfrac, 0.01), 1.0)
    one = frames.groupBy(frame).agg(F.min_by(header, F.to_json(header)).alias(header))
    known = materialise(one.select(frame, placement(F.col(header), local, anchor is not None, optics).alias(placed))).where(F.col(placed)["reason"].isNull())
    lifecycle.refuse_empty(known, "no frame has what it takes to be placed")
    value = F.col("v") if missing is None else F.coalesce(F.col("v"), F.lit(float(missing)))
    value = value / F.col(placed)["exposure"] if units == "counts" else value
    rows = px.join(known, frame).withColumn(sample, value).drop("v").withColumnRenamed(sample, "v")
    sky = {k: F.lit(float(anchor[k])) if anchor else F.col(placed)["sky"][k] for k in SKY}
    target = {k: F.lit(float(output[k])) for k in SKY}
    matrix = tuple(F.col(placed)["matrix"][i] for i in range(6)) if local else None
    width, height, w = int(output["naxis1"]), int(output["naxis2"]), None if weight is None else F.col(weight)
    # Positions go through each step as an array, by a function of one position: in one expression every step would repeat
    # those before it, which is more than fits a compiled method.
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    wanted = [*drizzle.corners_of(x, y, pixfrac), (x, y)] if kernel == "square" else [(x, y)]
    positions = F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in wanted))
    steps = [lambda a, b: wcs.pixel_to_sky(a, b, sky), lambda a, b: wcs.sky_to_pixel(a, b, target)]
    for step in [lambda a, b: wcs.affine(a, b, matrix), *steps] if local else steps:
        positions = F.transform(positions, _by(step))
    (found,) = robust.free_names(rows, ("positions",))
    rows = rows.withColumn(found, positions)
    *corners, at = [(F.col(found)[i]["x"], F.col(found)[i]["y"]) for i in range(len(wanted))]
    if kernel == "square":
        return drizzle.drizzle_quads(rows, key, corners, at, width, height, w)
    if kernel == "point":
        return project.drizzle_point(rows, key, *at, width, height, w)
    if kernel == "turbo":
        return project.drizzle_turbo(rows, key, *at, width, height, pixfrac, weight=w)
    return drizzle.drizzle_kernel(rows, key, *at, width, height, kernel, pixfrac, weight=w)


def _by(step: Callable[[Column, Column], tuple[Column, Column]]) -> Callable[[Column], Column]:
    return lambda p: F.struct(*(c.alias(n) for n, c in zip("xy", step(p["x"], p["y"]))))


def raw_colour(frames: DataFrame, frame: str = "path", pattern: str = "GRBG") -> tuple[DataFrame, DataFrame]:
    """(samples, frames) of raw mosaics (frame, h, w, c, data, header): (frame, ch, y, x, v) by gradient-corrected
    demosaicing, and (frame, header) for drizzle_frames with optics. An unknown pattern is GRBG. Frames of more
    than one channel, without data, or without coordinates or optics to make them from, take no part."""
    pattern = pattern.upper() if pattern.upper() in ("GRBG", "RGGB", "GBRG", "BGGR") else "GRBG"
    usable = (F.col("c") == 1) & F.col("data").isNotNull() & placement(F.col("header"), False, False, True)["reason"].isNull()
    kept = frames.where(usable).select(frame, "w", "data", "header")
    samples = model.explode_frames(kept.select(frame, "w", "data"), F.col("w")).select(frame, "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))
    colours = spatial.debayer_malvar(samples, [frame], pattern)
    channels = F.array(*(F.struct(F.lit(i).alias("ch"), F.col(c).alias("v")) for i, c in enumerate("rgb")))
    return colours.select(frame, "y", "x", F.explode(channels).alias("s")).select(frame, "s.ch", "y", "x", "s.v"), kept.select(frame, "header")


def final_image(px: DataFrame, headers: DataFrame, group: list[str], value: str = "value", weight: str = "wht", linear: bool = True, crop: bool = True, ends: tuple[float, float] = (0.001, 0.999), header: str = "header") -> DataFrame:
    """(group, ch, y, x, value, level, header): what is saved of an image.

    px: group, ch, y, x, value, weight; headers: group, header. crop: only the bounding box of positive weight stays, and
    CRPIX moves with it. linear: values are as they are; else they are scaled between percentiles of the covered
    samples, an image without range being 0. level: the value as 16 bits. RA and DEC follow CRVAL. Missing values are
    0. Images without any positive weight are not saved: a run whose every image is so fails with ValueError.
    """
    cells = px.select(*group, "ch", "y", "x", F.coalesce(F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(F.col(value)), F.lit(0.0)).alias("value"), F.coalesce(weight, F.lit(0.0)).alias("w"))
    covered = lifecycle.refuse_empty(cells.where("w > 0").select(*group).distinct(), "no cell has weight")
    cells = spatial.crop_to_coverage(cells, group) if crop else cells.join(covered, group).withColumns({"dy": F.lit(0), "dx": F.lit(0)})
    if not linear:
        low, high = (F.percentile(F.when(F.col("w") > 0, F.col("value")), F.lit(e)) for e in ends)
        limits = cells.groupBy(*group).agg(low.alias("low"), high.alias("high"))
        ranged = F.col("high") > F.col("low")
        cells = cells.join(limits, group).withColumn("value", F.when(ranged, stretch.clip01((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")))).otherwise(0.0))
    moved = F.transform_values("h", lambda k, v: F.when(k.isin("CRPIX1", "CRPIX2"), (v.try_cast("double") - F.when(k == "CRPIX1", F.col("dx")).otherwise(F.col("dy"))).cast("string")).otherwise(v))
    offsets = cells.groupBy(*group).agg(F.max("dy").alias("dy"), F.max("dx").alias("dx"))
    known = offsets.join(headers.select(*group, F.col(header).alias("h")), group, "left").withColumn("h", F.coalesce("h", F.create_map().cast("map<string,string>")))
    stated = known.select(*group, lifecycle.with_pointing(moved).alias("header"))
    return cells.join(stated, group).select(*group, "ch", "y", "x", "value", stretch.quantise(F.col("value")).alias("level"), "header")


def save_final(image: DataFrame, group: list[str], folder: str, u16: bool = False, overwrite: bool = False) -> None:
    """Writes each image of final_image() to folder/<its group's values, joined by _>.fits, as 32-bit floats or 16-bit levels,
    all files or none. A file is one image, so its samples meet in one task; images are written side by side."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "ch", "value"))), lambda s: s["value"].cast("float"))
    files = image.groupBy(*group).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), (F.max("ch") + 1).alias("c"), cells.alias("data"), F.first("header").alias("header"))
    bands.register(image.sparkSession)
    name = F.concat_ws("_", *(F.col(k).cast("string") for k in group)).alias("name")
    files.select(name, "h", "w", "c", "data", "header").write.format("frame_files").option("u16", str(u16).lower()).mode("overwrite" if overwrite else "append").save(folder)
