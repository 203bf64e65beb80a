"""Segments of images: connected samples over a threshold, their moments, and what follows from them.

A segment is found in two steps. Inside tiles of bounded size, samples are labelled by runs along rows that touch runs of
the row before. Labels of samples on both sides of a tile's border are joined by coordinates to pairs, and pairs are
merged in rounds: the larger of linked labels points to the least one that it or its neighbours know, so a chain
halves with every round. A label is the place of the segment's first sample (row, then column), whatever the tiles are, and no
frame or segment is gathered whole.

Masked samples belong to no segment. Repeated samples count as often as they stand there. Frames without
a segment have no rows in sources(), and defaults in the operators that return one row a frame. Tables may have columns of
any other name; they are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack.operators import background, robust
from lumenstack.work import forget, materialise

#: A label is row * ROW + column.
ROW = 1 << 32
#: Fixed value: where a segment is so small that its covariance vanishes, a pixel's own variance is added.
PIXEL_VARIANCE = 1 / 12


def tile_labels(y: np.ndarray, x: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """The label of each sample of one tile, in the order given."""
    order = np.lexsort((x, y))
    ys, xs = y[order].astype(np.int64), x[order].astype(np.int64)
    new = np.ones(len(ys), bool)
    new[1:] = (np.diff(ys) != 0) | (np.diff(xs) > 1)
    first = np.flatnonzero(new)
    row, start, end = ys[first], xs[first], xs[np.append(first[1:], len(ys)) - 1]
    root = list(range(len(first)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    # Runs of a row are in order, so the runs of the row before that touch one are a range.
    reach = 1 if diagonal else 0
    rows = np.searchsorted(row, [row - 1, row])
    for i in range(len(first)):
        low, high = rows[0, i], rows[1, i]
        if low == high or row[low] != row[i] - 1:
            continue
        a = low + np.searchsorted(end[low:high], start[i] - reach)
        b = low + np.searchsorted(start[low:high], end[i] + reach, side="right")
        for j in range(a, b):
            p, q = find(i), find(j)
            root[max(p, q)] = min(p, q)
    heads = np.array([find(i) for i in range(len(first))], np.int64)
    labels = np.empty(len(ys), np.int64)
    labels[order] = (row[heads] * ROW + start[heads])[np.cumsum(new) - 1]
    return labels


def merged(links: DataFrame, key: list[str]) -> DataFrame:
    """(key, label, root): the least label of each component of the links (key, a, b); both directions are implied."""
    both = lambda e: e.unionByName(e.select(*key, F.col("b").alias("a"), F.col("a").alias("b")))
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.hash(*key, "a", "b").cast("decimal(38)"))).first())
    edges = materialise(links.select(*key, "a", "b").where("a <> b").distinct())
    known = state(edges)
    while known[0]:
        around = both(edges)
        least = around.groupBy(*key, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Every larger neighbour is sent to the least one around, then every node and its lesser neighbours to the least of these.
        large = around.where("b > a").join(least, [*key, "a"]).select(*key, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lesser = large.groupBy(*key, "a").agg(F.min("b").alias("m"))
        small = large.join(lesser, [*key, "a"]).select(*key, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lesser.select(*key, "a", F.col("m").alias("b"))).where("a <> b").distinct()
        last, edges = edges, materialise(small)
        forget(last)
        before, known = known, state(edges)
        if known == before:
            break
    return edges.select(*key, F.col("a").alias("label"), F.col("b").alias("root"))


def label(px: DataFrame, key: list[str], tile: int = 256, diagonal: bool = True, v: str = "v") -> DataFrame:
    """(key, y, x, v, label) of the samples given, which are those over the threshold, with y and x from 0 on.

    tile: side of the squares labelled at once; the labels do not depend on it.
    """
    names = [f"k{i}" for i in range(len(key))]
    rows = px.select(*(F.col(k).alias(n) for k, n in zip(key, names)), F.col("y").cast("int"), F.col("x").cast("int"), F.col(v).cast("double").alias("v")).where("v is not null")
    kinds = dict(rows.dtypes)

    def run(table: pa.Table) -> pa.Table:
        labels = tile_labels(table["y"].to_numpy(), table["x"].to_numpy(), diagonal)
        return table.select([*names, "y", "x", "v"]).append_column("label", pa.array(labels))

    cut = rows.withColumns({"ty": F.expr(f"y div {tile}"), "tx": F.expr(f"x div {tile}")})
    inside = materialise(cut.groupBy(*names, "ty", "tx").applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (*names, "y", "x", "v")) + ", label long"))
    edge = inside.where(f"y % {tile} in (0, {tile - 1}) or x % {tile} in (0, {tile - 1})").select(*names, "y", "x", "label").distinct()
    steps = [(0, 1), (1, 0), *([(1, -1), (1, 1)] if diagonal else [])]
    step = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps)))
    sent = edge.select(*names, "y", "x", F.col("label").alias("a"), step.alias("s")).select(*names, "a", (F.col("y") + F.col("s.a")).alias("ny"), (F.col("x") + F.col("s.b")).alias("nx"), "y", "x")
    sent = sent.where(f"y div {tile} <> ny div {tile} or x div {tile} <> nx div {tile}").select(*names, "a", F.col("ny").alias("y"), F.col("nx").alias("x"))
    links = sent.join(edge.withColumnRenamed("label", "b"), [*names, "y", "x"]).select(*names, "a", "b")
    roots = merged(links, names)
    out = inside.join(roots, [*names, "label"], "left").withColumn("label", F.coalesce("root", "label"))
    return out.select(*(F.col(n).alias(k) for k, n in zip(key, names)), "y", "x", F.col("v").alias(v), "label")


def sources(labelled: DataFrame, key: list[str], least: int = 1, v: str = "v") -> DataFrame:
    """(key, label, n, flux, peak, sx, sy, major, minor, eccentricity, fwhm) of segments of `least` samples and more.

    The centre, and the deviations along the axes, are moments weighted by the sample, negative ones counting as 0; fwhm is that
    of a round profile of the same variance. Segments without a positive sample have null moments.
    """
    names = [f"k{i}" for i in range(len(key))]
    f = F.greatest(F.col(v), F.lit(0.0))
    # Moments are about the segment's first sample, so that they keep their digits far from the origin.
    dy, dx = F.col("y") - F.col("y0"), F.col("x") - F.col("x0")
    at = labelled.select(*(F.col(k).alias(n) for k, n in zip(key, names)), "y", "x", v, "label", F.floor(F.col("label") / ROW).alias("y0"), F.pmod(F.col("label"), F.lit(ROW)).alias("x0"))
    sums = at.groupBy(*names, "label").agg(F.count("*").alias("n"), F.sum(v).alias("flux"), F.max(v).alias("peak"), F.first("y0").alias("y0"), F.first("x0").alias("x0"), F.sum(f).alias("m"), *(F.sum(f * a).alias(c) for c, a in (("mx", dx), ("my", dy), ("xx", dx * dx), ("yy", dy * dy), ("xy", dx * dy))))
    m = F.when(F.col("m") > 0, F.col("m"))
    cx, cy = F.col("mx") / m, F.col("my") / m
    found = sums.where(F.col("n") >= least).select(*names, "label", "n", "flux", "peak", (F.col("x0") + cx).alias("sx"), (F.col("y0") + cy).alias("sy"), *((F.col(c) / m - a).alias(c) for c, a in (("xx", cx * cx), ("yy", cy * cy), ("xy", cx * cy))))
    small = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy") < PIXEL_VARIANCE**2
    found = found.withColumns({c: F.col(c) + F.when(small, PIXEL_VARIANCE).otherwise(0.0) for c in ("xx", "yy")})
    half, spread = (F.col("xx") + F.col("yy")) / 2, F.sqrt((F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy")) + 4 * F.col("xy") * F.col("xy")) / 2
    low = F.greatest(half - spread, F.lit(0.0))
    shape = [F.sqrt(half + spread).alias("major"), F.sqrt(low).alias("minor"), F.sqrt(F.greatest(1 - low / (half + spread), F.lit(0.0))).alias("eccentricity"), (2 * F.sqrt(math.log(2) * (half + spread + low))).alias("fwhm")]
    return found.select(*(F.col(n).alias(k) for k, n in zip(key, names)), "label", "n", "flux", "peak", "sx", "sy", *shape)


def over_sky(px: DataFrame, key: list[str], sigma: float = 3.0, rounds: int = 5, subtract: bool = False) -> DataFrame:
    """(key, y, x, v): the samples over their frame's clipped median by `sigma` clipped deviations; subtract: less the median."""
    sky = robust.clipped_stats(px.select(*key, "v"), key, 3.0, rounds).select(*key, F.col("median").alias("sky_median"), F.col("std").alias("sky_std"))
    held = px.select(*key, "y", "x", "v").join(sky, key).where(F.col("v") > F.col("sky_median") + sigma * F.col("sky_std"))
    return held.select(*key, "y", "x", (F.col("v") - F.col("sky_median") if subtract else F.col("v")).alias("v"))


def every_frame(px: DataFrame, key: list[str], found: DataFrame, **defaults: Column) -> DataFrame:
    """found for each frame of px, with defaults where it has no row or a null."""
    return px.select(*key).distinct().join(found, key, "left").withColumns({c: F.coalesce(c, d) for c, d in defaults.items()})


def initial_fwhm(px: DataFrame, key: list[str], tile: int = 256, least: int = 5, eccentricity: float = 0.5, fallback: float = 4.0, sigma: float = 3.0) -> DataFrame:
    """(key, n, fwhm): of each frame the median width of its round segments over median + sigma deviations, and their
    number; the fallback for frames without."""
    found = sources(label(over_sky(px, key, sigma), key, tile), key, least).where(F.col("eccentricity") < eccentricity)
    own = found.groupBy(*key).agg(F.count("fwhm").alias("n"), F.median("fwhm").alias("fwhm"))
    return every_frame(px, key, own, n=F.lit(0), fwhm=F.lit(fallback))


def star_counts(px: DataFrame, key: list[str], tile: int = 256, sigma: float = 5.0, least: int = 5) -> DataFrame:
    """(key, stars): segments of each frame, without a bound on their number."""
    found = sources(label(over_sky(px, key, sigma), key, tile), key, least)
    return every_frame(px, key, found.groupBy(*key).agg(F.count("*").alias("stars")), stars=F.lit(0))


def star_cells(px: DataFrame, key: list[str], h: int, w: int, grow: int = 2, tile: int = 256, sigma: float = 5.0, least: int = 1) -> DataFrame:
    """(key, y, x): cells within `grow` steps along rows and columns of a segment's centre (its whole part), inside the image."""
    found = sources(label(over_sky(px, key, sigma, subtract=True), key, tile), key, least)
    steps = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-grow, grow + 1) for b in range(-grow, grow + 1) if abs(a) + abs(b) <= grow]
    inside = lambda c, top: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(top - 1)).cast("int")
    at = found.where("sx is not null").select(*key, inside("sy", h).alias("cy"), inside("sx", w).alias("cx"), F.explode(F.array(*steps)).alias("d"))
    grown = at.select(*key, (F.col("cy") + F.col("d.a")).alias("y"), (F.col("cx") + F.col("d.b")).alias("x"))
    return grown.where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1)).distinct()


def fwhm_weights(px: DataFrame, key: list[str], h: int, w: int, box: int = 32, tile: int = 256, stars: int = 5, least: int = 7, area: int = 2500) -> DataFrame:
    """(key, n, weight): of each frame the least width of its segments (0.5 at least) over their median width.

    Frames lose their mesh background (or median, where no zone of the mesh has samples enough); stars are segments over 5
    background deviations, widths those of segments of `least` samples over 7.5. 1 for images under `area` pixels and frames
    of under `stars` stars.
    """
    if h * w < area:
        return every_frame(px, key, px.select(*key, F.lit(0).cast("long").alias("n")).distinct(), n=F.lit(0)).withColumn("weight", F.lit(1.0))
    mesh = background.zone_mesh(px, key, h, w, box, 3, 3.0, 10.0, 10)
    sky, rms = (background.spline_surface(mesh, key, c, h, w, box).withColumnRenamed(c, n) for c, n in (("v", "sky_level"), ("s", "sky_rms")))
    whole = px.groupBy(*key).agg(F.median("v").alias("all_median"), F.stddev_pop("v").alias("all_std"))
    flat = px.select(*key, "y", "x", "v").join(sky, [*key, "y", "x"], "left").join(rms, [*key, "y", "x"], "left").join(whole, key)
    flat = flat.select(*key, "y", "x", (F.col("v") - F.coalesce("sky_level", "all_median")).alias("v"), (5 * F.coalesce("sky_rms", "all_std")).alias("threshold"))
    flat = materialise(flat.where(F.col("v") > F.col("threshold")))
    n = sources(label(flat, key, tile), key).groupBy(*key).agg(F.count("*").alias("n"))
    widths = sources(label(flat.where(F.col("v") > 1.5 * F.col("threshold")), key, tile), key, least)
    own = widths.groupBy(*key).agg(F.median("fwhm").alias("mid"), F.greatest(F.min("fwhm"), F.lit(0.5)).alias("low"))
    value = F.when((F.col("n") >= stars) & (F.col("mid") > 0), F.col("low") / F.col("mid"))
    return every_frame(px, key, n.join(own, key, "left").select(*key, "n", value.alias("weight")), n=F.lit(0), weight=F.lit(1.0))
