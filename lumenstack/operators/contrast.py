"""Local contrast of 8-bit images: contrast-limited adaptive histogram equalisation, unsharp mask, and the enhanced stretch.

Images of one call have one size, h x w, and rows (key, y, x) once each. Masked samples stay masked in clahe() and unsharp() and
count as 0 in the stretch. Other columns than those named are dropped, so none can clash. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstack.functions import lab

LEVELS = 256


def mirror_images(p: Column, size: int, low: int, high: int) -> Column:
    """The places in low .. high - 1 at which sample p of 0 .. size - 1 stands, the image being mirrored beyond its ends without
    its border samples."""
    period = max(1, 2 * (size - 1))
    places = [sign * p + period * k for k in range((low - size) // period, high // period + 2) for sign in (1, -1)]
    return F.array_distinct(F.filter(F.array(*(q.cast("int") for q in places)), lambda q: (q >= low) & (q < high)))


def equalising_maps(counts: pa.Array, area: int, limit: float) -> pa.Array:
    """For each tile's (value, n) an array of 256 bytes, the new value of each value. Tiles have `area` samples.

    Counts are cut at limit times the mean count (1 at least); the excess goes to all values alike, what is left over to
    every so many-th value; the running sum is scaled to 255.
    """
    top = max(int(limit * area / LEVELS), 1) if limit > 0 else area
    flat = counts.flatten()
    held = np.zeros((len(counts), LEVELS), np.int64)
    held[np.repeat(np.arange(len(counts)), counts.value_lengths().to_numpy()), flat.field("value").to_numpy()] = flat.field("n").to_numpy()
    excess = np.maximum(held - top, 0).sum(1)
    each, rest = np.divmod(excess, LEVELS)
    step = np.maximum(LEVELS // np.maximum(rest, 1), 1)
    place = np.arange(LEVELS)
    more = (place % step[:, None] == 0) & (place // step[:, None] < rest[:, None])
    sums = (np.minimum(held, top) + each[:, None] + more).cumsum(1)
    new = np.clip(np.rint(sums * (255 / area)), 0, 255).astype(np.uint8)
    return pa.ListArray.from_arrays(np.arange(len(counts) + 1, dtype=np.int32) * LEVELS, pa.array(new.ravel().view(np.int8)))


def clahe(px: DataFrame, key: list[str], h: int, w: int, limit: float = 2.0, tiles: int = 8, v: str = "v") -> DataFrame:
    """(key, y, x, v): v, a whole number from 0 to 255, by the maps of the four nearest of tiles x tiles tiles, mixed bilinearly.

    Where the tiles do not divide both sides, the image is mirrored at its lower and right border (a side that they
    divide by a whole row of tiles' worth). The maps of four tiles stand in one row for the cell between their centres, which
    its pixels meet by an equi-join and read one byte each of.
    """
    even = h % tiles == 0 and w % tiles == 0
    ph, pw = (h, w) if even else (h + tiles - h % tiles, w + tiles - w % tiles)
    th, tw = ph // tiles, pw // tiles
    value = F.when(F.col(v).isNotNull(), F.least(F.greatest(F.col(v).cast("int"), F.lit(0)), F.lit(255)))
    image = px.select(*key, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), value.alias("value"))
    spread = image.where("value is not null").select(*key, "value", F.explode(mirror_images(F.col("y"), h, 0, ph)).alias("y"), "x").select(*key, "value", "y", F.explode(mirror_images(F.col("x"), w, 0, pw)).alias("x"))
    counts = spread.groupBy(*key, F.expr(f"y div {th}").cast("int").alias("ty"), F.expr(f"x div {tw}").cast("int").alias("tx"), "value").agg(F.count("*").alias("n"))
    packed = counts.groupBy(*key, "ty", "tx").agg(F.collect_list(F.struct("value", "n")).alias("counts"))  # at most 256 entries

    def equalised(counts: pa.Array) -> pa.Array:
        return equalising_maps(counts, th * tw, limit)

    maps = packed.select(*key, "ty", "tx", F.arrow_udf(equalised, "array<tinyint>")("counts").alias("map"))

    def cells(t: str) -> Column:
        """The cells that a tile is a corner of, with the corner: 0 is the upper or left one. End tiles are both."""
        own = [F.struct(F.col(t).alias("c"), F.lit(0).alias("side")), F.struct((F.col(t) - 1).alias("c"), F.lit(1).alias("side"))]
        ends = [F.when(F.col(t) == 0, F.struct(F.lit(-1).alias("c"), F.lit(0).alias("side"))), F.when(F.col(t) == tiles - 1, F.struct(F.lit(tiles - 1).alias("c"), F.lit(1).alias("side")))]
        return F.explode(F.filter(F.array(*own, *ends), lambda s: s.isNotNull()))

    corners = maps.withColumn("a", cells("ty")).withColumn("b", cells("tx"))
    corner = lambda i, j: F.first(F.when((F.col("a.side") == i) & (F.col("b.side") == j), F.col("map")), ignorenulls=True).alias(f"m{i}{j}")
    four = corners.groupBy(*key, F.col("a.c").alias("cy"), F.col("b.c").alias("cx")).agg(*(corner(i, j) for i in (0, 1) for j in (0, 1)))
    ty, tx = F.col("y") / th - 0.5, F.col("x") / tw - 0.5
    placed = image.withColumns({"cy": F.floor(ty).cast("int"), "cx": F.floor(tx).cast("int"), "fy": ty - F.floor(ty), "fx": tx - F.floor(tx)})
    mixed = placed.join(four, [*key, "cy", "cx"], "left")
    image_of = lambda m: F.pmod(F.element_at(m, F.col("value") + 1).cast("int"), F.lit(LEVELS))
    upper, lower = (image_of(f"m{i}0") * (1 - F.col("fx")) + image_of(f"m{i}1") * F.col("fx") for i in (0, 1))
    return mixed.select(*key, "y", "x", lab.whole(upper * (1 - F.col("fy")) + lower * F.col("fy")).alias(v))


def clahe_colour(px: DataFrame, key: list[str], h: int, w: int, limit: float = 2.0, tiles: int = 8) -> DataFrame:
    """(key, y, x, r, g, b): clahe() of the lightness of 8-bit colours."""
    lightness, a, b = lab.to_lab(*map(F.col, "rgb"))
    held = px.select(*key, "y", "x", lightness.alias("l"), a.alias("ca"), b.alias("cb"))
    # The lightness meets its colours again by an equi-join on the pixel.
    both = clahe(held, key, h, w, limit, tiles, v="l").join(held.drop("l"), [*key, "y", "x"])
    return both.select(*key, "y", "x", *(c.alias(n) for c, n in zip(lab.from_lab(F.col("l"), F.col("ca"), F.col("cb")), "rgb")))


def unsharp(px: DataFrame, key: list[str], columns: list[str], percent: int = 120, threshold: int = 3) -> DataFrame:
    """8-bit columns, each plus percent of its difference to a blurred copy where that is over the threshold.

    The blur is that of radius 1: three passes of (1, 4, 1) / 6 along rows and then along columns, rounded after each, border samples
    repeated. A pass needs the neighbours in a row or column alone, so windows of one line do, three on one sort.
    """
    blurred = px.select(*key, "y", "x", *columns, *(F.col(c).cast("int").alias(f"{c}_soft") for c in columns))
    for line, along in (("y", "x"), ("x", "y")):
        order = Window.partitionBy(*key, line).orderBy(along)
        for _ in range(3):
            soft = {f"{c}_soft": F.col(f"{c}_soft") for c in columns}
            beside = lambda v: F.coalesce(F.lag(v).over(order), v) + F.coalesce(F.lead(v).over(order), v)
            blurred = blurred.withColumns({n: F.floor((4 * v + beside(v)) / 6 + 0.5).cast("int") for n, v in soft.items()})

    def sharp(c: str) -> Column:
        change = F.col(c) - F.col(f"{c}_soft")
        moved = F.col(c) + (change * percent / 100).cast("int")
        return F.when(F.abs(change) > threshold, F.least(F.greatest(moved, F.lit(0)), F.lit(255))).otherwise(F.col(c)).cast("int")

    return blurred.select(*key, "y", "x", *(sharp(c).alias(c) for c in columns))


def enhanced_stretch(px: DataFrame, key: list[str], h: int, w: int, columns: tuple[str, ...] = ("r", "g", "b"), saturation: float = 1.2, limit: float = 2.0, tiles: int = 8, sharpen: bool = False) -> DataFrame:
    """(key, y, x, columns) in [0, 1]: asinh between automatic levels, 8 bits, CLAHE (limit 0: none), saturation, unsharp mask.

    columns: three of a colour image or one. The levels are the first and 99th percentile of the luminance, 0 and 1 for images
    of under 20 samples; images without anything over the black level become 0.
    """
    if len(columns) not in (1, 3):
        raise ValueError("one column, or red, green and blue")
    names = ("r", "g", "b") if len(columns) == 3 else ("v",)
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    image = px.select(*key, "y", "x", *(finite(F.col(c).cast("double")).alias(n) for c, n in zip(columns, names)))
    grey = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b") if len(names) == 3 else F.col("v")
    values = [F.coalesce(n, F.lit(0.0)) for n in names]
    most = F.max(F.greatest(*values) if len(values) > 1 else values[0])
    levels = image.groupBy(*key).agg(F.percentile(grey, F.array(F.lit(0.01), F.lit(0.99))).alias("p"), F.count(grey).alias("n"), most.alias("most"))
    black = F.when(F.col("n") < 20, 0.0).otherwise(F.least(F.greatest(F.col("p")[0], F.lit(0.0)), F.lit(1 - 1e-4)))
    levels = levels.withColumn("black", black).withColumn("white", F.when(F.col("n") < 20, 1.0).otherwise(F.least(F.greatest(F.col("p")[1], F.col("black") + 1e-4), F.lit(1.0))))
    scale = 10 / F.greatest(F.lit(0.01), F.col("white") - F.col("black"))
    levels = levels.select(*key, "black", scale.alias("scale"), F.asinh(scale * F.greatest(F.col("most") - F.col("black"), F.lit(0.0))).alias("whole"))
    curve = lambda v: F.when(F.col("whole") < 1e-10, 0.0).otherwise(F.least(F.asinh(F.col("scale") * F.greatest(v - F.col("black"), F.lit(0.0))) / F.col("whole"), F.lit(1.0)))
    shown = image.join(levels, key).select(*key, "y", "x", *((curve(v) * 255).cast("int").alias(n) for v, n in zip(values, names)))
    if limit > 0 and tiles > 1:
        shown = clahe_colour(shown, key, h, w, limit, tiles) if len(names) == 3 else clahe(shown, key, h, w, limit, tiles)
    if len(names) == 3 and abs(saturation - 1) > 1e-2:
        shown = shown.select(*key, "y", "x", *(c.alias(n) for c, n in zip(lab.saturated(*map(F.col, names), saturation), names)))
    if sharpen:
        shown = unsharp(shown, key, list(names))
    return shown.select(*key, "y", "x", *((F.col(n) / 255).alias(c) for n, c in zip(names, columns)))
