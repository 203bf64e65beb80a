"""Registration and projection: samples onto output grids by coordinate equi-joins and sums of overlaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack.functions import wcs


def drizzle_point(px: DataFrame, key: list[str], out_x: Column, out_y: Column, width: int, height: int, weight: Column | None = None) -> DataFrame:
    """Each sample's flux to the cell that holds its centre: weighted mean and weight by cell."""
    w = F.lit(1.0) if weight is None else weight
    cells = px.where(F.col("v").isNotNull()).select(*key, "v", w.alias("w"), F.floor(out_x + 0.5).cast("int").alias("cx"), F.floor(out_y + 0.5).cast("int").alias("cy"))
    return summed(cells.where(f"cx between 0 and {width - 1} and cy between 0 and {height - 1}"), key)


def drizzle_turbo(px: DataFrame, key: list[str], out_x: Column, out_y: Column, width: int, height: int, pixfrac: float = 1.0, scale: float = 1.0, weight: Column | None = None) -> DataFrame:
    """Each sample's axis-aligned box of pixfrac * scale over the cells that it covers, by area.

    A box covers at most (ceil(pixfrac * scale) + 1)^2 cells, so the explosion is bounded.
    """
    half = pixfrac * scale / 2
    w = F.lit(1.0) if weight is None else weight
    boxes = px.where(F.col("v").isNotNull()).select(*key, "v", w.alias("w"), out_x.alias("ox"), out_y.alias("oy")).where("ox is not null and oy is not null")
    for axis, size in (("x", width), ("y", height)):
        low, high = F.floor(F.col(f"o{axis}") - half + 0.5), F.ceil(F.col(f"o{axis}") + half + 0.5) - 1
        boxes = boxes.withColumn(f"c{axis}", F.explode(F.sequence(low.cast("int"), F.greatest(high, low).cast("int")))).where(f"c{axis} between 0 and {size - 1}")
    share = F.lit(1.0)
    for axis in "xy":
        share *= F.greatest(F.lit(0.0), F.least(F.col(f"o{axis}") + half, F.col(f"c{axis}") + 0.5) - F.greatest(F.col(f"o{axis}") - half, F.col(f"c{axis}") - 0.5))
    return summed(boxes.withColumn("w", F.col("w") * share / (4 * half * half)).where("w > 0"), key)


def summed(cells: DataFrame, key: list[str]) -> DataFrame:
    """Weighted sums by cell (cy, cx) of v under w."""
    agg = cells.groupBy(*key, F.col("cy").alias("y"), F.col("cx").alias("x")).agg(F.sum(F.col("v") * F.col("w")).alias("sum"), F.sum("w").alias("wht"))
    return agg.withColumn("sci", F.when(F.col("wht") > 0, F.col("sum") / F.col("wht")).otherwise(0.0))


def finalize(acc: DataFrame, group: list[str], mode: str) -> DataFrame:
    """sum / max(wht, 1e-9); `max` and `n_images` multiply by the greatest and the mean weight of the image."""
    safe = F.greatest("wht", F.lit(1e-9))
    out = acc.withColumn("value", F.col("sum") / safe)
    if mode in ("max", "n_images"):
        factor = acc.groupBy(*group).agg((F.max(safe) if mode == "max" else F.avg(safe)).alias("_f"))
        out = out.join(factor, group).withColumn("value", F.col("value") * F.col("_f")).drop("_f")
    elif mode == "none":
        out = out.withColumn("value", F.col("sum"))
    return out.withColumn("value", F.when(F.isnan("value") | (F.abs("value") == float("inf")), 0.0).otherwise(F.col("value")))


def reproject_bilinear(px: DataFrame, key: list[str], targets: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Values at real positions: targets (key, ty, tx, sx, sy) meet the four samples around (sx, sy), for each value of
    the columns `also` of px (channels). Where a neighbour is missing there is no row, as outside a footprint.
    """
    names = {k: f"key_{i}_of_px" for i, k in enumerate((*key, *also))}  # the steps below have names that a key may have
    px, targets, key, also = px.withColumnsRenamed(names), targets.withColumnsRenamed(names), [names[k] for k in key], tuple(names[k] for k in also)
    x0, y0 = F.floor("sx"), F.floor("sy")
    corners = F.array(*(F.struct((x0 + dx).cast("int").alias("x"), (y0 + dy).cast("int").alias("y"), ((1 - dx + (2 * dx - 1) * (F.col("sx") - x0)) * (1 - dy + (2 * dy - 1) * (F.col("sy") - y0))).alias("f")) for dx in (0, 1) for dy in (0, 1)))
    wanted = targets.select(*key, "ty", "tx", F.explode(corners).alias("c")).select(*key, "ty", "tx", "c.*").where("f > 0")
    met = wanted.join(px.where(F.col("v").isNotNull()).select(*key, *also, "x", "y", "v"), [*key, "x", "y"])
    agg = met.groupBy(*key, *also, "ty", "tx").agg(F.sum(F.col("v") * F.col("f")).alias("value"), F.sum("f").alias("_f"))
    return agg.where("_f > 1 - 1e-9").drop("_f").withColumnsRenamed({b: a for a, b in names.items()})


def coadd(tiles: DataFrame, pixel: list[str], value: str, weight: str) -> DataFrame:
    """sum(v w) / sum(w) over projected frames, 0 where uncovered, with the coverage."""
    agg = tiles.groupBy(*pixel).agg(F.sum(F.col(value) * F.col(weight)).alias("sum"), F.sum(weight).alias("coverage"))
    return agg.select(*pixel, F.when(F.col("coverage") > 0, F.col("sum") / F.col("coverage")).otherwise(0.0).alias("value"), "coverage")


def output_grid(headers: DataFrame, group: list[str]) -> DataFrame:
    """Bounding box over the frames' corners in reference pixels, one pixel of padding, at the least scale."""
    corners = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    c = headers.select("*", corners.alias("c")).withColumns({"cx": F.col("x0") + F.col("c.a") * (F.col("naxis1") - 1) * F.col("scale"), "cy": F.col("y0") + F.col("c.b") * (F.col("naxis2") - 1) * F.col("scale")})
    agg = c.groupBy(*group).agg(F.floor(F.min("cx")).alias("x_min"), F.ceil(F.max("cx")).alias("x_max"), F.floor(F.min("cy")).alias("y_min"), F.ceil(F.max("cy")).alias("y_max"), F.min("scale").alias("scale"))
    return agg.select(*group, (F.col("x_max") - F.col("x_min") + 3).cast("int").alias("width"), (F.col("y_max") - F.col("y_min") + 3).cast("int").alias("height"), "scale")


def angular_neighbours(a: DataFrame, b: DataFrame, key: str, limit: float = 0.3, parts: int = 4) -> DataFrame:
    """Pairs of distinct keys less than `limit` degrees apart: each point of b is sent to the cells of the sky that its circle
    touches, meets the points of a there by equi-join, and the great-circle distance decides.

    Cells are declination bands of the limit's width over `parts` (a power of two; it changes the work, never the pairs), cut in
    right ascension into cells about as wide. The result has as many rows as there are pairs, the square of the number of points
    in the worst case. Cells are dealt over all tasks, however small the tables are: the work is in the pairs.
    """
    step, half, slack = limit / parts, min(limit, 180.0) / 2, 1e-6
    most = F.pow(F.sin(F.radians(F.lit(half))), F.lit(2.0)) * (1 + 1e-9)
    band = F.floor(F.col("dec") / step)

    def cosine(band: Column, pick: Callable[[Column, Column], Column]) -> Column:
        """The least or greatest of a band's edges."""
        return pick(*(F.cos(F.radians(F.least(F.greatest((band + d) * step, F.lit(-90.0)), F.lit(90.0)))) for d in (0, 1)))

    def cells_in(band: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(360.0 / step * cosine(band, F.greatest))).cast("long")

    turn = F.pmod(F.col("ra"), F.lit(360.0)) / 360.0
    left = a.select(F.col(key).alias("a"), F.col("ra").alias("ra1"), F.col("dec").alias("dec1"), band.alias("band"), turn.alias("turn"))
    left = left.select("a", "ra1", "dec1", "band", F.pmod(F.floor(F.col("turn") * cells_in(F.col("band"))), cells_in(F.col("band"))).alias("cell"))
    right = b.select(F.col(key).alias("b"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"), turn.alias("turn"), F.explode(F.array(*(band + d for d in range(-parts, parts + 1)))).alias("band"))
    # How far in right ascension the circle reaches inside the band, at most.
    off = F.greatest(F.col("band") * step - F.col("dec2"), F.col("dec2") - (F.col("band") + 1) * step, F.lit(slack)) - slack
    room = F.cos(F.radians("dec2")) * cosine(F.col("band"), F.least)
    share = (most - F.pow(F.sin(F.radians(off / 2)), F.lit(2.0))) / F.greatest(room, F.lit(1e-12))
    reach = F.when(share < 1, 2 * F.degrees(F.asin(F.sqrt(share))) + slack).otherwise(180.0) / 360.0
    right = right.where(share >= 0).select("b", "ra2", "dec2", "band", cells_in(F.col("band")).alias("n"), "turn", reach.alias("reach"))
    first, last = (F.floor((F.col("turn") + e) * F.col("n")) for e in (-F.col("reach"), F.col("reach")))
    around = F.when(last - first + 1 >= F.col("n"), F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.col("n"))))
    right = right.select("b", "ra2", "dec2", "band", F.explode(around).alias("cell"))
    spark = a.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    met = left.repartition(tasks, "band", "cell").hint("merge").join(right.repartition(tasks, "band", "cell"), ["band", "cell"])
    apart = wcs.separation(F.col("ra1"), F.col("dec1"), F.col("ra2"), F.col("dec2"))
    return met.where("a < b").withColumn("separation", apart).where(F.col("separation") < limit).select("a", "b", "separation")
