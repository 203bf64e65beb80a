"""The pixel table: (frame_id, batch_id, ch, y, x, v[, w]); a masked sample has a null v."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = ["ch", "y", "x"]


def unmasked(v: Column) -> Column:
    """NaN and infinities become null, the only mark of a missing sample."""
    v = v.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def explode_frames(frames: DataFrame, width: int, data: str = "data", channels: int = 1) -> DataFrame:
    """One row a sample from packed frames: row-major, channels last; other columns are repeated."""
    others = [c for c in frames.columns if c != data]
    rows = frames.select(*others, F.posexplode(data).alias("_p", "_v"))
    pixel = F.expr(f"_p div {channels}")
    return rows.select(*others, F.expr(f"cast(_p % {channels} as int)").alias("ch"), F.floor(pixel / width).cast("int").alias("y"), (pixel % width).cast("int").alias("x"), unmasked(F.col("_v")).alias("v"))


def pack_frames(pixels: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """Packed frames again, ordered by (y, x, ch); one row for each value of `by`."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "ch", F.col(v).alias("v"))))
    return pixels.groupBy(*by).agg(F.max("y").alias("_y"), F.max("x").alias("_x"), cells.alias("c")).select(*by, (F.col("_y") + 1).alias("h"), (F.col("_x") + 1).alias("w"), F.transform("c", lambda s: s["v"]).alias("data"))
