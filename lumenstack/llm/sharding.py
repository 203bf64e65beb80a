"""Shards along a Hilbert curve, in DataFrame functions alone.

Each dimension is cut at its quantiles into 2^bits cells (strings by the order of whole strings; nulls fall in the
first cell), the cell's index on the Hilbert curve is computed, rows are ordered by that index and runs of
the order are the shards, so that each shard covers a small box of every dimension and readers can skip
files by their minima and maxima. The law is `rows`: counts of any two shards differ by at most one.

The global rank needs no sort in one task: rows are counted by (curve index, bucket of the row's hash),
those counts are summed up along the curve, and only rows of one bucket are ranked together. A cell that
holds most rows is spread over `buckets` buckets, so no group is ranked in one task.

Empty tables give no rows. Repeated rows each get a place, in no order between them. Fewer rows than shards leave
shards empty. Columns of any name may be dimensions or keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstack.llm.common import free_name, materialise

def string_cells(rows: DataFrame, name: str, bits: int) -> DataFrame:
    """(name, cell): each distinct string with its quantile cell, by the whole string; equal strings share a cell.

    Distinct strings are dealt by range, counted by range, and summed up within each range only.
    """
    seen = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    ranged = materialise(seen.repartitionByRange(name).withColumn("part", F.spark_partition_id()))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = ranged.groupBy("part").agg(F.sum("n").alias("m")).select("part", F.coalesce(F.sum("m").over(so_far), F.lit(0)).alias("before"))
    total = max(1, ranged.agg(F.sum("n")).first()[0] or 0)
    within = Window.partitionBy("part").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(parts), "part").withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    return placed.select(name, F.expr(f"cast({1 << bits} * before div {total} as int)").alias("cell"))


def hilbert_index(df: DataFrame, axes: list[str], bits: int, out: str) -> DataFrame:
    """df with the position on the Hilbert curve of the cell in columns axes (integers below 2^bits).

    Skilling's transform (Programming the Hilbert curve, 2004), one step a projection; axes are changed.
    """
    n = len(axes)
    first = axes[0]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in axes:
            set_ = F.col(axis).bitwiseAND(F.lit(1 << level)) != 0
            swap = F.col(first).bitwiseXOR(F.col(axis)).bitwiseAND(F.lit(low))
            changed = {first: F.when(set_, F.col(first).bitwiseXOR(F.lit(low))).otherwise(F.col(first).bitwiseXOR(swap))}
            if axis != first:
                changed[axis] = F.when(set_, F.col(axis)).otherwise(F.col(axis).bitwiseXOR(swap))
            df = df.withColumns(changed)
    for before, axis in zip(axes, axes[1:]):
        df = df.withColumn(axis, F.col(axis).bitwiseXOR(F.col(before)))
    last = F.col(axes[-1])
    flip = reduce(Column.bitwiseXOR, (F.when(last.bitwiseAND(F.lit(1 << level)) != 0, F.lit((1 << level) - 1)).otherwise(F.lit(0)) for level in range(bits - 1, 0, -1)), F.lit(0))
    df = df.withColumn(out, flip).withColumns({axis: F.col(axis).bitwiseXOR(F.col(out)) for axis in axes})
    place = [F.shiftleft(F.shiftright(F.col(axis), level).bitwiseAND(F.lit(1)), level * n + n - 1 - k) for level in range(bits) for k, axis in enumerate(axes)]
    return df.withColumn(out, reduce(Column.bitwiseOR, place))


def hilbert_shards(df: DataFrame, dims: list[str], shards: int, keys: list[str], bits: int = 3, buckets: int | None = None) -> DataFrame:
    """(keys, hilbert int, shard int, slot long) for each row of df; hilbert, shard and slot get underscores before
    them if a key is so named.

    dims: columns to order by, numbers or strings. keys: columns to keep; they also settle the order within a cell.
    buckets: parts that a cell is ranked in, by default one for 50,000 rows and 256 at least.
    """
    kept, names = [f"key_{i}" for i in range(len(keys))], [f"dim_{i}" for i in range(len(dims))]
    text = [n for n, d in zip(names, dims) if dict(df.dtypes)[d] == "string"]
    value = [F.col(f"`{d}`") if n in text else F.col(f"`{d}`").cast("double") for n, d in zip(names, dims)]
    rows = materialise(df.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, kept)), *(v.alias(n) for v, n in zip(value, names))))
    total = rows.count()
    buckets = buckets or max(256, total // 50_000)
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = [n for n in names if n not in text]
    cuts = rows.agg(F.count("*").alias("rows"), *(F.percentile_approx(c, steps, 10_000).alias(c) for c in numbers)).first()
    cells = {c: reduce(Column.__add__, (F.coalesce(F.col(c) > v, F.lit(False)).cast("int") for v in sorted(set(cuts[c] or []))), F.lit(0)) for c in numbers}
    for name in text:
        found = materialise(string_cells(rows, name, bits))
        rows = rows.join(found, name, "left").drop(name).withColumn(name, F.coalesce("cell", F.lit(0))).drop("cell")
    rows = materialise(rows) if text else rows
    rows = hilbert_index(rows.withColumns(cells), names, bits, "hilbert").drop(*names)
    rows = rows.withColumn("hash", F.xxhash64(*kept))
    rows = materialise(rows.withColumn("bucket", F.pmod(F.shiftright("hash", 20), F.lit(buckets)).cast("int")))

    counts = rows.groupBy("hilbert", "bucket").agg(F.count("*").alias("n"))
    along = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)  # at most 2^(bits * dims) rows
    per_cell = counts.groupBy("hilbert").agg(F.sum("n").alias("cell_n"))
    per_cell = per_cell.select("hilbert", F.coalesce(F.sum("cell_n").over(along), F.lit(0)).alias("cell_before"))
    within = Window.partitionBy("hilbert").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(per_cell, "hilbert").select("hilbert", "bucket", (F.col("cell_before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before"))

    ordered = Window.partitionBy("hilbert", "bucket").orderBy("hash", *kept)
    rank = F.col("before") + F.row_number().over(ordered) - 1
    ranked = rows.join(starts, ["hilbert", "bucket"]).withColumn("rank", rank)
    shard = F.expr(f"cast((rank * {shards}L) div {max(1, total)}L as int)")
    first = F.expr(f"({total}L * shard + {shards - 1}L) div {shards}L")
    placed = ranked.withColumn("shard", shard).withColumn("slot", (F.col("rank") - first).cast("long"))
    return placed.select(*(F.col(n).alias(k) for n, k in zip(kept, keys)), *(F.col(c).alias(free_name(df.select(*(f"`{k}`" for k in keys)), c)) for c in ("hilbert", "shard", "slot")))
