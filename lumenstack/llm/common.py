"""What the text operators share: table paths, names, slices of batches, and word rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstack.work import forget, materialise, shared_dir  # noqa: F401

#: The ASCII white space that separates words, as a Java pattern and as bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Upper to lower case for A-Z only, as two strings for translate().
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hands whole texts to Python workers in batches of at most so many rows or 4 MB (one row at least), unless
    the session asks for fewer rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, rows)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or wish with underscores before it if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


#: Bits of a map of Spark's bitmap functions, the most maps of a sieve (8 MB), and the bits that a key gets until then.
MAP_BITS, MOST_MAPS, KEY_BITS = 1 << 15, 2048, 32


def sieved(df: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
    """df with the boolean column `name`, false only where df's long column `key` is not in the table `wanted`'s `key`.

    A join of large rows with few keys of a long table can so let most rows out before it shuffles them. It is true
    of some other rows too (1 of 32 until the maps are at their most), so the join must follow. What is sent to all
    tasks is 4 bytes a wanted key, and MOST_MAPS maps at most.
    """
    maps = min(MOST_MAPS, 1 + wanted.count() * KEY_BITS // MAP_BITS)
    at, number, bits = (free_name(df, wish) for wish in ("_at", "_map", "_bits"))
    place = F.pmod(F.xxhash64(key), F.lit(maps * MAP_BITS))
    made = wanted.select(place.alias(at)).groupBy(F.expr(f"{at} div {MAP_BITS}").alias(number)).agg(F.bitmap_construct_agg(F.col(at) % MAP_BITS).alias(bits))
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast({at} % {MAP_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("getbit", byte, F.expr(f"cast({at} % 8 as int)")) == 1, F.lit(False))
    placed = df.withColumn(at, place).withColumn(number, F.expr(f"{at} div {MAP_BITS}"))
    return placed.join(F.broadcast(materialise(made)), number, "left").withColumn(name, hit).drop(number, at, bits)


def slices(texts: pa.Array, size: int = 2_000_000) -> Iterator[pa.Array]:
    """The texts in arrays of about `size` bytes or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield texts[at:upto]
        at = upto


def in_slices(texts: pa.Array, size: int = 2_000_000) -> Iterator[list[str | None]]:
    """As slices(), in lists."""
    return (some.to_pylist() for some in slices(texts, size))
