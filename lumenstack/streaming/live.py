"""Live stacking: a stream of frames is gated, brought onto its first frame, and added into sums that any batching leaves
the same.

Sums are written by foreachBatch to a table in a shared folder, in parts (squares of pixels) and one version a trigger: version n
has the parts that batch n touches, each as its version before with the batch's sums added, so a batch that is run again writes
the same version again, a query that stops goes on where it was, and a version that fails to be written leaves the ones
before it whole. A part's versions but the last two are removed. Nothing of an image comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstack.operators import robust, stars
from lumenstack.sources import bands
from lumenstack.work import materialise, shared_dir


def has_rows(spark: SparkSession, path: str) -> bool:
    try:
        return spark.read.parquet(path).limit(1).count() > 0
    except AnalysisException:
        return False


def version(folder: str, number: int) -> str:
    return f"{folder}/sums/version={number}"


def part_of(key: list[str], tile: int) -> Column:
    """The part of the sums that a row is in: its square of tile x tile pixels, or one of 64 by its key where that has no pixel."""
    if {"y", "x"} <= set(key):
        square = [F.floor(F.col(c) / tile).cast("string") for c in ("y", "x")]
        return F.concat(F.lit("p"), square[0], F.lit("_"), square[1])
    return F.concat(F.lit("p"), F.pmod(F.hash(*key), F.lit(64)).cast("string"))


def newest(every: DataFrame, before: int | None = None) -> DataFrame:
    """(part, version): the last version of each part, of those before a number if one is given."""
    held = every if before is None else every.where(F.col("version") < before)
    return held.groupBy("part").agg(F.max("version").alias("version"))


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The sums after the last trigger: each part as its last version has it."""
    every = spark.read.parquet(f"{folder}/sums")
    return every.join(newest(every), ["part", "version"]).drop("version", "part")


def can_resume(spark: SparkSession, folder: str) -> bool:
    """Whether the folder has sums to go on from."""
    return has_rows(spark, f"{folder}/sums")


def drop_old(spark: SparkSession, folder: str, number: int) -> None:
    """Removes what neither the sums after trigger `number` nor those before it need: the trigger may run again."""
    every = spark.read.parquet(f"{folder}/sums").select("version", "part").distinct()
    kept = newest(every).union(newest(every, number))
    old = every.join(kept, ["part", "version"], "left_anti").collect()  # names of folders: a part has two after each trigger, and one more now
    hadoop = spark._jvm.org.apache.hadoop.fs
    for r in old:
        path = hadoop.Path(f"{version(folder, r['version'])}/part={r['part']}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(stream: DataFrame, folder: str, key: list[str], partial: Callable[[DataFrame, int], DataFrame], after: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None, tile: int = 256):
    """Starts a query that adds partial(batch, number), a table (key, sum, wht), into the sums in folder, and returns it.
    after: called with the sums of every trigger, the last and smaller group included; for display, it changes nothing.
    trigger: of the query; what is there and no more by default. tile: side of the squares of pixels that are rewritten whole."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sums = materialise(partial(batch, number).select(*key, "sum", "wht", part_of(key, tile).alias("part")))
        if number and can_resume(spark, folder):
            every = spark.read.parquet(f"{folder}/sums")
            before = newest(every, number).join(sums.select("part").distinct(), "part")
            sums = sums.unionByName(every.join(before, ["part", "version"]).drop("version"))
        new = sums.groupBy("part", *key).agg(F.sum("sum").alias("sum"), F.sum("wht").alias("wht"))
        new.write.mode("overwrite").partitionBy("part").parquet(version(folder, number))
        some = can_resume(spark, folder)
        if some:
            drop_old(spark, folder, number)
        if after:
            after(latest(spark, folder) if some else new.drop("part").limit(0), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def run_once(spark: SparkSession, path: str, key: str, gate: Column, files_per_trigger: int = 1, value: str = "value") -> DataFrame:
    """Reads all files under path as a stream, in order, a group of files a trigger, and returns the final (key, sum, wht)
    of the samples that pass the gate."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")
    folder = shared_dir(spark)
    fold(stream, folder, [key], lambda batch, _: batch.where(gate).groupBy(key).agg(F.sum(value).alias("sum"), F.count(F.lit(1)).alias("wht"))).awaitTermination()
    return latest(spark, folder)


def frame_sums(folder: str, frame: str = "frame_id", least: int = 100, keep_from: float = 2.5, sigma: float = 5.0) -> Callable[[DataFrame, int], DataFrame]:
    """A partial() of samples (frame, ch, y, x, v): frames under the signal-to-noise threshold go; the first frame that
    passes is the reference, kept in the folder; all others are aligned to it by their stars, and those that cannot be
    go too."""

    def run(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        place = f"{folder}/reference"
        grey = batch.groupBy(frame, "y", "x").agg(F.avg("v").alias("v"))
        passed = robust.snr(grey, [frame], least, keep_from).where("kept").select(frame)
        good = batch.join(passed, frame, "left_semi")
        found = stars.detect(good.groupBy(frame, "y", "x").agg(F.avg("v").alias("v")).withColumn("ch", F.lit(0)), [frame], sigma)
        if not has_rows(spark, place):
            first = passed.agg(F.min(frame).alias(frame))
            if first.where(F.col(frame).isNotNull()).count():
                found.join(first, frame).write.mode("overwrite").parquet(place)
        if not has_rows(spark, place):
            return good.select("ch", "y", "x", F.col("v").alias("sum"), F.lit(1).cast("long").alias("wht")).limit(0)
        reference = spark.read.parquet(place)
        moved = stars.warp(good, frame, stars.align(found, frame, reference, passed)).where("ok")
        return moved.groupBy("ch", "y", "x").agg(F.sum("v").alias("sum"), F.count("v").alias("wht"))

    return run


def average(sums: DataFrame) -> DataFrame:
    """value: sum / max(wht, 1e-6)."""
    return sums.withColumn("value", F.col("sum") / F.greatest(F.col("wht").cast("double"), F.lit(1e-6)))


def files_as_frames(spark: SparkSession, roots: list[str], log: str, files_per_trigger: int | None = None, roots_file: str | None = None) -> DataFrame:
    """A stream of samples (frame_id, ch, y, x, v) of the FITS files below the roots, and below those that roots_file comes to
    name while it runs; a frame is named by its path and comes once. log: a kept and shared folder."""
    bands.register(spark)
    options = {"path": ",".join(roots), "log": log} | ({"filesPerTrigger": files_per_trigger} if files_per_trigger else {}) | ({"roots_file": roots_file} if roots_file else {})
    return bands.samples(spark.readStream.format("frame_files").options(**options).load())
