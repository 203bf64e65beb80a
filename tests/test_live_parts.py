"""Sums of a live stack by parts: a trigger writes what it touches, old versions go, a trigger that runs again changes nothing."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstack.streaming import live


def partial(batch, number):
    return batch.groupBy("ch", "y", "x").agg(F.sum("v").alias("sum"), F.count("v").alias("wht"))


def write(spark, folder, name, cells):
    rows = [(0, y, x, float(v)) for y, x, v in cells]
    spark.createDataFrame(rows, "ch int, y int, x int, v double").coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, source, work, **more):
    stream = spark.readStream.schema("ch int, y int, x int, v double").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    live.fold(stream, work, ["ch", "y", "x"], partial, tile=10, **more).awaitTermination()


def parts(work):
    return {(int(v.split("=")[1]), p.split("=")[1]) for v in os.listdir(f"{work}/sums") if v.startswith("version=") for p in os.listdir(f"{work}/sums/{v}") if p.startswith("part=")}


def sums(spark, work):
    return {(r["y"], r["x"]): (r["sum"], r["wht"]) for r in live.latest(spark, work).collect()}


@pytest.fixture
def places(tmp_path):
    return f"{tmp_path}/in", f"{tmp_path}/work"


def test_touched_parts_only(spark, places):
    source, work = places
    rng = np.random.default_rng(1)
    want: dict = {}

    def add(name, cells):
        cells = [(y, x, float(rng.integers(1, 9))) for y, x in cells]
        write(spark, source, name, cells)
        for y, x, v in cells:
            s, n = want.get((y, x), (0.0, 0))
            want[y, x] = s + v, n + 1

    add("a", [(y, x) for y in range(0, 40, 3) for x in range(0, 40, 3)])
    run(spark, source, work)
    assert sums(spark, work) == want and len(parts(work)) == 16
    add("b", [(12, 25), (13, 29), (19, 20)])
    run(spark, source, work)
    assert sums(spark, work) == want and {p for p in parts(work) if p[0] == 1} == {(1, "p1_2")}
    for k in range(3):
        add(f"c{k}", [(12, 25), (39, 39)])
    run(spark, source, work)
    assert sums(spark, work) == want
    held = parts(work)
    assert {v for v, p in held if p == "p1_2"} == {3, 4} and {v for v, p in held if p == "p3_3"} == {3, 4} and {v for v, p in held if p == "p0_0"} == {0}


def test_a_trigger_that_runs_again(spark, places):
    """The last trigger's commit is taken back, as if the driver had died before it."""
    source, work = places
    write(spark, source, "a", [(0, 0, 1.0), (15, 15, 2.0)])
    run(spark, source, work)
    write(spark, source, "b", [(0, 0, 4.0)])
    run(spark, source, work)
    before = sums(spark, work)
    for name in ("1", ".1.crc"):
        os.remove(f"{work}/checkpoint/commits/{name}")
    run(spark, source, work)
    assert sums(spark, work) == before == {(0, 0): (5.0, 2), (15, 15): (2.0, 1)}


def test_nothing_and_keys_without_pixels(spark, places):
    source, work = places
    write(spark, source, "a", [])
    run(spark, source, work)
    assert not live.can_resume(spark, work)
    write(spark, source, "b", [(0, 0, 1.0)])
    run(spark, source, work)
    assert sums(spark, work) == {(0, 0): (1.0, 1)}
    rows = spark.range(1000).select(live.part_of(["id"], 10).alias("p")).distinct().count()
    assert 50 < rows <= 64
