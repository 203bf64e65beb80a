"""Columns and keys that are named like an operator's own steps change nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstack.operators import background, coadd, colour, drizzle, project


@pytest.fixture(scope="module")
def px(spark):
    rng = np.random.default_rng(1)
    rows = [(k, 0, y, x, float(rng.uniform(0.1, 0.9)), float(rng.uniform(0.2, 1))) for k in range(2) for y in range(8) for x in range(8)]
    return spark.createDataFrame(rows, "frame int, ch int, y int, x int, v double, weight double").cache()


def values(df, columns, key):
    return {tuple(r[k] for k in key): tuple(None if r[c] is None else round(r[c], 9) for c in columns) for r in df.collect()}


CASES = {
    "preview": (lambda p, k, w: colour.preview(p, k), ["b", "w", "n", "lo", "hi", "_s", "t", "above"], ["shown"]),
    "interbatch": (lambda p, k, w: background.interbatch_normalised(p, k, p.select(*k, "y", "x", F.lit(0.25).alias("model"))), ["model", "_level", "_after"], ["v"]),
    "feather": (lambda p, k, w: background.feather(p, k, 8, 8, w, reach=4), ["_b", "_f", "_g"], ["v"]),
    "blend": (lambda p, k, w: background.low_weight_blend(p, k, 8, 8, w, reach=4), ["_t", "_on", "_fill", "_new", "_soft"], ["v"]),
    "coverage": (lambda p, k, w: background.coverage_masked(p, k, 8, 8, 0.6, w, 1.0), ["_b", "_top"], ["v"]),
    "smooth": (lambda p, k, w: background.smooth_background(p, k, 8, 8, 2, w, 10), ["_m", "_s", "_n"], ["model"]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_other_columns(px, name):
    run, taken, out = CASES[name]
    own = px.withColumns({c: F.lit("own") for c in taken if c != "model"})
    own = own.withColumn("model", F.lit(5.0)) if "model" in taken else own
    plain = run(px, ["frame"], "weight")
    got = run(own, ["frame"], "weight")
    place = ["frame", "y", "x"]
    assert values(got, out, place) == values(plain, out, place)
    if set(px.columns) <= set(plain.columns):
        assert all(c in got.columns for c in own.columns) and len(set(got.columns)) == len(got.columns)
        assert all(set(r) == {"own"} for r in got.select(*(c for c in taken if c != "model")).distinct().collect()) or taken == ["model"]


@pytest.mark.parametrize("key", ["f", "c", "w", "area", "cx", "ox"])
def test_keys(px, key):
    own = px.withColumnRenamed("frame", key)
    place = lambda k: [k, "y", "x"]
    to = lambda x, y: (x + 0.3, y - 0.2)
    kernels = [lambda p, k: drizzle.drizzle_square(p, [k], to, 8, 8, 0.8, F.col("weight")), lambda p, k: drizzle.drizzle_kernel(p, [k], *to(F.col("x"), F.col("y")), 8, 8, "gaussian")]
    for run in kernels:
        assert values(run(own, key), ["sci", "wht"], place(key)) == values(run(px, "frame"), ["sci", "wht"], place("frame"))
    targets = px.select("frame", F.col("y").alias("ty"), F.col("x").alias("tx"), (F.col("y") * 0.9).alias("sy"), (F.col("x") * 0.8).alias("sx"))
    plain = project.reproject_bilinear(px, ["frame"], targets, ("ch",))
    got = project.reproject_bilinear(own, [key], targets.withColumnRenamed("frame", key), ("ch",))
    assert values(got, ["value"], [key, "ch", "ty", "tx"]) == values(plain, ["value"], ["frame", "ch", "ty", "tx"])


def test_matched(px):
    own = px.withColumn("correction", F.lit("own"))
    got = coadd.matched(own, "frame")
    assert values(got, ["v"], ["frame", "y", "x"]) == values(coadd.matched(px, "frame"), ["v"], ["frame", "y", "x"])
    assert {r["correction"] for r in got.collect()} == {"own"}
