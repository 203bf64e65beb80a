"""Operators against NumPy, and properties that must hold whatever the partitioning."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstack import model
from lumenstack.functions import stretch, wcs
from lumenstack.operators import project, robust, spatial, stack

KEY = ["ch", "y", "x"]


def pixels(spark, frames: np.ndarray):
    """frames: (N, H, W)."""
    rows = [(i, 0, y, x, None if np.isnan(v) else float(v)) for i, f in enumerate(frames) for (y, x), v in np.ndenumerate(f)]
    return spark.createDataFrame(rows, "frame_id int, ch int, y int, x int, v double")


def image(df, column="value"):
    rows = df.collect()
    out = np.full((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["y"], r["x"]] = np.nan if r[column] is None else r[column]
    return out


def winsorize(a, limits):
    """Along axis 0, masked samples last, k rounded half to even."""
    n = len(a)
    low, high = int(round(limits[0] * n)), int(round(limits[1] * n))
    order, s = np.argsort(a, 0, kind="stable"), np.sort(a, 0)
    if low:
        np.put_along_axis(a, order[:low], s[low : low + 1].repeat(low, 0), 0)
    if high:
        np.put_along_axis(a, order[n - high :], s[n - high - 1 : n - high].repeat(high, 0), 0)
    return a


def winsorized_sigma(frames, kappa, limits, rounds=5, decay=0.9):
    keep = ~np.isnan(frames)
    for i in range(rounds):
        w = winsorize(np.where(keep, frames, np.nan), limits)
        m, s, k = np.nanmean(w, 0), np.nanstd(w, 0, ddof=1), kappa * decay**i
        new = keep & (frames >= m - k * s) & (frames <= m + k * s)
        if (new == keep).all():
            break
        keep = new
    w = winsorize(np.where(keep, frames, np.nan), limits)
    return np.nanmean(np.where(keep, frames, w), 0), keep


def test_mean_of_constants(spark):
    frames = np.stack([np.full((4, 4), v) for v in (1.0, 2.0, 3.0)])
    assert (image(stack.mean(pixels(spark, frames), KEY)) == 2).all()
    assert (image(stack.live_average(pixels(spark, frames), KEY)) == 2).all()


def test_winsorized_sigma(spark):
    rng = np.random.default_rng(0)
    frames = rng.normal(100, 5, (40, 3, 3))
    bad = rng.random(frames.shape) < 0.05
    frames[bad] = rng.uniform(150, 200, bad.sum())
    got = stack.winsorized_sigma(pixels(spark, frames), KEY)
    want, keep = winsorized_sigma(frames.copy(), 3.0, (0.05, 0.05))
    assert np.allclose(image(got), want, rtol=1e-9)
    assert np.allclose(image(got, "kept"), keep.sum(0))
    assert abs(image(got).mean() - frames[~bad].mean()) < 2


def test_kappa_sigma_masks_and_weights(spark):
    frames = np.array([[[1.0]], [[1.1]], [[0.9]], [[1.0]], [[50.0]], [[np.nan]]])
    px = pixels(spark, frames).withColumn("w", F.col("frame_id") + 1.0)
    (r,) = stack.kappa_sigma(px, KEY, 1.5, 1.5, "w").collect()
    assert r["kept"] == 4 and r["value"] == pytest.approx((1 + 2.2 + 2.7 + 4) / 10) and r["rejected_pct"] == pytest.approx(100 / 3)


def test_batches_do_not_matter(spark):
    frames = np.random.default_rng(1).random((12, 3, 4))
    px = pixels(spark, frames)
    whole = image(stack.mean(px, KEY))
    for size in (1, 2, 5, 12):
        split = px.withColumn("b", F.floor(F.col("frame_id") / size)).repartition(size)
        assert np.allclose(image(stack.combine_batches(split, KEY, "b")), whole, rtol=1e-9)


def test_drizzle(spark):
    frames = np.full((1, 8, 8), 5.0)
    px = pixels(spark, frames)
    same = project.drizzle_turbo(px, [], F.col("x").cast("double"), F.col("y").cast("double"), 8, 8)
    assert (image(same, "sci") == 5).all() and np.allclose(image(same, "wht"), 1)
    moved = project.drizzle_turbo(px, [], F.col("x") + 0.3, F.col("y") - 0.7, 9, 9)
    total = sum(r["wht"] for r in moved.collect())
    assert total == pytest.approx(8 * (8 - 0.7), abs=1e-9)  # the image starts at -0.5, the first row's boxes at -1.2
    two = px.withColumn("w", F.lit(1.0)).unionAll(px.withColumn("v", F.lit(20.0)).withColumn("w", F.lit(0.5)))
    mixed = project.drizzle_point(two, [], F.col("x"), F.col("y"), 8, 8, F.col("w"))
    assert np.allclose(image(mixed, "sci"), 10.0) and np.allclose(image(mixed, "wht"), 1.5)


def test_finalize_modes(spark):
    acc = spark.createDataFrame([(0, 0, 0, 10.0, 2.0), (0, 0, 1, 9.0, 1.0)], "g int, y int, x int, sum double, wht double")
    for mode, want in (("divide", [5, 9]), ("max", [10, 18]), ("n_images", [7.5, 13.5]), ("none", [10, 9]), ("other", [5, 9])):
        assert image(project.finalize(acc, ["g"], mode))[0].tolist() == want


def test_sky_round_trip(spark):
    w = {k: F.lit(v) for k, v in wcs.synthetic(359.99, -60.0, 200.0, 3.0, 100, 80).items()}
    df = spark.range(50).select((F.col("id") * 2).cast("double").alias("x"), (F.col("id") * 1.5).alias("y"))
    ra, dec = wcs.pixel_to_sky(F.col("x"), F.col("y"), w)
    bx, by = wcs.sky_to_pixel(F.col("ra"), F.col("dec"), w)
    worst = df.withColumns({"ra": ra, "dec": dec}).select(F.max(F.abs(bx - F.col("x")) + F.abs(by - F.col("y")))).first()[0]
    assert worst < 1e-8


def test_grid_of_scale():
    grid = wcs.scaled_grid(wcs.synthetic(10.0, 20.0, 250.0, 2.9, 40, 32), 2.0)
    assert (grid["naxis1"], grid["naxis2"]) == (80, 64) and grid["crpix1"] == 41.0


def test_mosaic_reference(spark):
    tiles = np.stack([np.full((6, 6), v) for v in (0.0, 100.0, 200.0)])
    px = pixels(spark, tiles)
    coverage = px.groupBy("frame_id").agg(F.lit(1.0).alias("fraction"))
    (r,) = robust.background_reference(robust.plane_metrics(px, ["frame_id"]), coverage, "frame_id").collect()
    assert r["frame_id"] == 1
    offsets = {r["frame_id"]: r["offset"] for r in robust.background_offsets(px.withColumn("frame_id", F.pmod(F.col("frame_id") - 1, F.lit(3))).withColumn("g", F.lit(0)), ["g"], "frame_id").collect()}
    assert offsets == {0: 0.0, 1: -100.0, 2: 100.0}


def test_linear_fit_brings_frames_together(spark):
    base = np.random.default_rng(3).random((6, 6))
    px = pixels(spark, np.stack([base, 2 * base + 1])).withColumn("g", F.lit(0))
    out = robust.normalize_linear(px, ["g"], "frame_id")
    assert np.allclose(image(out.where("frame_id = 1"), "v"), base, atol=1e-9)


def test_crop_downsample_and_pack(spark):
    frame = np.arange(16.0).reshape(4, 4)
    px = pixels(spark, frame[None]).withColumn("w", F.expr("if(y between 1 and 2 and x between 1 and 2, 1.0, 0.0)"))
    assert image(spatial.crop_to_coverage(px, ["frame_id"]), "v").tolist() == frame[1:3, 1:3].tolist()
    assert image(spatial.downsample(px, ["frame_id"]), "v").tolist() == [[2.5, 4.5], [10.5, 12.5]]
    (packed,) = model.pack_frames(px, ["frame_id"]).collect()
    assert packed["data"] == frame.ravel().tolist() and (packed["h"], packed["w"]) == (4, 4)


def test_nan_is_masked(spark):
    df = spark.createDataFrame([(0, [1.0, float("nan"), float("inf"), 4.0])], "frame_id int, data array<double>")
    assert [r["v"] for r in model.explode_frames(df, 2).orderBy("y", "x").collect()] == [1.0, None, None, 4.0]


def test_quantise_truncates(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (0.25,), (-3.0,)], "v double")
    assert [r[0] for r in df.select(stretch.quantise(F.col("v"))).collect()] == [0, 65535, 32767, 16383, 0]


def test_pairwise_offsets_of_many_labels_with_gaps(spark):
    """Each two of 14 tiles whose labels are up to 1,000 apart, and the solution of their levels; one tile meets none."""
    labels = [0, 1, 2, 30, 31, 50, 90, 91, 92, 93, 94, 95, 400, 1000]
    level = {k: (7 * i) % 11 - 4.0 for i, k in enumerate(labels)}
    rows = [(k, 0, x, level[k] + 0.1 * x) for k in labels for x in range(3)] + [(2000, 9, 9, 5.0)]
    px = spark.createDataFrame(rows, "tile long, y int, x int, v double")
    pairs = robust.pairwise_offsets(px, "tile", ["y", "x"])
    got = {(p["a"], p["b"]): (round(p["offset"], 9), p["overlap"]) for p in pairs.collect()}
    assert got == {(a, b): (level[a] - level[b], 3) for a in labels for b in labels if a < b}
    mean = sum(level.values()) / len(labels)
    solved = {p["tile"]: p["correction"] for p in robust.solve_offsets(pairs, px, "tile").collect()}
    assert solved.pop(2000) == 0.0
    assert all(abs(solved[k] - (level[k] - mean)) < 1e-9 for k in labels) and len(solved) == len(labels)


def test_running_average_covers_every_pixel(spark):
    from lumenstack.queries import QUERIES, frames

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    out = QUERIES["running_average_pixels"](spark, folder)
    assert out.select("y", "x").distinct().count() == 64
    assert out.count() == frames(spark, folder).count()
