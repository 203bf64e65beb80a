"""Drizzle by frames' own headers, raw frames with optics, final images and display adjustments against NumPy or stated cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import image, pixels

from lumenstack.functions import wcs
from lumenstack.operators import colour, drizzle, panels
from lumenstack.plans import lifecycle
from lumenstack.sources import fits

GRID = wcs.synthetic(10.0, 20.0, 250.0, 2.9, 5, 5)
SKY = {"CRVAL1": "10.0", "CRVAL2": "20.0", "CRPIX1": "3.0", "CRPIX2": "3.0", "CD1_1": str(GRID["cd11"]), "CD2_2": str(GRID["cd22"])}


def moves(*m):
    return dict(zip(panels.MATRIX, map(str, m)))


def frames_of(spark, headers):
    return spark.createDataFrame(list(enumerate(headers)), "frame_id int, header map<string,string>")


@pytest.mark.parametrize("kernel", ["square", "turbo", "gaussian", "no such kernel"])
def test_each_frame_goes_by_its_own_matrix(spark, kernel):
    shots = np.random.default_rng(5).random((3, 5, 5))
    shots[0, 2, 2] = np.nan
    frames = frames_of(spark, [SKY | moves(1, 0, 0.317, 0, 1, 0.441) | {"EXPTIME": "2"}, SKY | moves(0.9, -0.2, 0.413, 0.2, 0.9, 0.129), SKY])
    got = panels.drizzle_frames(pixels(spark, shots), frames.unionAll(frames), "frame_id", [], GRID, kernel, 0.8, "counts", local=True)
    one = lambda i, m, e: (pixels(spark, shots[i : i + 1]).withColumn("v", F.coalesce("v", F.lit(0.0)) / e), lambda x, y: wcs.affine(x, y, tuple(map(F.lit, m))))
    parts = [one(0, (1.0, 0.0, 0.317, 0.0, 1.0, 0.441), 2.0), one(1, (0.9, -0.2, 0.413, 0.2, 0.9, 0.129), 1.0)]
    x, y = F.col("x").cast("double"), F.col("y").cast("double")

    def alone(px, to):
        if kernel in ("square", "no such kernel"):
            return drizzle.drizzle_square(px, [], to, 5, 5, 0.8)
        if kernel == "turbo":
            return panels.project.drizzle_turbo(px, [], *to(x, y), 5, 5, 0.8)
        return drizzle.drizzle_kernel(px, [], *to(x, y), 5, 5, kernel, 0.8)

    want = alone(*parts[0]).unionByName(alone(*parts[1])).groupBy("y", "x").agg(F.sum("sum").alias("sum"), F.sum("wht").alias("wht"))
    for column in ("sum", "wht"):
        assert np.allclose(np.nan_to_num(image(got, column)), np.nan_to_num(image(want, column)), atol=1e-6)


def test_standard_mode_one_anchor_masks_and_refusals(spark):
    shots = np.ones((4, 5, 5))
    shots[1, 0, 0] = np.nan
    headers = [SKY, moves(1, 0, 0, 0, 1, 0), SKY | moves(1, 0, 0, 0, 1, "x"), None]
    frames, px = frames_of(spark, headers), pixels(spark, shots).withColumn("placed_frame", F.lit(7))
    reasons = lambda **k: {r["frame_id"]: r["reason"] for r in panels.refusals(frames, "frame_id", **k).collect()}
    assert reasons() == {1: "no celestial coordinates", 3: "no header"}
    assert reasons(local=True) == {0: "no matrix", 1: "no celestial coordinates", 2: "no matrix", 3: "no header"}
    assert reasons(local=True, anchored=True) == {0: "no matrix", 2: "no matrix", 3: "no header"}
    own = panels.drizzle_frames(px, frames, "frame_id", [], GRID, "point")
    assert image(own, "wht").tolist() == (np.ones((5, 5)) * 2).tolist()
    anchored = lambda **k: panels.drizzle_frames(px, frames, "frame_id", [], GRID, "point", local=True, anchor=GRID, **k)
    assert image(anchored(), "sum")[0, 0] == 0 or np.isnan(image(anchored(), "sum")[0, 0])
    assert anchored(missing=None).where("x = 0 and y = 0").count() == 0
    masked = panels.drizzle_frames(px.withColumn("w", F.when(F.col("x") < 2, 0.0).otherwise(3.0)), frames, "frame_id", [], GRID, "point", weight="w")
    assert image(masked, "wht")[0].tolist() == [0, 0, 6, 6, 6]
    with pytest.raises(ValueError, match="placed"):
        panels.drizzle_frames(px, frames_of(spark, [None, {}]), "frame_id", [], GRID)
    with pytest.raises(ValueError, match="units"):
        panels.drizzle_frames(px, frames, "frame_id", [], GRID, units="adu")


@pytest.mark.parametrize("cards, want", [
    ({"CDELT1": "-2", "CDELT2": "3"}, (-2, 0, 0, 3)),
    ({"CDELT1": "-2", "CDELT2": "3", "CROTA2": "90"}, (0, -3, -2, 0)),
    ({"CDELT1": "2", "CDELT2": "2", "PC1_1": "0.5", "PC1_2": "-0.1", "PC2_1": "0.1", "PC2_2": "0.5"}, (1, -0.2, 0.2, 1)),
    ({"CD1_1": "4", "CD2_2": "5", "CDELT1": "9", "CDELT2": "9"}, (4, 0, 0, 5)),
    ({}, (None,) * 4),
])
def test_coordinates_of_headers(spark, cards, want):
    w = wcs.of_header(F.col("h"))
    (got,) = spark.createDataFrame([(cards,)], "h map<string,string>").select(w["cd11"], w["cd12"], w["cd21"], w["cd22"]).collect()
    assert all(a is None if b is None else a == pytest.approx(b, abs=1e-12) for a, b in zip(got, want))


def test_raw_frames_with_optics(spark, tmp_path):
    optics = {"RA": "10.0", "DEC": "20.0", "FOCALLEN": "250", "XPIXSZ": "2.9", "YPIXSZ": "2.9"}
    level = np.full((6, 7, 1), 0.25)
    (tmp_path / "a.fits").write_bytes(fits.image_bytes(level, optics, False))
    (tmp_path / "b.fits").write_bytes(fits.image_bytes(level, {}, False))
    (tmp_path / "c.fits").write_bytes(b"x" * 10)
    samples, frames = panels.raw_colour(fits.read_fits(spark, f"file://{tmp_path}"), pattern="nonsense")
    assert frames.count() == 1 and samples.count() == 6 * 7 * 3
    grid = wcs.synthetic(10.0, 20.0, 250.0, 2.9, 7, 6)
    out = panels.drizzle_frames(samples, frames, "path", ["ch"], grid, "square", optics=True).collect()
    assert len(out) == 6 * 7 * 3 and all(r["sci"] == pytest.approx(0.25) and r["wht"] == pytest.approx(1, abs=1e-5) for r in out)


def final(spark, value, weight, header, **options):
    rows = [("g", 0, y, x, float(v), float(weight[y, x])) for (y, x), v in np.ndenumerate(value)]
    px = spark.createDataFrame(rows, "name string, ch int, y int, x int, value double, wht double")
    return panels.final_image(px, spark.createDataFrame([("g", header)], "name string, header map<string,string>"), ["name"], **options)


def test_final_image_is_cropped_pointed_and_written(spark, tmp_path):
    value, weight = np.arange(16.0).reshape(4, 4), np.zeros((4, 4))
    weight[1:3, 1:3] = 1
    out = final(spark, value, weight, {"CRPIX1": "2.0", "CRPIX2": "2.0", "CRVAL1": "10.5", "CRVAL2": "-3", "RA": "0"})
    assert image(out).tolist() == value[1:3, 1:3].tolist()
    header = out.first()["header"]
    assert (header["CRPIX1"], header["CRPIX2"], header["RA"], header["DEC"]) == ("1.0", "1.0", "10.5", "-3")
    whole = final(spark, value / 15, np.ones((4, 4)), None, crop=False)
    assert image(whole, "level").tolist() == np.trunc(value / 15 * 65535).tolist() and whole.first()["header"] == {}
    folder = f"file://{tmp_path}/out"
    panels.save_final(out, ["name"], folder)
    panels.save_final(whole, ["name"], f"{folder}16", u16=True)
    (a,), (b,) = fits.read_fits(spark, folder).collect(), fits.read_fits(spark, f"{folder}16").collect()
    assert a["data"] == value[1:3, 1:3].ravel().tolist() and a["header"]["CRPIX1"] == "1.0"
    assert b["data"] == np.trunc(value / 15 * 65535).ravel().tolist() and b["header"]["BZERO"] == "32768"


def test_final_image_scales_and_refuses(spark):
    value = np.random.default_rng(3).random((9, 9)) * 50
    got = image(final(spark, value, np.ones((9, 9)), None, linear=False))
    low, high = np.quantile(value, [0.001, 0.999])
    assert np.allclose(got, np.clip((value - low) / (high - low), 0, 1))
    assert set(image(final(spark, np.full((3, 3), 7.0), np.ones((3, 3)), None, linear=False)).ravel()) == {0.0}
    assert image(final(spark, np.array([[np.nan, np.inf]]), np.ones((1, 2)), None)).tolist() == [[0, 0]]
    with pytest.raises(ValueError, match="no cell has weight"):
        final(spark, value, np.zeros((9, 9)), None)


def test_adjustments_level_by_level(spark):
    rng = np.random.default_rng(8)
    levels = rng.integers(0, 256, (6, 6, 3)).astype(np.int32)
    rows = [("p", y, x, *((levels[y, x] + 0.5) / 255).tolist()) for y in range(6) for x in range(6)]
    px = spark.createDataFrame(rows, "picture string, y int, x int, r double, g double, b double").withColumn("_mean", F.lit("kept"))

    def blend(base, v, factor):
        return np.clip(np.float32(base) + np.float32(factor) * np.float32(v - base), 0, 255).astype(np.int32)

    def grey(a):
        return (a[..., 0] * 19595 + a[..., 1] * 38470 + a[..., 2] * 7471 + 32768) >> 16

    for brightness, contrast, saturation in [(1, 1, 1), (1.4, 1, 1), (1, 0.3, 1), (1, 1, 2.5), (0.7, 1.8, 0), (1.0005, 0, 1)]:
        want = levels
        if abs(brightness - 1) > 1e-3:
            want = blend(0, want, brightness)
        if abs(contrast - 1) > 1e-3:
            want = blend(int(grey(want).mean() + 0.5), want, contrast)
        if abs(saturation - 1) > 1e-3:
            want = blend(grey(want)[..., None], want, saturation)
        got = colour.adjusted(px, ["picture"], brightness, contrast, saturation)
        assert got.columns == px.columns
        assert all(np.array_equal(image(got, c), want[..., i]) for i, c in enumerate("rgb"))


def test_automatic_levels_of_flat_and_small_images(spark):
    flat, few = np.full((1, 4, 4), 0.5), np.ones((1, 3, 3))
    (row,) = colour.automatic_levels(pixels(spark, flat), ["frame_id"]).collect()
    assert (row["black"], row["white"]) == (pytest.approx(0.501), 1.0)
    assert colour.automatic_levels(pixels(spark, few), ["frame_id"]).count() == 0


def test_names_of_outputs_solved_batches_and_exposures(spark):
    names = {"Light_001.fit": True, "stack_1.fit": False, "M31_REPROJECT.fits": False, "a_sum.npy": False, "x_preview.png": False, "my_reference_image.fit": False, "sum_1.fit": True}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", lifecycle.is_candidate(F.col("n"))).collect()
    assert dict(map(tuple, got)) == names
    batches = spark.createDataFrame([(1, SKY | {"CDELT1": "1", "CDELT2": "1"}), (2, {"EXPTIME": "5", "UNITS": "CPS"}), (3, None)], "id int, header map<string,string>")
    assert [r["id"] for r in lifecycle.solved_only(batches).collect()] == [1]
    assert [tuple(r) for r in batches.select(*lifecycle.exposure_of(F.col("header"))).collect()] == [(1.0, "counts"), (5.0, "cps"), (1.0, "counts")]
    with pytest.raises(ValueError, match="a mode"):
        lifecycle.refuse_empty(batches.limit(0), "a mode")
