"""Drizzle, co-addition, live stacking, colour, masks and lifecycle rules against NumPy or stated cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import image, pixels
from test_stars import field

from lumenstack.functions import wcs
from lumenstack.operators import background, coadd, colour, drizzle, robust, spatial, stack, stars
from lumenstack.plans import lifecycle
from lumenstack.sources import fits
from lumenstack.streaming import live

HEADER = "map<string,string>"


def turned(angle, dx, dy, scale=1.0):
    c, s = scale * np.cos(np.radians(angle)), scale * np.sin(np.radians(angle))
    return lambda x, y: (c * x - s * y + dx, s * x + c * y + dy)


def clipped_area(polygon, x, y):
    """Area of a convex polygon within the cell around (x, y), by cutting it at the cell's sides."""
    for axis, low, sign in ((0, x - 0.5, 1), (0, x + 0.5, -1), (1, y - 0.5, 1), (1, y + 0.5, -1)):
        out = []
        for p, q in zip(polygon, polygon[1:] + polygon[:1]):
            a, b = sign * (p[axis] - low), sign * (q[axis] - low)
            if a >= 0:
                out.append(p)
            if a * b < 0:
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        polygon = out
        if not polygon:
            return 0.0
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(polygon, polygon[1:] + polygon[:1]))) / 2


@pytest.mark.parametrize("angle,scale,pixfrac", [(0, 1, 1.0), (30, 1, 0.7), (-72, 2, 0.9)])
def test_square_drizzle_against_polygons(spark, angle, scale, pixfrac):
    frame = np.random.default_rng(1).random((4, 4))
    to = turned(angle, 3.2, 8.9, scale)
    got = image(drizzle.drizzle_square(pixels(spark, frame[None]), [], to, 14, 14, pixfrac), "sum")
    want = np.zeros((14, 14))
    for (y, x), v in np.ndenumerate(frame):
        quad = [to(x + a * pixfrac / 2, y + b * pixfrac / 2) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        for cy in range(14):
            for cx in range(14):
                want[cy, cx] += v * clipped_area(quad, cx, cy) / (pixfrac * scale) ** 2
    inside = np.nan_to_num(got)
    assert np.allclose(inside, want[: got.shape[0], : got.shape[1]], atol=1e-9) and want.sum() == pytest.approx(inside.sum())


def test_drizzle_is_the_same_for_any_batches_and_ends_at_the_border(spark):
    frames_ = np.random.default_rng(2).random((4, 5, 5))
    px, to = pixels(spark, frames_), turned(20, 2.1, 0.4)
    whole = drizzle.drizzle_square(px, [], to, 6, 6, 0.8)
    parts = [drizzle.drizzle_square(px.where(f"frame_id % 2 = {k}"), [], to, 6, 6, 0.8) for k in range(2)]
    merged = parts[0].unionByName(parts[1]).groupBy("y", "x").agg(F.sum("sum").alias("sum"), F.sum("wht").alias("wht"))
    assert np.allclose(image(whole, "sum"), image(merged, "sum"), equal_nan=True)
    gone = drizzle.drizzle_square(px, [], lambda x, y: (x + 6.0, y + 0.0), 6, 6)
    assert gone.count() == 0  # no centre is inside, so nothing is folded onto the edge
    with pytest.raises(ValueError):
        drizzle.drizzle_kernel(px, [], F.col("x"), F.col("y"), 6, 6, "box")


def test_lanczos_keeps_a_flat_image(spark):
    px = pixels(spark, np.full((1, 9, 9), 3.0))
    out = drizzle.drizzle_kernel(px, [], F.col("x") + 0.25, F.col("y") + 0.0, 9, 9, "lanczos3")
    assert np.allclose(image(out, "sci"), 3.0)


def test_matched_coadd_is_flat_and_drops_what_is_not_celestial(spark):
    grid = wcs.synthetic(40.0, -30.0, 200.0, 3.0, 10, 10)
    rows = [(i, 0, y, x, 5.0 + 100 * i) for i in range(3) for y in range(8) for x in range(8)]
    px = spark.createDataFrame(rows, "frame_id int, ch int, y int, x int, v double")
    base = {c: float(grid[c]) for c in coadd.WCS}
    frames = [(i, *{**base, "crpix1": base["crpix1"] - i, "crpix2": base["crpix2"] - 0.5, **({"cd11": 1e-9, "cd22": 1e-9} if i == 3 else {})}.values(), 8, 8) for i in range(4)]
    table = spark.createDataFrame(frames, "frame_id int, " + ", ".join(f"{c} double" for c in coadd.WCS) + ", naxis1 int, naxis2 int")
    out = coadd.reproject_and_coadd(px, table, "frame_id", grid, match_background=True).collect()
    values = {round(r["value"], 6) for r in out}
    assert len(values) == 1 and max(r["coverage"] for r in out) == 3
    assert coadd.mosaic_grid(table).first()["dropped"] == 1 and coadd.rotated_grid(table).first()["dropped"] == 1
    with pytest.raises(RuntimeError):
        coadd.covered(spark.createDataFrame([(0, 0.0)], "x int, coverage double"))
    up = coadd.fixed_orientation({**grid, "cd11": 0.0, "cd12": -0.001, "cd21": 0.001, "cd22": 0.0}, 2.0)
    assert (up["cd12"], up["cd21"], up["naxis1"]) == (0.0, 0.0, 20) and up["cd22"] == pytest.approx(0.0005)


def test_channels_and_masters(spark):
    rows = [(0, 0, 0, 0, 3.0)] + [(1, c, 0, 0, float(c)) for c in range(3)]
    px = spark.createDataFrame(rows, "frame_id int, ch int, y int, x int, v double")
    assert sorted((r["frame_id"], r["ch"], r["v"]) for r in coadd.with_channels(px, "frame_id", True).collect()) == [(0, 0, 3), (0, 1, 3), (0, 2, 3), (1, 0, 0), (1, 1, 1), (1, 2, 2)]
    assert sorted((r["frame_id"], r["v"]) for r in coadd.with_channels(px, "frame_id", False).collect()) == [(0, 3), (1, 1)]
    batch = spark.createDataFrame([(0, float("nan"), 2.0), (1, 4.0, 0.0), (2, None, None)], "x int, img double, cov double")
    got = {r["x"]: (r["value"], r["coverage"]) for r in coadd.master_image(coadd.merge_masters([coadd.master_of(batch, ["x"])] * 2, ["x"]), ["x"]).collect()}
    assert got == {0: (0.0, 4.0), 1: (0.0, 0.0), 2: (0.0, 0.0)}


def test_mosaic_with_a_forced_reference(spark):
    tiles = pixels(spark, np.stack([np.full((6, 6), v) for v in (0.0, 100.0, 200.0)]))
    for reference, level in ((None, 100), (2, 200)):
        assert {r["value"] for r in coadd.assemble_mosaic(tiles, "frame_id", reference=reference).collect()} == {level}
    assert {round(r["value"], 9) for r in coadd.assemble_mosaic(tiles, "frame_id", match_background=False).collect()} == {100}


def test_hot_pixels_of_larger_boxes(spark):
    rng = np.random.default_rng(4)
    frame = rng.random((12, 10))
    frame[3, 4], frame[0, 0], frame[11, 5] = 9, 8, 7
    for size in (4, 5, 7):
        half = (size | 1) // 2
        near, mirror = np.pad(frame, half, "edge"), np.pad(frame, half, "reflect")
        view = lambda a: np.lib.stride_tricks.sliding_window_view(a, (size | 1, size | 1)).reshape(12, 10, -1)
        med, m, m2 = np.median(view(near), 2), view(mirror).mean(2), (view(mirror) ** 2).mean(2)
        want = np.where(frame > med + 3 * np.maximum(np.sqrt(np.maximum(m2 - m * m, 1e-10)), 1e-5), med, frame)
        out = spatial.hot_pixels(pixels(spark, frame[None]), ["frame_id"], 3.0, size)
        assert np.allclose(image(out, "v"), want) and out.where("hot").count() == (want != frame).sum() > 0


def test_blur_background_and_masks(spark):
    y, x = np.mgrid[:20, :20]
    px = pixels(spark, (1200.0 + x + y)[None])
    model = background.smooth_background(px, ["frame_id"], 20, 20)
    flat = image(background.interbatch_normalised(px, ["frame_id"], model), "v")
    assert np.median(flat) == pytest.approx(np.median(1200.0 + x + y)) and flat.std() < (x + y).std() / 2
    few = background.smooth_background(px.where("y < 3"), ["frame_id"], 20, 20)
    assert few.agg(F.max("model")).first()[0] == 0
    with pytest.raises(ValueError):
        background.blur(px, ["frame_id"], 51, 20, 20)
    same = background.convolve(pixels(spark, np.full((1, 5, 7), 2.0)), ["frame_id"], background.gaussian_kernel(9), 5, 7)
    assert np.allclose(image(same, "v"), 2.0)
    weights = pixels(spark, np.full((1, 8, 8), 0.5)).withColumn("w", F.lit(0.0))
    assert not background.low_weight_blend(weights, ["frame_id"], 8, 8, reach=4).where("masked").count()


def test_neutral_background(spark):
    rng = np.random.default_rng(7)
    h = w = 32
    sky = rng.normal(0.2, 0.01, (h, w))
    sky[:8] += 0.5
    rows = [(0, c, yy, xx, float(sky[yy, xx] * k)) for c, k in enumerate((1.5, 1.0, 0.8)) for yy in range(h) for xx in range(w)]
    px = spark.createDataFrame(rows, "picture int, ch int, y int, x int, v double")
    (gain,) = colour.neutral_background(px, ["picture"], h, w, grid=4).collect()
    assert gain["red"] == pytest.approx(1 / 1.5, rel=0.02) and gain["blue"] == pytest.approx(1.25, rel=0.02)
    assert colour.neutral_background(px, ["picture"], h, w, grid=16).count() == 0


def test_preview_of_odd_images(spark):
    flat, white = np.full((8, 8), 0.4), np.full((8, 8), 0.9)
    white[0, 0] = 0.0
    out = image(colour.preview(pixels(spark, flat[None]), ["frame_id"]), "shown")
    assert np.isfinite(out).all() and out.min() >= 0 and out.max() <= 1
    assert image(colour.preview(pixels(spark, white[None]), ["frame_id"], True), "shown")[0, 0] == 0


def test_warp_keeps_what_cannot_be_aligned(spark):
    rng = np.random.default_rng(6)
    points = (np.array([[x, y] for x in (18, 33, 48, 63) for y in (18, 33, 48, 63)]) + rng.uniform(-5, 5, (16, 2)))[:9]
    moved = points + np.array([3.0, -2.0])
    px = pixels(spark, np.stack([field(points), field(moved), np.full((80, 80), 10.0)]))
    out = stars.align_frames(px, "frame_id", 0)
    ok = {r["frame_id"]: r["ok"] for r in out.select("frame_id", "ok").distinct().collect()}
    assert ok == {0: True, 1: True, 2: False}
    a, b = image(out.where("frame_id = 0"), "v"), image(out.where("frame_id = 1"), "v")
    assert np.abs(a - b)[8:-8, 8:-8].max() < 4 and (image(out.where("frame_id = 2"), "v") == 10).all()
    weights = {r["frame_id"]: r["weight"] for r in stars.fwhm_weights(stars.detect(px, ["frame_id"]), "frame_id", px).collect()}
    assert weights[2] == 1.0 and 0.5 < weights[0] <= 1.0


def test_live_stack_of_frames(spark, tmp_path):
    """Gate, reference, alignment and sums; one frame or two a trigger give the same; a second start adds nothing."""
    rng = np.random.default_rng(6)
    points = (np.array([[x, y] for x in (18, 33, 48, 63) for y in (18, 33, 48, 63)]) + rng.uniform(-5, 5, (16, 2)))[:9]
    noise = np.random.default_rng(9).normal(0, 50, (80, 80))
    for i, frame in enumerate((noise, field(points), field(points + [2.0, 1.0]))):
        pixels(spark, frame[None]).withColumn("frame_id", F.lit(i)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    images = []
    for group in (1, 2):
        folder, seen = f"{tmp_path}/out{group}", []
        for _ in range(2):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", group).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
            live.fold(stream, folder, ["ch", "y", "x"], live.frame_sums(folder), lambda sums, n: seen.append(n)).awaitTermination()
        assert live.can_resume(spark, folder) and seen == list(range(-(-3 // group)))
        sums = live.latest(spark, folder)
        assert sums.agg(F.max("wht")).first()[0] == 2
        images.append(image(live.average(sums)))
    assert np.allclose(*images) and not live.can_resume(spark, f"{tmp_path}/nothing")


def test_fits_rules(spark, tmp_path):
    cube = np.zeros((5, 5, 5))
    (tmp_path / "odd.fits").write_bytes(fits.image_bytes(cube, {"OBJECT": "odd"}, False))
    (tmp_path / "stacked").mkdir()
    (tmp_path / "stacked/old.fits").write_bytes(fits.image_bytes(np.ones((6, 6, 1)), {}, False))
    (tmp_path / "flat.fits").write_bytes(fits.image_bytes(np.full((6, 6, 1), 7.0), {"CD1_1": "-0.001", "CD2_2": "0.001"}, False))
    ramp = np.arange(36.0).reshape(6, 6, 1)
    ramp[0, 1] = np.nan
    (tmp_path / "ramp.fits").write_bytes(fits.image_bytes(ramp, {}, False))
    np.save(tmp_path / "a.npy", np.arange(12.0).reshape(3, 4))
    name = lambda r: r["path"].rsplit("/", 1)[1]
    frames = fits.read_fits(spark, f"file://{tmp_path}")
    got = {name(r): r for r in fits.normalised(frames).collect()}
    assert set(got) == {"odd.fits", "flat.fits", "ramp.fits"}
    assert got["odd.fits"]["data"] is None and got["odd.fits"]["header"]["OBJECT"] == "odd" and got["odd.fits"]["error"]
    assert set(got["flat.fits"]["data"]) == {0.5} and got["ramp.fits"]["data"][1] == 0 and got["ramp.fits"]["data"][-1] == 1
    assert {name(r) for r in fits.read_fits(spark, f"file://{tmp_path}/stacked").collect()} == {"old.fits"}
    heads = {name(r): r for r in fits.read_headers(spark, f"file://{tmp_path}").collect()}
    assert (heads["flat.fits"]["h"], heads["flat.fits"]["w"], heads["flat.fits"]["header"]["CD1_1"]) == (6, 6, "-0.001")
    three = {name(r): r for r in fits.three_channels(fits.normalised(frames)).collect()}
    assert three["ramp.fits"]["c"] == 3 and len(three["ramp.fits"]["data"]) == 108
    assert all(r["data"] is None for r in fits.drizzle_inputs(frames).collect())
    (npy,) = fits.read_npy(spark, f"file://{tmp_path}").collect()
    assert (npy["h"], npy["w"], npy["data"]) == (3, 4, [float(i) for i in range(12)])


def test_headers_and_settings(spark):
    df = spark.createDataFrame([({"CRVAL1": "1", "CRVAL2": "2", "CD1_1": "3", "OBJECT": "M31", "HISTORY": "x"}, {"CRVAL1": "9", "CTYPE1": "RA---TAN", "COMMENT": "y"})], f"h {HEADER}, s {HEADER}")
    row = df.select(lifecycle.with_solution(F.col("h"), F.col("s")).alias("n"), lifecycle.with_pointing(F.col("h")).alias("p"), lifecycle.with_note(F.col("h"), F.lit(True)).alias("w"), F.struct(*lifecycle.exposure_of(F.col("h"))).alias("e")).first()
    assert row["n"]["header"] == {"OBJECT": "M31", "CRVAL1": "9", "CTYPE1": "RA---TAN"} and row["n"]["cards"] == 2
    assert (row["p"]["RA"], row["p"]["DEC"]) == ("1", "2") and "STK_NOTE" in row["w"] and tuple(row["e"]) == (1.0, "counts")
    config = lifecycle.StackConfig(kappa=3.5, winsor_limits=(0.1, 0.2))
    assert lifecycle.StackConfig.loaded(config.saved()) == config
    assert lifecycle.StackConfig.loaded("{broken") == lifecycle.StackConfig() == lifecycle.StackConfig.loaded('["a"]')
    assert lifecycle.StackConfig.loaded('{"kappa": 2.0, "theme": "dark"}').kappa == 2.0


def test_user_columns_of_any_name_stay(spark):
    names = ["_m", "_s", "med", "sd", "kept", "lost", "a", "b", "mad", "_n", "_sky", "_lo", "_hi", "_d", "steps", "_steps"]
    px = pixels(spark, np.random.default_rng(1).random((3, 4, 4))).withColumn("g", F.lit(0)).withColumns({n: F.col("frame_id") * 10 for n in names})
    for out in (robust.clipped(px, ["frame_id"]), robust.subtract_sky(px, ["frame_id"], 1), robust.normalize_linear(px, ["g"], "frame_id"), robust.normalize_sky(px, ["g"], "frame_id"), robust.normalize_robust(px, ["frame_id"]), robust.normalize_minmax(px, ["frame_id"]), stack.winsorized(px, ["y", "x"], (0.4, 0.4))):
        assert all(r[n] == 10 * r["frame_id"] for r in out.collect() for n in names)
    assert robust.normalize(px, "none", ["g"], "frame_id") is px and robust.deviation(px, ["frame_id"]).count() == 3
    for f in (stack.kappa_sigma, stack.linear_fit_clip, stack.winsorized_sigma):
        assert f(px, ["y", "x"]).count() == 16
    with pytest.raises(ValueError):
        stack.by_name(px, ["y", "x"], "nonsense")
    with pytest.raises(ValueError):
        robust.normalize(px, "nonsense", ["g"], "frame_id")
