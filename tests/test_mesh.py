"""The mesh background by splines against NumPy, on images that are no multiple of the box."""

import numpy as np
import pytest

from lumenstack.operators import background


def coefficients(values):
    """By a dense solution, mirrored about the outer edges of the end cells."""
    n = len(values)
    m = np.zeros((n, n))
    for i in range(n):
        for j, k in ((i - 1, 1), (i, 4), (i + 1, 1)):
            m[i, min(max(j, 0), n - 1)] += k
    return np.linalg.solve(m / 6, values)


def spline(values, at):
    """Values at places in units of cells, 0 at the first centre."""
    c, n, out = coefficients(values), len(values), 0
    for j in range(-3, n + 3):
        d = np.abs(at - j)
        b = np.where(d < 1, 2 / 3 - d**2 + d**3 / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0))
        m = j % (2 * n)
        out = out + np.multiply.outer(b, c[m if m < n else 2 * n - 1 - m])
    return out


def clip(v, sigma=3.0, rounds=5):
    for _ in range(rounds):
        v = v[np.abs(v - np.median(v)) <= sigma * v.std()]
    return v


def plain_mesh(image, box, window=5, exclude=98.0):
    h, w = image.shape
    by, bx = min(box, h), min(box, w)
    mesh = np.full((2, -(-h // by), -(-w // bx)), np.nan)
    for i, j in np.ndindex(mesh.shape[1:]):
        v = image[i * by : i * by + by, j * bx : j * bx + bx]
        v = clip(v[~np.isnan(v)])
        if len(v) and by * bx - len(v) <= exclude / 100 * by * bx:
            mesh[:, i, j] = np.median(v), v.std()
    good = np.argwhere(~np.isnan(mesh[0]))
    filled = mesh.copy()
    for i, j in np.argwhere(np.isnan(mesh[0])):
        near = sorted(((y - i) ** 2 + (x - j) ** 2, y, x) for y, x in good)[:10]
        weight = [1 / np.sqrt(d) for d, _, _ in near]
        filled[:, i, j] = [np.average([m[y, x] for _, y, x in near], weights=weight) for m in mesh]
    half = (window | 1) // 2
    out = np.empty_like(filled)
    for i, j in np.ndindex(mesh.shape[1:]):
        out[:, i, j] = np.median(filled[:, max(0, i - half) : i + half + 1, max(0, j - half) : j + half + 1], axis=(1, 2))
    return out


def plain_surface(mesh, h, w, box):
    by, bx = min(box, h), min(box, w)
    columns = spline(mesh, (np.arange(h) + 0.5) / by - 0.5)
    return np.clip(spline(columns.T, (np.arange(w) + 0.5) / bx - 0.5).T, mesh.min(), mesh.max())


def as_rows(spark, *images):
    rows = [(k, y, x, None if np.isnan(v) else float(v)) for k, image in enumerate(images) for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "frame int, y int, x int, v double")


def as_image(df, k, shape, column="model"):
    out = np.full(shape, np.nan)
    for r in df.where(f"frame = {k}").collect():
        assert np.isnan(out[r["y"], r["x"]])
        out[r["y"], r["x"]] = r[column]
    return out


def scene(h, w, seed):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    image = 100 + 0.2 * y + 12 * np.sin(x / 25) + rng.normal(0, 1, (h, w))
    for _ in range(20):
        image += 300 * np.exp(-((x - rng.uniform(0, w)) ** 2 + (y - rng.uniform(0, h)) ** 2) / 4)
    return image


@pytest.mark.parametrize("h,w,box,window", [(68, 120, 8, 5), (50, 47, 16, 4), (12, 12, 5, 1), (9, 40, 16, 3), (7, 7, 128, 5)])
def test_any_size(spark, h, w, box, window):
    image = scene(h, w, h)
    got = as_image(background.mesh_background(as_rows(spark, image), ["frame"], h, w, box, window), 0, (h, w))
    assert np.allclose(got, plain_surface(plain_mesh(image, box, window)[0], h, w, box), atol=1e-9)


def test_partial_zones_count(spark):
    """v = y on 12 x 12 with box 5: the last zone's median is 10.5, and row 7 lies at its zone's centre."""
    image = np.repeat(np.arange(12.0)[:, None], 12, 1)
    got = as_image(background.mesh_background(as_rows(spark, image), ["frame"], 12, 12, 5, 1), 0, (12, 12))
    assert np.allclose(got[7], 7, atol=0.2) and np.allclose(got, plain_surface(plain_mesh(image, 5, 1)[0], 12, 12, 5))


def test_masked_zones(spark):
    """Zones without samples, zones with too few under a strict limit, and an image that is masked whole."""
    image = scene(60, 60, 3)
    image[:20, 40:] = np.nan
    image[41:60, 2:20] = np.nan
    other = np.full((60, 60), np.nan)
    px = as_rows(spark, image, other).withColumn("model", px_literal())
    for exclude in (98.0, 40.0):
        model = background.mesh_background(px, ["frame"], 60, 60, 10, 3, exclude=exclude).cache()
        assert np.allclose(as_image(model, 0, (60, 60)), plain_surface(plain_mesh(image, 10, 3, exclude)[0], 60, 60, 10))
        assert model.where("frame = 1").count() == 0
    flat = background.without_background(px, ["frame"], 60, 60, 10, 3)
    assert flat.columns == px.columns and flat.count() == 7200
    assert np.allclose(as_image(flat, 0, (60, 60), "v"), image - plain_surface(plain_mesh(image, 10, 3)[0], 60, 60, 10), equal_nan=True)
    assert background.mesh_background(px.where("false"), ["frame"], 60, 60, 10).count() == 0


def px_literal():
    from pyspark.sql import functions as F

    return F.lit("a column of that name")


def test_deviation_surface(spark):
    image = scene(40, 52, 5)
    mesh = background.zone_mesh(as_rows(spark, image), ["frame"], 40, 52, 16, 3, 3.0, 98.0)
    got = as_image(background.spline_surface(mesh, ["frame"], "s", 40, 52, 16), 0, (40, 52), "s")
    assert np.allclose(got, plain_surface(plain_mesh(image, 16, 3)[1], 40, 52, 16))


def test_bilinear_on_any_size(spark):
    image = np.repeat(np.arange(12.0)[:, None], 12, 1)
    got = as_image(background.mesh_background(as_rows(spark, image), ["frame"], 12, 12, 5, 1, splines=False), 0, (12, 12))
    centres, values = (np.arange(3) + 0.5) * 5 - 0.5, [2, 7, 10.5]
    assert np.allclose(got, np.interp(np.arange(12), centres, values)[:, None])
