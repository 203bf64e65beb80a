"""CLAHE, unsharp mask, enhanced stretch and non-local means against plain loops in NumPy."""

import math

import numpy as np
import pytest

from lumenstack.functions import lab
from lumenstack.operators import contrast, denoise


def plain_clahe(image, limit, tiles):
    h, w = image.shape
    if h % tiles or w % tiles:
        image = np.pad(image, ((0, tiles - h % tiles), (0, tiles - w % tiles)), "reflect")
    th, tw = image.shape[0] // tiles, image.shape[1] // tiles
    top = max(int(limit * th * tw / 256), 1)
    maps = np.zeros((tiles, tiles, 256))
    for i, j in np.ndindex(tiles, tiles):
        hist = np.bincount(image[i * th : i * th + th, j * tw : j * tw + tw].ravel(), minlength=256)
        excess = int(np.maximum(hist - top, 0).sum())
        hist = np.minimum(hist, top) + excess // 256
        rest = excess % 256
        if rest:
            step = max(256 // rest, 1)
            k = 0
            while k < 256 and rest:
                hist[k] += 1
                k, rest = k + step, rest - 1
        maps[i, j] = np.clip(np.rint(hist.cumsum() * (255 / (th * tw))), 0, 255)
    out = np.zeros((h, w), int)
    for y, x in np.ndindex(h, w):
        fy, fx = y / th - 0.5, x / tw - 0.5
        a, b = math.floor(fy), math.floor(fx)
        v = image[y, x]
        m = maps[np.ix_([max(a, 0), min(a + 1, tiles - 1)], [max(b, 0), min(b + 1, tiles - 1)])][:, :, v]
        fy, fx = fy - a, fx - b
        out[y, x] = np.rint((m[0, 0] * (1 - fx) + m[0, 1] * fx) * (1 - fy) + (m[1, 0] * (1 - fx) + m[1, 1] * fx) * fy)
    return out


def plain_unsharp(image, percent=120, threshold=3):
    soft = image.astype(int)
    for axis in (1, 0):
        for _ in range(3):
            p = np.pad(soft, [(1, 1) if a == axis else (0, 0) for a in (0, 1)], "edge")
            cut = lambda a: np.take(p, range(a, a + soft.shape[axis]), axis)  # noqa: B023, E731
            soft = np.floor((cut(0) + 4 * cut(1) + cut(2)) / 6 + 0.5).astype(int)
    change = image - soft
    return np.where(abs(change) > threshold, np.clip(image + np.trunc(change * percent / 100), 0, 255), image).astype(int)


def plain_nlm(channels, strength, template=7, search=21):
    r, q, n = search // 2, template // 2, len(channels)
    padded = np.array([np.pad(c, r + q, "reflect") for c in channels])
    unit, shift = (2**31 - 1) // (search**2 * 255), math.ceil(math.log2(template**2))
    out = np.zeros(channels.shape, int)
    for y, x in np.ndindex(channels.shape[1:]):
        cy, cx = y + r + q, x + r + q
        own, total, result = padded[:, cy - q : cy + q + 1, cx - q : cx + q + 1], 0, np.zeros(n, int)
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                d = int(((own - padded[:, cy + dy - q : cy + dy + q + 1, cx + dx - q : cx + dx + q + 1]) ** 2).sum())
                weight = round(unit * math.exp(-(d >> shift) * 2**shift / template**2 / (strength**2 * n)))
                weight = 0 if weight < 0.001 * unit else weight
                total, result = total + weight, result + weight * padded[:, cy + dy, cx + dx]
        out[:, y, x] = (result + total // 2) // total
    return out


def rows(spark, images, columns, extra=()):
    """images: by key, (channels, h, w)."""
    data = [(k, y, x, *(None if np.isnan(c[y, x]) else float(c[y, x]) for c in image), *("a name" for _ in extra)) for k, image in images.items() for y, x in np.ndindex(image.shape[1:])]
    return spark.createDataFrame(data, f"frame string, y int, x int, {', '.join(f'{c} double' for c in columns)}" + "".join(f", {e} string" for e in extra)).repartition(3)


def image_of(df, key, columns, shape):
    out = np.full((len(columns), *shape), np.nan)
    for r in df.collect():
        if r["frame"] == key:
            out[:, r["y"], r["x"]] = [np.nan if r[c] is None else r[c] for c in columns]
    return out


def scene(h, w, seed, top=256):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    return np.clip(60 + 40 * np.sin(y / 5) + 30 * np.cos(x / 7) + rng.normal(0, 12, (h, w)), 0, top - 1).astype(int)


@pytest.mark.parametrize("h,w,tiles,limit", [(64, 48, 8, 2.0), (61, 50, 8, 2.0), (40, 33, 4, 40.0), (16, 9, 3, 3.0), (5, 3, 2, 1.0)])
def test_clahe(spark, h, w, tiles, limit):
    images = {"a": scene(h, w, 1)[None], "b": np.full((1, h, w), 77)}
    px = rows(spark, images, ["v"], ("cy", "value", "n", "m00", "map"))
    got = contrast.clahe(px, ["frame"], h, w, limit, tiles)
    for k, image in images.items():
        assert np.array_equal(image_of(got, k, ["v"], (h, w))[0], plain_clahe(image[0], limit, tiles))


def test_masked_and_empty(spark):
    image = scene(16, 16, 2).astype(float)
    image[3, 4] = np.nan
    px = rows(spark, {"a": image[None]}, ["v"])
    got = image_of(contrast.clahe(px, ["frame"], 16, 16, 2.0, 2), "a", ["v"], (16, 16))[0]
    assert np.isnan(got[3, 4]) and np.isnan(got).sum() == 1
    none = px.where("false")
    assert contrast.clahe(none, ["frame"], 16, 16).count() == contrast.enhanced_stretch(none, ["frame"], 16, 16, ("v",)).count() == denoise.denoised(none, ["frame"], 16, 16, 5).count() == 0


def test_lab_round_trip_and_known_colours(spark):
    known = {(255, 255, 255): (255, 128, 128), (0, 0, 0): (0, 128, 128), (255, 0, 0): (136, 208, 195), (0, 255, 0): (224, 42, 211), (0, 0, 255): (82, 207, 20), (128, 128, 128): (137, 128, 128)}
    df = spark.createDataFrame(list(known), "r int, g int, b int")
    for r in df.select("*", *(c.alias(n) for c, n in zip(lab.to_lab(df["r"], df["g"], df["b"]), "xyz"))).collect():
        assert (r["x"], r["y"], r["z"]) == known[r["r"], r["g"], r["b"]]
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([tuple(map(int, c)) for c in rng.integers(0, 256, (500, 3))], "r int, g int, b int")
    for curve in (True, False):
        there = df.select("r", "g", "b", *(c.alias(n) for c, n in zip(lab.to_lab(df["r"], df["g"], df["b"], curve), "xyz")))
        back = there.select("r", "g", "b", *(c.alias(n) for c, n in zip(lab.from_lab(there["x"], there["y"], there["z"], curve), "uvw"))).collect()
        gaps = np.array([[abs(r[a] - r[b]) for a, b in zip("rgb", "uvw")] for r in back])
        assert gaps.mean() < (1 if curve else 1.2) and np.quantile(gaps, 0.99) <= 8  # 8-bit L*a*b* is coarse for dark colours


def test_unsharp(spark):
    images = {"a": np.array([scene(30, 22, 4), scene(30, 22, 5) // 3]), "b": np.zeros((2, 30, 22), int)}
    got = contrast.unsharp(rows(spark, images, ["v", "u"], ("v_old",)), ["frame"], ["v", "u"])
    for k, image in images.items():
        assert np.array_equal(image_of(got, k, ["v", "u"], (30, 22)), [plain_unsharp(c) for c in image])


def test_enhanced_stretch_of_one_channel(spark):
    rng = np.random.default_rng(6)
    image = np.clip(rng.gamma(2, 0.05, (40, 40)), 0, 1)
    dark, few = np.zeros((40, 40)), np.full((40, 40), np.nan)
    few[:2, :2] = 0.5
    px = rows(spark, {"a": image[None], "dark": dark[None], "few": few[None]}, ["v"], ("p", "n", "scale", "most"))
    got = contrast.enhanced_stretch(px, ["frame"], 40, 40, ("v",), tiles=4, sharpen=True)
    for k, own in {"a": image, "dark": dark, "few": few}.items():
        finite, v = own[~np.isnan(own)], np.nan_to_num(own)
        black, white = (0.0, 1.0) if len(finite) < 20 else np.percentile(finite, [1, 99])
        black = min(max(black, 0), 1 - 1e-4)
        white = min(max(white, black + 1e-4), 1)
        scale = 10 / max(0.01, white - black)
        over = np.maximum(v - black, 0)
        curve = np.clip(np.arcsinh(scale * over) / np.arcsinh(scale * over.max()), 0, 1) if over.max() > 0 else np.zeros_like(v)
        want = plain_unsharp(plain_clahe((curve * 255).astype(int), 2.0, 4)) / 255
        assert np.allclose(image_of(got, k, ["v"], (40, 40))[0], want)


def test_enhanced_stretch_of_colour(spark):
    """Its steps, each tested above, one after the other."""
    rng = np.random.default_rng(7)
    image = np.clip(rng.gamma(2, 0.08, (3, 24, 24)), 0, 1)
    px = rows(spark, {"a": image}, ["red", "green", "blue"])
    one = image_of(contrast.enhanced_stretch(px, ["frame"], 24, 24, ("red", "green", "blue"), 1.0, 0), "a", ["red", "green", "blue"], (24, 24)) * 255
    assert np.allclose(one, np.rint(one)) and one.max() == 255
    px8 = rows(spark, {"a": np.rint(one)}, list("rgb"))
    equal = contrast.clahe_colour(px8, ["frame"], 24, 24, 2.0, 3)
    two = image_of(equal, "a", list("rgb"), (24, 24))
    grey = np.floor((19595 * two[0] + 38470 * two[1] + 7471 * two[2] + 32768) / 65536)
    three = np.clip(np.trunc(grey + 1.2 * (two - grey)), 0, 255)
    want = np.array([plain_unsharp(c.astype(int)) for c in three]) / 255
    got = contrast.enhanced_stretch(px, ["frame"], 24, 24, ("red", "green", "blue"), tiles=3, sharpen=True)
    assert np.allclose(image_of(got, "a", ["red", "green", "blue"], (24, 24)), want)
    with pytest.raises(ValueError):
        contrast.enhanced_stretch(px, ["frame"], 24, 24, ("red", "green"))


@pytest.mark.parametrize("tile", [5, 14, 64])
def test_non_local_means(spark, tile):
    images = {"a": scene(23, 17, 8)[None], "b": np.full((1, 23, 17), 9)}
    got = denoise.non_local_means(rows(spark, images, ["v"], ("ty", "c0")), ["frame"], 23, 17, 12.0, tile=tile)
    for k, image in images.items():
        assert np.array_equal(image_of(got, k, ["v"], (23, 17)), plain_nlm(image, 12.0))


def test_two_channels_small_windows_and_a_tiny_image(spark):
    image = np.array([scene(12, 11, 9), scene(12, 11, 10)])
    got = denoise.non_local_means(rows(spark, {"a": image}, ["u", "v"]), ["frame"], 12, 11, 20.0, ("u", "v"), 3, 5, tile=4)
    assert np.array_equal(image_of(got, "a", ["u", "v"], (12, 11)), plain_nlm(image, 20.0, 3, 5))
    one = denoise.non_local_means(rows(spark, {"a": np.array([[[200]]])}, ["v"]), ["frame"], 1, 1, 5.0)
    assert [r["v"] for r in one.collect()] == [200]


def test_denoised_colour(spark):
    """Lightness and colour by themselves, and back; conversions as tested above."""
    rng = np.random.default_rng(11)
    image = np.clip(0.5 + rng.normal(0, 0.1, (3, 14, 12)), 0, 1)
    px = rows(spark, {"a": image}, list("rgb"))
    eight = rows(spark, {"a": np.trunc(image * 255)}, list("rgb"))
    parts = eight.select("frame", "y", "x", *(c.alias(n) for c, n in zip(lab.to_lab(eight["r"], eight["g"], eight["b"], False), "lab")))
    parts = image_of(parts, "a", list("lab"), (14, 12)).astype(int)
    done = rows(spark, {"a": np.concatenate([plain_nlm(parts[:1], 15.0), plain_nlm(parts[1:], 15.0)])}, list("lab"))
    want = image_of(done.select("frame", "y", "x", *(c.alias(n) for c, n in zip(lab.from_lab(done["l"], done["a"], done["b"], False), "rgb"))), "a", list("rgb"), (14, 12)) / 255
    got = image_of(denoise.denoised(px, ["frame"], 14, 12, 15.0, ("r", "g", "b"), tile=8), "a", list("rgb"), (14, 12))
    assert np.allclose(got, want) and not np.allclose(got, np.trunc(image * 255) / 255)
