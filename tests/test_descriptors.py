"""Descriptors, matches and transforms of known star fields; expanded canvases against plain loops."""

import numpy as np
import pytest

from lumenstack.operators import descriptors as de

SIZE = 150


def sky(seed=1, n=170):
    rng = np.random.default_rng(seed)
    return rng.uniform(-60, SIZE + 60, (n * 3, 2)), rng.uniform(20, 200, n * 3)


def frame_of(field, angle, shift, scale=1.0, noise=0.5, seed=9):
    """The field turned about the image's centre, scaled and shifted; and the transform back onto the field."""
    points, flux = field
    t = scale * np.exp(1j * np.radians(angle))
    c = SIZE / 2 * (1 + 1j)
    moved = t * (points @ (1, 1j) - c) + c + complex(*shift)
    y, x = np.mgrid[:SIZE, :SIZE]
    image = np.random.default_rng(seed).normal(20, noise, (SIZE, SIZE))
    for p, f in zip(moved, flux):
        if -8 < p.real < SIZE + 8 and -8 < p.imag < SIZE + 8:
            image += f * np.exp(-((x - p.real) ** 2 + (y - p.imag) ** 2) / (2 * 1.4**2))
    back = 1 / t
    offset = c - back * (c + complex(*shift))
    return image, np.array([[back.real, -back.imag, offset.real], [back.imag, back.real, offset.imag]])


@pytest.fixture(scope="module")
def scene(spark):
    field = sky()
    made = [frame_of(field, 0, (0, 0)), frame_of(field, 0, (7.3, -4.6), seed=2), frame_of(field, 28, (3, 5), seed=3), frame_of(field, -121, (-2, 6), 1.04, seed=4), frame_of(sky(77), 0, (0, 0), seed=5), (np.random.default_rng(6).normal(20, 1, (SIZE, SIZE)), None)]
    rows = [(f"f{k}", 0, y, x, float(v), 1, "own", 2) for k, (image, _) in enumerate(made) for (y, x), v in np.ndenumerate(image)]
    return made, spark.createDataFrame(rows, "k string, ch int, y int, x int, v double, star int, d string, i int").cache()


def test_known_transforms_come_back(scene):
    made, px = scene
    got = {r["k"]: r for r in de.fast_transforms(px, "k", "f0").collect()}  # a name that is used within, too
    assert set(got) == {f"f{k}" for k in range(6)}
    for k in range(4):
        r = got[f"f{k}"]
        assert r["ok"] and r["matched"] >= 10, k
        m = np.array([[r["m11"], r["m12"], r["m13"]], [r["m21"], r["m22"], r["m23"]]])
        corners = np.array([[0, 0, 1], [SIZE, 0, 1], [0, SIZE, 1], [SIZE, SIZE, 1]])
        assert np.abs(corners @ m.T - corners @ made[k][1].T).max() < 1.0, k
    for k in (4, 5):
        assert not got[f"f{k}"]["ok"] and got[f"f{k}"]["m11"] is None


def test_descriptors_turn_with_the_patch():
    rng = np.random.default_rng(3)
    patches = rng.gamma(1, 10, (30, 31, 31)).cumsum(1)[:, :, :] % 97
    turned = np.rot90(patches, 1, (1, 2))
    a, b = de.describe_patches(patches), de.describe_patches(np.ascontiguousarray(turned))
    gaps = np.bitwise_count((a ^ b).view(np.uint64)).sum(1)
    others = np.bitwise_count((a ^ np.roll(b, 1, 0)).view(np.uint64)).sum(1)
    assert np.median(gaps) < 30 < 90 < np.median(others)
    assert np.array_equal(de.describe_patches(patches + 1000), a)


def test_matches_are_mutual_nearest(spark):
    """Against all pairs: every pair that meets and is nearest both ways; ties by number."""
    rng = np.random.default_rng(4)
    ref = rng.integers(-(2**63), 2**63 - 1, (40, 4))
    own = ref.copy()
    for row in own:
        for bit in rng.choice(256, 30, replace=False):
            row[bit // 64] ^= np.int64(np.uint64(1) << np.uint64(bit % 64))
    own[5] = own[6]
    table = lambda d: spark.createDataFrame([("a", k, float(k), 0.0, row.tolist()) for k, row in enumerate(d)], "frame string, star int, sx double, sy double, d array<long>")
    got = {(r["star"], r["other"]): r["distance"] for r in de.matches(table(own), table(ref), "frame").collect()}
    gaps = np.bitwise_count((own[:, None] ^ ref[None]).view(np.uint64)).sum(2)
    want = {(i, int(gaps[i].argmin())): int(gaps[i].min()) for i in range(40) if gaps[:, gaps[i].argmin()].argmin() == i}
    assert got == want and 38 <= len(want) <= 40


def test_consensus():
    rng = np.random.default_rng(5)
    a = rng.uniform(0, 500, (100, 2))
    m = np.array([[0.8, -0.6, 12], [0.6, 0.8, -30]])
    b = a @ m[:, :2].T + m[:, 2] + rng.normal(0, 0.3, a.shape)
    b[60:] = rng.uniform(0, 500, (40, 2))
    got, n = de.consensus(a, b)
    assert n >= 58 and np.allclose(got, m, atol=[[0.01, 0.01, 1], [0.01, 0.01, 1]])
    assert de.consensus(a[:1], b[:1]) == (None, 0) and de.consensus(np.ones((5, 2)), b[:5]) == (None, 0)


def test_expanded_canvas(spark):
    rng = np.random.default_rng(7)
    h, w = 9, 13
    image = rng.uniform(1, 5, (2, h, w))
    turn = np.radians(30)
    mats = {"a": np.array([[np.cos(turn), -np.sin(turn), 5], [np.sin(turn), np.cos(turn), -2]]), "b": np.array([[1, 0, -3.5], [0, 1, 0.25]])}
    px = spark.createDataFrame([(k, c, y, x, float(image[c, y, x]), 0.0) for k in "abc" for c, y, x in np.ndindex(image.shape)], "frame string, ch int, y int, x int, v double, f double")
    m = spark.createDataFrame([(k, *map(float, v.ravel()), True) for k, v in mats.items()] + [("c", *[None] * 6, False)], "frame string, m11 double, m12 double, m13 double, m21 double, m22 double, m23 double, ok boolean")
    got = {}
    for r in de.expanded(px, "frame", m, h, w).collect():
        got[r["frame"], r["ch"], r["y"], r["x"]] = r["v"]
    assert {k[1:]: v for k, v in got.items() if k[0] == "c"} == {k: image[k] for k in np.ndindex(image.shape)}
    for k, own in mats.items():
        rows, columns = de.expected_side(h, w, own)
        low = (np.array([[0, 0], [w - 1, 0], [0, h - 1], [w - 1, h - 1]]) @ own[:, :2].T + own[:, 2]).min(0)
        for c, y, x in np.ndindex(2, rows, columns):
            sx, sy = np.linalg.solve(own[:, :2], np.array([x, y]) + low - own[:, 2])
            x0, y0 = int(np.floor(round(sx, 9))), int(np.floor(round(sy, 9)))
            want = sum(image[c, y0 + dy, x0 + dx] * (1 - abs(sx - x0 - dx)) * (1 - abs(sy - y0 - dy)) for dy in (0, 1) for dx in (0, 1) if 0 <= y0 + dy < h and 0 <= x0 + dx < w)
            assert got.pop((k, c, y, x)) == pytest.approx(want, abs=1e-6)
    assert all(k[0] == "c" for k in got)
