"""Segments against a flood fill over tiles of any size; moments, widths, counts and masks of known stars."""

import math
import random

import numpy as np
import pytest

from lumenstack.operators import segments


def flood(cells, diagonal=True):
    """Label of each cell: the first cell of its component."""
    left, out = set(cells), {}
    for cell in sorted(cells):
        if cell not in left:
            continue
        left.discard(cell)
        stack = [cell]
        while stack:
            y, x = stack.pop()
            out[y, x] = cell[0] * segments.ROW + cell[1]
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (diagonal or not (dy and dx)) and (y + dy, x + dx) in left:
                        left.discard((y + dy, x + dx))
                        stack.append((y + dy, x + dx))
    return out


@pytest.mark.parametrize("diagonal", [True, False])
def test_tiles_alone(diagonal):
    rng = random.Random(1)
    for _ in range(200):
        share = rng.choice((0.1, 0.4, 0.6, 0.9))
        cells = [(y, x) for y in range(rng.randrange(1, 20)) for x in range(rng.randrange(1, 20)) if rng.random() < share] or [(0, 0)]
        rng.shuffle(cells)
        got = segments.tile_labels(np.array([c[0] for c in cells]), np.array([c[1] for c in cells]), diagonal)
        want = flood(cells, diagonal)
        assert got.tolist() == [want[c] for c in cells]


def spiral(n):
    """One long winding line of width one, which crosses every tile."""
    grid, y, x, dy, dx = np.zeros((n, n), bool), 0, 0, 0, 1
    for _ in range(n * n):
        grid[y, x] = True
        ahead = (y + 2 * dy, x + 2 * dx)
        blocked = not (0 <= y + dy < n and 0 <= x + dx < n) or (0 <= ahead[0] < n and 0 <= ahead[1] < n and grid[ahead])
        if blocked:
            dy, dx = dx, -dy
            ahead = (y + 2 * dy, x + 2 * dx)
            if not (0 <= y + dy < n and 0 <= x + dx < n) or grid[y + dy, x + dx] or (0 <= ahead[0] < n and 0 <= ahead[1] < n and grid[ahead]):
                break
        y, x = y + dy, x + dx
    return [(int(a), int(b)) for a, b in zip(*np.nonzero(grid))]


@pytest.fixture(scope="module")
def images(spark):
    rng = random.Random(2)
    cells = {("a", k): [(y, x) for y in range(24) for x in range(24) if rng.random() < share] for k, share in enumerate((0.2, 0.45, 0.6))}
    cells["b", 0] = spiral(24)
    cells["b", 1] = [(0, x) for x in range(40)]
    cells[None, 2] = [(7, 7), (8, 8), (8, 7)]
    rows = [(f, k, y, x, 1.0, "own", 0) for (f, k), own in cells.items() for y, x in own]
    return cells, spark.createDataFrame(rows, "frame string, ch int, y int, x int, v double, label string, root int")


@pytest.mark.parametrize("tile,diagonal", [(1, True), (3, True), (3, False), (5, True), (64, True)])
def test_labels_over_tiles(images, tile, diagonal):
    cells, px = images
    px = px.where("frame is not null")
    got = {(r["frame"], r["ch"], r["y"], r["x"]): r["label"] for r in segments.label(px, ["frame", "ch"], tile, diagonal).collect()}
    want = {(*f, *c): own for f, mine in cells.items() if f[0] for c, own in flood(mine, diagonal).items()}
    assert got == want


def test_repeated_and_masked_samples_and_no_rows(spark, images):
    _, px = images
    one = spark.createDataFrame([(1, 3, 3, 2.0), (1, 3, 3, 2.0), (1, 3, 4, None), (1, 3, 5, 2.0)], "f int, y int, x int, v double")
    got = segments.label(one, ["f"], 2).collect()
    assert sorted((r["x"], r["label"] % segments.ROW) for r in got) == [(3, 3), (3, 3), (5, 5)]
    assert segments.label(one.where("false"), ["f"], 2).count() == 0
    assert segments.sources(segments.label(one.where("false"), ["f"], 2), ["f"]).count() == 0


def field(points, sigma, size=90, amplitude=80.0, seed=2):
    y, x = np.mgrid[:size, :size]
    image = np.random.default_rng(seed).normal(10, 0.1, (size, size))
    for py, px in points:
        image += amplitude * np.exp(-((x - px) ** 2 + (y - py) ** 2) / (2 * sigma**2))
    return image


GRID = [(y + 0.25, x - 0.25) for y in range(6, 84, 11) for x in range(6, 84, 11)]


@pytest.fixture(scope="module")
def stars(spark):
    """64 stars, wide ones, ones of two widths, an elongated one, none."""
    two = field(GRID[:32], 1.2) + field(GRID[32:], 2.4, seed=3) - 10
    y, x = np.mgrid[:90, :90]
    long = np.random.default_rng(4).normal(10, 0.1, (90, 90)) + 80 * np.exp(-((x - 45) ** 2) / 2 - (y - 45) ** 2 / 200)
    frames = [field(GRID, 1.2), field(GRID, 2.0), two, long, field([], 1.0)]
    rows = [(k, y, x, float(v)) for k, f in enumerate(frames) for (y, x), v in np.ndenumerate(f)]
    return frames, spark.createDataFrame(rows, "frame int, y int, x int, v double").cache()


def test_moments(spark, stars):
    frames, px = stars
    found = segments.sources(segments.label(segments.over_sky(px, ["frame"], 5.0, subtract=True), ["frame"], 17), ["frame"], 5).collect()
    own = [r for r in found if r["frame"] == 0]
    assert len(own) == 64
    for r in own:
        assert min(math.hypot(r["sy"] - y, r["sx"] - x) for y, x in GRID) < 0.05
        assert r["fwhm"] == pytest.approx(2.3548 * 1.2, rel=0.1) and r["eccentricity"] < 0.2  # the threshold cuts the wings
    (r,) = [r for r in found if r["frame"] == 3]
    assert r["major"] == pytest.approx(10, rel=0.1) and r["minor"] == pytest.approx(1, rel=0.1) and r["eccentricity"] > 0.98
    # By hand, over the labels of one frame.
    labels = flood([tuple(map(int, c)) for c in np.argwhere(frames[1] > np.quantile(frames[1], 0.9))])
    rows = spark.createDataFrame([(1, y, x, float(frames[1][y, x]), l) for (y, x), l in labels.items()], "f int, y int, x int, v double, label long")
    for r in segments.sources(rows, ["f"]).collect():
        cells = np.array([c for c, l in labels.items() if l == r["label"]])
        v = frames[1][cells[:, 0], cells[:, 1]]
        cov = np.cov(cells.T, aweights=v, bias=True).reshape(2, 2) if len(cells) > 1 else np.zeros((2, 2))
        if np.linalg.det(cov) < 1 / 144:
            cov = cov + np.eye(2) / 12
        assert (r["n"], r["flux"], r["peak"]) == (len(cells), pytest.approx(v.sum()), v.max())
        assert (r["sy"], r["sx"]) == pytest.approx(np.average(cells, axis=0, weights=v))
        assert [r["minor"], r["major"]] == pytest.approx(np.sqrt(np.linalg.eigvalsh(cov)), abs=1e-6)


def test_one_row_a_frame(stars):
    frames, px = stars
    counts = {r["frame"]: r["stars"] for r in segments.star_counts(px, ["frame"], 20).collect()}
    assert counts == {0: 64, 1: 64, 2: 64, 3: 1, 4: 0}
    got = {r["frame"]: (r["n"], r["fwhm"]) for r in segments.initial_fwhm(px, ["frame"], 20).collect()}
    assert got[0][0] == 64 and got[3] == got[4] == (0, 4.0)
    for k, image in enumerate(frames):
        kept = image.ravel()
        for _ in range(5):
            kept = kept[np.abs(kept - np.median(kept)) <= 3 * kept.std()]
        labels = flood([tuple(map(int, c)) for c in np.argwhere(image > np.median(kept) + 3 * kept.std())])
        widths = []
        for own in set(labels.values()):
            cells = np.array([c for c, l in labels.items() if l == own])
            if len(cells) >= 5:
                low, high = np.linalg.eigvalsh(np.cov(cells.T, aweights=image[cells[:, 0], cells[:, 1]], bias=True))
                if 1 - low / high < 0.25:
                    widths.append(2 * math.sqrt(math.log(2) * (low + high)))
        assert got[k] == ((len(widths), pytest.approx(np.median(widths))) if widths else (0, 4.0))


def test_weights(spark, stars):
    """Nine stars of one width, of two, four stars, and an image that is too small."""
    some = [(y + 0.25, x - 0.25) for y in (14, 60, 103) for x in (14, 60, 103)]
    frames = [field(some, 1.4, 120, 300.0), field(some[:4], 1.4, 120, 300.0) + field(some[4:], 2.8, 120, 300.0, 3) - 10, field(some[:4], 1.4, 120, 300.0)]
    px = spark.createDataFrame([(k, y, x, float(v)) for k, f in enumerate(frames) for (y, x), v in np.ndenumerate(f)], "frame int, y int, x int, v double")
    got = {r["frame"]: (r["n"], r["weight"]) for r in segments.fwhm_weights(px, ["frame"], 120, 120, tile=50).collect()}
    assert [got[k][0] for k in range(3)] == [9, 9, 4]
    assert got[0][1] > 0.95 and 0.45 < got[1][1] < 0.65 and got[2][1] == 1.0
    small = px.where("y < 40 and x < 40")
    assert {(r["n"], r["weight"]) for r in segments.fwhm_weights(small, ["frame"], 40, 40).collect()} == {(0, 1.0)}


def test_mask_cells(stars):
    _, px = stars
    got = {(r["y"], r["x"]) for r in segments.star_cells(px.where("frame = 0"), ["frame"], 90, 90).collect()}
    want = {(int(y) + a, math.floor(x) + b) for y, x in GRID for a in range(-2, 3) for b in range(-2, 3) if abs(a) + abs(b) <= 2}
    assert got == want
