"""Offsets of frames by conjugate gradients against dense least squares."""

import numpy as np
import pytest

from lumenstack.operators import robust


def dense(n, pairs):
    m, right = np.zeros((n, n)), np.zeros(n)
    for a, b, o in pairs:
        m[[a, b], [a, b]] += 1
        m[[a, b], [b, a]] -= 1
        right[[a, b]] += (o, -o)
    return np.linalg.lstsq(m, right, rcond=None)[0]


def solve(spark, n, pairs):
    df = spark.createDataFrame([(int(a), int(b), o) for a, b, o in pairs], "a int, b int, offset double")
    frames = spark.createDataFrame([(k, 0.0) for k in range(n)] * 2, "f int, correction double")
    got = {r["f"]: r["correction"] for r in robust.solve_offsets(df, frames, "f").collect()}
    assert set(got) == set(range(n))
    return np.array([got[k] for k in range(n)])


@pytest.mark.parametrize("seed", [1, 2])
def test_sparse_graphs(spark, seed):
    """A ring with some chords, frames of many and of few pairs."""
    rng = np.random.default_rng(seed)
    n = 20
    pairs = [(k, k + 1, rng.normal()) for k in range(n - 1)] + [(0, k, rng.normal()) for k in range(3, n, 4)]
    assert np.allclose(solve(spark, n, pairs), dense(n, pairs), atol=1e-7)


def test_consistent_offsets_come_back(spark):
    level = np.array([3.0, -1, 4, 1, -5, 9, 2])
    pairs = [(a, b, float(level[a] - level[b])) for a in range(7) for b in range(a + 1, 7) if (a + b) % 3]
    assert np.allclose(solve(spark, 7, pairs), level - level.mean(), atol=1e-7)


def test_linked_sets_nothing_known_and_bad_offsets(spark):
    pairs = [(0, 1, 2.0), (1, 2, 1.0), (4, 5, -3.0), (0, 4, None), (2, 4, float("nan")), (3, 5, float("inf"))]
    good = [p for p in pairs if p[2] is not None and np.isfinite(p[2])]
    got = solve(spark, 7, pairs)
    assert np.allclose(got, dense(7, good), atol=1e-7) and got[3] == got[6] == 0
    assert np.array_equal(solve(spark, 3, [(0, 1, None)]), np.zeros(3)) and np.array_equal(solve(spark, 2, [(0, 1, 0.0)]), np.zeros(2))


def test_tile_medians_carry_the_offsets(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(100, 5, (24, 24))
    level = [0.0, 7.5, -2.25]
    rows = [(k, 0, y, x, float(base[y, x] + level[k])) for k in range(3) for y in range(24) for x in range(24) if (k != 1 or y < 16) and (k != 2 or y >= 8)]
    px = spark.createDataFrame(rows, "f int, ch int, y int, x int, v double")
    tiles = robust.tile_medians(px, "f", 8, 64)
    assert tiles.count() == 9 + 6 + 6
    pairs = robust.pairwise_offsets(tiles, "f", ["ch", "y", "x"])
    got = {r["f"]: r["correction"] for r in robust.solve_offsets(pairs, px, "f").collect()}
    assert np.allclose([got[k] for k in range(3)], np.array(level) - np.mean(level))
