"""What must not grow faster than the tables: one test a finding, at small sizes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstack.operators import denoise, project, robust, spatial


def apart(p, q) -> float:
    (r1, d1), (r2, d2) = (map(math.radians, x) for x in (p, q))
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((r2 - r1) / 2) ** 2
    return math.degrees(2 * math.asin(math.sqrt(min(h, 1.0))))


@pytest.mark.parametrize("limit, parts", [(25.0, 4), (3.0, 4), (25.0, 1), (100.0, 8), (180.0, 4)])
def test_neighbours_of_the_whole_sky(spark, limit, parts):
    rng = np.random.default_rng(5)
    points = [(float(a), float(b)) for a, b in zip(rng.uniform(-400, 800, 120), np.degrees(np.arcsin(rng.uniform(-1, 1, 120))))]
    points += [(0.0, 90.0), (77.0, -90.0), (359.999, 89.9), (0.0, 0.0), (360.0, 0.0), (0.0, 25.0), (12.0, 50.0), (-1e-20, 1.0)]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "k long, ra double, dec double")
    got = {(r.a, r.b) for r in project.angular_neighbours(table, table, "k", limit, parts).collect()}
    want = {(i, j): apart(p, q) for i, p in enumerate(points) for j, q in enumerate(points) if i < j}
    unsure = {k for k, d in want.items() if abs(d - limit) < 1e-9}
    assert got - unsure == {k for k, d in want.items() if d < limit} - unsure


def test_neighbours_are_dealt_over_tasks(spark):
    """A small table must not become one task: before, its cells went to every task, of which there was one."""
    table = spark.range(400, numPartitions=1).selectExpr("id AS k", "id * 7 % 360 * 1.0D AS ra", "id % 55 - 5.0D AS dec")
    found = project.angular_neighbours(table, table, "k", 25.0)
    assert len({r.p for r in found.selectExpr("spark_partition_id() AS p").distinct().collect()}) > 4


def test_samples_of_a_large_image_are_not_broadcast(spark, tmp_path):
    """Before, the packed table looked small, so its samples went to every task, and each image was one task."""
    spark.range(1200).selectExpr("id % 3 AS image", "transform(sequence(0, 299), i -> (hash(id, i) % 1000) / 7D) AS data").write.parquet(str(tmp_path / "packed"))
    px = spark.read.parquet(str(tmp_path / "packed")).select("image", F.explode("data").alias("v"))
    assert px.count() / 3 > robust.LARGE
    plan = robust.clipped(px, ["image"], 1.0, 2)._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "SortMergeJoin" not in plan


def test_medians_in_brackets_are_exact(spark):
    rng = np.random.default_rng(1)
    groups = {"normal": rng.normal(size=3001), "even": rng.normal(size=2000), "ties": rng.integers(0, 3, 4000) * 1.0, "one": np.array([2.5]), "two": np.array([1.0, 4.0]), "far": np.append(rng.normal(size=1500), [1e30, -1e30] * 200), "halves": np.repeat([0.0, 1.0], 1000)}
    px = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None)], "k string, v double")
    got = {r.k: r for r in robust.group_stats(px, ["k"], True).collect()}
    assert got["none"].median is None and got["none"].n == 0
    for k, vs in groups.items():
        assert got[k].median == np.median(vs) and got[k].n == len(vs), k
        assert got[k].std == pytest.approx(vs.std(), rel=1e-12, abs=1e-12)
    for a, b in zip(*(sorted(map(tuple, robust.clipped(px, ["k"], 1.5, 3, large).where("k <> 'far'").collect())) for large in (False, True))):
        assert a == b


def test_demosaicing_sends_a_sample_to_its_tiles_only(spark):
    """Before, each sample went to the 25 boxes that it is in, and they met by a join."""
    rng = np.random.default_rng(2)
    images = {k: np.round(rng.uniform(0, 9, shape), 1) for k, shape in (("a", (11, 14)), ("b", (8, 8)), ("dot", (1, 1)), ("line", (2, 9)))}
    rows = [(k, y, x, None if (y + 3 * x) % 17 == 5 else float(m[y, x])) for k, m in images.items() for y in range(m.shape[0]) for x in range(m.shape[1]) if (2 * y + x) % 13 != 6]
    px = spark.createDataFrame(rows, "k string, y int, x int, v double")
    held, want = {r[:3]: r[3] for r in rows}, {}
    ends = {k: (max(r[1] for r in rows if r[0] == k), max(r[2] for r in rows if r[0] == k)) for k in images}
    turn = lambda p, top: -p if p < 0 else 2 * top - p if p > top else p
    for k, y, x, v in rows:
        around = {(i, j): held.get((k, turn(y + i - 2, ends[k][0]), turn(x + j - 2, ends[k][1]))) for i in range(5) for j in range(5)}
        some = any(n is not None for n in around.values())
        f = {name: sum(m[i][j] / 8 * (n or 0) for (i, j), n in around.items()) if some else None for name, m in spatial.MALVAR.items()}
        red, blue, row = y % 2 == x % 2 == 0, y % 2 == x % 2 == 1, y % 2 == 0
        want[k, y, x] = (v if red else f["other"] if blue else f["row" if row else "column"], f["green"] if red or blue else v, v if blue else f["other"] if red else f["column" if row else "row"])
    for tile in (4, 5, 64):
        found = spatial.debayer_malvar(px, ["k"], "RGGB", tile)
        got = {(r.k, r.y, r.x): (r.r, r.g, r.b) for r in found.collect()}
        assert got.keys() == want.keys()
        assert all((a is None and b is None) or a == pytest.approx(b, abs=1e-9) for at in want for a, b in zip(got[at], want[at]))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert spatial.debayer_malvar(px.where("false"), ["k"]).count() == 0


def test_tiles_are_denoised_together(spark):
    """Before, each tile was a call that made the table of weights anew."""
    blocks = np.random.default_rng(3).integers(0, 256, (7, 2, 13, 11))
    together = denoise.denoise_tile(blocks, 30.0, 3, 5)
    assert together.shape == (7, 2, 7, 5)
    assert all(np.array_equal(t, denoise.denoise_tile(b, 30.0, 3, 5)) for t, b in zip(together, blocks))
    images = spark.range(40).selectExpr("nullif(concat('i', id), 'i7') AS k", "explode(sequence(0, 80)) AS p", "id").selectExpr("k", "int(p div 9) AS y", "int(p % 9) AS x", "hash(id, p) % 256 AS v")
    small, large = ({tuple(r) for r in denoise.non_local_means(images, ["k"], 9, 9, 40.0, template=3, search=5, tile=tile).collect()} for tile in (4, 64))
    assert small == large and len(small) == 40 * 81
