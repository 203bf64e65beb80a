import numpy as np
import pytest

from lumenstack.operators import stars


def field(points, size=80):
    y, x = np.mgrid[:size, :size]
    image = np.random.default_rng(2).normal(10, 0.1, (size, size))
    for k, (px, py) in enumerate(points):
        image += (60 + 5 * k) * np.exp(-((x - px) ** 2 + (y - py) ** 2) / (2 * 1.2**2))
    return image


def test_detect_and_align(spark):
    rng = np.random.default_rng(6)
    points = np.array([[x, y] for x in (18, 33, 48, 63) for y in (18, 33, 48, 63)]) + rng.uniform(-5, 5, (16, 2))
    points = points[:9]
    angle, shift = np.radians(5), np.array([2.3, -1.7])
    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    moved = (points - 40) @ turn.T + 40 + shift
    rows = [(i, 0, y, x, float(v)) for i, p in enumerate((points, moved)) for (y, x), v in np.ndenumerate(field(p))]
    rows += [(2, 0, y, x, 1.0 + (y + x) % 2) for y in range(20) for x in range(20)]
    px = spark.createDataFrame(rows, "frame_id int, ch int, y int, x int, v double")
    found = stars.detect(px, ["frame_id"])
    got = {i: sorted((r["sx"], r["sy"]) for r in found.where(f"frame_id = {i}").collect()) for i in (0, 1)}
    assert np.allclose(got[0], sorted(map(tuple, points)), atol=0.2)
    out = {r["frame_id"]: r for r in stars.align(found, "frame_id", found.where("frame_id = 0")).collect()}
    assert out[1]["ok"] and out[1]["matched"] == 9
    back = np.array([[out[1]["m11"], out[1]["m12"]], [out[1]["m21"], out[1]["m22"]]])
    assert np.allclose(back, turn.T, atol=0.01) and set(out) == {0, 1}
    every = {r["frame_id"]: (r["ok"], r["matched"]) for r in stars.align(found, "frame_id", found.where("frame_id = 0"), px).collect()}
    assert set(every) == {0, 1, 2} and every[2] == (False, 0)


def test_too_few_stars():
    assert stars.match(np.array([[1.0, 1.0], [5.0, 5.0]]), np.array([[1.0, 1.0]])) == (None, 0)
    m, n = stars.match(np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 7.0]]), np.array([[1.0, 1.0], [11.0, 1.0], [1.0, 8.0]]))
    assert n == 3 and m == pytest.approx(np.array([[1, 0, 1], [0, 1, 1]]))
