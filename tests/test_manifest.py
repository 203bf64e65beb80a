"""Manifests: going on, and each reason not to."""

import json
import os

import pytest

from lumenstack.streaming import manifest


@pytest.fixture
def run(spark, tmp_path):
    paths = []
    for k in range(5):
        (tmp_path / f"f{k}").write_bytes(os.urandom(100 + k) if k else b"")
        paths.append(f"file://{tmp_path}/f{k}" if k % 2 else f"{tmp_path}/f{k}")
    plan = lambda: spark.createDataFrame(list(enumerate(paths)), "position int, path string")
    return str(tmp_path / "work"), paths, plan, {"kappa": 3.0, "winsor_limits": (0.05, 0.05), "kernel": "square"}


def test_goes_on(spark, run):
    folder, paths, plan, settings = run
    assert manifest.resume(spark, folder, plan(), settings, "sum") == 0
    for n in (0, 3, 4):
        manifest.save(folder, plan(), settings, n, "sum")
        assert manifest.resume(spark, folder, plan(), dict(settings), "sum") == n
    open(paths[4], "wb").write(b"not processed yet")
    paths.append(paths[0])
    assert manifest.resume(spark, folder, plan(), settings, "sum") == 4
    assert len([x for x in os.listdir(f"{folder}/manifest") if x.startswith("inputs-")]) == 1


@pytest.mark.parametrize("change, reason", [("settings", "kappa"), ("mode", "finalisation"), ("content", "f1"), ("gone", "f2"), ("order", "f0"), ("fewer", "f2"), ("form", "form 99"), ("torn", "damaged"), ("edited", "damaged")])
def test_refuses(spark, run, change, reason):
    folder, paths, plan, settings = run
    manifest.save(folder, plan(), settings, 3, "sum")
    mode, file = "sum", f"{folder}/manifest/manifest.json"
    if change == "settings":
        settings = settings | {"kappa": 2.5}
    elif change == "mode":
        mode = "divide"
    elif change == "content":
        open(paths[1].removeprefix("file://"), "r+b").write(b"x")
    elif change == "gone":
        os.remove(paths[2])
    elif change == "order":
        paths[0], paths[1] = paths[1], paths[0]
    elif change == "fewer":
        del paths[2:]
    elif change == "form":
        content = manifest.sealed(manifest.load(folder) | {"form": 99})
        open(file, "wb").write(content)
    elif change == "torn":
        content = open(file, "rb").read()
        open(file, "wb").write(content[: len(content) // 2])
    else:
        whole = json.load(open(file))
        json.dump(whole | {"body": whole["body"].replace('"processed": 3', '"processed": 2')}, open(file, "w"))
    with pytest.raises(ValueError, match=reason):
        manifest.resume(spark, folder, plan(), settings, mode)


def test_a_write_that_stops_leaves_the_last_one(spark, run):
    """A file of another name is no manifest, and a failed write does not touch the one before it."""
    folder, _, plan, settings = run
    manifest.save(folder, plan(), settings, 2, "sum")
    open(f"{folder}/manifest/.half", "wb").write(b'{"digest')
    with pytest.raises(TypeError):
        manifest.save(folder, plan(), {"kappa": object()}, 3, "sum")
    assert manifest.resume(spark, folder, plan(), settings, "sum") == 2


def test_no_path_and_no_file(spark, tmp_path):
    df = spark.createDataFrame([(0, None), (1, f"{tmp_path}/none"), (2, "nowhere://x")], "position int, path string")
    assert [(r["size"], r["sha256"]) for r in manifest.described(df).collect()] == [(None, None)] * 3
