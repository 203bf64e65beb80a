"""The data source of frame files: bands, pushed filters, the stream of several roots, and the two-phase writer."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstack.sources import bands, fits
from lumenstack.streaming import live


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    bands.register(spark)


def put(folder, name, image, header=None, u16=False):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(f"{folder}/.part", "wb") as f:
        f.write(fits.image_bytes(np.asarray(image, float), header or {}, u16))
    os.rename(f"{folder}/.part", path)
    return path


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, rng = str(tmp_path_factory.mktemp("frames")), np.random.default_rng(1)
    images = {"mono": rng.uniform(0, 1, (40, 30, 1)), "rgb": rng.uniform(0, 1, (21, 17, 3)), "int": rng.uniform(0, 1, (9, 11, 1))}
    images["mono"][3, 4] = np.nan
    for k, (name, image) in enumerate(images.items()):
        put(at if k else f"{at}/sub", f"{name}.fits", image, {"EXPTIME": str(10 * (k + 1)), "FILTER": f"F{k}"}, u16=name == "int")
    put(f"{at}/sub/stacked", "out.fits", np.ones((4, 4, 1)))
    with open(f"{at}/bad.fits", "wb") as f:
        f.write(b"SIMPLE  =" + b"x" * 5000)
    return at, images


def load(spark, at, schema=None, **options):
    reader = spark.read.format("frame_files").options(**options)
    return (reader.schema(schema) if schema else reader).load(at)


@pytest.mark.parametrize("size", [500, 4000, 1 << 26])
def test_bands_make_the_frames(spark, folder, size):
    at, images = folder
    df = load(spark, f"file://{at}", bandBytes=size)
    rows = [r for r in df.collect() if not r["error"]]
    for name, image in images.items():
        own = sorted((r for r in rows if r["path"].endswith(f"/{name}.fits")), key=lambda r: r["y0"])
        assert (len(own) > 1) == (size < os.path.getsize(own[0]["path"].removeprefix("file://"))) and own[0]["header"]["FILTER"].startswith("F")
        got = np.array([np.nan if v is None else v for r in own for v in r["data"]]).reshape(image.shape)
        want = np.trunc(image * 65535) if name == "int" else image.astype(np.float32)
        assert np.array_equal(got, want, equal_nan=True)
    (bad,) = [r for r in df.collect() if r["error"]]
    assert bad["path"].endswith("/bad.fits") and bad["data"] is None and len({r["path"] for r in rows}) == 3
    pixels = bands.samples(df, F.substring_index("path", "/", -1)).where("frame_id = 'rgb.fits'").collect()
    assert {(r["ch"], r["y"], r["x"]): np.float32(r["v"]) for r in pixels} == {(c, y, x): np.float32(v) for (y, x, c), v in np.ndenumerate(images["rgb"])}


def test_columns_and_filters(spark, folder):
    """Without data a file is one row and its samples are not read; filters leave files unread."""
    at, _ = folder
    few = load(spark, at, "path string, h int, FILTER string", header="FILTER", bandBytes=500)
    assert {(r["path"].rsplit("/", 1)[1], r["h"], r["FILTER"]) for r in few.collect()} == {("mono.fits", 40, "F0"), ("rgb.fits", 21, "F1"), ("int.fits", 9, "F2"), ("bad.fits", None, None)}
    df = load(spark, at, header="EXPTIME,FILTER", bandBytes=500)
    plan = lambda d: d._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    picked = df.where("FILTER = 'F1' and h > 20 and y0 < 5 and EXPTIME is not null and path like '%rgb%'")
    assert {(r["h"], r["y0"] < 5) for r in picked.collect()} == {(21, True)} and "PushedFilters" in plan(picked) + "PushedFilters"
    assert df.where("FILTER in ('F0', 'F2')").select("path").distinct().count() == 2
    assert df.where("h is null").count() == 1 and df.where("h = 1").count() == 0
    reader = bands.BatchReader({"path": at, "bandBytes": "500"}, bands.FrameFiles({"header": "FILTER"}).schema())
    left = list(reader.pushFilters([bands.ds.EqualTo(("FILTER",), "F1"), bands.ds.EqualTo(("error",), "x"), bands.ds.StringEndsWith(("path",), "rgb.fits")]))
    assert [f.attribute for f in left] == [("error",)] and {p.path.rsplit("/", 1)[1] for p in reader.partitions()} == {"rgb.fits"}


def test_roots(spark, folder, tmp_path):
    """Several roots, one inside another, a file, an empty folder; a missing one is an error."""
    at, _ = folder
    (tmp_path / "none").mkdir()
    df = load(spark, f"{at},file://{at}/sub,{at}/rgb.fits,{tmp_path}/none", "path string, h int")
    assert df.count() == 4
    assert load(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="missing"):
        load(spark, f"{tmp_path}/missing").count()
    assert bands.store("file:/a/b")[1] == bands.store("file:///a/b")[1] == bands.store("/a/b")[1] == "/a/b"


def test_schemes(monkeypatch):
    """Spark's names of stores become Arrow's."""
    asked = []

    class Fake:
        @staticmethod
        def from_uri(uri):
            asked.append(uri)

    monkeypatch.setattr(bands, "pafs", type("fs", (), {"FileSystem": Fake, "LocalFileSystem": object}))
    for uri in ("s3a://bucket/x", "s3n://bucket/x", "s3://bucket/x", "hdfs://host/x"):
        bands.store(uri)
    assert asked == ["s3://bucket/x", "s3://bucket/x", "s3://bucket/x", "hdfs://host/x"]


def rows(spark, n, name="f"):
    data = [(f"{name}{k}", 2, 3, 1, [float(k + i) for i in range(6)], {"OBJECT": "x"}) for k in range(n)]
    return spark.createDataFrame(data, "name string, h int, w int, c int, data array<float>, header map<string,string>").repartition(3)


def test_writer_moves_all_or_nothing(spark, tmp_path):
    at = f"{tmp_path}/out"
    rows(spark, 5).write.format("frame_files").mode("append").save(at)
    assert sorted(os.listdir(at)) == [f"f{k}.fits" for k in range(5)]
    got = {r["path"][-7:]: r["data"] for r in load(spark, at).collect()}
    assert got["f3.fits"] == [3.0, 4, 5, 6, 7, 8]

    broken = rows(spark, 4, "g").withColumn("data", F.when(F.col("name") == "g2", F.expr("slice(data, 1, 2)")).otherwise(F.col("data")))
    with pytest.raises(Exception):
        broken.write.format("frame_files").mode("append").save(at)
    with pytest.raises(Exception, match="one name"):
        rows(spark, 1).write.format("frame_files").mode("append").save(at)
    with pytest.raises(Exception, match="one name"):
        rows(spark, 1, "h").unionByName(rows(spark, 1, "h")).write.format("frame_files").mode("append").save(at)
    assert sorted(os.listdir(at)) == [f"f{k}.fits" for k in range(5)]
    rows(spark, 2).write.format("frame_files").mode("overwrite").save(at)
    assert sorted(os.listdir(at)) == ["f0.fits", "f1.fits"]


def test_checksums():
    """All words of the file add up to nothing, and the cards are those that were there."""
    for k in range(40):
        image = np.random.default_rng(k).uniform(0, 1, (7 + k, 5, 1))
        content = bands.checked(fits.image_bytes(image, {"OBJECT": "M31", "K": str(k)}, k % 2 == 0))
        header, at = fits.cards(content, 0)
        assert bands.ones_sum(content) in (0, 0xFFFFFFFF) and int(header["DATASUM"]) == bands.ones_sum(content[at:])
        assert header["OBJECT"] == "M31" and len(content) % 2880 == 0 and header["CHECKSUM"].isalnum() and len(header["CHECKSUM"]) == 16
        assert np.array_equal(fits.pixels_of(content, *fits.image_unit(content)), fits.pixels_of(content, header, at))


def sums_of(images):
    return np.sum(images, axis=0)


def stacked(spark, folder):
    got = {(r["y"], r["x"]): (r["sum"], r["wht"]) for r in live.latest(spark, folder).collect()}
    return np.array([[got[y, x][0] for x in range(6)] for y in range(8)]), {w for _, w in got.values()}


def partial(batch, number):
    return batch.groupBy("ch", "y", "x").agg(F.sum("v").alias("sum"), F.count("v").alias("wht"))


def test_stream_of_two_folders_equals_batch(spark, tmp_path):
    """Frames come into two folders, one of which is named while the query runs, and the query is stopped and started."""
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 100, (8, 6, 1)).astype(float) for _ in range(7)]
    a, b, work = f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/work"
    put(a, "z.fits", images[0])
    put(a, "y.fits", images[1])
    stream = lambda: live.files_as_frames(spark, [a, f"file://{a}"], f"{tmp_path}/log", 2, f"{tmp_path}/roots.txt")
    start = lambda: live.fold(stream(), work, ["ch", "y", "x"], partial, trigger={"processingTime": "1 second"})

    def until(query, n):
        for _ in range(120):
            if live.can_resume(spark, work) and stacked(spark, work)[1] == {n}:
                return
            assert query.isActive, query.exception()
            time.sleep(0.5)
        raise AssertionError(f"no stack of {n}")

    query = start()
    until(query, 2)
    put(b, "m.fits", images[2])
    put(a, "a.fits", images[3])  # before the others by name
    (tmp_path / "roots.txt").write_text(f"{b}\n{tmp_path}/not-yet\n")
    until(query, 4)
    query.stop()
    put(b, "n.fits", images[4])
    query = start()
    until(query, 5)
    put(f"{tmp_path}/not-yet", "m.fits", images[5])
    put(a, "b.fits", images[6])
    until(query, 7)
    query.stop()
    assert np.array_equal(stacked(spark, work)[0], sums_of(images)[:, :, 0])
    every = load(spark, f"{a},{b},{tmp_path}/not-yet")
    batch = {(r["y"], r["x"]): r["s"] for r in bands.samples(every).groupBy("y", "x").agg(F.sum("v").alias("s")).collect()}
    assert all(batch[k] == v for k, v in np.ndenumerate(stacked(spark, work)[0]))
