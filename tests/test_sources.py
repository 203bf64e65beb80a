import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstack.plans import lifecycle
from lumenstack.sources import fits, plan


def test_fits_round_trip(spark, tmp_path):
    image = [float(i) / 48 for i in range(48)]
    rows = [("a", 4, 12, 1, image, {"OBJECT": "M'31", "EXPTIME": "10.5"}), ("b", 6, 8, 1, [None, *image[1:]], {})]
    df = spark.createDataFrame(rows, "name string, h int, w int, c int, data array<float>, header map<string,string>")
    folder = f"file://{tmp_path}/out"
    assert fits.write_fits(df, folder, "name") == ["a.fits", "b.fits"]
    got = {r["path"].rsplit("/", 1)[1]: r for r in fits.read_fits(spark, folder).collect()}
    assert (got["a.fits"]["h"], got["a.fits"]["w"], got["a.fits"]["c"]) == (4, 12, 1)
    assert np.allclose(got["a.fits"]["data"], image) and got["a.fits"]["header"]["OBJECT"] == "M'31"
    assert got["b.fits"]["data"][0] is None
    assert (tmp_path / "out/a.fits").stat().st_size % 2880 == 0


def test_u16_truncates(spark, tmp_path):
    df = spark.createDataFrame([("q", 2, 2, 1, [0.0, 1.0, 0.5, 0.25], {})], "name string, h int, w int, c int, data array<float>, header map<string,string>")
    fits.write_fits(df, f"file://{tmp_path}/u", "name", u16=True)
    (row,) = fits.read_fits(spark, f"file://{tmp_path}/u").collect()
    assert row["data"] == [0, 65535, 32767, 16383] and row["header"]["BZERO"] == "32768"


def test_colour_layout_and_damage(spark, tmp_path):
    image = np.arange(6 * 7 * 3, dtype=float).reshape(6, 7, 3)
    (tmp_path / "c.fits").write_bytes(fits.image_bytes(image, {}, False))
    (tmp_path / "bad.fits").write_bytes(b"x" * 100)
    got = {r["path"].rsplit("/", 1)[1]: r for r in fits.read_fits(spark, f"file://{tmp_path}").collect()}
    assert got["c.fits"]["data"] == image.ravel().tolist() and got["c.fits"]["c"] == 3
    assert got["bad.fits"]["data"] is None and got["bad.fits"]["error"]


@pytest.mark.parametrize("text, want", [("order,file\n2,b.fit\n1,a.fit\n", ["a.fit", "b.fit"]), ("7,x.fit\n8,y.fit\n", ["x.fit", "y.fit"]), ("x.fit\ny.fit\n", ["x.fit", "y.fit"]), ("order,batch_id,file_path,exposure\n1,A,/p/a.fit,10\n2,B,,10\n", ["/p/a.fit"])])
def test_plan_variants(spark, tmp_path, text, want):
    (tmp_path / "plan.csv").write_text(text)
    rows = plan.read_plan(spark, f"file://{tmp_path}/plan.csv").orderBy("order").collect()
    assert [r["file_path"] for r in rows] == want


def test_batches_and_missing(spark, tmp_path):
    (tmp_path / "plan.csv").write_text("order,batch_id,file_path\n3,A,c\n1,B,a\n2,A,b\n")
    rows = plan.read_plan(spark, f"file://{tmp_path}/plan.csv", base="/data")
    assert [(r["batch_id"], r["files"]) for r in lifecycle.plan_batches(rows).collect()] == [("B", ["/data/a"]), ("A", ["/data/b", "/data/c"])]
    files = spark.createDataFrame([("/data/a",), ("/data/b",)], "path string")
    assert plan.with_files(rows, files).count() == 2
    with pytest.raises(ValueError, match="/data/c"):
        plan.with_files(rows, files, missing_is_error=True)


def test_decisions():
    assert lifecycle.final_combine(None, " Winsorized_Sigma_Clip ") == "winsorized_sigma_clip" and lifecycle.final_combine("nonsense", None) == "nonsense"
    assert lifecycle.final_combine("reproject and coadd", "median") == "reproject_coadd" and lifecycle.final_combine("", "none") == "none" and lifecycle.final_combine(None, None) == "mean"
    c = lifecycle.StackConfig(kappa=9, winsor_limits=(0.6, 0.1), pixfrac=5).clamped()
    assert (c.kappa, c.winsor_limits, c.pixfrac) == (5.0, (0.05, 0.05), 1.0)


def test_header(spark):
    df = spark.createDataFrame([({"CRVAL1": "1", "CRVAL2": "2", "CRPIX1": "1", "CRPIX2": "1", "CDELT1": "1", "CDELT2": "1", "HISTORY": "é"},), ({"CRVAL1": "1"},)], "h map<string,string>")
    rows = df.select(lifecycle.has_wcs(F.col("h")).alias("ok"), lifecycle.without_keywords(F.col("h")).alias("h")).collect()
    assert [r["ok"] for r in rows] == [True, False] and "HISTORY" not in rows[0]["h"]
