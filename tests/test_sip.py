"""Polynomial distortion against NumPy, its inverse, and header rules."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstack.functions import sip, wcs

RNG = np.random.default_rng(1)
CARDS = {"A_ORDER": "3", "B_ORDER": "2", "A_2_0": "2.1e-6", "A_1_1": "-1.3e-6", "A_0_3": "4e-9", "A_0_4": "9", "B_0_2": "-3e-6", "B_1_1": "7e-7", "B_3_0": "1", "CRVAL1": "150.2", "B_2_0": "not a number"}
A = {(2, 0): 2.1e-6, (1, 1): -1.3e-6, (0, 3): 4e-9}
B = {(0, 2): -3e-6, (1, 1): 7e-7}


@pytest.fixture(scope="module")
def points(spark):
    xy = RNG.uniform(-200, 2200, (300, 2))
    df = spark.createDataFrame([(float(x), float(y), CARDS) for x, y in xy] + [(None, 1.0, CARDS), (5.0, 6.0, {}), (5.0, 6.0, None)], "x double, y double, header map<string,string>")
    return xy, df.withColumns({"a": sip.coefficients(F.col("header"), "A"), "b": sip.coefficients(F.col("header"), "B")})


def plain(c, u, v):
    return sum(k * u**p * v**q for (p, q), k in c.items())


def test_forward(points):
    xy, df = points
    u, v = sip.distorted(F.col("x"), F.col("y"), F.col("a"), F.col("b"))
    got = df.select(u.alias("u"), v.alias("v")).collect()
    want = np.column_stack([xy[:, 0] + plain(A, *xy.T), xy[:, 1] + plain(B, *xy.T)])
    assert np.allclose([(r["u"], r["v"]) for r in got[:300]], want, rtol=1e-13)
    assert tuple(got[300]) == (None, None) and tuple(got[301]) == (5.0, 6.0) and tuple(got[302]) == (None, None)


def test_inverse(points):
    xy, df = points
    u, v = sip.distorted(F.col("x"), F.col("y"), F.col("a"), F.col("b"))
    back = df.withColumns({"u": u, "v": v}).select(sip.undistorted(F.col("u"), F.col("v"), F.col("a"), F.col("b")).alias("g")).select("g.*").collect()
    assert np.allclose([tuple(r) for r in back[:300]], xy, atol=1e-6)


def test_sky_round_trip(points):
    xy, df = points
    w = {k: F.lit(v) for k, v in {"crval1": 150.2, "crval2": 40.0, "crpix1": 1000.5, "crpix2": 1001.0, "cd11": -2e-4, "cd12": 1e-5, "cd21": 1e-5, "cd22": 2e-4}.items()}
    ra, dec = sip.pixel_to_sky(F.col("x"), F.col("y"), w, F.col("a"), F.col("b"))
    got = df.withColumns({"ra": ra, "dec": dec}).select("ra", "dec", sip.sky_to_pixel(F.col("ra"), F.col("dec"), w, F.col("a"), F.col("b")).alias("p")).collect()
    assert np.allclose([(r["p"]["x"], r["p"]["y"]) for r in got[:300]], xy, atol=1e-6)
    plain_ra, plain_dec = wcs.pixel_to_sky(F.col("x"), F.col("y"), w)
    flat = df.select(plain_ra.alias("ra"), plain_dec.alias("dec")).collect()
    assert max(abs(a["ra"] - b["ra"]) for a, b in zip(got[:300], flat[:300])) > 1e-4
    assert (got[301]["ra"], got[301]["dec"]) == pytest.approx((flat[301]["ra"], flat[301]["dec"]))


def test_suffix(spark):
    cases = [({"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "A_ORDER": "2"}, ("RA---TAN-SIP", "DEC--TAN-SIP")), ({"CTYPE1": "RA---TAN-sip", "bp_1_1": "0"}, ("RA---TAN-sip", None)), ({"CTYPE1": "RA---TAN", "AIRMASS": "1"}, ("RA---TAN", None)), ({}, (None, None)), (None, (None, None))]
    df = spark.createDataFrame([(h,) for h, _ in cases], "h map<string,string>")
    got = df.select(sip.with_suffix(F.col("h")).alias("h")).collect()
    assert [(None, None) if r["h"] is None else (r["h"].get("CTYPE1"), r["h"].get("CTYPE2")) for r in got] == [w for _, w in cases]
    assert got[0]["h"]["A_ORDER"] == "2" and got[4]["h"] is None


def plain_clean(text):
    out, modified, dropped = [], 0, 0
    for line in [l.rstrip() for l in text.splitlines() if l.strip()]:
        if not line.lstrip().startswith("CONTINUE"):
            out.append(line)
            continue
        found = re.match(r"^CONTINUE\s+(.*)$", line.strip())
        if not found:
            dropped += 1
            continue
        value = found[1].strip()
        if value[0] not in "'\"":
            value, modified = '"' + value.replace('"', '\\"') + '"', modified + 1
        out.append(f"CONTINUE {value}")
    return "\n".join(out) + "\n", modified, dropped


def test_side_files(spark):
    texts = ["", "A = 1\n\n  \nCONTINUE 'x'  \nEND", "  CONTINUE   bare \"word\" \nCONTINUE\nCONTINUED x\nCONTINUE\t\"q\"", "x\r\ny\rz", "\tCONTINUE\t5 \t\n é = 'ü'   "]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = [r["c"] for r in df.select(sip.clean_text(F.col("t")).alias("c")).collect()]
    assert got.pop() is None and [tuple(g) for g in got] == [plain_clean(t) for t in texts]
