"""Polynomial distortion of world coordinates (the SIP convention) as expressions: forward, its inverse by fixed-point steps, and
headers.

A frame's coefficients are two arrays, one place for each term u^p v^q of p + q up to the order, read from its header once; a
pixel then meets arrays, not header look-ups. Null coordinates and null coefficients give null; a header without terms gives
arrays of 0, that is no distortion.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenstack.functions import wcs


def terms(order: int) -> list[tuple[int, int]]:
    return [(p, n - p) for n in range(order + 1) for p in range(n, -1, -1)]


def coefficients(header: Column, kind: str, order: int = 5) -> Column:
    """The array of a header's cards kind_p_q, such as A_2_0; terms that are missing, no number, or over the header's own
    kind_ORDER are 0."""
    number = lambda k: F.try_element_at(header, F.lit(k)).try_cast("double")
    own = F.coalesce(number(f"{kind}_ORDER"), F.lit(float(order)))
    return F.when(header.isNotNull(), F.array(*(F.when(own >= p + q, F.coalesce(number(f"{kind}_{p}_{q}"), F.lit(0.0))).otherwise(0.0) for p, q in terms(order))))


def polynomial(c: Column, u: Column, v: Column, order: int = 5) -> Column:
    """The sum of c[p, q] u^p v^q, by Horner's rule in u over rows in v."""
    place = {t: i for i, t in enumerate(terms(order))}
    total = F.lit(0.0)
    for p in range(order, -1, -1):
        row = F.lit(0.0)
        for q in range(order - p, -1, -1):
            row = row * v + F.element_at(c, place[p, q] + 1)
        total = total * u + row
    return total


def distorted(u: Column, v: Column, a: Column, b: Column, order: int = 5) -> tuple[Column, Column]:
    """Offsets from the reference pixel with their distortion: u + A(u, v), v + B(u, v)."""
    return u + polynomial(a, u, v, order), v + polynomial(b, u, v, order)


def undistorted(u: Column, v: Column, a: Column, b: Column, order: int = 5, steps: int = 20) -> Column:
    """struct(u, v) whose distorted() is the given offset: each step takes off the distortion at the last guess.

    A fold, so that the expression does not double with each step. A distortion that changes by a tenth of a pixel a pixel
    gains a digit a step; where it changes by a pixel or more there is no inverse, and what comes out is not one.
    """
    guess = F.struct(u.cast("double").alias("u"), v.cast("double").alias("v"))
    step = lambda g, _: F.struct((u - polynomial(a, g["u"], g["v"], order)).alias("u"), (v - polynomial(b, g["u"], g["v"], order)).alias("v"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), guess, step)


def pixel_to_sky(x: Column, y: Column, w: dict[str, Column], a: Column, b: Column, order: int = 5) -> tuple[Column, Column]:
    """(ra, dec) of a 0-based pixel."""
    u, v = distorted(x + 1 - w["crpix1"], y + 1 - w["crpix2"], a, b, order)
    return wcs.pixel_to_sky(u + w["crpix1"] - 1, v + w["crpix2"] - 1, w)


def sky_to_pixel(ra: Column, dec: Column, w: dict[str, Column], a: Column, b: Column, order: int = 5, steps: int = 20) -> Column:
    """struct(x, y), 0-based; null behind the projection's horizon."""
    x, y = wcs.sky_to_pixel(ra, dec, w)
    at = undistorted(x + 1 - w["crpix1"], y + 1 - w["crpix2"], a, b, order, steps)
    return F.struct((at["u"] + w["crpix1"] - 1).alias("x"), (at["v"] + w["crpix2"] - 1).alias("y"))


def has_terms(header: Column) -> Column:
    """Whether a header names distortion: A_ORDER or B_ORDER, or a card that begins with A_, B_, AP_ or BP_."""
    return F.coalesce(F.exists(F.map_keys(header), lambda k: F.upper(k).rlike("^(A|B|AP|BP)_")), F.lit(False))


def with_suffix(header: Column) -> Column:
    """The header with -SIP after CTYPE1 and CTYPE2 where it names distortion and they do not say so yet."""
    lacks = lambda k, v: k.isin("CTYPE1", "CTYPE2") & ~F.upper(F.coalesce(v, F.lit(""))).contains("-SIP")
    return F.when(has_terms(header), F.transform_values(header, lambda k, v: F.when(lacks(k, v), F.concat(F.coalesce(v, F.lit("")), F.lit("-SIP"))).otherwise(v))).otherwise(header)


def clean_text(text: Column) -> Column:
    """struct(text, modified, dropped) of a solver's side file: lines without trailing blanks, blank ones left out; CONTINUE lines
    without a value dropped, and unquoted values put in double quotes, quotes in them escaped. Null stays null."""
    blank = r"^\s*$"
    lines = F.transform(F.filter(F.split(text, r"\r\n|\n|\r"), lambda l: ~l.rlike(blank)), lambda l: F.rtrim(F.regexp_replace(l, r"\s+$", "")))
    goes_on = lambda l: F.ltrim(F.regexp_replace(l, r"^\s+", "")).startswith("CONTINUE")
    value = lambda l: F.regexp_extract(l, r"^\s*CONTINUE\s+(.*)$", 1)
    bad = lambda l: goes_on(l) & ~l.rlike(r"^\s*CONTINUE\s+\S")
    bare = lambda l: goes_on(l) & ~value(l).rlike("^['\"]")
    kept = F.filter(lines, lambda l: ~bad(l))
    quoted = lambda l: F.concat(F.lit('CONTINUE "'), F.replace(value(l), F.lit('"'), F.lit('\\"')), F.lit('"'))
    out = F.transform(kept, lambda l: F.when(bare(l), quoted(l)).when(goes_on(l), F.concat(F.lit("CONTINUE "), value(l))).otherwise(l))
    return F.when(text.isNotNull(), F.struct(F.concat(F.array_join(out, "\n"), F.lit("\n")).alias("text"), F.size(F.filter(kept, bare)).cast("long").alias("modified"), F.size(F.filter(lines, bad)).cast("long").alias("dropped")))
