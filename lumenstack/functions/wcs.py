"""World coordinates: TAN projection, transforms and grids as expressions on columns, in degrees and 0-based pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def affine(x: Column, y: Column, m: tuple[Column, ...]) -> tuple[Column, Column]:
    """m: (m11, m12, m13, m21, m22, m23)."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def inverse_affine(x: Column, y: Column, m: tuple[Column, ...]) -> tuple[Column, Column]:
    det = m[0] * m[4] - m[1] * m[3]
    u, v = x - m[2], y - m[5]
    return (m[4] * u - m[1] * v) / det, (m[0] * v - m[3] * u) / det


def pixel_to_sky(x: Column, y: Column, w: dict[str, Column]) -> tuple[Column, Column]:
    """(ra, dec) of a pixel under crval1/2, crpix1/2 (1-based), cd11..cd22."""
    u, v = x + 1 - w["crpix1"], y + 1 - w["crpix2"]
    xi, eta = F.radians(w["cd11"] * u + w["cd12"] * v), F.radians(w["cd21"] * u + w["cd22"] * v)
    dec0 = F.radians(w["crval2"])
    down = F.cos(dec0) - eta * F.sin(dec0)
    ra = F.pmod(w["crval1"] + F.degrees(F.atan2(xi, down)), F.lit(360.0))
    return ra, F.degrees(F.atan2((F.sin(dec0) + eta * F.cos(dec0)), F.sqrt(xi * xi + down * down)))


def sky_to_pixel(ra: Column, dec: Column, w: dict[str, Column]) -> tuple[Column, Column]:
    """Null behind the projection's horizon."""
    a, d, d0 = F.radians(ra - w["crval1"]), F.radians(dec), F.radians(w["crval2"])
    cosc = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a)
    xi = F.degrees(F.cos(d) * F.sin(a) / cosc)
    eta = F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a)) / cosc)
    det = w["cd11"] * w["cd22"] - w["cd12"] * w["cd21"]
    u, v = (w["cd22"] * xi - w["cd12"] * eta) / det, (w["cd11"] * eta - w["cd21"] * xi) / det
    ahead = cosc > 0
    return F.when(ahead, u + w["crpix1"] - 1), F.when(ahead, v + w["crpix2"] - 1)


def header_number(header: Column, name: str) -> Column:
    """A keyword's number in a map of header cards; null where it is missing or no number."""
    return F.try_element_at(header, F.lit(name)).try_cast("double")


def of_header(header: Column) -> dict[str, Column]:
    """The coordinates that a header states: the CD matrix (a missing element is 0), or CDELT under PC or CROTA2."""
    n = lambda name: header_number(header, name)
    has_cd = F.coalesce(*(n(f"CD{i}_{j}") for i in (1, 2) for j in (1, 2))).isNotNull()
    turn, one, two = F.radians(F.coalesce(n("CROTA2"), F.lit(0.0))), n("CDELT1"), n("CDELT2")
    turned = {"11": F.cos(turn), "12": -F.sin(turn) * two / one, "21": F.sin(turn) * one / two, "22": F.cos(turn)}
    made = {}
    for place, default in turned.items():
        delta = one if place[0] == "1" else two
        pc = F.coalesce(n(f"PC{place[0]}_{place[1]}"), default)
        made[f"cd{place}"] = F.when(has_cd, F.coalesce(n(f"CD{place[0]}_{place[1]}"), F.lit(0.0))).otherwise(delta * pc)
    return {k: n(k.upper()) for k in ("crval1", "crval2", "crpix1", "crpix2")} | made


def of_optics(header: Column) -> dict[str, Column]:
    """A north-up grid about the middle of the frame, from RA, DEC, FOCALLEN (mm), XPIXSZ and YPIXSZ (um); null where one is missing."""
    n = lambda name: header_number(header, name)
    step = lambda size: F.degrees(n(size) * 1e-3 / F.nullif(n("FOCALLEN"), F.lit(0.0)))
    whole = step("XPIXSZ").isNotNull() & step("YPIXSZ").isNotNull()
    return {"crval1": n("RA"), "crval2": n("DEC"), "crpix1": (n("NAXIS1") + 1) / 2, "crpix2": (n("NAXIS2") + 1) / 2, "cd11": -step("XPIXSZ"), "cd12": F.when(whole, 0.0), "cd21": F.when(whole, 0.0), "cd22": step("YPIXSZ")}


def is_solution(w: dict[str, Column]) -> Column:
    """Every number is there, and the grid is celestial."""
    whole = F.lit(True)
    for v in w.values():
        whole &= v.isNotNull()
    return whole & is_celestial(w)


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in degrees."""
    a = F.pow(F.sin(F.radians(dec2 - dec1) / 2), F.lit(2.0))
    b = F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), F.lit(2.0))
    return F.degrees(2 * F.asin(F.sqrt(F.least(a + b, F.lit(1.0)))))


def plane_scales(w: dict[str, Column]) -> tuple[Column, Column]:
    return F.hypot(w["cd11"], w["cd21"]), F.hypot(w["cd12"], w["cd22"])


def is_celestial(w: dict[str, Column]) -> Column:
    """Finite plane scales between 0.05 and 20,000 arc seconds."""
    one, two = (s * 3600 for s in plane_scales(w))
    return F.coalesce(one.between(0.05, 20000.0) & two.between(0.05, 20000.0), F.lit(False))


def in_grid(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Lower bounds with a tolerance of 1e-9, upper bounds strict."""
    return F.coalesce((x >= -1e-9) & (x < width) & (y >= -1e-9) & (y < height), F.lit(False))


def scaled_grid(w: dict[str, float], scale: float) -> dict[str, float]:
    """The output grid of a scale: pixel p goes to scale p + scale - 1."""
    out = {k: w[k] / scale for k in ("cd11", "cd12", "cd21", "cd22")} | {k: w[k] * scale for k in ("crpix1", "crpix2")}
    return w | out | {k: round(w[k] * scale) for k in ("naxis1", "naxis2")}


def synthetic(ra: float, dec: float, focal_mm: float, pixel_um: float, width: int, height: int) -> dict[str, float]:
    """A north-up grid from a header's pointing and optics."""
    step = pixel_um / focal_mm * 206.265 / 3600
    return {"crval1": ra, "crval2": dec, "crpix1": (width + 1) / 2, "crpix2": (height + 1) / 2, "cd11": -step, "cd12": 0.0, "cd21": 0.0, "cd22": step, "naxis1": width, "naxis2": height}


def principal_angle(cxx: float, cyy: float, cxy: float) -> float:
    """Degrees of the principal axis of a covariance."""
    return math.degrees(0.5 * math.atan2(2 * cxy, cxx - cyy))
