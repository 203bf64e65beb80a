"""8-bit sRGB to 8-bit CIE L*a*b* and back, and 8-bit colour saturation. Values are whole numbers from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Linear sRGB to XYZ and back, the white point, and the bends of the curves.
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
FROM_XYZ = ((3.240479, -1.53715, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
WHITE = (0.950456, 1.0, 1.088754)
DARK, SLOPE, LIFT, GREY = 0.008856, 7.787, 16 / 116, 903.3
#: Weights of grey in 65536ths.
LUMA = (19595, 38470, 7471)


def whole(v: Column) -> Column:
    """Rounded (halves to even) and kept within 0 and 255; null stays null."""
    return F.when(v.isNotNull(), F.least(F.greatest(F.rint(v), F.lit(0.0)), F.lit(255.0))).cast("int")


def to_lab(r: Column, g: Column, b: Column, curve: bool = True) -> tuple[Column, Column, Column]:
    """curve: false if the values are linear already."""
    linear = [c / 255 if not curve else F.when(c <= 0.04045 * 255, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    x, y, z = (sum((m * c for m, c in zip(row, linear)), F.lit(0.0)) / white for row, white in zip(TO_XYZ, WHITE))
    fx, fy, fz = (F.when(t > DARK, F.cbrt(t)).otherwise(SLOPE * t + LIFT) for t in (x, y, z))
    lightness = F.when(y > DARK, 116 * fy - 16).otherwise(GREY * y)
    return whole(lightness * 2.55), whole(500 * (fx - fy) + 128), whole(200 * (fy - fz) + 128)


def from_lab(lightness: Column, a: Column, b: Column, curve: bool = True) -> tuple[Column, Column, Column]:
    l = lightness / 2.55
    dark = l <= DARK * GREY
    y = F.when(dark, l / GREY).otherwise(F.pow((l + 16) / 116, F.lit(3.0)))
    fy = F.when(dark, SLOPE * y + LIFT).otherwise((l + 16) / 116)
    back = lambda f: F.when(f <= 6 / 29, (f - LIFT) / SLOPE).otherwise(f * f * f)
    x, z = back(fy + (a - 128) / 500) * WHITE[0], back(fy - (b - 128) / 200) * WHITE[2]
    linear = [F.greatest(sum((m * c for m, c in zip(row, (x, y, z))), F.lit(0.0)), F.lit(0.0)) for row in FROM_XYZ]
    return tuple(whole(255 * (c if not curve else F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055))) for c in linear)


def saturated(r: Column, g: Column, b: Column, factor: float) -> tuple[Column, Column, Column]:
    """Each channel `factor` times as far from the pixel's grey, cut to a whole number."""
    grey = F.floor((LUMA[0] * r + LUMA[1] * g + LUMA[2] * b + 32768) / 65536)
    return tuple(F.least(F.greatest((grey + factor * (c - grey)).cast("int"), F.lit(0)), F.lit(255)) for c in (r, g, b))
