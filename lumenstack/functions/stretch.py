"""Display functions of a sample, given its frame's levels as columns or numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip01(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def unclipped_linear(v: Column, black: Column, white: Column) -> Column:
    return (v - black) / (F.greatest(white, black + 1e-6) - black)


def unclipped_logarithmic(v: Column, black: Column, top: Column, scale: float = 10.0) -> Column:
    """log1p(s max(v - black, 1e-10)) over the same of the frame's greatest."""
    return F.log1p(scale * F.greatest(v - black, F.lit(1e-10))) / F.log1p(scale * F.greatest(top - black, F.lit(1e-10)))


def unclipped_asinh(v: Column, black: Column, top: Column, scale: float = 10.0) -> Column:
    """asinh(s max(v - black, 0)) over the same of the frame's greatest; 0 where nothing is above black."""
    return F.when(top > black, F.asinh(scale * F.greatest(v - black, F.lit(0.0))) / F.asinh(scale * (top - black))).otherwise(0.0)


def linear(v: Column, black: Column, white: Column) -> Column:
    return clip01(unclipped_linear(v, black, white))


def logarithmic(v: Column, black: Column, top: Column, scale: float = 10.0) -> Column:
    return clip01(unclipped_logarithmic(v, black, top, scale))


def asinh(v: Column, black: Column, top: Column, scale: float = 10.0) -> Column:
    return clip01(unclipped_asinh(v, black, top, scale))


def gamma(v: Column, power: float) -> Column:
    return F.pow(F.greatest(v, F.lit(1e-10)), F.lit(power))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def scnr(r: Column, g: Column, b: Column, amount: float = 1.0) -> Column:
    """Green above the mean of red and blue goes down to it, by `amount`."""
    neutral = (r + b) / 2
    return F.when(g > neutral, (1 - amount) * g + amount * neutral).otherwise(g)


def quantise(v: Column, top: int = 65535) -> Column:
    """Truncation of clip(v, 0, 1) * top."""
    return (clip01(v) * top).cast("int")


def grey_level(r: Column, g: Column, b: Column) -> Column:
    """Luminance of 8-bit levels as an 8-bit level, by weights in 65,536ths."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)


def blended(base: Column, v: Column, factor: float) -> Column:
    """8-bit levels base + factor (v - base) in single precision, truncated, within 0 and 255."""
    moved = base.cast("float") + F.lit(factor).cast("float") * (v - base).cast("float")
    return F.least(F.greatest(moved, F.lit(0.0).cast("float")), F.lit(255.0).cast("float")).cast("int")
