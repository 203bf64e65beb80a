"""Drizzle with footprints of any shape and with kernels: flux of each sample over the output cells that it reaches.

Cells are centred on whole coordinates. A sample is a bounded explosion over the cells of its footprint's box and
one sum by cell, so frames, batches and partitions may be cut in any way.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack.functions import wcs
from lumenstack.functions.stretch import clip01
from lumenstack.operators import robust
from lumenstack.operators.project import summed

Point = tuple[Column, Column]


def _under(y: Column) -> Column:
    """Integral of clip(t, 0, 1) over t up to y."""
    return F.when(y <= 0, 0.0).when(y >= 1, y - 0.5).otherwise(y * y / 2)


def edge_area(a: Point, b: Point) -> Column:
    """Signed area between a directed edge and the axis, inside the unit square: the integral of the edge's height,
    kept within [0, 1], over its stretch of x within [0, 1]."""
    (ax, ay), (bx, by) = a, b
    slope = F.when(F.abs(bx - ax) > 1e-12, (by - ay) / (bx - ax)).otherwise(0.0)
    left, right = clip01(ax), clip01(bx)
    low, high = ay + slope * (left - ax), ay + slope * (right - ax)
    level = F.abs(high - low) < 1e-9
    return F.when(level, (right - left) * clip01((low + high) / 2)).otherwise((right - left) * (_under(high) - _under(low)) / (high - low))


def overlap(quad: list[Point], x: Column, y: Column) -> Column:
    """Area of a simple quadrilateral within the cell around (x, y)."""
    moved = [(px - x + 0.5, py - y + 0.5) for px, py in quad]
    return F.abs(sum((edge_area(moved[i], moved[(i + 1) % 4]) for i in range(1, 4)), edge_area(moved[0], moved[1])))


def quad_area(quad: list[Point]) -> Column:
    cross = lambda a, b: a[0] * b[1] - b[0] * a[1]
    return F.abs(sum((cross(quad[i], quad[(i + 1) % 4]) for i in range(1, 4)), cross(quad[0], quad[1]))) / 2


def _over_cells(rows: DataFrame, bounds: dict[str, tuple[Column, Column]], sizes: dict[str, int]) -> DataFrame:
    """A row for each output cell cy, cx between the bounds."""
    for axis in "yx":
        low, high = bounds[axis]
        first, last = F.greatest(F.floor(low + 0.5), F.lit(0)), F.least(F.ceil(high + 0.5) - 1, F.lit(sizes[axis] - 1))
        rows = rows.where(first <= last).withColumn(f"c{axis}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return rows


def corners_of(x: Column, y: Column, pixfrac: float) -> list[Point]:
    """Corners of a sample's square, shrunk by pixfrac, in order around it."""
    half = pixfrac / 2
    return [(x + dx * half, y + dy * half) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def drizzle_square(px: DataFrame, key: list[str], to_output: Callable[[Column, Column], Point], width: int, height: int, pixfrac: float = 1.0, weight: Column | None = None) -> DataFrame:
    """The default kernel: each sample's square, shrunk by pixfrac, is carried over corner by corner, and its flux is
    shared by the area that each cell has of the quadrilateral. Samples whose centre is outside the grid count nowhere.

    to_output: output position of an input position. Returns (key, y, x, sum, wht, sci).
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return drizzle_quads(px, key, [to_output(*c) for c in corners_of(x, y, pixfrac)], to_output(x, y), width, height, weight)


@robust.any_key
def drizzle_quads(px: DataFrame, key: list[str], corners: list[Point], centre: Point, width: int, height: int, weight: Column | None = None) -> DataFrame:
    """drizzle_square of samples whose corners and centre on the output are known."""
    cx, cy = centre
    inside = wcs.in_grid(cx, cy, F.lit(width), F.lit(height))
    w = F.lit(1.0) if weight is None else weight
    rows = px.where(F.col("v").isNotNull() & inside).select(*key, "v", w.alias("w"), *(c.alias(f"q{i}{axis}") for i, point in enumerate(corners) for axis, c in zip("xy", point)))
    quad = [(F.col(f"q{i}x"), F.col(f"q{i}y")) for i in range(4)]
    ends = {axis: (F.least(*(F.col(f"q{i}{axis}") for i in range(4))), F.greatest(*(F.col(f"q{i}{axis}") for i in range(4)))) for axis in "xy"}
    cells = _over_cells(rows.withColumn("area", quad_area(quad)).where("area > 0"), ends, {"x": width, "y": height})
    return summed(cells.withColumn("w", F.col("w") * overlap(quad, F.col("cx"), F.col("cy")) / F.col("area")).where("w > 0"), key)


def _sinc(x: Column) -> Column:
    return F.when(F.abs(x) < 1e-9, 1.0).otherwise(F.sin(x * math.pi) / (x * math.pi))


@robust.any_key
def drizzle_kernel(px: DataFrame, key: list[str], out_x: Column, out_y: Column, width: int, height: int, kernel: str, pixfrac: float = 1.0, scale: float = 1.0, weight: Column | None = None) -> DataFrame:
    """Kernels by the distance of a cell's centre: gaussian (full width pixfrac * scale, to 2.5 deviations or 1.2 input
    pixels), tophat (a disc of that diameter), lanczos2 and lanczos3 (a product by axis, lobes of that width)."""
    size = pixfrac * scale
    if kernel == "gaussian":
        deviation = size / 2.3548
        reach = max(2.5 * deviation, 1.2 * scale)
        share = lambda dx, dy: F.exp(-(dx * dx + dy * dy) / (2 * deviation**2)) / (2 * math.pi * deviation**2)
    elif kernel == "tophat":
        reach = size / 2
        share = lambda dx, dy: F.when(dx * dx + dy * dy <= reach * reach, 1.0).otherwise(0.0)
    elif kernel in ("lanczos2", "lanczos3"):
        lobes = int(kernel[-1])
        reach = lobes * size
        one = lambda d: F.when(F.abs(d) < reach, _sinc(d / size) * _sinc(d / reach)).otherwise(0.0)
        share = lambda dx, dy: one(dx) * one(dy)
    else:
        raise ValueError(f"no kernel {kernel}")
    w = F.lit(1.0) if weight is None else weight
    rows = px.where(F.col("v").isNotNull()).select(*key, "v", w.alias("w"), out_x.alias("ox"), out_y.alias("oy")).where("ox is not null and oy is not null")
    # The box of whole cells within reach: bounds of _over_cells are those of a footprint, so reach goes less half a cell.
    ends = {axis: (F.ceil(F.col(f"o{axis}") - reach) - 0.5, F.floor(F.col(f"o{axis}") + reach) + 0.5) for axis in "xy"}
    cells = _over_cells(rows, ends, {"x": width, "y": height})
    return summed(cells.withColumn("w", F.col("w") * share(F.col("cx") - F.col("ox"), F.col("cy") - F.col("oy"))).where("w <> 0"), key)


def sky_map(transform: tuple[Column, ...] | None, reference: dict[str, Column], output: dict[str, Column]) -> Callable[[Column, Column], Point]:
    """Input position to output position: the frame's transform onto the reference (none: it is solved itself), the
    reference's sky, and the output grid."""

    def run(x: Column, y: Column) -> Point:
        rx, ry = wcs.affine(x, y, transform) if transform else (x, y)
        return wcs.sky_to_pixel(*wcs.pixel_to_sky(rx, ry, reference), output)

    return run


def sum_of_results(results: DataFrame, key: list[str], group: list[str], mode: str) -> DataFrame:
    """Results (frame's sci and wht by cell) added up; `max` times the greatest sum of weights of the image, `n_images`
    times the number of results, else sum / weights."""
    acc = results.groupBy(*group, *key).agg(F.sum(F.col("sci") * F.col("wht")).alias("sum"), F.sum("wht").alias("wht"), F.count("*").alias("n"))
    value = F.col("sum") / F.greatest("wht", F.lit(1e-9))
    if mode not in ("max", "n_images"):
        return acc.withColumn("value", value)
    whole = acc.groupBy(*group).agg((F.max("wht") if mode == "max" else F.max("n").cast("double")).alias("factor"))
    return acc.join(whole, group).withColumn("value", value * F.col("factor")).drop("factor")
