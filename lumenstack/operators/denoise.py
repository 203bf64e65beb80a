"""Non-local means over packed tiles that carry a border from their neighbours.

A sample becomes the mean of the samples in a search window around it, weighted by how alike the patches around both
are. Each sample is sent to the tiles that it is in or borders on, so that a tile is worked on by itself; patch distances
of a whole tile are one difference and two running sums for each step of the search window.

Images of one call have one size, h x w, mirrored at the borders without the border samples; samples are whole numbers from 0 to
255, masked or absent ones count as 0, repeated ones as one of them. An empty table gives no rows. Columns that are not
named are dropped.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenstack.functions import lab
from lumenstack.operators import tiles
from lumenstack.operators.contrast import mirror_images

#: Weights are whole numbers, and one under a thousandth of the greatest is none.
LEAST_WEIGHT, LARGEST = 0.001, 2**31 - 1


@functools.lru_cache(16)
def weights_by_distance(strength: float, channels: int, template: int, search: int) -> tuple[np.ndarray, int]:
    """(weights, shift): the weight of a summed patch distance d is weights[d >> shift]."""
    area = template * template
    shift = (area - 1).bit_length()
    unit = LARGEST // (search * search * 255)
    mean = np.arange((area * 255 * 255 * channels >> shift) + 1) * (2**shift / area)
    weights = np.rint(unit * np.exp(-mean / (strength * strength * channels))).astype(np.int64)
    return np.where(weights < LEAST_WEIGHT * unit, 0, weights), shift


def denoise_tile(block: np.ndarray, strength: float, template: int, search: int) -> np.ndarray:
    """block: tiles (if there are several), channels, rows and columns, with a border of half a search window and half a patch around
    what is returned."""
    weights, shift = weights_by_distance(strength, block.shape[-3], template, search)
    reach, half = search // 2, template // 2
    border = reach + half
    rows, columns = block.shape[-2] - 2 * border, block.shape[-1] - 2 * border
    seen = lambda dy, dx: block[..., reach + dy : reach + dy + rows + 2 * half, reach + dx : reach + dx + columns + 2 * half]
    own, several = seen(0, 0), block.shape[:-3]
    total, result = np.zeros((*several, rows, columns), np.int64), np.zeros((*several, block.shape[-3], rows, columns), np.int64)
    gap = np.zeros((*several, rows + 2 * half + 1, columns + 2 * half + 1), np.int64)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            other = seen(dy, dx)
            gap[..., 1:, 1:] = ((own - other) ** 2).sum(-3).cumsum(-2).cumsum(-1)
            patch = gap[..., template:, template:] - gap[..., :-template, template:] - gap[..., template:, :-template] + gap[..., :-template, :-template]
            weight = weights[patch >> shift]
            total += weight
            result += weight[..., None, :, :] * other[..., half : half + rows, half : half + columns]
    total = total[..., None, :, :]
    return (result + total // 2) // total


def non_local_means(px: DataFrame, key: list[str], h: int, w: int, strength: float, columns: tuple[str, ...] = ("v",), template: int = 7, search: int = 21, tile: int = 64) -> DataFrame:
    """(key, y, x, columns): the columns' samples, which share their weights, after denoising. template, search: odd sides.

    tile: side of the squares worked on at once; the result does not depend on it.
    """
    border = search // 2 + template // 2
    names, data = [f"k{i}" for i in range(len(key))], [f"c{i}" for i in range(len(columns))]
    value = lambda c: F.least(F.greatest(F.coalesce(F.col(c).cast("int"), F.lit(0)), F.lit(0)), F.lit(255))
    rows = px.select(*(F.col(k).alias(n) for k, n in zip(key, names)), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *(value(c).alias(n) for c, n in zip(columns, data)))
    for axis, size in (("y", h), ("x", w)):
        rows = rows.withColumn(axis, F.explode(mirror_images(F.col(axis), size, -border, size + border)))
        first, last = F.greatest(F.ceil((F.col(axis) - border - tile + 1) / tile), F.lit(0)), F.least(F.floor((F.col(axis) + border) / tile), F.lit((size - 1) // tile))
        rows = rows.where(first <= last).withColumn(f"t{axis}", F.explode(F.sequence(first, last)))
    kinds = dict(rows.dtypes)

    cut, call = tiles.dealt(rows, [*names, "ty", "tx"])

    def run(table: pa.Table) -> pa.Table:
        done = []
        for some, number, heads in tiles.split(table, [*names, "ty", "tx"], len(data) * (tile + 2 * border) ** 2):
            y0, x0 = (some[c].to_numpy().astype(np.int64) * tile for c in ("ty", "tx"))
            sides = np.stack([np.minimum(tile, h - y0[heads]), np.minimum(tile, w - x0[heads])])
            for height, width in np.unique(sides, axis=1).T.tolist():
                like = np.flatnonzero((sides[0] == height) & (sides[1] == width))
                place = np.full(len(heads), -1)
                place[like] = np.arange(len(like))
                y, x = some["y"].to_numpy() - y0 + border, some["x"].to_numpy() - x0 + border
                inside = (place[number] >= 0) & (y < height + 2 * border) & (x < width + 2 * border)
                at, y, x = place[number][inside], y[inside], x[inside]
                block = np.zeros((len(like), len(data), height + 2 * border, width + 2 * border), np.int64)
                there = np.zeros((len(like), height + 2 * border, width + 2 * border), bool)
                for k, c in enumerate(data):
                    block[at, k, y, x] = some[c].to_numpy()[inside]
                there[at, y, x] = True
                made = denoise_tile(block, strength, template, search)
                t, oy, ox = np.nonzero(there[:, border : border + height, border : border + width])
                first = heads[like][t]
                keys = {n: some[n].combine_chunks().take(pa.array(first)) for n in names}
                done.append(pa.table(keys | {"y": (y0[first] + oy).astype(np.int32), "x": (x0[first] + ox).astype(np.int32)} | {c: made[t, k, oy, ox].astype(np.int32) for k, c in enumerate(data)}))
        return pa.concat_tables(done)

    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "y int", "x int", *(f"{c} int" for c in data)])
    done = cut.groupBy(call).applyInArrow(run, schema)
    return done.select(*(F.col(n).alias(k) for k, n in zip(key, names)), "y", "x", *(F.col(c).alias(n) for c, n in zip(data, columns)))


def denoised(px: DataFrame, key: list[str], h: int, w: int, strength: float, columns: tuple[str, ...] = ("v",), tile: int = 64) -> DataFrame:
    """(key, y, x, columns) in [0, 1]: images in [0, 1], in 8 bits, by non_local_means(); of three columns red, green and blue the
    lightness and the two colour differences, without the curve of sRGB, are denoised by themselves."""
    eight = px.select(*key, "y", "x", *((F.least(F.greatest(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 255).cast("int").alias(c) for c in columns))
    if len(columns) == 3:
        parts = eight.select(*key, "y", "x", *(c.alias(n) for c, n in zip(lab.to_lab(*map(F.col, columns), curve=False), ("lab_l", "lab_a", "lab_b"))))
        light = non_local_means(parts, key, h, w, strength, ("lab_l",), tile=tile)
        colour = non_local_means(parts, key, h, w, strength, ("lab_a", "lab_b"), tile=tile)
        back = lab.from_lab(F.col("lab_l"), F.col("lab_a"), F.col("lab_b"), curve=False)
        done = light.join(colour, [*key, "y", "x"]).select(*key, "y", "x", *(c.alias(n) for c, n in zip(back, columns)))
    else:
        done = non_local_means(eight, key, h, w, strength, columns, tile=tile)
    return done.select(*key, "y", "x", *((F.col(c) / 255).alias(c) for c in columns))
