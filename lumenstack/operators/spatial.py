"""Neighbourhood and display operators on pixel tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstack.operators import tiles


def neighbourhood(px: DataFrame, key: list[str], size: int, mirror: bool = False) -> DataFrame:
    """(key, y, x, v, nv, oy, ox): each sample with the samples of the size x size box around it, itself among them, and
    how far off they are.

    Each sample is sent to the size^2 boxes that it is in: a bounded explosion and one equi-join, for small boxes; see
    hot_pixels() for larger ones. Borders see what is inside the image; mirror: also its mirror image, without the
    border row itself.
    """
    half = size // 2
    reach = [F.lit(d) for d in range(-half, half + 1)]
    sent = px.select(*key, F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("v").alias("nv"))
    if mirror:
        sent = sent.join(px.groupBy(*key).agg(F.max("y").alias("_ty"), F.max("x").alias("_tx")), key)
        for axis in "yx":
            p, top = F.col(f"_{axis}"), F.col(f"_t{axis}")
            sent = sent.withColumn(f"_{axis}", F.explode(F.array_distinct(F.filter(F.array(p, -p, 2 * top - p), lambda q: (q >= -half) & (q <= top + half)))))
    sent = sent.withColumn("_dy", F.explode(F.array(*reach))).withColumn("_dx", F.explode(F.array(*reach)))
    sent = sent.select(*key, (F.col("_y") + F.col("_dy")).alias("y"), (F.col("_x") + F.col("_dx")).alias("x"), "nv", (-F.col("_dy")).alias("oy"), (-F.col("_dx")).alias("ox"))
    return px.join(sent, [*key, "y", "x"])


def box_statistics(rows: pa.Array, row: pa.Array, height: pa.Array, size: int) -> pa.Array:
    """For packed rows (y, xs, vs) around a row of each image: of each of its cells the box median, the border samples
    repeated beyond it, and the box mean and mean square, mirrored beyond it without the border samples."""
    half, flat = size // 2, rows.flatten()
    ys, xs, vs = flat.field("y").to_numpy(), flat.field("xs"), flat.field("vs")
    cuts = np.concatenate([[0], np.cumsum(xs.value_lengths().to_numpy())])
    x, v = xs.flatten().to_numpy(), vs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    groups = np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy())])
    out = []
    for g, (a, b) in enumerate(zip(groups[:-1], groups[1:])):
        at, h = row[g].as_py(), height[g].as_py()
        width = int(x[cuts[a] : cuts[b]].max()) + 1
        image = {int(ys[r]): r for r in range(a, b)}

        def line(y: int) -> np.ndarray:
            values = np.full(width, np.nan)
            if y in image:
                r = image[y]
                values[x[cuts[r] : cuts[r + 1]]] = v[cuts[r] : cuts[r + 1]]
            return values

        places = np.arange(at - half, at + half + 1)
        repeated = np.pad(np.array([line(y) for y in np.clip(places, 0, h - 1).tolist()]), ((0, 0), (half, half)), "edge")
        turned = np.where(places < 0, -places, np.where(places > h - 1, 2 * (h - 1) - places, places))
        mirrored = np.pad(np.array([line(y) for y in turned.tolist()]), ((0, 0), (half, half)), "reflect" if width > half else "edge")
        boxes = np.lib.stride_tricks.sliding_window_view(repeated, size, axis=1).transpose(1, 0, 2).reshape(width, -1)
        means = np.lib.stride_tricks.sliding_window_view(mirrored, size, axis=1).transpose(1, 0, 2).reshape(width, -1)
        r = image[at]
        own = x[cuts[r] : cuts[r + 1]]
        out.append((own, v[cuts[r] : cuts[r + 1]], np.nanmedian(boxes, axis=1)[own], np.nanmean(means, axis=1)[own], np.nanmean(means * means, axis=1)[own]))
    ends = pa.array(np.cumsum([0, *(len(o[0]) for o in out)], dtype=np.int32))
    join = lambda i, kind: pa.array(np.concatenate([o[i] for o in out]) if out else [], kind, from_pandas=i > 0)
    cells = pa.StructArray.from_arrays([join(0, pa.int32()), *(join(i, pa.float64()) for i in range(1, 5))], ["x", "v", "med", "m", "m2"])
    return pa.ListArray.from_arrays(ends, cells)


def hot_pixels(px: DataFrame, key: list[str], threshold: float = 3.0, size: int = 5, whole_numbers: bool = False) -> DataFrame:
    """A sample over the box median by `threshold` box deviations (1e-5 at least, 1 for whole numbers) becomes the median.

    The size is made odd and 3 at least. Image rows are packed and each is sent to the `size` rows around it, not each
    sample to size^2 boxes; borders are as in box_statistics().
    """
    size = max(3, size | 1)
    half = size // 2
    packed = px.groupBy(*key, "y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("c"))
    packed = packed.select(*key, "y", F.struct("y", F.col("c.x").alias("xs"), F.col("c.v").alias("vs")).alias("r"))
    height = packed.groupBy(*key).agg((F.max("y") + 1).alias("h"))
    sent = packed.join(height, key).withColumn("d", F.explode(F.array(*map(F.lit, range(-half, half + 1))))).withColumn("t", F.col("y") + F.col("d")).where("t between 0 and h - 1")
    around = sent.groupBy(*key, "t", "h").agg(F.collect_list("r").alias("rows")).join(packed.select(*key, F.col("y").alias("t")), [*key, "t"], "left_semi")

    def run(rows: pa.Array, row: pa.Array, height: pa.Array) -> pa.Array:
        return box_statistics(rows, row, height, size)

    made = F.arrow_udf(run, "array<struct<x:int,v:double,med:double,m:double,m2:double>>")("rows", "t", "h")
    box = around.select(*key, F.col("t").alias("y"), F.explode(made).alias("b")).select(*key, "y", "b.*")
    std = F.greatest(F.sqrt(F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(1e-10))), F.lit(1.0 if whole_numbers else 1e-5))
    hot = F.col("v") > F.col("med") + threshold * std
    return box.select(*key, "y", "x", F.when(hot, F.col("med")).otherwise(F.col("v")).alias("v"), F.coalesce(hot, F.lit(False)).alias("hot"))


def downsample(px: DataFrame, key: list[str], factor: int = 2) -> DataFrame:
    """Mean of whole factor x factor boxes."""
    cells = px.groupBy(*key, F.expr(f"cast(y div {factor} as int)").alias("y"), F.expr(f"cast(x div {factor} as int)").alias("x"))
    return cells.agg(F.avg("v").alias("v"))


def edge_crop(px: DataFrame, h: int, w: int, fraction: float) -> DataFrame:
    """Cuts int(fraction * side) from each side and shifts; a cut that leaves nothing changes nothing."""
    dy, dx = int(h * fraction), int(w * fraction)
    if 2 * dy >= h or 2 * dx >= w:
        return px
    return px.where(F.col("y").between(dy, h - dy - 1) & F.col("x").between(dx, w - dx - 1)).withColumns({"y": F.col("y") - dy, "x": F.col("x") - dx})


def crop_to_coverage(px: DataFrame, group: list[str], weight: str = "w") -> DataFrame:
    """The bounding box of positive coverage, shifted to the origin; dy and dx are what CRPIX loses."""
    box = px.where(F.col(weight) > 0).groupBy(*group).agg(*(f(c).alias(f"_{c}{n}") for c in "yx" for n, f in enumerate((F.min, F.max))))
    inside = px.join(box, group).where("y between _y0 and _y1 and x between _x0 and _x1")
    return inside.withColumns({"y": F.col("y") - F.col("_y0"), "x": F.col("x") - F.col("_x0"), "dy": F.col("_y0"), "dx": F.col("_x0")}).drop("_y0", "_y1", "_x0", "_x1")


def low_weight_threshold(px: DataFrame, group: list[str], weight: str = "w", floor: float = 0.0) -> DataFrame:
    """min(10th percentile, median) of positive weights, not under the floor."""
    p = F.percentile(F.when(F.col(weight) > 0, F.col(weight)), F.array(F.lit(0.1), F.lit(0.5)))
    return px.groupBy(*group).agg(p.alias("p")).select(*group, F.greatest(F.least(F.col("p")[0], F.col("p")[1]), F.lit(floor)).alias("threshold"))


def edge_mask(y: Column, x: Column, h: int, w: int, border: int) -> Column:
    """Distance to the nearest border over the border's width, up to 1."""
    return F.least(F.least(y, h - 1 - y, x, w - 1 - x) / F.lit(float(border)), F.lit(1.0))


def gaussian(px: DataFrame, key: list[str], sigma: float, radius: int | None = None) -> DataFrame:
    """Separable blur, kernel cut at `radius` (3 sigma) and renormalised at borders: an explosion of 2 radius + 1
    and a sum along each axis."""
    import math

    radius = radius or max(1, math.ceil(3 * sigma))
    kernel = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(math.exp(-d * d / (2 * sigma * sigma))).alias("k")) for d in range(-radius, radius + 1)))
    for axis, other in (("x", "y"), ("y", "x")):
        top = px.groupBy(*key).agg(F.max(axis).alias("_top"))
        sent = px.select(*key, other, axis, "v", F.explode(kernel).alias("k")).join(top, key)
        sent = sent.withColumn(axis, F.col(axis) + F.col("k.d")).where(f"{axis} between 0 and _top")
        px = sent.groupBy(*key, other, axis).agg((F.sum(F.col("v") * F.col("k.k")) / F.sum("k.k")).alias("v"))
    return px


def debayer_bilinear(px: DataFrame, key: list[str], pattern: str = "GRBG") -> DataFrame:
    """A mosaic to three channels: each colour is the mean of its samples in the 3 x 3 box around a pixel, or the
    pixel's own sample."""
    colours = F.array(*map(F.lit, pattern))
    colour = lambda y, x: F.element_at(colours, (2 * (y % 2) + x % 2 + 1).cast("int"))
    marked = px.withColumn("c", colour(F.col("y"), F.col("x")))
    sent = neighbourhood(marked.withColumn("v", F.struct("v", "c")).drop("c"), key, 3)
    grouped = sent.groupBy(*key, "y", "x", F.col("nv.c").alias("c")).agg(F.avg("nv.v").alias("around"), F.first(F.col("v")).alias("own"))
    return grouped.select(*key, "y", "x", "c", F.when(F.col("own.c") == F.col("c"), F.col("own.v")).otherwise(F.col("around")).alias("v"))


#: The 5 x 5 filters of gradient-corrected demosaicing (Malvar, He and Cutler, 2004), in eighths: green at a
#: red or blue pixel, a colour at a green pixel along its row and along its column, and red at blue or blue at red.
MALVAR = {
    "green": ((0, 0, -1, 0, 0), (0, 0, 2, 0, 0), (-1, 2, 4, 2, -1), (0, 0, 2, 0, 0), (0, 0, -1, 0, 0)),
    "row": ((0, 0, 0.5, 0, 0), (0, -1, 0, -1, 0), (-1, 4, 5, 4, -1), (0, -1, 0, -1, 0), (0, 0, 0.5, 0, 0)),
    "column": ((0, 0, -1, 0, 0), (0, -1, 4, -1, 0), (0.5, 0, 5, 0, 0.5), (0, -1, 4, -1, 0), (0, 0, -1, 0, 0)),
    "other": ((0, 0, -1.5, 0, 0), (0, 2, 0, 2, 0), (-1.5, 0, 6, 0, -1.5), (0, 2, 0, 2, 0), (0, 0, -1.5, 0, 0)),
}


def malvar_block(block: np.ndarray) -> dict[str, np.ndarray]:
    """What each filter gives for blocks with a border of two."""
    h, w = block.shape[1] - 4, block.shape[2] - 4
    return {name: sum(c / 8 * block[:, i : i + h, j : j + w] for i, row in enumerate(m) for j, c in enumerate(row) if c) for name, m in MALVAR.items()}


def debayer_malvar(px: DataFrame, key: list[str], pattern: str = "GRBG", tile: int = 64) -> DataFrame:
    """(key, y, x, r, g, b) of a mosaic by gradient-corrected filters, borders mirrored; missing samples add nothing, repeated ones
    are one of them.

    Each sample is sent to the tiles that it is in or borders on, and each tile gets its image's last row and column, so that a tile
    is worked on by itself. tile: side of the squares worked on at once; the result does not depend on it.
    """
    place = (2 * (F.col("y") % 2) + F.col("x") % 2 + 1).cast("int")
    own = F.element_at(F.array(*map(F.lit, pattern)), place)
    along = F.element_at(F.array(*(F.lit(pattern[i ^ 1]) for i in range(4))), place)  # the other colour of the pixel's row
    names = [f"k{i}" for i in range(len(key))]
    rows = px.select(*(F.col(k).alias(n) for k, n in zip(key, names)), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v")).dropna(subset=[*names, "y", "x"])
    far = F.lit((1 << 31) // tile).cast("long")
    sent = rows.withColumn("ty", F.explode(tiles.reached(F.col("y"), tile, 2, far))).withColumn("tx", F.explode(tiles.reached(F.col("x"), tile, 2, far)))
    ends = rows.groupBy(*names).agg(F.max("y").alias("y"), F.max("x").alias("x"), F.lit(None).cast("double").alias("v"))
    ends = ends.withColumn("ty", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"y div {tile}")))).withColumn("tx", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"x div {tile}"))))
    cut, call = tiles.dealt(sent.withColumn("last", F.lit(False)).unionByName(ends.withColumn("last", F.lit(True))), [*names, "ty", "tx"])
    kinds = dict(rows.dtypes)

    def mirrored(block: np.ndarray, start: np.ndarray, top: np.ndarray, axis: int) -> np.ndarray:
        """Places beyond an image's ends get the sample on the other side, if there is one."""
        at = start[:, None] + np.arange(-2, block.shape[axis] - 2)
        source = np.where(at < 0, -at, np.where(at > top[:, None], 2 * top[:, None] - at, at))
        local = source - start[:, None] + 2
        good = (source >= 0) & (source <= top[:, None]) & (at <= top[:, None] + 2) & (local >= 0) & (local < block.shape[axis])
        shape = (*good.shape, 1) if axis == 1 else (len(good), 1, good.shape[1])
        return np.where(good.reshape(shape), np.take_along_axis(block, np.where(good, local, 0).reshape(shape), axis), 0)

    def run(table: pa.Table) -> pa.Table:
        ly, lx = (table[c].to_numpy() - table[t].to_numpy() * tile + 2 for c, t in (("y", "ty"), ("x", "tx")))
        h, w = (min(tile + 4, int(np.where(table["last"].to_numpy(), 0, l).max(initial=0)) + 3) for l in (ly, lx))
        done = []
        for some, number, heads in tiles.split(table, [*names, "ty", "tx"], h * w):
            last, v = some["last"].to_numpy(), some["v"].to_numpy()
            y, x, y0, x0 = (some[c].to_numpy().astype(np.int64) for c in ("y", "x", "ty", "tx"))
            y0, x0 = y0 * tile, x0 * tile
            top = np.full((2, len(heads)), -1)
            top[:, number[last]] = y[last], x[last]
            block, held, there = np.zeros((len(heads), h, w)), np.zeros((len(heads), h, w), bool), np.zeros((len(heads), h, w), bool)
            put = (number[~last], (y - y0 + 2)[~last], (x - x0 + 2)[~last])
            block[put], there[put], held[put] = np.nan_to_num(v[~last]), True, ~np.isnan(v[~last])
            inner = (slice(None), slice(2, h - 2), slice(2, w - 2))
            t, oy, ox = np.nonzero(there[inner])
            mine, known = block[inner][t, oy, ox], held[inner][t, oy, ox]
            for axis, start in ((1, y0[heads]), (2, x0[heads])):
                block, held = mirrored(block, start, top[axis - 1], axis), mirrored(held, start, top[axis - 1], axis)
            seen = sum(held[:, i : i + h - 4, j : j + w - 4].astype(np.int8) for i in range(5) for j in range(5))[t, oy, ox] > 0
            made = {name: pa.array(m[t, oy, ox], mask=~seen) for name, m in malvar_block(block).items()}
            keys = {n: some[n].combine_chunks().take(pa.array(heads[t])) for n in names}
            done.append(pa.table(keys | {"y": (y0[heads][t] + oy).astype(np.int32), "x": (x0[heads][t] + ox).astype(np.int32), "own": pa.array(mine, mask=~known)} | made))
        return pa.concat_tables(done)

    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "y int", "x int", "own double", *(f"{n} double" for n in MALVAR)])
    sums = cut.groupBy(call).applyInArrow(run, schema)
    pick = lambda colour: F.when(own == colour, F.col("own")).when(own == "G", F.when(along == colour, F.col("row")).otherwise(F.col("column"))).otherwise(F.col("other"))
    return sums.select(*(F.col(n).alias(k) for n, k in zip(names, key)), "y", "x", pick("R").alias("r"), F.when(own == "G", F.col("own")).otherwise(F.col("green")).alias("g"), pick("B").alias("b"))


def star_mask(stars: DataFrame, frame: list[str], grow: int = 2) -> DataFrame:
    """(frame, y, x): cells within `grow` steps of a star's centre, as a cross dilated so often."""
    steps = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-grow, grow + 1) for b in range(-grow, grow + 1) if abs(a) + abs(b) <= grow]
    at = stars.select(*frame, F.round("sy").cast("int").alias("cy"), F.round("sx").cast("int").alias("cx"), F.explode(F.array(*steps)).alias("d"))
    return at.select(*frame, (F.col("cy") + F.col("d.a")).alias("y"), (F.col("cx") + F.col("d.b")).alias("x")).where("y >= 0 and x >= 0").distinct()


def moving_average(values: Column, alpha: float = 0.1) -> Column:
    """Exponential moving average of an ordered array; it starts at the first value."""
    return F.aggregate(F.slice(values, 2, 1_000_000_000), F.element_at(values, 1).cast("double"), lambda a, x: (1 - alpha) * a + alpha * x)


def histogram(df: DataFrame, group: list[str], value: str, bins: int = 256) -> DataFrame:
    """Counts in `bins` equal bins from the least to the greatest value (its edge raised by a thousandth of the
    range), empty bins included; tiny negatives (over -1e-5) count as 0."""
    v = F.when((F.col(value) < 0) & (F.col(value) > -1e-5), 0.0).otherwise(F.col(value).cast("double"))
    finite = df.select(*group, v.alias("v")).where("v is not null and not isnan(v)")
    ends = finite.groupBy(*group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = F.greatest((F.col("hi") - F.col("lo")) * 1.001, F.lit(1e-12))
    counts = finite.join(ends, group).groupBy(*group, F.floor((F.col("v") - F.col("lo")) / width * bins).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select(*group, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, [*group, "bin"], "left").select(*group, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def mode_bin(hist: DataFrame, group: list[str]) -> DataFrame:
    """The fullest bin, the lowest on ties."""
    best = hist.groupBy(*group).agg(F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("m"))
    return best.select(*group, (-F.col("m.b")).alias("bin"), F.col("m.n").alias("n"))


def levels(px: DataFrame, group: list[str], low: float = 0.01, high: float = 0.99, apart: float = 1e-4) -> DataFrame:
    """Black and white points: two percentiles, `apart` at least."""
    p = px.groupBy(*group).agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("p"))
    return p.select(*group, F.col("p")[0].alias("black"), F.greatest(F.col("p")[1], F.col("p")[0] + apart).alias("white"))


def zones(px: DataFrame, key: list[str], size: int) -> DataFrame:
    """Median and deviation of size x size zones."""
    z = px.groupBy(*key, F.expr(f"cast(y div {size} as int)").alias("zy"), F.expr(f"cast(x div {size} as int)").alias("zx"))
    return z.agg(F.median("v").alias("median"), F.stddev_pop("v").alias("std"), F.count("v").alias("n"))


def running_average(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Mean of all samples so far in order."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("average", F.avg(value).over(w)).withColumn("frames", F.count(value).over(w))
