"""Smooth backgrounds, blurs with mirrored borders, and masks by weight. Images of one call have one size, h x w."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack.operators import project, robust
from lumenstack.work import materialise

#: Kernels of 1, 3, 5 and 7 taps where no deviation is given.
SMALL = {1: [1.0], 3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625], 7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125]}


def gaussian_kernel(size: int, sigma: float | None = None) -> list[float]:
    """size: odd. Without a deviation: the fixed ones up to 7 taps, else 0.3 ((size - 1) / 2 - 1) + 0.8."""
    if sigma is None and size in SMALL:
        return SMALL[size]
    s = sigma or 0.3 * ((size - 1) / 2 - 1) + 0.8
    k = [math.exp(-(((i - size // 2) / s) ** 2) / 2) for i in range(size)]
    return [x / sum(k) for x in k]


def convolve(px: DataFrame, key: list[str], kernel: list[float], h: int, w: int, mirror: str = "edge once", v: str = "v") -> DataFrame:
    """(key, y, x, v): a symmetric kernel along rows and then columns.

    mirror: what stands beyond a border: "edge once" (c b | a b c: the border sample is not repeated) or "edge twice"
    (b a | a b c). Each sample goes to the cells within reach and, near a border, to those within reach of its mirror
    image; the reach may be up to the side less one.
    """
    reach, more = len(kernel) // 2, 0 if mirror == "edge once" else 1
    taps = F.array(*(F.struct(F.lit(i - reach).alias("d"), F.lit(k).alias("k")) for i, k in enumerate(kernel)))
    out = px.select(*key, "y", "x", F.col(v).alias("v"))
    for axis, other, size in (("x", "y", w), ("y", "x", h)):
        if reach > size - 1 + more:
            raise ValueError("the kernel reaches over the whole image")
        p = F.col(axis)
        images = F.filter(F.array(p, -p - more, 2 * (size - 1) - p + more), lambda q: (q >= -reach) & (q <= size - 1 + reach))
        images = F.array_distinct(images)  # the border sample is its own image if it is not repeated
        sent = out.select(*key, other, "v", F.explode(images).alias("_p")).select(*key, other, "v", "_p", F.explode(taps).alias("_t"))
        sent = sent.withColumn(axis, (F.col("_p") + F.col("_t.d")).cast("int")).where(F.col(axis).between(0, size - 1))
        out = sent.groupBy(*key, other, axis).agg(F.sum(F.col("v") * F.col("_t.k")).alias("v"))
    return out


def blur(px: DataFrame, key: list[str], size: int, h: int, w: int, v: str = "v") -> DataFrame:
    return convolve(px, key, gaussian_kernel(size), h, w, v=v)


def shrink(px: DataFrame, key: list[str], h: int, w: int, small_h: int, small_w: int) -> DataFrame:
    """Each cell of the small image is the mean of the area that it covers; samples on an edge count by their share."""
    out = px.select(*key, "y", "x", "v", F.lit(1.0).alias("_a"))
    for axis, size, small in (("y", h, small_h), ("x", w, small_w)):
        low, high = F.col(axis) * (small / size), (F.col(axis) + 1) * (small / size)
        out = out.withColumns({"_l": low, "_h": high}).withColumn("_c", F.explode(F.sequence(F.floor(low + 1e-9).cast("int"), F.greatest(F.ceil(high - 1e-9) - 1, F.floor(low + 1e-9)).cast("int"))))
        share = F.least(F.col("_h"), F.col("_c") + 1.0) - F.greatest(F.col("_l"), F.col("_c").cast("double"))
        out = out.withColumn("_a", F.col("_a") * share).withColumn(axis, F.col("_c"))
    return out.where("_a > 1e-12").groupBy(*key, "y", "x").agg((F.sum(F.col("v") * F.col("_a")) / F.sum("_a")).alias("v"))


def enlarge(px: DataFrame, key: list[str], h: int, w: int, large_h: int, large_w: int) -> DataFrame:
    """Bilinear, cell centres to cell centres, the border values beyond the outer centres."""
    at = lambda t, small, large: F.least(F.greatest((F.col(t) + 0.5) * (small / large) - 0.5, F.lit(0.0)), F.lit(small - 1.0))
    cells = px.select(*key).distinct() if key else px.select().limit(1)
    cells = cells.withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(large_h - 1)))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(large_w - 1))))
    made = project.reproject_bilinear(px, key, cells.withColumns({"sy": at("ty", h, large_h), "sx": at("tx", w, large_w)}))
    return made.select(*key, F.col("ty").alias("y"), F.col("tx").alias("x"), F.col("value").alias("v"))


@robust.keeps_names("_m", "_s", "_n", "_top")
def smooth_background(px: DataFrame, key: list[str], h: int, w: int, factor: int = 4, weight: str | None = None, least: int = 64) -> DataFrame:
    """(key, y, x, model): samples over median + 3 deviations, masked ones and those without weight become the median;
    then shrunk by the factor, blurred over a quarter of the smaller side, enlarged, and kept between the median
    less 5 deviations and the model's 95th percentile. 0 where an image has under `least` good samples."""
    good = F.col("v").isNotNull() & (F.coalesce(F.col(weight) > 0, F.lit(False)) if weight else F.lit(True))
    kept = F.when(good, F.col("v"))
    stats = px.groupBy(*key).agg(F.median(kept).alias("_m"), F.coalesce(F.stddev_pop(kept), F.lit(0.0)).alias("_s"), F.count(kept).alias("_n"))
    filled = F.when(~good | ((F.col("_s") > 0) & (F.col("v") > F.col("_m") + 3 * F.col("_s"))), F.coalesce("_m", F.lit(0.0))).otherwise(F.col("v"))
    work = px.join(stats, key).select(*key, "y", "x", filled.alias("v"))
    small_h, small_w = max(1, h // factor), max(1, w // factor)
    size = max(3, int(min(small_h, small_w) * 0.25)) | 1
    model = enlarge(blur(shrink(work, key, h, w, small_h, small_w), key, size, small_h, small_w), key, small_h, small_w, h, w)
    top = model.groupBy(*key).agg(F.percentile("v", F.lit(0.95)).alias("_top"))
    low = F.when(F.col("_s") > 0, F.col("_m") - 5 * F.col("_s"))
    value = F.greatest(F.least("v", "_top"), low)
    return model.join(top, key).join(stats, key).select(*key, "y", "x", F.when(F.col("_n") >= least, value).otherwise(0.0).alias("model"))


@robust.keeps_names("model", "_level", "_after")
def interbatch_normalised(px: DataFrame, key: list[str], model: DataFrame) -> DataFrame:
    """px less the model, at its own median level again."""
    level = px.groupBy(*key).agg(F.median("v").alias("_level"))
    flat = px.join(model, [*key, "y", "x"]).withColumn("v", F.col("v") - F.col("model")).drop("model")
    after = flat.groupBy(*key).agg(F.median("v").alias("_after"))
    return flat.join(level, key).join(after, key).withColumn("v", F.col("v") - F.col("_after") + F.col("_level")).drop("_level", "_after")


def matched_to(px: DataFrame, ratio: DataFrame, key: list[str]) -> DataFrame:
    """px times the scale of robust.overlap_ratio(); frames without one are left alone."""
    return px.join(ratio.select(*key, F.col("scale").alias("_f")), key, "left").withColumn("v", F.col("v") * F.coalesce("_f", F.lit(1.0))).drop("_f")


def zone_mesh(px: DataFrame, key: list[str], h: int, w: int, box: int = 128, window: int = 5, sigma: float = 3.0, exclude: float = 98.0, rounds: int = 5) -> DataFrame:
    """(key, y, x, v, s): clipped median and deviation of zones of box x box samples, each then the median of the zones in
    an odd window around it. y and x number the zones.

    The image need not be a multiple of the box: the last zones are cut by its border. Zones that miss (masked, clipped or
    beyond the border) over `exclude` percent of a whole zone's samples are filled from the ten nearest others, weighted by
    the inverse of their distance (of equally near ones the upper, then the left). An image without any zone has no rows.
    """
    from lumenstack.operators.spatial import neighbourhood

    by, bx = min(box, h), min(box, w)
    zone = px.select(*key, "v", F.expr(f"cast(y div {by} as int)").alias("zy"), F.expr(f"cast(x div {bx} as int)").alias("zx"))
    stats = robust.clipped_stats(zone, [*key, "zy", "zx"], sigma, rounds).where(by * bx - F.col("n") <= exclude / 100 * by * bx)
    kept = materialise(stats.select(*key, F.col("zy").alias("y"), F.col("zx").alias("x"), F.col("median").alias("v"), F.col("std").alias("s")))  # read three times
    packed = kept.groupBy(*key).agg(F.collect_list(F.struct("y", "x", "v", "s")).alias("all_zones"))  # an image's zones, not its samples
    grid = packed.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(-(-h // by) - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(-(-w // bx) - 1))))
    away = lambda z: F.pow(z["y"] - F.col("y"), F.lit(2)) + F.pow(z["x"] - F.col("x"), F.lit(2))
    near = F.slice(F.array_sort(F.transform("all_zones", lambda z: F.struct(away(z).alias("d"), z["y"].alias("y"), z["x"].alias("x"), z["v"].alias("v"), z["s"].alias("s")))), 1, 10)
    total = lambda f: F.aggregate("near", F.lit(0.0), lambda a, z: a + f(z) / F.sqrt(z["d"]))
    missing = grid.join(kept.select(*key, "y", "x"), [*key, "y", "x"], "left_anti").withColumn("near", near)
    filled = missing.select(*key, "y", "x", *((total(lambda z, c=c: z[c]) / total(lambda z: F.lit(1.0))).alias(c) for c in "vs"))
    mesh = kept.unionByName(filled).withColumn("v", F.struct("v", "s")).drop("s")
    return materialise(neighbourhood(mesh, key, window | 1).groupBy(*key, "y", "x").agg(F.median("nv.v").alias("v"), F.median("nv.s").alias("s")))


def spline_coefficients(values: Column, n: int) -> Column:
    """Coefficients of the cubic B-spline through n values, mirrored about the outer edges of the end cells.

    The system has 1 beside a diagonal of 4 (5 at both ends, 6 for a single value) and 6 times the values at its right; it
    is solved by a forward and a backward fold, whose factors depend on n alone.
    """
    factors: list[float] = []
    for i in range(n):
        diagonal = 4 + (i == 0) + (i == n - 1)
        factors.append(1 / (diagonal - (factors[-1] if factors else 0.0)))
    c = F.array(*map(F.lit, factors))
    before = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))
    none = F.array().cast("array<double>")
    forward = F.aggregate(F.sequence(F.lit(1), F.lit(n)), none, lambda acc, i: F.concat(acc, F.array((6 * F.element_at(values, i) - before(acc)) * F.element_at(c, i))))
    pairs = F.reverse(F.arrays_zip(forward.alias("d"), c.alias("c")))
    return F.reverse(F.aggregate(pairs, none, lambda acc, p: F.concat(acc, F.array(p["d"] - p["c"] * before(acc)))))


def spline_weights(t: Column) -> list[Column]:
    """Weights of the four coefficients around a place, t beyond the second of them."""
    u = 1 - t
    return [u * u * u / 6, (3 * t * t * t - 6 * t * t + 4) / 6, (3 * u * u * u - 6 * u * u + 4) / 6, t * t * t / 6]


def spline_surface(mesh: DataFrame, key: list[str], column: str, h: int, w: int, box: int) -> DataFrame:
    """(key, y, x, column) for each pixel of an h x w image: the bicubic spline through the zones' values at their centres, kept
    within their range.

    Mesh rows and then mesh columns are solved as arrays. Each image row gets a value a mesh column, and the four values
    around each gap between two columns' centres then make the pixels of that gap.
    """
    by, bx = min(box, h), min(box, w)
    ny, nx = -(-h // by), -(-w // bx)
    mirrored = lambda i, n: F.when(F.pmod(i, F.lit(2 * n)) < n, F.pmod(i, F.lit(2 * n))).otherwise(2 * n - 1 - F.pmod(i, F.lit(2 * n))).cast("int")
    ends = mesh.groupBy(*key).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    part = mesh.select(*key, "y", "x", F.col(column).alias("c"))
    for along, other, n in (("x", "y", nx), ("y", "x", ny)):
        line = part.groupBy(*key, other).agg(F.array_sort(F.collect_list(F.struct(along, "c"))).alias("line"))
        part = line.select(*key, other, F.posexplode(spline_coefficients(F.col("line.c"), n)).alias(along, "c"))
    place = lambda p, size: (p + 0.5) / size - 0.5
    gap = F.floor(place(F.col("row"), by))
    taps = F.array(*(F.struct(mirrored(gap + k - 1, ny).alias("y"), weight.alias("k")) for k, weight in enumerate(spline_weights(place(F.col("row"), by) - gap))))
    rows = mesh.sparkSession.range(h).select(F.col("id").cast("int").alias("row")).withColumn("tap", F.explode(taps)).select("row", "tap.y", "tap.k")
    across = part.join(rows, "y").groupBy(*key, "row", "x").agg(F.sum(F.col("c") * F.col("k")).alias("c"))
    lines = across.groupBy(*key, "row").agg(F.array_sort(F.collect_list(F.struct("x", "c"))).alias("line")).select(*key, "row", F.col("line.c").alias("line"))
    gaps = lines.withColumn("gap", F.explode(F.sequence(F.lit(-1), F.lit(nx - 1))))
    four = gaps.select(*key, "row", "gap", *(F.element_at("line", mirrored(F.col("gap") + k - 1, nx) + 1).alias(f"c{k}") for k in range(4))).join(ends, key)
    low, high = F.greatest(F.ceil((F.col("gap") + 0.5) * bx - 0.5), F.lit(0)), F.least(F.ceil((F.col("gap") + 1.5) * bx - 0.5) - 1, F.lit(w - 1))
    cells = four.where(low <= high).withColumn("x", F.explode(F.sequence(low, high).cast("array<int>")))
    weights = spline_weights(place(F.col("x"), bx) - F.col("gap"))
    value = sum((F.col(f"c{k}") * weight for k, weight in enumerate(weights)), F.lit(0.0))
    return cells.select(*key, F.col("row").alias("y"), "x", F.least(F.greatest(value, F.col("lo")), F.col("hi")).alias(column))


def mesh_background(px: DataFrame, key: list[str], h: int, w: int, box: int = 128, window: int = 5, sigma: float = 3.0, exclude: float = 98.0, splines: bool = True) -> DataFrame:
    """(key, y, x, model): the surface through zone_mesh(), by splines or bilinear, for images of any size."""
    mesh = zone_mesh(px, key, h, w, box, window, sigma, exclude)
    if splines:
        return spline_surface(mesh, key, "v", h, w, box).withColumnRenamed("v", "model")
    by, bx = min(box, h), min(box, w)
    ny, nx = -(-h // by), -(-w // bx)
    return enlarge(mesh.drop("s"), key, ny, nx, ny * by, nx * bx).where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1)).withColumnRenamed("v", "model")


def without_background(px: DataFrame, key: list[str], h: int, w: int, box: int = 128, window: int = 5, sigma: float = 3.0, exclude: float = 98.0) -> DataFrame:
    """px less its mesh background; samples of images without a model stay as they are. key: the image, its channel with it."""
    (level,) = robust.free_names(px, ("model",))
    model = mesh_background(px, key, h, w, box, window, sigma, exclude).withColumnRenamed("model", level)
    return px.join(model, [*key, "y", "x"], "left").withColumn("v", F.col("v") - F.coalesce(level, F.lit(0.0))).drop(level)


@robust.keeps_names("_b", "_f", "_g")
def feather(px: DataFrame, key: list[str], h: int, w: int, weight: str = "w", reach: int = 256, eps: float = 1e-6, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """v times the blurred gain of blurred weight over weight (its first percentile at least), the gain within
    [low, high] and v within [0, 1]."""
    size = max(1, reach) // 2 * 2 + 1
    wide = blur(px, key, size, h, w, v=weight).withColumnRenamed("v", "_b")
    floor = px.groupBy(*key).agg(F.greatest(F.percentile(F.when(F.col(weight) > eps, F.col(weight)), F.lit(0.01)), F.lit(10 * eps)).alias("_f"))
    gain = F.least(F.greatest(F.col("_b") / F.greatest(F.col(weight), F.col("_f")), F.lit(low)), F.lit(high))
    gains = px.join(wide, [*key, "y", "x"]).join(floor, key).select(*key, "y", "x", gain.alias("v"))
    smooth = blur(gains, key, size, h, w).withColumnRenamed("v", "_g")
    return px.join(smooth, [*key, "y", "x"]).withColumn("v", F.least(F.greatest(F.col("v") * F.col("_g"), F.lit(0.0)), F.lit(1.0))).drop("_g")


@robust.keeps_names("_p", "_t", "_fill", "_on", "_share", "_soft", "_new", "_span")
def low_weight_blend(px: DataFrame, key: list[str], h: int, w: int, weight: str = "w", percent: float = 0.1, reach: int = 128, floor: float = 1e-5, most: float = 0.5, dynamic: float = 0.05) -> DataFrame:
    """Where the weight is low, the image fades into its median: the threshold is the lesser of a percentile and the
    median of positive weights. An image of which over `most` would be masked, or that would lose its dynamic, is
    left as it is; `masked` says which."""
    positive = F.when(F.col(weight) > floor, F.col(weight))
    stats = px.groupBy(*key).agg(F.percentile(positive, F.array(F.lit(percent), F.lit(0.5))).alias("_p"), F.median("v").alias("_fill"))
    stats = stats.select(*key, F.greatest(F.least(F.col("_p")[0], F.col("_p")[1]), F.lit(floor)).alias("_t"), "_fill")
    held = px.join(stats, key).withColumn("_on", F.coalesce((F.col(weight) > F.col("_t")).cast("double"), F.lit(1.0)))
    share = held.groupBy(*key).agg((1 - F.avg("_on")).alias("_share"))
    soft = blur(held, key, max(1, reach // 2) * 2 + 1, h, w, v="_on").withColumnRenamed("v", "_soft")
    both = held.join(soft, [*key, "y", "x"]).join(share, key)
    blend = F.least(F.greatest(F.col("v") * F.col("_soft") + F.col("_fill") * (1 - F.col("_soft")), F.lit(0.0)), F.lit(1.0))
    both = both.withColumn("_new", blend)
    span = both.groupBy(*key).agg((F.max("_new") - F.min("_new")).alias("_span"))
    done = both.join(span, key).withColumn("masked", F.col("_t").isNotNull() & (F.col("_share") <= most) & (F.col("_span") >= dynamic))
    return done.withColumn("v", F.when(F.col("masked"), F.col("_new")).otherwise(F.col("v"))).drop("_t", "_fill", "_on", "_share", "_soft", "_new", "_span")


@robust.keeps_names("_b", "_top")
def coverage_masked(px: DataFrame, key: list[str], h: int, w: int, threshold: float, weight: str = "w", sigma: float = 3.0) -> DataFrame:
    """v is 0 where the blurred mean weight of the channels is under the threshold's share of its greatest."""
    side = min(h, w)
    s = max(1.0, side / 8) if side <= 4 * sigma else sigma
    reach = int(4 * s + 0.5)
    mean = px.groupBy(*key, "y", "x").agg(F.avg(F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0))).alias("v"))
    smooth = convolve(mean, key, gaussian_kernel(2 * reach + 1, s), h, w, "edge twice").withColumnRenamed("v", "_b")
    top = smooth.groupBy(*key).agg(F.max("_b").alias("_top"))
    off = (F.col("_top") > 1e-9) & (F.col("_b") < threshold * F.col("_top"))
    return px.join(smooth, [*key, "y", "x"]).join(top, key).withColumn("v", F.when(off, 0.0).otherwise(F.col("v"))).drop("_b", "_top")


def soft_edge_mask(px: DataFrame, key: list[str], h: int, w: int, border: int, sigma: float) -> DataFrame:
    """(key, y, x, mask): distance to the nearest border over the border's width, up to 1, blurred."""
    from lumenstack.operators.spatial import edge_mask

    hard = px.select(*key, "y", "x", edge_mask(F.col("y"), F.col("x"), h, w, border).alias("v"))
    reach = int(4 * sigma + 0.5)
    return convolve(hard, key, gaussian_kernel(2 * reach + 1, sigma), h, w, "edge twice").withColumnRenamed("v", "mask")


def luminance_valid(red: Column, green: Column, blue: Column, threshold: float) -> Column:
    """1 where the original image's luminance is over the threshold, else 0."""
    return F.when(0.299 * red + 0.587 * green + 0.114 * blue > threshold, 1.0).otherwise(0.0)
