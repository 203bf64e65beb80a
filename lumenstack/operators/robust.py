"""Robust statistics by frame or region, backgrounds, quality, weights and normalisation."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstack.work import forget, materialise

LUMINANCE = (0.299, 0.587, 0.114)
#: Samples of a group from which on its exact median is found in a bracket; this changes the work, never the median.
LARGE = 100_000


def free_names(df: DataFrame, wishes: tuple[str, ...]) -> list[str]:
    """Each wish, with underscores before it as long as df has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for wish in wishes:
        while wish.lower() in taken:
            wish = "_" + wish
        out.append(wish)
    return out


def keeps_names(*inner: str):
    """For an operator whose first argument is a table that it returns with all its columns: columns that are named like
    one of its own steps' go by other names while it runs. Keys are not renamed."""

    def of(operator):
        @functools.wraps(operator)
        def run(px: DataFrame, key: list[str], *args, **kwargs) -> DataFrame:
            taken = [c for c in px.columns if c.lower() in {n.lower() for n in inner} and c not in key]
            away = dict(zip(taken, free_names(px, tuple(f"own_{c}" for c in taken))))
            moved = lambda a: away.get(a, a) if isinstance(a, str) else a
            out = operator(px.withColumnsRenamed(away), key, *map(moved, args), **{k: moved(a) for k, a in kwargs.items()})
            return out.withColumnsRenamed({b: a for a, b in away.items()})

        return run

    return of


def any_key(operator):
    """For an operator on (px, key, ...) whose own steps have names that a key may have: keys go by numbers while it runs."""

    @functools.wraps(operator)
    def run(px: DataFrame, key: list[str], *args, **kwargs) -> DataFrame:
        names = dict(zip(key, (f"key_{i}_of_px" for i in range(len(key)))))
        out = operator(px.withColumnsRenamed(names), list(names.values()), *args, **kwargs)
        return out.withColumnsRenamed({b: a for a, b in names.items()})

    return run


def is_large(px: DataFrame, key: list[str]) -> bool:
    """Whether a group has more samples than one task should hold; one number to the driver."""
    sizes = px.groupBy(*key).agg(F.count("v").alias("n"))
    return (sizes.agg(F.max("n")).first()[0] or 0) > LARGE


def group_stats(px: DataFrame, key: list[str], large: bool) -> DataFrame:
    """(key, mean, median, std, n), the deviation that of a population. An exact median keeps the distinct values of a group in one
    task; large: only those in a bracket around it, as the values outside count as the bracket's ends. The bracket comes from
    approximate percentiles, and the numbers of values on its sides say whether the median is inside; where it is not,
    all values are kept.
    """
    low, high = free_names(px, ("_low", "_high"))
    stats = lambda rows, v: rows.groupBy(*key).agg(F.avg("v").alias("mean"), F.median(v).alias("median"), F.stddev_pop("v").alias("std"), F.count("v").alias("n"), F.count_if(F.col("v") < F.col(low)).alias(low), F.count_if(F.col("v") > F.col(high)).alias(high))
    names = [*key, "mean", "median", "std", "n"]
    if not large:
        return stats(px.withColumns({low: F.lit(None).cast("double"), high: F.lit(None).cast("double")}), F.col("v")).select(*names)
    ends = px.groupBy(*key).agg(F.percentile_approx("v", F.array(F.lit(0.49), F.lit(0.51)), 2000).alias(low))
    ends = materialise(ends.select(*key, F.col(low)[0].alias(low), F.col(low)[1].alias(high)))
    found = materialise(stats(px.join(ends, key), F.least(F.greatest("v", low), high)))
    inside = (2 * F.col(low) < F.col("n")) & (2 * F.col(high) < F.col("n"))
    missed = found.where(~inside).select(*key)
    if missed.isEmpty():
        return found.select(*names)
    again = group_stats(px.join(missed, key, "left_semi"), key, False)
    return found.where(inside).select(*names).unionByName(again)


def clipped(px: DataFrame, key: list[str], sigma: float = 3.0, rounds: int = 5, large: bool | None = None) -> DataFrame:
    """px without what iterated clipping about the median (population deviation) drops.

    Each round is an aggregation by key of what the rounds before it left; their medians and deviations are joined back,
    so no frame is buffered whole. large: as in group_stats(), by default if a group is; a round's statistics are then written,
    so that the join back sends them, and not the samples, to all tasks.
    """
    steps, limits = free_names(px, ("_steps", "_limit"))
    px = px.where(F.col("v").isNotNull())
    large = is_large(px, key) if large is None else large
    passes = F.forall(steps, lambda l: F.abs(F.col("v") - l["m"]) <= sigma * l["s"])
    found = None
    for _ in range(rounds):
        inside = px if found is None else px.join(found, key).where(passes)
        limit = F.struct(F.col("median").alias("m"), F.col("std").alias("s"))
        if large:
            own = group_stats(inside.select(*key, "v"), key, True).select(*key, limit.alias(limits))
            own = own.select(*key, F.array(limits).alias(steps)) if found is None else own.join(found, key).select(*key, F.concat(F.col(steps), F.array(limits)).alias(steps))
            found = materialise(own)
            continue
        before = F.array().cast("array<struct<m:double,s:double>>") if found is None else F.first(steps)
        own = inside.groupBy(*key).agg(before.alias(steps), F.struct(F.median("v").alias("m"), F.stddev_pop("v").alias("s")).alias(limits))
        found = own.select(*key, F.concat(F.col(steps), F.array(limits)).alias(steps))
    return px if found is None else px.join(found, key).where(passes).drop(steps)


def clipped_stats(px: DataFrame, key: list[str], sigma: float = 3.0, rounds: int = 5) -> DataFrame:
    """Mean, median and population deviation after clipping."""
    large = is_large(px, key)
    return group_stats(clipped(px, key, sigma, rounds, large).select(*key, "v"), key, large)


def subtract_sky(px: DataFrame, key: list[str], least: int = 1024) -> DataFrame:
    """px less its clipped median; frames of fewer than `least` samples are left alone."""
    n, level = free_names(px, ("_n", "_sky"))
    sizes = px.groupBy(*key).agg(F.count("v").alias(n))
    sky = clipped_stats(px, key).select(*key, F.col("median").alias(level))
    shift = F.when(F.col(n) >= least, F.coalesce(level, F.lit(0.0))).otherwise(0.0)
    return px.join(sizes, key).join(sky, key, "left").withColumn("v", F.col("v") - shift).drop(n, level)


def deviation(px: DataFrame, key: list[str]) -> DataFrame:
    """(key, med, mad, n): median and raw median absolute deviation."""
    (m,) = free_names(px, ("_med",))
    med = px.groupBy(*key).agg(F.median("v").alias("med"), F.count("v").alias("n"))
    mad = px.join(med.select(*key, F.col("med").alias(m)), key).groupBy(*key).agg(F.median(F.abs(F.col("v") - F.col(m))).alias("mad"))
    return med.join(mad, key)


def snr(px: DataFrame, key: list[str], least: int = 100, keep_from: float = 2.5) -> DataFrame:
    """median / (1.4826 MAD + 1e-6), 0 below `least` samples; kept from the threshold on."""
    value = F.when(F.col("n") >= least, F.col("med") / (1.4826 * F.col("mad") + 1e-6)).otherwise(0.0)
    return deviation(px, key).select(*key, value.alias("snr"), (value >= keep_from).alias("kept"))


def reference_frame(px: DataFrame, group: list[str], frame: str, first: int = 20) -> DataFrame:
    """The frame of greatest median / (1.4826 MAD + 1e-9) among the first candidates, earliest on ties."""
    order = Window.partitionBy(*group).orderBy(frame)
    firsts = px.select(*group, frame).distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= first).drop("_r")
    metric = F.when((F.col("med") > 1e-9) & (1.4826 * F.col("mad") > 1e-9), F.col("med") / (1.4826 * F.col("mad") + 1e-9)).otherwise(float("-inf"))
    scored = deviation(px.join(firsts, [*group, frame]), [*group, frame]).withColumn("metric", metric)
    best = scored.groupBy(*group).agg(F.max(F.struct("metric", (-F.col(frame)).alias("_f"))).alias("b"))
    return best.select(*group, (-F.col("b._f")).alias(frame), F.col("b.metric").alias("metric"))


def low_variance(px: DataFrame, key: list[str], least: float = 0.0005) -> DataFrame:
    """Frames whose population deviation is under `least`."""
    return px.groupBy(*key).agg(F.stddev_pop("v").alias("std")).where(F.col("std") < least)


def overlap_ratio(a: DataFrame, b: DataFrame, pixel: list[str], key: list[str], least: int = 1024, weight: str | None = None) -> DataFrame:
    """Scale and offset of b against a over common positive pixels (of positive weight in both, if one is named):
    medians, the 90th percentile if one is not positive; scale within [0.2, 5]."""
    good = (F.col(weight) > 0) if weight else F.lit(True)
    both = a.where(good).select(*pixel, F.col("v").alias("va")).join(b.where(good).select(*key, *pixel, F.col("v").alias("vb")), pixel).where("va > 0 and vb > 0")
    agg = both.groupBy(*key).agg(F.count("*").alias("overlap"), F.median("va").alias("ma"), F.median("vb").alias("mb"), F.percentile("va", F.lit(0.9)).alias("pa"), F.percentile("vb", F.lit(0.9)).alias("pb"))
    ref, new = F.when(F.col("ma") > 0, F.col("ma")).otherwise(F.col("pa")), F.when(F.col("mb") > 0, F.col("mb")).otherwise(F.col("pb"))
    return agg.where(F.col("overlap") >= least).select(*key, "overlap", F.least(F.greatest(F.abs(ref / new), F.lit(0.2)), F.lit(5.0)).alias("scale"), (ref - new).alias("offset"))


def plane_metrics(px: DataFrame, frame: list[str]) -> DataFrame:
    """Median, 1.4826 MAD, and root mean square gradient of what a fitted plane leaves.

    The plane's normal equations are sums by frame; the gradient is by central differences along rows and
    columns, one-sided at the ends.
    """
    good = px.where(F.col("v").isNotNull())
    sums = good.groupBy(*frame).agg(*(F.covar_pop(a, b).alias(f"_{a}{b}") for a, b in ("xx", "yy", "xy", "xv", "yv")), *(F.avg(c).alias(f"_m{c}") for c in "xyv"))
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    a = F.when(det != 0, (F.col("_xv") * F.col("_yy") - F.col("_yv") * F.col("_xy")) / det).otherwise(0.0)
    b = F.when(det != 0, (F.col("_yv") * F.col("_xx") - F.col("_xv") * F.col("_xy")) / det).otherwise(0.0)
    fitted = good.join(sums.select(*frame, a.alias("_a"), b.alias("_b"), "_mx", "_my", "_mv"), frame)
    rest = fitted.withColumn("r", F.col("v") - F.col("_mv") - F.col("_a") * (F.col("x") - F.col("_mx")) - F.col("_b") * (F.col("y") - F.col("_my")))

    def slope(along: str, across: str) -> Column:
        w = Window.partitionBy(*frame, "ch", across).orderBy(along)
        before, after = F.lag("r").over(w), F.lead("r").over(w)
        return F.when(before.isNull(), after - F.col("r")).when(after.isNull(), F.col("r") - before).otherwise((after - before) / 2)

    sloped = rest.withColumn("gx", slope("x", "y")).withColumn("gy", slope("y", "x"))
    grad = sloped.groupBy(*frame).agg(F.sqrt(F.avg(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("gradient"))
    return deviation(good, frame).join(grad, frame).select(*frame, F.col("med").alias("median"), (1.4826 * F.col("mad")).alias("noise"), "gradient")


def background_reference(metrics: DataFrame, coverage: DataFrame, frame: str) -> DataFrame:
    """|median - overall median| + noise + 2 gradient - 0.5 coverage fraction; the least is the reference."""
    overall = metrics.agg(F.median("median").alias("_all"))
    cost = F.abs(F.col("median") - F.col("_all")) + F.col("noise") + 2 * F.col("gradient") - 0.5 * F.coalesce("fraction", F.lit(0.0))
    scored = metrics.join(coverage.select(frame, "fraction"), frame, "left").join(F.broadcast(overall)).select(frame, cost.alias("score"))
    return scored.agg(F.min(F.struct("score", frame)).alias("b")).select(f"b.{frame}", "b.score")


def pairwise_offsets(px: DataFrame, frame: str, pixel: list[str]) -> DataFrame:
    """Median difference over the common footprint of each two frames a < b that have one.

    The join makes a row for each pixel of each pair, so px should be tiles (stacks of batches), not raw frames.
    """
    a = px.select(F.col(frame).alias("a"), *pixel, F.col("v").alias("va"))
    b = px.select(F.col(frame).alias("b"), *pixel, F.col("v").alias("vb"))
    return a.join(b, pixel).where("a < b").groupBy("a", "b").agg(F.median(F.col("va") - F.col("vb")).alias("offset"), F.count("*").alias("overlap"))


def tile_medians(px: DataFrame, frame: str, side: int, least: int = 1) -> DataFrame:
    """(frame, ch, y, x, v): medians of side x side squares of `least` samples and more, on the grid that all frames share;
    pairwise_offsets() of these makes a row a square, not a sample, of each two frames."""
    square = px.where(F.col("v").isNotNull()).groupBy(frame, "ch", F.expr(f"cast(floor(y / {side}) as int)").alias("y"), F.expr(f"cast(floor(x / {side}) as int)").alias("x"))
    return square.agg(F.median("v").alias("v"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def solve_offsets(pairs: DataFrame, frames: DataFrame, frame: str, tolerance: float = 1e-10, rounds: int = 1000) -> DataFrame:
    """(frame, correction) to subtract from each frame: least squares of the pairs' offsets, of mean 0 in each set of linked
    frames; 0 for frames without a finite offset.

    Conjugate gradients on tables: pairs (a, b, offset) are the edges of a graph, a round is one join of them with the
    search direction and a sum by frame, and only dot products come to the driver. Starting from 0 the solution of least norm
    is met. A round that can't improve ends it, as do `rounds`, with an error if the residual is then over a thousandth.
    """
    known = pairs.where(F.col("offset").isNotNull() & ~F.isnan("offset") & (F.abs("offset") < float("inf")))
    forth = known.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("offset").cast("double").alias("o"))
    edges = materialise(forth.unionByName(known.select(F.col("b").alias("i"), F.col("a").alias("j"), (-F.col("offset")).cast("double").alias("o"))))
    # The degree scales the unknowns, so that frames of many and of few pairs weigh alike.
    start = edges.groupBy("i").agg(F.count("*").cast("double").alias("d"), F.sum("o").alias("r")).withColumn("z", F.col("r") / F.col("d"))
    state = last = materialise(start.select("i", "d", F.lit(0.0).alias("x"), "r", F.col("z").alias("p")))
    dot = lambda df, *columns: [v or 0.0 for v in df.agg(*(F.sum(c) for c in columns)).first()]
    rz, first = dot(state, F.col("r") * F.col("r") / F.col("d"), F.abs("r"))
    norm = rz
    for _ in range(rounds):
        if rz <= tolerance * tolerance * norm or not first:
            break
        around = edges.join(state.select(F.col("i").alias("j"), F.col("p").alias("pj")), "j").groupBy("i").agg(F.sum("pj").alias("s"))
        stepped = materialise(state.join(around, "i").withColumn("q", F.col("d") * F.col("p") - F.col("s")).drop("s"))
        (pq,) = dot(stepped, F.col("p") * F.col("q"))
        if pq <= 0:
            break
        forget(last)
        last = stepped
        alpha = rz / pq
        r = F.col("r") - alpha * F.col("q")
        (after,) = dot(stepped, r * r / F.col("d"))
        beta, rz = after / rz, after
        state = stepped.select("i", "d", (F.col("x") + alpha * F.col("p")).alias("x"), r.alias("r"), (r / F.col("d") + beta * F.col("p")).alias("p"))
    if rz > 1e-6 * norm:
        raise RuntimeError(f"no solution in {rounds} rounds")
    # Mean 0 over all: the scaled start leaves a constant in each linked set, which its label takes out.
    solved = state.select("i", "x")
    linked = _linked_sets(edges)
    level = solved.join(linked, "i").groupBy("root").agg(F.avg("x").alias("level"))
    centred = solved.join(linked, "i").join(level, "root").select(F.col("i").alias(frame), (F.col("x") - F.col("level")).alias("correction"))
    return frames.select(frame).distinct().join(centred, frame, "left").select(frame, F.coalesce("correction", F.lit(0.0)).alias("correction"))


def _linked_sets(edges: DataFrame) -> DataFrame:
    """(i, root): the least frame that each is linked to, by edges (i, j) in both directions."""
    known = materialise(edges.groupBy("i").agg(F.least(F.min("j"), F.col("i")).alias("root")))
    while True:
        seen = edges.join(known.select(F.col("i").alias("j"), F.col("root").alias("rj")), "j").groupBy("i").agg(F.min("rj").alias("m"))
        own = known.join(seen, "i").select("i", F.least("root", "m").alias("root"), F.col("root").alias("before"))
        # The root's own root is a second step at once.
        jumped = own.join(known.select(F.col("i").alias("root"), F.col("root").alias("further")), "root", "left").select("i", F.least("root", F.coalesce("further", F.col("root"))).alias("root"), "before")
        step = materialise(jumped)
        forget(known)
        if not step.where("root <> before").limit(1).count():
            return step.select("i", "root")
        known = step


def noise_variance_weights(px: DataFrame, frame: list[str]) -> DataFrame:
    """Least clipped variance of the frame's channels over each channel's, then divided by the greatest."""
    var = clipped_stats(px, [*frame, "ch"]).select(*frame, "ch", (F.col("std") * F.col("std")).alias("var"))
    own = Window.partitionBy(*frame)
    weight = F.when(F.col("var") > 1e-9, F.min("var").over(own) / F.col("var")).otherwise(1.0)
    return var.withColumn("_w", weight).select(*frame, "ch", (F.col("_w") / F.max("_w").over(own)).alias("weight"))


def radial_weight(y: Column, x: Column, h: int, w: int, feather: float = 0.92, floor: float = 0.1) -> Column:
    """1 inside `feather` of the corner's distance, then falling linearly to the floor."""
    cy, cx = (h - 1) / 2, (w - 1) / 2
    r = F.sqrt((y - cy) * (y - cy) + (x - cx) * (x - cx)) / ((cy * cy + cx * cx) ** 0.5 or 1.0)
    return F.when(r >= feather, F.least(F.greatest(1 - (r - feather) / (1 - feather), F.lit(floor)), F.lit(1.0))).otherwise(1.0)


def exposure_weight(weight: Column, exptime: Column, units: Column) -> Column:
    """Counts weigh with their exposure, rates do not."""
    return F.when(units == "counts", weight * exptime).otherwise(weight)


def quality_weight(snr_: Column, stars: Column, top_snr: Column, top_stars: Column, a: float = 1.8, b: float = 0.5, floor: float = 0.01) -> Column:
    """Our own formula: powers of the shares of the best, not below the floor."""
    return F.greatest(F.pow(snr_ / top_snr, F.lit(a)) * F.pow(stars / top_stars, F.lit(b)), F.lit(floor))


def _reference(stats: DataFrame, group: list[str], frame: str, columns: list[str]) -> DataFrame:
    """The columns of each group's first frame, as ref_..."""
    first = stats.groupBy(*group).agg(F.min(frame).alias(frame))
    return stats.join(first, [*group, frame]).drop(frame).withColumnsRenamed({c: f"ref_{c}" for c in columns})


def linear_fit_coefficients(px: DataFrame, group: list[str], frame: str, low: float = 0.25, high: float = 0.9, ladder: bool = False) -> DataFrame:
    """(a, b) that take the two percentiles of each frame to those of its group's first frame, by channel.

    A flat frame is shifted. ladder: a flat frame under a reference with range becomes its low level, and a frame with
    range under a flat reference is shifted.
    """
    p = F.percentile("v", F.array(F.lit(low), F.lit(high)))
    stats = px.groupBy(*group, frame, "ch").agg(p.alias("p")).select(*group, frame, "ch", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    both = stats.join(_reference(stats, [*group, "ch"], frame, ["lo", "hi"]), [*group, "ch"])
    own, ref = F.col("hi") - F.col("lo"), F.col("ref_hi") - F.col("ref_lo")
    if ladder:
        own_flat, ref_flat = F.abs(own) <= 1e-5, F.abs(ref) <= 1e-5
        a = F.when(own_flat & ~ref_flat, 0.0).when(own_flat | ref_flat, 1.0).otherwise(ref / own)
    else:
        a = F.when(own > 1e-5, ref / own).otherwise(1.0)
    return both.withColumn("a", a).select(*group, frame, "ch", "a", (F.col("ref_lo") - F.col("a") * F.col("lo")).alias("b"))


def normalize_linear(px: DataFrame, group: list[str], frame: str, ladder: bool = False) -> DataFrame:
    a, b = free_names(px, ("_a", "_b"))
    found = linear_fit_coefficients(px, group, frame, ladder=ladder).withColumnsRenamed({"a": a, "b": b})
    return px.join(found, [*group, frame, "ch"]).withColumn("v", F.col(a) * F.col("v") + F.col(b)).drop(a, b)


def normalize(px: DataFrame, method: str, group: list[str], frame: str) -> DataFrame:
    """By name: astropy (robust z), skimage or basic (to [0, 1]), linear_fit, sky_mean, none."""
    if method == "none":
        return px
    ways = {"astropy": lambda: normalize_robust(px, [*group, frame]), "skimage": lambda: normalize_minmax(px, [*group, frame]), "basic": lambda: normalize_minmax(px, [*group, frame]), "linear_fit": lambda: normalize_linear(px, group, frame), "sky_mean": lambda: normalize_sky(px, group, frame)}
    if method not in ways:
        raise ValueError(f"no normalisation {method}")
    return ways[method]()


def normalize_sky(px: DataFrame, group: list[str], frame: str, at: float = 0.25) -> DataFrame:
    """Adds the difference of the reference's and the frame's percentile."""
    stats = px.groupBy(*group, frame).agg(F.percentile("v", F.lit(at)).alias("sky"))
    (d,) = free_names(px, ("_d",))
    both = stats.join(_reference(stats, group, frame, ["sky"]), group).select(*group, frame, (F.col("ref_sky") - F.col("sky")).alias(d))
    return px.join(both, [*group, frame]).withColumn("v", F.col("v") + F.col(d)).drop(d)


def normalize_robust(px: DataFrame, key: list[str]) -> DataFrame:
    """(v - median) / max(1.4826 MAD, 1e-9)."""
    med, mad = free_names(px, ("_med", "_mad"))
    d = deviation(px, key).select(*key, F.col("med").alias(med), F.col("mad").alias(mad))
    return px.join(d, key).withColumn("v", (F.col("v") - F.col(med)) / F.greatest(1.4826 * F.col(mad), F.lit(1e-9))).drop(med, mad)


def normalize_minmax(px: DataFrame, key: list[str]) -> DataFrame:
    """To [0, 1]; flat frames and missing samples become 0."""
    lo, hi = free_names(px, ("_lo", "_hi"))
    m = px.groupBy(*key).agg(F.min("v").alias(lo), F.max("v").alias(hi))
    scaled = F.when(F.col(hi) > F.col(lo), (F.col("v") - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(0.0)
    return px.join(m, key).withColumn("v", F.coalesce(scaled, F.lit(0.0))).drop(lo, hi)


def background_offsets(px: DataFrame, group: list[str], frame: str) -> DataFrame:
    """Median of the group's first frame less that of each frame, by channel."""
    stats = px.groupBy(*group, frame, "ch").agg(F.median("v").alias("med"))
    return stats.join(_reference(stats, [*group, "ch"], frame, ["med"]), [*group, "ch"]).select(*group, frame, "ch", (F.col("ref_med") - F.col("med")).alias("offset"))
