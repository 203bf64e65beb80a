"""Per-pixel reductions over frames. All take samples with a value column v and a group key; null v is masked.

rejected_pct is 100 * (1 - kept / total) over all samples of the pixel, masked ones included in total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstack.operators.robust import free_names
from lumenstack.work import materialise


def mean(px: DataFrame, key: list[str], weight: str | None = None) -> DataFrame:
    """Mean; weighted: sum(v w) / sum(w), and 0 where the weights do not reach 1e-9."""
    if weight is None:
        return px.groupBy(*key).agg(F.avg("v").alias("value"), F.count("v").alias("n"))
    w = F.when(F.col("v").isNotNull(), F.col(weight))
    agg = px.groupBy(*key).agg(F.sum(F.col("v") * w).alias("s"), F.sum(w).alias("w"), F.count("v").alias("n"))
    return agg.select(*key, F.when(F.col("w") > 1e-9, F.col("s") / F.col("w")).otherwise(0.0).alias("value"), "w", "n")


def median(px: DataFrame, key: list[str]) -> DataFrame:
    """Exact median with linear interpolation."""
    return px.groupBy(*key).agg(F.median("v").alias("value"), F.count("v").alias("n"))


def combine(marked: DataFrame, key: list[str], keep: Column, weight: str | None = None, floor: float = 1e-6) -> DataFrame:
    """Mean of kept samples; weighted ones give 0 where the kept weights do not exceed floor, unweighted null."""
    kept = F.when(keep, F.col("v"))
    aggs = [F.count("*").alias("total"), F.count(kept).alias("kept")]
    if weight is None:
        value = F.avg(kept)
    else:
        w = F.when(keep & F.col("v").isNotNull(), F.col(weight))
        value = F.when(F.coalesce(F.sum(w), F.lit(0.0)) > floor, F.sum(kept * w) / F.sum(w)).otherwise(0.0)
    agg = marked.groupBy(*key).agg(value.alias("value"), *aggs)
    return agg.select(*key, "value", "kept", (100.0 * (1 - F.col("kept") / F.col("total"))).alias("rejected_pct"))


def with_centre(px: DataFrame, key: list[str]) -> tuple[DataFrame, Column, Column]:
    """px with its pixel's median and population deviation, and these: one aggregation joined back, so that a hot pixel
    is neither buffered whole nor kept from being split."""
    med, sd = free_names(px, ("med", "sd"))
    stats = px.groupBy(*key).agg(F.median("v").alias(med), F.stddev_pop("v").alias(sd))
    return px.join(stats, key), F.col(med), F.col(sd)


def kappa_sigma(px: DataFrame, key: list[str], low: float = 3.0, high: float = 3.0, weight: str | None = None) -> DataFrame:
    """One pass: keep med - low sd <= v <= med + high sd, ends included."""
    centred, med, sd = with_centre(px, key)
    return combine(centred, key, F.col("v").between(med - low * sd, med + high * sd), weight)


def linear_fit_clip(px: DataFrame, key: list[str], sigma: float = 3.0, weight: str | None = None) -> DataFrame:
    """Residuals from the median, kept up to sigma of their deviation; no line is fitted."""
    centred, med, sd = with_centre(px, key)
    return combine(centred, key, F.abs(F.col("v") - med) <= sigma * sd, weight)


def winsorized(px: DataFrame, key: list[str], limits: tuple[float, float], value: str = "v", out: str = "wv") -> DataFrame:
    """px with the winsorised value of each sample along its pixel.

    k = round-half-even(limit * N), N with masked samples; ranks put masked samples last. The lowest k ranks take
    the value of rank k + 1, the highest k that of rank N - k.
    """
    pixel = Window.partitionBy(*key)
    n, r, lo, hi = names = free_names(px, ("_n", "_r", "_lo", "_hi"))
    ranked = px.withColumn(n, F.count("*").over(pixel)).withColumn(r, F.row_number().over(pixel.orderBy(F.col(value).asc_nulls_last())))
    ranked = ranked.withColumn(lo, F.bround(F.col(n) * limits[0]).cast("int")).withColumn(hi, F.bround(F.col(n) * limits[1]).cast("int"))
    low = F.max(F.when(F.col(r) == F.col(lo) + 1, F.col(value))).over(pixel)
    high = F.max(F.when(F.col(r) == F.col(n) - F.col(hi), F.col(value))).over(pixel)
    filled = F.when((F.col(lo) > 0) & (F.col(r) <= F.col(lo)), low).when((F.col(hi) > 0) & (F.col(r) > F.col(n) - F.col(hi)), high).otherwise(F.col(value))
    return ranked.withColumn(out, filled).drop(*names)


def winsorized_sigma(px: DataFrame, key: list[str], kappa: float = 3.0, limits: tuple[float, float] = (0.05, 0.05), rounds: int = 5, decay: float = 0.9, rewinsor: bool = True, weight: str | None = None) -> DataFrame:
    """Iterative: winsorise what is kept, clip at kappa decay^i sample deviations about its mean, and stop for the
    whole image when a round rejects nothing. Unweighted with rewinsor: rejected samples count with their
    winsorised value; weighted: kept samples alone.

    The samples are shuffled once: a row a pixel with its values in ascending order, as many as there are frames, and the
    state of each. A value is kept if it lies within all rounds' limits, so what is kept is a run of that order, and a
    round only narrows the run (low, high) of each pixel, written to the shared folder.
    """
    one = F.struct(F.col("v").alias("v"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    cells = F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), one)))
    state = px.groupBy(*key).agg(cells.alias("s"), F.count("*").cast("int").alias("total"))
    state = materialise(state.withColumns({"lo": F.lit(1), "hi": F.size("s")}))
    kept = F.col("hi") - F.col("lo") + 1
    for i in range(rounds):
        k = kappa * decay**i
        filled = _filled("s", limits)
        with_stats = state.withColumn("f", filled).withColumn("n", F.size("f"))
        mean = F.aggregate("f", F.lit(0.0), lambda a, x: a + x) / F.col("n")
        with_stats = with_stats.withColumn("m", F.when(F.col("n") > 0, mean))
        sd = F.sqrt(F.aggregate("f", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / (F.col("n") - 1))
        ends = with_stats.withColumn("d", F.when(F.col("n") > 1, sd))
        run = F.slice("s", F.col("lo"), F.greatest(kept, F.lit(0)))
        under = F.size(F.filter(run, lambda c: ~F.coalesce(c["v"] >= F.col("m") - k * F.col("d"), F.lit(False))))
        within = F.size(F.filter(run, lambda c: F.coalesce(c["v"].between(F.col("m") - k * F.col("d"), F.col("m") + k * F.col("d")), F.lit(False))))
        narrowed = ends.withColumns({"u": under, "t": within}).select(*key, "s", "total", (F.col("lo") + F.col("u")).alias("lo"), (F.col("lo") + F.col("u") + F.col("t") - 1).alias("hi"), (F.col("t") < kept).alias("lost"))
        state = materialise(narrowed)
        done = not state.where("lost").limit(1).count()
        state = state.drop("lost")
        if done:
            break
    run = F.slice("s", F.col("lo"), F.greatest(kept, F.lit(0)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    if weight is None and rewinsor:
        used = _used("s", limits)
        value = F.when(F.size(used) > 0, total(used) / F.size(used))
    elif weight is None:
        w = total(F.transform(run, lambda c: c["w"]))
        value = F.when(w > 1e-9, total(F.transform(run, lambda c: c["v"])) / w)
    else:
        w = total(F.transform(run, lambda c: F.coalesce(c["w"], F.lit(0.0))))
        value = F.when(w > 1e-9, total(F.transform(run, lambda c: c["v"] * F.coalesce(c["w"], F.lit(0.0)))) / w).otherwise(0.0)
    return state.select(*key, value.alias("value"), kept.cast("long").alias("kept"), (100.0 * (1 - kept / F.col("total"))).alias("rejected_pct"))


def _limits(limits: tuple[float, float]) -> tuple[Column, Column, Column]:
    """(k low, k high, values at rank k low + 1 and N - k high) of the kept run: ranks are over all N samples with masked
    and rejected ones last."""
    low, high = (F.bround(F.col("total") * x).cast("int") for x in limits)
    return low, high, F.col("hi") - F.col("lo") + 1


def _at(cells: str, rank: Column, kept: Column) -> Column:
    """The kept value of a rank from 1, null where that rank is masked or rejected."""
    return F.when((rank >= 1) & (rank <= kept), F.try_element_at(cells, (F.col("lo") + rank - 1).cast("int"))["v"])


def _filled(cells: str, limits: tuple[float, float]) -> Column:
    """Winsorised values of all N ranks that are not null."""
    low, high, kept = _limits(limits)
    n = F.col("total")
    bottom, top = _at(cells, low + 1, kept), _at(cells, n - high, kept)
    value = lambda r: F.when((low > 0) & (r <= low), bottom).when((high > 0) & (r > n - high), top).otherwise(_at(cells, r, kept))
    return F.filter(F.transform(F.sequence(F.lit(1), n), value), lambda x: x.isNotNull())


def _used(cells: str, limits: tuple[float, float]) -> Column:
    """Kept samples as they are, and the others with their winsorised value, where that is not null."""
    low, high, kept = _limits(limits)
    n = F.col("total")
    bottom, top = _at(cells, low + 1, kept), _at(cells, n - high, kept)
    value = lambda r: F.when(r <= kept, _at(cells, r, kept)).when((low > 0) & (r <= low), bottom).when((high > 0) & (r > n - high), top)
    return F.filter(F.transform(F.sequence(F.lit(1), n), value), lambda x: x.isNotNull())


def by_name(px: DataFrame, key: list[str], mode: str, weight: str | None = None, kappa: float = 3.0, sigma_low: float = 3.0, sigma_high: float = 3.0, limits: tuple[float, float] = (0.05, 0.05), rewinsor: bool = True, streaming_compat: bool = False) -> DataFrame:
    """(key, value, ...) by the mode's name: mean, median, kappa-sigma, winsorized-sigma, linear_fit_clip.

    streaming_compat: weights of one where none are named, so that pixels without any kept sample are 0 and nothing
    is winsorised again.
    """
    if streaming_compat and weight is None:
        (weight,) = free_names(px, ("_one",))
        px = px.withColumn(weight, F.lit(1.0))
    modes = {
        "mean": lambda: mean(px, key, weight),
        "median": lambda: median(px, key),
        "kappa-sigma": lambda: kappa_sigma(px, key, sigma_low, sigma_high, weight),
        "winsorized-sigma": lambda: winsorized_sigma(px, key, kappa, limits, rewinsor=rewinsor, weight=weight),
        "linear_fit_clip": lambda: linear_fit_clip(px, key, 3.0, weight),
    }
    if mode not in modes:
        raise ValueError(f"no stacking mode {mode}")
    return modes[mode]()


def live_average(px: DataFrame, key: list[str]) -> DataFrame:
    """SUM / max(WHT, 1e-6), with one unit of weight a frame."""
    agg = px.groupBy(*key).agg(F.sum(F.coalesce("v", F.lit(0.0))).alias("sum"), F.count("*").alias("wht"))
    return agg.withColumn("value", F.col("sum") / F.greatest(F.col("wht").cast("double"), F.lit(1e-6)))


def combine_batches(px: DataFrame, key: list[str], batch: str) -> DataFrame:
    """Batches' means weighted by their coverage: what is merged are sums, so batching cannot matter."""
    per_batch = px.groupBy(batch, *key).agg(F.avg("v").alias("img"), F.count("v").alias("cov"))
    merged = per_batch.groupBy(*key).agg(F.sum(F.col("img") * F.col("cov")).alias("sum"), F.sum("cov").alias("wht"), F.count("*").alias("batches"))
    return merged.withColumn("value", F.col("sum") / F.col("wht"))


def coverage_fraction(px: DataFrame, key: list[str], frame: str, least: int = 2) -> DataFrame:
    """Share of each frame's covered pixels that `least` frames cover."""
    covered = px.where(F.col("v").isNotNull() & (F.col("v") > 0))
    counts = covered.groupBy(*key).agg(F.count("*").alias("n"))
    return covered.join(counts, key).groupBy(frame).agg(F.avg((F.col("n") >= least).cast("double")).alias("fraction"), F.count("*").alias("pixels"))
