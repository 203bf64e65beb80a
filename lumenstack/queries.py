"""The engine's queries over the driver's tables, each with its SQL twin where SQL can express it.

Embeddings of 64 numbers are read as 8 x 8 frames: vec_id is the frame, label the batch. Where three channels
are needed, frames 3k, 3k + 1 and 3k + 2 of the table are red, green and blue of picture k. lineitem is read as
samples of pixels: l_partkey is the pixel, l_extendedprice the value, 1 - l_discount the weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstack import model
from lumenstack.functions import stretch, wcs
from lumenstack.operators import project, robust, spatial, stack
from lumenstack.plans import lifecycle

QUERIES: dict = {}
SQL: dict[str, str] = {}
PIXEL = ["batch_id", "y", "x"]
PX = "px AS (SELECT vec_id AS frame_id, label AS batch_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS t(i))"
LI = "li AS (SELECT l_partkey, l_extendedprice AS v, 1 - l_discount AS w FROM lineitem)"
STATS = "st AS (SELECT batch_id, y, x, median(v) AS med, stddev_pop(v) AS sd FROM px GROUP BY ALL)"
DEV = "md AS (SELECT frame_id, batch_id, median(v) AS med, count(v) AS n FROM px GROUP BY ALL), dv AS (SELECT frame_id, batch_id, med, n, median(abs(v - med)) AS mad FROM px JOIN md USING (frame_id, batch_id) GROUP BY ALL)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rs(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


def r(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("label").alias("batch_id"), F.col("embedding").alias("data"))
    return model.explode_frames(packed, 8)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("v"), (1 - F.col("l_discount")).alias("w"))


# Stacks


@query(f"WITH {PX} SELECT batch_id, y, x, {rs('avg(v)')} AS value, count(v) AS n FROM px GROUP BY batch_id, y, x")
def stack_mean(spark, d):
    return stack.mean(frames(spark, d), PIXEL).select(*PIXEL, r("value").alias("value"), "n")


@query(f"WITH {LI} SELECT l_partkey, {rs('sum(v * w) / sum(w)', 3)} AS value, {rs('sum(w)', 3)} AS w, count(v) AS n FROM li GROUP BY l_partkey")
def stack_weighted_mean(spark, d):
    return stack.mean(samples(spark, d), ["l_partkey"], "w").select("l_partkey", r("value", 3).alias("value"), r("w", 3).alias("w"), "n")


@query(f"WITH {PX} SELECT batch_id, y, x, {rs('median(v)')} AS value, count(v) AS n FROM px GROUP BY batch_id, y, x")
def stack_median(spark, d):
    return stack.median(frames(spark, d), PIXEL).select(*PIXEL, r("value").alias("value"), "n")


def _clip_sql(keep: str, low: str = "") -> str:
    return f"WITH {PX}, {STATS} SELECT batch_id, y, x, {rs(f'avg(v) FILTER (WHERE {keep})')} AS value, count(*) FILTER (WHERE {keep}) AS kept, {rs(f'100.0 * (1 - count(*) FILTER (WHERE {keep}) / count(*))')} AS rejected_pct FROM px JOIN st USING (batch_id, y, x) GROUP BY batch_id, y, x"


@query(_clip_sql("v BETWEEN med - 2.0 * sd AND med + 2.5 * sd"))
def stack_kappa_sigma(spark, d):
    out = stack.kappa_sigma(frames(spark, d), PIXEL, 2.0, 2.5)
    return out.select(*PIXEL, r("value").alias("value"), "kept", r("rejected_pct").alias("rejected_pct"))


@query(_clip_sql("abs(v - med) <= 2.0 * sd"))
def stack_linear_fit_clip(spark, d):
    out = stack.linear_fit_clip(frames(spark, d), PIXEL, 2.0)
    return out.select(*PIXEL, r("value").alias("value"), "kept", r("rejected_pct").alias("rejected_pct"))


@query(f"WITH {LI}, st AS (SELECT l_partkey, median(v) AS med, stddev_pop(v) AS sd FROM li GROUP BY 1), k AS (SELECT l_partkey, v, w, v BETWEEN med - 1.5 * sd AND med + 1.5 * sd AS keep FROM li JOIN st USING (l_partkey)) SELECT l_partkey, CASE WHEN coalesce(sum(w) FILTER (WHERE keep), 0) > 1e-6 THEN {rs('sum(v * w) FILTER (WHERE keep) / sum(w) FILTER (WHERE keep)', 3)} ELSE 0.0 END AS value, count(*) FILTER (WHERE keep) AS kept FROM k GROUP BY 1")
def stack_kappa_sigma_weighted(spark, d):
    out = stack.kappa_sigma(samples(spark, d), ["l_partkey"], 1.5, 1.5, "w")
    return out.select("l_partkey", r("value", 3).alias("value"), "kept")


def _winsor_sql(source: str, value: str, name: str) -> str:
    """A CTE that adds wv to source, winsorised at 0.05 along pixels."""
    w = "PARTITION BY batch_id, y, x"
    return f"{name}r AS (SELECT *, count(*) OVER ({w}) AS n_, row_number() OVER ({w} ORDER BY {value} ASC NULLS LAST) AS r_ FROM {source}), {name}k AS (SELECT *, CAST(round_even(0.05::DOUBLE * n_, 0) AS INTEGER) AS k_ FROM {name}r), {name} AS (SELECT * EXCLUDE (n_, r_, k_), CASE WHEN k_ > 0 AND r_ <= k_ THEN max(CASE WHEN r_ = k_ + 1 THEN {value} END) OVER ({w}) WHEN k_ > 0 AND r_ > n_ - k_ THEN max(CASE WHEN r_ = n_ - k_ THEN {value} END) OVER ({w}) ELSE {value} END AS wv FROM {name}k)"


@query(f"WITH {PX}, {_winsor_sql('px', 'v', 'a')} SELECT frame_id, y, x, {rs('wv')} AS wv FROM a")
def winsorize(spark, d):
    return stack.winsorized(frames(spark, d), PIXEL, (0.05, 0.05)).select("frame_id", "y", "x", r("wv").alias("wv"))


def _winsorized_sigma_sql(weighted: bool) -> str:
    """Five rounds written out; a round acts only if the one before it rejected something."""
    w = "PARTITION BY batch_id, y, x"
    steps, last = [f"WITH {PX}", "s0 AS (SELECT *, v AS kept, 1 AS lost FROM px)"], "s0"
    for i in range(5):
        k = 2.0 * 0.9**i
        steps.append(_winsor_sql(last, "kept", f"w{i}"))
        steps.append(f"m{i} AS (SELECT *, avg(wv) OVER ({w}) AS m_, stddev_samp(wv) OVER ({w}) AS s_ FROM w{i})")
        steps.append(f"d{i} AS (SELECT frame_id, batch_id, y, x, v, kept AS before_, CASE WHEN (SELECT max(lost) FROM {last}) = 0 OR v BETWEEN m_ - {k} * s_ AND m_ + {k} * s_ THEN kept END AS kept FROM m{i})")
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT frame_id, batch_id, y, x, v, kept, CAST(before_ IS NOT NULL AND kept IS NULL AS INTEGER) AS lost FROM d{i})")
        last = f"s{i + 1}"
    if weighted:
        value = "CASE WHEN coalesce(sum(1 + y) FILTER (WHERE kept IS NOT NULL), 0) > 1e-9 THEN sum(kept * (1 + y)) / sum(1 + y) FILTER (WHERE kept IS NOT NULL) ELSE 0 END"
        return ", ".join(steps) + f" SELECT batch_id, y, x, {rs(value)} AS value, count(kept) AS kept FROM {last} GROUP BY ALL"
    steps.append(_winsor_sql(last, "kept", "z"))
    return ", ".join(steps) + f" SELECT batch_id, y, x, {rs('avg(coalesce(kept, wv))')} AS value, count(kept) AS kept FROM z GROUP BY batch_id, y, x"


@query(_winsorized_sigma_sql(False))
def stack_winsorized_sigma(spark, d):
    return stack.winsorized_sigma(frames(spark, d), PIXEL, kappa=2.0).select(*PIXEL, r("value").alias("value"), "kept")


@query(_winsorized_sigma_sql(True))
def stack_winsorized_weighted(spark, d):
    weighted = frames(spark, d).withColumn("w", (1 + F.col("y")).cast("double"))
    return stack.winsorized_sigma(weighted, PIXEL, kappa=2.0, weight="w").select(*PIXEL, r("value").alias("value"), "kept")


@query(f"WITH {PX} SELECT batch_id, y, x, {rs('sum(coalesce(v, 0))')} AS sum, count(*) AS wht, {rs('sum(coalesce(v, 0)) / greatest(count(*), 1e-6)')} AS value FROM px GROUP BY batch_id, y, x")
def live_average(spark, d):
    return stack.live_average(frames(spark, d), PIXEL).select(*PIXEL, r("sum").alias("sum"), "wht", r("value").alias("value"))


@query(f"WITH {PX}, b AS (SELECT batch_id, y, x, avg(v) AS img, count(v) AS cov FROM px GROUP BY ALL) SELECT y, x, {rs('sum(img * cov) / sum(cov)')} AS value, CAST(sum(cov) AS BIGINT) AS wht, count(*) AS batches FROM b GROUP BY y, x")
def combine_batches(spark, d):
    return stack.combine_batches(frames(spark, d), ["y", "x"], "batch_id").select("y", "x", r("value").alias("value"), "wht", "batches")


@query(f"WITH {PX}, c AS (SELECT * FROM px WHERE v > 0), n AS (SELECT batch_id, y, x, count(*) AS n FROM c GROUP BY ALL) SELECT frame_id, {rs('avg(CAST(n >= 20 AS INTEGER))')} AS fraction, count(*) AS pixels FROM c JOIN n USING (batch_id, y, x) GROUP BY frame_id")
def coverage_fraction(spark, d):
    return stack.coverage_fraction(frames(spark, d), PIXEL, "frame_id", 20).select("frame_id", r("fraction").alias("fraction"), "pixels")


# Robust statistics, quality, weights


def _clipped_sql(key: str, source: str = "px") -> str:
    steps, last = [], source
    for i in range(5):
        steps.append(f"c{i} AS (SELECT {key}, median(v) AS m_, stddev_pop(v) AS s_ FROM {last} GROUP BY {key}), p{i} AS (SELECT {last}.* FROM {last} JOIN c{i} USING ({key}) WHERE abs(v - m_) <= 2.0 * s_)")
        last = f"p{i}"
    return ", ".join(steps)


@query(f"WITH {PX}, {_clipped_sql('frame_id')} SELECT frame_id, {rs('avg(v)')} AS mean, {rs('median(v)')} AS median, {rs('stddev_pop(v)')} AS std, count(v) AS n FROM p4 GROUP BY frame_id")
def sigma_clipped_stats(spark, d):
    out = robust.clipped_stats(frames(spark, d), ["frame_id"], 2.0)
    return out.select("frame_id", *(r(c).alias(c) for c in ("mean", "median", "std")), "n")


@query(f"WITH {PX}, {_clipped_sql('frame_id').replace('2.0 * s_', '3.0 * s_')}, k AS (SELECT frame_id, median(v) AS sky FROM p4 GROUP BY 1) SELECT frame_id, y, x, {rs('v - sky')} AS v FROM px JOIN k USING (frame_id)")
def subtract_sky_median(spark, d):
    return robust.subtract_sky(frames(spark, d), ["frame_id"], 50).select("frame_id", "y", "x", r("v").alias("v"))


@query(f"WITH {PX}, {DEV} SELECT frame_id, {rs('CASE WHEN n >= 50 THEN med / (1.4826 * mad + 1e-6) ELSE 0 END')} AS snr, CASE WHEN n >= 50 THEN med / (1.4826 * mad + 1e-6) ELSE 0 END >= 0.1 AS kept FROM dv")
def snr_gate(spark, d):
    return robust.snr(frames(spark, d), ["frame_id"], 50, 0.1).select("frame_id", r("snr").alias("snr"), "kept")


@query(f"WITH {PX} SELECT frame_id, {rs('stddev_pop(v)')} AS std FROM px GROUP BY frame_id HAVING stddev_pop(v) < 0.95")
def low_variance_frames(spark, d):
    return robust.low_variance(frames(spark, d), ["frame_id"], 0.95).select("frame_id", r("std").alias("std"))


@query(f"WITH {PX}, {DEV}, f AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY frame_id) AS r FROM dv), s AS (SELECT batch_id, frame_id, CASE WHEN med > 1e-9 AND 1.4826 * mad > 1e-9 THEN med / (1.4826 * mad + 1e-9) ELSE '-inf'::DOUBLE END AS metric FROM f WHERE r <= 20) SELECT batch_id, frame_id, {rs('metric')} AS metric FROM s QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY metric DESC, frame_id) = 1")
def reference_frame(spark, d):
    return robust.reference_frame(frames(spark, d), ["batch_id"], "frame_id").select("batch_id", "frame_id", r("metric").alias("metric"))


@query(f"WITH {PX}, s AS (SELECT batch_id, y, x, avg(v) + 1 AS v FROM px GROUP BY ALL), m AS (SELECT a.batch_id AS a, b.batch_id AS b, count(*) AS overlap, median(a.v) AS ma, median(b.v) AS mb FROM s a JOIN s b ON a.y = b.y AND a.x = b.x AND b.batch_id <> 0 AND a.batch_id = 0 WHERE a.v > 0 AND b.v > 0 GROUP BY ALL HAVING count(*) >= 10) SELECT b AS batch_id, overlap, {rs('least(greatest(abs(ma / mb), 0.2), 5.0)')} AS scale, {rs('ma - mb')} AS \"offset\" FROM m")
def overlap_ratio(spark, d):
    tiles = stack.mean(frames(spark, d), PIXEL).select(*PIXEL, (F.col("value") + 1).alias("v"))
    out = robust.overlap_ratio(tiles.where("batch_id = 0"), tiles.where("batch_id <> 0"), ["y", "x"], ["batch_id"], 10)
    return out.select("batch_id", "overlap", r("scale").alias("scale"), r("offset").alias("offset"))


_PLANE = f"""{PX}, t AS (SELECT batch_id AS frame_id, 0 AS batch_id, y, x, avg(v) AS v FROM px GROUP BY ALL),
q AS (SELECT frame_id, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv, avg(x) AS mx, avg(y) AS my, avg(v) AS mv FROM t GROUP BY 1),
f AS (SELECT t.*, v - mv - (xv * yy - yv * xy) / (xx * yy - xy * xy) * (x - mx) - (yv * xx - xv * xy) / (xx * yy - xy * xy) * (y - my) AS r FROM t JOIN q USING (frame_id)),
g AS (SELECT frame_id, CASE WHEN x = 0 THEN lead(r) OVER a - r WHEN x = 7 THEN r - lag(r) OVER a ELSE (lead(r) OVER a - lag(r) OVER a) / 2 END AS gx, CASE WHEN y = 0 THEN lead(r) OVER b - r WHEN y = 7 THEN r - lag(r) OVER b ELSE (lead(r) OVER b - lag(r) OVER b) / 2 END AS gy FROM f WINDOW a AS (PARTITION BY frame_id, y ORDER BY x), b AS (PARTITION BY frame_id, x ORDER BY y)),
md AS (SELECT frame_id, median(v) AS med FROM t GROUP BY 1), dv AS (SELECT frame_id, med, median(abs(v - med)) AS mad FROM t JOIN md USING (frame_id) GROUP BY ALL),
pm AS (SELECT frame_id, med AS median, 1.4826 * mad AS noise, sqrt(avg(gx * gx + gy * gy)) AS gradient FROM g JOIN dv USING (frame_id) GROUP BY ALL)"""


def _tiles(spark, d):
    return stack.mean(frames(spark, d), [*PIXEL, "ch"]).select(F.col("batch_id").alias("frame_id"), "ch", "y", "x", F.col("value").alias("v"))


@query(f"WITH {_PLANE} SELECT frame_id, {rs('median')} AS median, {rs('noise')} AS noise, {rs('gradient')} AS gradient FROM pm")
def bg_plane_metrics(spark, d):
    out = robust.plane_metrics(_tiles(spark, d), ["frame_id"])
    return out.select("frame_id", *(r(c).alias(c) for c in ("median", "noise", "gradient")))


@query(f"WITH {_PLANE}, c AS (SELECT frame_id, avg(CAST(v > 0 AS INTEGER)) AS fraction FROM t GROUP BY 1) SELECT frame_id, {rs('abs(median - (SELECT median(median) FROM pm)) + noise + 2 * gradient - 0.5 * fraction')} AS score FROM pm JOIN c USING (frame_id) ORDER BY abs(median - (SELECT median(median) FROM pm)) + noise + 2 * gradient - 0.5 * fraction, frame_id LIMIT 1")
def mosaic_reference(spark, d):
    tiles = _tiles(spark, d)
    coverage = tiles.groupBy("frame_id").agg(F.avg((F.col("v") > 0).cast("double")).alias("fraction"))
    return robust.background_reference(robust.plane_metrics(tiles, ["frame_id"]), coverage, "frame_id").select("frame_id", r("score").alias("score"))


@query(f"WITH {PX}, t AS (SELECT batch_id, y, x, avg(v) AS v FROM px GROUP BY ALL) SELECT a.batch_id AS a, b.batch_id AS b, {rs('median(a.v - b.v)')} AS \"offset\", count(*) AS overlap FROM t a JOIN t b ON a.y = b.y AND a.x = b.x AND a.batch_id < b.batch_id GROUP BY ALL")
def pairwise_bg_offsets(spark, d):
    tiles = stack.mean(frames(spark, d), PIXEL).select(*PIXEL, F.col("value").alias("v"))
    out = robust.pairwise_offsets(tiles, "batch_id", ["y", "x"])
    return out.select("a", "b", r("offset").alias("offset"), "overlap")


@query(f"WITH {PX}, t AS (SELECT batch_id, y, x, avg(v) AS v FROM px GROUP BY ALL), p AS (SELECT a.batch_id AS a, b.batch_id AS b, median(a.v - b.v) AS o FROM t a JOIN t b ON a.y = b.y AND a.x = b.x AND a.batch_id <> b.batch_id GROUP BY 1, 2) SELECT a AS batch_id, {rs('sum(o) / (SELECT count(DISTINCT batch_id) FROM t)')} AS correction FROM p GROUP BY 1")
def solved_bg_offsets(spark, d):
    """All tiles share all pixels, so the least squares are the mean of a tile's offsets, itself included."""
    tiles = stack.mean(frames(spark, d), PIXEL).select(*PIXEL, F.col("value").alias("v"))
    out = robust.solve_offsets(robust.pairwise_offsets(tiles, "batch_id", ["y", "x"]), tiles, "batch_id")
    return out.select("batch_id", (r("correction") + 0.0).alias("correction"))


_RGB = "rgb AS (SELECT batch_id, vec_id // 3 AS picture, CAST(vec_id % 3 AS INTEGER) AS ch, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT *, label AS batch_id FROM embeddings), range(1, 65) AS t(i))"


def _pictures(spark, d):
    return frames(spark, d).withColumns({"picture": F.expr("frame_id div 3"), "ch": F.expr("cast(frame_id % 3 as int)")})


@query(f"WITH {_RGB}, {_clipped_sql('picture, ch', 'rgb').replace('2.0 * s_', '3.0 * s_')}, q AS (SELECT picture, ch, stddev_pop(v) ** 2 AS var FROM p4 GROUP BY 1, 2), u AS (SELECT picture, ch, CASE WHEN var > 1e-9 THEN min(var) OVER (PARTITION BY picture) / var ELSE 1.0 END AS u FROM q) SELECT picture, ch, {rs('u / max(u) OVER (PARTITION BY picture)')} AS weight FROM u")
def noise_variance_weights(spark, d):
    return robust.noise_variance_weights(_pictures(spark, d), ["picture"]).select("picture", "ch", r("weight").alias("weight"))


_RADIUS = "sqrt((y - 3.5) * (y - 3.5) + (x - 3.5) * (x - 3.5)) / sqrt(24.5)"


@query(f"WITH {PX} SELECT batch_id, {rs(f'sum(v * CASE WHEN {_RADIUS} >= 0.5 THEN least(greatest(1 - ({_RADIUS} - 0.5) / 0.5, 0.1), 1.0) ELSE 1.0 END)')} AS weighted FROM px GROUP BY 1")
def radial_weights(spark, d):
    w = robust.radial_weight(F.col("y"), F.col("x"), 8, 8, 0.5, 0.1)
    return frames(spark, d).groupBy("batch_id").agg(r(F.sum(F.col("v") * w)).alias("weighted"))


@query("SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN (1 - l_discount) * l_quantity ELSE 1 - l_discount END), 3) AS weight FROM lineitem GROUP BY 1")
def exposure_weights(spark, d):
    w = robust.exposure_weight(1 - F.col("l_discount"), F.col("l_quantity"), F.when(F.col("l_linestatus") == "F", "counts").otherwise("cps"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r(F.sum(w), 3).alias("weight"))


@query(f"WITH {PX}, {DEV}, q AS (SELECT frame_id, abs(med) / (1.4826 * mad + 1e-6) AS snr, 1 + frame_id % 7 AS stars FROM dv), w AS (SELECT frame_id, greatest(pow(snr / max(snr) OVER (), 1.8) * pow(stars / max(stars) OVER (), 0.5), 0.01) AS w FROM q) SELECT batch_id, y, x, {rs('sum(v * w) / sum(w)')} AS value FROM px JOIN w USING (frame_id) GROUP BY 1, 2, 3")
def quality_weighted_stack(spark, d):
    px = frames(spark, d)
    q = robust.deviation(px, ["frame_id"]).select("frame_id", (F.abs("med") / (1.4826 * F.col("mad") + 1e-6)).alias("snr"), (1 + F.col("frame_id") % 7).alias("stars"))
    top = q.agg(F.max("snr").alias("ts"), F.max("stars").alias("tt")).first()
    w = q.select("frame_id", robust.quality_weight(F.col("snr"), F.col("stars"), F.lit(top["ts"]), F.lit(top["tt"])).alias("w"))
    return stack.mean(px.join(w, "frame_id"), PIXEL, "w").select(*PIXEL, r("value").alias("value"))


# Normalisation


_FIT = "p AS (SELECT batch_id, frame_id, quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.9) AS hi FROM px GROUP BY ALL), f AS (SELECT batch_id, arg_min(lo, frame_id) AS rlo, arg_min(hi, frame_id) AS rhi FROM p GROUP BY 1), c AS (SELECT batch_id, frame_id, CASE WHEN hi - lo > 1e-5 THEN (rhi - rlo) / (hi - lo) ELSE 1 END AS a, lo, rlo FROM p JOIN f USING (batch_id))"


@query(f"WITH {PX}, {_FIT} SELECT batch_id, frame_id, {rs('a')} AS a, {rs('rlo - a * lo')} AS b FROM c")
def norm_linear_fit(spark, d):
    return robust.linear_fit_coefficients(frames(spark, d), ["batch_id"], "frame_id").select("batch_id", "frame_id", r("a").alias("a"), r("b").alias("b"))


@query(f"WITH {PX}, {_FIT} SELECT batch_id, y, x, {rs('avg(a * v + rlo - a * lo)')} AS value FROM px JOIN c USING (batch_id, frame_id) GROUP BY 1, 2, 3")
def norm_linear_fit_stack(spark, d):
    return stack.mean(robust.normalize_linear(frames(spark, d), ["batch_id"], "frame_id"), PIXEL).select(*PIXEL, r("value").alias("value"))


@query(f"WITH {PX}, p AS (SELECT batch_id, frame_id, quantile_cont(v, 0.25) AS s FROM px GROUP BY ALL), f AS (SELECT batch_id, arg_min(s, frame_id) AS rs FROM p GROUP BY 1) SELECT batch_id, frame_id, y, x, {rs('v + rs - s')} AS v FROM px JOIN p USING (batch_id, frame_id) JOIN f USING (batch_id)")
def norm_sky_mean(spark, d):
    return robust.normalize_sky(frames(spark, d), ["batch_id"], "frame_id").select("batch_id", "frame_id", "y", "x", r("v").alias("v"))


@query(f"WITH {PX}, {DEV} SELECT frame_id, y, x, {rs('(v - med) / greatest(1.4826 * mad, 1e-9)')} AS v FROM px JOIN dv USING (frame_id, batch_id)")
def norm_robust_z(spark, d):
    return robust.normalize_robust(frames(spark, d), ["frame_id"]).select("frame_id", "y", "x", r("v").alias("v"))


@query(f"WITH {PX}, m AS (SELECT frame_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1) SELECT frame_id, y, x, {rs('CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END')} AS v FROM px JOIN m USING (frame_id)")
def norm_minmax(spark, d):
    return robust.normalize_minmax(frames(spark, d), ["frame_id"]).select("frame_id", "y", "x", r("v").alias("v"))


@query(f"WITH {PX}, m AS (SELECT batch_id, frame_id, median(v) AS med FROM px GROUP BY ALL), f AS (SELECT batch_id, arg_min(med, frame_id) AS ref FROM m GROUP BY 1) SELECT batch_id, frame_id, {rs('ref - med')} AS \"offset\" FROM m JOIN f USING (batch_id)")
def bg_offsets(spark, d):
    return robust.background_offsets(frames(spark, d), ["batch_id"], "frame_id").select("batch_id", "frame_id", r("offset").alias("offset"))


# Geometry


_AFF = "a AS (SELECT *, 0.9::DOUBLE * x + -0.2::DOUBLE * y + 0.3::DOUBLE AS ox, 0.2::DOUBLE * x + 0.9::DOUBLE * y + -0.7::DOUBLE AS oy FROM px)"


def _moved() -> tuple[Column, Column]:
    return wcs.affine(F.col("x"), F.col("y"), tuple(map(F.lit, (0.9, -0.2, 0.3, 0.2, 0.9, -0.7))))


@query(f"WITH {PX}, {_AFF} SELECT frame_id, y, x, {rs('ox')} AS out_x, {rs('oy')} AS out_y, ox >= -1e-9 AND ox < 8 AND oy >= -1e-9 AND oy < 8 AS in_grid FROM a")
def affine_pixmap(spark, d):
    ox, oy = _moved()
    return frames(spark, d).select("frame_id", "y", "x", r(ox).alias("out_x"), r(oy).alias("out_y"), wcs.in_grid(ox, oy, F.lit(8), F.lit(8)).alias("in_grid"))


@query(f"WITH {PX}, {_AFF}, c AS (SELECT batch_id, v, CAST(floor(ox + 0.5) AS INTEGER) AS x, CAST(floor(oy + 0.5) AS INTEGER) AS y FROM a) SELECT batch_id, y, x, {rs('avg(v)')} AS sci, CAST(count(*) AS DOUBLE) AS wht FROM c WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 GROUP BY 1, 2, 3")
def drizzle_point(spark, d):
    return project.drizzle_point(frames(spark, d), ["batch_id"], *_moved(), 8, 8).select(*PIXEL, r("sci").alias("sci"), "wht")


_TURBO = "b AS (SELECT batch_id, v, 2 * x + 1.3::DOUBLE AS ox, 2 * y + 0.6::DOUBLE AS oy FROM px), c AS (SELECT batch_id, v, cx AS x, cy AS y, greatest(0, least(ox + 0.8, cx + 0.5) - greatest(ox - 0.8::DOUBLE, cx - 0.5::DOUBLE)) * greatest(0, least(oy + 0.8, cy + 0.5) - greatest(oy - 0.8, cy - 0.5)) / 2.56 AS w FROM b, (SELECT CAST(range AS INTEGER) AS cx FROM range(16)), (SELECT CAST(range AS INTEGER) AS cy FROM range(16)) WHERE abs(cx - ox) < 1.3 AND abs(cy - oy) < 1.3)"


def _turbo(spark, d):
    return project.drizzle_turbo(frames(spark, d), ["batch_id"], 2 * F.col("x") + 1.3, 2 * F.col("y") + 0.6, 16, 16, 0.8, 2.0)


@query(f"WITH {PX}, {_TURBO} SELECT batch_id, y, x, {rs('sum(v * w) / sum(w)')} AS sci, {rs('sum(w)', 9)} AS wht FROM c WHERE w > 1e-12 GROUP BY 1, 2, 3")
def drizzle_turbo(spark, d):
    return _turbo(spark, d).where("wht > 1e-12").select(*PIXEL, r("sci").alias("sci"), r("wht", 9).alias("wht"))


@query(f"WITH {PX}, {_TURBO}, s AS (SELECT batch_id, y, x, sum(v * w) AS s, sum(w) AS w FROM c WHERE w > 1e-12 GROUP BY 1, 2, 3), f AS (SELECT batch_id, max(w) AS top, avg(w) AS mean FROM s GROUP BY 1) SELECT batch_id, y, x, {rs('s / w')} AS divide, {rs('s / w * top')} AS \"max\", {rs('s / w * mean')} AS n_images, {rs('s')} AS \"none\" FROM s JOIN f USING (batch_id)")
def drizzle_finalize_modes(spark, d):
    acc = _turbo(spark, d).where("wht > 1e-12")
    out = acc
    for mode in ("divide", "max", "n_images", "none"):
        out = project.finalize(out, ["batch_id"], mode).withColumnRenamed("value", f"as_{mode}")
    return out.select(*PIXEL, *(r(f"as_{m}").alias(m) for m in ("divide", "max", "n_images", "none")))


@query(f"WITH {PX}, t AS (SELECT batch_id, y AS ty, x AS tx, x + 0.25 AS sx, y + 0.5 AS sy FROM (SELECT DISTINCT batch_id, y, x FROM px)), m AS (SELECT batch_id, y, x, avg(v) AS v FROM px GROUP BY ALL), n AS (SELECT batch_id, ty, tx, sum(v * (1 - abs(x - sx)) * (1 - abs(y - sy))) AS value, sum((1 - abs(x - sx)) * (1 - abs(y - sy))) AS f FROM t JOIN m USING (batch_id) WHERE abs(x - sx) < 1 AND abs(y - sy) < 1 GROUP BY 1, 2, 3) SELECT batch_id, ty, tx, {rs('value')} AS value FROM n WHERE f > 1 - 1e-9")
def reproject_bilinear(spark, d):
    tiles = stack.mean(frames(spark, d), PIXEL).withColumnRenamed("value", "v")
    targets = tiles.select("batch_id", F.col("y").alias("ty"), F.col("x").alias("tx"), (F.col("x") + 0.25).alias("sx"), (F.col("y") + 0.5).alias("sy"))
    return project.reproject_bilinear(tiles, ["batch_id"], targets).select("batch_id", "ty", "tx", r("value").alias("value"))


@query(f"WITH {PX}, m AS (SELECT batch_id, y + batch_id % 3 AS y, x + batch_id % 2 AS x, avg(v) AS v, count(*) AS w FROM px GROUP BY ALL) SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {rs('sum(v * w) / sum(w)')} AS value, CAST(sum(w) AS BIGINT) AS coverage FROM m GROUP BY 1, 2")
def reproject_coadd(spark, d):
    tiles = stack.mean(frames(spark, d), PIXEL).select((F.col("y") + F.col("batch_id") % 3).cast("int").alias("y"), (F.col("x") + F.col("batch_id") % 2).cast("int").alias("x"), "value", "n")
    return project.coadd(tiles, ["y", "x"], "value", "n").select("y", "x", r("value").alias("value"), "coverage")


_HEAD = "h AS (SELECT c_custkey, c_nationkey, c_acctbal / 10 AS x0, c_custkey % 500 AS y0, 100 + c_custkey % 7 AS naxis1, 80 + c_custkey % 5 AS naxis2, 1 + (c_custkey % 3) / 4.0::DOUBLE AS scale FROM customer)"


@query(f"WITH {_HEAD}, k AS (SELECT c_nationkey, x0 + a * (naxis1 - 1) * scale AS cx, y0 + b * (naxis2 - 1) * scale AS cy, scale FROM h, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(a, b)) SELECT c_nationkey, CAST(ceil(max(cx)) - floor(min(cx)) + 3 AS INTEGER) AS width, CAST(ceil(max(cy)) - floor(min(cy)) + 3 AS INTEGER) AS height, min(scale) AS scale FROM k GROUP BY 1")
def output_grid_bbox(spark, d):
    key = F.col("c_custkey")
    headers = table(spark, d, "customer").select("c_nationkey", (F.col("c_acctbal") / 10).alias("x0"), (key % 500).alias("y0"), (100 + key % 7).alias("naxis1"), (80 + key % 5).alias("naxis2"), (1 + (key % 3) / F.lit(4.0)).alias("scale"))
    return project.output_grid(headers, ["c_nationkey"])


_SEP = "degrees(2 * asin(sqrt(least(1.0, pow(sin(radians(b.dec - a.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(b.ra - a.ra) / 2), 2)))))"


@query(f"WITH p AS (SELECT s_suppkey AS k, (s_suppkey * 7 % 360) / 1.0 AS ra, s_acctbal / 200 AS dec FROM supplier) SELECT a.k AS a, b.k AS b, {rs(_SEP)} AS separation FROM p a JOIN p b ON a.k < b.k WHERE {_SEP} < 25.0")
def angular_groups(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 7 % 360).cast("double").alias("ra"), (F.col("s_acctbal") / 200).alias("dec"))
    return project.angular_neighbours(p, p, "k", 25.0).select("a", "b", r("separation").alias("separation"))


@query("WITH w AS (SELECT s_suppkey, s_acctbal / 1e7 AS cd11, 1e-5 AS cd12, -2e-5 AS cd21, s_acctbal / 2e7 AS cd22 FROM supplier) SELECT s_suppkey, (round(sqrt(cd11 * cd11 + cd21 * cd21) * 3600, 6) + 0.0) AS cdelt1, (round(sqrt(cd12 * cd12 + cd22 * cd22) * 3600, 6) + 0.0) AS cdelt2, sqrt(cd11 * cd11 + cd21 * cd21) * 3600 BETWEEN 0.05 AND 20000 AND sqrt(cd12 * cd12 + cd22 * cd22) * 3600 BETWEEN 0.05 AND 20000 AS celestial FROM w")
def wcs_canonical_scale(spark, d):
    w = {"cd11": F.col("s_acctbal") / 1e7, "cd12": F.lit(1e-5), "cd21": F.lit(-2e-5), "cd22": F.col("s_acctbal") / 2e7}
    one, two = wcs.plane_scales(w)
    return table(spark, d, "supplier").select("s_suppkey", r(one * 3600).alias("cdelt1"), r(two * 3600).alias("cdelt2"), wcs.is_celestial(w).alias("celestial"))


_TAN = {"crval1": "10.0", "crval2": "20.0", "crpix1": "4.5", "crpix2": "4.5", "cd11": repr(-2.9 / 250.0 * 206.265 / 3600), "cd12": "0.0", "cd21": "0.0", "cd22": repr(2.9 / 250.0 * 206.265 / 3600)}


def _tan_sql() -> str:
    u, v = f"radians({_TAN['cd11']} * (x - 3.5))", f"radians({_TAN['cd22']} * (y - 3.5))"
    down = f"(cos(radians(20.0)) - {v} * sin(radians(20.0)))"
    return f"{rs(f'10.0 + degrees(atan2({u}, {down}))')} AS ra, {rs(f'degrees(atan2(sin(radians(20.0)) + {v} * cos(radians(20.0)), sqrt({u} * {u} + {down} * {down})))')} AS dec, 0.0::DOUBLE AS error"


@query(f"WITH {PX} SELECT frame_id, y, x, {_tan_sql()} FROM px")
def sky_round_trip(spark, d):
    """Pixels to sky and back under a TAN grid; the error column is 0 to a millionth."""
    w = {k: F.lit(float(v)) for k, v in wcs.synthetic(10.0, 20.0, 250.0, 2.9, 8, 8).items()}
    ra, dec = wcs.pixel_to_sky(F.col("x"), F.col("y"), w)
    sky = frames(spark, d).select("frame_id", "y", "x", ra.alias("ra"), dec.alias("dec"))
    bx, by = wcs.sky_to_pixel(F.col("ra"), F.col("dec"), w)
    return sky.select("frame_id", "y", "x", r("ra").alias("ra"), r("dec").alias("dec"), r(F.abs(bx - F.col("x")) + F.abs(by - F.col("y"))).alias("error"))


# Neighbourhoods and display


_BOX = "o AS (SELECT a.range AS dy, b.range AS dx FROM range(-1, 2) a, range(-1, 2) b), h AS (SELECT t.frame_id, t.y, t.x, t.v, median(c.v) AS med, avg(m.v) AS m, avg(m.v * m.v) AS m2 FROM (SELECT px.*, least(greatest(y + dy, 0), 7) AS cy, least(greatest(x + dx, 0), 7) AS cx, CASE WHEN y + dy < 0 THEN 1 WHEN y + dy > 7 THEN 6 ELSE y + dy END AS my, CASE WHEN x + dx < 0 THEN 1 WHEN x + dx > 7 THEN 6 ELSE x + dx END AS mx FROM px, o) t JOIN px c ON c.frame_id = t.frame_id AND c.y = t.cy AND c.x = t.cx JOIN px m ON m.frame_id = t.frame_id AND m.y = t.my AND m.x = t.mx GROUP BY 1, 2, 3, 4), b AS (SELECT frame_id, y, x, v, med, greatest(sqrt(greatest(m2 - m * m, 1e-10)), 1e-5) AS sd FROM h)"


@query(f"WITH {PX}, {_BOX} SELECT frame_id, y, x, {rs('CASE WHEN v > med + 1.5 * sd THEN med ELSE v END')} AS v, v > med + 1.5 * sd AS hot FROM b")
def hot_pixels(spark, d):
    return spatial.hot_pixels(frames(spark, d), ["frame_id"], 1.5, 3).select("frame_id", "y", "x", r("v").alias("v"), "hot")


@query(f"WITH {PX} SELECT frame_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, {rs('avg(v)')} AS v FROM px GROUP BY 1, 2, 3")
def downsample_area(spark, d):
    return spatial.downsample(frames(spark, d), ["frame_id"], 2).select("frame_id", "y", "x", r("v").alias("v"))


@query(f"WITH {PX} SELECT frame_id, y - 1 AS y, x - 1 AS x, {rs('v')} AS v FROM px WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6")
def edge_crop(spark, d):
    return spatial.edge_crop(frames(spark, d), 8, 8, 0.2).select("frame_id", "y", "x", r("v").alias("v"))


@query(f"WITH {PX}, c AS (SELECT *, greatest(v - 0.1, 0) AS w FROM px), b AS (SELECT frame_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM c WHERE w > 0 GROUP BY 1) SELECT frame_id, y - y0 AS y, x - x0 AS x, {rs('v')} AS v, y0 AS dy, x0 AS dx FROM c JOIN b USING (frame_id) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1")
def crop_to_footprint(spark, d):
    px = frames(spark, d).withColumn("w", F.greatest(F.col("v") - 0.1, F.lit(0.0)))
    return spatial.crop_to_coverage(px, ["frame_id"]).select("frame_id", "y", "x", r("v").alias("v"), "dy", "dx")


@query(f"WITH {PX} SELECT frame_id, {rs('greatest(least(quantile_cont(CASE WHEN v > 0 THEN v END, 0.1), quantile_cont(CASE WHEN v > 0 THEN v END, 0.5)), 0.01)')} AS threshold FROM px GROUP BY 1")
def low_weight_mask(spark, d):
    return spatial.low_weight_threshold(frames(spark, d), ["frame_id"], "v", 0.01).select("frame_id", r("threshold").alias("threshold"))


@query(f"WITH {PX} SELECT batch_id, {rs('sum(v * least(least(y, 7 - y, x, 7 - x) / 3.0, 1.0))')} AS masked FROM px GROUP BY 1")
def edge_mask(spark, d):
    return frames(spark, d).groupBy("batch_id").agg(r(F.sum(F.col("v") * spatial.edge_mask(F.col("y"), F.col("x"), 8, 8, 3))).alias("masked"))


_K = "exp(-d * d / 2.0)"


@query(f"WITH {PX}, k AS (SELECT range AS d, exp(-range * range / 2.0) AS k FROM range(-2, 3)), a AS (SELECT frame_id, y, x + d AS x, sum(v * k) / sum(k) AS v FROM px, k WHERE x + d BETWEEN 0 AND 7 GROUP BY ALL) SELECT frame_id, CAST(y + d AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {rs('sum(v * k) / sum(k)')} AS v FROM a, k WHERE y + d BETWEEN 0 AND 7 GROUP BY 1, 2, 3".replace("GROUP BY ALL) SELECT", "GROUP BY frame_id, y, x + d) SELECT"))
def gaussian_blur(spark, d):
    return spatial.gaussian(frames(spark, d), ["frame_id"], 1.0, 2).select("frame_id", "y", "x", r("v").alias("v"))


@query(f"WITH {PX}, m AS (SELECT *, CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 'R' WHEN y % 2 = 1 AND x % 2 = 1 THEN 'B' ELSE 'G' END AS c FROM px) SELECT a.frame_id, a.y, a.x, n.c, {rs('coalesce(max(CASE WHEN n.c = a.c THEN a.v END), avg(n.v))')} AS v FROM m a JOIN m n ON a.frame_id = n.frame_id AND abs(a.y - n.y) <= 1 AND abs(a.x - n.x) <= 1 GROUP BY 1, 2, 3, 4")
def debayer_bilinear(spark, d):
    return spatial.debayer_bilinear(frames(spark, d), ["frame_id"], "RGGB").select("frame_id", "y", "x", "c", r("v").alias("v"))


_HIST = "e AS (SELECT event_type, min(value) AS lo, greatest((max(value) - min(value)) * 1.001, 1e-12) AS w FROM events GROUP BY 1), c AS (SELECT event_type, CAST(floor((value - lo) / w * 256) AS INTEGER) AS bin, count(*) AS n FROM events JOIN e USING (event_type) GROUP BY 1, 2), h AS (SELECT event_type, CAST(range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM e CROSS JOIN range(256) LEFT JOIN c ON c.event_type = e.event_type AND c.bin = range)"


@query(f"WITH {_HIST.replace('SELECT event_type, CAST(range', 'SELECT e.event_type, CAST(range')} SELECT * FROM h")
def histogram256(spark, d):
    return spatial.histogram(table(spark, d, "events"), ["event_type"], "value")


@query(f"WITH {_HIST.replace('SELECT event_type, CAST(range', 'SELECT e.event_type, CAST(range')} SELECT event_type, bin, n FROM h QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, bin) = 1")
def histogram_mode(spark, d):
    return spatial.mode_bin(histogram256(spark, d), ["event_type"])


_LEV = "l AS (SELECT batch_id, quantile_cont(v, 0.01) AS black, greatest(quantile_cont(v, 0.99), quantile_cont(v, 0.01) + 1e-4) AS white, max(v) AS top FROM px GROUP BY 1)"


@query(f"WITH {PX}, {_LEV} SELECT batch_id, {rs('black')} AS black, {rs('white')} AS white FROM l")
def auto_levels(spark, d):
    return spatial.levels(frames(spark, d), ["batch_id"]).select("batch_id", r("black").alias("black"), r("white").alias("white"))


def _clip_to_one(e: str) -> str:
    return f"least(greatest({e}, 0.0), 1.0)"


_LINEAR = _clip_to_one("(v - black) / (greatest(white, black + 1e-6) - black)")
_LOG = _clip_to_one("ln(1 + 10 * greatest(v - black, 1e-10)) / ln(1 + 10 * greatest(top - black, 1e-10))")
_ASINH = f"CASE WHEN top > black THEN {_clip_to_one('asinh(10 * greatest(v - black, 0.0)) / asinh(10 * (top - black))')} ELSE 0 END"


@query(f"WITH {PX}, {_LEV} SELECT frame_id, y, x, {rs(_LINEAR)} AS linear, {rs(_LOG)} AS logarithmic, {rs(_ASINH)} AS asinh, {rs(f'pow(greatest({_LINEAR}, 1e-10), 0.5)')} AS gamma, CAST(trunc({_LINEAR} * 65535) AS INTEGER) AS u16 FROM px JOIN l USING (batch_id)")
def stretches(spark, d):
    px = frames(spark, d)
    lev = spatial.levels(px, ["batch_id"]).join(px.groupBy("batch_id").agg(F.max("v").alias("top")), "batch_id")
    v, black, white, top = map(F.col, ("v", "black", "white", "top"))
    linear = stretch.linear(v, black, white)
    return px.join(lev, "batch_id").select("frame_id", "y", "x", r(linear).alias("linear"), r(stretch.logarithmic(v, black, top)).alias("logarithmic"), r(stretch.asinh(v, black, top)).alias("asinh"), r(stretch.gamma(linear, 0.5)).alias("gamma"), stretch.quantise(linear).alias("u16"))


_PIVOT = "c AS (SELECT picture, y, x, max(CASE WHEN ch = 0 THEN v END) AS r, max(CASE WHEN ch = 1 THEN v END) AS g, max(CASE WHEN ch = 2 THEN v END) AS b FROM rgb GROUP BY 1, 2, 3)"


def _colours(spark, d):
    return _pictures(spark, d).groupBy("picture", "y", "x").agg(*(F.max(F.when(F.col("ch") == i, F.col("v"))).alias(c) for i, c in enumerate("rgb")))


@query(f"WITH {_RGB}, {_PIVOT} SELECT picture, y, x, {rs('CASE WHEN g > (r + b) / 2 THEN 0.2 * g + 0.8 * (r + b) / 2 ELSE g END')} AS g, {rs('0.299 * r + 0.587 * g + 0.114 * b')} AS luminance FROM c")
def scnr_green(spark, d):
    c = map(F.col, "rgb")
    red, green, blue = c
    return _colours(spark, d).select("picture", "y", "x", r(stretch.scnr(red, green, blue, 0.8)).alias("g"), r(stretch.luminance(red, green, blue)).alias("luminance"))


@query(f"WITH {_RGB}, m AS (SELECT ch, picture, median(v) + 3 AS med FROM rgb GROUP BY ALL), g AS (SELECT picture, med AS green FROM m WHERE ch = 1) SELECT picture, ch, {rs('least(greatest(green / med, 0.2), 5.0)')} AS gain FROM m JOIN g USING (picture)")
def auto_white_balance(spark, d):
    """By medians; white_balance_modes has the modes of the histogram."""
    med = _pictures(spark, d).groupBy("picture", "ch").agg((F.median("v") + 3).alias("med"))
    green = med.where("ch = 1").select("picture", F.col("med").alias("green"))
    gain = F.least(F.greatest(F.col("green") / F.col("med"), F.lit(0.2)), F.lit(5.0))
    return med.join(green, "picture").select("picture", "ch", r(gain).alias("gain"))


@query(f"WITH {PX} SELECT frame_id, CAST(y // 4 AS INTEGER) AS zy, CAST(x // 4 AS INTEGER) AS zx, {rs('median(v)')} AS median, {rs('stddev_pop(v)')} AS std, count(v) AS n FROM px GROUP BY 1, 2, 3")
def background_zones(spark, d):
    return spatial.zones(frames(spark, d), ["frame_id"], 4).select("frame_id", "zy", "zx", r("median").alias("median"), r("std").alias("std"), "n")


# Plans and lifecycle


@query("SELECT o_orderpriority AS batch_id, min(o_orderkey) AS first, count(*) AS frames, CAST(sum(pos * (o_orderkey % 100)) AS BIGINT) AS ordered FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS pos FROM orders) GROUP BY 1")
def plan_batches(spark, d):
    plan = table(spark, d, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_orderpriority").alias("batch_id"), F.col("o_orderkey").cast("string").alias("file_path"))
    return lifecycle.plan_positions(plan).groupBy("batch_id").agg(F.min("order").alias("first"), F.count("*").alias("frames"), F.sum(F.col("position") * (F.col("order") % 100)).alias("ordered"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 'mosaic' WHEN c_custkey % 2 = 0 THEN 'drizzle' WHEN c_custkey % 3 = 0 THEN 'classic_sumw' WHEN c_custkey % 5 = 0 THEN 'reproject_coadd' ELSE 'classic_sumw' END AS mode FROM customer")
def finalization_mode(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", lifecycle.finalization_mode(F.col("c_nationkey") == 0, k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("mode"))


@query("SELECT p_partkey, NOT (starts_with(lower(p_name), 'stack_') OR starts_with(lower(p_name), 'mosaic_final_') OR starts_with(lower(p_name), 'aligned_') OR starts_with(lower(p_name), 'drizzle_') OR starts_with(lower(p_name), 'part 1')) AS candidate FROM part")
def candidate_names(spark, d):
    return table(spark, d, "part").select("p_partkey", lifecycle.is_candidate(F.col("p_name"), (*lifecycle.OUTPUT_PREFIXES, "part 1")).alias("candidate"))


@query("SELECT count(*) AS lines, count(DISTINCT user_id) AS keys FROM events WHERE event_type NOT IN ('error')")
def header_lines(spark, d):
    """Header cards without dropped keywords: props as text values under the event type as keyword."""
    cards = table(spark, d, "events").select("user_id", F.create_map(F.col("event_type"), F.col("props")).alias("header"))
    clean = cards.withColumn("header", lifecycle.without_keywords(F.col("header"), ("error",))).where(F.size("header") > 0)
    return clean.agg(F.count("*").alias("lines"), F.countDistinct("user_id").alias("keys"))


@query(f"WITH {PX} SELECT batch_id, frame_id, {rs('avg(v) OVER (PARTITION BY batch_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING)')} AS average, count(v) OVER (PARTITION BY batch_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING) AS frames FROM (SELECT batch_id, frame_id, avg(v) AS v FROM px GROUP BY 1, 2)")
def running_average(spark, d):
    """Of the frames' mean levels, over all pixels of each."""
    levels = frames(spark, d).groupBy("batch_id", "frame_id").agg(F.avg("v").alias("v"))
    return spatial.running_average(levels, ["batch_id"], ["frame_id"], "v").select("batch_id", "frame_id", r("average").alias("average"), "frames")


@query(f"WITH {PX} SELECT batch_id, y, x, frame_id, {rs('avg(v) OVER w')} AS average, count(v) OVER w AS frames FROM px WINDOW w AS (PARTITION BY batch_id, y, x ORDER BY frame_id ROWS UNBOUNDED PRECEDING)")
def running_average_pixels(spark, d):
    """running_average of every pixel by itself."""
    return spatial.running_average(frames(spark, d), PIXEL, ["frame_id"], "v").select(*PIXEL, "frame_id", r("average").alias("average"), "frames")


@query("SELECT event_type, round(sum(value), 4) AS sum, count(*) AS wht, round(sum(value) / count(*), 6) AS value FROM events WHERE value / (1.0 + value) > 0.5 GROUP BY 1")
def live_stack_stream(spark, d):
    from lumenstack.streaming import live

    sums = live.run_once(spark, f"{d}/events.parquet", "event_type", F.col("value") / (1.0 + F.col("value")) > 0.5)
    return live.average(sums).select("event_type", r("sum", 4).alias("sum"), "wht", r("value").alias("value"))
