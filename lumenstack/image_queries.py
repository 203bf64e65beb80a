"""Queries over whole images: segments, spline backgrounds, local contrast and denoising. They join those of queries.py.

_IMAGES reads the frames of `embeddings` as five larger images: frame k is in image k % 5, eight frames a row, in order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenstack.functions import sip
from lumenstack.operators import background, contrast, denoise, descriptors, segments
from lumenstack.queries import _RGB, PX, _clipped_sql, _pictures, frames, query, r, rs, table
from lumenstack.sky_queries import sky_sql

FRAME = ["frame_id", "y", "x"]
_IMAGES = f"{PX}, im AS (SELECT frame_id % 5 AS image, 8 * (frame_id // 5 // 8) + y AS y, 8 * (frame_id // 5 % 8) + x AS x, v FROM px)"
WIDTH = 64


def _images(spark, d):
    k = F.expr("frame_id div 5")
    y, x = 8 * F.floor(k / 8) + F.col("y"), 8 * (k % 8) + F.col("x")
    return frames(spark, d).select((F.col("frame_id") % 5).alias("image"), y.cast("int").alias("y"), x.cast("int").alias("x"), "v")


def _height(spark, d) -> int:
    """Of the largest image: one number to the driver."""
    last = table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0]
    return 8 if last is None else 8 * (last // 5 // 8 + 1)


# Segments

ROW = segments.ROW


def _segments_sql(over: str, least: int, value: str = "v") -> str:
    """CTEs from im and a condition to seg, the segments with their moments: the least place that reaches a sample labels it."""
    return f"""o AS (SELECT image, y, x, {value} AS v, y * {ROW} + x AS id FROM im WHERE {over}),
n AS (SELECT a.image, a.id, b.id AS other FROM o a JOIN o b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND b.id <> a.id),
w AS (SELECT image, id, id AS root FROM o UNION SELECT n.image, n.other, w.root FROM w JOIN n ON n.image = w.image AND n.id = w.id WHERE w.root < n.other),
l AS (SELECT o.*, root FROM o JOIN (SELECT image, id, min(root) AS root FROM w GROUP BY 1, 2) USING (image, id)),
s AS (SELECT image, root AS label, count(*) AS n, sum(v) AS flux, max(v) AS peak, sum(greatest(v, 0)) AS m, sum(greatest(v, 0) * x) / m AS sx, sum(greatest(v, 0) * y) / m AS sy, sum(greatest(v, 0) * x * x) / m - sx * sx AS xx, sum(greatest(v, 0) * y * y) / m - sy * sy AS yy, sum(greatest(v, 0) * x * y) / m - sx * sy AS xy FROM l GROUP BY 1, 2 HAVING count(*) >= {least}),
c AS (SELECT * EXCLUDE (xx, yy), xx + CASE WHEN xx * yy - xy * xy < 1.0 / 144 THEN 1.0::DOUBLE / 12 ELSE 0 END AS xx, yy + CASE WHEN xx * yy - xy * xy < 1.0 / 144 THEN 1.0::DOUBLE / 12 ELSE 0 END AS yy FROM s),
g AS (SELECT *, (xx + yy) / 2 AS half, sqrt((xx - yy) ** 2 + 4 * xy * xy) / 2 AS spread FROM c),
seg AS (SELECT *, sqrt(greatest(1 - greatest(half - spread, 0) / (half + spread), 0)) AS eccentricity, 2 * sqrt(ln(2::DOUBLE) * (half + spread + greatest(half - spread, 0))) AS fwhm FROM g)"""


def _sky_sql(sigma: float) -> str:
    return f"{_clipped_sql('image', 'im').replace('2.0 * s_', '3.0 * s_')}, sky AS (SELECT image, median(v) AS sky, stddev_pop(v) AS sd FROM p4 GROUP BY 1), raw AS (SELECT im.*, sky, v > sky + {sigma}::DOUBLE * sd AS bright FROM im JOIN sky USING (image))"


def _from_sky(sql: str) -> str:
    return sql.replace("FROM im WHERE", "FROM raw WHERE")


@query(f"WITH RECURSIVE {_IMAGES}, {_segments_sql('v > 0.15::DOUBLE', 2)} SELECT image, label, n, {rs('flux')} AS flux, {rs('peak')} AS peak, {rs('sx', 4)} AS sx, {rs('sy', 4)} AS sy, {rs('eccentricity', 3)} AS eccentricity, {rs('fwhm', 4)} AS fwhm FROM seg")
def star_segments(spark, d):
    """Segments of two samples and more, over tiles that cut them."""
    labels = segments.label(_images(spark, d).where("v > 0.15D"), ["image"], 16)
    found = segments.sources(labels, ["image"], 2)
    return found.select("image", "label", "n", r("flux").alias("flux"), r("peak").alias("peak"), r("sx", 4).alias("sx"), r("sy", 4).alias("sy"), r("eccentricity", 3).alias("eccentricity"), r("fwhm", 4).alias("fwhm"))


@query(f"WITH RECURSIVE {_IMAGES}, {_sky_sql(1.2)}, {_from_sky(_segments_sql('bright', 5))}, f AS (SELECT image, count(*) AS n, median(fwhm) AS fwhm FROM seg WHERE eccentricity < 0.8 GROUP BY 1) SELECT image, coalesce(n, 0) AS n, {rs('coalesce(fwhm, 4.0)', 4)} AS fwhm FROM (SELECT DISTINCT image FROM im) LEFT JOIN f USING (image)")
def initial_fwhm(spark, d):
    return segments.initial_fwhm(_images(spark, d), ["image"], 16, eccentricity=0.8, sigma=1.2).select("image", "n", r("fwhm", 4).alias("fwhm"))


@query(f"WITH RECURSIVE {_IMAGES}, {_sky_sql(1.0)}, {_from_sky(_segments_sql('bright', 3))} SELECT image, count(label) AS stars FROM (SELECT DISTINCT image FROM im) LEFT JOIN seg USING (image) GROUP BY 1")
def star_counts(spark, d):
    return segments.star_counts(_images(spark, d), ["image"], 16, 1.0, 3)


@query(f"WITH RECURSIVE {_IMAGES}, {_sky_sql(1.2)}, {_from_sky(_segments_sql('bright', 3, 'v - sky'))}, q AS (SELECT image, CAST(floor(sy) AS INTEGER) AS cy, CAST(floor(sx) AS INTEGER) AS cx FROM seg), e AS (SELECT max(y) AS top FROM im) SELECT DISTINCT image, CAST(cy + a AS INTEGER) AS y, CAST(cx + b AS INTEGER) AS x FROM q, e, range(-2, 3) AS ra(a), range(-2, 3) AS rb(b) WHERE abs(a) + abs(b) <= 2 AND cy + a BETWEEN 0 AND top AND cx + b BETWEEN 0 AND 63")
def segment_mask(spark, d):
    return segments.star_cells(_images(spark, d), ["image"], _height(spark, d), WIDTH, 2, 16, 1.2, 3)


@query()
def segment_fwhm_weights(spark, d):
    return segments.fwhm_weights(_images(spark, d), ["image"], _height(spark, d), WIDTH, 16, 16, least=3).select("image", "n", r("weight").alias("weight"))


# Backgrounds


def _spline_matrix(size: int, box: int) -> str:
    """What each zone's value weighs in each pixel along one axis, as rows of SQL: a dense solution, for few zones."""
    n = -(-size // box)
    system = np.zeros((n, n))
    for i in range(n):
        for j, k in ((i - 1, 1), (i, 4), (i + 1, 1)):
            system[i, min(max(j, 0), n - 1)] += k / 6
    solved = np.linalg.inv(system)
    out = []
    for p in range(size):
        at, row = (p + 0.5) / box - 0.5, np.zeros(n)
        for j in range(-2, n + 2):
            far = abs(at - j)
            row += (2 / 3 - far**2 + far**3 / 2 if far < 1 else (2 - far) ** 3 / 6 if far < 2 else 0) * solved[(-j - 1 if j < 0 else 2 * n - 1 - j if j >= n else j)]
        out += [f"({p}, {z}, {float(k)!r}::DOUBLE)" for z, k in enumerate(row)]
    return f"(VALUES {', '.join(out)})"


def _box_clip_sql(box: int) -> str:
    steps, last = [f"z0 AS (SELECT frame_id, y // {box} AS zy, x // {box} AS zx, v FROM px)"], "z0"
    for i in range(5):
        steps.append(f"c{i} AS (SELECT frame_id, zy, zx, median(v) AS m_, stddev_pop(v) AS s_ FROM {last} GROUP BY 1, 2, 3), p{i} AS (SELECT {last}.* FROM {last} JOIN c{i} USING (frame_id, zy, zx) WHERE abs(v - m_) <= 3.0 * s_)")
        last = f"p{i}"
    return ", ".join(steps)


@query(f"WITH {PX}, {_box_clip_sql(3)}, z AS (SELECT frame_id, zy, zx, median(v) AS v FROM p4 GROUP BY 1, 2, 3), k(p, z, k) AS {_spline_matrix(8, 3)}, e AS (SELECT frame_id, min(v) AS lo, max(v) AS hi FROM z GROUP BY 1), s AS (SELECT frame_id, a.p AS y, b.p AS x, sum(v * a.k * b.k) AS v FROM z JOIN k a ON a.z = zy JOIN k b ON b.z = zx GROUP BY 1, 2, 3) SELECT frame_id, y, x, {rs('least(greatest(v, lo), hi)')} AS model FROM s JOIN e USING (frame_id)")
def mesh_background_splines(spark, d):
    """Zones of 3 x 3 on 8 x 8 frames: the last ones are cut to 2."""
    return background.mesh_background(frames(spark, d), ["frame_id"], 8, 8, 3, 1).select(*FRAME, r("model").alias("model"))


# Local contrast

_EIGHT = "e AS (SELECT frame_id AS k, y, x, CAST(floor(least(greatest(2 * v + 0.5, 0), 1) * 255) AS BIGINT) AS v FROM px)"


def _clahe_sql(source: str, value: str, h: int, w: int, limit: float, tiles: int, name: str) -> str:
    """CTEs to `name`: source (k, y, x, value) with the new value as z."""
    even = h % tiles == 0 and w % tiles == 0
    ph, pw = (h, w) if even else (h + tiles - h % tiles, w + tiles - w % tiles)
    th, tw = ph // tiles, pw // tiles
    top = max(int(limit * th * tw / 256), 1)
    return f"""hy AS (SELECT range AS p, CASE WHEN range < {h} THEN range ELSE {2 * (h - 1)} - range END AS y FROM range({ph})), hx AS (SELECT range AS p, CASE WHEN range < {w} THEN range ELSE {2 * (w - 1)} - range END AS x FROM range({pw})),
h0 AS (SELECT k, hy.p // {th} AS ty, hx.p // {tw} AS tx, {value} AS i, count(*) AS n FROM {source} JOIN hy USING (y) JOIN hx USING (x) WHERE {value} IS NOT NULL GROUP BY ALL),
h1 AS (SELECT t.*, i, coalesce(n, 0) AS n FROM (SELECT DISTINCT k, ty, tx FROM h0) t CROSS JOIN (SELECT range AS i FROM range(256)) LEFT JOIN h0 USING (k, ty, tx, i)),
h2 AS (SELECT k, ty, tx, sum(greatest(n - {top}, 0)) AS excess FROM h1 GROUP BY ALL),
h3 AS (SELECT h1.*, least(n, {top}) + excess // 256 + CASE WHEN i % greatest(256 // greatest(excess % 256, 1), 1) = 0 AND i // greatest(256 // greatest(excess % 256, 1), 1) < excess % 256 THEN 1 ELSE 0 END AS c FROM h1 JOIN h2 USING (k, ty, tx)),
h4 AS (SELECT k, ty, tx, i, least(round_even(sum(c) OVER (PARTITION BY k, ty, tx ORDER BY i) * (255.0::DOUBLE / {th * tw}), 0), 255) AS m FROM h3),
h5 AS (SELECT *, y / {th}::DOUBLE - 0.5 AS fy, x / {tw}::DOUBLE - 0.5 AS fx FROM {source}),
{name} AS (SELECT h5.* EXCLUDE (fy, fx), CAST(least(greatest(round_even((a.m * (1 - (fx - floor(fx))) + b.m * (fx - floor(fx))) * (1 - (fy - floor(fy))) + (c.m * (1 - (fx - floor(fx))) + d.m * (fx - floor(fx))) * (fy - floor(fy)), 0), 0), 255) AS INTEGER) AS z FROM h5
  LEFT JOIN h4 a ON a.k = h5.k AND a.i = {value} AND a.ty = greatest(floor(fy), 0) AND a.tx = greatest(floor(fx), 0) LEFT JOIN h4 b ON b.k = h5.k AND b.i = {value} AND b.ty = greatest(floor(fy), 0) AND b.tx = least(floor(fx) + 1, {tiles - 1})
  LEFT JOIN h4 c ON c.k = h5.k AND c.i = {value} AND c.ty = least(floor(fy) + 1, {tiles - 1}) AND c.tx = greatest(floor(fx), 0) LEFT JOIN h4 d ON d.k = h5.k AND d.i = {value} AND d.ty = least(floor(fy) + 1, {tiles - 1}) AND d.tx = least(floor(fx) + 1, {tiles - 1}))"""


def _eight(spark, d):
    return frames(spark, d).withColumn("v", F.floor(F.least(F.greatest(2 * F.col("v") + 0.5, F.lit(0.0)), F.lit(1.0)) * 255))


@query(f"WITH {PX}, {_EIGHT}, {_clahe_sql('e', 'v', 8, 8, 64.0, 3, 'done')} SELECT k AS frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, z AS v FROM done")
def clahe(spark, d):
    """Three by three tiles, which do not divide the side."""
    return contrast.clahe(_eight(spark, d), ["frame_id"], 8, 8, 64.0, 3)


def _lab_sql() -> str:
    linear = lambda c: f"CASE WHEN {c} <= 0.04045::DOUBLE * 255 THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE (({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE) ** 2.4 END"
    cube = lambda t: f"CASE WHEN {t} > 0.008856::DOUBLE THEN cbrt({t}) ELSE 7.787::DOUBLE * {t} + 16.0::DOUBLE / 116 END"
    whole = lambda e: f"CAST(least(greatest(round_even({e}, 0), 0), 255) AS INTEGER)"
    return f"""t1 AS (SELECT k, y, x, {', '.join(f'{linear(c)} AS l{c}' for c in 'rgb')} FROM e8),
t2 AS (SELECT k, y, x, (0.412453::DOUBLE * lr + 0.357580::DOUBLE * lg + 0.180423::DOUBLE * lb) / 0.950456::DOUBLE AS tx_, 0.212671::DOUBLE * lr + 0.715160::DOUBLE * lg + 0.072169::DOUBLE * lb AS ty_, (0.019334::DOUBLE * lr + 0.119193::DOUBLE * lg + 0.950227::DOUBLE * lb) / 1.088754::DOUBLE AS tz_ FROM t1),
t3 AS (SELECT k, y, x, ty_, {cube('tx_')} AS ax, {cube('ty_')} AS ay, {cube('tz_')} AS az FROM t2),
lab AS (SELECT k, y, x, {whole('CASE WHEN ty_ > 0.008856::DOUBLE THEN 116 * ay - 16 ELSE 903.3::DOUBLE * ty_ END * 2.55::DOUBLE')} AS l, {whole('500 * (ax - ay) + 128')} AS ca, {whole('200 * (ay - az) + 128')} AS cb FROM t3)"""


def _rgb_sql() -> str:
    back = lambda f: f"CASE WHEN {f} <= 6.0::DOUBLE / 29 THEN ({f} - 16.0::DOUBLE / 116) / 7.787::DOUBLE ELSE {f} * {f} * {f} END"
    curve = lambda e: f"CAST(least(greatest(round_even(255 * CASE WHEN {e} <= 0.0031308::DOUBLE THEN 12.92::DOUBLE * {e} ELSE 1.055::DOUBLE * {e} ** (1 / 2.4::DOUBLE) - 0.055::DOUBLE END, 0), 0), 255) AS INTEGER)"
    return f"""b1 AS (SELECT *, z / 2.55::DOUBLE AS ll FROM cl),
b2 AS (SELECT *, CASE WHEN ll <= 0.008856::DOUBLE * 903.3 THEN ll / 903.3::DOUBLE ELSE ((ll + 16) / 116) ** 3.0 END AS yy, CASE WHEN ll <= 0.008856::DOUBLE * 903.3 THEN 7.787::DOUBLE * (ll / 903.3::DOUBLE) + 16.0::DOUBLE / 116 ELSE (ll + 16) / 116 END AS ay FROM b1),
b3 AS (SELECT *, ay + (ca - 128) / 500::DOUBLE AS ax, ay - (cb - 128) / 200::DOUBLE AS az FROM b2),
b4 AS (SELECT k, y, x, yy, ({back('ax')}) * 0.950456::DOUBLE AS xx, ({back('az')}) * 1.088754::DOUBLE AS zz FROM b3),
b5 AS (SELECT k, y, x, greatest(3.240479::DOUBLE * xx - 1.53715::DOUBLE * yy - 0.498535::DOUBLE * zz, 0) AS lr, greatest(-0.969256::DOUBLE * xx + 1.875991::DOUBLE * yy + 0.041556::DOUBLE * zz, 0) AS lg, greatest(0.055648::DOUBLE * xx - 0.204043::DOUBLE * yy + 1.057311::DOUBLE * zz, 0) AS lb FROM b4),
c8 AS (SELECT k, y, x, {curve('lr')} AS r, {curve('lg')} AS g, {curve('lb')} AS b FROM b5)"""


def _unsharp_sql(source: str) -> str:
    steps, last = [f"s0 AS (SELECT *, r AS sr, g AS sg, b AS sb FROM {source})"], "s0"
    for i in range(6):
        order = "PARTITION BY k, y ORDER BY x" if i < 3 else "PARTITION BY k, x ORDER BY y"
        soft = lambda c: f"CAST(floor((4 * s{c} + coalesce(lag(s{c}) OVER ({order}), s{c}) + coalesce(lead(s{c}) OVER ({order}), s{c})) / 6.0::DOUBLE + 0.5) AS INTEGER) AS s{c}"  # noqa: B023, E731
        steps.append(f"s{i + 1} AS (SELECT * EXCLUDE (sr, sg, sb), {', '.join(map(soft, 'rgb'))} FROM {last})")
        last = f"s{i + 1}"
    sharp = lambda c: f"CASE WHEN abs({c} - s{c}) > 3 THEN least(greatest({c} + CAST(trunc(({c} - s{c}) * 120 / 100.0::DOUBLE) AS INTEGER), 0), 255) ELSE {c} END AS {c}"
    return ", ".join([*steps, f"sh AS (SELECT k, y, x, {', '.join(map(sharp, 'rgb'))} FROM {last})"])


_LEVELS = """pv AS (SELECT picture AS k, y, x, max(v) FILTER (ch = 0) AS r, max(v) FILTER (ch = 1) AS g, max(v) FILTER (ch = 2) AS b FROM (SELECT * REPLACE (least(greatest(2 * v + 0.5, 0), 1) AS v) FROM rgb) GROUP BY ALL),
lv AS (SELECT k, quantile_cont(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0.01) AS p1, quantile_cont(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0.99) AS p2, count(r + g + b) AS n, max(greatest(coalesce(r, 0), coalesce(g, 0), coalesce(b, 0))) AS most FROM pv GROUP BY 1),
l2 AS (SELECT *, CASE WHEN n < 20 THEN 0.0 ELSE least(greatest(p1, 0), 0.9999::DOUBLE) END AS black, CASE WHEN n < 20 THEN 1.0 ELSE least(greatest(p2, least(greatest(p1, 0), 0.9999::DOUBLE) + 1e-4::DOUBLE), 1) END AS white FROM lv),
l3 AS (SELECT k, black, 10 / greatest(0.01::DOUBLE, white - black) AS scale, asinh(10 / greatest(0.01::DOUBLE, white - black) * greatest(most - black, 0)) AS whole FROM l2)"""
_CURVE = "CAST(floor(CASE WHEN whole < 1e-10 THEN 0.0 ELSE least(asinh(scale * greatest(coalesce({0}, 0) - black, 0)) / whole, 1) END * 255) AS INTEGER) AS {0}"


@query(f"WITH {_RGB}, {_LEVELS}, e8 AS (SELECT k, y, x, {', '.join(_CURVE.format(c) for c in 'rgb')} FROM pv JOIN l3 USING (k)), {_lab_sql()}, {_clahe_sql('lab', 'l', 8, 8, 2.0, 2, 'cl')}, {_rgb_sql()}, gr AS (SELECT *, (19595 * r + 38470 * g + 7471 * b + 32768) // 65536 AS grey FROM c8), sa AS (SELECT k, y, x, {', '.join(f'CAST(least(greatest(trunc(grey + 1.2::DOUBLE * ({c} - grey)), 0), 255) AS INTEGER) AS {c}' for c in 'rgb')} FROM gr), {_unsharp_sql('sa')} SELECT k AS picture, y, x, {', '.join(f'{rs(f"{c} / 255.0::DOUBLE")} AS {c}' for c in 'rgb')} FROM sh")
def enhanced_stretch(spark, d):
    scaled = _pictures(spark, d).withColumn("v", F.least(F.greatest(2 * F.col("v") + 0.5, F.lit(0.0)), F.lit(1.0)))
    colours = scaled.groupBy("picture", "y", "x").agg(*(F.max(F.when(F.col("ch") == i, F.col("v"))).alias(c) for i, c in enumerate("rgb")))
    return contrast.enhanced_stretch(colours, ["picture"], 8, 8, tiles=2, sharpen=True).select("picture", "y", "x", *(r(c).alias(c) for c in "rgb"))


# Denoising

_TURN = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"
_UNIT = (2**31 - 1) // (25 * 255)
_AT = f"8 * ({_TURN}) + ({_TURN.replace('{0}', '{1}')}) + 1"


@query(f"""WITH e AS (SELECT vec_id AS k, list_transform(embedding, lambda v: CAST(floor(least(greatest(2 * CAST(v AS DOUBLE) + 0.5, 0), 1) * 255) AS BIGINT)) AS vs FROM embeddings),
t AS (SELECT y.range AS y, x.range AS x, {_TURN.format('(y.range + a.range - 2)')} AS oy, {_TURN.format('(x.range + b.range - 2)')} AS ox,
  list({_AT.format('(y.range + p.range - 1)', '(x.range + q.range - 1)')} ORDER BY p.range, q.range) AS own, list({_AT.format('(y.range + p.range + a.range - 3)', '(x.range + q.range + b.range - 3)')} ORDER BY p.range, q.range) AS other
  FROM range(8) y, range(8) x, range(5) a, range(5) b, range(3) p, range(3) q GROUP BY y.range, x.range, a.range, b.range),
s AS (SELECT k, y, x, vs[8 * oy + ox + 1] AS v, CAST(round_even({_UNIT} * exp(-(CAST(list_sum(list_transform(range(1, 10), lambda i: (vs[own[i]] - vs[other[i]]) * (vs[own[i]] - vs[other[i]]))) AS BIGINT) >> 4) * 16 / 9.0::DOUBLE / 900), 0) AS BIGINT) AS wt FROM e, t),
f AS (SELECT k, y, x, v, CASE WHEN wt < 0.001::DOUBLE * {_UNIT} THEN 0 ELSE wt END AS wt FROM s)
SELECT k AS frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST((sum(wt * v) + sum(wt) // 2) // sum(wt) AS INTEGER) AS v FROM f GROUP BY 1, 2, 3""")
def non_local_means(spark, d):
    """Small windows over tiles of 5, so that tiles need their neighbours."""
    return denoise.non_local_means(_eight(spark, d), ["frame_id"], 8, 8, 30.0, template=3, search=5, tile=5)


# Alignment


@query(f"WITH {_IMAGES}, e AS (SELECT max(y) AS top FROM im) SELECT k, k < 3 AS ok, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 END AS m11, CASE k WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 END AS m12, CASE k WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN 3.0 END AS m13, CASE k WHEN 0 THEN 0.0 WHEN 1 THEN -1.0 WHEN 2 THEN 0.0 END AS m21, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 END AS m22, CASE k WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN CAST(top AS DOUBLE) WHEN 2 THEN -5.0::DOUBLE END AS m23 FROM e, (SELECT CAST(unnest(range(4)) AS INTEGER) AS k)".replace(".0 END", ".0::DOUBLE END"))
def fast_alignment(spark, d):
    """The image 0 as it is, turned by a right angle, and shifted, and the image 1, which is another: onto the image 0."""
    image, top = _images(spark, d), _height(spark, d) - 1
    own, y, x = image.where("image = 0"), F.col("y"), F.col("x")
    views = [own.select(F.lit(0).alias("k"), "y", "x", "v"), own.select(F.lit(1).alias("k"), x.alias("y"), (top - y).alias("x"), "v"), own.select(F.lit(2).alias("k"), (y + 5).alias("y"), (x - 3).alias("x"), "v").where("x >= 0"), image.where("image = 1").select(F.lit(3).alias("k"), "y", "x", "v")]
    px = views[0].unionByName(views[1]).unionByName(views[2]).unionByName(views[3])
    out = descriptors.fast_transforms(px, "k", 0, radius=8, sigma=1.0, tile=16, threshold=0.5)
    return out.select("k", "ok", *((r(f"m{i}{j}", 3) + 0.0).alias(f"m{i}{j}") for i in (1, 2) for j in (1, 2, 3)))


_TURNED = """t AS (SELECT frame_id, cos(radians(frame_id % 7 * 10.0)) AS c, sin(radians(frame_id % 7 * 10.0)) AS s FROM (SELECT DISTINCT frame_id FROM px)),
l AS (SELECT *, least(0, 7 * c, -7 * s, 7 * c - 7 * s) AS lx, greatest(0, 7 * c, -7 * s, 7 * c - 7 * s) AS hx, least(0, 7 * s, 7 * c, 7 * s + 7 * c) AS ly, greatest(0, 7 * s, 7 * c, 7 * s + 7 * c) AS hy FROM t),
g AS (SELECT frame_id, c, s, lx, ly, a.range AS ty, b.range AS tx FROM l, range(12) a, range(12) b WHERE a.range < ceil(round(hy - ly, 6)) AND b.range < ceil(round(hx - lx, 6))),
p AS (SELECT frame_id, ty, tx, round(c * (tx + lx) + s * (ty + ly), 9) AS sx, round(c * (ty + ly) - s * (tx + lx), 9) AS sy FROM g)"""


@query(f"WITH {PX}, {_TURNED} SELECT p.frame_id, CAST(ty AS INTEGER) AS y, CAST(tx AS INTEGER) AS x, {rs('coalesce(sum(v * (1 - abs(px.x - sx)) * (1 - abs(px.y - sy))), 0)')} AS v FROM p LEFT JOIN px ON px.frame_id = p.frame_id AND px.x BETWEEN floor(sx) AND floor(sx) + 1 AND px.y BETWEEN floor(sy) AND floor(sy) + 1 GROUP BY 1, 2, 3")
def expanded_canvas(spark, d):
    """Each frame turned by ten degrees times frame_id % 7."""
    px = frames(spark, d)
    a = F.radians(F.col("frame_id") % 7 * 10.0)
    turns = px.select("frame_id").distinct().select("frame_id", F.cos(a).alias("m11"), (-F.sin(a)).alias("m12"), F.lit(0.0).alias("m13"), F.sin(a).alias("m21"), F.cos(a).alias("m22"), F.lit(0.0).alias("m23"), F.lit(True).alias("ok"))
    return descriptors.expanded(px, "frame_id", turns, 8, 8).select(*FRAME, (r("v") + 0.0).alias("v"))


# Distortion

_SIP = {"A_ORDER": "3", "B_ORDER": "3", "A_2_0": "2.1e-6", "A_1_1": "-1.3e-6", "A_0_3": "4e-9", "B_0_2": "-3e-6", "B_1_1": "7e-7", "B_3_0": "-2e-9"}
_SKY = {"crval1": 150.2, "crval2": 40.0, "crpix1": 1000.5, "crpix2": 1001.0, "cd11": -2e-4, "cd12": 1e-5, "cd21": 1e-5, "cd22": 2e-4}
_SIP_U = "u + 2.1e-6::DOUBLE * u * u - 1.3e-6::DOUBLE * u * v + 4e-9::DOUBLE * v * v * v"
_SIP_V = "v - 3e-6::DOUBLE * v * v + 7e-7::DOUBLE * u * v - 2e-9::DOUBLE * u * u * u"


@query(f"WITH s AS (SELECT p_partkey, CAST(p_partkey * 37 % 2048 AS DOUBLE) AS x, CAST(p_partkey * 53 % 2048 AS DOUBLE) AS y FROM part), o AS (SELECT *, x + 1 - 1000.5::DOUBLE AS u, y + 1 - 1001.0::DOUBLE AS v FROM s), d AS (SELECT p_partkey, x, y, {_SIP_U} + 999.5::DOUBLE AS dx, {_SIP_V} + 1000.0::DOUBLE AS dy FROM o), q AS (SELECT p_partkey, x, y, {', '.join(f'{e} AS {n}' for e, n in zip(sky_sql('dx', 'dy', {k: f'({v!r}::DOUBLE)' for k, v in _SKY.items()}), ('ra', 'dec')))} FROM d) SELECT p_partkey, {rs('ra', 8)} AS ra, {rs('dec', 8)} AS dec, {rs('x', 5)} AS x, {rs('y', 5)} AS y FROM q")
def sip_round_trip(spark, d):
    """Parts as pixels, to the sky with distortion and back again: x and y are those that came back."""
    k = F.col("p_partkey")
    header = F.create_map(*(F.lit(x) for pair in _SIP.items() for x in pair))
    w = {n: F.lit(v) for n, v in _SKY.items()}
    px = table(spark, d, "part").select("p_partkey", (k * 37 % 2048).cast("double").alias("x"), (k * 53 % 2048).cast("double").alias("y"), sip.coefficients(header, "A", 3).alias("a"), sip.coefficients(header, "B", 3).alias("b"))
    ra, dec = sip.pixel_to_sky(F.col("x"), F.col("y"), w, F.col("a"), F.col("b"), 3)
    seen = px.select("p_partkey", "a", "b", ra.alias("ra"), dec.alias("dec"))
    back = seen.withColumn("p", sip.sky_to_pixel(F.col("ra"), F.col("dec"), w, F.col("a"), F.col("b"), 3))
    return back.select("p_partkey", r("ra", 8).alias("ra"), r("dec", 8).alias("dec"), (r("p.x", 5) + 0.0).alias("x"), (r("p.y", 5) + 0.0).alias("y"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), 'the', 'CONTINUE'), chr(10))) AS l, generate_subscripts(string_split(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), 'the', 'CONTINUE'), chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, i, regexp_replace(l, '[ \\t\\n\\x0B\\f\\r]+$', '') AS l FROM l WHERE NOT regexp_full_match(l, '[ \\t\\n\\x0B\\f\\r]*')), c AS (SELECT *, regexp_matches(l, '^[ \\t]*CONTINUE') AS on_, regexp_extract(l, '^[ \\t]*CONTINUE[ \\t\\x0B\\f]+(.*)$', 1) AS v FROM k), o AS (SELECT doc_id, i, on_ AND v = '' AS bad, on_ AND v <> '' AND left(v, 1) NOT IN ('''', '\"') AS bare, CASE WHEN NOT on_ THEN l WHEN left(v, 1) IN ('''', '\"') THEN 'CONTINUE ' || v ELSE 'CONTINUE \"' || replace(v, '\"', '\\\"') || '\"' END AS l FROM c) SELECT doc_id, md5(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT bad), '') || chr(10)) AS text_md5, count(*) FILTER (bare) AS modified, count(*) FILTER (bad) AS dropped FROM o GROUP BY 1")
def solver_text(spark, d):
    """Documents as a solver's side files, `the` read as CONTINUE; those without a line are left out."""
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("the"), F.lit("CONTINUE")).alias("text")).where(F.col("text").rlike(r"\S"))
    return docs.select("doc_id", sip.clean_text(F.col("text")).alias("c")).select("doc_id", F.md5("c.text").alias("text_md5"), "c.modified", "c.dropped")
