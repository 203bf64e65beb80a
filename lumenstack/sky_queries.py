"""More queries over the driver's tables: drizzle kernels, co-addition under world coordinates, mosaics, backgrounds,
colour, and the rules of a run. They join those of queries.py, whose readings of the tables they share."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumenstack.functions import stretch, wcs
from lumenstack.operators import background, coadd, colour, drizzle, robust, spatial, stack, stars
from lumenstack.plans import lifecycle
from lumenstack.queries import _AFF, _PIVOT, _PLANE, _RGB, PIXEL, PX, _clip_to_one, _moved, _pictures, _tiles, frames, query, r, rs, table

BOX = ["frame_id", "y", "x"]


def sky_sql(x: str, y: str, w: dict[str, str]) -> tuple[str, str]:
    """Right ascension and declination of a pixel, as SQL."""
    u, v = f"({x} + 1 - {w['crpix1']})", f"({y} + 1 - {w['crpix2']})"
    xi, eta = f"radians({w['cd11']} * {u} + {w['cd12']} * {v})", f"radians({w['cd21']} * {u} + {w['cd22']} * {v})"
    d0 = f"radians({w['crval2']})"
    down = f"(cos({d0}) - {eta} * sin({d0}))"
    a = f"({w['crval1']} + degrees(atan2({xi}, {down})))"
    return f"({a} - 360 * floor({a} / 360))", f"degrees(atan2(sin({d0}) + {eta} * cos({d0}), sqrt({xi} * {xi} + {down} * {down})))"


def pixel_sql(ra: str, dec: str, w: dict[str, str]) -> tuple[str, str]:
    a, d, d0 = f"radians({ra} - {w['crval1']})", f"radians({dec})", f"radians({w['crval2']})"
    cosc = f"(sin({d0}) * sin({d}) + cos({d0}) * cos({d}) * cos({a}))"
    xi, eta = f"degrees(cos({d}) * sin({a}) / {cosc})", f"degrees((cos({d0}) * sin({d}) - sin({d0}) * cos({d}) * cos({a})) / {cosc})"
    det = f"({w['cd11']} * {w['cd22']} - {w['cd12']} * {w['cd21']})"
    return f"(({w['cd22']} * {xi} - {w['cd12']} * {eta}) / {det} + {w['crpix1']} - 1)", f"(({w['cd11']} * {eta} - {w['cd21']} * {xi}) / {det} + {w['crpix2']} - 1)"


# Drizzle


def _edge_sql(a: tuple[str, str], b: tuple[str, str]) -> str:
    (ax, ay), (bx, by) = a, b
    clip = lambda e: f"least(greatest({e}, 0.0), 1.0)"
    slope = f"(CASE WHEN abs({bx} - {ax}) > 1e-12 THEN ({by} - {ay}) / ({bx} - {ax}) ELSE 0.0 END)"
    left, right = clip(ax), clip(bx)
    low, high = f"({ay} + {slope} * ({left} - {ax}))", f"({ay} + {slope} * ({right} - {ax}))"
    under = lambda e: f"(CASE WHEN {e} <= 0 THEN 0.0 WHEN {e} >= 1 THEN {e} - 0.5 ELSE {e} * {e} / 2 END)"
    return f"(CASE WHEN abs({high} - {low}) < 1e-9 THEN ({right} - {left}) * {clip(f'({low} + {high}) / 2')} ELSE ({right} - {left}) * ({under(high)} - {under(low)}) / ({high} - {low}) END)"


_QUAD = [(-0.4, -0.4), (0.4, -0.4), (0.4, 0.4), (-0.4, 0.4)]
_CORNERS = ", ".join(f"0.9::DOUBLE * (x + ({a}::DOUBLE)) - 0.2::DOUBLE * (y + ({b}::DOUBLE)) + 0.3::DOUBLE AS q{i}x, 0.2::DOUBLE * (x + ({a}::DOUBLE)) + 0.9::DOUBLE * (y + ({b}::DOUBLE)) - 0.7::DOUBLE AS q{i}y" for i, (a, b) in enumerate(_QUAD))
_POINTS = [(f"(q{i}x - cx + 0.5)", f"(q{i}y - cy + 0.5)") for i in range(4)]
_SQUARE = f"{_AFF}, q AS (SELECT batch_id, v, {_CORNERS} FROM a WHERE ox >= -1e-9 AND ox < 8 AND oy >= -1e-9 AND oy < 8), n AS (SELECT CAST(range AS INTEGER) AS c FROM range(8)), c AS (SELECT q.*, nx.c AS cx, ny.c AS cy FROM q, n nx, n ny WHERE abs(nx.c - (q0x + q2x) / 2) < 1.5 AND abs(ny.c - (q0y + q2y) / 2) < 1.5), w AS (SELECT batch_id, cy AS y, cx AS x, v, abs({' + '.join(_edge_sql(_POINTS[i], _POINTS[(i + 1) % 4]) for i in range(4))}) / (0.64::DOUBLE * 0.85) AS w FROM c)"


@query(f"WITH {PX}, {_SQUARE} SELECT batch_id, y, x, {rs('sum(v * w) / sum(w)')} AS sci, {rs('sum(w)', 6)} AS wht FROM w WHERE w > 1e-12 GROUP BY 1, 2, 3")
def drizzle_square(spark, d):
    out = drizzle.drizzle_square(frames(spark, d), ["batch_id"], lambda x, y: wcs.affine(x, y, tuple(map(F.lit, (0.9, -0.2, 0.3, 0.2, 0.9, -0.7)))), 8, 8, 0.8)
    return out.where("wht > 1e-12").select(*PIXEL, r("sci").alias("sci"), r("wht").alias("wht"))


_GAUSS = 1.2 / 2.3548


@query(f"WITH {PX}, b AS (SELECT batch_id, v, 2 * x + 0.3::DOUBLE AS ox, 2 * y + 0.55::DOUBLE AS oy FROM px), n AS (SELECT CAST(range AS INTEGER) AS c FROM range(16)), c AS (SELECT batch_id, ny.c AS y, nx.c AS x, v, (nx.c - ox) * (nx.c - ox) + (ny.c - oy) * (ny.c - oy) AS d2 FROM b, n nx, n ny WHERE abs(nx.c - ox) <= 2.4 AND abs(ny.c - oy) <= 2.4), k AS (SELECT *, exp(-d2 / {2 * _GAUSS**2}) / {2 * math.pi * _GAUSS**2} AS g, CASE WHEN d2 <= 0.36 THEN 1.0 ELSE 0.0 END AS t FROM c) SELECT batch_id, y, x, {rs('sum(v * g) / sum(g)')} AS gaussian, {rs('sum(g)')} AS weight, {rs('CASE WHEN sum(t) > 0 THEN sum(v * t) / sum(t) END')} AS tophat FROM k GROUP BY 1, 2, 3")
def drizzle_kernels(spark, d):
    px = frames(spark, d)
    made = {k: drizzle.drizzle_kernel(px, ["batch_id"], 2 * F.col("x") + 0.3, 2 * F.col("y") + 0.55, 16, 16, k, 0.6, 2.0) for k in ("gaussian", "tophat")}
    both = made["gaussian"].select(*PIXEL, F.col("sci").alias("g"), "wht").join(made["tophat"].select(*PIXEL, F.col("sci").alias("t")), PIXEL, "left")
    return both.select(*PIXEL, r("g").alias("gaussian"), r("wht").alias("weight"), r("t").alias("tophat"))


@query(f"WITH {PX}, {_AFF} SELECT frame_id, y, x, {rs('2 * ox + 1')} AS out_x, {rs('2 * oy + 1')} AS out_y FROM a")
def sky_pixmap(spark, d):
    """The frame's transform, the reference's sky and the output grid of scale 2 composed: p goes to 2 p + 1."""
    grid = wcs.synthetic(10.0, 20.0, 250.0, 2.9, 8, 8)
    reference, output = ({k: F.lit(float(v)) for k, v in w.items()} for w in (grid, wcs.scaled_grid(grid, 2.0)))
    ox, oy = drizzle.sky_map(tuple(map(F.lit, (0.9, -0.2, 0.3, 0.2, 0.9, -0.7))), reference, output)(F.col("x").cast("double"), F.col("y").cast("double"))
    return frames(spark, d).select("frame_id", "y", "x", r(ox).alias("out_x"), r(oy).alias("out_y"))


@query(f"WITH {PX}, s AS (SELECT frame_id, batch_id, y, x, v AS sci, 1.0 + y AS wht FROM px), a AS (SELECT batch_id, y, x, sum(sci * wht) AS s, sum(wht) AS w, count(*) AS n FROM s GROUP BY 1, 2, 3), f AS (SELECT batch_id, max(w) AS top, max(n) AS n FROM a GROUP BY 1) SELECT a.batch_id, y, x, {rs('s / w')} AS divide, {rs('s / w * top')} AS \"max\", {rs('s / w * f.n')} AS n_images FROM a JOIN f USING (batch_id)")
def drizzle_integrator(spark, d):
    results = frames(spark, d).select("batch_id", "y", "x", F.col("v").alias("sci"), (1.0 + F.col("y")).alias("wht"))
    out = None
    for mode in ("divide", "max", "n_images"):
        one = drizzle.sum_of_results(results, ["y", "x"], ["batch_id"], mode).select(*PIXEL, r("value").alias(mode))
        out = one if out is None else out.join(one, PIXEL)
    return out


# World coordinates


_GRID = wcs.synthetic(150.0, 20.0, 250.0, 2.9, 9, 9)
_STEP = _GRID["cd22"]


def _tile_frames(spark, d):
    """The batches' tiles as solved frames, shifted by halves of pixels."""
    k = F.col("frame_id")
    rows = table(spark, d, "embeddings").select(F.col("label").alias("frame_id")).distinct()
    return rows.select("frame_id", F.lit(150.0).alias("crval1"), F.lit(20.0).alias("crval2"), (F.lit(_GRID["crpix1"]) + (k % 3) * 0.5 - 0.75).alias("crpix1"), (F.lit(_GRID["crpix2"]) - (k % 2) * 0.5).alias("crpix2"), F.lit(-_STEP).alias("cd11"), F.lit(0.0).alias("cd12"), F.lit(0.0).alias("cd21"), F.lit(_STEP).alias("cd22"), F.lit(8).alias("naxis1"), F.lit(8).alias("naxis2"), (1 + k % 4).alias("weight"))


@query(f"WITH {PX}, t AS (SELECT batch_id AS f, y, x, avg(v) AS v FROM px GROUP BY ALL), n AS (SELECT CAST(range AS INTEGER) AS c FROM range(9)), g AS (SELECT f, ny.c AS ty, nx.c AS tx, nx.c + (f % 3) * 0.5::DOUBLE - 0.75::DOUBLE AS sx, ny.c - (f % 2) * 0.5::DOUBLE AS sy FROM (SELECT DISTINCT f FROM t), n nx, n ny), m AS (SELECT g.f, ty, tx, sum(v * (1 - abs(x - sx)) * (1 - abs(y - sy))) AS v, sum((1 - abs(x - sx)) * (1 - abs(y - sy))) AS a FROM g JOIN t ON t.f = g.f AND abs(x - sx) < 1 AND abs(y - sy) < 1 GROUP BY 1, 2, 3) SELECT ty AS y, tx AS x, {rs('sum(v * (1 + f % 4)) / sum(1 + f % 4)')} AS value, CAST(sum(1 + f % 4) AS DOUBLE) AS coverage FROM m WHERE a > 1 - 1e-9 GROUP BY 1, 2")
def reproject_coadd_wcs(spark, d):
    out = coadd.reproject_and_coadd(_tiles(spark, d), _tile_frames(spark, d), "frame_id", _GRID, "weight")
    return coadd.covered(out).select("y", "x", r("value").alias("value"), r("coverage").alias("coverage"))


@query()
def reproject_coadd_matched(spark, d):
    """As reproject_coadd_wcs without weights, each tile first brought to the common background."""
    out = coadd.reproject_and_coadd(_tiles(spark, d).withColumn("v", F.col("v") + 10 * F.col("frame_id")), _tile_frames(spark, d), "frame_id", _GRID, match_background=True)
    return out.select("y", "x", r("value", 5).alias("value"), "coverage")


@query(f"WITH {PX}, b AS (SELECT batch_id, y, x, avg(v) AS img, count(v) AS cov FROM px GROUP BY ALL) SELECT y, x, {rs('sum(img * cov) / sum(cov)')} AS value, CAST(sum(cov) AS DOUBLE) AS coverage FROM b GROUP BY 1, 2")
def incremental_master(spark, d):
    per_batch = stack.mean(frames(spark, d), PIXEL).select(*PIXEL, F.col("value").alias("img"), F.col("n").alias("cov"))
    masters = [coadd.master_of(per_batch.where(F.col("batch_id") % 3 == k), ["y", "x"]) for k in range(3)]
    whole = coadd.merge_masters([coadd.merge_masters(masters[:2], ["y", "x"]), masters[2]], ["y", "x"])
    return coadd.master_image(whole, ["y", "x"]).select("y", "x", r("value").alias("value"), "coverage")


_BEST = f"SELECT frame_id FROM pm ORDER BY abs(median - (SELECT median(median) FROM pm)) + noise + 2 * gradient - 0.5, frame_id LIMIT 1"


@query(f"WITH {_PLANE}, tm AS (SELECT frame_id, median(v) AS med FROM t GROUP BY 1), best AS (SELECT med FROM tm WHERE frame_id = ({_BEST})) SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {rs('avg(v + (SELECT med FROM best) - tm.med)')} AS value, CAST(count(*) AS DOUBLE) AS coverage FROM t JOIN tm USING (frame_id) GROUP BY 1, 2")
def mosaic_three_pass(spark, d):
    out = coadd.assemble_mosaic(_tiles(spark, d), "frame_id")
    return out.select("y", "x", r("value").alias("value"), "coverage")


def _panels(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_nationkey", k.alias("panel"), (358.0 + (k % 40) / 10.0).alias("crval1"), (30.0 + (k % 7) / 7.0).alias("crval2"), F.lit(50.5).alias("crpix1"), F.lit(40.5).alias("crpix2"), (-0.001 - (k % 3) / 10000.0).alias("cd11"), F.lit(0.0).alias("cd12"), F.lit(0.0).alias("cd21"), F.when(k % 11 == 0, 9.0).otherwise(0.001 + (k % 3) / 10000.0).alias("cd22"), F.lit(100).alias("naxis1"), F.lit(80).alias("naxis2"))


_PANEL = {"crval1": "crval1", "crval2": "crval2", "crpix1": "50.5", "crpix2": "40.5", "cd11": "cd11", "cd12": "0.0", "cd21": "0.0", "cd22": "cd22"}
_PLANE_AT = {"crval1": "ra0", "crval2": "dec0", "crpix1": "0.0", "crpix2": "0.0", "cd11": "-step", "cd12": "0.0", "cd21": "0.0", "cd22": "step"}
_PRA, _PDEC = sky_sql("px", "py", _PANEL)
_GX, _GY = pixel_sql("ra", "dec", _PLANE_AT)
_PANELS = f"p AS (SELECT 358.0 + (s_suppkey % 40) / 10.0::DOUBLE AS crval1, 30.0 + (s_suppkey % 7) / 7.0::DOUBLE AS crval2, -0.001 - (s_suppkey % 3) / 10000.0::DOUBLE AS cd11, CASE WHEN s_suppkey % 11 = 0 THEN 9.0 ELSE 0.001 + (s_suppkey % 3) / 10000.0::DOUBLE END AS cd22 FROM supplier), ok AS (SELECT * FROM p WHERE cd22 < 5), c AS (SELECT *, a * 99.0 AS px, b * 79.0 AS py FROM ok, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(a, b)), s AS (SELECT *, {_PRA} AS ra, {_PDEC} AS dec FROM c)"


@query(f"WITH {_PANELS}, m AS (SELECT median((ra + 180) % 360 - 180) AS ra0, median(dec) AS dec0, avg((abs(cd11) + abs(cd22)) / 2) / 2 AS step FROM s), g AS (SELECT ra0, dec0, step, {_GX} AS gx, {_GY} AS gy FROM s, m) SELECT {rs('any_value(ra0)')} AS crval1, {rs('any_value(dec0)')} AS crval2, {rs('-min(gx)', 4)} AS crpix1, {rs('-min(gy)', 4)} AS crpix2, {rs('any_value(step)', 9)} AS cd22, greatest(10, CAST(ceil(max(gx) - min(gx) + 1) AS INTEGER)) AS naxis1, greatest(10, CAST(ceil(max(gy) - min(gy) + 1) AS INTEGER)) AS naxis2, (SELECT count(*) FROM p WHERE cd22 >= 6) AS dropped FROM g")
def mosaic_grid(spark, d):
    out = coadd.mosaic_grid(_panels(spark, d), 2.0)
    return out.select(r("crval1").alias("crval1"), r("crval2").alias("crval2"), r("crpix1", 4).alias("crpix1"), r("crpix2", 4).alias("crpix2"), r("cd22", 9).alias("cd22"), "naxis1", "naxis2", "dropped")


@query(f"WITH {_PANELS}, m AS (SELECT median(crval1) AS ra0, median(crval2) AS dec0, min((abs(cd11) + abs(cd22)) / 2) AS step FROM ok), g AS (SELECT {_GX} AS gx, {_GY} AS gy FROM s, m), a AS (SELECT 0.5 * atan2(2 * covar_samp(gx, gy), covar_samp(gx, gx) - covar_samp(gy, gy)) AS t FROM g), u AS (SELECT t, cos(t) * gx + sin(t) * gy AS u, cos(t) * gy - sin(t) * gx AS w FROM g, a) SELECT {rs('degrees(any_value(t))', 4)} AS angle, CAST(ceil(max(u)) - floor(min(u)) + 2 AS INTEGER) AS naxis1, CAST(ceil(max(w)) - floor(min(w)) + 2 AS INTEGER) AS naxis2 FROM u")
def rotated_grid(spark, d):
    return coadd.rotated_grid(_panels(spark, d)).select(r("angle", 4).alias("angle"), "naxis1", "naxis2")


# Backgrounds and masks


def _reflected(axis: str, last: int, once: bool = True) -> str:
    low, high = (f"-{axis}", f"{2 * last} - {axis}") if once else (f"-1 - {axis}", f"{2 * last + 1} - {axis}")
    return f"CASE WHEN {axis} < 0 THEN {low} WHEN {axis} > {last} THEN {high} ELSE {axis} END"


def blur_sql(name: str, source: str, key: str, last: int, kernel: list[float], value: str = "v", once: bool = True) -> str:
    """CTEs that end in name(key, y, x, v): source blurred along x and then y."""
    reach = len(kernel) // 2
    taps = ", ".join(f"({i - reach}, {k!r}::DOUBLE)" for i, k in enumerate(kernel))
    steps, at = [], source
    for axis, other in (("x", "y"), ("y", "x")):
        v = value if at == source else "v"
        steps.append(f"{name}_{axis} AS (SELECT {', '.join(f't.{c}' for c in (key, other, axis))}, sum(s.{v} * k) AS v FROM (SELECT DISTINCT {key}, {other}, {axis}, d, k, {_reflected(f'({axis} + d)', last, once)} AS p FROM {source}, (VALUES {taps}) AS w(d, k)) t JOIN {at} s ON s.{key} = t.{key} AND s.{other} = t.{other} AND s.{axis} = t.p GROUP BY 1, 2, 3)")
        at = f"{name}_{axis}"
    return ", ".join(steps) + f", {name} AS (SELECT * FROM {at})"


_MODEL = f"st AS (SELECT frame_id, median(v) AS m, stddev_pop(v) AS s FROM px GROUP BY 1), wk AS (SELECT frame_id, y, x, CASE WHEN v > m + 3 * s THEN m ELSE v END AS v FROM px JOIN st USING (frame_id)), sm AS (SELECT frame_id, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM wk GROUP BY 1, 2, 3), {blur_sql('bl', 'sm', 'frame_id', 3, background.SMALL[3])}, tg AS (SELECT frame_id, CAST(y AS INTEGER) AS ty, CAST(x AS INTEGER) AS tx, least(greatest((y + 0.5) * 0.5 - 0.5, 0), 3)::DOUBLE AS sy, least(greatest((x + 0.5) * 0.5 - 0.5, 0), 3)::DOUBLE AS sx FROM px), up AS (SELECT tg.frame_id, ty AS y, tx AS x, sum(v * (1 - abs(bl.x - sx)) * (1 - abs(bl.y - sy))) AS v FROM tg JOIN bl ON bl.frame_id = tg.frame_id AND abs(bl.x - sx) < 1 AND abs(bl.y - sy) < 1 GROUP BY 1, 2, 3), tp AS (SELECT frame_id, quantile_cont(v, 0.95) AS top FROM up GROUP BY 1), md AS (SELECT frame_id, y, x, greatest(least(v, top), m - 5 * s) AS model FROM up JOIN tp USING (frame_id) JOIN st USING (frame_id))"


@query(f"WITH {PX}, {_MODEL} SELECT frame_id, y, x, {rs('model')} AS model FROM md")
def background_model(spark, d):
    return background.smooth_background(frames(spark, d), ["frame_id"], 8, 8, 2).select(*BOX, r("model").alias("model"))


@query(f"WITH {PX}, {_MODEL}, fl AS (SELECT frame_id, px.y, px.x, v - model AS v, v AS own FROM px JOIN md USING (frame_id, y, x)), lv AS (SELECT frame_id, median(v) AS after, median(own) AS level FROM fl GROUP BY 1) SELECT frame_id, y, x, {rs('v - after + level')} AS v FROM fl JOIN lv USING (frame_id)")
def interbatch_normalization(spark, d):
    px = frames(spark, d)
    return background.interbatch_normalised(px, ["frame_id"], background.smooth_background(px, ["frame_id"], 8, 8, 2)).select(*BOX, r("v").alias("v"))


_MESH = "z AS (SELECT frame_id, y // 4 AS y, x // 4 AS x, median(v) AS v FROM p4 GROUP BY 1, 2, 3), e AS (SELECT a.frame_id, a.y, a.x, median(b.v) AS v FROM z a JOIN z b ON a.frame_id = b.frame_id GROUP BY 1, 2, 3)"


def _zone_clip_sql() -> str:
    steps, last = ["z0 AS (SELECT frame_id, y, x, v, y // 4 AS zy, x // 4 AS zx FROM px)"], "z0"
    for i in range(5):
        steps.append(f"c{i} AS (SELECT frame_id, zy, zx, median(v) AS m_, stddev_pop(v) AS s_ FROM {last} GROUP BY 1, 2, 3), p{i} AS (SELECT {last}.* FROM {last} JOIN c{i} USING (frame_id, zy, zx) WHERE abs(v - m_) <= 3.0 * s_)")
        last = f"p{i}"
    return ", ".join(steps)


@query(f"WITH {PX}, {_zone_clip_sql()}, {_MESH}, tg AS (SELECT frame_id, CAST(y AS INTEGER) AS ty, CAST(x AS INTEGER) AS tx, v AS own, least(greatest((y + 0.5) * 0.25 - 0.5, 0), 1)::DOUBLE AS sy, least(greatest((x + 0.5) * 0.25 - 0.5, 0), 1)::DOUBLE AS sx FROM px) SELECT tg.frame_id, ty AS y, tx AS x, {rs('any_value(own) - sum(v * (1 - abs(e.x - sx)) * (1 - abs(e.y - sy)))')} AS v FROM tg JOIN e ON e.frame_id = tg.frame_id AND abs(e.x - sx) < 1 AND abs(e.y - sy) < 1 GROUP BY 1, 2, 3")
def background_subtracted(spark, d):
    px = frames(spark, d)
    model = background.mesh_background(px, ["frame_id"], 8, 8, 4, 3, splines=False)
    return px.join(model, BOX).select(*BOX, r(F.col("v") - F.col("model")).alias("v"))


_WEIGHTED = "pw AS (SELECT frame_id, y, x, least(greatest(abs(v), 0.0), 1.0) AS v, 0.1 + y + x / 4.0 AS w FROM px)"


def _weighted(spark, d):
    return frames(spark, d).withColumns({"v": F.least(F.abs("v"), F.lit(1.0)), "w": 0.1 + F.col("y") + F.col("x") / 4.0})


@query(f"WITH {PX}, {_WEIGHTED}, {blur_sql('wb', 'pw', 'frame_id', 7, background.SMALL[5], 'w')}, fl AS (SELECT frame_id, greatest(quantile_cont(w, 0.01), 1e-5) AS f FROM pw WHERE w > 1e-6 GROUP BY 1), gn AS (SELECT pw.frame_id, pw.y, pw.x, least(greatest(wb.v / greatest(w, f), 0.5), 2.0) AS v FROM pw JOIN wb USING (frame_id, y, x) JOIN fl USING (frame_id)), {blur_sql('gb', 'gn', 'frame_id', 7, background.SMALL[5])} SELECT frame_id, y, x, {rs('least(greatest(pw.v * gb.v, 0), 1)')} AS v FROM pw JOIN gb USING (frame_id, y, x)")
def feather_by_weight(spark, d):
    return background.feather(_weighted(spark, d), ["frame_id"], 8, 8, reach=5).select(*BOX, r("v").alias("v"))


@query(f"WITH {PX}, {_WEIGHTED}, th AS (SELECT frame_id, greatest(least(quantile_cont(w, 0.1), median(w)), 1e-5) AS t, median(v) AS fill FROM pw GROUP BY 1), bn AS (SELECT frame_id, y, x, CAST(w > t AS INTEGER)::DOUBLE AS v FROM pw JOIN th USING (frame_id)), {blur_sql('sb', 'bn', 'frame_id', 7, background.SMALL[5])}, nw AS (SELECT pw.frame_id, pw.y, pw.x, pw.v AS own, least(greatest(pw.v * sb.v + fill * (1 - sb.v), 0), 1) AS v FROM pw JOIN sb USING (frame_id, y, x) JOIN th USING (frame_id)), dy AS (SELECT frame_id, max(v) - min(v) >= 0.05 AS ok FROM nw GROUP BY 1) SELECT frame_id, y, x, {rs('CASE WHEN ok THEN v ELSE own END')} AS v, ok AS masked FROM nw JOIN dy USING (frame_id)")
def low_weight_blend(spark, d):
    return background.low_weight_blend(_weighted(spark, d), ["frame_id"], 8, 8, reach=4).select(*BOX, r("v").alias("v"), "masked")


@query(f"WITH {PX}, pw AS (SELECT batch_id, y, x, avg(v) AS v, CAST(y + 1 AS DOUBLE) AS w FROM px GROUP BY ALL), {blur_sql('cb', 'pw', 'batch_id', 7, background.gaussian_kernel(9, 1.0), 'w', False)}, tp AS (SELECT batch_id, max(v) AS top FROM cb GROUP BY 1) SELECT batch_id, y, x, {rs('CASE WHEN cb.v < 0.4 * top THEN 0 ELSE pw.v END')} AS v FROM pw JOIN cb USING (batch_id, y, x) JOIN tp USING (batch_id)")
def coverage_masked(spark, d):
    tiles = stack.mean(frames(spark, d), PIXEL).select(*PIXEL, F.col("value").alias("v"), (F.col("y") + 1.0).alias("w"))
    return background.coverage_masked(tiles, ["batch_id"], 8, 8, 0.4).select(*PIXEL, r("v").alias("v"))


@query(f"WITH {PX}, e AS (SELECT frame_id, y, x, least(least(y, 7 - y, x, 7 - x) / 3.0::DOUBLE, 1.0) AS v FROM px), {blur_sql('eb', 'e', 'frame_id', 7, background.gaussian_kernel(9, 1.0), once=False)} SELECT frame_id, y, x, {rs('v')} AS mask FROM eb")
def soft_edge_mask(spark, d):
    return background.soft_edge_mask(frames(spark, d), ["frame_id"], 8, 8, 3, 1.0).select(*BOX, r("mask").alias("mask"))


_MALVAR = " ".join(f"WHEN '{name}' THEN [{', '.join(str(float(c) / 8) for row in m for c in row)}][(dy + 2) * 5 + dx + 3]" for name, m in spatial.MALVAR.items())


@query(f"WITH {PX}, o AS (SELECT a.range AS dy, b.range AS dx FROM range(-2, 3) a, range(-2, 3) b), n AS (SELECT t.frame_id, t.y, t.x, t.v AS own, dy, dx, s.v FROM (SELECT px.*, dy, dx, {_reflected('(y + dy)', 7)} AS py, {_reflected('(x + dx)', 7)} AS p FROM px, o) t JOIN px s ON s.frame_id = t.frame_id AND s.y = t.py AND s.x = t.p), f AS (SELECT frame_id, y, x, own, {', '.join(f"sum(v * CASE '{k}' {_MALVAR} END) AS f_{k}" for k in spatial.MALVAR)}, y % 2 = 0 AND x % 2 = 0 AS red, y % 2 = 1 AND x % 2 = 1 AS blue, y % 2 = 0 AS red_row FROM n GROUP BY 1, 2, 3, 4) SELECT frame_id, y, x, {rs('CASE WHEN red THEN own WHEN blue THEN f_other WHEN red_row THEN f_row ELSE f_column END')} AS r, {rs('CASE WHEN red OR blue THEN f_green ELSE own END')} AS g, {rs('CASE WHEN blue THEN own WHEN red THEN f_other WHEN red_row THEN f_column ELSE f_row END')} AS b FROM f")
def debayer_malvar(spark, d):
    return spatial.debayer_malvar(frames(spark, d), ["frame_id"], "RGGB").select(*BOX, *(r(c).alias(c) for c in "rgb"))


# Colour and display


@query(f"WITH {_RGB}, e AS (SELECT picture, ch, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM rgb GROUP BY 1, 2), b AS (SELECT picture, ch, lo, hi, least(floor((v - lo) / (hi - lo) * 256), 255) AS bin, count(*) AS n FROM rgb JOIN e USING (picture, ch) WHERE v BETWEEN lo AND hi GROUP BY ALL), m AS (SELECT picture, ch, greatest(lo + (bin + 0.5) * ((hi - lo) / 256), 1e-5) AS mode FROM b QUALIFY row_number() OVER (PARTITION BY picture, ch ORDER BY n DESC, bin) = 1) SELECT m.picture, ch, {rs('CASE WHEN ch = 1 THEN 1 ELSE least(greatest(g.mode / m.mode, 0.2), 5.0) END', 5)} AS gain FROM m JOIN (SELECT picture, mode FROM m WHERE ch = 1) g USING (picture)")
def white_balance_modes(spark, d):
    return colour.auto_white_balance(_pictures(spark, d), ["picture"]).select("picture", "ch", r("gain", 5).alias("gain"))


_SCNR = "least(greatest({0} * (0.2126 * r + 0.7152 * g + 0.0722 * b) / greatest(0.2126 * r + 0.7152 * g + 0.0722 * n, 1e-7), 0), 1)"


@query(f"WITH {_RGB}, {_PIVOT}, u AS (SELECT picture, y, x, abs(r) AS r, abs(g) AS g, abs(b) AS b FROM c), s AS (SELECT *, CASE WHEN b > (r + g) / 2 THEN 0.3 * b + 0.7 * (r + g) / 2 ELSE b END AS n FROM u) SELECT picture, y, x, {rs(_SCNR.format('r'))} AS r, {rs(_SCNR.format('g'))} AS g, {rs(_SCNR.format('n'))} AS b FROM s")
def scnr_blue(spark, d):
    c = colour.pivoted(_pictures(spark, d), ["picture"])
    out = colour.scnr(F.abs("r"), F.abs("g"), F.abs("b"), "blue", 0.7)
    return c.select("picture", "y", "x", *(r(o).alias(n) for o, n in zip(out, "rgb")))


_RATIO = "CASE WHEN count(*) FILTER (WHERE g > 1e-8) > 8 THEN median({0} / (g + 1e-8)) FILTER (WHERE g > 1e-8) ELSE 1.0 END"
_FACTOR = "least(greatest({0} * (1 - s + s * least(greatest(c{0} / greatest(l{0}, 1e-8), {1}), {2})), 0), 1)"


@query(f"WITH {_RGB}, {_PIVOT}, u AS (SELECT picture, y, x, abs(r) AS r, abs(g) AS g, abs(b) AS b, 1 - least(least(y, 7 - y, x, 7 - x) / 4.0::DOUBLE, 1.0) AS s FROM c), ce AS (SELECT picture, {_RATIO.format('r')} AS cr, {_RATIO.format('b')} AS cb FROM u WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY 1), lo AS (SELECT picture, y // 4 AS zy, x // 4 AS zx, {_RATIO.format('r')} AS lr, {_RATIO.format('b')} AS lb FROM u GROUP BY 1, 2, 3) SELECT picture, y, x, {rs(_FACTOR.format('r', 0.7, 1.3))} AS r, {rs(_FACTOR.format('b', 0.4, 1.5))} AS b FROM u JOIN ce USING (picture) JOIN lo ON lo.picture = u.picture AND zy = y // 4 AND zx = x // 4".replace("SELECT picture, y, x, (round(least(greatest(r", "SELECT u.picture, y, x, (round(least(greatest(r"))
def chromatic_balance(spark, d):
    c = colour.pivoted(_pictures(spark, d), ["picture"]).withColumns({k: F.abs(k) for k in "rgb"})
    return colour.chromatic_balance(c, ["picture"], 8, 8, 4, least=8).select("picture", "y", "x", r("r").alias("r"), r("b").alias("b"))


@query()
def neutral_background(spark, d):
    """Gains by zones of 4 x 4 pixels."""
    out = colour.neutral_background(_pictures(spark, d).withColumn("v", F.abs("v")), ["picture"], 8, 8, 2, least=8, least_side=4)
    return out.select("picture", r("red").alias("red"), r("blue").alias("blue"))


_P = "quantile_cont({0}, {1})"


@query(f"WITH {PX}, s AS (SELECT frame_id, count(*) FILTER (WHERE v > 0.001) AS n, quantile_cont(v, 0.01) FILTER (WHERE v > 0.001) AS p1, quantile_cont(v, 0.99) FILTER (WHERE v > 0.001) AS p2, quantile_cont(v, 0.005) AS q1, quantile_cont(v, 0.995) AS q2, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1), e AS (SELECT *, CASE WHEN n < 20 THEN lo ELSE p1 END AS b, CASE WHEN n < 20 THEN hi ELSE p2 END AS w FROM s), l AS (SELECT *, (q1 - b) / (w - b + 1e-9) AS l1, (q2 - b) / (w - b + 1e-9) AS h1 FROM e) SELECT frame_id, y, x, {rs(_clip_to_one('((v - b) / (w - b + 1e-9) - l1) / (h1 - l1 + 1e-9)'))} AS shown FROM px JOIN l USING (frame_id)")
def preview_stretch(spark, d):
    return colour.preview(frames(spark, d), ["frame_id"]).select(*BOX, r("shown").alias("shown"))


def _display_sql(c: str, gain: float) -> str:
    v = _clip_to_one(f"abs({c}) * {gain}")
    return rs(f"pow(greatest({_clip_to_one(f'asinh(10 * greatest({v} - 0.1, 0)) / asinh(10 * 0.8)')}, 1e-10), 0.8)")


@query(f"WITH {_RGB}, {_PIVOT} SELECT picture, y, x, {_display_sql('r', 1.2)} AS r, {_display_sql('g', 1.0)} AS g, {_display_sql('b', 0.9)} AS b FROM c")
def display_pipeline(spark, d):
    c = colour.pivoted(_pictures(spark, d), ["picture"])
    out = colour.displayed(F.abs("r"), F.abs("g"), F.abs("b"), (F.lit(1.2), F.lit(1.0), F.lit(0.9)), "asinh", F.lit(0.1), F.lit(0.9), 0.8)
    return c.select("picture", "y", "x", *(r(o).alias(n) for o, n in zip(out, "rgb")))


@query(f"WITH {_RGB}, {_PIVOT} SELECT picture, y, x, {rs('1.5 * r - 0.3 * g - 0.2 * b')} AS r, {rs('-0.1 * r + 1.2 * g - 0.1 * b')} AS g, {rs('0.0 * r - 0.4 * g + 1.4 * b')} AS b FROM c")
def colour_matrix(spark, d):
    c = colour.pivoted(_pictures(spark, d), ["picture"])
    out = colour.mixed(F.col("r"), F.col("g"), F.col("b"), [[1.5, -0.3, -0.2], [-0.1, 1.2, -0.1], [0.0, -0.4, 1.4]])
    return c.select("picture", "y", "x", *(r(o).alias(n) for o, n in zip(out, "rgb")))


@query(f"WITH {PX}, b AS (SELECT frame_id, quantile_cont(v, 0.01) + 0.001 AS black FROM px GROUP BY 1) SELECT frame_id, {rs('black')} AS black, {rs('quantile_cont(v, 0.99)')} AS white FROM px JOIN b USING (frame_id) WHERE v > black GROUP BY frame_id, black")
def viewer_levels(spark, d):
    return colour.viewer_levels(frames(spark, d), ["frame_id"]).select("frame_id", r("black").alias("black"), r("white").alias("white"))


@query(f"WITH {PX}, t AS (SELECT batch_id, y, x, avg(v) * (batch_id % 2) AS v, count(*) AS n FROM px GROUP BY batch_id, y, x), m AS (SELECT batch_id, max(abs(v)) AS top FROM t GROUP BY 1) SELECT batch_id, y, x, {rs('CASE WHEN top < 1e-12 THEN v ELSE v * n END')} AS v FROM t JOIN m USING (batch_id)")
def renormalised_by_inputs(spark, d):
    tiles = stack.mean(frames(spark, d), PIXEL).select(*PIXEL, (F.col("value") * (F.col("batch_id") % 2)).alias("v"), "n")
    return colour.by_inputs(tiles, ["batch_id"], F.col("n")).select(*PIXEL, r("v").alias("v"))


@query(f"WITH {_RGB}, {_PIVOT} SELECT picture, y, x, CASE WHEN 0.299 * r + 0.587 * g + 0.114 * b > 0.1 THEN 1.0 ELSE 0.0 END AS valid FROM c")
def luminance_mask(spark, d):
    return colour.pivoted(_pictures(spark, d), ["picture"]).select("picture", "y", "x", background.luminance_valid(F.col("r"), F.col("g"), F.col("b"), 0.1).cast("decimal(2,1)").alias("valid"))


# Stacks, normalisation and weights


@query(f"WITH {PX}, q AS (SELECT batch_id, frame_id, CASE WHEN frame_id % 3 = 0 THEN 1.0 ELSE v END AS v FROM px), p AS (SELECT batch_id, frame_id, quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.9) AS hi FROM q GROUP BY ALL), f AS (SELECT batch_id, arg_min(lo, frame_id) AS rlo, arg_min(hi, frame_id) AS rhi FROM p GROUP BY 1), c AS (SELECT batch_id, frame_id, CASE WHEN abs(hi - lo) <= 1e-5 AND abs(rhi - rlo) > 1e-5 THEN 0.0 WHEN abs(hi - lo) <= 1e-5 OR abs(rhi - rlo) <= 1e-5 THEN 1.0 ELSE (rhi - rlo) / (hi - lo) END AS a, lo, rlo FROM p JOIN f USING (batch_id)) SELECT batch_id, frame_id, {rs('a')} AS a, {rs('rlo - a * lo')} AS b FROM c")
def norm_linear_ladder(spark, d):
    px = frames(spark, d).withColumn("v", F.when(F.col("frame_id") % 3 == 0, 1.0).otherwise(F.col("v")))
    return robust.linear_fit_coefficients(px, ["batch_id"], "frame_id", ladder=True).select("batch_id", "frame_id", r("a").alias("a"), r("b").alias("b"))


_STATS = "st AS (SELECT batch_id, y, x, median(v) AS med, stddev_pop(v) AS sd FROM px GROUP BY ALL), k AS (SELECT px.*, med, sd FROM px JOIN st USING (batch_id, y, x))"


@query(f"WITH {PX}, {_STATS} SELECT batch_id, y, x, {rs('avg(v)')} AS mean, {rs('any_value(med)')} AS median, {rs('coalesce(avg(v) FILTER (WHERE abs(v - med) <= 0.1 * sd), 0)')} AS kappa, {rs('coalesce(avg(v) FILTER (WHERE abs(v - med) <= 3.0 * sd), 0)')} AS fit FROM k GROUP BY 1, 2, 3")
def stack_by_name(spark, d):
    """Four modes as the chunked entry runs them: weights of one, so pixels that keep nothing are 0."""
    px, out = frames(spark, d), None
    for name, mode, more in (("mean", "mean", {}), ("median", "median", {}), ("kappa", "kappa-sigma", {"sigma_low": 0.1, "sigma_high": 0.1}), ("fit", "linear_fit_clip", {})):
        one = stack.by_name(px, PIXEL, mode, streaming_compat=True, **more).select(*PIXEL, r("value").alias(name))
        out = one if out is None else out.join(one, PIXEL)
    return out


@query(f"WITH {PX}, s AS (SELECT batch_id, y, x, avg(v) + 1 AS v, y - 2 AS w FROM px GROUP BY ALL), m AS (SELECT b.batch_id AS b, count(*) AS overlap, median(a.v) AS ma, median(b.v) AS mb FROM s a JOIN s b ON a.y = b.y AND a.x = b.x AND b.batch_id <> 0 AND a.batch_id = 0 WHERE a.v > 0 AND b.v > 0 AND a.w > 0 AND b.w > 0 GROUP BY ALL), f AS (SELECT b AS batch_id, overlap, least(greatest(abs(ma / mb), 0.2), 5.0) AS scale FROM m) SELECT batch_id, y, x, overlap, {rs('v * scale')} AS v FROM s JOIN f USING (batch_id)")
def interbatch_match(spark, d):
    tiles = stack.mean(frames(spark, d), PIXEL).select(*PIXEL, (F.col("value") + 1).alias("v"), (F.col("y") - 2).alias("w"))
    ratio = robust.overlap_ratio(tiles.where("batch_id = 0"), tiles.where("batch_id <> 0"), ["y", "x"], ["batch_id"], 10, "w")
    return background.matched_to(tiles.where("batch_id <> 0"), ratio, ["batch_id"]).join(ratio.select("batch_id", "overlap"), "batch_id").select(*PIXEL, "overlap", r("v").alias("v"))


_EMA = "list_reduce(list_transform(embedding, lambda e: CAST(e AS DOUBLE)), lambda a, b: 0.9 * a + 0.1 * b)"


@query(f"SELECT vec_id, {rs(_EMA, 5)} AS average FROM embeddings")
def progress_average(spark, d):
    return table(spark, d, "embeddings").select("vec_id", r(spatial.moving_average(F.col("embedding").cast("array<double>")), 5).alias("average"))


# Stars


_STARS = """sk AS (SELECT CAST((s_suppkey * 7919 + s_suppkey * s_suppkey * 31) % 2003 AS DOUBLE) AS x, CAST((s_suppkey * 6007 + s_suppkey * s_suppkey * 17) % 1999 AS DOUBLE) AS y, s_acctbal + 1000 AS flux, s_suppkey % 7 / 10.0::DOUBLE AS wide FROM supplier),
sl AS (SELECT CAST(range AS INTEGER) AS frame_id, cos(radians(range * 2.0)) * x - sin(radians(range * 2.0)) * y + 5.0 * range AS sx, sin(radians(range * 2.0)) * x + cos(radians(range * 2.0)) * y - 3.0 * range AS sy, 2.0 + range + wide AS fwhm FROM sk, range(3))"""


def _star_lists(spark, d):
    """All suppliers as stars of a field, seen in the frame 0, and turned and shifted in the frames 1 and 2."""
    from pyspark.sql import Window

    k = F.col("s_suppkey")
    sky = table(spark, d, "supplier").select(((k * 7919 + k * k * 31) % 2003).cast("double").alias("x"), ((k * 6007 + k * k * 17) % 1999).cast("double").alias("y"), (F.col("s_acctbal") + 1000).alias("flux"), (k % 7 / 10.0).alias("wide"))
    seen = sky.withColumn("frame_id", F.explode(F.array(*map(F.lit, range(3)))))
    angle = F.radians(F.col("frame_id") * 2.0)
    at = seen.select("frame_id", (F.cos(angle) * F.col("x") - F.sin(angle) * F.col("y") + 5.0 * F.col("frame_id")).alias("sx"), (F.sin(angle) * F.col("x") + F.cos(angle) * F.col("y") - 3.0 * F.col("frame_id")).alias("sy"), "flux", (2.0 + F.col("frame_id") + F.col("wide")).alias("fwhm"))
    return at.withColumn("rank", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("flux"), "sx")))


@query(f"SELECT CAST(range AS INTEGER) AS frame_id, true AS ok, {rs('-2.0::DOUBLE * range', 4)} AS angle, {rs('-(cos(radians(range * 2.0)) * 5.0 * range - sin(radians(range * 2.0)) * 3.0 * range)', 3)} AS dx, {rs('sin(radians(range * 2.0)) * 5.0 * range + cos(radians(range * 2.0)) * 3.0 * range', 3)} AS dy FROM range(3) WHERE (SELECT count(*) FROM supplier) > 0")
def star_alignment(spark, d):
    found = _star_lists(spark, d)
    out = stars.align(found, "frame_id", found.where("frame_id = 0"))
    return out.select("frame_id", "ok", (r(F.degrees(F.atan2("m21", "m11")), 4) + 0.0).alias("angle"), (r("m13", 3) + 0.0).alias("dx"), (r("m23", 3) + 0.0).alias("dy"))


@query(f"WITH {_STARS} SELECT DISTINCT frame_id, CAST(round(sy) AS INTEGER) + CAST(a.range AS INTEGER) AS y, CAST(round(sx) AS INTEGER) + CAST(b.range AS INTEGER) AS x FROM sl, range(-2, 3) a, range(-2, 3) b WHERE abs(a.range) + abs(b.range) <= 2 AND CAST(round(sy) AS INTEGER) + a.range >= 0 AND CAST(round(sx) AS INTEGER) + b.range >= 0")
def star_mask(spark, d):
    return spatial.star_mask(_star_lists(spark, d), ["frame_id"])


@query(f"WITH {_STARS} SELECT frame_id, {rs('CASE WHEN count(*) >= 5 THEN greatest(min(fwhm), 0.5) / median(fwhm) ELSE 1.0 END')} AS weight FROM sl GROUP BY 1")
def fwhm_weights(spark, d):
    found = _star_lists(spark, d)
    return stars.fwhm_weights(found, "frame_id", found).select("frame_id", r("weight").alias("weight"))


# Rules of a run


@query("SELECT c_custkey, c_custkey % 3 <> 0 AND NOT (c_custkey % 4 = 0) AS between_batches, c_custkey % 5 = 0 OR c_custkey % 4 = 0 AS coadd, c_custkey % 2 = 0 AND c_custkey % 4 <> 1 AS match_background FROM customer")
def run_policy(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", lifecycle.run_policy(k % 4, k % 3 != 0, k % 5 == 0, k % 2 == 0).alias("p")).select("c_custkey", "p.*")


@query("WITH p AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' ZeSolver ' WHEN 1 THEN 'astap' WHEN 2 THEN 'none' WHEN 3 THEN 'ansvr' WHEN 4 THEN 'else' END AS pref, (c_custkey // 6) % 2 = 0 AS ready, (c_custkey // 12) % 2 = 0 AS there FROM customer), w AS (SELECT *, coalesce(lower(trim(pref)), 'none') AS wish FROM p), a AS (SELECT *, wish IN ('zesolver', 'ansvr') AS first FROM w) SELECT c_custkey, (first AND (ready OR there)) OR (wish = 'astap' AND there) AS allowed, CASE WHEN (first AND (ready OR there)) OR (wish = 'astap' AND there) THEN NULL WHEN first THEN 'zesolver_unavailable_no_astap' WHEN wish = 'astap' THEN 'astap_not_configured' ELSE 'no_solver_configured' END AS reason FROM a")
def solver_gate(spark, d):
    k = F.col("c_custkey")
    pref = F.when(k % 6 == 0, " ZeSolver ").when(k % 6 == 1, "astap").when(k % 6 == 2, "none").when(k % 6 == 3, "ansvr").when(k % 6 == 4, "else")
    gate = lifecycle.solver_gate(pref, F.expr("(c_custkey div 6) % 2 = 0"), F.expr("(c_custkey div 12) % 2 = 0"))
    return table(spark, d, "customer").select("c_custkey", gate.alias("g")).select("c_custkey", "g.*")


@query("SELECT p_partkey, p_partkey % 2 = 0 AND p_partkey % 3 = 0 AS strict, p_partkey % 2 = 0 AND (p_partkey % 3 = 0 OR p_partkey % 5 = 0) AS loose FROM part")
def wcs_predicates(spark, d):
    k = F.col("p_partkey")
    keys = lambda names: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.lit("1") for _ in names)))
    some = F.when(k % 3 == 0, keys(("CD1_1", "CD1_2", "CD2_1", "CD2_2"))).when(k % 5 == 0, keys(("PC1_1",))).otherwise(keys(("OBJECT",)))
    header = F.when(k % 2 == 0, F.map_concat(keys(("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2")), some)).otherwise(some)
    return table(spark, d, "part").select("p_partkey", lifecycle.has_wcs(header).alias("strict"), lifecycle.has_wcs_loosely(header).alias("loose"))
