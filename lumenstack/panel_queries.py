"""Queries of drizzle by frames' own headers, final images, and display adjustments, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenstack.functions import stretch, wcs
from lumenstack.operators import colour, panels, stack
from lumenstack.plans import lifecycle
from lumenstack.queries import _PIVOT, _RGB, PIXEL, PX, _pictures, frames, query, r, rs, table

#: Pointing, optics and size of the anchor of the queries' frames.
GRID = wcs.synthetic(10.0, 20.0, 250.0, 2.9, 8, 8)


def _cards(**values) -> F.Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), (v if isinstance(v, F.Column) else F.lit(str(v))).cast("string"))))


def _headers(spark, d):
    """Frames with a shift onto the anchor by id; each 11th has no matrix, each 13th no coordinates."""
    i = F.col("vec_id")
    sky = _cards(**{k.upper() if len(k) > 4 else f"CD{k[2]}_{k[3]}": v for k, v in GRID.items() if not k.startswith("naxis")})
    moves = _cards(M11=1, M12=0, M13=(i % 4) * 0.1 + 0.06, M21=0, M22=1, M23=(i % 3) * -0.1 - 0.07)
    exposure = _cards(EXPTIME=1 + i % 3)
    none = F.create_map().cast("map<string,string>")
    header = F.map_concat(exposure, F.when(i % 13 == 0, none).otherwise(sky), F.when(i % 11 == 0, none).otherwise(moves))
    return table(spark, d, "embeddings").select(i.alias("frame_id"), header.alias("header"))


@query("SELECT vec_id AS frame_id, CASE WHEN vec_id % 11 = 0 THEN 'no matrix' ELSE 'no celestial coordinates' END AS reason FROM embeddings WHERE vec_id % 11 = 0 OR vec_id % 13 = 0")
def panel_refusals(spark, d):
    return panels.refusals(_headers(spark, d), "frame_id", local=True)


_PLACED = "p AS (SELECT batch_id, v / (1 + frame_id % 3) AS v, 2 * (x + (frame_id % 4) * 0.1::DOUBLE + 0.06::DOUBLE) + 1 AS ox, 2 * (y - (frame_id % 3) * 0.1::DOUBLE - 0.07::DOUBLE) + 1 AS oy FROM px WHERE frame_id % 11 <> 0 AND frame_id % 13 <> 0)"


@query(f"WITH {PX}, {_PLACED}, c AS (SELECT batch_id, CAST(floor(oy + 0.5) AS INTEGER) AS y, CAST(floor(ox + 0.5) AS INTEGER) AS x, v FROM p) SELECT batch_id, y, x, {rs('avg(v)')} AS sci, CAST(count(*) AS DOUBLE) AS wht FROM c WHERE x BETWEEN 0 AND 15 AND y BETWEEN 0 AND 15 GROUP BY 1, 2, 3")
def panel_drizzle(spark, d):
    """Each frame by its matrix, its anchor's sky and the grid of scale 2; counts over the exposure; flux to the nearest cell."""
    out = panels.drizzle_frames(frames(spark, d), _headers(spark, d), "frame_id", ["batch_id"], wcs.scaled_grid(GRID, 2.0), "point", units="counts", local=True)
    return out.select(*PIXEL, r("sci").alias("sci"), "wht")


_SHARE = " * ".join(f"greatest(0.0, least(o{a} + 0.5, n{a}.c + 0.5) - greatest(o{a} - 0.5, n{a}.c - 0.5))" for a in "xy")


@query(f"WITH {PX}, {_PLACED}, n AS (SELECT CAST(range AS INTEGER) AS c FROM range(16)), s AS (SELECT batch_id, ny.c AS y, nx.c AS x, v, {_SHARE} AS w FROM p, n nx, n ny WHERE abs(nx.c - ox) < 1 AND abs(ny.c - oy) < 1) SELECT batch_id, y, x, {rs('sum(v * w) / sum(w)')} AS sci, {rs('sum(w)')} AS wht FROM s GROUP BY 1, 2, 3")
def panel_drizzle_turbo(spark, d):
    """panel_drizzle with the kernel that shares by area."""
    out = panels.drizzle_frames(frames(spark, d), _headers(spark, d), "frame_id", ["batch_id"], wcs.scaled_grid(GRID, 2.0), "turbo", units="counts", local=True)
    return out.select(*PIXEL, r("sci").alias("sci"), r("wht").alias("wht"))


def _final(spark, d, linear):
    """A stack a batch whose weight is 0 on a border that the batch's parity sets."""
    px = stack.mean(frames(spark, d), PIXEL).select("batch_id", F.lit(0).alias("ch"), "y", "x", "value", F.when((F.col("y") > F.col("batch_id") % 2) & F.col("x").between(2, 6), 1.0).otherwise(0.0).alias("wht"))
    headers = px.select("batch_id").distinct().withColumn("header", _cards(CRVAL1=10.5, CRVAL2=20.25, CRPIX1=4.5, CRPIX2=4.5, RA="old"))
    out = panels.final_image(px, headers, ["batch_id"], linear=linear)
    card = lambda k: F.col("header")[k].cast("double").alias(k.lower())
    return out.select("batch_id", "y", "x", r("value").alias("value"), card("CRPIX1"), card("CRPIX2"), card("RA"), card("DEC"))


_SAVED = f"WITH {PX}, s AS (SELECT batch_id, y, x, avg(v) AS value FROM px WHERE y > batch_id % 2 AND x BETWEEN 2 AND 6 GROUP BY 1, 2, 3), q AS (SELECT batch_id, quantile_cont(value, 0.001) AS lo, quantile_cont(value, 0.999) AS hi FROM s GROUP BY 1) SELECT batch_id, CAST(y - batch_id % 2 - 1 AS INTEGER) AS y, x - 2 AS x, {{value}} AS value, 2.5::DOUBLE AS crpix1, CAST(4.5 - batch_id % 2 - 1 AS DOUBLE) AS crpix2, 10.5::DOUBLE AS ra, 20.25::DOUBLE AS dec FROM s JOIN q USING (batch_id)"


@query(_SAVED.format(value=rs("value")))
def final_image_linear(spark, d):
    return _final(spark, d, True)


@query(_SAVED.format(value=rs("CASE WHEN hi > lo THEN least(greatest((value - lo) / (hi - lo), 0.0), 1.0) ELSE 0.0 END")))
def final_image_scaled(spark, d):
    return _final(spark, d, False)


def _blend_sql(base: str, v: str, factor: float) -> str:
    return f"CAST(trunc(least(greatest(CAST({base} AS FLOAT) + CAST({factor} AS FLOAT) * CAST({v} - {base} AS FLOAT), CAST(0 AS FLOAT)), CAST(255 AS FLOAT))) AS INTEGER)"


_GREY = "((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16)"
_LEVELS = ", ".join(f"CAST(floor(least(coalesce(abs({c}), 0.0), 1.0) * 255) AS INTEGER) AS {c}" for c in "rgb")


@query(f"WITH {_RGB}, {_PIVOT}, l AS (SELECT picture, y, x, {_LEVELS} FROM c), br AS (SELECT picture, y, x, {', '.join(f'{_blend_sql(chr(48), c, 1.3)} AS {c}' for c in 'rgb')} FROM l), m AS (SELECT picture, CAST(floor(avg({_GREY}) + 0.5) AS INTEGER) AS mean FROM br GROUP BY 1), co AS (SELECT picture, y, x, {', '.join(f'{_blend_sql(chr(109) + chr(101) + chr(97) + chr(110), c, 1.7)} AS {c}' for c in 'rgb')} FROM br JOIN m USING (picture)) SELECT picture, y, x, {', '.join(f'{_blend_sql(_GREY, c, 0.6)} AS {c}' for c in 'rgb')} FROM co")
def display_adjusted(spark, d):
    """Brightness, contrast and saturation of pictures' absolute values; a missing channel is 0."""
    c = colour.pivoted(_pictures(spark, d), ["picture"]).withColumns({n: F.abs(n) for n in "rgb"})
    return colour.adjusted(c, ["picture"], 1.3, 1.7, 0.6).select("picture", "y", "x", "r", "g", "b")


@query(f"WITH {PX}, b AS (SELECT frame_id, quantile_cont(v, 0.01) + 0.001 AS black FROM px GROUP BY 1 HAVING count(v) >= 10), w AS (SELECT frame_id, quantile_cont(v, 0.99) AS white FROM px JOIN b USING (frame_id) WHERE v > black GROUP BY 1), k AS (SELECT frame_id, least(greatest(black, 0.0), 0.99) AS black, coalesce(white, 1.0) AS white FROM b LEFT JOIN w USING (frame_id)) SELECT frame_id, {rs('black')} AS black, {rs('least(greatest(white, black + 0.01), 1.0)')} AS white FROM k")
def viewer_automatic_levels(spark, d):
    return colour.automatic_levels(frames(spark, d), ["frame_id"]).select("frame_id", r("black").alias("black"), r("white").alias("white"))


@query(f"WITH {PX} SELECT frame_id, y, x, {rs('(v - 0.1) / 0.3')} AS linear, {rs('ln(1 + 10 * greatest(v - 0.1, 1e-10)) / ln(1 + 10 * 0.3::DOUBLE)')} AS log, {rs('asinh(10 * greatest(v - 0.1, 0.0)) / asinh(10 * 0.3::DOUBLE)')} AS asinh FROM px")
def viewer_stretches(spark, d):
    """Stretches of the viewer, which may leave [0, 1]."""
    ends = F.col("v"), F.lit(0.1), F.lit(0.4)
    return frames(spark, d).select("frame_id", "y", "x", r(stretch.unclipped_linear(*ends)).alias("linear"), r(stretch.unclipped_logarithmic(*ends)).alias("log"), r(stretch.unclipped_asinh(*ends)).alias("asinh"))


@query("SELECT c_custkey, 1.0 + c_custkey % 4 AS exposure, CASE WHEN c_custkey % 2 = 0 THEN 'counts' ELSE 'cps' END AS units FROM customer WHERE c_custkey % 3 <> 0")
def solved_batches(spark, d):
    """Exposure and units of the batches that have coordinates; those without take no part."""
    k = F.col("c_custkey")
    none = F.create_map().cast("map<string,string>")
    sky = F.when(k % 3 == 0, none).otherwise(_cards(CRVAL1=1, CRVAL2=2, CRPIX1=3, CRPIX2=4, CDELT1=-0.1, CDELT2=0.1))
    header = F.map_concat(sky, F.when(k % 4 == 0, none).otherwise(_cards(EXPTIME=1 + k % 4)), F.when(k % 2 == 0, none).otherwise(_cards(UNITS="CPS")))
    batches = table(spark, d, "customer").select("c_custkey", header.alias("header"))
    exposure, units = lifecycle.exposure_of(F.col("header"))
    return lifecycle.solved_only(batches).select("c_custkey", exposure.cast("decimal(2,1)").alias("exposure"), units.alias("units"))
