"""Stars of frames, and the rigid transform that brings a frame onto a reference by its stars.

Detection is DataFrame functions: samples over the frame's clipped median by `sigma` clipped deviations that are
the greatest of their neighbourhood, with the flux-weighted centre of the box around them. Matching is small
arithmetic on the brightest stars of one frame (USED at most), so it runs grouped by frame in pandas.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenstack.functions import wcs
from lumenstack.operators import project, robust, spatial
from lumenstack.work import materialise

#: Brightest stars of a frame that alignment looks at.
USED = 40
TRANSFORM = "m11 double, m12 double, m13 double, m21 double, m22 double, m23 double, ok boolean, matched int"


def detect(px: DataFrame, frame: list[str], sigma: float = 5.0, size: int = 5, brightest: int | None = None) -> DataFrame:
    """(frame, sx, sy, flux, fwhm, rank): centres, flux over the sky, full width at half maximum by the second moments of
    the box, and rank by flux. brightest: only so many of each frame; all by default."""
    sky = robust.clipped_stats(px, frame).select(*frame, F.col("median").alias("_m"), F.col("std").alias("_s"))
    good = px.where(F.col("v").isNotNull()).join(sky, frame)
    above = good.withColumn("v", F.struct(F.greatest(F.col("v") - F.col("_m"), F.lit(0.0)).alias("f"), "y", "x", (F.col("v") > F.col("_m") + sigma * F.col("_s")).alias("over")))
    box = spatial.neighbourhood(above, frame, size)
    sums = box.where("v.over").groupBy(*frame, "y", "x").agg(F.max(F.struct("nv.f", (-F.col("nv.y")).alias("a"), (-F.col("nv.x")).alias("b"))).alias("top"), F.sum("nv.f").alias("flux"), F.sum(F.col("nv.f") * F.col("nv.x")).alias("fx"), F.sum(F.col("nv.f") * F.col("nv.y")).alias("fy"), F.sum(F.col("nv.f") * (F.col("nv.x") * F.col("nv.x") + F.col("nv.y") * F.col("nv.y"))).alias("f2"))
    peaks = sums.where("flux > 0 and top.a = -y and top.b = -x").select(*frame, (F.col("fx") / F.col("flux")).alias("sx"), (F.col("fy") / F.col("flux")).alias("sy"), "flux", (F.col("f2") / F.col("flux")).alias("f2"))
    wide = F.sqrt(F.greatest((F.col("f2") - F.col("sx") * F.col("sx") - F.col("sy") * F.col("sy")) / 2, F.lit(0.0)))
    peaks = peaks.withColumn("fwhm", 2.3548 * wide).drop("f2")
    order = Window.partitionBy(*frame).orderBy(F.desc("flux"), "sy", "sx")
    ranked = peaks.withColumn("rank", F.row_number().over(order))
    return ranked if brightest is None else ranked.where(F.col("rank") <= brightest)


def triangles(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of all triangles, in the order of their opposite sides, and the two ratios of their sides."""
    corners, shapes = [], []
    for t in itertools.combinations(range(len(points)), 3):
        sides = [np.hypot(*(points[t[(i + 1) % 3]] - points[t[(i + 2) % 3]])) for i in range(3)]
        order = np.argsort(sides)
        small, middle, large = (sides[i] for i in order)
        if small > 2:
            corners.append([t[i] for i in order])
            shapes.append((small / large, middle / large))
    return np.array(corners).reshape(-1, 3), np.array(shapes).reshape(-1, 2)


def rigid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rotation and shift (2 x 3, scale one) that take a to b in the least squares."""
    ca, cb = a.mean(0), b.mean(0)
    p, q = a - ca, b - cb
    angle = np.arctan2((p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]).sum(), (p * q).sum())
    r = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    return np.column_stack([r, cb - r @ ca])


def match(points: np.ndarray, reference: np.ndarray, used: int = 15, tolerance: float = 1.5) -> tuple[np.ndarray | None, int]:
    """The transform of points onto reference that most stars agree on, and how many do."""
    a, b = points[:used], reference[:used]
    (ta, sa), (tb, sb) = triangles(a), triangles(b)
    best, most = None, 0
    if len(sa) and len(sb):
        for i, shape in enumerate(sa):
            for j in np.flatnonzero(np.abs(sb - shape).max(1) < 0.01):
                m = rigid(a[ta[i]], b[tb[j]])
                moved = a @ m[:, :2].T + m[:, 2]
                n = int((np.hypot(*(moved[:, None] - b[None]).transpose(2, 0, 1)).min(1) < tolerance).sum())
                if n > most:
                    best, most = m, n
            if most >= min(len(a), len(b)) * 0.8:
                break
    if best is None or most < 3:
        return None, most
    moved = points @ best[:, :2].T + best[:, 2]
    gap = np.hypot(*(moved[:, None] - reference[None]).transpose(2, 0, 1))
    inside = gap.min(1) < tolerance
    return rigid(points[inside], reference[gap.argmin(1)[inside]]), int(inside.sum())


def align(stars: DataFrame, frame: str, reference: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """(frame, m11..m23, ok, matched) of each frame against the stars (sx, sy, rank) of one reference frame, which
    are few and go to every task. Frames that do not match have ok false and no transform; so have those of `frames`
    (a table with the column frame) that have no stars at all."""
    target = reference.orderBy("rank").limit(USED).toPandas()[["sx", "sy"]].to_numpy()
    kind = dict(stars.dtypes)[frame]

    def one(own: pd.DataFrame) -> pd.DataFrame:
        m, n = match(own.sort_values("rank")[["sx", "sy"]].to_numpy(), target)
        values = m.ravel().tolist() if m is not None else [None] * 6
        return pd.DataFrame([[own[frame].iloc[0], *values, m is not None, n]], columns=[frame, "m11", "m12", "m13", "m21", "m22", "m23", "ok", "matched"])

    found = stars.where(F.col("rank") <= USED).groupBy(frame).applyInPandas(one, f"{frame} {kind}, {TRANSFORM}")
    if frames is None:
        return found
    return frames.select(frame).distinct().join(found, frame, "left").withColumns({"ok": F.coalesce("ok", F.lit(False)), "matched": F.coalesce("matched", F.lit(0))})


def warp(px: DataFrame, frame: str, transforms: DataFrame) -> DataFrame:
    """(frame, ch, y, x, v, ok): each frame brought onto the reference by its transform, bilinear, 0 where it has
    nothing; frames that are not ok, or have no transform, as they are, with ok false."""
    m = transforms.select(frame, *(f"m{i}{j}" for i in (1, 2) for j in (1, 2, 3)), "ok")
    held = px.select(frame, "ch", "y", "x", "v").join(m, frame, "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    good = held.where("ok")
    sx, sy = wcs.inverse_affine(F.col("x").cast("double"), F.col("y").cast("double"), tuple(F.col(f"m{i}{j}") for i in (1, 2) for j in (1, 2, 3)))
    targets = good.select(frame, F.col("y").alias("ty"), F.col("x").alias("tx"), sx.alias("sx"), sy.alias("sy")).distinct()
    moved = project.reproject_bilinear(good, [frame], targets, ("ch",)).select(frame, "ch", F.col("ty").alias("y"), F.col("tx").alias("x"), "value")
    back = good.join(moved, [frame, "ch", "y", "x"], "left").select(frame, "ch", "y", "x", F.coalesce("value", F.lit(0.0)).alias("v"), "ok")
    return back.unionByName(held.where("not ok").select(frame, "ch", "y", "x", "v", "ok"))


def align_frames(px: DataFrame, frame: str, reference: int, sigma: float = 5.0) -> DataFrame:
    """warp() of all frames onto one of them, by the stars of their channels' mean."""
    grey = px.groupBy(frame, "y", "x").agg(F.avg("v").alias("v")).withColumn("ch", F.lit(0))
    found = materialise(detect(grey, [frame], sigma))
    return warp(px, frame, align(found, frame, found.where(F.col(frame) == reference), px))


def fwhm_weights(stars: DataFrame, frame: str, frames: DataFrame, least: int = 5) -> DataFrame:
    """(frame, weight): the frame's least width (0.5 at least) over its median width; 1 for frames of fewer stars."""
    own = stars.groupBy(frame).agg(F.count("*").alias("n"), F.median("fwhm").alias("med"), F.min("fwhm").alias("low"))
    value = F.when((F.col("n") >= least) & (F.col("med") > 0), F.greatest(F.col("low"), F.lit(0.5)) / F.col("med")).otherwise(1.0)
    return frames.select(frame).distinct().join(own, frame, "left").select(frame, F.coalesce(value, F.lit(1.0)).alias("weight"))
