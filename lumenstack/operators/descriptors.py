"""Alignment by binary descriptors of stars, for frames that turn, shift and scale, and warps onto a canvas of their own.

A star's descriptor is 256 comparisons of two smoothed samples in the patch around it, turned by the direction of the patch's
intensity centroid, in four longs. Descriptors of a frame and of the reference meet where any of their bands of bits are
equal (an equi-join), and those that are each other's nearest match. The best matches of a frame vote for a transform:
pairs of them, chosen by a fixed sequence, each give a rotation, scale and shift, and the one that most matches agree with is
fitted again to these.

A frame brings at most `most` stars (the brightest), so what is grouped by frame is small. Frames without stars, with
too few matches or too few that agree have ok false and no transform. Stars whose patch is not whole inside the image have no
descriptor. Masked samples are missing samples. Tables may have any other columns; in described(), matches() and estimate() the
frame's own column is not named like one of the result or one of i, k, n, at and place.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenstack.functions import wcs
from lumenstack.operators import segments
from lumenstack.operators.stars import TRANSFORM
from lumenstack.work import materialise

BITS = 256


def pattern(radius: int) -> np.ndarray:
    """The pairs compared, (256, 2 points, y and x): normally distributed, inside the circle that stays in the patch when it turns.
    A fixed sequence, so descriptors of different runs compare."""
    rng = np.random.default_rng(radius)
    out: list[np.ndarray] = []
    while len(out) < 2 * BITS:
        p = rng.normal(0, (2 * radius + 1) / 5, 2)
        if np.hypot(*p) <= radius - 0.5:
            out.append(p)
    return np.array(out).reshape(BITS, 2, 2)


def describe_patches(patches: np.ndarray) -> np.ndarray:
    """(n, 4) longs of n square patches."""
    side = patches.shape[1]
    radius = side // 2
    padded = np.pad(patches, ((0, 0), (3, 2), (3, 2)), "edge").cumsum(1).cumsum(2)
    smooth = padded[:, 5:, 5:] - padded[:, :-5, 5:] - padded[:, 5:, :-5] + padded[:, :-5, :-5]
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    inside = np.hypot(y, x) <= radius + 0.5
    angle = np.arctan2((patches * (y * inside)).sum((1, 2)), (patches * (x * inside)).sum((1, 2)))
    py, px = pattern(radius)[..., 0], pattern(radius)[..., 1]
    cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    at_y, at_x = np.rint(sin * px + cos * py).astype(int) + radius, np.rint(cos * px - sin * py).astype(int) + radius
    seen = smooth[np.arange(len(patches))[:, None, None], at_y, at_x]
    bits = np.packbits(seen[..., 0] < seen[..., 1], axis=1)
    return np.ascontiguousarray(bits).view(np.int64)


def described(px: DataFrame, stars: DataFrame, frame: str, radius: int = 15) -> DataFrame:
    """(frame, star, sx, sy, d): the descriptor of each of the stars (frame, star, sx, sy) in px (frame, y, x, v).

    A star asks for the samples of its patch, an equi-join, not every sample for the stars around it.
    """
    side = 2 * radius + 1
    reach = F.array(*map(F.lit, range(-radius, radius + 1)))
    asked = stars.select(frame, "star", F.col("sx"), F.col("sy"), F.explode(reach).alias("dy")).withColumn("dx", F.explode(reach))
    asked = asked.select(frame, "star", "sx", "sy", ((F.col("dy") + radius) * side + F.col("dx") + radius).alias("at"), (F.round("sy").cast("int") + F.col("dy")).alias("y"), (F.round("sx").cast("int") + F.col("dx")).alias("x"))
    met = asked.join(px.select(frame, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v").where("v is not null"), [frame, "y", "x"])
    # One sample for each place of the patch, where some are repeated.
    once = met.groupBy(frame, "star", "sx", "sy", "at").agg(F.max("v").alias("v"))
    patch = once.groupBy(frame, "star", "sx", "sy").agg(F.array_sort(F.collect_list(F.struct("at", "v")))["v"].alias("patch")).where(F.size("patch") == side * side)

    def run(patches: pa.Array) -> pa.Array:
        made = describe_patches(patches.flatten().to_numpy().reshape(-1, side, side)) if len(patches) else np.zeros((0, 4), np.int64)
        return pa.ListArray.from_arrays(np.arange(len(patches) + 1, dtype=np.int32) * 4, pa.array(made.ravel()))

    return patch.select(frame, "star", "sx", "sy", F.arrow_udf(run, "array<long>")("patch").alias("d"))


def matches(own: DataFrame, reference: DataFrame, frame: str, bands: int = 32) -> DataFrame:
    """(frame, star, other, distance, sx, sy, rx, ry): stars and reference stars that are each other's nearest.

    Two descriptors meet if one of their bands of 256 / bands bits is equal: of pairs that differ in a fifth of all bits,
    997 of 1,000 meet in 32 bands, of unrelated ones an eighth. Equally near ones go by the number of the star.
    """
    width = BITS // bands
    if BITS % bands or 64 % width:
        raise ValueError("bands divide each of the four longs")

    def keyed(df: DataFrame) -> DataFrame:
        """A row a band: its number and its bits."""
        bits = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
        return bits.withColumn("k", F.expr(f"shiftrightunsigned(d[cast(i * {width} div 64 as int)], i * {width} % 64) & {2**width - 1}"))

    theirs = keyed(reference.select(F.col("star").alias("other"), F.col("sx").alias("rx"), F.col("sy").alias("ry"), "d")).withColumnRenamed("d", "rd")
    met = keyed(own).join(theirs, ["i", "k"]).select(frame, "star", "other", "sx", "sy", "rx", "ry", "d", "rd").distinct()
    gap = sum((F.bit_count(F.col("d")[i].bitwiseXOR(F.col("rd")[i])) for i in range(4)), F.lit(0))
    pairs = met.withColumn("distance", gap).drop("d", "rd")
    best = pairs.groupBy(frame, "star").agg(F.min(F.struct("distance", "other", "sx", "sy", "rx", "ry")).alias("m")).select(frame, "star", "m.*")
    back = pairs.groupBy(frame, "other").agg(F.min(F.struct("distance", "star")).alias("m")).select(frame, "other", F.col("m.star").alias("star"))
    return best.join(back, [frame, "star", "other"])


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rotation, scale and shift (2 x 3) that take a to b in the least squares."""
    ca, cb = a.mean(0), b.mean(0)
    p, q = (a - ca) @ (1, 1j), (b - cb) @ (1, 1j)
    turn = (p.conj() * q).sum() / max((p.conj() * p).sum().real, 1e-300)
    m = np.array([[turn.real, -turn.imag], [turn.imag, turn.real]])
    return np.column_stack([m, cb - m @ ca])


def consensus(a: np.ndarray, b: np.ndarray, threshold: float = 3.0, trials: int = 2000) -> tuple[np.ndarray | None, int]:
    """The transform of a onto b that most pairs of points agree with within the threshold, and how many do."""
    n = len(a)
    if n < 2:
        return None, 0
    i, j = np.triu_indices(n, 1)
    if len(i) > trials:
        pick = np.random.default_rng(n).choice(len(i), trials, replace=False)
        i, j = i[pick], j[pick]
    p, q = a @ (1, 1j), b @ (1, 1j)
    apart = np.abs(p[i] - p[j]) > 1e-9
    i, j = i[apart], j[apart]
    if not len(i):
        return None, 0
    turn = (q[i] - q[j]) / (p[i] - p[j])
    shift = q[i] - turn * p[i]
    near = np.abs(turn[:, None] * p + shift[:, None] - q) < threshold
    inside = near[near.sum(1).argmax()]
    for _ in range(3):
        m = similarity(a[inside], b[inside])
        inside = np.hypot(*(a @ m[:, :2].T + m[:, 2] - b).T) < threshold
        if inside.sum() < 2:
            return None, int(inside.sum())
    return similarity(a[inside], b[inside]), int(inside.sum())


def estimate(found: DataFrame, frame: str, frames: DataFrame, ratio: float = 0.2, least: int = 10, threshold: float = 3.0) -> DataFrame:
    """(frame, m11..m23, ok, matched): the transform of each frame onto the reference by its matches(), of which the nearest `ratio`
    (`least` at least) vote; ok if `least` agree. frames: a table with the frames to report."""
    order = Window.partitionBy(frame).orderBy("distance", "star")
    ranked = found.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(frame)))
    good = ranked.where((F.col("place") <= F.greatest(F.lit(least), F.floor(F.col("n") * ratio))) & (F.col("n") >= least))
    kind = dict(found.dtypes)[frame]

    def run(table: pa.Table) -> pa.Table:
        points = [np.column_stack([table[c].to_numpy() for c in pair]).astype(float) for pair in (("sx", "sy"), ("rx", "ry"))]
        m, n = consensus(*points, threshold)
        ok = m is not None and n >= least
        values = m.ravel().tolist() if ok else [None] * 6
        names = [x.split()[0] for x in TRANSFORM.split(", ")]
        columns = [*(pa.array([v], pa.float64()) for v in values), pa.array([ok]), pa.array([n], pa.int32())]
        return pa.table([table[frame].slice(0, 1), *columns], names=[frame, *names])

    done = good.select(frame, "sx", "sy", "rx", "ry").groupBy(frame).applyInArrow(run, f"{frame} {kind}, {TRANSFORM}")
    return frames.select(frame).distinct().join(done, frame, "left").withColumns({"ok": F.coalesce("ok", F.lit(False)), "matched": F.coalesce("matched", F.lit(0))})


def fast_transforms(px: DataFrame, name: str, reference, most: int = 750, radius: int = 15, sigma: float = 4.0, least_samples: int = 3, tile: int = 256, **votes) -> DataFrame:
    """(name, m11..m23, ok, matched) of each frame of px (name, y, x, v) onto the frame `reference`, by the stars of its
    channels' mean."""
    frame = "its_frame"  # whatever its own name
    px = px.select(F.col(name).alias(frame), "y", "x", "v")
    grey = materialise(px.groupBy(frame, "y", "x").agg(F.avg("v").alias("v")))
    found = segments.sources(segments.label(segments.over_sky(grey, [frame], sigma, subtract=True), [frame], tile), [frame], least_samples)
    order = Window.partitionBy(frame).orderBy(F.desc("peak"), "label")
    stars = found.where("sx is not null").withColumn("star", F.row_number().over(order)).where(F.col("star") <= most)
    own = materialise(described(grey, stars.select(frame, "star", "sx", "sy"), frame, radius))
    return estimate(matches(own, own.where(F.col(frame) == reference), frame), frame, px, **votes).withColumnRenamed(frame, name)


def expanded(px: DataFrame, name: str, transforms: DataFrame, h: int, w: int) -> DataFrame:
    """(name, ch, y, x, v, ok): each h x w frame warped onto a canvas that its transformed corners just fill, bilinear, what is
    beyond its border counting as 0; frames that are not ok as they are."""
    m, frame = [f"m{i}{j}" for i in (1, 2) for j in (1, 2, 3)], "its_frame"
    px, transforms = px.select(F.col(name).alias(frame), "ch", "y", "x", "v"), transforms.select(F.col(name).alias(frame), *m, "ok")
    held = px.select(frame, "ch", "y", "x", "v").join(transforms.select(frame, *m, "ok"), frame, "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    corner = lambda row, x, y: F.col(f"m{row}1") * x + F.col(f"m{row}2") * y + F.col(f"m{row}3")
    ends = [(0, 0), (w - 1, 0), (0, h - 1), (w - 1, h - 1)]
    canvas = transforms.where("ok").select(frame, *m, *(f(*(corner(row, x, y) for x, y in ends)).alias(f"{n}{axis}") for axis, row in (("x", 1), ("y", 2)) for n, f in (("low", F.least), ("high", F.greatest))))
    side = lambda axis: F.ceil(F.round(F.col(f"high{axis}") - F.col(f"low{axis}"), 6)).cast("int")
    cells = canvas.where((side("x") > 0) & (side("y") > 0)).withColumn("ty", F.explode(F.sequence(F.lit(0), side("y") - 1))).withColumn("tx", F.explode(F.sequence(F.lit(0), side("x") - 1)))
    sx, sy = wcs.inverse_affine(F.col("tx") + F.col("lowx"), F.col("ty") + F.col("lowy"), tuple(map(F.col, m)))
    wanted = cells.join(held.select(frame, "ch").distinct(), frame).select(frame, "ch", "ty", "tx", F.round(sx, 9).alias("sx"), F.round(sy, 9).alias("sy"))
    x0, y0 = F.floor("sx"), F.floor("sy")
    share = lambda a, d: 1 - a if d == 0 else a
    corners = F.array(*(F.struct((x0 + dx).cast("int").alias("x"), (y0 + dy).cast("int").alias("y"), (share(F.col("sx") - x0, dx) * share(F.col("sy") - y0, dy)).alias("f")) for dx in (0, 1) for dy in (0, 1)))
    four = wanted.select(frame, "ch", "ty", "tx", F.explode(corners).alias("c")).select(frame, "ch", "ty", "tx", "c.*")
    met = four.join(held.where("ok and v is not null").select(frame, "ch", "x", "y", "v"), [frame, "ch", "x", "y"], "left")
    done = met.groupBy(frame, "ch", "ty", "tx").agg(F.coalesce(F.sum(F.col("v") * F.col("f")), F.lit(0.0)).alias("v"))
    return done.select(frame, "ch", F.col("ty").alias("y"), F.col("tx").alias("x"), "v", F.lit(True).alias("ok")).unionByName(held.where("not ok").select(frame, "ch", "y", "x", "v", "ok")).withColumnRenamed(frame, name)


def expected_side(h: int, w: int, m: np.ndarray) -> tuple[int, int]:
    """Rows and columns of the canvas of expanded()."""
    corners = np.array([[0, 0], [w - 1, 0], [0, h - 1], [w - 1, h - 1]]) @ m[:, :2].T
    return tuple(math.ceil(round(float(np.ptp(corners[:, k])), 6)) for k in (1, 0))
