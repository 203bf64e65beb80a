"""Colour and display of pictures. Samples by channel are (key, ch, y, x, v), 0 to 2 red, green and blue; where a function
takes columns r, g, b, each row is a pixel with its three channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack.functions import stretch
from lumenstack.functions.stretch import clip01
from lumenstack.operators import robust


def pivoted(px: DataFrame, key: list[str]) -> DataFrame:
    """(key, y, x, r, g, b) of samples by channel."""
    return px.groupBy(*key, "y", "x").agg(*(F.max(F.when(F.col("ch") == i, F.col("v"))).alias(c) for i, c in enumerate("rgb")))


def balanced(r: Column, g: Column, b: Column, gains: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Channels times their gains, within [0, 1]."""
    return tuple(clip01(c * k) for c, k in zip((r, g, b), gains))


def channel_modes(px: DataFrame, key: list[str], bins: int = 256) -> DataFrame:
    """(key, ch, mode): centre of the fullest of `bins` equal bins from the 0.5th to the 99.5th percentile, the lowest on
    ties, 1e-5 at least."""
    ends = px.groupBy(*key, "ch").agg(F.percentile("v", F.array(F.lit(0.005), F.lit(0.995))).alias("p"))
    ends = ends.select(*key, "ch", F.col("p")[0].alias("lo"), F.when(F.col("p")[1] > F.col("p")[0], F.col("p")[1]).otherwise(F.col("p")[0] + 1e-5).alias("hi"))
    place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = px.join(ends, [*key, "ch"]).where("v between lo and hi").groupBy(*key, "ch", "lo", "hi", place.alias("bin")).agg(F.count("*").alias("n"))
    best = counts.groupBy(*key, "ch", "lo", "hi").agg((-F.max(F.struct("n", (-F.col("bin")).alias("b")))["b"]).alias("bin"))
    return best.select(*key, "ch", F.greatest(F.col("lo") + (F.col("bin") + 0.5) * ((F.col("hi") - F.col("lo")) / bins), F.lit(1e-5)).alias("mode"))


def auto_white_balance(px: DataFrame, key: list[str], low: float = 0.2, high: float = 5.0) -> DataFrame:
    """(key, ch, gain): gains that bring each channel's mode to that of green, within [low, high]; green keeps 1."""
    modes = channel_modes(px, key)
    green = modes.where("ch = 1").select(*key, F.col("mode").alias("green"))
    gain = F.when(F.col("ch") == 1, 1.0).otherwise(F.least(F.greatest(F.col("green") / F.col("mode"), F.lit(low)), F.lit(high)))
    return modes.join(green, key).select(*key, "ch", gain.alias("gain"))


def scnr(r: Column, g: Column, b: Column, channel: str = "green", amount: float = 1.0, keep_luminance: bool = True) -> tuple[Column, Column, Column]:
    """What the channel has over the mean of the other two goes, by `amount`; then all channels are scaled to the
    luminance (0.2126, 0.7152, 0.0722) that the pixel had, within [0, 1]."""
    if channel not in ("green", "blue"):
        raise ValueError(f"no such channel: {channel}")
    own, mean = (g, (r + b) / 2) if channel == "green" else (b, (r + g) / 2)
    less = F.when(own > mean, (1 - amount) * own + amount * mean).otherwise(own)
    out = (r, less, b) if channel == "green" else (r, g, less)
    if not keep_luminance:
        return tuple(map(clip01, out))
    light = lambda c: 0.2126 * c[0] + 0.7152 * c[1] + 0.0722 * c[2]
    factor = light((r, g, b)) / F.greatest(light(out), F.lit(1e-7))
    return tuple(clip01(c * factor) for c in out)


def neutral_background(px: DataFrame, key: list[str], h: int, w: int, grid: int = 16, low: float = 0.05, high: float = 0.45, spread: float = 1.5, least: int = 50, gains: tuple[float, float] = (0.2, 7.0), least_side: int = 8) -> DataFrame:
    """(key, red, blue): gains that make the background grey. Of grid x grid zones those are background whose median
    luminance lies between two percentiles of all zones' and whose deviation is at most `spread` times the median one;
    their clipped medians (2.5 deviations, 3 rounds) are compared. Pictures without such zones, or with zones
    under least_side pixels, have no row."""
    zone_h, zone_w = h // grid, w // grid
    if min(zone_h, zone_w) < least_side:
        return px.select(*key, F.lit(1.0).alias("red"), F.lit(1.0).alias("blue")).limit(0)
    inside = px.where((F.col("y") < zone_h * grid) & (F.col("x") < zone_w * grid)).withColumns({"zy": F.expr(f"y div {zone_h}"), "zx": F.expr(f"x div {zone_w}")})
    zone = [*key, "zy", "zx"]
    medians = robust.clipped_stats(inside, [*zone, "ch"]).groupBy(*zone).agg(*(F.max(F.when(F.col("ch") == i, F.col("median"))).alias(c) for i, c in enumerate("rgb")), F.sum("n").alias("n"))
    light = pivoted(inside, zone).select(*zone, "y", "x", stretch.luminance(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    zones = medians.join(robust.clipped_stats(light, zone).select(*zone, "std"), zone).withColumn("light", stretch.luminance(F.col("r"), F.col("g"), F.col("b")))
    limits = zones.groupBy(*key).agg(F.percentile("light", F.array(F.lit(low), F.lit(high))).alias("p"), F.median("std").alias("s"))
    chosen = zones.join(limits, key).where((F.col("light") >= F.col("p")[0]) & (F.col("light") <= F.col("p")[1]) & (F.col("std") <= spread * F.col("s"))).select(*zone)
    pooled = robust.clipped_stats(inside.join(chosen, zone), [*key, "ch"], 2.5, 3)
    m = pooled.groupBy(*key).agg(*(F.max(F.when(F.col("ch") == i, F.col("median"))).alias(c) for i, c in enumerate("rgb")), F.min("n").alias("n")).where(F.col("n") >= least)
    gain = lambda c: F.least(F.greatest(F.when(F.col(c) > 1e-7, F.col("g") / F.col(c)).otherwise(1.0), F.lit(gains[0])), F.lit(gains[1]))
    return m.select(*key, gain("r").alias("red"), gain("b").alias("blue"))


def chromatic_balance(pictures: DataFrame, key: list[str], h: int, w: int, border: int = 25, strength: Column | None = None, red: tuple[float, float] = (0.7, 1.3), blue: tuple[float, float] = (0.4, 1.5), least: int = 100) -> DataFrame:
    """Red and blue of (r, g, b) pictures, window by window of border x border pixels that tile the picture, scaled so
    that their median ratios to green are those of the centre half. strength: how much of it a pixel takes (by
    default 1 at the edge, falling to 0 over the border). Windows with few green pixels count as ratio 1."""
    from lumenstack.operators.spatial import edge_mask

    good, eps = F.col("g") > 1e-8, 1e-8
    ratios = lambda n: [F.when(F.count(F.when(good, 1)) > least, F.median(F.when(good, F.col(c) / (F.col("g") + eps)))).otherwise(1.0).alias(f"{n}{c}") for c in "rb"]
    half = min(h, w) // 4
    centre = pictures.where(F.col("y").between(h // 2 - half, h // 2 + half - 1) & F.col("x").between(w // 2 - half, w // 2 + half - 1)).groupBy(*key).agg(*ratios("c"))
    placed = pictures.withColumns({"_zy": F.expr(f"y div {border}"), "_zx": F.expr(f"x div {border}")})
    local = placed.groupBy(*key, "_zy", "_zx").agg(*ratios("l"))
    s = strength if strength is not None else 1 - edge_mask(F.col("y"), F.col("x"), h, w, border)
    joined = placed.join(local, [*key, "_zy", "_zx"]).join(centre, key)
    scaled = lambda c, ends: clip01(F.col(c) * (1 - s + s * F.least(F.greatest(F.col(f"c{c}") / F.greatest(F.col(f"l{c}"), F.lit(eps)), F.lit(ends[0])), F.lit(ends[1]))))
    return joined.withColumns({"r": scaled("r", red), "b": scaled("b", blue), "g": clip01(F.col("g"))}).drop("_zy", "_zx", "cr", "cb", "lr", "lb")


@robust.keeps_names("n", "p", "q", "lo", "hi", "b0", "w0", "b", "w", "l1", "h1", "t", "above", "_s", "_range", "_mean")
def preview(px: DataFrame, key: list[str], enhanced: bool = False) -> DataFrame:
    """px with `shown` in [0, 1]: black and white points at percentiles of the samples over 0.001 (1 and 99, enhanced 0.1
    and 99.5), or the extremes of images with few such samples or no range; a second stretch between the 0.5th and
    99.5th percentile if over 1e-3 apart; and a gentler one instead if the image would be white all over."""
    lit = F.when(F.col("v") > 0.001, F.col("v"))
    ends = (0.001, 0.995) if enhanced else (0.01, 0.99)
    percent = lambda c, *at: F.percentile(c, F.array(*map(F.lit, at)))
    s = px.groupBy(*key).agg(F.count(lit).alias("n"), percent(lit, *ends).alias("p"), percent(F.col("v"), 0.005, 0.995).alias("q"), percent(F.when(F.col("v") > 0, F.col("v")), 0.001, 0.999).alias("t"), F.count(F.when(F.col("v") > 0, 1)).alias("above"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    few = F.col("n") < 20
    s = s.withColumns({"b0": F.when(few, F.col("lo")).otherwise(F.col("p")[0]), "w0": F.when(few, F.col("hi")).otherwise(F.col("p")[1])})
    flat, ranged = F.col("w0") <= F.col("b0") + 1e-7, F.col("hi") > F.col("lo") + 1e-7
    s = s.withColumns({"b": F.when(~flat, F.col("b0")).when(ranged, F.col("lo")).otherwise(0.0), "w": F.when(~flat, F.col("w0")).when(ranged, F.col("hi")).otherwise(F.greatest("hi", F.lit(1e-7)))})
    once = lambda v: (v - F.col("b")) / (F.col("w") - F.col("b") + 1e-9)
    s = s.withColumns({"l1": once(F.col("q")[0]), "h1": once(F.col("q")[1])})
    twice = F.when(F.col("h1") - F.col("l1") > 1e-3, clip01((once(F.col("v")) - F.col("l1")) / (F.col("h1") - F.col("l1") + 1e-9))).otherwise(once(F.col("v")))
    shown = px.join(s.select(*key, "b", "w", "l1", "h1", "t", "above"), key).withColumn("_s", twice)
    again = shown.groupBy(*key).agg((F.max("_s") - F.min("_s")).alias("_range"), F.avg("_s").alias("_mean"))
    white = (F.col("_range") < 5e-3) & (F.col("_mean") > 0.97) & (F.col("above") > 50) & (F.col("t")[1] > F.col("t")[0] + 1e-7)
    last = F.when(white, (F.col("v") - F.col("t")[0]) / (F.col("t")[1] - F.col("t")[0] + 1e-9)).otherwise(F.col("_s"))
    return shown.join(again, key).withColumn("shown", clip01(last)).drop("b", "w", "l1", "h1", "t", "above", "_s", "_range", "_mean")


def displayed(r: Column, g: Column, b: Column, gains: tuple[Column, Column, Column], mode: str, black: Column, white: Column, gamma: float = 1.0) -> tuple[Column, ...]:
    """White balance, one of the stretches linear, asinh and log between two levels, and gamma."""
    kinds = {"linear": lambda v: stretch.linear(v, black, white), "asinh": lambda v: stretch.asinh(v, black, white), "log": lambda v: stretch.logarithmic(v, black, white)}
    return tuple(stretch.gamma(kinds[mode](v), gamma) for v in balanced(r, g, b, gains))


def adjusted(pictures: DataFrame, key: list[str], brightness: float = 1.0, contrast: float = 1.0, saturation: float = 1.0) -> DataFrame:
    """pictures with the 8-bit levels of r, g, b in [0, 1] after the three adjustments in this order: brightness blends with
    black, contrast with the picture's mean grey, saturation with each pixel's own. Factors within 1e-3 of 1 do nothing."""
    level = lambda c: F.floor(clip01(F.coalesce(F.col(c), F.lit(0.0))) * 255).cast("int")
    out = pictures.withColumns({c: level(c) for c in "rgb"})
    differs = lambda factor: abs(factor - 1) > 1e-3
    grey = lambda: stretch.grey_level(*map(F.col, "rgb"))
    if differs(brightness):
        out = out.withColumns({c: stretch.blended(F.lit(0), F.col(c), brightness) for c in "rgb"})
    if differs(contrast):
        (mean,) = robust.free_names(out, ("_mean",))
        means = out.groupBy(*key).agg(F.floor(F.avg(grey()) + 0.5).cast("int").alias(mean))
        out = out.join(means, key).withColumns({c: stretch.blended(F.col(mean), F.col(c), contrast) for c in "rgb"}).drop(mean)
    if differs(saturation):
        out = out.withColumns({c: stretch.blended(grey(), F.col(c), saturation) for c in "rgb"})
    return out


def mixed(r: Column, g: Column, b: Column, matrix: list[list[float]]) -> tuple[Column, ...]:
    """A 3 x 3 colour matrix."""
    return tuple(row[0] * r + row[1] * g + row[2] * b for row in matrix)


def viewer_levels(px: DataFrame, key: list[str]) -> DataFrame:
    """(key, black, white): the first percentile and 0.001, and the 99th percentile of the samples above it."""
    black = px.groupBy(*key).agg((F.percentile("v", F.lit(0.01)) + 0.001).alias("black"))
    return px.join(black, key).where("v > black").groupBy(*key, "black").agg(F.percentile("v", F.lit(0.99)).alias("white"))


def automatic_levels(px: DataFrame, key: list[str], least: int = 10) -> DataFrame:
    """(key, black, white) of images with enough samples: viewer_levels with a white of 1 where nothing is above black,
    black kept within [0, 0.99] and white within [black + 0.01, 1]."""
    lower = px.groupBy(*key).agg((F.percentile("v", F.lit(0.01)) + 0.001).alias("black"), F.count("v").alias("samples")).where(F.col("samples") >= least)
    upper = px.join(lower.select(*key, F.col("black").alias("floor_of_image")), key).where("v > floor_of_image").groupBy(*key).agg(F.percentile("v", F.lit(0.99)).alias("white"))
    black = F.least(F.greatest("black", F.lit(0.0)), F.lit(0.99))
    return lower.join(upper, key, "left").select(*key, black.alias("black"), F.least(F.greatest(F.coalesce("white", F.lit(1.0)), black + 0.01), F.lit(1.0)).alias("white"))


def by_inputs(px: DataFrame, key: list[str], inputs: Column) -> DataFrame:
    """v times the number of inputs, unless the image is all but 0 (1e-12)."""
    top = px.groupBy(*key).agg(F.max(F.abs("v")).alias("_top"))
    return px.join(top, key).withColumn("v", F.when(F.col("_top") < 1e-12, F.col("v")).otherwise(F.col("v") * inputs)).drop("_top")
