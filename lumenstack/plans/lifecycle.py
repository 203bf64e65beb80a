"""Stack plans, run modes, names and headers."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstack.work import materialise

#: Prefixes of files that a run itself makes.
OUTPUT_PREFIXES = ("stack_", "mosaic_final_", "aligned_", "drizzle_")
#: Parts of the names of files that a run itself makes.
OUTPUT_PARTS = ("_reproject", "_sum.", "_wht.", "_preview.", "_temp.", "reference_image.fit", "cumulative_sum.npy", "cumulative_wht.npy")
#: Other spellings of the final combination.
COMBINE = {"reproject and coadd": "reproject_coadd", "reproject_and_coadd": "reproject_coadd", "reproject-coadd": "reproject_coadd"}
#: Former names of solver preferences.
FORMER_SOLVERS = ("ansvr", "astrometry")


def plan_positions(plan: DataFrame) -> DataFrame:
    """Each row's position in its batch, by order and path: rows are dealt by range, counted by batch and range, and
    numbered within both, so that no batch is ordered in one task."""
    order = ["batch_id", "order", "file_path"]
    dealt = materialise(plan.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("batch_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = dealt.groupBy("batch_id", "_part").agg(F.count("*").alias("_n")).select("batch_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("batch_id", "_part").orderBy("order", "file_path"))
    return dealt.join(starts, ["batch_id", "_part"]).withColumn("position", (F.col("_before") + own).cast("long")).drop("_part", "_before")


def plan_batches(plan: DataFrame) -> DataFrame:
    """(batch_id, first, files): batches in order of their first row, with their files in order."""
    files = F.array_sort(F.collect_list(F.struct("order", "file_path")))
    return plan.groupBy("batch_id").agg(F.min("order").alias("first"), F.transform(files, lambda f: f["file_path"]).alias("files")).orderBy("first")


def finalization_mode(mosaic: Column, drizzle: Column, between_batches: Column, coadd: Column) -> Column:
    """mosaic, then drizzle, then classic_sumw if batches are reprojected, then reproject_coadd, then classic_sumw."""
    return F.when(mosaic, "mosaic").when(drizzle, "drizzle").when(between_batches, "classic_sumw").when(coadd, "reproject_coadd").otherwise("classic_sumw")


def is_candidate(name: Column, prefixes: tuple[str, ...] = OUTPUT_PREFIXES, parts: tuple[str, ...] = OUTPUT_PARTS) -> Column:
    """Not one of the run's own outputs, which begin with a prefix or hold a part."""
    lower = F.lower(name)
    made = F.lit(False)
    for p in prefixes:
        made |= lower.startswith(p)
    for p in parts:
        made |= lower.contains(p)
    return ~made


def refuse_empty(df: DataFrame, what: str) -> DataFrame:
    """df, if it has a row: a mode that has gathered nothing fails, and no other mode takes its place."""
    if df.isEmpty():
        raise ValueError(f"nothing to go on with: {what}")
    return df


def final_combine(cli: str | None, settings: str | None) -> str:
    """The command line, then the settings, then mean; names are trimmed and lower-cased, unknown ones kept."""
    names = (x.strip().lower() for x in (cli, settings) if x is not None)
    return next((COMBINE.get(x, x) for x in names if x), "mean")


def solver_gate(preference: Column, operational: Column, configured: Column) -> Column:
    """struct(allowed, reason): whether a solver may run. operational: the first solver is ready; configured: the second,
    to which the first falls back, is there. A null, unknown or "none" preference allows none."""
    wish = F.lower(F.trim(F.coalesce(preference, F.lit("none"))))
    first = wish.isin("zesolver", *FORMER_SOLVERS)
    allowed = (first & (operational | configured)) | ((wish == "astap") & configured)
    reason = F.when(allowed, F.lit(None).cast("string")).when(first, "zesolver_unavailable_no_astap").when(wish == "astap", "astap_not_configured").otherwise("no_solver_configured")
    return F.struct(allowed.alias("allowed"), reason.alias("reason"))


def run_policy(batch_size: Column, between_batches: Column, coadd: Column, match_background: Column) -> Column:
    """struct(between_batches, coadd, match_background): a batch size of 0 means one final co-add and no reprojection
    between batches; backgrounds are not matched at a batch size of 1."""
    whole = batch_size == 0
    return F.struct((between_batches & ~whole).alias("between_batches"), (coadd | whole).alias("coadd"), (match_background & (batch_size != 1)).alias("match_background"))


def exposure_of(header: Column) -> tuple[Column, Column]:
    """(EXPTIME, units) of a header map: 1.0 and counts where they are missing."""
    return F.coalesce(F.try_element_at(header, F.lit("EXPTIME")).cast("double"), F.lit(1.0)), F.coalesce(F.lower(F.try_element_at(header, F.lit("UNITS"))), F.lit("counts"))


def solved_only(batches: DataFrame, header: str = "header") -> DataFrame:
    """Batches whose header has world coordinates; the others take no part in a final reprojection."""
    return batches.where(has_wcs(F.col(header)))


def without_keywords(header: Column, dropped: tuple[str, ...] = ("HISTORY", "COMMENT", "CONTINUE")) -> Column:
    """A header map without some keywords, its values in ASCII."""
    kept = F.map_filter(header, lambda k, _: ~k.isin(*dropped))
    return F.transform_values(kept, lambda _, v: F.regexp_replace(v, r"[^\x20-\x7E]", ""))


def has_wcs(header: Column) -> Column:
    """CRVAL and CRPIX, and either both CDELT or the full CD matrix."""
    every = lambda *keys: _all(F.map_contains_key(header, k) for k in keys)
    return every("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2") & (every("CDELT1", "CDELT2") | every("CD1_1", "CD1_2", "CD2_1", "CD2_2"))


def has_wcs_loosely(header: Column) -> Column:
    """CRVAL, and the diagonal of CD, or PC1_1, or CDELT1."""
    every = lambda *keys: _all(F.map_contains_key(header, k) for k in keys)
    return every("CRVAL1", "CRVAL2") & (every("CD1_1", "CD2_2") | every("PC1_1") | every("CDELT1"))


#: Keywords of world coordinates that a new solution replaces.
WCS_KEYS = ("WCSAXES", "CTYPE1", "CTYPE2", "CUNIT1", "CUNIT2", "CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2", "CDELT1", "CDELT2", "CROTA1", "CROTA2", "CD1_1", "CD1_2", "CD2_1", "CD2_2", "PC1_1", "PC1_2", "PC2_1", "PC2_2", "LONPOLE", "LATPOLE", "RADESYS", "EQUINOX")


def with_solution(header: Column, solution: Column) -> Column:
    """struct(header, cards): the header without its old world coordinates and free text, with those of the solution in
    ASCII, and how many cards that are."""
    new = without_keywords(solution)
    kept = F.map_filter(without_keywords(header), lambda k, _: ~k.isin(*WCS_KEYS) & ~F.map_contains_key(new, k))
    return F.struct(F.map_concat(kept, new).alias("header"), F.size(new).alias("cards"))


def with_pointing(header: Column) -> Column:
    """RA and DEC from CRVAL1 and CRVAL2, where these are."""
    found = F.map_contains_key(header, "CRVAL1") & F.map_contains_key(header, "CRVAL2")
    rest = F.map_filter(header, lambda k, _: ~k.isin("RA", "DEC"))
    return F.when(found, F.map_concat(rest, F.create_map(F.lit("RA"), F.try_element_at(header, F.lit("CRVAL1")), F.lit("DEC"), F.try_element_at(header, F.lit("CRVAL2"))))).otherwise(header)


def with_note(header: Column, rewinsor: Column) -> Column:
    """STK_NOTE says which winsorised mean a stack is."""
    note = F.when(rewinsor, "Winsorized sigma clip, rejected replaced").otherwise("Winsorized sigma clip, rejected dropped")
    return F.map_concat(F.map_filter(header, lambda k, _: k != "STK_NOTE"), F.create_map(F.lit("STK_NOTE"), note))


def _all(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= c
    return out


@dataclass(frozen=True)
class StackConfig:
    """Settings with their defaults; clamped() brings them into range."""

    mode: str = "kappa-sigma"
    kappa: float = 2.5
    sigma_low: float = 3.0
    sigma_high: float = 3.0
    winsor_limits: tuple[float, float] = (0.05, 0.05)
    snr: float = 2.5
    drizzle_scale: float = 2.0
    pixfrac: float = 1.0
    final_combine: str = "mean"

    def clamped(self) -> StackConfig:
        low, high = self.winsor_limits
        limits = (low, high) if 0 <= low < 0.5 and 0 <= high < 0.5 and low + high < 1 else (0.05, 0.05)
        inside = lambda v, a, b: min(max(v, a), b)
        return replace(self, kappa=inside(self.kappa, 1.0, 5.0), sigma_low=inside(self.sigma_low, 0.1, 10.0), sigma_high=inside(self.sigma_high, 0.1, 10.0), winsor_limits=limits, pixfrac=inside(self.pixfrac, 0.01, 1.0), final_combine=final_combine(self.final_combine, None))

    def saved(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def loaded(cls, text: str) -> StackConfig:
        """Known keys of a JSON text; what is not JSON, or not an object, gives the defaults."""
        try:
            found = json.loads(text)
        except ValueError:
            return cls()
        if not isinstance(found, dict):
            return cls()
        own = {f.name: found[f.name] for f in fields(cls) if f.name in found}
        if isinstance(own.get("winsor_limits"), list):
            own["winsor_limits"] = tuple(own["winsor_limits"])
        return cls(**own)
