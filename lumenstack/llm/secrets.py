"""Secrets in text: fixed patterns, and strings that look random to character Markov models.

Everything here is DataFrame functions. Positions are code points, ends exclusive. Three base kinds are
found leftmost and non-overlapping, each by itself, and matches that are too short are dropped afterwards.
The kind `markov` adds runs of key characters whose log-likelihood under a first-order character model of
random strings exceeds that under a model of ordinary identifiers by `least` nats in all and by `each` nats a pair
of characters; runs that overlap a base span are left out. Both models are counts of character pairs, collected
from labelled samples: random strings in several alphabets, and words, joined words, constants, numbers, dates, UUIDs
and rows of one character, so that digits or capitals alone do not make a secret.

Null and empty texts have no spans; repeated rows each have their own, and an empty table gives none (the models
are then those of the generated samples alone). Equal starts are ordered by kind. A text is scanned whole in its row,
however long; work grows with its matches squared only in the array of its spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base kinds with their pattern, the group that is measured, and its least length. Runs of a single
#: class are asked for with their least length: a shorter run holds no match of it, so the spans are the same.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
RUN = "[A-Za-z0-9+/_=-]"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Words that names in code and addresses are made of, beside the words of the documents.
COMMON = """
get set put add new old max min sum count total size length width height index value values data time date day month year
hour user users account accounts name names first last table tables row column file files path paths folder list map key
keys item items order orders price number string text line page pages image images video http https www com org net html
php example connection timeout seconds milliseconds server client request response status error message code type types
version default config settings option options input output source target start end begin before after from into with
without between update delete insert select create remove open close read write send receive load save build test main
public private static final class method function return true false null this that there which when where what who how
people world house street water number company government system program question problem group service area interest
""".split()
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans_of(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans of the matches of pattern whose group has `least` characters, as SPAN."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    measured = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own"))), measured, lambda p, v: F.struct(p["gap"].alias("gap"), p["own"].alias("own"), F.length(v).alias("measured")))
    none = F.array().cast(SPAN)

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        own = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["own"]).alias("end"), F.lit(kind).alias("kind")))
        return F.struct((start + x["own"]).alias("at"), F.when(x["measured"] >= least, F.concat(state["found"], own)).otherwise(state["found"]).alias("found"))

    found = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda state: state["found"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def random_samples(spark: SparkSession, n: int, seed: str = "sample") -> DataFrame:
    """(text): n strings of hash digits in each of base64, hexadecimal, and capitals with digits."""
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    shapes = F.array(F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), F.substring(digest, 1, 40), F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)))
    return spark.range(n).select(F.explode(shapes).alias("text"))


def ordinary_samples(words: DataFrame, spark: SparkSession, n: int, seed: str = "plain") -> DataFrame:
    """(text): from words (w array<string>) and COMMON single words and joined ones in five styles; and n each of numbers, dates,
    times, versions and UUIDs, with a row of each character."""
    shuffled = (F.shuffle(F.split(F.lit(" ".join(COMMON)), " "), seed=k).alias("w") for k in range(20))
    words = words.select("w").unionAll(spark.range(1).select(F.explode(F.array(*shuffled)).alias("w")))
    pairs = F.zip_with("w", F.slice("w", 2, 1_000_000_000), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, F.lit("x")).alias("b")))
    styles = [lambda p: F.concat_ws("_", p["a"], p["b"]), lambda p: F.concat(p["a"], F.initcap(p["b"])), lambda p: F.concat_ws("/", p["a"], p["b"]), lambda p: F.concat_ws("-", p["a"], p["b"]), lambda p: F.upper(F.concat_ws("_", p["a"], p["b"]))]
    named = words.select(F.explode(F.concat(F.col("w"), *(F.transform(pairs, f) for f in styles))).alias("text"))
    k, digest = F.xxhash64(F.lit(seed), "id"), F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(k, F.lit(20_000)).cast("int"))
    uuid = F.concat_ws("-", *(F.substring(digest, a, l) for a, l in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    shapes = [F.lpad(F.pmod(k, F.lit(10**15)).cast("string"), 16, "0"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("_"), F.pmod(k, F.lit(10_000)).cast("string")), F.date_format(day, "yyyy/MM/dd"), F.date_format(day, "yyyyMMdd"), F.concat_ws("-", F.year(day), F.year(day) + 1, F.year(day) + 2), F.concat(F.lit("v"), F.pmod(k, F.lit(100)).cast("string"), F.lit("_"), F.pmod(k, F.lit(1000)).cast("string")), uuid, F.upper(uuid)]
    made = spark.range(n).select(F.explode(F.array(*shapes)).alias("text"))
    rows = spark.range(1).select(F.explode(F.transform(F.split(F.lit(ALPHABET), ""), lambda c: F.repeat(c, F.lit(n)))).alias("text"))
    return named.unionAll(made).unionAll(rows)


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 300, random_strings: int = 4000) -> DataFrame:
    """(text, label): random strings (label 1), and ordinary ones with the words of the sample_docs documents of
    least hash of the id (label 0)."""
    spark = docs.sparkSession
    ids = [r[0] for r in docs.select(id_col).where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample_docs).collect()]
    words = docs.where(F.col(id_col).isin(ids)).select(F.filter(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit("[A-Za-z]{2,}"), F.lit(0)), lambda w: ~w.rlike("^[0-9a-f]{24,}$")).alias("w"))
    ordinary = ordinary_samples(words, spark, random_strings // 8)
    return random_samples(spark, random_strings).withColumn("label", F.lit(1)).unionAll(ordinary.withColumn("label", F.lit(0)))


def train_markov(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each pair of characters of ALPHABET, row by row."""
    k = len(ALPHABET)
    last = F.length("text") - 1
    pairs = samples.where(last > 0).select("label", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr("text", i, F.lit(2)))).alias("pair"))
    rows = pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).where(F.col("pair").rlike(f"^{RUN}{{2}}$")).collect()  # k * k pairs a label at most
    counts = [[0] * (k * k) for _ in range(2)]
    for r in rows:
        counts[r["label"]][ALPHABET.index(r["pair"][0]) * k + ALPHABET.index(r["pair"][1])] += r["n"]

    def smoothed(own: list[int]) -> list[float]:
        """Each row of pairs leans on the frequencies of single characters with the weight of 5 pairs."""
        single = [sum(own[b::k]) + 0.5 for b in range(k)]
        total = sum(single)
        before = [sum(own[a * k : a * k + k]) for a in range(k)]
        return [math.log((own[a * k + b] + 5 * single[b] / total) / (before[a] + 5)) for a in range(k) for b in range(k)]

    logs = [smoothed(own) for own in counts]
    return [b - a for a, b in zip(*logs)]


def likelihood_ratio(run: Column, table: list[float]) -> Column:
    """Sum over the pairs of characters of a run."""
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")

    code = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.zip_with(F.slice(code, F.lit(1), F.length(run) - 1), F.slice(code, F.lit(2), F.length(run) - 1), lambda a, b: (a - 1) * len(ALPHABET) + b)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.element_at(ratios, p))


def looks_random(run: Column, table: list[float], least: float, each: float) -> Column:
    ratio = likelihood_ratio(run, table)
    return (ratio >= least) & (ratio >= each * (F.length(run) - 1))


def markov_spans(text: Column, table: list[float], shortest: int, least: float, each: float) -> Column:
    pattern = f"{RUN}{{{shortest},}}"
    spans = spans_of(text, "markov", len(BASE), pattern, 0, shortest)
    return F.filter(spans, lambda s: looks_random(F.substr(text, s["start"] + 1, s["end"] - s["start"]), table, least, each))


def find_secrets(df: DataFrame, table: list[float], text_col: str = "text", shortest: int = 20, least: float = 8.0, each: float = 0.5) -> tuple[Column, Column]:
    """(base, all): SPAN columns over df[text_col], each sorted by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(F.concat(*(spans_of(text, kind, rank, pattern, group, size) for rank, (kind, pattern, group, size) in enumerate(BASE))))
    return base, markov_spans(text, table, shortest, least, each)


def with_secrets(df: DataFrame, table: list[float], text_col: str = "text", shortest: int = 20, least: float = 8.0, each: float = 0.5, base_name: str = "base_spans", name: str = "spans") -> DataFrame:
    """df with the columns base_name and name (SPAN). Taken names are refused, never overwritten; see common.free_name()."""
    if {base_name.lower(), name.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"df has a column {base_name} or {name} already")
    base, more = find_secrets(df, table, text_col, shortest, least, each)
    df = df.withColumns({base_name: base, name: more})
    apart = F.filter(name, lambda m: ~F.exists(base_name, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return df.withColumn(name, F.array_sort(F.concat(base_name, apart)))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with every span (overlapping ones together) replaced by mark."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def cut(s: Column, x: Column) -> Column:
        whole = F.concat(s["out"], F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))
        return F.struct(F.when(x["start"] >= s["at"], whole).otherwise(s["out"]).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    done = F.aggregate(spans, state, cut, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))
    return F.when(F.size(spans) > 0, done).otherwise(text)
