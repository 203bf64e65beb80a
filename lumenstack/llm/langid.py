"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are added as log-probabilities: the text under a model of hashed byte trigrams of
each language, the language that the markup declares, the country suffix of the address, and a prior of the
host. The trigram model is fitted on a bounded sample of labelled rows; all other tables are grouped
aggregations over all rows: how often each declaration and each suffix comes with each language (as the text
alone is judged), and how often each host has each language. Host counts are smoothed by those of the other hosts of
its domain (the last two labels), these by those of all rows, so that a host of few pages follows its domain, and one
without a domain of several hosts follows all rows; no count is used twice.

A row is rejected if its text has no letter, if a flat model (every trigram alike) explains the text better
than any language does, or if the posterior of the best language is under `least`. Null texts are empty ones
and are rejected. Null declarations, suffixes and hosts add nothing. With no labelled rows, all rows are
rejected. Repeated rows are judged alike; of equal scores the first language in alphabetical order wins. An empty
table gives no rows, and columns of any name are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack.llm.common import free_name, materialise

BUCKETS = 1 << 15
#: Trigrams of a text overlap and depend on each other; their evidence counts by this power.
TEMPER = 0.25
SMOOTH = 20.0


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of the lower-cased texts, each between spaces, and the n+1 bounds of the texts."""
    parts = [b" " + " ".join((t or "").lower().split()).encode() + b"  " for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    bounds = np.cumsum([0, *map(len, parts)])
    if len(data) < 3:
        return np.zeros(0, np.uint32), bounds
    code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return np.append((code * np.uint32(2654435761)) >> np.uint32(17), np.uint32([0, 0])), bounds


@dataclass(frozen=True)
class TextModel:
    """Log-probability of each hashed trigram in each language."""

    languages: tuple[str, ...]
    table: np.ndarray  # (BUCKETS, languages) float32, less the flat model's log-probability

    def score(self, texts: list[str | None]) -> np.ndarray:
        """(texts, languages): log-likelihood over the flat model's, tempered."""
        out = np.zeros((len(texts), len(self.languages)))
        at = 0
        while at < len(texts):  # about 250,000 bytes at once
            size, upto = 0, at
            while upto < len(texts) and (size < 250_000 or upto == at):
                size, upto = size + len(texts[upto] or ""), upto + 1
            grams, bounds = trigrams(texts[at:upto])
            for k in range(len(self.languages)):
                sums = np.concatenate([[0.0], np.cumsum(self.table[:, k][grams], dtype=np.float64)])
                out[at:upto, k] = sums[bounds[1:] - 2] - sums[bounds[:-1]]
            at = upto
        return TEMPER * out


def train_text_model(df: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = 4000) -> TextModel:
    """Fitted on the sample_rows labelled rows of least hash of the id, for all labels that they have."""
    labelled = df.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    ids = [r[0] for r in labelled.select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).collect()]
    sample = labelled.where(F.col(id_col).isin(ids)).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = trigrams([text])[0][:-2]
                totals.setdefault(label, np.zeros(BUCKETS, np.int64))
                totals[label] += np.bincount(grams, minlength=BUCKETS)
        for label, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"label": pa.array([label] * len(at), pa.string()), "gram": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})

    counts = sample.mapInArrow(count, "label string, gram int, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    rows = counts.toPandas() if ids else None  # at most BUCKETS rows a label of the sample
    if rows is None or not len(rows):
        return TextModel((), np.zeros((BUCKETS, 0), np.float32))
    languages = tuple(sorted(rows["label"].unique()))
    table = np.full((BUCKETS, len(languages)), 0.1)
    for k, language in enumerate(languages):
        own = rows[rows["label"] == language]
        table[own["gram"].to_numpy(), k] += own["n"].to_numpy()
    return TextModel(languages, (np.log(table / table.sum(0)) + np.log(BUCKETS)).astype(np.float32))


def text_scores(df: DataFrame, model: TextModel, text: Column) -> Column:
    held = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language of the sample

    def run(texts: pa.Array) -> pa.Array:
        scores = held.value.score(texts.to_pylist())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1, dtype=np.int32) * scores.shape[1]), pa.array(scores.ravel()))

    return F.arrow_udf(run, "array<double>")(text)


def domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def best(scores: Column) -> Column:
    """Place, from 0, of the first greatest."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def log_table(counts: list[tuple[str, int, int]], keys: list[str], n: int) -> Column:
    """A map from key to log P(key | language), add-half smoothed, from (key, language, count)."""
    totals = np.full((len(keys), n), 0.5)
    for key, language, count in counts:
        totals[keys.index(key), language] += count
    logs = np.log(totals / totals.sum(0))
    return F.create_map(*(x for key, row in zip(keys, logs.tolist()) for x in (F.lit(key), F.array(*map(F.lit, row)))))


def identify_language(df: DataFrame, model: TextModel, text_col: str = "text", declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, least: float = 0.5, broadcast_hosts: int = 50_000) -> DataFrame:
    """df with a struct column `language` (lang, confidence, accepted; underscores before a taken name).

    suffix: two-letter country codes; other values add nothing. broadcast_hosts: up to so many hosts their
    priors are broadcast, beyond it Spark joins by host.
    """
    n = len(model.languages)
    out = free_name(df, "language")
    if not n:
        return df.withColumn(out, F.struct(F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted")))
    none = F.lit(None).cast("string")
    tag = F.lower(F.regexp_extract(declared, "^[A-Za-z]{2,3}", 0)) if declared is not None else none
    tag = F.when(tag.isin(*model.languages), tag).when(tag != "", F.lit("?"))
    code = F.when(F.lower(suffix).rlike("^[a-z]{2}$"), F.lower(suffix)) if suffix is not None else none
    scores, tags, codes, hosts = (free_name(df, x) for x in ("_scores", "_declared", "_suffix", "_host"))
    rows = df.withColumns({scores: text_scores(df, model, F.coalesce(text_col, F.lit(""))), tags: tag, codes: code, hosts: F.lower(host) if host is not None else none})

    seen = materialise(rows.groupBy(F.col(hosts).alias("host"), F.col(tags).alias("tag"), F.col(codes).alias("code"), best(F.col(scores)).alias("language")).agg(F.count("*").alias("n")))
    per_tag = [tuple(r) for r in seen.where("tag is not null").groupBy("tag", "language").agg(F.sum("n")).collect()]
    per_code = [tuple(r) for r in seen.where("code is not null").groupBy("code", "language").agg(F.sum("n")).collect()]
    overall = np.full(n, 1.0)
    for r in seen.groupBy("language").agg(F.sum("n").alias("n")).collect():
        overall[r["language"]] += r["n"]
    overall = (overall / overall.sum()).tolist()

    def smoothed(own: Column, under: Column) -> Column:
        total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, under, lambda x, p: (x + SMOOTH * p) / (total + SMOOTH))

    def counts(k: str) -> Column:
        return F.array(*(F.sum(F.when(F.col("language") == i, F.col("n")).otherwise(0)).cast("double") for i in range(n))).alias(k)

    named = seen.where("host is not null")
    by_host = named.groupBy("host").agg(counts("own")).withColumn("domain", domain(F.col("host")))
    total = by_host.groupBy("domain").agg(F.array(*(F.sum(F.col("own")[i]) for i in range(n))).alias("all"))
    others = F.zip_with("all", "own", lambda a, o: a - o)
    by_host = by_host.join(total, "domain").select("host", "own", smoothed(others, F.array(*map(F.lit, overall))).alias("wide"))
    prior = free_name(df, "_prior")
    priors = materialise(by_host.select(F.col("host").alias(hosts), F.transform(smoothed(F.col("own"), F.col("wide")), lambda p: F.log(p)).alias(prior)))
    rows = rows.join(F.broadcast(priors) if priors.count() <= broadcast_hosts else priors, hosts, "left")

    flat = F.array(*(F.lit(0.0) for _ in range(n)))
    evidence = [F.col(scores), F.coalesce(prior, F.array(*(F.lit(float(np.log(p))) for p in overall)))]
    for column, found in ((tags, per_tag), (codes, per_code)):
        if found:
            evidence.append(F.coalesce(F.element_at(log_table(found, sorted({k for k, _, _ in found}), n), F.col(column)), flat))
    total = evidence[0]
    for e in evidence[1:]:
        total = F.zip_with(total, e, lambda a, b: a + b)
    totals = free_name(df, "_total")
    rows = rows.withColumn(totals, total)
    top = F.array_max(totals)
    confidence = 1.0 / F.aggregate(totals, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    lang = F.element_at(F.array(*map(F.lit, model.languages)), best(F.col(totals)) + 1)
    letters = F.col(text_col).rlike(r"\p{L}")
    accepted = F.coalesce(letters, F.lit(False)) & (F.array_max(scores) > 0) & (confidence >= least)
    result = F.struct(lang.alias("lang"), confidence.alias("confidence"), accepted.alias("accepted"))
    return rows.select(*(F.col(f"`{c}`") for c in df.columns), result.alias(out))


def url_host(url: Column) -> Column:
    """Null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#:]+)", 1)), F.lit(""))


def html_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with the columns text, declared, suffix and host that identify_language() takes; taken names are refused."""
    if taken := {"text", "declared", "suffix", "host"} & {c.lower() for c in pages.columns}:
        raise ValueError(f"pages has columns {sorted(taken)} already")
    html = F.col(html_col)
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    host = url_host(F.col(url_col))
    return pages.withColumns({"text": bare, "declared": F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1), "suffix": F.regexp_extract(host, r"\.([a-z]{2})$", 1), "host": host})
