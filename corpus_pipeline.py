"""A corpus pipeline: language, near-duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last
return the columns of documents. Empty tables pass through every stage; null texts are rejected by the first.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstack.llm import bpe, decontam, langid, neardup, secrets
from lumenstack.llm.common import free_name, materialise, small_batches, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the rejected ones go."""
    small_batches(spark)
    model = langid.train_text_model(docs, "doc_id", "text", "lang")
    judged = langid.identify_language(docs, model, declared=F.col("lang"), host=F.col("source"))
    verdict = judged.columns[-1]
    return judged.where(F.col(f"{verdict}.accepted")).drop(verdict)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 or more of their five-word shingles."""
    small_batches(spark)
    return neardup.keep_one_of_each_group(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    small_batches(spark)
    return docs.where(F.size(decontam.leaks(table(spark, sf_dir, "benchmark"), F.col("text"))) == 0)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark, and n_chars set right."""
    ratios = secrets.train_markov(secrets.labelled_samples(docs))
    base, spans = free_name(docs, "base_spans"), free_name(docs, "spans")
    found = secrets.with_secrets(docs, ratios, base_name=base, name=spans)
    text = secrets.redacted(F.col("text"), F.col(spans))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and the digest of what they decode to."""
    small_batches(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = docs.select("doc_id", "lang", "source", bpe.encode_bpe("text", path, cache_words=50_000, slice_bytes=400_000).alias("ids"))
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(bpe.decode_bpe("ids", path), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("tokens", tokens)]
#: Trained models and components of a similarity graph are not expressible in SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
