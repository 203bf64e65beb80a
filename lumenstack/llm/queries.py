"""The opN_ queries and their SQL. Each is thin: it applies an operator and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstack.llm import audit, bpe, conversations, decontam, langid, licenses, lm, quality, records, secrets, sharding, simhash, sql, urls
from lumenstack.llm.common import shared_dir, small_batches, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = table(spark, sf_dir, "documents").select("doc_id", bpe.encode_bpe("text", path).alias("ids"))
    both = ids.withColumn("decoded", bpe.decode_bpe("ids", path))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    keyed = docs.select("doc_id", size.alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"), "lang", "source", F.col("doc_id").alias("age"), size.alias("bytes"))
    placed = sharding.hilbert_shards(keyed, ["lang", "source", "bytes", "age"], 40, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratios = secrets.train_markov(secrets.labelled_samples(docs))
    found = secrets.with_secrets(docs.select("doc_id", "text"), ratios)
    counts = (secrets.count_kind(F.col("base_spans"), kind).alias(f"n_{kind}") for kind, *_ in secrets.BASE)
    return found.select("doc_id", *counts, F.sha2(secrets.written(F.col("base_spans")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = langid.train_text_model(docs, "doc_id", "text", "lang")
    judged = langid.identify_language(docs.select("doc_id", "text", "lang", "source"), model, declared=F.col("lang"), host=F.col("source"))
    return judged.select("doc_id", "language.lang", F.col("lang").alias("declared"), F.round("language.confidence", 6).alias("confidence"), F.col("language.accepted").alias("kept"))


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by all kinds of evidence; the text model is that of documents."""
    small_batches(spark)
    model = langid.train_text_model(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    pages = langid.html_evidence(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
    judged = langid.identify_language(pages, model, declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host"))
    return judged.select("page_id", "host", "declared", "language.lang", F.round("language.confidence", 6).alias("confidence"), F.col("language.accepted").alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    judged = quality.quality_cascade(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.train_url_model(urls.labelled_urls(spark))
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), model)
    return judged.select("page_id", *(f"url_verdict.{c}" for c in ("host", "path", "rule", "verdict")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = decontam.leaks(table(spark, sf_dir, "benchmark"), F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("leak"))
    shared, of = F.col("leak.shared"), F.col("leak.item_shingles")
    return rows.select("doc_id", F.col("leak.item").cast("long").alias("item_id"), shared.alias("shared"), of.alias("item_shingles"), (shared / of).alias("containment"))


def op9_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 2000)
    folder = shared_dir(spark)
    records.write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return records.read_records(spark, folder, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    held_out = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % 7 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    model, made = lm.fit_lm(docs.where(~F.col("held_out")), shared_dir(spark))
    scored = docs.withColumn("s", lm.score_texts(F.col("text"), model, made))
    return scored.select("doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "s.base_score", "s.score")


def damaged(rows: DataFrame) -> DataFrame:
    """The damage that op11 is to repair: each row with how often it stands there, `copies`."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(F.encode(key, "utf-8")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = damaged(table(spark, sf_dir, "conversations"))
    blocks = conversations.repair_conversations(rows, copies=F.col("copies"))
    return conversations.digests(blocks).withColumnRenamed("conv", "conv_id")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.withColumn("l", licenses.licenses(F.col("text"), licenses.fit_index(docs)))
    joined = (F.array_join(f"l.{c}", ",").alias(c) for c in ("base_labels", "labels"))
    return found.select("doc_id", "l.n_words", "l.n_base", "l.first_word", "l.last_word", *joined, "l.score")


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    masks = audit.failure_masks(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels")
    rows = audit.with_labels(masks, labels, "doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return audit.audit(rows).drop("filter")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_hilbert, op3_secrets, op4_langid, langid_pages, op5_quality, op6_urls, op7_simhash, op8_decontam, op9_records, op10_lm, op11_repair, op12_licenses, op13_audit)}
ORACLE_SQL = {"op5_quality": sql.OP5_QUALITY, "op8_decontam": sql.OP8_DECONTAM, "op11_repair": sql.OP11_REPAIR, "op13_audit": sql.OP13_AUDIT}
