"""The queries of this package, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fingerprints, language, secrets, sharding, simhash, suffix_dedup, toxicity, wordpiece
from .common import documents


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"), whole=True)
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    counts = [F.size(F.expr(f"filter(secrets, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"), counts[3])


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprint(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.text_of(F.col("sketch")).alias("fingerprint"),
        fingerprints.text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(documents(spark, sf_dir).select("doc_id", F.octet_length("text").alias("bytes"), "text"), keep=["doc_id", "bytes"])
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.coalesce("bytes", F.lit(0)).cast("long").alias("n_bytes"),
        length.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = language.page_parts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    model = language.fit(documents(spark, sf_dir))
    evidence = {c: F.col(c) for c in ("host", "domain", "suffix", "declared")}
    return language.identify(parts, model, **evidence, keep=["page_id", "host", "declared"])


def op5_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    found = toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"])
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    there = bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, keep=["doc_id"], back=True)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return there.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(documents(spark, sf_dir), keep=["doc_id"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_fingerprints": op2_fingerprints,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_language": op4_language,
    "op5_wordpiece": op5_wordpiece,
    "op6_toxicity": op6_toxicity,
    "op7_decontam": op7_decontam,
    "op8_simhash": op8_simhash,
    "op9_bpe": op9_bpe,
    "op10_shards": op10_shards,
}
#: No SQL for the others: they are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op1_secrets": secrets.oracle(), "op7_decontam": decontam.oracle()}
