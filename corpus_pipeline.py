"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, secrets, byte-level BPE and back.

STAGES has (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the
columns of docs. Rows with nulls in any column, repeated rows and empty tables pass through every stage as the operators
define it; columns besides those of documents stay with their rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontam, language, secrets, simhash
from lodestone.llm.common import documents, written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages that the corpus is labelled with go: those without a letter, or unlike all of them."""
    model = language.fit(docs)
    found = language.identify(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text", "source", "lang"), model, host=F.col("source"), declared=F.col("lang"), keep=["doc"])
    return found.filter("accepted").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose 5-word shingles have a similarity of 0.8 or more, along chains, that of least doc_id stays."""
    return simhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    found = decontam.search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("__found")).distinct()
    # A written table: small ones are then sent to the documents instead of the documents to them.
    found = written(found, "contaminated")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__found"]), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows."""
    there = secrets.redact(secrets.scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text"), whole=True))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("text").isNotNull() & (F.size("secrets") > 0), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))}
    return there.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the token ids, and whether the bytes decoded from them are those of the text (an empty one if null)."""
    kept = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("__sha256"))
    ids = bpe.encode(kept, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "__sha256"], back=True)
    digest = F.sha2("decoded", 256)
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", digest.alias("decoded_sha256"), (digest == F.col("__sha256")).alias("round_trip"))


STAGES = [
    ("language", languages),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", redact_secrets),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages' fingerprints, merges and models cannot be told in SQL: tested against brute force in tests/llm.
ORACLE_SQL = None
