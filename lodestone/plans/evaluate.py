"""Evaluation of answers: labelled suites, correctness, rates, percentiles, reasons of refusal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import measures

REASONS = ["underspecified_query", "safety_policy_violation", "off_topic_query", "no_retrieval_candidates", "entity_mismatch", "insufficient_coverage", "low_retrieval_confidence", "grounding_failed"]


def suite(docs: DataFrame, built_in: DataFrame) -> DataFrame:
    """(query_id, query, category, answerable): the documents' own queries, each once, and a labelled set with these columns."""
    own = docs.filter(F.length(F.trim("query")) >= 3).groupBy(F.trim("query").alias("query")).agg(F.min("ord").alias("query_id"))
    own = own.select("query_id", "query", F.lit("Dataset").alias("category"), F.lit(True).alias("answerable"))
    return own.unionByName(built_in.select("query_id", "query", "category", "answerable"))


def judged(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """Adds correct: answered and grounded where an answer is due, refused where not."""
    there = answers.join(asked.select("query_id", "category", "answerable"), "query_id")
    passed = (F.col("status") == "PASSED") & F.col("grounded")
    refused = (F.col("status") != "PASSED") & ~F.col("grounded")
    return there.withColumn("correct", F.when(F.col("answerable"), passed).otherwise(refused))


def report(judged_: DataFrame) -> DataFrame:
    """One row: numbers of queries, rates in per cent, and refusals by reason."""
    due, right = F.col("answerable"), F.col("correct")
    reasons = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    other = F.count_if(F.col("reason").isNotNull() & ~F.col("reason").isin(REASONS)).alias("other_reasons")
    return judged_.agg(
        F.count("*").alias("queries"),
        measures.rate(right, F.lit(True), 0.0).alias("accuracy"),
        measures.rate(right, due, 0.0).alias("answer_rate"),
        measures.rate(right, ~due, 100.0).alias("refusal_rate"),
        *reasons,
        other,
    )


def by_category(judged_: DataFrame) -> DataFrame:
    return judged_.groupBy("category").agg(F.count("*").alias("queries"), measures.rate(F.col("correct"), F.lit(True), 0.0).alias("accuracy"))


def write_report(judged_: DataFrame, path: str) -> None:
    """Stores a run as JSON in two folders under path: report (one row) and queries (each query with its judgement)."""
    report(judged_).write.mode("overwrite").json(f"{path}/report")
    judged_.write.mode("overwrite").json(f"{path}/queries")
