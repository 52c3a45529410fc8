"""Aggregates of evaluation runs: percentiles, rates, breakdowns, samples, a signature of a set of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_percentile(value: str, p: float) -> Column:
    """sorted[floor(n * p)], the last value at most: an aggregate over bounded runs (it collects the group)."""
    got = F.array_sort(F.collect_list(value))
    return F.get(got, F.least(F.floor(F.size(got) * F.lit(p)).cast("int"), F.size(got) - 1))


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """The same for groups of any size: values are counted first, and the rank is found in the running counts."""
    by = by or []
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    run = Window.partitionBy(*by).orderBy(value)
    counted = counted.withColumn("__upto", F.sum("__c").over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("__c").over(Window.partitionBy(*by)))
    picks = [F.min(F.when(F.col("__upto") > F.least(F.floor(F.col("__n") * F.lit(p)), F.col("__n") - 1), F.col(value))).alias(name) for name, p in shares.items()]
    return counted.groupBy(*by).agg(*picks)


def rate(hit: Column, of: Column, empty: float) -> Column:
    """Per cent, one decimal."""
    return F.when(F.count_if(of) == 0, F.lit(empty)).otherwise(F.round(100.0 * F.count_if(hit & of) / F.count_if(of), 1))


def stride_places(n: int, count: int, seed: int = 42) -> list[int]:
    """min(count, n) ordinals: those at floor(i * n / count + seed) modulo n; where two are the same, the first free ones fill up."""
    count = max(0, min(count, n))
    places = {int(i * (n / count) + seed) % n for i in range(count)}
    at = 0
    while len(places) < count:
        places.add(at)
        at += 1
    return sorted(places)


def stride_sample(df: DataFrame, ordinal: str, n: int, count: int, seed: int = 42) -> DataFrame:
    """Of n rows numbered by ordinal from 0, count spread over all (see stride_places); all of them if count is n or more."""
    if count >= n:
        return df
    places = df.sparkSession.createDataFrame([(p,) for p in stride_places(n, count, seed)], f"{ordinal} long")
    return df.join(F.broadcast(places), ordinal, "left_semi")


def signature(chunks: DataFrame) -> DataFrame:
    """One row: the number of chunks and of documents, and a hash that any change of a chunk changes, in any order of rows."""
    h = F.xxhash64("chunk_id", "strategy", "text")
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.hex(F.bit_xor(h)).alias("signature"))
