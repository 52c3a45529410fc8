"""Looking through chunks: filters, pages, counts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import STRATEGIES


def search(chunks: DataFrame, words: str | list[str] | None = None, strategy: str | None = None) -> DataFrame:
    """Chunks of a strategy (any if blank or "all") with words (any of a list) in text or title, in any case; % and _ are characters like others."""
    if strategy and strategy != "all":
        chunks = chunks.filter(F.col("strategy") == strategy)
    wanted = [w for w in ([words] if isinstance(words, str) else words or []) if w]
    if wanted:
        has = [F.contains(F.lower(c), F.lit(w.lower())) for w in wanted for c in (F.col("text"), F.coalesce("title", F.lit("")))]
        chunks = chunks.filter(reduce(or_, has))
    return chunks


def page(chunks: DataFrame, number: int = 1, limit: int = 20, order: str = "chunk_ord") -> DataFrame:
    """A page of 1 to 100 rows; numbers below 1 mean the first."""
    limit = max(1, min(100, limit))
    return chunks.orderBy(order).offset((max(1, number) - 1) * limit).limit(limit)


def counts(chunks: DataFrame) -> DataFrame:
    """(strategy, chunks) for all strategies, those without chunks too."""
    spark = chunks.sparkSession
    names = spark.createDataFrame([(s,) for s in STRATEGIES], "strategy string")
    return names.join(chunks.groupBy("strategy").agg(F.count("*").alias("chunks")), "strategy", "left").fillna(0, ["chunks"])
