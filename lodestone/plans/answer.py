"""Answering batches of queries: guards, dense and BM25 search, fusion, reranking, coverage, extraction, grounding.

One lazy plan for a batch. Refused queries keep their rows. Wide text joins late: only the candidates that survive the
cuts get their chunk and its document.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, embedding, guardrails, judging, retrieval

HEAD, RERANKED, UNIQUE, TOP = 8, 5, 3, 20


@dataclass
class Index:
    """Tables of a corpus: documents, chunks, vectors, postings, terms, stats."""

    docs: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    bm25: retrieval.Bm25

    @classmethod
    def build(cls, docs: DataFrame, strategy: str = "all") -> Index:
        chunks = chunking.chunk(docs, strategy)
        return cls(docs, chunks, embedding.embed(chunks, keep=["chunk_ord"]), retrieval.bm25_build(chunks))

    @classmethod
    def create(cls, docs: DataFrame, path: str, strategy: str = "all") -> Index:
        """Builds and stores an index. Chunks are written first, and all else is made of the stored ones."""
        spark = docs.sparkSession
        chunking.chunk(docs, strategy).write.mode("overwrite").partitionBy("strategy").parquet(f"{path}/chunks")
        chunks = spark.read.parquet(f"{path}/chunks")
        bm25 = retrieval.bm25_build(chunks)
        bm25.postings.repartitionByRange("term").sortWithinPartitions("term", "chunk_ord").write.mode("overwrite").parquet(f"{path}/postings")
        bm25.stats.write.mode("overwrite").parquet(f"{path}/stats")
        stats, postings = spark.read.parquet(f"{path}/stats"), spark.read.parquet(f"{path}/postings")
        retrieval.bm25_terms(postings, stats).write.mode("overwrite").parquet(f"{path}/terms")
        embedding.embed(chunks, keep=["chunk_ord"]).write.mode("overwrite").parquet(f"{path}/vectors")
        docs.write.mode("overwrite").parquet(f"{path}/docs")
        return cls.load(spark, path, validate=False)

    def tables(self) -> dict[str, DataFrame]:
        return {"docs": self.docs, "chunks": self.chunks, "vectors": self.vectors, "postings": self.bm25.postings, "terms": self.bm25.terms, "stats": self.bm25.stats}

    def save(self, path: str) -> None:
        """Parquet; chunks by strategy, postings in ranges of terms so that a query's terms prune row groups."""
        for name, df in self.tables().items():
            if name == "postings":
                df = df.repartitionByRange("term").sortWithinPartitions("term", "chunk_ord")
            writer = df.write.mode("overwrite")
            (writer.partitionBy("strategy") if name == "chunks" else writer).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, validate: bool = True) -> Index:
        t = {n: spark.read.parquet(f"{path}/{n}") for n in ("docs", "chunks", "vectors", "postings", "terms", "stats")}
        index = cls(t["docs"], t["chunks"], t["vectors"], retrieval.Bm25(t["postings"], t["terms"], t["stats"]))
        if validate:
            index.validate()
        return index

    def validate(self, expected: int | None = None) -> None:
        """Chunks, vectors and the statistics speak of the same number of chunks."""
        n = {"chunks": self.chunks.count(), "vectors": self.vectors.count(), "stats": self.bm25.stats.first()["n"]}
        if len(set(n.values())) != 1 or expected is not None and n["chunks"] != expected:
            raise ValueError(f"the index does not fit together: {n}" + (f", expected {expected}" if expected is not None else ""))


def candidates(queries: DataFrame, index: Index, strategy: str | None = None) -> DataFrame:
    """(query_id, query, chunk_ord, …): up to HEAD fused candidates of each query, with their chunks and documents.

    chunk_ord tells strategy and document, so text is joined to the head alone. The head is kept, as it is asked for twice; where
    it is small, it goes to the chunks and documents, which then are not exchanged but for the candidates' own.
    """
    dense = retrieval.knn(index.vectors, embedding.embed(queries, "query"), TOP)
    wide = retrieval.expand(queries, "query")
    sparse = retrieval.bm25_search(index.bm25, wide, "expanded", k=TOP)
    names = F.array(*map(F.lit, chunking.STRATEGIES))
    fused = retrieval.rrf(dense, sparse, top_k=TOP).withColumn("strategy", F.get(names, (F.floor(F.col("chunk_ord") / chunking.INDEX) % len(chunking.STRATEGIES)).cast("int")))
    head = _head(retrieval.strategy_filter(fused, strategy)).persist(StorageLevel.MEMORY_AND_DISK)
    small = F.broadcast if queries.count() * HEAD <= retrieval.BROADCAST_ROWS else lambda df: df
    chunks = index.chunks.select("chunk_ord", "doc_id", F.coalesce("title", F.lit("")).alias("title"), "text", "language")
    wanted = head.select(F.floor(F.col("chunk_ord") / (4 * chunking.INDEX)).alias("ord")).distinct()
    docs = index.docs.join(small(wanted), "ord", "left_semi").select(F.col("id").alias("doc_id"), F.col("text").alias("parent_text"))
    return chunks.join(small(head), "chunk_ord").join(docs, "doc_id").join(queries, "query_id")


def _head(fused: DataFrame) -> DataFrame:
    """The HEAD first of each query by fused rank, which a filter may have left with gaps."""
    return fused.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("place") <= HEAD)


ANSWER = "query_id long, status string, reason string, grounded boolean, answer string, confidence double, sources string, chunk_ords array<long>, entity_score double, coverage_score double, relevance double"


def _judge(pdf: pd.DataFrame) -> tuple:
    """The answer row of one query from its candidates in order of fused rank."""
    asked = judging.Asked(pdf["query"].iloc[0])
    rows = [judging.Candidate(int(r.chunk_ord), r.doc_id, r.title or "", r.text or "", r.parent_text or "", r.language, r.strategy, r.dense_score, r.bm25_score, r.rrf_score) for r in pdf.sort_values("place").itertuples()]
    ranked = judging.rerank(asked, rows, RERANKED)
    best, strategies = {}, {}
    for c in ranked:
        parent = retrieval.parent_key(c.doc_id, c.doc_id, c.text)
        best.setdefault(parent, c)
        strategies.setdefault(parent, []).append(c.strategy)
    best = dict(list(best.items())[:UNIQUE])
    sources = "; ".join(f"{c.doc_id} ({' + '.join(dict.fromkeys(strategies[key]))}, {c.final:.3f})" for key, c in best.items())
    best = list(best.values())
    verdict = judging.coverage(asked, best)
    told = (sources, [c.chunk_ord for c in best], verdict.entity, verdict.coverage, verdict.relevance)
    if not verdict.passed:
        return (int(pdf["query_id"].iloc[0]), verdict.status, verdict.reason, False, judging.REFUSAL, verdict.confidence, *told)
    answer = judging.extract(asked, best)
    status, grounded, confidence = judging.settle(verdict, answer, guardrails.grounded(answer.text, answer.source)[0])
    return (int(pdf["query_id"].iloc[0]), status, None if status == "PASSED" else "grounding_failed", grounded, answer.text, confidence, *told)


def answer(queries: DataFrame, index: Index, strategy: str | None = None, compose: bool = False) -> DataFrame:
    """One row for each query (query_id long, query): status, reason, grounded, answer, confidence, sources and scores."""
    guarded = queries.select("query_id", text.strip(F.coalesce("query", F.lit(""))).alias("query")).withColumn("guard", guardrails.input_guard(F.col("query"), compose))
    passing = guarded.filter("guard.passed").select("query_id", "query")
    found = candidates(passing, index, strategy)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_judge(group)], columns=[f.split(" ")[0] for f in ANSWER.split(", ")])

    judged = found.groupBy("query_id").applyInPandas(run, ANSWER)
    merged = guarded.join(judged, "query_id", "left")
    refused = ~F.col("guard.passed")
    status = F.when(refused, F.col("guard.status")).otherwise(F.coalesce(F.col("status"), F.lit("NO_CONTEXT")))
    reason = F.when(refused, F.col("guard.reason")).when(F.col("status").isNull(), F.lit("no_retrieval_candidates")).otherwise(F.col("reason"))
    return merged.select("query_id", "query", status.alias("status"), reason.alias("reason"), F.coalesce("grounded", F.lit(False)).alias("grounded"), F.coalesce("answer", F.lit(judging.REFUSAL)).alias("answer"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "sources", "chunk_ords", "entity_score", "coverage_score", "relevance")
