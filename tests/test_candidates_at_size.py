"""Vectors, nearest neighbours and candidates: what is exchanged is bounded by the queries."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import queries as engine
from lodestone.operators import embedding, retrieval
from lodestone.plans import answer


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_is_no_token_is_passed_over_at_once():
    began = time.time()
    assert embedding.py_tokens(" . " * 10_000_000 + "É_a") == ["é", "a"] and time.time() - began < 0.8


def test_vectors_of_mixed_scripts():
    texts = ["𝒜bc 𝒜 x", "नमस्ते दुनिया", "漢字 " * 3, "same same sam", "", "ab"]
    for t in texts:
        assert np.array_equal(embedding.vectors([t])[0], embedding.vectors([*texts, t])[-1])
    for t in ("a", "hello_you", "𝒜_b", "x" * 40_000):
        assert embedding.hashes([t], embedding.PAIR_SEED)[0] == embedding.py_hash32(t, embedding.PAIR_SEED)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def table(spark, v, name, kind="double"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], f"{name} long, embedding array<{kind}>").coalesce(1)


def test_a_task_hands_on_the_best_of_all_its_batches(spark, small_batches, monkeypatch):
    rng = np.random.default_rng(1)
    index, asked = table(spark, rng.normal(size=(500, 8)), "chunk_ord"), table(spark, rng.normal(size=(9, 8)), "query_id")
    monkeypatch.setattr(retrieval, "top", lambda df, *_: df)
    assert retrieval.knn(index, asked, 4).count() == 9 * 4


def test_neighbours_are_those_of_all_products(spark, monkeypatch):
    """Also with many equal vectors and with ones so near that 32 bits part them wrongly, in small slices and blocks."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 16))
    v = np.concatenate([v, v, v[:5] + 1e-9 * rng.normal(size=(5, 16)), v[:20] * (1 + 3e-7), np.zeros((3, 16))])
    q = np.concatenate([v[:6], rng.normal(size=(5, 16))])
    for name, limit in (("CHUNKS", 4), ("CELLS", 50), ("MERGED", 7), ("BLOCK_NUMBERS", 64)):
        monkeypatch.setattr(retrieval, name, limit)
    got = sorted((r.query_id, r["rank"], r.chunk_ord, r.score) for r in retrieval.knn(table(spark, v, "chunk_ord"), table(spark, q, "query_id"), 7).collect())
    want = []
    for a, row in enumerate((q @ v.T).astype(np.float32).astype(float)):
        best = sorted(range(len(v)), key=lambda i: (-row[i], i))[:7]
        want += [(a, n + 1, i, row[i]) for n, i in enumerate(best)]
    assert got == want


def test_text_goes_to_the_candidates(spark, data):
    asked = engine.questions(spark, data).withColumnRenamed("text", "query")
    found = answer.candidates(asked, engine.corpus_index(spark, data))
    assert "BroadcastHashJoin [chunk_ord#" in plan(found)
    rows = found.select("query_id", "chunk_ord", "strategy", "place", F.length("text").alias("n")).collect()
    assert rows and {r.strategy for r in rows} == {"fixed"} and max(r.place for r in rows) == answer.HEAD


def test_candidates_of_one_strategy_and_without_broadcast(spark, data, monkeypatch):
    docs = engine.docs(spark, data).limit(40)
    index, asked = answer.Index.build(docs), engine.questions(spark, data).limit(5).withColumnRenamed("text", "query")
    rows = lambda: sorted(map(tuple, answer.candidates(asked, index, "sentence").select("query_id", "place", "chunk_ord", "strategy", "text", "parent_text").collect()))
    want = rows()
    assert want and {r[3] for r in want} == {"sentence"}
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    assert rows() == want


def test_searches_of_an_answer_are_run_once(spark, data):
    asked = engine.questions(spark, data).withColumnRenamed("text", "query")
    assert "InMemoryTableScan" in plan(answer.answer(asked, engine.corpus_index(spark, data)))
