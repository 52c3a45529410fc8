"""BM25 tables and searches made in one reading of the chunks: nothing is exchanged but what is best."""

import re

import numpy as np
import pytest

from lodestone import queries as engine
from lodestone.functions import text
from lodestone.operators import chunking, retrieval


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def index(spark, data):
    return engine.chunk_index(spark, data)


def test_fusion_exchanges_no_pairs_and_keeps_nothing(spark, data):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    found = engine.fusion(spark, data)
    assert found.count() and spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert "Generate" not in plan(found)


def test_the_best_as_they_come(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(retrieval, "MERGED", 50)
    best, rows = retrieval.Best(7, 4), []
    for _ in range(60):
        q, i, s = rng.integers(0, 7, 40), rng.integers(0, 10**6, 40), rng.integers(0, 6, 40) / 7
        best.add(q, i, s)
        rows += zip(q.tolist(), i.tolist(), s.tolist())
    best.merge()
    want = [r for q in range(7) for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-round(r[2], 9), r[1]))[:4]]
    assert list(zip(best.query.tolist(), best.id.tolist(), best.score.tolist())) == want


@pytest.mark.parametrize("s", ["Hello, a_b 3.14 ÀÉß²ª", "नमस्ते—दुनिया", "ΑΣ﻿Α İstanbul x\x1cy\x85z", "漢字🙂ok", "été ﬁn Ⅷ", ""])
def test_runs_are_the_words_of_the_normal_form(spark, s):
    for compose in (False, True):
        want = spark.createDataFrame([(s,)], "s string").select(text.normalize(engine.F.col("s"), compose)).first()[0]
        assert text.py_runs(s, compose) == want.split()


def test_chunks_without_rows(spark):
    none = retrieval.bm25_build(spark.createDataFrame([], "chunk_ord long, text string"))
    assert none.stats.first() == (0, 1.0) and none.postings.count() == none.terms.count() == 0
    assert retrieval.bm25_search(none, spark.createDataFrame([(1, "goa")], "query_id long, text string")).count() == 0
    assert chunking.fixed(spark.createDataFrame([], "id string, ord long, title string, text string, language string, source string, query string")).count() == 0


def test_search_by_chunks_and_by_postings(spark, data, index):
    asked = engine.questions(spark, data).unionByName(spark.createDataFrame([(900, "the the goa goa goa"), (901, ""), (902, None)], "query_id long, text string"))
    got = retrieval.bm25_search(index, asked)
    assert "chunk_ord" not in "".join(re.findall(r"hashpartitioning\((.*?)\)", plan(got)))
    want = retrieval.bm25_search(retrieval.Bm25(index.postings, index.terms, index.stats), asked)
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_ord, round(r.score, 8)) for r in df.collect())
    assert rows(got) == rows(want)


def test_queries_block_by_block(index, monkeypatch):
    chunks, asked = index.chunks.limit(300), [(1, "the", 1.0), (2, "the", 1.0), (2, "that", 0.5), (3, "nowhere", 1.0)]
    whole = sorted(map(tuple, retrieval.scan(chunks, asked, 5, []).collect()))
    assert {r[0] for r in whole} == {1, 2} and retrieval.scan(chunks, [], 5, []).count() == 0
    for name in ("QUERIES", "CELLS", "MERGED", "OUT"):
        monkeypatch.setattr(retrieval, name, 1)
    assert sorted(map(tuple, retrieval.scan(chunks, asked, 5, []).collect())) == whole


def test_postings_are_not_exchanged(index):
    assert "Exchange" not in plan(index.postings)


def test_frequencies_are_exchanged_by_term_alone(index):
    assert re.findall(r"hashpartitioning\(([^#]*)#", plan(index.terms)) == ["term"]


@pytest.mark.parametrize("name", ["strategy_filter", "dedupe_parent"])
def test_queries_over_the_fusion(spark, data, name):
    found = engine.QUERIES[name](spark, data)
    assert "Generate" not in plan(found) and found.count()
