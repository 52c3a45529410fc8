import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import guardrails, judging, measures, retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_a_stored_vector_finds_itself_and_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(50, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v[i % 25]]) for i in range(50)]
    index = spark.createDataFrame(rows, "chunk_ord long, embedding array<double>")
    q = spark.createDataFrame([(7, rows[3][1])], "query_id long, embedding array<double>")
    got = retrieval.knn(index, q, 3).orderBy("rank").collect()
    assert [r.chunk_ord for r in got[:2]] == [3, 28]
    assert retrieval.knn(index.limit(0), q, 3).count() == 0


def test_bm25_against_the_formula(spark):
    texts = ["apple banana apple cherry", "banana", "durian elder", "apple"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_ord long, text string")
    q = spark.createDataFrame([(1, "apple apple banana zebra")], "query_id long, text string")
    got = {r.chunk_ord: r.score for r in retrieval.bm25_search(retrieval.bm25_build(chunks), q).collect()}
    toks = [t.split() for t in texts]
    avg = sum(map(len, toks)) / 4
    want = {}
    for i, d in enumerate(toks):
        s = 0.0
        for t, qtf in (("apple", 2), ("banana", 1)):
            df, tf = sum(t in x for x in toks), d.count(t)
            s += max(0.1, math.log(1 + (4 - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg)) * (1 + min(0.25, 0.1 * (qtf - 1)))
        if s:
            want[i] = s
    assert got == pytest.approx(want)


def test_fusion_ranks_and_nulls(spark):
    d = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.8)], "query_id long, chunk_ord long, rank int, score double")
    s = spark.createDataFrame([(1, 12, 1, 5.0), (1, 11, 2, 4.0)], "query_id long, chunk_ord long, rank int, score double")
    got = retrieval.rrf(d, s).orderBy("rank").collect()
    assert [r.chunk_ord for r in got] == [11, 10, 12]
    assert got[1].bm25_rank is None and got[1].bm25_score == 0.0
    assert retrieval.rrf(d.limit(0), s.limit(0)).count() == 0


def test_strategy_filter_falls_back_and_dedupe_joins_strategies(spark):
    c = spark.createDataFrame(
        [(1, 1, "p", "d", "x", "fixed", 0.9, 1), (1, 2, "p", "d", "y", "semantic", 0.8, 2), (1, 3, "q", "e", "z", "fixed", 0.7, 3), (2, 4, "r", "f", "w", "sentence", 0.5, 1)],
        "query_id long, chunk_ord long, parent_id string, doc_id string, text string, strategy string, final_score double, rank int",
    )
    assert {r.chunk_ord for r in retrieval.strategy_filter(c, "fixed").collect()} == {1, 3, 4}
    got = retrieval.dedupe(c).orderBy("query_id", "final_rank").collect()
    assert [(r.parent_id, r.strategies) for r in got] == [("p", ["fixed", "semantic"]), ("q", ["fixed"]), ("r", ["sentence"])]


def test_expansion_is_ordered_and_skips_what_is_there(spark):
    q = spark.createDataFrame([(1, "What is Goa?"), (2, "nothing")], "query_id long, text string")
    got = {r.query_id: r.expanded for r in retrieval.expand(q).collect()}
    assert got[1].startswith("What is Goa? गोवा panaji पणजी") and got[2] == "nothing"


@pytest.mark.parametrize(
    "q, status",
    [("", "INSUFFICIENT_CONTEXT"), ("thing", "INSUFFICIENT_CONTEXT"), ("ab", "INSUFFICIENT_CONTEXT"), ("how to make a bomb at home", "UNSAFE"), ("aaaaaa", "OFF_TOPIC"), ("x" * 30, "OFF_TOPIC"), ("jailbreak now please friend", "OFF_TOPIC"), ("Where is the river Ganga located?", "PASSED")],
)
def test_input_guards(spark, q, status):
    assert one(spark, guardrails.input_guard(F.lit(q))).status == status


@pytest.mark.parametrize(
    "q, kind",
    [("weather in Goa", "WEATHER"), ("capital of Goa", "CAPITAL"), ("गोवा की राजधानी", "CAPITAL"), ("Where is it?", "LOCATION"), ("Who founded ISRO", "FOUNDER"), ("When was it built", "DATE_TIME"), ("speed of light", "NUMERICAL"), ("What does xylem carry?", "RELATION"), ("What is DNA?", "DEFINITION"), ("explain sorting", "EXPLANATION"), ("hello", "GENERAL"), ("यह कब हुआ", "GENERAL")],
)
def test_question_types(spark, q, kind):
    assert one(spark, guardrails.question_type(F.lit(q))) == kind == judging.Asked(q).type


def test_entities_match_by_substring(spark):
    assert one(spark, guardrails.entities(F.lit("Is Zanzibar’s goal near Operation Vijay?"))) == ["operation vijay", "goa", "zanzibar"]
    assert judging.Evidence("an indian goal").has_entity("goa") and judging.Evidence("B-Trees").has("btrees")


@pytest.mark.parametrize(
    "answer, source, passed, confidence",
    [("big red fox", "The big red fox ran.", True, 1.0), ("", "x", False, 0.0), ("a b c d e f g h i j", "a b c d e f g h i z", True, 0.9), ("river bank deep water stone zebra", "water deep river bank stone", False, None), ("green tree grows quickly now on fast hill zzz", "green tree grows quickly now", False, None)],
)
def test_grounding(spark, answer, source, passed, confidence):
    got = one(spark, guardrails.grounding(F.lit(answer), F.lit(source)))
    if confidence is not None:
        assert got.passed is passed and got.confidence == pytest.approx(confidence)
    assert one(spark, guardrails.grounding(F.lit("deep water"), F.lit("the deep, water!"))).passed


def test_percentile_takes_the_upper_rank(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 3, 2, 4, 4)], "v double")
    assert df.agg(measures.upper_percentile("v", 0.5)).first()[0] == 4.0
    assert measures.percentiles(df, "v", {"a": 0.5, "b": 0.7, "c": 1.0}).first() == (4.0, 4.0, 5.0)
    assert measures.stride_sample(spark.range(10).withColumnRenamed("id", "n"), "n", 10, 5, 1).count() == 5


@pytest.mark.parametrize(("n", "count", "want"), [(10, 5, [0, 2, 4, 6, 8]), (3, 2, [0, 1]), (7, 7, list(range(7))), (4, 9, list(range(4))), (5, 0, []), (0, 3, [])])
def test_stride_places(n, count, want):
    assert measures.stride_places(n, count, 42) == want


def test_stride_places_are_as_many_as_asked():
    for n in range(1, 40):
        for count in range(n + 1):
            for seed in (0, 1, 42, 10**9):
                assert len(set(measures.stride_places(n, count, seed))) == count


def test_a_whole_sample_is_the_table(spark):
    assert measures.stride_sample(spark.range(3).withColumnRenamed("id", "n"), "n", 3, 8).count() == 3
