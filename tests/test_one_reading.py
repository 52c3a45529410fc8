"""Explorer and grounding read the text once."""

from lodestone import queries as engine
from lodestone.operators import explorer


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_search_for_any_of_two_cuts_the_documents_once(spark, data):
    found = engine.QUERIES["explore_search"](spark, data)
    assert plan(found).count("MapInArrow") == 1 and "Exchange" not in plan(found)
    chunks = spark.createDataFrame([(1, "Nation***", "T", "fixed"), (2, "x", "100%%%", "fixed"), (3, "both tion*** %%%", None, "sentence"), (4, "none", None, "fixed")], "chunk_ord long, text string, title string, strategy string")
    assert sorted(r.chunk_ord for r in explorer.search(chunks, ["TION***", "", "%%%"]).collect()) == [1, 2, 3]
    assert [r.chunk_ord for r in explorer.search(chunks, ["TION***"], "sentence").collect()] == [3]
    assert explorer.search(chunks, []).count() == explorer.search(chunks).count() == 4


def test_grounding_normalises_where_it_measures(spark, data):
    found = engine.QUERIES["grounding_all"](spark, data)
    documents = plan(found).split("MapInArrow")[1]
    assert "regexp_replace" not in documents


def test_answers_inside_of_a_source_by_parts_of_words():
    from lodestone.operators.grounding_pairs import Block

    answers = ["cat", "at sat on", "the cat sat", "cat sat on the ma", "a b"]
    passed, confidence = Block(answers).measure("the cat sat on the mat".split())
    assert [a for a, p, c in zip(answers, passed, confidence) if p and c == 1] == ["cat", "at sat on", "the cat sat", "cat sat on the ma"]
