"""Every benchmark answer against every document: as the column function has it, pair by pair."""

from pyspark.sql import functions as F

from lodestone import queries as engine
from lodestone.operators import grounding_pairs, guardrails


def rows(df):
    return sorted(((r.item_id, r.doc_id, r.passed, round(r.confidence, 9)) for r in df.collect()), key=repr)


def test_every_pair_as_the_column_function(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").filter("doc_id < 60")
    texts = [None, "", "the of", "Deep water, a cat", "the deep water", "concatenate many things", "blue whale swims in deep cold water today"]
    d = d.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    b = spark.read.parquet(f"{data}/benchmark.parquet").filter("item_id < 12")
    made = [None, "", "the of", "deep water", "cat", "deep blue water", "blue whale swims deep cold river", "the the cat cat sat"]
    b = b.unionByName(spark.createDataFrame([(2000 + i, t) for i, t in enumerate(made)], "item_id long, text string"))
    # Whole words of a document, so that each way to pass is met.
    b = b.unionByName(d.filter("doc_id between 3 and 6").select((F.col("doc_id") + 3000).alias("item_id"), F.substring("text", 20, 120).alias("text")))
    pairs = b.select("item_id", F.col("text").alias("a")).crossJoin(d.select("doc_id", F.col("text").alias("s")))
    want = pairs.withColumn("g", guardrails.grounding(F.col("a"), F.col("s"))).select("item_id", "doc_id", "g.passed", "g.confidence")
    got = rows(grounding_pairs.every_pair(b, d))
    assert got == rows(want)
    assert any(p for _, _, p, _ in got) and not all(p for _, _, p, _ in got)
    assert grounding_pairs.every_pair(b.limit(0), d).count() == 0


def test_documents_of_any_residue(spark, tmp_path):
    spark.createDataFrame([(1, "deep cold water")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(2, "a whale in deep cold water"), (41, "nothing")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.passed) for r in engine.QUERIES["grounding_all"](spark, str(tmp_path)).collect()}
    assert found == {(2, True), (41, False)}
    assert "grounding_check" not in engine.QUERIES and "%" not in engine.ORACLE["grounding_all"]
