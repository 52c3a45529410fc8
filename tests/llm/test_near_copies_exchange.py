"""What near-duplicates exchange: not the texts of rows that stay, and a tile once for each home it meets, not for each tile."""

import random

import pytest
from test_near_copies import plain_kept, variants

from lodestone.llm import components, simhash


def exchanged(df):
    """Rows that the exchanges of a collected result wrote."""

    def walk(node):
        kind, found = node.getClass().getSimpleName(), 0
        if kind == "ShuffleExchangeExec":
            found += node.metrics().apply("shuffleRecordsWritten").value()
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        return found + sum(map(walk, below))

    return walk(df._jdf.queryExecution().executedPlan())


def test_rows_that_stay_are_not_exchanged(spark, docs):
    """Tables too large to be sent to every task are joined by exchanges, as on a large input."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.representatives(docs.select("doc_id", "text"))
        got = sorted(r.doc_id for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == plain_kept(rows) and 0 < len(got) < len(rows)
    assert exchanged(kept) <= 3 * (len(rows) - len(got))


@pytest.mark.parametrize("marks", [1, simhash.MARKS])
def test_marks_lose_and_keep_the_right_rows(spark, monkeypatch, marks):
    """However few marks there are; rows that repeat key and text come once."""
    monkeypatch.setattr(simhash, "MARKS", marks)
    rows = list(enumerate(variants(9) + [None, "", "one", "One"]))
    twice = [*rows, *rows[::3], (None, "no id"), (None, "no id")]
    for given in (rows, twice):
        got = [r.doc_id for r in simhash.representatives(spark.createDataFrame(given, "doc_id long, text string")).collect()]
        assert sorted(i for i in got if i is not None) == plain_kept(rows) and got.count(None) == (given is twice)


@pytest.mark.parametrize("tiles, homes", [(1, 3), (2, 16), (64, 2)])
def test_homes_of_several_tiles(spark, monkeypatch, tiles, homes):
    monkeypatch.setattr(simhash, "TILES", tiles)
    rnd = random.Random(11)
    base = [rnd.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(150):
        a = base[i % 12]
        for _ in range(rnd.randint(0, 4)):
            a ^= 1 << rnd.randrange(64)
        rows.append((i, a, rnd.choice([3, 4, 5, 9])))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(i, [signed(a)], s) for i, a, s in rows], "node long, words array<long>, s int")
    root = list(range(len(rows)))
    top = lambda x: x if root[x] == x else top(root[x])
    for i, a, s in rows:
        for j, b, t in rows[:i]:
            if abs(s - t) <= 1 and (a ^ b).bit_count() <= 4:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(simhash.links(df, 4, 4, steps=[1], homes=homes)).collect()}
    assert [got.get(i, i) for i in range(len(rows))] == [top(i) for i in range(len(rows))]
