"""Near copies of the pipeline, against all pairs of exact 5-word shingle sets."""

import random

import corpus_pipeline
import pytest

from lodestone.llm import components, simhash


def plain_shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    """The least ids of the components of (id, text)."""
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return sorted(rows[i][0] for i in range(len(rows)) if top(i) == i)


def variants(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(8, 200))]
        for changes in (0, 1, 1, 2, 3, 4, 6, 9):
            copy = list(base)
            for _ in range(changes):
                copy[rnd.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("tile", [3, simhash.TILE])
def test_near_copies_against_all_pairs(spark, docs, tile):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(variants(5) + [None, "", " \n", "one", "One", "one two"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(df, tile=tile, compared=max(tile, 20)).collect()) == plain_kept(rows)
    assert simhash.representatives(df.limit(0)).count() == 0


def test_pipeline_leaves_no_near_copies(spark, data):
    """Nor a pair of them: the stage is held against all pairs."""
    held = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        if name == "decontaminate":
            break
        held = stage(spark, held, data)
    kept = [(r.doc_id, r.text) for r in held.collect()]
    assert kept and len(plain_kept(kept)) == len(kept)


def test_near_copies_of_odd_rows(spark, odd):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    texts = {frozenset(plain_shingles(r.text)) for r in odd.collect()}
    assert len(texts) >= kept.count() == len({frozenset(plain_shingles(r.text)) for r in kept.collect()})


@pytest.mark.parametrize("tiles", [1, 2, 64])
def test_tiles_meet_all_others(spark, monkeypatch, tiles):
    """However few partner tiles a task takes at once, no pair is lost."""
    monkeypatch.setattr(simhash, "TILES", tiles)
    rnd = random.Random(7)
    base = [[rnd.getrandbits(64) for _ in range(2)] for _ in range(15)]
    rows = []
    for i in range(120):
        a, b = base[i % 15]
        for _ in range(rnd.randint(0, 6)):
            a, b = a ^ 1 << rnd.randrange(64), b ^ 1 << rnd.randrange(64)
        rows.append((i, [a, b], rnd.choice([3, 4, 5, 9])))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(i, [signed(x) for x in w], s) for i, w, s in rows], "node long, words array<long>, s int")
    root = list(range(len(rows)))
    top = lambda x: x if root[x] == x else top(root[x])
    for i, w, s in rows:
        for j, v, t in rows[:i]:
            if abs(s - t) <= 1 and sum((x ^ y).bit_count() for x, y in zip(w, v)) <= 5:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(simhash.links(df, 5, 4, steps=[1])).collect()}
    assert [got.get(i, i) for i in range(len(rows))] == [top(i) for i in range(len(rows))]
