"""Repeats, languages, toxicity, near-duplicates, components, shards and the pipeline."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestone.llm import anchors, components, language, queries, sharding, simhash, suffix_dedup, toxicity


def test_repeats_against_all_strings(spark, odd):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(150, 900))) for _ in range(20)]
    texts = [None, "", "x" * 199, "x" * 200, "y" * 201, base[0], base[0]]
    for _ in range(100):
        t = ""
        for _ in range(rnd.randint(1, 5)):
            b = rnd.choice(base)
            at = rnd.randint(0, len(b) - 1)
            t += b[at : at + rnd.randint(50, 500)] + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 60)))
        texts.append(t)
    rows = [(i if i != 9 else None, t) for i, t in enumerate(texts)]
    length = anchors.LENGTH
    data = [(t or "").encode() for t in texts]
    often = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    got = {(r.doc_id, r.text): r for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), batches=3).collect()}
    for row, d in zip(rows, data):
        covered = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if often[d[i : i + length]] > 1:
                covered[i : i + length] = True
        r = got[row]
        assert bytes(r.kept) == bytes(b for b, c in zip(d, covered) if not c)
        mask = np.zeros(len(d), dtype=bool)
        for s in r.removed:
            mask[s.start : s.end] = True
        assert (mask == covered).all() and all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))
    assert suffix_dedup.deduplicate(odd, batches=2).count() == odd.count()
    assert suffix_dedup.deduplicate(odd.limit(0)).count() == 0


def test_long_texts_are_cut_without_losing_windows():
    texts = [b"", b"a" * 199, b"b" * 200, bytes(range(256)) * 4]
    parts = list(anchors.segments(texts, 100))
    for k, t in enumerate(texts):
        own = [(at, p) for j, at, p in parts if j == k]
        assert {at + i for at, p in own for i in range(len(p) - 199)} == set(range(max(0, len(t) - 199)))


def test_languages_of_pages_and_documents(spark, docs, data, odd):
    model = language.fit(docs)
    got = language.identify(docs, model, host=F.col("source"), keep=["doc_id", "lang"]).toPandas()
    assert (got["lang"] == got["language"]).mean() > 0.97 and got["accepted"].mean() > 0.99
    found = queries.op4_language(spark, data).toPandas()
    assert (found["declared"] == found["text_language"]).mean() > 0.95
    rows = language.identify(odd, model, host=F.col("source"), declared=F.col("lang"))
    assert rows.columns == [c for c in odd.columns if c != "language"] + ["language", "probability", "text_language", "accepted"]
    by = {r.doc_id: r for r in rows.filter("doc_id in (0, 1, 2, 12)").collect()}
    assert {r.language for r in by.values()} == {"und"} and not any(r.accepted for r in by.values())
    assert language.identify(odd.limit(0), model).count() == 0
    nothing = language.fit(docs.limit(0))
    assert language.identify(docs, nothing).filter("language = 'und' and accepted").count() == docs.filter("text rlike '[A-Za-z]'").count()


def test_hosts_and_declarations_settle_what_the_text_leaves_open(spark):
    table = np.full((language.BUCKETS, 2), -8.0, dtype=np.float32)
    table[language.trigrams("ja"), 0] += 1
    table[language.trigrams("nee"), 1] += 1
    model = language.Model(["de", "nl"], table)
    rows = [(i, "nee" if i < 30 else "ja", "h.nl" if i < 30 else "h.de", "nl" if i < 30 else "de") for i in range(60)] + [(100, "zzz", "h.nl", None), (101, "zzz", "new.x", "de")]
    df = spark.createDataFrame(rows, "id long, text string, host string, tag string")
    got = {r.id: r.language for r in language.identify(df, model, host=F.col("host"), suffix=F.substring_index("host", ".", -1), declared=F.col("tag")).collect()}
    assert got[100] == "nl" and got[101] == "de"


def test_page_parts(spark):
    html = '<html LANG="de-AT"><script>x<y</script><body><nav>n</nav><article>Gut &amp; <b>schön</b></article>tail</body>'
    r = language.page_parts(spark.createDataFrame([("http://u@A.b.Co.UK:80/x", html), (None, None)], "url string, html string")).collect()
    assert (r[0].host, r[0].domain, r[0].suffix, r[0].declared, r[0].text.split()) == ("a.b.co.uk", "co.uk", "uk", "de", ["Gut", "schön"])
    assert (r[1].host, r[1].declared, r[1].text) == (None, None, "")


def test_toxicity_on_held_out_rows(spark, odd):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = docs.join(labels, "doc_id")
    model = toxicity.fit(known.select("doc_id", "text"), labels)
    held = toxicity.score(known, model, keep=["doc_id", "toxic"]).filter(toxicity.held_out("doc_id")).toPandas()
    hit, toxic = held["score"] >= toxicity.THRESHOLD, held["toxic"] == 1
    assert (hit & toxic).sum() / toxic.sum() > 0.8 and (hit & ~toxic).sum() / (~toxic).sum() < 0.005
    for r in spark.range(50).select("id", toxicity.held_out("id").alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1)
    scores = toxicity.score(odd, model)
    assert scores.filter("score between 0 and 1").count() == odd.count()
    assert toxicity.score(odd.limit(0), model).count() == 0
    untaught = toxicity.fit(odd, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, untaught).collect()} == {0.5}


def test_interactions_that_weights_alone_miss():
    """Two words that are harmless alone and toxic together, and the other way round."""
    rows = [(int(a != b), [1] * a + [2] * b + [3]) for a in (0, 1) for b in (0, 1) for _ in range(100)]
    machine = toxicity.fit_machine(rows, [1, 2, 3])
    assert all((machine.score([1] * a + [2] * b + [3]) >= 0.5) == (a != b) for a in (0, 1) for b in (0, 1))


def test_scores_against_a_plain_sum_over_pairs(spark, docs):
    """The machine's formula as it is written, over words found without the operator's own functions."""
    texts = [r.text or "" for r in docs.select("text").limit(60).collect()]
    plain = lambda t: {zlib.crc32(w.encode()) % toxicity.BUCKETS for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()}
    known = sorted(set().union(*map(plain, texts)))[::3]
    rnd = np.random.default_rng(3)
    machine = toxicity.Machine(-0.4, {f: i for i, f in enumerate(known)}, rnd.normal(0, 0.2, len(known)).astype(np.float32), rnd.normal(0, 0.1, (len(known), 8)).astype(np.float32))
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), machine, keep=["doc_id"]).collect()
    assert len(got) == len(texts)
    for r in got:
        at = [machine.place[f] for f in plain(texts[r.doc_id]) if f in machine.place]
        margin = machine.bias + sum(float(machine.weights[i]) for i in at)
        margin += sum(float(machine.factors[i].astype(float) @ machine.factors[j].astype(float)) for i in at for j in at if i < j)
        assert abs(r.score - 1 / (1 + np.exp(-margin))) < 1e-4


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=2):
    root = list(range(len(ids)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[top(i)] = min(x, least.get(top(i), x))
    return [least.get(top(i)) for i in range(len(ids))]


@pytest.mark.parametrize("tile", [3, simhash.TILE])
def test_near_duplicates_against_all_pairs(spark, docs, odd, tile):
    df = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    rows = df.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = Counter(zip([r.doc_id for r in rows], fps, plain_components([r.doc_id for r in rows], fps)))
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df, tile=tile).collect())
    assert got == want
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_links_of_close_fingerprints(spark):
    rnd = random.Random(2)
    fps = list({f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for f in [rnd.getrandbits(64) for _ in range(12)] for _ in range(25)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=7)
    got = dict((r.node, r.root) for r in components.components(edges).collect())
    want = plain_components(signed, fps)
    assert [got.get(s, s) for s in signed] == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(5, 5), (3, 4), (4, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{x: 7 for x in range(200, 260)}, 4: 3}


def test_shards(spark, docs, odd):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same text").otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"))
    for df, bound in ((docs, None), (hot, 0.01), (odd, None), (odd.limit(0), None)):
        got = sharding.shard(df, keep=["doc_id", "text"]).toPandas()
        assert len(got) == df.count()
        for r in got.itertuples():
            data = (r.text or "").encode()
            assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        for _, part in got.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))
        if len(got):
            sizes = [got.loc[got["shard"] == k, "size"].sum() for k in range(8)]
            largest = got["size"].max()
            assert max(sizes) - min(sizes) <= (bound * sum(sizes) / 8 + 2 * largest if bound else 2 * largest)
    assert sharding.shard(odd).columns == [c for c in odd.columns if c != "size"] + ["size", "text_crc32", "shard", "slot"]


def test_equal_texts_stay_together_where_they_fit(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 800).cast("string")).alias("text"))
    split = sharding.shard(df).groupBy("text").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count()
    assert split <= 7


def test_shards_of_many_crowded_ranges(spark, monkeypatch):
    """Every range of hashes is cut, and rows of one text and key too."""
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 1)
    df = spark.range(9000).select(F.when(F.col("id") < 3000, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 3000, "one text").otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"))
    got = sharding.shard(df).toPandas()
    assert len(got) == 9000
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_shards_as_by_sorting_all_rows(spark, docs):
    """Shards follow one order of all rows, and each border lies within the tolerance of its share of the bytes."""
    got = sharding.shard(docs).select("doc_id", "size", "shard", F.xxhash64("text").alias("k1")).toPandas().sort_values(["k1", "doc_id"])
    assert got["shard"].is_monotonic_increasing
    total, largest = got["size"].sum(), got["size"].max()
    for k in range(1, 8):
        assert abs(got.loc[got["shard"] < k, "size"].sum() - total * k / 8) <= max(largest, sharding.TOLERANCE * total / 8)


def plain_language(rows, model, host, declared):
    """identify() by plain sums: (language, accepted) of each of rows (text, host, declared)."""
    n = len(model.languages)
    means = [[model.table[language.trigrams(t or "")].astype(float).mean(axis=0)][0] if len(language.trigrams(t or "")) else None for t, _, _ in rows]
    tops = [int(m.argmax()) if m is not None and m.max() > language.FLOOR else None for m in means]
    everywhere = np.array([tops.count(i) + 1.0 for i in range(n)])
    everywhere /= everywhere.sum()
    tags = {d for (_, _, d), t in zip(rows, tops) if d is not None and t is not None}
    out = []
    for (text, h, d), m, t in zip(rows, means, tops):
        if t is None:
            out.append(("und", False))
            continue
        prior = everywhere
        if h is not None:
            own = np.array([sum(1 for (_, o, _), u in zip(rows, tops) if o == h and u == i) for i in range(n)], dtype=float)
            own[t] -= 1
            prior = (own + language.KAPPA * everywhere) / (own.sum() + language.KAPPA)
        logs = language.TEMPER * len(language.trigrams(text)) * m + np.log(prior)
        if d in tags:
            logs += np.log([(sum(1 for (_, _, e), u in zip(rows, tops) if e == d and u == i) + language.ALPHA) / (tops.count(i) + language.ALPHA * (len(tags) + 1)) for i in range(n)])
        out.append((model.languages[int(logs.argmax())], True))
    return out


def test_languages_against_plain_sums(spark, docs):
    model = language.fit(docs)
    rnd = random.Random(3)
    texts = [r.text for r in docs.select("text").collect()][:60]
    rows = [(t if rnd.random() < 0.3 else t[: rnd.randint(0, 25)], rnd.choice([None, "a.x", "b.y"]), rnd.choice([None, "en", "de", "zz", "en"])) for t in texts * 2]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, host string, tag string")
    got = {r.id: (r.language, r.accepted) for r in language.identify(df, model, host=F.col("host"), declared=F.col("tag")).collect()}
    assert [got[i] for i in range(len(rows))] == plain_language(rows, model, 1, 2)


def test_any_number_of_labels_and_tags(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("wort"), F.col("id").cast("string"), F.lit(" word nee ja")).alias("text"), F.concat(F.lit("tag"), (F.col("id") % 2000).cast("string")).alias("tag"), F.concat(F.lit("l"), (F.col("id") % 90).cast("string")).alias("lang"))
    model = language.fit(df)
    assert len(model.languages) == 90
    assert language.identify(df, language.Model(model.languages[:3], model.table[:, :3]), declared=F.col("tag")).filter("accepted").count() == 3000


def test_pages_of_several_articles(spark):
    html = ["<html><body><main><article>Eins <article>zwei</article> drei</article> mehr</main><article>vier</article>tail</body>", "<article>123</article><p>Text</p>", None]
    got = [r.text.split() for r in language.page_parts(spark.createDataFrame([(None, h) for h in html], "url string, html string")).collect()]
    assert got == [["Eins", "zwei", "drei", "mehr", "vier"], ["123", "Text"], []]
    assert language.page_parts(spark.createDataFrame([], "url string, html string")).count() == 0


def test_pipeline_stages(spark, data, odd):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    extra = odd.select(*columns, F.lit("x").alias("fp"), F.lit("y").alias("__found2"))
    for df in (docs, extra, extra.limit(0)):
        held = df
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, held, data)
            if name != "encode":
                assert out.columns == df.columns
                assert out.count() <= held.count()
            held = out.cache()
        assert {"doc_id", "n_tokens", "ids"} <= set(held.columns)


def test_pipeline_decisions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    f = dict(corpus_pipeline.STAGES)
    assert f["language"](spark, docs, data).count() >= 0.99 * docs.count()
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    found = {r.doc_id for r in queries.op7_decontam(spark, data).collect()}
    assert {r.doc_id for r in f["decontaminate"](spark, docs, data).collect()} == set(ids) - found and found
    clean = f["secrets"](spark, docs, data)
    changed = clean.filter("text like '%[SECRET]%'")
    assert changed.count() == queries.op1_secrets(spark, data).filter("spans != ''").count() and changed.filter("n_chars != length(text)").count() == 0


def test_levels_hold_each_block_once(spark, docs):
    index = suffix_dedup.SuffixIndex(spark)
    texts = docs.select(F.xxhash64("text", "doc_id").alias("rid"), F.col("text").cast("binary").alias("__bytes"))
    for k in range(3):
        index.add(texts.filter(F.pmod("rid", F.lit(3)) == k))
    assert sorted(index.levels) == [0, 1]
    found = index.scan().toPandas()
    assert found.groupby(["a", "b"]).size().max() == 1
    assert (found.groupby("a")["b"].transform("size") - 1 == found["others"]).all()
