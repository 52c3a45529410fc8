"""Secrets, fingerprints, decontamination, word pieces, BPE: against brute force, and on odd rows."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontam, fingerprints, queries, secrets, wordpiece

BYTE_BPE = P.path("byte_bpe_50k.tiktoken")


def scan(t):
    t, out = t or "", []
    for m in re.finditer(secrets.ASSIGN[4:], t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, p, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t) if len(m[0]) >= least]
    base = list(out)
    for m in re.finditer(secrets.CANDIDATE, t):
        fits = lambda p: re.search(p.replace(r"\z", r"\Z"), m[0])
        if any(map(fits, secrets.ALLOWED)):
            continue
        limit = secrets.most(next(bits for p, bits in secrets.CLASSES if fits(p)))
        hot = [i for i in range(len(m[0]) - secrets.WINDOW + 1) if sum(map(secrets.weight, Counter(m[0][i : i + secrets.WINDOW]).values())) <= limit]
        if hot:
            e = (m.start() + hot[0], 3, m.start() + hot[-1] + secrets.WINDOW)
            if not any(b[0] < e[2] and e[0] < b[2] for b in base):
                out.append(e)
    return [(secrets.KINDS[k], s, e) for s, k, e in sorted(out)]


def test_secrets_and_redaction(spark, odd, docs):
    rnd = random.Random(3)
    pick = lambda letters, a, b: "".join(rnd.choice(letters) for _ in range(rnd.randint(a, b)))
    parts = [lambda: "é🙂 word ", lambda: "SECRET=", lambda: "api_key : '", lambda: pick("ABCdef0123456789+/xyzQRS", 5, 60), lambda: pick("0123456789abcdef", 10, 50), lambda: " ", lambda: "AKIA" + pick("ABC12", 5, 30), lambda: "\n", lambda: "a" * 40, lambda: "token: password: abcdefgh"]
    made = ["".join(rnd.choice(parts)() for _ in range(rnd.randint(1, 12))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").unionByName(docs.select("doc_id", "text")).unionByName(odd.select("doc_id", "text"))
    seen = Counter()
    for r in secrets.redact(secrets.scan(df).withColumn("raw", F.col("text"))).collect():
        want = scan(r.raw)
        assert [tuple(s) for s in r.secrets] == want
        seen.update(k for k, _, _ in want)
        left, at = "", 0
        for _, s, e in sorted(want, key=lambda x: x[1]):
            if s >= at:
                left += r.raw[at:s] + "[SECRET]"
            at = max(at, e)
        assert r.text == (left + r.raw[at:] if want else r.raw)
    assert all(seen[k] for k in secrets.KINDS)
    assert secrets.scan(odd).columns == [c for c in odd.columns if c != "secrets"] + ["secrets"]
    assert secrets.scan(odd.limit(0)).count() == 0


def shingles(t, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_fingerprints(spark, docs, data):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op2_fingerprints(spark, data).collect()}
    assert len(got) == len(rows)
    errors = []
    for r, after in zip(rows, rows[1:] + rows[:1]):
        cut = len(r.text) // 4
        edited = r.text[: len(r.text) - cut] + after.text[:cut]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(r.text), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((g.near_edited, edited), (g.near_next, after.text)):
            a, b = shingles(r.text), shingles(other)
            want = len(a & b) / len(a | b) if a | b else 1.0
            errors.append(abs(near - want))
            if len(a | b) <= fingerprints.K:
                assert near == pytest.approx(want)
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03


def test_fingerprints_of_odd_rows(spark, odd):
    got = fingerprints.fingerprint(odd)
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r.near_next <= 1 for r in rows)
    same = [tuple(r.sketch) for r in rows if r.text == "Same text here for all of us to see"]
    assert len(same) == 3 and len(set(same)) == 1
    order = sorted((r for r in rows), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text))
    for r, after in zip(order, order[1:] + order[:1]):
        cut = len(r.text) // 4
        assert r.edited == r.text[: len(r.text) - cut] + after.text[:cut]
    assert fingerprints.fingerprint(odd.limit(0)).count() == 0
    alone = fingerprints.fingerprint(odd.filter("doc_id = 4")).first()
    assert alone.near_next == 1.0


def test_sketches_merge_and_estimate(spark):
    parts = spark.sql("select id % 2 as k, concat_ws(' ', transform(sequence(id * 300, id * 300 + 404), x -> concat('w', x))) as text from range(6)")
    whole = spark.sql("select k, concat_ws(' ', collect_list(text)) as text from {p} group by k", p=parts)
    merged = fingerprints.merge(fingerprints.sketch(parts, "text"), "k")
    every = fingerprints.sketch(parts, "text", k=10**6).groupBy("k").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, fingerprints.K).alias("s"))
    assert merged.join(every, "k").filter("sketch = s").count() == 2 == whole.count()
    n = merged.select(fingerprints.distinct_shingles(F.col("sketch")).alias("n")).first().n
    assert n == pytest.approx(3 * 401, rel=0.3)
    small = spark.sql("select 'a b c d e f g' as x, 'a b c d e f g h i j k' as y")
    both = fingerprints.sketch(fingerprints.sketch(small, "x", "sx"), "y", "sy")
    assert both.select(fingerprints.containment(F.col("sx"), F.col("sy"))).first()[0] == pytest.approx(1.0)


def test_decontamination(spark, docs, data, odd):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL["op7_decontam"]).fetchall())
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    for limit in (decontam.BROADCAST_ROWS, 0):
        got = sorted(tuple(r) for r in decontam.search(docs, items, broadcast_rows=limit).collect())
        assert got == want and got
    inside = spark.createDataFrame([(1, "one two three four"), (2, None), (3, ""), (4, "Same text here for all of us"), (4, "word0 token0 word1 token1 word2 token2"), (5, "not anywhere in these rows at all")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.search(odd, inside).collect()}
    assert found == {(4, 1), (5, 4), (6, 4), (7, 4), (9, 4), (10, 4)}
    assert decontam.search(odd.limit(0), inside).count() == decontam.search(odd, inside.limit(0)).count() == 0


def test_small_items_in_long_documents(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    items = [" ".join(word() for _ in range(n)) for n in (5, 6, 9, 12, 40)]
    long = [" ".join([*(word() for _ in range(4000)), item, *(word() for _ in range(4000))]) for item in items]
    found = decontam.search(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.containment) for r in found.collect()) == [(i, i, 1.0) for i in range(5)]


def test_items_of_few_words_ask_for_no_bins(spark):
    """A short item beside long ones, and short ones alone, are found in the documents of just their words."""
    long = " ".join(f"item{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "Tiny item"), (2, f"before {long} after"), (3, "a tiny item in more words than five"), (4, None), (5, "tiny"), (6, "tiny item tiny item tiny item")], "doc_id long, text string")
    items = [(1, "tiny item"), (2, long), (3, "tiny"), (4, ""), (5, None)]
    for some, want in ((items, {(1, 1), (2, 2), (5, 3)}), ([items[0], items[2]], {(1, 1), (5, 3)})):
        for limit in (decontam.BROADCAST_ROWS, 0):
            found = decontam.search(docs, spark.createDataFrame(some, "item_id long, text string"), broadcast_rows=limit)
            assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_word_pieces_against_greedy_matching(spark, odd):
    path = P.path("word_bpe_49k.json")
    w = wordpiece.WordPieces(path)
    vocabulary = {w.split(p, "</w>", wordpiece.byte_alphabet()) for p in w.pieces}
    longest = max(map(len, vocabulary))

    def greedy(word, pieces=vocabulary):
        s, at, n = (*word, wordpiece.END), 0, 0
        while at < len(s):
            end = next((e for e in range(min(len(s), at + longest), at, -1) if s[at:e] in pieces), None)
            if end is None:
                return 1
            at, n = end, n + 1
        return n

    rnd = random.Random(1)
    words = ["".join(rnd.choice("etaoinshrdluéßñ'12漢") for _ in range(rnd.randint(1, 25))).encode() for _ in range(3000)]
    assert [w.automaton.count(x) for x in words] == [greedy(x) for x in words]
    few = {(*b"a",), (*b"ab", wordpiece.END), (*b"abcd",), (*b"bc", wordpiece.END), (*b"c",), (*b"b",), (wordpiece.END,)}
    small = wordpiece.Automaton(few)
    for x in ["".join(rnd.choice("abcdx") for _ in range(rnd.randint(0, 9))).encode() for _ in range(500)]:
        assert small.count(x) == greedy(x, few)
    rows = wordpiece.count(odd, path).collect()
    for r in rows:
        assert (r.n_words, r.n_pieces) == (len(w.words(r.text or "")), sum(greedy(x.encode()) for x in w.words(r.text or "")))
    assert wordpiece.count(odd.limit(0), path).count() == 0


def test_bpe_as_the_library_and_back(spark, docs, odd):
    ranks = bpe.read_ranks(BYTE_BPE)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    letters = "abcdefgh ABC  \n\t\r'sé漢字🙂0123456789.,;:-_=+\x1c\x85 　ñ"
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 400))) for _ in range(300)] + ["a" * n + "=" * (n // 2) for n in range(1, 600, 60)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").unionByName(docs.select("doc_id", "text")).unionByName(odd.select("doc_id", "text"))
    encoded = bpe.encode(df, BYTE_BPE, P.PATTERN)
    for r in bpe.decode(encoded, BYTE_BPE).collect():
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    for r in bpe.encode(odd, BYTE_BPE, P.PATTERN, back=True).collect():
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(odd, BYTE_BPE, P.PATTERN).columns == [c for c in odd.columns if c != "ids"] + ["ids"]
    assert bpe.decode(spark.sql("select cast(null as array<int>) as ids"), BYTE_BPE).first().decoded == b""
    assert bpe.encode(odd.limit(0), BYTE_BPE, P.PATTERN).count() == 0


def test_merges_in_a_vocabulary_of_odd_ranks():
    """Pairs whose product has a lower rank than a pair made later are taken in the library's order too."""
    rnd = random.Random(9)
    for _ in range(30):
        tokens = [bytes([b]) for b in range(256)]
        extra = list({bytes(rnd.choice(b"ab c") for _ in range(rnd.randint(2, 5))) for _ in range(25)})
        ranks = {t: i for i, t in enumerate(tokens + extra)}
        library = tiktoken.Encoding("own", pat_str=r"[^ ]+| ", mergeable_ranks=ranks, special_tokens={})
        replay = bpe.MergeReplay(ranks)
        words = list({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14))) for _ in range(40)})
        assert replay.replay([w.encode() for w in words]) == [library.encode_ordinary(w) for w in words]
