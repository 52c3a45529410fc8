import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import lexicons, text
from lodestone.operators import chunking, embedding

DOC = "id string, ord long, title string, text string, language string, source string, query string"


def docs(spark, *texts, title="T"):
    return spark.createDataFrame([(f"d{i}", i, title, t, None, None, None) for i, t in enumerate(texts)], DOC)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "s, want",
    [("Hello there. Value 3.14 here. Next one.", None), ("One. Two? तीन। end", ["One.", "Two?", "तीन।", "end"]), ("", []), ("no end", ["no end"]), ("a.\nb", ["a.", "b"])],
)
def test_sentences(spark, s, want):
    got = one(spark, text.sentences(F.lit(s)))
    assert got == ([x.strip() for x in chunking._sentence.findall(s) if x.strip()] if want is None else want)


def test_normalize_keeps_marks_and_composes(spark):
    assert one(spark, text.normalize(F.lit("  Ｈello, नमस्ते—B-Tree!  "), compose=True)) == "hello नमस्ते b tree" == text.py_normalize("  Ｈello, नमस्ते—B-Tree!  ")
    assert one(spark, text.normalize(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("w, want", [("carries", "carry"), ("moving", "mov"), ("tried", "try"), ("tied", "tied"), ("stored", "stor"), ("boxes", "box"), ("cats", "cat"), ("gas", "gas")])
def test_stem(spark, w, want):
    assert one(spark, text.stem(F.lit(w))) == want


@pytest.mark.parametrize("n", [0, 1, 60, 61, 105, 106, 400])
def test_fixed_windows(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = [r.text.split() for r in chunking.fixed(docs(spark, " ".join(words))).orderBy("chunk_ord").collect()]
    want, at = [], 0
    while n and (not want or at - 45 + 60 < n):
        want.append(words[at : at + 60])
        at += 45
    assert got == want
    assert not got or got[0] + [w for c in got[1:] for w in c[15:]] == words


def test_sentence_chunks_against_a_plain_loop(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["Some words here. ", "x ", "A much longer sentence with many words in it, really. ", "\n", "3.5 of it? "]) for _ in range(rnd.randint(0, 30))) for _ in range(40)]
    got = {}
    for r in chunking.sentence(docs(spark, *texts)).orderBy("chunk_ord").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for i, t in enumerate(texts):
        want, held, n = [], [], 0
        for s in (x.strip() for x in chunking._sentence.findall(t)):
            if s:
                held.append(s)
                n += len(s.split())
                if len(held) >= 2 and n >= 15 or len(held) >= 3:
                    want.append(" ".join(held))
                    held, n = [], 0
        assert got.get(f"d{i}", []) == want + ([" ".join(held)] if held else [])


def test_semantic_parts_at_transitions_and_paragraphs():
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven"
    got = chunking.semantic_units(f"{long}. However alpha beta again.", tuple(lexicons.TRANSITIONS), 0.05, 30)
    assert got == [f"{long}.", "However alpha beta again."]
    assert chunking.semantic_chunks("a b c\n\nd e f") == ["a b c d e f"]
    assert chunking.semantic_chunks(" ".join(["word"] * 200)) == [" ".join(["word"] * 200)]
    assert chunking.semantic_chunks("") == []


def test_metadata_sections(spark):
    t = "intro line\n# Head\nbody one\nbody two\nCAPS LINE:\n" + " ".join(f"w{i}" for i in range(80)) + "\n## Empty"
    got = [(r.title, r.text.split("] ")[0] + "]", r.word_count, r.chunk_index) for r in chunking.metadata(docs(spark, t)).orderBy("chunk_ord").collect()]
    assert got == [("T", "[T]", 2, 0), ("Head", "[Head]", 4, 1), ("CAPS LINE", "[CAPS LINE]", 75, 2), ("CAPS LINE", "[CAPS LINE]", 5, 3)]
    assert [r.text for r in chunking.metadata(docs(spark, "# Only\n## Heads")).collect()] == ["[T] # Only ## Heads"]


def test_all_strategies_in_order(spark):
    d = docs(spark, "One two. Three four.", "Five. Six.")
    got = [r.chunk_id for r in chunking.chunk(d).orderBy("chunk_ord").collect()]
    assert [re.sub(r"_\d+$", "", x) for x in got] == [f"d{i}_{s}" for i in (0, 1) for s in ("fixed", "sent", "sem", "meta")]


def test_hash_column_and_vectors(spark):
    for w in ["a", "hello", "नमस्ते", "é"]:
        assert one(spark, embedding.hash32(F.lit(w), embedding.TOKEN_SEED)) == embedding.py_hash32(w, embedding.TOKEN_SEED)
    v = embedding.Embedder()("Hello world hello")
    assert abs((v * v).sum() - 1) < 1e-9 and not embedding.Embedder()("—").any()
    rows = embedding.embed(docs(spark, "Hello world hello", ""), keep=["id"]).orderBy("id").collect()
    assert rows[0].embedding == pytest.approx(v.tolist(), abs=1e-6) and set(rows[1].embedding) == {0.0}
