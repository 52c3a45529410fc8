import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import explorer, judging
from lodestone.plans import evaluate
from lodestone.plans.answer import Index, answer
from lodestone.sources import readers
from lodestone.streaming import speech

TEXTS = {
    "goa": "Goa is a state on the southwestern coast of India. Panaji is the capital of Goa. Goa was liberated in 1961 by Operation Vijay.",
    "xylem": "Xylem is a plant tissue. Xylem transports water and minerals from the roots to the leaves.",
    "isro": "ISRO was founded in 1969. Vikram Sarabhai is the father of the Indian space programme. ISRO is located in Bengaluru.",
    "timsort": "Timsort is a hybrid sorting algorithm. Timsort works by merging runs, because real data has runs already. Tim Peters implemented Timsort in 2002.",
}
QUESTIONS = [
    ("What is the capital of Goa?", "PASSED"),
    ("What does xylem carry?", "PASSED"),
    ("Who founded ISRO?", "PASSED"),
    ("What is Timsort?", "PASSED"),
    ("weather in Goa today", "INSUFFICIENT_CONTEXT"),
    ("What is the capital of Haryana?", "INSUFFICIENT_CONTEXT"),
    ("thing", "INSUFFICIENT_CONTEXT"),
    ("how to make a bomb with Goa", "UNSAFE"),
    ("aaaaaaaa", "OFF_TOPIC"),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(k, i, k.title(), t, "en", "test", None) for i, (k, t) in enumerate(TEXTS.items())]
    docs = spark.createDataFrame(rows, "id string, ord long, title string, text string, language string, source string, query string")
    path, other = (str(tmp_path_factory.mktemp(n)) for n in ("index", "other"))
    Index.build(docs).save(path)
    made, stored = Index.load(spark, path), Index.create(docs, other)
    for name, df in made.tables().items():
        assert df.count() == stored.tables()[name].select(df.columns).count() > 0
    return made


def test_questions(spark, index):
    q = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(QUESTIONS)], "query_id long, query string")
    got = {r.query_id: r for r in answer(q, index).collect()}
    assert len(got) == len(QUESTIONS)
    assert [got[i].status for i in range(len(QUESTIONS))] == [s for _, s in QUESTIONS]
    assert "Panaji is the capital of Goa." in got[0].answer and got[0].grounded
    assert "transports water" in got[1].answer
    asked = spark.createDataFrame([(i, q, "x", s == "PASSED") for i, (q, s) in enumerate(QUESTIONS)], "query_id long, query string, category string, answerable boolean")
    report = evaluate.report(evaluate.judged(answer(q, index), asked)).first()
    assert (report.queries, report.accuracy, report.refusal_rate) == (len(QUESTIONS), 100.0, 100.0)
    assert report.underspecified_query == 1 and report.safety_policy_violation == 1


def test_index_that_does_not_fit_together(spark, index):
    with pytest.raises(ValueError):
        index.validate(expected=3)
    counts = {r.strategy: r.chunks for r in explorer.counts(index.chunks.filter("strategy != 'semantic'")).collect()}
    assert counts["semantic"] == 0 and counts["fixed"] == 4


def test_two_questions_and_rivals():
    asked = judging.requirements("where is Goa and what is its capital?")
    assert [r.intent for r in asked] == ["LOCATION", "CAPITAL"]
    assert judging.score_sentence("Phloem carries sugar in plants.", judging.requirements("What does xylem carry?")[0]) == 0
    assert [judging.stem(w) for w in ("carries", "moved", "cats")] == ["carry", "mov", "cat"]


def test_readers(spark, tmp_path):
    rows = [{"id": "a", "text": " x  y "}, {"doc_id": 7, "passage": "p", "lang": "hi", "metadata": {"title": "M"}}, {"content": "  "}, {"document_id": "z", "content": "c", "question": "q?"}]
    lines = tmp_path / "d.jsonl"
    lines.write_text("\n".join([json.dumps(rows[0]), "", *map(json.dumps, rows[1:]), "3"]))
    got = [(r.id, r.title, r.text, r.language, r.query) for r in readers.read_documents(spark, str(lines)).orderBy("ord").collect()]
    assert got == [("a", "Document 1", "x y", "unknown", None), ("doc_3", "M", "p", "hi", None), ("z", "Document 5", "c", "unknown", "q?")]
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n{oops\n')
    with pytest.raises(readers.BadRecord, match="line 2"):
        readers.read_documents(spark, str(tmp_path / "bad.jsonl"))
    for key in (None, *readers.WRAPPERS):
        (tmp_path / "d.json").write_text(json.dumps(rows if key is None else {key: rows}))
        assert readers.read_documents(spark, str(tmp_path / "d.json"), limit=3).count() == 2
    (tmp_path / "d.json").write_text('{"other": 1}')
    with pytest.raises(ValueError):
        readers.read_documents(spark, str(tmp_path / "d.json"))
    with pytest.raises(ValueError):
        readers.read_documents(spark, "x.csv")
    assert readers.dataset_info(readers.read_documents(spark, str(lines))).count() == 2


def test_stored_vectors(spark, tmp_path):
    want = [(0, [1.0, -2.5]), (1, [0.25, 0.0]), (2, [3.0, 4.0])]
    flat = np.array([v for _, v in want], dtype="<f4")
    for name, kept in (("b", {"vectorsBase64": base64.b64encode(flat.tobytes()).decode()}), ("l", {"vectorsArray": flat.tolist()}), ("n", {})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps({"dim": 2, "numVectors": 3, **kept}, indent=1))
        got = [(r.chunk_ord, r.embedding) for r in readers.read_vectors(spark, str(path)).orderBy("chunk_ord").collect()]
        assert got == (want if kept else [])
    (tmp_path / "short.json").write_text(json.dumps({"dim": 2, "numVectors": 9, "vectorsBase64": base64.b64encode(flat.tobytes()).decode()}))
    with pytest.raises(Exception, match="buffer"):
        readers.read_vectors(spark, str(tmp_path / "short.json")).collect()


def test_reports_are_stored(spark, tmp_path):
    rows = [(1, "a", True, "PASSED", None, True), (2, "a", True, "REFUSED", "grounding_failed", False), (3, "b", False, "REFUSED", "odd", True)]
    evaluate.write_report(spark.createDataFrame(rows, "query_id long, category string, answerable boolean, status string, reason string, correct boolean"), str(tmp_path))
    stored = spark.read.json(str(tmp_path / "report")).first()
    assert (stored.queries, stored.accuracy, stored.answer_rate, stored.refusal_rate, stored.grounding_failed, stored.other_reasons) == (3, 66.7, 50.0, 100.0, 1, 1)
    assert spark.read.json(str(tmp_path / "queries")).count() == 3


def test_control_events(spark):
    said = [("s", 1, '{"type": "start"}'), ("s", 2, '{"type": "start", "language": "hi"}'), ("s", 3, "not json"), ("s", 4, '{"type": "stop", "language": "en"}'), ("s", 5, '{"type": "other"}'), ("s", 6, '{"type": "start"}'), ("t", 1, '{"type": "stop"}'), ("t", 2, None)]
    got = [(r.session, r.ts, r.event, r.streaming, r.language) for r in speech.control_events(spark.createDataFrame(said, "session string, ts long, message string"), "en").orderBy("session", "ts").collect()]
    assert got == [("s", 1, "start", True, "en"), ("s", 2, "start", True, "hi"), ("s", 4, "stop", False, "hi"), ("s", 6, "start", True, "hi"), ("t", 1, "stop", False, "en")]


def test_speech_steps():
    frames = [(0, 600), (100, 601), (200, 3000), (1600, 0), (1601, 0), (1700, 700)]
    open_, last, out = False, 0.0, []
    for ts, level in frames:
        open_, last, events = speech.step(open_, last, ts, level)
        out += [(ts, e) for e, _ in events]
    assert out == [(100, "START_SPEECH"), (100, "audio_level"), (200, "audio_level"), (1601, "END_SPEECH"), (1700, "START_SPEECH"), (1700, "audio_level")]


def test_levels_and_segments(spark):
    pcm = b"".join(int(x).to_bytes(2, "little", signed=True) for x in (1000, -1000, 2000, -32768))
    df = spark.createDataFrame([("s", bytearray(pcm)), ("t", bytearray(b""))], "session string, pcm binary")
    got = {r.session: r.level for r in speech.leveled(df).collect()}
    assert got == pytest.approx({"s": speech.rms(pcm), "t": 0.0})
    frames = spark.sql("select 's' session, timestamp_millis(x) ts, cast(l as double) level from values (0, 700), (1000, 700), (2000, 0), (5000, 900) t(x, l)")
    assert [r.frames for r in speech.segments(frames).orderBy("started").collect()] == [2, 1]


def test_speech_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = "values ('s', 60000, 700), ('s', 60100, 900), ('s', 61800, 0), ('s', 100000, 0), ('t', 90000, 0)"
    spark.sql(f"select session, timestamp_millis(x) ts, cast(l as double) level from {rows} t(session, x, l)").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("session string, ts timestamp, level double").parquet(src)
    q = speech.speech_events(stream).writeStream.format("memory").queryName("speech_out").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = [r.event for r in spark.table("speech_out").filter("session = 's'").orderBy("ts", F.col("event").desc()).collect()]
    assert got == ["audio_level", "START_SPEECH", "audio_level", "END_SPEECH"]


def test_records_are_numbered_over_all_partitions(spark, tmp_path):
    """Also where there are hundreds: numbers have no gaps, a limit reaches over partitions, and chunks keep an order."""
    from lodestone.operators import chunking
    from lodestone.sources import readers

    path = str(tmp_path / "d.parquet")
    spark.range(4000).selectExpr("concat('t ', id) as text", "concat('i', id) as id").repartition(300).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        docs = readers.read_documents(spark, path)
        assert docs.rdd.getNumPartitions() >= 300
        assert sorted(r.ord for r in docs.collect()) == list(range(4000))
        assert readers.read_documents(spark, path, limit=1000).count() == 1000
        assert chunking.fixed(docs).select("chunk_ord").distinct().count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    info = readers.dataset_info(docs, path).collect()
    assert [(r.language, r.documents, r.total, r.path) for r in info] == [("unknown", 4000, 4000, path)]
    assert readers.resolve(spark, "d.parquet", ["/nowhere", str(tmp_path)], []) == path == readers.resolve(spark, None, [str(tmp_path)], ["x.json", "d.parquet"])
    with pytest.raises(FileNotFoundError):
        readers.resolve(spark, "e.parquet", [str(tmp_path)], [])


def test_grounding_in_python_as_in_columns(spark):
    """All branches: inside, by words, by content words and a pair (few and many), and none."""
    from pyspark.sql import functions as F

    from lodestone.operators import guardrails

    source = "Panaji is the capital of Goa and the river Mandovi flows beside the old market near the church of the town"
    answers = ["the capital of Goa", "capital Goa Panaji river market", "Goa capital of it", "river Mandovi flows beside it with a boat", "river Mandovi flows beside old market near church it has some more as we all say here", "boats in Delhi", "of the", "", "market old near Goa capital Panaji flows"]
    rows = spark.createDataFrame([(a, source) for a in answers] + [("x", "")], "a string, s string").select("a", "s", guardrails.grounding(F.col("a"), F.col("s")).alias("g")).collect()
    for r in rows:
        passed, confidence = guardrails.grounded(r.a, r.s)
        assert (r.g.passed, round(r.g.confidence, 9)) == (passed, round(confidence, 9))
    assert {r.g.passed for r in rows} == {True, False}


def plain_vector(text):
    """The embedding feature by feature."""
    import numpy as np

    from lodestone.operators import embedding as e

    v, tokens = np.zeros(e.DIM), e.py_tokens(text)
    for i, t in enumerate(tokens):
        h, s = e.py_hash32(t, e.TOKEN_SEED), e.py_hash32(t, e.SIGN_SEED)
        v[h % e.DIM] += e.FIRST if s & 1 else -e.FIRST
        v[(h >> 8) % e.DIM] += e.SECOND if s & 2 else -e.SECOND
        for k in range(len(t) - 2):
            h = e.py_hash32(t[k : k + 3], e.TRIGRAM_SEED)
            v[h % e.DIM] += e.TRIGRAM if h & 4 else -e.TRIGRAM
        if i + 1 < len(tokens):
            h = e.py_hash32(f"{t}_{tokens[i + 1]}", e.PAIR_SEED)
            v[h % e.DIM] += e.PAIR if h & 8 else -e.PAIR
    norm = np.sqrt((v * v).sum())
    return v / norm if norm else v


def test_vectors_against_single_features(spark, data):
    import numpy as np

    from lodestone.operators import embedding

    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(60).collect()] + ["", "a", "ab cd", "नमस्ते दुनिया 漢字 🙂x 𝒜bc", "x" * 300, "same same same"]
    assert np.allclose(embedding.vectors(texts), [plain_vector(t) for t in texts], atol=1e-9)


def test_equal_scores_are_settled_in_the_whole_document():
    asked = judging.Asked("Where is the lighthouse of Velsao?")
    filler = "word " * 400
    make = lambda k, parent, bm25: judging.Candidate(k, str(k), "", "nothing of it", parent, "en", "fixed", 0.0, bm25, 0.0)
    # Both lack the subject in what is scored; the second has it further on in its document; equal ones keep their places.
    ranked = judging.rerank(asked, [make(1, filler, 0.0), make(2, filler + "the lighthouse of Velsao", 0.0), make(3, filler, 0.0)], 3)
    assert len({c.final for c in ranked}) == 1
    assert [c.chunk_ord for c in ranked] == [2, 1, 3]


def test_transcripts_and_their_fallback(spark):
    rows = [(1, b"abc", None, "unknown"), (2, b"", "audio/ogg", "hi-IN"), (3, None, None, None), (4, b"boom", None, "hi-IN"), (5, b"boom", None, "ta-IN")]
    audio = spark.createDataFrame(rows, "id long, audio binary, mime string, language string")

    def recognise(sound, mime, language):
        if sound == b"boom":
            raise OSError("no service")
        return {"text": f"{len(sound)} {mime} {language}"} if sound else {"transcript": "none", "language_code": "xx", "confidence": 0.5}

    got = {r.id: (r.transcript, r.spoken, r.provider, r.confidence) for r in speech.transcribe(audio, recognise, "svc").collect()}
    assert got == {
        1: ("3 audio/wav en-IN", "unknown", "svc", 0.95),
        2: ("none", "xx", "svc", 0.5),
        3: ("none", "xx", "svc", 0.5),
        4: ("", "hi-IN", "fallback", 0.0),
        5: ("", "en-IN", "fallback", 0.0),
    }
    none = speech.transcribe(audio).collect()
    assert [(r.transcript, r.spoken, r.provider) for r in sorted(none)] == [("", "hi-IN" if r[3] == "hi-IN" else "en-IN", "fallback") for r in rows]
    assert speech.transcribe(audio.limit(0)).count() == 0 and all(r.latency_ms >= 0 for r in none)
