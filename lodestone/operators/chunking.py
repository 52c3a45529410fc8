"""Documents to chunks, by four strategies.

Documents have id, ord (a long, the document's place), title, text, language, source and query. Chunks do not repeat the
document's text: parent_id leads to it. chunk_ord, the chunk's place among all, is put together from the places of
document, strategy and chunk, so it orders chunks as one global numbering would without numbering them in one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons, text

STRATEGIES = ("fixed", "sentence", "semantic", "metadata")
#: chunk_ord: the chunk's number below INDEX, the strategy's times INDEX, the document's times 4 * INDEX.
INDEX = 1 << 20


def _chunks(df: DataFrame, strategy: str, suffix: str, title: Column | None = None) -> DataFrame:
    """From rows with chunk_index, text, words (their number) and the document's columns."""
    order = STRATEGIES.index(strategy)
    return df.select(
        F.concat_ws("_", "id", F.lit(suffix), F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col("id").alias("doc_id"),
        "query",
        F.coalesce("language", F.lit("en")).alias("language"),
        (F.col("title") if title is None else title).alias("title"),
        F.coalesce("source", F.lit("corpus")).alias("source"),
        F.lit(strategy).alias("strategy"),
        F.col("id").alias("parent_id"),
        F.col("chunk").alias("text"),
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.col("words").cast("int").alias("word_count"),
        F.length("chunk").alias("char_count"),
        (F.col("ord") * (4 * INDEX) + order * INDEX + F.col("chunk_index")).cast("long").alias("chunk_ord"),
    )


_space = re.compile("[" + re.sub(r"\\x\{(\w+)\}", r"\\u\1", text.SPACE) + "]+")
_sentence = re.compile(re.sub(r"\\x\{(\w+)\}", r"\\u\1", text.SENTENCE).replace(r"\z", r"\Z"))
_blank_line = re.compile(r"\n\s*\n")
_no_term = re.compile(rf"_+|[^\w{_space.pattern[1:-2]}]+")
_header = re.compile(rf"#{{1,4}}{_space.pattern}|[A-Z0-9{_space.pattern[1:-2]}]{{4,40}}:\Z")
_mark = re.compile(rf"#{{1,4}}{_space.pattern}")
#: The members of text.SPACE, and what str.split() takes otherwise than it: all but the last are space to split() only.
SPACES = "".join(chr(c) for c in range(0x10000) if _space.fullmatch(chr(c)))
ODD = "\x1c\x1d\x1e\x1f\x85\ufeff"
#: Documents taken out of Arrow at once, and characters of chunks handed on at once, so that a worker's memory follows neither a batch nor its task.
ROWS, CHARACTERS = 256, 2_000_000


def _py_words(s: str) -> list[str]:
    return [w for w in _space.split(s) if w] if any(c in s for c in ODD) else s.split()


def _py_sentences(s: str) -> list[str]:
    """text.sentences()."""
    return [x for x in (y.strip(SPACES) for y in _sentence.findall(s)) if x]


def _by_document(docs: DataFrame, cut: Callable[[str, str], Iterable[tuple]], *more: str) -> DataFrame:
    """The document's columns with chunk_index, chunk, words and what more names, all strings: a row for each piece that cut(text, title) gives."""
    keep = ["id", "ord", "title", "language", "source", "query"]
    kinds = [pa.string(), pa.int32(), *[pa.string()] * len(more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                at, index, made, held = [], [], [], 0

                def rows() -> pa.RecordBatch:
                    columns = zip(*made) if made else [[] for _ in kinds]
                    arrays = [pa.array(index, pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds))]
                    return pa.RecordBatch.from_arrays([*part.select(keep).take(pa.array(at, pa.int64())).columns, *arrays], names=[*keep, "chunk_index", "chunk", "words", *more])

                for i, (s, title) in enumerate(zip(part.column("text"), part.column("title"))):
                    for k, piece in enumerate(cut(s.as_py() or "", title.as_py() or "")):
                        at.append(i)
                        index.append(k)
                        made.append(piece)
                        held += len(piece[0])
                        if held >= CHARACTERS:
                            yield rows()
                            at, index, made, held = [], [], [], 0
                yield rows()

    there = docs.select(*keep, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in there.select(*keep).schema.fields)
    return there.mapInArrow(run, ", ".join([schema, "chunk_index int, chunk string, words int", *(f"{m} string" for m in more)]))


def fixed_chunks(s: str, size: int = 60, overlap: int = 15) -> Iterator[tuple[str, int]]:
    """(chunk, words) for each window."""
    step, words = max(1, size - overlap), _py_words(s)
    last = -(-max(0, len(words) - size) // step)
    for k in range(last + 1 if words else 0):
        part = words[k * step : k * step + size]
        yield " ".join(part), len(part)


def fixed(docs: DataFrame, size: int = 60, overlap: int = 15) -> DataFrame:
    """Windows of size words, each overlap words into the one before; none after the window that reaches the end.

    In Python, by Arrow batches, as sentence() and metadata(): a column's array is copied as a whole for each piece that is
    sliced from it or appended to it, so long documents would cost their length times their chunks.
    """
    return _chunks(_by_document(docs, lambda s, _: fixed_chunks(s, size, overlap)), "fixed", "fixed")


def sentence_chunks(s: str, target: int = 2, most: int = 3, least_words: int = 15) -> Iterator[tuple[str, int]]:
    """(chunk, words) for each chunk of sentences."""
    held, words = [], 0
    for x in _py_sentences(s):
        held.append(x)
        words += len(_py_words(x))
        if len(held) >= target and words >= least_words or len(held) >= most:
            yield " ".join(held), words
            held, words = [], 0
    if held:
        yield " ".join(held), words


def sentence(docs: DataFrame, target: int = 2, most: int = 3, least_words: int = 15) -> DataFrame:
    """Sentences in a row: a chunk is closed at target sentences with least_words words, at most sentences, or at the end."""
    return _chunks(_by_document(docs, lambda s, _: sentence_chunks(s, target, most, least_words)), "sentence", "sent")


def _terms(s: str) -> set[str]:
    """Words of more than two letters or digits; all else, marks too, is cut out of them."""
    return {w for w in _py_words(_no_term.sub("", s.lower())) if len(w) > 2}


def _units(s: str, transitions: tuple[str, ...], likeness: float, least: int) -> Iterator[tuple[str, int]]:
    """semantic_units() with their words, counted as they come."""
    for paragraph in filter(None, (p.strip() for p in _blank_line.split(s))):
        found = [x.strip() for x in _sentence.findall(paragraph) if x.strip()]
        if len(found) <= 1:
            yield paragraph, len(_py_words(paragraph))
            continue
        unit, seen, words = [found[0]], _terms(found[0]), len(_py_words(found[0]))
        for x in found[1:]:
            terms, n = _terms(x), len(_py_words(x))
            if words >= least:
                both = len(seen & terms)
                alike = both / (len(seen) + len(terms) - both) if seen and terms else 0.0
                if alike < likeness or x.lower().startswith(transitions):
                    yield " ".join(unit), words
                    unit, seen, words = [x], terms, n
                    continue
            unit.append(x)
            seen |= terms
            words += n
        yield " ".join(unit), words


def semantic_units(s: str, transitions: tuple[str, ...], likeness: float, least: int) -> list[str]:
    """Sentences of a paragraph in a row, parted where one opens with a transition or shares too few words with those before."""
    return [unit for unit, _ in _units(s, transitions, likeness, least)]


def _semantic(s: str, transitions: tuple[str, ...], likeness: float, least: int, most: int) -> Iterator[tuple[str, int]]:
    held: list[str] = []
    words = 0
    for unit, n in _units(s, transitions, likeness, least):
        if held and words + n > most:
            yield " ".join(held), words
            held, words = [], 0
        held.append(unit)
        words += n
    if held:
        yield " ".join(held), words


def semantic_chunks(s: str, transitions: tuple[str, ...] = tuple(lexicons.TRANSITIONS), likeness: float = 0.05, least: int = 30, most: int = 80) -> list[str]:
    """Units in a row, as long as they have no more than most words together; a longer unit is a chunk of its own."""
    return [chunk for chunk, _ in _semantic(s, transitions, likeness, least, most)]


def semantic(docs: DataFrame, likeness: float = 0.05, least: int = 30, most: int = 80, transitions: list[str] = lexicons.TRANSITIONS) -> DataFrame:
    """By likeness of neighbouring sentences: two nested folds with a growing set of words."""
    opening = tuple(transitions)
    return _chunks(_by_document(docs, lambda s, _: _semantic(s, opening, likeness, least, most)), "semantic", "sem")


def metadata_chunks(s: str, title: str, size: int = 75, prefix: bool = True) -> Iterator[tuple[str, int, str]]:
    """(chunk, words, section's title) for each piece."""
    sections: list[tuple[str, list[str]]] = []
    section, body = title, []
    for line in filter(None, (x.strip(SPACES) for x in s.split("\n"))):
        if _header.match(line):
            if body:
                sections.append((section, body))
            section, body = _mark.sub("", line, count=1) if line[0] == "#" else line, []
            section = section.removesuffix(":")
        else:
            body.append(line)
    if body:
        sections.append((section, body))
    for section, body in sections or [(title, [s])]:
        words = _py_words(" ".join(body))
        for k in range(0, len(words), size):
            part = words[k : k + size]
            yield f"[{section}] {' '.join(part)}" if section and prefix else " ".join(part), len(part), section


def metadata(docs: DataFrame, size: int = 75, prefix: bool = True) -> DataFrame:
    """Sections under headers, cut into pieces of size words that carry their section's title."""
    cut = _by_document(docs, lambda s, title: metadata_chunks(s, title, size, prefix), "section")
    return _chunks(cut, "metadata", "meta", F.when(F.col("section") != "", F.col("section")).otherwise(F.col("title")))


def chunk(docs: DataFrame, strategy: str = "all") -> DataFrame:
    """Chunks by one strategy, or by all four, in chunk_ord's order: document, strategy, chunk."""
    by = {"fixed": fixed, "sentence": sentence, "semantic": semantic, "metadata": metadata}
    if strategy != "all":
        return by[strategy](docs)
    found = [by[s](docs) for s in STRATEGIES]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
