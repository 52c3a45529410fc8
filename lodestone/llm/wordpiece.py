"""Word-piece counts by a linear longest-match automaton (Song et al., 2021).

The automaton is a trie of the vocabulary. A node's failure link leads to where matching goes on after the longest
matches that its string begins with are popped; how many are popped is precomputed, so a word's pieces are counted in
one pass over its bytes, without going back and without building a piece. A word is its bytes and an end mark; final
pieces have the mark. A word that no pieces make up counts as one unknown piece.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END, ROOT, KEPT = 256, 0, 400_000


class Automaton:
    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        """pieces: of bytes and, last in final ones, END."""
        self.child: dict[int, int] = {}
        parent, symbol, final = [-1], [-1], [False]
        for piece in pieces:
            v = ROOT
            for c in piece:
                u = self.child.get(v << 9 | c)
                if u is None:
                    u = self.child[v << 9 | c] = len(parent)
                    parent.append(v)
                    symbol.append(c)
                    final.append(False)
                v = u
            final[v] = v != ROOT
        self.fail, self.popped = [-1] * len(parent), [0] * len(parent)
        depth = [0] * len(parent)
        for v in range(1, len(parent)):  # a parent comes before its children
            depth[v] = depth[parent[v]] + 1
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if final[v]:
                self.fail[v], self.popped[v] = ROOT, 1
                continue
            u, c = parent[v], symbol[v]
            z, n = self.fail[u], self.popped[u]
            while z >= 0 and (z << 9 | c) not in self.child:
                n += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.child[z << 9 | c], n

    def count(self, word: bytes) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        v, n = ROOT, 0
        for c in (*word, END):
            while (u := child.get(v << 9 | c)) is None:
                n += popped[v]
                v = fail[v]
                if v < 0:
                    return 1
            v = u
        while v != ROOT:
            n += popped[v]
            v = fail[v]
            if v < 0:
                return 1
        return n


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordPieces:
    """A vocabulary file with an end-of-word suffix, its word pattern, and the counts of words met lately."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, alphabet = spec["model"]["end_of_word_suffix"], byte_alphabet()
        special = {x["content"] for x in spec["added_tokens"]}
        self.pieces = [p for p in spec["model"]["vocab"] if p not in special]
        self.automaton = Automaton(self.split(p, suffix, alphabet) for p in self.pieces)
        self.find = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")).findall
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    @staticmethod
    def split(piece: str, suffix: str, alphabet: dict[str, int]) -> tuple[int, ...]:
        if piece.endswith(suffix) and piece != suffix:
            return (*(alphabet[c] for c in piece[: -len(suffix)]), END)
        return tuple(alphabet[c] for c in piece)

    def words(self, text: str) -> list[str]:
        return self.find((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())

    def counts(self, text: str) -> tuple[int, int]:
        """Words and pieces."""
        if len(self.young) > KEPT // 2:
            self.old, self.young = self.young, {}
        words, known = self.words(text), self.young
        for w in set(words):
            if w not in known:
                n = self.old.get(w)
                known[w] = self.automaton.count(w.encode()) if n is None else n
        return len(words), sum(map(known.__getitem__, words))


_kept: dict[str, WordPieces] = {}


def _pieces(path: str) -> WordPieces:
    if path not in _kept:
        _kept[path] = WordPieces(path)
    return _kept[path]


def count(df: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_words and n_pieces, longs. A null or empty text has none of either."""
    made = ["n_words", "n_pieces"]
    keep = [c for c in df.columns if c not in made] if keep is None else keep
    there = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary)
        for batch in batches:
            found = [pieces.counts(x.as_py() or "") for x in batch.column("__text")]
            new = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[*keep, *made])

    schema = T.StructType([f for f in there.schema.fields if f.name != "__text"])
    return there.mapInArrow(run, schema.add("n_words", T.LongType()).add("n_pieces", T.LongType()))
