"""Byte-level BPE by corpus-level merge replay.

The corpus of a replay is the distinct pieces of a slice of a task's texts (SLICE characters or so, which bounds the
memory) that the worker has not kept from before. An inverted index has, for each mergeable pair of neighbouring tokens,
the positions where the pair stands; merges are applied in the order of their ranks, at all positions at once, and only
the two neighbours of a merged pair are entered anew. The tokens of a piece do not depend on the other pieces, so what a
worker has replayed, and has met again, it keeps (up to a bound) for the later texts.

encode(): adds `ids`, an array of ints. A null or empty text has no ids. decode(): adds `decoded`, the bytes of ids;
null ids give empty bytes. Columns that the input already has under these names are replaced; all others stay.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A worker keeps the tokens of at most this many pieces, none of them longer than KEPT_BYTES, and takes texts of about SLICE characters at once.
KEPT, KEPT_BYTES, SLICE = 640_000, 48, 1 << 20
#: Marks for pieces met before, by their hash.
SEEN = 1 << 22


#: The pattern for which there is a faster form.
GPT2 = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class MergeReplay:
    """Tokens of pieces, by the ranks of a byte-level vocabulary that has all 256 bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self.first = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self.pairs: dict[int, int] = {}

    def pair(self, key: int) -> int:
        """The rank of the token that two make, or -1; key has both."""
        if len(self.pairs) > 200_000:
            self.pairs.clear()
        found = self.pairs[key] = self.ranks.get(self.token[key >> 24] + self.token[key & 0xFFFFFF], -1)
        return found

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """The tokens of each piece: always the pair of lowest rank first, the leftmost of equal ones."""
        whole = list(map(self.ranks.get, pieces))
        corpus = [p for p, w in zip(pieces, whole, strict=True) if w is None and p]
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, corpus), dtype=np.int64, count=len(corpus)))])
        text = np.frombuffer(b"".join(corpus), dtype=np.uint8).astype(np.int64)
        tok, left, right, index = self._corpus(text, starts)
        known = self.pairs.get
        heap = sorted(index)
        while heap:
            r = heappop(heap)
            waiting: set[int] = set()
            later: list[int] = []
            for p in sorted(index.pop(r, ())):
                q, t = right[p], tok[p]
                if q < 0 or t < 0:
                    continue
                key = t << 24 | tok[q]
                found = known(key)
                if (self.pair(key) if found is None else found) != r:
                    continue
                if waiting and self._piece(starts, p) in waiting:  # a pair of lower rank has come up there and goes first
                    later.append(p)
                    continue
                tok[p], tok[q] = r, -1
                q = right[p] = right[q]
                low = r
                if q >= 0:
                    left[q] = p
                    key = r << 24 | tok[q]
                    new = known(key)
                    if new is None:
                        new = self.pair(key)
                    if new >= 0:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heappush(heap, new)
                        low = min(low, new)
                q = left[p]
                if q >= 0:
                    key = tok[q] << 24 | r
                    new = known(key)
                    if new is None:
                        new = self.pair(key)
                    if new >= 0:
                        if new in index:
                            index[new].append(q)
                        else:
                            index[new] = [q]
                            heappush(heap, new)
                        low = min(low, new)
                if low < r:
                    waiting.add(self._piece(starts, p))
            if later:
                index.setdefault(r, []).extend(later)
                heappush(heap, r)
        tokens = np.array(tok, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(tokens >= 0)])[starts]
        tokens = tokens[tokens >= 0].tolist()
        replayed = iter([tokens[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
        return [[w] if w is not None else next(replayed) if p else [] for p, w in zip(pieces, whole, strict=True)]

    def _corpus(self, text: np.ndarray, starts: np.ndarray) -> tuple[list[int], list[int], list[int], dict[int, list[int]]]:
        """Tokens, links to both neighbours (-1: none), and the inverted index from the rank of a pair to its positions."""
        n = len(text)
        left, right = np.arange(-1, n - 1), np.arange(1, n + 1)
        left[starts[:-1]], right[starts[1:] - 1] = -1, -1
        rank = np.full(n, -1)
        if n:
            rank[:-1] = self.first[text[:-1] << 8 | text[1:]]
            rank[starts[1:] - 1] = -1
        at = np.argsort(rank, kind="stable")
        at = at[np.searchsorted(rank[at], 0) :]
        ranks, begins = np.unique(rank[at], return_index=True)
        index = {r: x.tolist() for r, x in zip(ranks.tolist(), np.split(at, begins[1:]), strict=True)} if len(at) else {}
        return self.single[text].tolist(), left.tolist(), right.tolist(), index

    @staticmethod
    def _piece(starts: np.ndarray, position: int) -> int:
        return int(np.searchsorted(starts, position, side="right"))


class TextEncoder:
    """Texts to ids, with a bounded memory of pieces: those met lately, in two generations, each with its ids as int32s."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay = MergeReplay(ranks)
        self.any = regex.compile(pattern).findall
        # The same pattern with its classes written out for ASCII, which the standard library finds faster.
        self.ascii = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+"), re.ASCII).findall if pattern == GPT2 else self.any
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # Most pieces come once: only those that come again are kept.
        self.seen, self.marks = bytearray(SEEN), 0

    def encode(self, texts: list[str]) -> pa.ListArray:
        """An array of ids for each text. Pieces are numbered within the call, so that all else is done on whole arrays."""
        pieces = [self.ascii(t) if t.isascii() else self.any(t) for t in texts]
        code = dict.fromkeys(chain.from_iterable(pieces))
        for i, p in enumerate(code):
            code[p] = i
        counts = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        codes = np.fromiter(map(code.__getitem__, chain.from_iterable(pieces)), dtype=np.int32, count=int(counts.sum()))
        ids = self._ids(list(code))
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4)]).astype(np.int32)
        each = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))).take(pa.array(codes))
        ends = np.concatenate([[0], np.cumsum(counts)])
        return pa.ListArray.from_arrays(pa.array(np.asarray(each.offsets)[ends]), each.values)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        if len(self.young) > KEPT // 2:
            self.old, self.young = self.young, {}
        known, old, seen = self.young, self.old, self.seen
        new = []
        for p in pieces:
            if p not in known:
                if p in old:
                    known[p] = old[p]
                else:
                    new.append(p)
        fresh = {}
        for p, ids in zip(new, self.replay.replay([p.encode() for p in new]), strict=True):
            fresh[p] = array("i", ids).tobytes()
        out = [known[p] if p in known else fresh[p] for p in pieces]
        for p in new:
            at = hash(p) & (SEEN - 1)
            if not seen[at]:
                seen[at] = 1
                self.marks += 1
            elif len(p) <= KEPT_BYTES:
                known[p] = fresh[p]
        if self.marks > SEEN // 2:
            self.seen, self.marks = bytearray(SEEN), 0
        return out


_encoders: dict[tuple[str, str], TextEncoder] = {}


def _encoder(path: str, pattern: str) -> TextEncoder:
    """One for each worker process, as workers take many tasks."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = TextEncoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


_vocabularies: dict[str, pa.Array] = {}


def _tokens(path: str) -> pa.Array:
    """The bytes of each id."""
    if path not in _vocabularies:
        token = {rank: token for token, rank in read_ranks(path).items()}
        _vocabularies[path] = pa.array([token.get(i) for i in range(max(token) + 1)], pa.binary())
    return _vocabularies[path]


def _slices(texts: pa.ChunkedArray | pa.Array) -> Iterator[list[str]]:
    part: list[str] = []
    held = 0
    for x in texts:
        part.append(x.as_py() or "")
        held += len(part[-1])
        if held >= SLICE:
            yield part
            part, held = [], 0
    if part:
        yield part


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), column], names=[*keep, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name]).add(name, kind)


def _bytes_of(ids: pa.ListArray, token: pa.Array) -> pa.Array:
    """The bytes of each row of ids. The tokens stand one after another in one buffer: only the rows' ends are left to say."""
    ends = np.asarray(ids.offsets)
    flat = token.take(ids.values.slice(ends[0], ends[-1] - ends[0]))
    edges = np.frombuffer(flat.buffers()[1], dtype=np.int32, count=len(flat) + 1)[ends - ends[0]]
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(edges)), flat.buffers()[2]])


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: list[str] | None = None, back: bool = False) -> DataFrame:
    """Adds ids; back: and decoded, decoded from them by the same worker, which saves a second one for each task.

    keep: the columns that stay, all unless given (columns not kept are not sent to Python).
    """
    made = ["ids", "decoded"] if back else ["ids"]
    keep = [c for c in df.columns if c not in made] if keep is None else keep
    there = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary, pattern)
        token = _tokens(vocabulary) if back else None
        for batch in batches:
            at, rest = 0, batch.select(keep)
            for part in _slices(batch.column("__text")):
                ids = enc.encode(part)
                out = _with(rest.slice(at, len(part)), "ids", ids)
                yield _with(out, "decoded", _bytes_of(ids, token)) if back else out
                at += len(part)

    schema = _schema(there.drop("__text"), "ids", T.ArrayType(T.IntegerType()))
    return there.mapInArrow(run, schema.add("decoded", T.BinaryType()) if back else schema)


def decode(df: DataFrame, vocabulary: str, keep: list[str] | None = None) -> DataFrame:
    """Adds decoded, the concatenated bytes of ids."""
    keep = [c for c in df.columns if c != "decoded"] if keep is None else keep
    there = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("ids", F.expr("cast(array() as array<int>)")).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tokens(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield _with(part.select(keep), "decoded", _bytes_of(part.column("__ids"), token))

    return there.mapInArrow(run, _schema(there.drop("__ids"), "decoded", T.BinaryType()))
