"""Hashed embeddings: a text's tokens, their character trigrams and its word pairs, signed and summed into DIM slots.

embed() does it in numpy by Arrow batches; hash32() is the same hash as a Column, for plans that stay in the JVM.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_runs

DIM = 128
# The hash's multiplier, its seeds, and what a feature adds.
MULTIPLIER = 0x5BD1E995
TOKEN_SEED, SIGN_SEED, TRIGRAM_SEED, PAIR_SEED = 0x12345678, 0x87654321, 0x9ABCDEF0, 0x55AA55AA
FIRST, SECOND, TRIGRAM, PAIR = 1.0, 0.7, 0.35, 0.5
MASK = 0xFFFFFFFF

def hash32(c: Column, seed: int) -> Column:
    """Unsigned 32 bits in a long. The products stay below 2**63."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    start = F.lit(seed).cast("long").bitwiseXOR(F.length(c).cast("long"))

    def step(h: Column, code: Column) -> Column:
        m = (h.bitwiseXOR(code) * MULTIPLIER).bitwiseAND(MASK)
        return m.bitwiseXOR(F.shiftright(m, 15))

    return F.aggregate(codes, start, step)


def py_hash32(s: str, seed: int) -> int:
    """Over UTF-16 units."""
    units = np.frombuffer(s.encode("utf-16-le"), dtype=np.uint16).tolist()
    h = seed ^ len(units)
    for u in units:
        h = (h ^ u) * MULTIPLIER & MASK
        h ^= h >> 15
    return h


def py_tokens(s: str) -> list[str]:
    """Letters and digits in a row; marks part words."""
    return py_runs(s, marks=False)


def _units(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All their UTF-16 units, and how many each has."""
    units = np.frombuffer("".join(strings).encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
    n = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    if len(units) != n.sum():
        n = np.fromiter((len(s.encode("utf-16-le", "surrogatepass")) // 2 for s in strings), dtype=np.int64, count=len(strings))
    return units, n


def _hashed(units: np.ndarray, n: np.ndarray, at, seed: int) -> np.ndarray:
    """py_hash32 of many strings, unit by unit over all that have one. at(order) gives, for strings in that order, where the k-th unit of the first m is."""
    kind = np.int16 if n.max(initial=0) < 1 << 15 else np.int64
    order = np.argsort(-n.astype(kind), kind="stable")
    h, sizes, place = np.uint32(seed) ^ n[order].astype(np.uint32), -n[order], at(order)
    for k in range(int(n.max(initial=0))):
        longer = np.searchsorted(sizes, -k)
        # Products are taken modulo 2**32, as the mask does.
        m = (h[:longer] ^ units[place(k, longer)]) * np.uint32(MULTIPLIER)
        h[:longer] = m ^ m >> np.uint32(15)
    out = np.empty(len(n), dtype=np.int64)
    out[order] = h
    return out


def _starts(n: np.ndarray):
    start = np.cumsum(n) - n

    def at(order: np.ndarray):
        first = start[order]
        return lambda k, m: first[:m] + k

    return at


def hashes(strings: list[str], seed: int) -> np.ndarray:
    """py_hash32 of many strings."""
    units, n = _units(strings)
    return _hashed(units.astype(np.uint32), n, _starts(n), seed)


def _trigrams(tokens: list[str], units: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many trigrams each token has, and the hashes of all of them in order."""
    size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    many = np.maximum(size - 2, 0)
    if len(units) != size.sum():
        parts: dict[str, int] = {}
        part = np.fromiter((parts.setdefault(t[k : k + 3], len(parts)) for t in tokens for k in range(len(t) - 2)), dtype=np.int64, count=int(many.sum()))
        return many, hashes(list(parts), TRIGRAM_SEED)[part]
    at = np.repeat(np.cumsum(n) - n - np.cumsum(many) + many, many) + np.arange(many.sum())
    h = np.full(len(at), TRIGRAM_SEED ^ 3, dtype=np.uint32)
    for k in range(3):
        m = (h ^ units[at + k]) * np.uint32(MULTIPLIER)
        h = m ^ m >> np.uint32(15)
    return many, h.astype(np.int64)


def _pairs(units: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hashes of left_right for pairs of tokens, read from the tokens' units as if they were joined."""
    start = np.cumsum(n) - n
    joint = np.append(units, np.uint32(ord("_")))

    def at(order: np.ndarray):
        one, other, size = start[left[order]], start[right[order]], n[left[order]]
        # After the left token comes the last unit, then the right token.
        return lambda k, m: np.where(k < size[:m], one[:m] + k, np.where(k == size[:m], len(units), other[:m] + (k - 1) - size[:m]))

    return _hashed(joint, n[left] + n[right] + 1, at, PAIR_SEED)


def vectors(texts: list[str], dim: int = DIM) -> np.ndarray:
    """A row for each text. Each distinct token of a batch is hashed once."""
    out = np.zeros(len(texts) * dim)
    found = [py_tokens(t) for t in texts]
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    code: dict[str, int] = defaultdict(count().__next__)
    codes = np.fromiter(map(code.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=int(sizes.sum()))
    if not len(codes):
        return out.reshape(len(texts), dim)
    tokens, row = list(code), np.repeat(np.arange(len(texts)), sizes)
    units, n = _units(tokens)
    units = units.astype(np.uint32)
    sign = lambda h, bit: np.where(h & bit, 1.0, -1.0)

    def add(rows: np.ndarray, slots: np.ndarray, values: np.ndarray) -> None:
        np.add(out, np.bincount(rows * dim + slots, weights=values, minlength=len(out)), out=out)

    h, s = _hashed(units, n, _starts(n), TOKEN_SEED), _hashed(units, n, _starts(n), SIGN_SEED)
    add(row, (h % dim)[codes], (FIRST * sign(s, 1))[codes])
    add(row, ((h >> 8 & 0xFFFFFF) % dim)[codes], (SECOND * sign(s, 2))[codes])
    many, g = _trigrams(tokens, units, n)
    if len(g):
        times = many[codes]
        each = np.repeat((np.cumsum(many) - many)[codes] - np.cumsum(times) + times, times) + np.arange(times.sum())
        add(np.repeat(row, times), (g % dim)[each], (TRIGRAM * sign(g, 4))[each])
    first = np.flatnonzero(row[1:] == row[:-1])
    if len(first):
        g = _pairs(units, n, codes[first], codes[first + 1])
        add(row[first], g % dim, PAIR * sign(g, 8))
    made = out.reshape(len(texts), dim) / np.sqrt(np.maximum(sizes, 1))[:, None]
    norm = np.sqrt((made * made).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-8, made / np.maximum(norm, 1e-8), made)


class Embedder:
    """The vector of one text."""

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def __call__(self, text: str) -> np.ndarray:
        return vectors([text], self.dim)[0]


def embed(df: DataFrame, text: str = "text", to: str = "embedding", dim: int = DIM, keep: list[str] | None = None) -> DataFrame:
    """Adds to, array<float>, of unit length; zeros for a text without tokens."""
    keep = [c for c in df.columns if c != to] if keep is None else keep
    there = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                flat = vectors([x.as_py() or "" for x in part.column("__text")], dim).astype(np.float32).reshape(-1)
                made = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dim), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), made], names=[*keep, to])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in there.drop("__text").schema.fields)
    return there.mapInArrow(run, f"{schema}, {to} array<float>")
