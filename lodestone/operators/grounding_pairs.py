"""Grounding of every answer in every source, with the measures of guardrails.grounding.

An answer's words and word pairs are rows of matrices with a column for each answer, so a source is split once and meets
a block of answers by sums over the rows of the words that it has. Answers are a stated set that fits in memory.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons, text

BLOCK, SLICE = 512, 256


class Block:
    """A block of normalised answers, to be measured against normalised sources."""

    def __init__(self, answers: list[str]):
        stop = set(lexicons.GROUND_STOP)
        words = [[w for w in a.split(" ") if w] for a in answers]
        content = [[w for w in ws if len(w) >= 2 and w not in stop] for ws in words]
        self.answers, self.n, self.m = answers, np.array([len(w) for w in words]), np.array([len(c) for c in content])
        self.word, self.all = self._rows(words)
        self.part = np.zeros_like(self.all)
        for i, ws in enumerate(content):
            for w, k in Counter(ws).items():
                self.part[self.word[w], i] = k
        self.pair, self.pairs = self._rows([list(zip(ws, ws[1:])) for ws in words])

    @staticmethod
    def _rows(lists: list[list]) -> tuple[dict, np.ndarray]:
        at: dict = {}
        for x in lists:
            for w in x:
                at.setdefault(w, len(at))
        counts = np.zeros((len(at), len(lists)), dtype=np.int32)
        for i, x in enumerate(lists):
            for w, k in Counter(x).items():
                counts[at[w], i] = k
        return at, counts

    def measure(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """passed and confidence of each answer in a source of these words."""
        source = " ".join(ws)
        here = [self.word[w] for w in self.word.keys() & set(ws)]
        there = [self.pair[p] for p in self.pair.keys() & set(zip(ws, ws[1:]))]
        known = self.all[here].sum(axis=0)
        t, c = known / np.maximum(self.n, 1), self.part[here].sum(axis=0) / np.maximum(self.m, 1)
        near = (c >= 0.8) & (self.pairs[there].sum(axis=0) > 0) & (self.m > 0)
        # Where a source has an answer, it has all its words but the first and last, which may be parts of longer ones.
        held = np.zeros(len(self.answers), dtype=bool)
        for i in np.flatnonzero(known >= self.n - 2).tolist():
            held[i] = self.answers[i] in source
        conf = np.select(
            [held, t >= 0.85, self.m == 0, near & (self.m <= 3), near],
            [1.0, t, t, np.minimum(0.98, 0.65 * c + 0.35 * t), np.minimum(0.98, 0.60 * c + 0.40 * t)],
            np.minimum(1.0, 0.55 * t + 0.45 * c),
        )
        void = (self.n == 0) | (source == "")
        return ~void & (held | (t >= 0.85) | near), np.where(void, 0.0, conf)


def every_pair(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(item_id, doc_id, passed, confidence) for each row of answers (item_id, text) with each row of sources (doc_id, text)."""
    item, doc = answers.schema["item_id"].dataType, sources.schema["doc_id"].dataType
    held = answers.select("item_id", text.normalize(F.col("text")).alias("a")).collect()
    there = sources.select("doc_id", F.col("text").alias("s"))
    cut = [held[i : i + BLOCK] for i in range(0, len(held), BLOCK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [(pa.array([r[0] for r in rows], pa.int64()), Block([r[1] for r in rows])) for rows in cut]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                told = [text.py_runs(s.as_py() or "") for s in part.column("s")]
                for ids, block in blocks:
                    found = [block.measure(ws) for ws in told]
                    k = len(ids)
                    docs = part.column("doc_id").take(pa.array(np.repeat(np.arange(part.num_rows), k)))
                    items = ids.take(pa.array(np.tile(np.arange(k), part.num_rows)))
                    yield pa.RecordBatch.from_arrays([items, docs, pa.array(np.concatenate([p for p, _ in found])), pa.array(np.concatenate([c for _, c in found]))], names=["item_id", "doc_id", "passed", "confidence"])

    schema = T.StructType().add("item_id", item).add("doc_id", doc).add("passed", T.BooleanType()).add("confidence", T.DoubleType())
    return there.mapInArrow(run, schema)
