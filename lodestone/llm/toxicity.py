"""Toxicity by a factorization machine over hashed terms.

A text's features are the hashes of its distinct words. The machine's score is bias + sum of weights + sum over pairs of
features of the dot product of their factors, so an insult and a mention of a group can weigh more together than apart.
It is fitted on a bounded sample of labelled rows: counts by feature and label are taken over the sample by grouped
aggregation, the FEATURES features that tell the labels apart best are kept, and the driver fits the machine on them.
The model sent to the executors is bounded by FEATURES, whatever the input.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, written

#: Bounds: labelled rows of either kind that are used, hash buckets, features kept, factors of each.
TOXIC_ROWS, OTHER_ROWS, BUCKETS, FEATURES, FACTORS = 6_000, 24_000, 1 << 22, 4_096, 8
EPOCHS, RATE, DECAY, SEED = 60, 0.1, 1e-4, 7
#: How much more a toxic row weighs in the fit, as toxic rows are few.
TOXIC_WEIGHT = 3
THRESHOLD = 0.7

_find = re.compile(r"[^\W\d_]+").findall


def buckets(text: str) -> list[int]:
    """Hashes of the distinct words, in lower case."""
    return list({zlib.crc32(w.encode()) & (BUCKETS - 1) for w in set(_find(text.lower()))})


@dataclass
class Machine:
    bias: float
    place: dict[int, int]
    weights: np.ndarray
    factors: np.ndarray

    def score(self, features: list[int]) -> float:
        at = [self.place[f] for f in features if f in self.place]
        margin = self.bias
        if at:
            v = self.factors[at]
            total = v.sum(axis=0)
            margin += float(self.weights[at].sum() + 0.5 * ((total**2).sum() - (v**2).sum()))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, margin))))


def fit_machine(rows: list[tuple[int, list[int]]], features: list[int]) -> Machine:
    """By AdaGrad on the logistic loss, a row at a time in a fixed random order. rows: (label, kept features)."""
    place = {f: i for i, f in enumerate(features)}
    toxic = sum(y for y, _ in rows)
    rng = np.random.default_rng(SEED)
    bias, w, v = math.log((toxic + 1) / (len(rows) - toxic + 1)), np.zeros(len(features)), rng.normal(0, 0.01, (len(features), FACTORS))
    gb, gw, gv = 1.0, np.ones(len(features)), np.ones((len(features), FACTORS))
    data = [(y, np.array([place[f] for f in x], dtype=np.int64)) for y, x in rows]
    for _ in range(EPOCHS if features else 0):
        loss = 0.0
        for k in rng.permutation(len(data)):
            y, at = data[k]
            total = v[at].sum(axis=0)
            margin = bias + w[at].sum() + 0.5 * ((total**2).sum() - (v[at] ** 2).sum())
            g = 1 / (1 + math.exp(-max(-60.0, min(60.0, margin)))) - y
            loss += abs(g)
            g *= TOXIC_WEIGHT if y else 1
            gb += g * g
            bias -= RATE * g / math.sqrt(gb)
            if len(at) and abs(g) > 1e-3:
                dw, dv = g + DECAY * w[at], g * (total - v[at]) + DECAY * v[at]
                gw[at] += dw * dw
                gv[at] += dv * dv
                w[at] -= RATE * dw / np.sqrt(gw[at])
                v[at] -= RATE * dv / np.sqrt(gv[at])
        if loss / max(1, len(data)) < 0.002:
            break
    return Machine(float(bias), place, w.astype(np.float32), v.astype(np.float32))


def _features(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([buckets(x.as_py() or "") for x in batch.column("__text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], names=[*keep, "features"])

    there = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    return there.mapInArrow(run, T.StructType([*there.select(*keep).schema.fields, T.StructField("features", T.ArrayType(T.IntegerType()))]))


def held_out(key: str):
    """Whether a row is kept from learning: crc32 of the key as text, modulo 3, is 1. A null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """labels: key and label (0 or 1; rows with nulls are not used, the larger counts if a key has several).

    Used are the rows of least hash of the key, up to the bounds above, without held-out ones.
    """
    given = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("__y"))
    order = [F.xxhash64(key), F.col(key)]
    sample = given.filter("__y = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(given.filter("__y = 0").orderBy(*order).limit(OTHER_ROWS))
    # Bounded by the two limits: small enough to send everywhere.
    rows = written(_features(docs.join(F.broadcast(sample), key), text, [key, "__y"]).select("__y", "features"), "toxic-sample")
    n = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    pos, neg = max(1, n.get(1, 0)), max(1, n.get(0, 0))
    by = rows.select("__y", F.explode("features").alias("f")).groupBy("f").agg(F.sum("__y").alias("p"), F.count("*").alias("c")).filter("c >= 3")
    a, b = (F.col("p") + 0.1) / pos, (F.col("c") - F.col("p") + 0.1) / neg
    pooled = (F.col("c") + 0.2) / (pos + neg)
    z = F.abs(a - b) / F.sqrt(pooled * (1 - pooled + 1e-9) * (1 / pos + 1 / neg))
    features = [r.f for r in by.select("f", z.alias("z")).filter("z >= 3.5").orderBy(F.desc("z"), "f").limit(FEATURES).collect()]
    chosen = F.array(*[F.lit(f) for f in features]) if features else F.expr("cast(array() as array<int>)")
    data = [(r["__y"], r["x"]) for r in rows.select("__y", F.sort_array(F.array_intersect("features", chosen)).alias("x")).collect()]
    drop_table(rows)
    data.sort()
    return fit_machine(data, features)


def score(docs: DataFrame, model: Machine, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score, 0 to 1. A null text counts as an empty one; its score is that of a text without known words."""
    keep = [c for c in docs.columns if c != "score"] if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(model)
    there = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for batch in batches:
            found = pa.array([machine.score(buckets(x.as_py() or "")) for x in batch.column("__text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], names=[*keep, "score"])

    return there.mapInArrow(run, T.StructType([f for f in there.schema.fields if f.name != "__text"]).add("score", T.DoubleType()))
