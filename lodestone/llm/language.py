"""Language by Bayesian fusion of evidence: the text, the language that markup declares, and where the text is from.

Text likelihoods are those of hashed byte trigrams of its letters, counted by language over a bounded sample of labelled
rows. The prior of a host is smoothed by that of its domain, this by that of its address suffix, this by that of all
rows; the counts behind them, and how declared languages agree with the texts, come from one grouped aggregation over
all rows, by the language that the text alone suggests. A row's own count is left out of its host's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Bound of the sample: labelled rows of a language (all languages that are labelled count). Then the trigram buckets.
ROWS, BUCKETS = 1_000, 1 << 16
#: Trigrams overlap, so their evidence is tempered.
TEMPER = 0.3
#: Weight of a level's prior in the level below, in rows; of any declared language, in rows.
KAPPA, ALPHA = 10.0, 1.0
#: A text is rejected without a letter, or if its trigrams are on average no likelier than this, near that of any bytes.
FLOOR = -10.5
UNKNOWN = "und"

_gap = re.compile(r"[\W\d_]+")


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the letters, in lower case, with one space around each word."""
    letters = _gap.sub(" ", text.lower()).strip()
    if not letters:
        return np.zeros(0, dtype=np.int64)
    b = np.frombuffer(f" {letters} ".encode(), dtype=np.uint8).astype(np.int32)  # sums stay below 2**24
    return (b[:-2] * 40503 + b[1:-1] * 9973 + b[2:] * 257) % 65521 % BUCKETS


def mean_logs(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The mean of the table's rows at, which for a long text are counted first, so memory does not follow text and languages."""
    if len(at) < BUCKETS // 16:
        return table[at].sum(axis=0, dtype=np.float64) / len(at)
    n = np.bincount(at)
    return n.astype(np.float64) @ table[: len(n)] / len(at)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS rows of log-likelihoods, a column for each language


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """On about ROWS rows of each language, by the hash of the key; rows without a label or text are not used.

    Every label is a language: the model has a column for each, so it is bounded by the labels in use, not by the rows.
    """
    rows = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("__label"), F.col(text).cast("string").alias("__text"), F.pmod(F.xxhash64(key), F.lit(1 << 32)).alias("__at"))
    # A share of each language's rows by the hash of their keys: no row has to be compared with another. One row for each label.
    shares = rows.groupBy("__label").agg(F.least(F.lit(1.0), ROWS / F.count("*")).alias("__share"))
    there = rows.join(F.broadcast(shares), "__label").filter(F.col("__at") < (1 << 32) * F.col("__share")).select("__label", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for label, x in zip(batch.column("__label").to_pylist(), batch.column("__text"), strict=True):
                sums[label] = sums.get(label, 0) + np.bincount(trigrams(x.as_py()), minlength=BUCKETS)
            for label, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at), pa.array(n[at])], names=["label", "bucket", "n"])

    counts = there.mapInArrow(run, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counts["label"]))
    table = np.full((BUCKETS, len(languages)), 0.1)
    for i, language in enumerate(languages):
        own = counts[counts["label"] == language]
        table[own["bucket"].to_numpy(), i] += own["n"].to_numpy()
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32) if languages else table.astype(np.float32))


def likelihoods(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_trigrams and mean_log, the mean log-likelihood of a trigram in each language (zeros without any)."""
    made = ["n_trigrams", "mean_log"]
    keep = [c for c in df.columns if c not in made] if keep is None else keep
    sent = df.sparkSession.sparkContext.broadcast(model)
    there = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.table
        for batch in batches:
            n, means = [], []
            for x in batch.column("__text"):
                at = trigrams(x.as_py() or "")
                n.append(len(at))
                means.append((mean_logs(table, at) if len(at) else np.zeros(table.shape[1])).tolist())
            new = [pa.array(n, pa.int64()), pa.array(means, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[*keep, *made])

    schema = T.StructType([f for f in there.schema.fields if f.name != "__text"])
    return there.mapInArrow(run, schema.add("n_trigrams", T.LongType()).add("mean_log", T.ArrayType(T.DoubleType())))


def _counts(rows: DataFrame, by: str, n: int) -> DataFrame:
    """(by, __c): rows by language, for each value of by."""
    sums = [F.count_if(F.col("__top") == i).alias(f"__{i}") for i in range(n)]
    return rows.groupBy(by).agg(*sums).select(by, F.array(*[F.col(f"__{i}").cast("double") for i in range(n)]).alias("__c"))


def _smoothed(counts: Column, prior: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    return F.zip_with(counts, prior, lambda c, p: (c + KAPPA * p) / (total + KAPPA))


def identify(df: DataFrame, model: Model, text: str = "text", host: Column | None = None, domain: Column | None = None, suffix: Column | None = None, declared: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds language, probability, text_language and accepted.

    host, domain, suffix, declared: string columns, any of them absent or null (then that evidence is neutral). A text
    without letters (null and empty ones too) or unlike every language gets "und", probability 0 and accepted false. Ties
    go to the first language in order; long texts count whole; repeated rows count each. Without any language to tell (no labelled rows) all is "und", and texts with letters are accepted.
    """
    made = ["language", "probability", "text_language", "accepted"]
    keep = [c for c in df.columns if c not in made] if keep is None else keep
    n = len(model.languages)
    there = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("__text"), *[(F.lit(None) if c is None else c).cast("string").alias(name) for name, c in (("__host", host), ("__domain", domain), ("__suffix", suffix), ("__declared", declared))])
    scored = likelihoods(there, model, "__text", ["row", "__host", "__domain", "__suffix", "__declared"])
    if not n:
        return scored.select("row.*", F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("probability"), F.lit(UNKNOWN).alias("text_language"), (F.col("n_trigrams") > 0).alias("accepted"))
    best = F.array_max("mean_log")
    known = (F.col("n_trigrams") > 0) & (best > FLOOR)
    top = F.when(known, F.array_position("mean_log", best).cast("int") - 1)
    scored = written(scored.withColumn("__top", top), "language")
    all_ = scored.agg(*[F.count_if(F.col("__top") == i) for i in range(n)]).first()
    total = sum(all_)
    everywhere = [(c + 1.0) / (total + n) for c in all_]
    flat = F.array(*[F.lit(p) for p in everywhere])
    suffixes = _counts(scored.filter("__suffix is not null"), "__suffix", n).select("__suffix", _smoothed(F.col("__c"), flat).alias("__ps"))
    places = scored.filter("__host is not null").groupBy("__host").agg(F.min("__domain").alias("__domain"), F.min("__suffix").alias("__suffix"), *[F.count_if(F.col("__top") == i).cast("double").alias(f"__{i}") for i in range(n)])
    domains = places.filter("__domain is not null").groupBy("__domain").agg(F.min("__suffix").alias("__suffix"), *[F.sum(f"__{i}").alias(f"__{i}") for i in range(n)])
    counted = F.array(*[F.col(f"__{i}") for i in range(n)])
    domains = domains.join(suffixes, "__suffix", "left").select("__domain", _smoothed(counted, F.coalesce("__ps", flat)).alias("__pd"))
    hosts = places.join(domains, "__domain", "left").join(suffixes, "__suffix", "left").select("__host", counted.alias("__c"), F.coalesce("__pd", "__ps", flat).alias("__ph"))
    # A written table, so that both sides of the join are plain exchanges and a crowded host's rows can be split.
    hosts = written(hosts, "hosts")
    # How often each language declares what, whatever number of tags there is; a written table for the same reason.
    tags = scored.filter("__top is not null and __declared is not null").groupBy("__declared").agg(F.array(*[F.count_if(F.col("__top") == i) for i in range(n)]).alias("__n"))
    tags = written(tags, "tags")
    chances = F.array(*[F.lit(float(c)) for c in all_])
    tags = tags.select("__declared", F.zip_with("__n", chances, lambda c, t: F.log((c + ALPHA) / (t + F.lit(ALPHA * (tags.count() + 1))))).alias("__ld"))
    log_declared = F.coalesce("__ld", F.array(*[F.lit(0.0)] * n))
    joined = scored.join(hosts, "__host", "left").join(tags, "__declared", "left")
    own = F.transform("__c", lambda c, i: F.when(i == F.col("__top"), F.greatest(c - 1, F.lit(0.0))).otherwise(c))
    prior = F.when(F.col("__c").isNotNull(), _smoothed(own, F.col("__ph"))).otherwise(flat)
    weight = TEMPER * F.col("n_trigrams")
    logs = F.zip_with(F.zip_with("mean_log", log_declared, lambda m, d: m * F.col("__w") + d), "__prior", lambda a, p: a + F.log(p))
    joined = joined.withColumns({"__prior": prior, "__w": weight}).withColumn("__logs", logs).withColumn("__max", F.array_max("__logs"))
    share = 1 / F.aggregate("__logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__max")))
    names = F.array(*[F.lit(x) for x in model.languages])
    pick = lambda at: F.element_at(names, at.cast("int"))
    is_known = F.col("__top").isNotNull()
    return joined.select(
        "row.*",
        F.when(is_known, pick(F.array_position("__logs", F.col("__max")))).otherwise(UNKNOWN).alias("language"),
        F.when(is_known, share).otherwise(0.0).alias("probability"),
        F.when(is_known, pick(F.col("__top") + 1)).otherwise(UNKNOWN).alias("text_language"),
        is_known.alias("accepted"),
    )


def page_parts(pages: DataFrame) -> DataFrame:
    """Adds of a page's url and html: host, domain (its last two names), suffix, declared (the lang of <html>, first part), text.

    text: what articles and main parts show, or the body if there is no letter in them. Null url or html: null parts, empty text.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    html = F.coalesce(F.col("html"), F.lit(""))
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|title)\b.*?</\1\s*>|<!--.*?-->", " ")
    # From the first article or main to the end of the last one: all of them, those inside others too.
    main = F.regexp_extract(body, r"(?is)<(?:article|main)\b[^>]*>(.*)</(?:article|main)\s*>", 1)
    visible = lambda c: F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"&[a-z]+;|&#\w+;", " ")
    there = pages.withColumns({"__body": body, "__main": visible(main)})
    plain = F.when(F.col("__main").rlike(r"\p{L}"), F.col("__main")).otherwise(visible(F.col("__body")))
    blank = lambda c: F.when(c != "", c)
    there = there.withColumns({"host": blank(host), "declared": blank(F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))), "text": plain}).drop("__body", "__main")
    return there.withColumns({"domain": blank(F.regexp_extract("host", r"([^.]+\.[^.]+)\z", 1)), "suffix": blank(F.regexp_extract("host", r"\.([^.]+)\z", 1))})
