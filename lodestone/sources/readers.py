"""Documents from JSON, JSONL or Parquet, with the names that fields go by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

#: Where a document's fields come from: the first that is not blank counts. Only strings do: a numeric id is no id.
FIELDS = {"id": ["id", "doc_id", "document_id"], "title": ["title", "metadata.title"], "text": ["text", "passage", "content"], "language": ["language", "lang", "metadata.language"], "query": ["query", "question", "metadata.query"]}
WRAPPERS = ["data", "records", "documents", "train"]


class BadRecord(ValueError):
    """A line that is not JSON; its number is in the message."""


def _documents(rows: DataFrame, limit: int, title: str, prefix: str, source: str) -> DataFrame:
    """From (ord, record: JSON text of one object). The limit counts records, those without a text too."""
    if limit > 0:
        rows = rows.filter(F.col("ord") < limit)

    def field(path: str):
        got = F.try_variant_get(F.col("__v"), f"$.{path}", "string")
        return F.when(F.schema_of_variant(F.try_variant_get(F.col("__v"), f"$.{path}", "variant")) == "STRING", got)

    there = rows.withColumn("__v", F.try_parse_json("record"))
    made = {name: text.first_filled(*[field(p) for p in paths]) for name, paths in FIELDS.items()}
    number = (F.col("ord") + 1).cast("string")
    return there.select(
        F.coalesce(made["id"], F.concat(F.lit(prefix), number)).alias("id"),
        "ord",
        F.coalesce(made["title"], F.concat(F.lit(title), number)).alias("title"),
        made["text"].alias("text"),
        F.coalesce(made["language"], F.lit("unknown")).alias("language"),
        F.coalesce(F.nullif(text.clean(field("source")), F.lit("")), F.lit(source)).alias("source"),
        made["query"].alias("query"),
    ).filter(F.col("text").isNotNull())


def _numbered(df: DataFrame) -> DataFrame:
    """Adds ord, the row's number among all in the order of the partitions, from 0 and without gaps.

    Each partition's rows are numbered by themselves; what goes before a partition comes from a table of one row for each.
    """
    there = df.withColumn("__at", F.monotonically_increasing_id()).withColumns({"__p": F.shiftright("__at", 33), "__i": F.col("__at").bitwiseAND((1 << 33) - 1)})
    sizes = there.groupBy("__p").agg((F.max("__i") + 1).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__start"))
    return there.join(F.broadcast(starts), "__p").withColumn("ord", (F.col("__start") + F.col("__i")).cast("long")).drop("__at", "__p", "__i", "__start")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(ord, record) of one file's lines in order; blank lines and values that are not objects are passed over, but numbered.

    A line that is not JSON raises BadRecord.
    """
    numbered = _numbered(spark.read.text(path).select("value")).filter(F.trim("value") != "")
    bad = numbered.filter(F.try_parse_json("value").isNull()).agg(F.min("ord").alias("ord")).first()
    if bad["ord"] is not None:
        raise BadRecord(f"line {bad['ord'] + 1} of {path} is not valid JSON")
    return numbered.filter(F.trim("value").startswith("{")).select("ord", F.trim("value").alias("record"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(ord, record) of a file that is an array of objects, or an object with one under data, records, documents or train."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    kinds = whole.select(F.schema_of_variant("v").alias("root"), *[F.schema_of_variant(F.try_variant_get("v", f"$.{w}", "variant")).alias(w) for w in WRAPPERS]).first()
    if kinds is None or kinds["root"] is None:
        raise BadRecord(f"{path} is not valid JSON")
    at = "$" if kinds["root"].startswith("ARRAY") else next((f"$.{w}" for w in WRAPPERS if (kinds[w] or "").startswith("ARRAY")), None)
    if at is None:
        raise ValueError(f"{path} has no array of records, nor one under {', '.join(WRAPPERS)}")
    rows = whole.select(F.posexplode(F.try_variant_get("v", at, "array<variant>")).alias("ord", "r"))
    return rows.select(F.col("ord").cast("long"), F.to_json("r").alias("record")).filter(F.col("record").startswith("{"))


def read_documents(spark: SparkSession, path: str, limit: int = 0, title: str = "Document ", prefix: str = "doc_", source: str = "corpus") -> DataFrame:
    """Documents (id, ord, title, text, language, source, query) by the file's extension. limit: records, all if not positive."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        rows = _numbered(spark.read.parquet(path).select(F.to_json(F.struct("*")).alias("record")))
    elif kind == "jsonl":
        rows = read_jsonl(spark, path)
    elif kind == "json":
        rows = read_json(spark, path)
    else:
        raise ValueError(f"{path}: .json, .jsonl or .parquet is expected")
    return _documents(rows, limit, title, prefix, source)


def dataset_info(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Documents by language, with the number of all and the path they are from."""
    by = docs.groupBy("language").agg(F.count("*").alias("documents"))
    total = by.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("total"))
    return by.crossJoin(F.broadcast(total)).withColumn("path", F.lit(path).cast("string"))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Little-endian 32-bit floats, dim for each vector."""
    for batch in batches:
        for dim, n, raw in zip(batch.column("dim").to_pylist(), batch.column("n").to_pylist(), batch.column("raw"), strict=True):
            flat = np.frombuffer(raw.as_buffer(), dtype="<f4", count=n * dim)
            for at in range(0, n, 4096):
                part = flat[at * dim : (at + 4096) * dim]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) // dim + 1, dtype=np.int32) * dim), pa.array(part))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(lists))), lists], names=["chunk_ord", "embedding"])


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_ord, embedding) of a stored vector index: one JSON object with dim, numVectors, and vectorsBase64 or vectorsArray.

    Base64 goes before an array; an index with neither has no vectors. Too few numbers for numVectors and dim raise an error.
    """
    stored = spark.read.schema("dim int, numVectors int, vectorsBase64 string, vectorsArray array<array<float>>").json(path, multiLine=True)
    packed = F.nullif("vectorsBase64", F.lit(""))
    raw = stored.filter(packed.isNotNull()).select("dim", F.col("numVectors").alias("n"), F.unbase64(packed).alias("raw"))
    listed = stored.filter(packed.isNull() & F.col("vectorsArray").isNotNull()).select("dim", "numVectors", F.posexplode("vectorsArray").alias("chunk_ord", "embedding"))
    fits = F.assert_true(F.size("embedding") == F.col("dim"), F.lit("a vector is not of the index's dimension"))
    listed = listed.filter("chunk_ord < numVectors").filter(fits.isNull()).select(F.col("chunk_ord").cast("long"), "embedding")
    return raw.mapInArrow(_vectors, "chunk_ord long, embedding array<float>").unionByName(listed)


def resolve(spark: SparkSession, asked: str | None, folders: list[str], names: list[str]) -> str:
    """The path that is asked for, alone or in one of the folders; if none is, the first of names in a folder. Any file system of Spark's."""
    tried = [asked, *(f"{f.rstrip('/')}/{asked}" for f in folders)] if asked else [f"{f.rstrip('/')}/{n}" for f in folders for n in names]
    for candidate in tried:
        path = spark._jvm.org.apache.hadoop.fs.Path(candidate)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return candidate
    raise FileNotFoundError("no dataset at " + ", ".join(tried))
