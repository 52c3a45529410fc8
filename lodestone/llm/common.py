"""What the operators share: places to keep intermediate tables, word and shingle expressions, safe column names."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by these six characters.
SPACE = r"[\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset, one of our own on a single machine; an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), "lodestone-checkpoints")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def table_path(spark: SparkSession, what: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/lodestone-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = table_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Removes the files of a table made by written()."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if "/lodestone-" in folder:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for an empty or null text."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(cut == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(cut, SPACE))


def shingle_hashes(df: DataFrame, text: str, to: str, n: int = SHINGLE_WORDS) -> DataFrame:
    """Adds to: 64-bit hashes of the text's n-word shingles in order, repeats included.

    Each word is hashed once, and a shingle's hash is that of its n word hashes. A text of fewer words has one shingle,
    of all of them; a text without words has none. Words are compared in lower case (A-Z only).
    """
    # The word hashes are a lambda's variable, and so are made once however the optimizer moves the expression.
    last = ", ".join(f"h[i+{k}]" for k in range(n))
    return df.withColumn("__w", F.transform(words(ascii_lower(F.col(text))), lambda w: F.xxhash64(w))).withColumn(
        to,
        F.expr(
            f"transform(array(__w), h -> case when size(h) = 0 then cast(array() as array<bigint>) when size(h) < {n} then array(xxhash64(h)) "
            f"else transform(sequence(0, size(h) - {n}), i -> xxhash64({last})) end)[0]"
        ),
    ).drop("__w")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
