"""Exact repeats of long byte strings by a logarithmic family of sparse suffix arrays.

Documents come in batches. A batch's suffix array has one entry for each distinct block (see anchors): the hash of its
anchor's string, the hash of the block, how often it occurs, and one place. It is a table sorted by these hashes, not by the
suffixes' bytes, and bucketed by anchor. add() makes the batch's table; two levels of one size merge, in one scan of
both, into the next, so an index of n batches has no more than log2(n) levels and each entry is rewritten log2(n) times.
Matches between levels that have not merged are found once, by scan() over all levels together, after the last batch.

Then windows are judged. A block that occurs twice is a repeat throughout; one whose anchor has no other block is
unique throughout. Where one anchor has several blocks, their windows are compared, in pieces first and then, in pieces
that share their core, one by one. All comparisons are of hashes: they are not verified on the bytes.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .anchors import LENGTH, Hashes, blocks, mix, segments
from .common import partitions, table_path

GRAM, CHUNK, BATCHES, PIECE = 100, 1 << 20, 2, 16
#: A place is a first window, a number of windows and the anchor's distance, in one long.
FIRST, COUNT = 1 << 24, 1 << 12


def release(spark: SparkSession) -> None:
    """Lets go of the exchanges of jobs whose results are written: Spark removes them once the JVM has found them unused."""
    gc.collect()
    spark._jvm.System.gc()


def bucketed(df: DataFrame, by: str, sort: list[str], n: int) -> DataFrame:
    """Written in the shared folder, in n buckets; df has to be partitioned so already, or it is exchanged."""
    spark = df.sparkSession
    name = f"lodestone_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", table_path(spark, "buckets")).bucketBy(n, by).sortBy(*sort).saveAsTable(name)
    table = spark.table(name)
    # What was read from the catalog stays in the frame's plan, buckets too; the files are not the catalog's.
    spark.sql(f"drop table {name}")
    return table


def _chunks(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """(text, its first byte) of the parts that stand one after another in a buffer, the buffer, their ends."""
    at: list[int] = []
    first: list[int] = []
    parts: list[bytes] = []
    held = 0
    for k, begin, part in segments(texts, CHUNK):
        at.append(k)
        first.append(begin)
        parts.append(part)
        held += len(part)
        if held >= CHUNK:
            yield at, first, np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts])
            at, first, parts, held = [], [], [], 0
    if parts:
        yield at, first, np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct block of a record batch."""
    for batch in batches:
        texts = [x.as_py() for x in batch.column("__bytes")]
        rid = batch.column("rid").to_numpy()
        found = []
        for at, first, data, ends in _chunks(texts):
            h, start, count, a, anchor = blocks(data, ends, gram=GRAM)
            part = np.searchsorted(ends, start, side="right")
            begin = np.concatenate([[0], ends[:-1]])
            place = start - begin[part] + np.array(first, dtype=np.int64)[part]
            found.append((a, h.of(start, start + count - 1 + LENGTH), rid[np.array(at)[part]], place * FIRST + count * COUNT + anchor - start))
        if not found:
            continue
        a, b, r, p = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((b, a))
        new = np.flatnonzero(np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])[: len(order)])
        n, keep = np.diff(np.concatenate([new, [len(order)]])), order[new]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[keep].view(np.int64), b[keep].view(np.int64), n, r[keep], p[keep])], names=["a", "b", "n", "rid", "place"])


class SuffixIndex:
    """Levels by size: a level of size k holds 2**k batches."""

    def __init__(self, spark: SparkSession):
        self.spark, self.buckets = spark, partitions(spark)
        self.levels: dict[int, DataFrame] = {}

    def add(self, docs: DataFrame) -> None:
        """docs: rid and __bytes."""
        raw = docs.select("rid", "__bytes").mapInArrow(_entries, "a long, b long, n long, rid long, place long")
        new = bucketed(self._summed(raw.repartition(self.buckets, "a")), "a", ["a", "b"], self.buckets)
        release(self.spark)
        size = 0
        while size in self.levels:
            old = self.levels.pop(size)
            merged = bucketed(self._merged([old, new]), "a", ["a", "b"], self.buckets)
            self.drop(old)
            self.drop(new)
            release(self.spark)
            new, size = merged, size + 1
        self.levels[size] = new

    def _merged(self, levels: list[DataFrame]) -> DataFrame:
        if len(levels) == 1:
            return levels[0]
        # Each level passes a filter (n is never 0), so that the union reads rows: read in columns, its partitions would
        # stand one after another although it says that buckets meet. The exchange is left out where they do meet.
        both = levels[0].filter("n > 0")
        for level in levels[1:]:
            both = both.union(level.filter("n > 0"))
        return self._summed(both.repartition(self.buckets, "a"))

    @staticmethod
    def _summed(entries: DataFrame) -> DataFrame:
        # first() takes both columns from one row; which row matters only for blocks that occur once.
        return entries.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("rid").alias("rid"), F.first("place").alias("place"))

    def scan(self) -> DataFrame:
        """All levels in one scan: (a, b, n, rid, place, others), others: the anchor's further blocks."""
        return self._merged(list(self.levels.values())).withColumn("others", F.count("*").over(Window.partitionBy("a")) - 1)

    def drop(self, table: DataFrame) -> None:
        files = table.inputFiles()
        if files:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each PIECE windows in a row of the doubtful blocks, cut at multiples of PIECE before the anchor.

    Two hashes tell the bytes that all windows of such a piece share, so pieces with a window in common have them in
    common; w has a hash of each window.
    """
    for batch in batches:
        rid = batch.column("rid").to_numpy()
        out, held = [], 0
        for k in range(batch.num_rows):
            h = Hashes(np.frombuffer(batch.column("__bytes")[k].as_py(), dtype=np.uint8))
            blocks_ = batch.column("doubtful")[k].as_py()
            place = np.array([d["place"] for d in blocks_], dtype=np.int64)
            a = np.array([d["a"] for d in blocks_], dtype=np.int64).view(np.uint64)
            n = np.array([d["n"] for d in blocks_], dtype=np.int64)
            count = place % FIRST // COUNT
            block = np.repeat(np.arange(len(place)), count)
            step = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
            at = (place // FIRST)[block] + step
            before = (place % COUNT)[block] - step
            part = before // PIECE
            new = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (part[1:] != part[:-1])]))
            late = at[new] + before[new] - part[new] * PIECE
            end = late - (PIECE - 1) + LENGTH
            c1 = h.of(late, end)
            c2 = h.of(late + LENGTH // 2, end) ^ mix(a[block[new]] + part[new].astype(np.uint64))
            out.append((c1.view(np.int64), c2.view(np.int64), n[block[new]], np.full(len(new), rid[k]), at[new], h.of(at, at + LENGTH).view(np.int64), np.diff(np.concatenate([new, [len(at)]]))))
            held += len(at)
            if held > 200_000 or k == batch.num_rows - 1:
                c1, c2, n, r, first, w, size = (np.concatenate(x) for x in zip(*out, strict=True))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(w))
                yield pa.RecordBatch.from_arrays([pa.array(c1), pa.array(c2), pa.array(n), pa.array(r), pa.array(first), lists], names=["c1", "c2", "n", "rid", "at", "w"])
                out, held = [], 0


def removed(n: int, *unique_places: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of a text of n bytes that repeats cover, from the places of its unique windows."""
    windows = n - LENGTH + 1
    if windows <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    step = np.zeros(windows + 1, dtype=np.int64)
    for p in unique_places:
        if p is not None and len(p):
            np.add.at(step, p // FIRST, 1)
            np.add.at(step, p // FIRST + p % FIRST // COUNT, -1)
    unique = np.cumsum(step[:-1]) > 0
    repeats = np.flatnonzero(~unique)
    if not len(repeats):
        return repeats, repeats
    cut = np.flatnonzero(np.diff(repeats) > LENGTH)
    return repeats[np.concatenate([[0], cut + 1])], repeats[np.concatenate([cut, [len(repeats) - 1]])] + LENGTH


def _strip(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                spans, kept = [], []
                for text, places, singles in zip(part.column("__bytes").to_pylist(), part.column("sure"), part.column("singles"), strict=True):
                    starts, ends = removed(len(text), places.values and places.values.to_numpy(), singles.values and singles.values.to_numpy())
                    spans.append([{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
                    edges = [0, *(x for s, e in zip(starts.tolist(), ends.tolist(), strict=True) for x in (s, e)), len(text)]
                    kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                made = [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=[*keep, "removed", "kept"])

    return run


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, batches: int = BATCHES) -> DataFrame:
    """Adds removed, the maximal runs (start, end: bytes, end exclusive) that repeats cover, and kept, the other bytes.

    A byte is covered if a string of LENGTH bytes around it also starts anywhere else in the input, in the same text
    included. Texts are UTF-8; a null one is empty. Rows of equal key and text are repeats of each other. keep: the
    columns that stay besides, all unless given.
    """
    spark = df.sparkSession
    n = partitions(spark)
    keep = [c for c in df.columns if c not in ("removed", "kept")] if keep is None else keep
    held = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.xxhash64(held, F.col(f"`{key}`")).alias("rid"), held.cast("binary").alias("__bytes"))
    docs = bucketed(docs.repartition(n, "rid"), "rid", ["rid"], n)
    release(spark)
    index = SuffixIndex(spark)
    for k in range(batches):
        index.add(docs.filter(F.pmod(F.shiftright("rid", 20), F.lit(batches)) == k))
    entries = index.scan()
    unique = F.when((F.col("n") == 1) & (F.col("others") == 0), F.col("place"))
    doubt = F.when(F.col("others") > 0, F.struct("a", "n", "place"))
    flags = entries.filter((F.col("n") == 1) | (F.col("others") > 0)).select("rid", unique.alias("u"), doubt.alias("d"))
    # The blocks of one text: bounded by its length.
    flags = flags.repartition(n, "rid").groupBy("rid").agg(F.collect_list("u").alias("sure"), F.collect_list("d").alias("doubtful"))
    flags = bucketed(flags, "rid", ["rid"], n)
    for level in index.levels.values():
        index.drop(level)
    release(spark)
    pieces = docs.select("rid", "__bytes").join(flags.filter(F.size("doubtful") > 0).select("rid", "doubtful").hint("merge"), "rid")
    pieces = pieces.mapInArrow(_pieces, "c1 long, c2 long, n long, rid long, at long, w array<long>").repartition(n, "c1")
    pieces = pieces.withColumn("others", F.count("*").over(Window.partitionBy("c1", "c2")) - 1)
    # A piece that shares its core with no other has unique windows, if its block occurs once; else they are compared.
    alone = F.when(F.col("others") == 0, F.array(F.struct(F.lit(None).cast("long").alias("w"), F.col("at"), F.size("w").alias("k"))))
    each = F.transform("w", lambda w, i: F.struct(w.alias("w"), (F.col("at") + i).alias("at"), F.lit(1).alias("k")))
    windows = pieces.filter((F.col("others") > 0) | (F.col("n") == 1)).select("c1", "c2", "n", "rid", F.explode(F.coalesce(alone, each)).alias("e"))
    windows = windows.groupBy("c1", "c2", "e.w").agg(F.sum("n").alias("n"), F.first("rid").alias("rid"), F.first(F.col("e.at") * FIRST + F.col("e.k") * COUNT).alias("place"))
    single = windows.filter("n = 1").select("rid", "place").repartition(n, "rid").groupBy("rid").agg(F.collect_list("place").alias("singles"))
    single = bucketed(single, "rid", ["rid"], n)
    release(spark)
    whole = docs.join(flags.select("rid", "sure").hint("merge"), "rid", "left").join(single.hint("merge"), "rid", "left").select("row", "__bytes", "sure", "singles")
    stripped = whole.mapInArrow(_strip(["row"]), f"row {docs.schema['row'].dataType.simpleString()}, removed array<struct<start:bigint,end:bigint>>, kept binary")
    return stripped.select("row.*", "removed", "kept")
