"""Shards of nearly equal bytes by histogram sort.

Rows are ordered by (hash of the text, key), so equal texts stand together. The splitters between shards are found by
rounds: each round counts the exact bytes below a row of probes across all partitions, and the next probes lie in the
one bin that holds the wanted byte. A splitter is settled as soon as a probe is within the tolerance, so it falls between
groups of equal texts where it can; a group heavier than that is cut by key. Then the rows are exchanged once.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS, TOLERANCE = 8, 0.001
#: Probes of a round, as bits; rows of one text hash range that are numbered by one task at most.
BITS, CHUNK_ROWS = 11, 2_000_000
LEAST = -(1 << 63)

Splitter = tuple[int, int]


def _width(lo: int, hi: int) -> int:
    """Of each of a range's bins."""
    return -(-(hi - lo) // (1 << BITS))


class _Search:
    """The range in which a splitter lies: of text hashes, or of keys under one text hash. below: bytes before lo."""

    def __init__(self, target: float):
        self.target, self.below, self.under, self.found = target, 0, None, None
        self.lo, self.hi = LEAST, 1 << 63

    @property
    def range(self) -> tuple:
        return self.under, self.lo, self.hi

    def splitter(self, at: int) -> Splitter | None:
        return (at, LEAST) if self.under is None else (self.under, at)

    def narrow(self, bins: dict[int, int], tolerance: float) -> None:
        """bins: bytes by bin of this range."""
        below, width = self.below, _width(self.lo, self.hi)
        for b in sorted(bins):
            if below + bins[b] > self.target:
                break
            below += bins[b]
        else:
            self.found = self.splitter(self.hi)
            return
        lo, after = self.lo + b * width, below + bins[b]
        hi = min(lo + width, self.hi)
        one_key = width == 1 and self.under is not None
        if self.target - below <= tolerance or one_key and self.target - below <= after - self.target:
            self.found = self.splitter(lo)
        elif after - self.target <= tolerance or one_key:
            self.found = self.splitter(hi)
        elif width == 1:
            self.under, self.lo, self.hi, self.below = lo, LEAST, 1 << 63, below
        else:
            self.lo, self.hi, self.below = lo, hi, below


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[Splitter]:
    """shards - 1 ordered (hash, key) pairs; a row belongs after a splitter that is not greater. keys: k1, k2, size.

    What a round brings to the driver is bounded by the number of probes, whatever the input.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    searches = [_Search(total * j / shards) for j in range(1, shards)]
    while open_ := [s for s in searches if s.found is None]:
        ranges = list(dict.fromkeys(s.range for s in open_))
        which, bin_ = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (under, lo, hi) in enumerate(ranges):
            col = F.col("k1" if under is None else "k2")
            inside = (col >= lo) & (col <= hi - 1)
            if under is not None:
                inside = (F.col("k1") == under) & inside
            width = _width(lo, hi)
            # A whole range is cut by its leading bits, as a difference of two of its longs can be too large for a long.
            at = F.shiftright(col, 64 - BITS) + (1 << BITS - 1) if hi - lo == 1 << 64 else F.expr(f"({'k1' if under is None else 'k2'} - ({lo}L)) div {width}L")
            which, bin_ = F.when(inside, i).otherwise(which), F.when(inside, at.cast("long")).otherwise(bin_)
        found: dict[int, dict[int, int]] = {i: {} for i in range(len(ranges))}
        for r in keys.select(which.alias("r"), bin_.alias("b"), "size").filter("r is not null").groupBy("r", "b").agg(F.sum("size").alias("n")).collect():
            found[r.r][r.b] = r.n
        for s in open_:
            s.narrow(found[ranges.index(s.range)], tolerance * total / shards)
    return [s.found for s in searches]


def _after(s: Splitter) -> Column:
    if s[0] >= 1 << 63:
        return F.lit(False)
    beyond = F.lit(False) if s[1] >= 1 << 63 else F.col("k2") >= s[1]
    return (F.col("k1") > s[0]) | (F.col("k1") == s[0]) & beyond


def shard(df: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds size, text_crc32, shard (0 to shards - 1) and slot, the row's place in its shard, without gaps.

    size: UTF-8 bytes of the text plus 1; a null text has none and counts as an empty one. key: an integer; a null key
    sorts first. Rows of equal text and key stay in one shard, however many; texts of any length count whole. keep: the columns that stay besides, all unless given;
    columns under the new names are replaced.
    """
    made = ["size", "text_crc32", "shard", "slot"]
    keep = [c for c in df.columns if c not in made] if keep is None else keep
    held, raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), [f"`{c}`" for c in keep]
    rows = written(
        df.select(
            F.struct(*raw).alias("row"),
            (F.octet_length(held) + 1).cast("long").alias("size"),
            F.crc32(held.cast("binary")).alias("text_crc32"),
            F.xxhash64(held).alias("k1"),
            F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LEAST)).alias("k2"),
            # A number of the row, fixed by writing it: rows of one text and key can so be numbered by several tasks.
            F.monotonically_increasing_id().alias("no"),
        ),
        "shard-rows",
    )
    of = sum((_after(s).cast("int") for s in splitters(rows.select("k1", "k2", "size"), shards, tolerance)), F.lit(0))
    # Slots are dealt by ranges of the hash, the crowded ones cut further, so that no task numbers a whole shard.
    rows = rows.withColumns({"shard": of, "range": F.shiftright("k1", 64 - BITS).cast("int")})
    per_range = {r["range"]: r.n for r in rows.groupBy("range").agg(F.count("*").alias("n")).collect()}
    limit = min(CHUNK_ROWS, 4 * (sum(per_range.values()) >> BITS) + 64)
    # By place in one literal: there are 2 ** BITS ranges, whatever the input.
    cuts = F.array(*[F.lit(-(-per_range.get(r, 1) // limit)) for r in range(-(1 << BITS - 1), 1 << BITS - 1)])
    rows = rows.withColumn("cut", F.pmod(F.xxhash64("no"), F.get(cuts, F.col("range") + (1 << BITS - 1))).cast("int"))
    chunk = ["shard", "range", "cut"]
    per_chunk = rows.groupBy(*chunk).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range", "cut").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each chunk: 2 ** BITS and the crowded ones' cuts.
    offsets = F.broadcast(per_chunk.select(*chunk, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    number = F.row_number().over(Window.partitionBy(*chunk).orderBy("k1", "k2", "no"))
    return rows.withColumn("place", number).join(offsets, chunk).select("row.*", "size", "text_crc32", "shard", (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"))
