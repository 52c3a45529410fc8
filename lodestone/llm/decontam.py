"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Documents are partitioned by size, so that the one-permutation MinHash of a partition has bins in proportion to its
largest document: a short item inside a long document then shares bin minima with it as often as inside a short one.
The bins are leading bits of the shingle hash, so a minimum is told by its value alone, and an item's shingle that is
the least of its bin stays so in every partition with finer bins. The number of bins follows from the smallest item and
the chance MISS that an item at the threshold shares no minimum; small items get so many bins that no shingle is hidden.
Items of fewer than five words do not count there: only documents of one shingle can have them, and the one shingle of
these is their minimum with any number of bins.

Document minima are looked up among the items' minima in the scan itself; the documents that share one are verified
there by the exact share of the item's distinct shingles that they have. Only pairs are shuffled. Item tables over
BROADCAST_ROWS are joined by shuffle instead.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, ascii_lower, shingle_hashes, words

WORD = r"[^\x20\x09-\x0D]"
THRESHOLD, MISS, BROADCAST_ROWS = 0.8, 1e-6, 1_000_000
#: Extra bits at least, and where all items are of fewer than five words.
FEWEST = -4


def bin_bits(smallest: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Extra bits: a partition of documents of up to 2**p shingles needs 2**(p + bits) bins.

    With x shingles a bin, one is its bin's least with a chance of (1 - exp(-x)) / x; at least threshold * smallest of
    them are shared.
    """
    shared = max(1, math.ceil(threshold * smallest))
    for bits in range(FEWEST, 40):
        x = 2.0**-bits
        if (1 - (1 - math.exp(-x)) / x) ** shared <= miss:
            return bits
    return 40


def _least(hashes: str, shift: str) -> str:
    """SQL of the least hash of each bin, from sorted distinct hashes; bins are the bits that shift leaves."""
    return f"transform(array({hashes}), s -> filter(s, (x, i) -> i = 0 or shiftright(x, {shift}) != shiftright(s[i - 1], {shift})))[0]"


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", item: str = "item_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(key, item, shared, containment): pairs where a document has at least threshold of an item's distinct shingles.

    A text of fewer than five words has one shingle, of all of them, and so is found in documents of just these words.
    Null and empty texts have no shingles: such items are in no document. Repeated keys: the pair once, with the larger
    containment. Items of one id and different texts are items of their own that share the id.
    """
    own = shingle_hashes(items.select(F.col(item).alias("__item"), F.col(text).cast("string").alias("__text")).filter(F.col("__text").rlike(WORD)), "__text", "__i")
    many = F.size(words(ascii_lower(F.col("__text")))) >= SHINGLE_WORDS
    own = own.select("__item", F.sort_array(F.array_distinct("__i")).alias("__i"), many.alias("__many")).distinct()
    own = own.withColumn("__no", F.xxhash64("__item", "__i"))
    stats = own.agg(F.min(F.when(F.col("__many"), F.size("__i"))).alias("least"), F.sum(F.size("__i")).alias("rows")).first()
    own = own.drop("__many")
    bits = bin_bits(stats["least"], threshold) if stats["least"] else FEWEST
    # __p: the least partition in whose bins the shingle is the least of its item.
    place = f"""transform(__i, (x, i) -> named_struct('h', x, 'p', case when i = 0 or shiftright(x, 63) != shiftright(__i[i - 1], 63) then 0
        else greatest(0, cast(65 - length(bin(x ^ __i[i - 1])) - {bits} as int)) end))"""
    minima = own.select("__no", F.explode(F.expr(place)).alias("e")).select("__no", F.col("e.h").alias("__h"), F.col("e.p").alias("__p0"))
    small = (stats["rows"] or 0) <= broadcast_rows
    minima, there = (F.broadcast(minima), F.broadcast(own)) if small else (minima, own)
    hashed = shingle_hashes(docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")), "__text", "__s").drop("__text")
    hashed = hashed.select("__key", F.sort_array(F.array_distinct("__s")).alias("__s"))
    # Never null, or the join would have it tested in a filter of its own, which hashes all texts once more.
    hashed = hashed.withColumn("__p", F.coalesce(F.ceil(F.log2(F.greatest(F.size("__s"), F.lit(1)))).cast("int"), F.lit(0)))
    least = F.expr(_least("__s", f"greatest(0, least(63, 64 - __p - ({bits})))"))
    match = [F.col("__sig") == F.col("__h"), F.col("__p") >= F.col("__p0")]
    shared = F.size(F.array_intersect("__s", "__i"))
    if small:
        pairs = hashed.select("__key", "__s", "__p", F.explode(least).alias("__sig")).join(minima, match).join(there, "__no")
    else:
        found = hashed.select("__key", "__p", F.explode(least).alias("__sig")).join(minima, match).select("__key", "__no").distinct()
        pairs = found.join(hashed.select("__key", "__s"), "__key").join(there, "__no")
    checked = pairs.select(F.col("__key").alias(key), F.col("__item").alias(item), shared.alias("shared"), (shared / F.size("__i")).alias("containment"))
    return checked.filter(F.col("containment") >= threshold).groupBy(key, item).agg(F.max("shared").cast("long").alias("shared"), F.max("containment").alias("containment"))


def oracle(threshold: float = THRESHOLD, n: int = SHINGLE_WORDS) -> str:
    """The same pairs in DuckDB's SQL, by all shingles."""

    def shingles(table: str, key: str) -> str:
        return f"""select distinct {key}, case when len(w) < {n} then array_to_string(w, ' ') else array_to_string(w[i:i + {n - 1}], ' ') end as s from
            (select {key}, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) as i from
            (select {key}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from {table}) where len(w) > 0)"""

    return f"""with d as ({shingles("documents", "doc_id")}), q as ({shingles("benchmark", "item_id")}), n as (select item_id, count(*) as total from q group by 1),
        f as (select doc_id, item_id, count(*) as shared from d join q using (s) group by 1, 2)
        select doc_id, item_id, shared, shared / total as containment from f join n using (item_id) where shared / total >= {threshold}"""
