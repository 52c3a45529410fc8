"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's sketch has the K least of its distinct shingle hashes, in order. The sketch of several parts is the K least of
their sketches together, so sketches can be made part by part and merged. Two sketches estimate resemblance (the share
of the union's K least that both have), containment, and the number of distinct shingles; of texts with no more than K
shingles, exactly.

DataFrame functions only. Null texts are empty ones; an empty text has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, shingle_hashes

K = 128


def sketch(df: DataFrame, text: str = "text", to: str = "sketch", k: int = K) -> DataFrame:
    """Adds to, array<long>."""
    return shingle_hashes(df, text, to).withColumn(to, F.slice(F.sort_array(F.array_distinct(to)), 1, k))


def merge(sketches: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """(key, column): one sketch for all parts with a key. Each task keeps no more than k hashes of a key."""
    hashes = sketches.select(key, F.explode(column).alias("__h")).distinct()
    least = hashes.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__h"))).filter(F.col("__n") <= k)
    merged = least.groupBy(key).agg(F.sort_array(F.collect_list("__h")).alias(column))
    empty = sketches.groupBy(key).agg(F.max(F.size(column)).alias("__m")).filter("__m = 0").select(key, F.expr("cast(array() as array<bigint>)").alias(column))
    return merged.unionByName(empty)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """0 to 1; two empty sketches are alike."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k; otherwise from the place of the k-th least hash among all longs."""
    share = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Of a's shingles, the share that b has: by resemblance and the numbers of shingles; an empty a is contained."""
    j, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (n + m) / n))


def text_of(a: Column) -> Column:
    """A sketch as a string: 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(df: DataFrame, key: str, columns: list[str], prepare=lambda df: df) -> DataFrame:
    """Adds next_c for each of columns: its value in the next row by (key, columns), and for the last row in the first.

    Rows are cut into ranges of the key, whose first keys are quantiles of the keys. The rows with a range's first key
    also go, as ghosts, to the range before, so each range finds its last row's next one by itself. A null key comes
    first. prepare: applied after the exchange (it has to keep the columns beginning with __). columns: after it.
    """
    at = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63)))
    ranges = 4 * partitions(df.sparkSession)
    marks = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    row = df.select(at.alias("__at")).agg(F.min("__at").alias("least"), F.percentile_approx("__at", marks, F.lit(max(10_000, 4 * ranges))).alias("marks")).first()
    heads = sorted({row["least"], *(row["marks"] or [])} - {None}) or [0]
    array = "array(" + ", ".join(f"{h}L" if h > -(1 << 63) else "(-9223372036854775807L - 1L)" for h in heads) + ")"
    steps = ", ".join(str(1 << b) for b in range(len(heads).bit_length() - 1, -1, -1))
    find = f"aggregate(array({steps}), 0, (lo, step) -> case when lo + step <= size(__heads) and __heads[lo + step - 1] <= __at then lo + step else lo end) - 1"
    there = df.withColumn("__at", at).withColumn("__heads", F.expr(array)).withColumn("__range", F.expr(find))
    first, last = F.col("__range") == 0, len(heads) - 1
    ghost = F.struct(F.when(first, F.lit(last)).otherwise(F.col("__range") - 1).alias("range"), F.lit(True).alias("ghost"), first.cast("int").alias("wrap"))
    own = F.struct(F.col("__range").alias("range"), F.lit(False).alias("ghost"), F.lit(0).alias("wrap"))
    to = F.when(F.expr("__heads[__range] = __at"), F.array(own, ghost)).otherwise(F.array(own))
    there = there.withColumn("__to", F.explode(to)).select("*", F.col("__to.range").alias("__in"), F.col("__to.ghost").alias("__ghost"), F.col("__to.wrap").alias("__wrap"))
    there = prepare(there.drop("__heads", "__range", "__to").repartition("__in"))
    order = Window.partitionBy("__in").orderBy("__wrap", "__at", *columns, "__ghost")
    return there.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter("not __ghost").drop("__at", "__in", "__ghost", "__wrap")


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the text's code points replaced by as many of the next text's first ones, or all it has."""
    cut = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(key, text, sketch, edited, edited_sketch, near_edited, near_next) for each row."""
    rows = df.select(F.col(key), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(text))
    found = with_next(rows, key, [text, "sketch"], prepare=lambda there: sketch(there, text, "sketch", k))
    found = sketch(found.withColumn("edited", edited(F.col(text), F.col(f"next_{text}"))), "edited", "edited_sketch", k)
    near = {"near_edited": resemblance(F.col("sketch"), F.col("edited_sketch"), k), "near_next": resemblance(F.col("sketch"), F.col("next_sketch"), k)}
    return found.withColumns(near).drop(f"next_{text}", "next_sketch")
