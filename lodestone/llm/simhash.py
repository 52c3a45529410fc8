"""SimHash near-duplicates: exact comparison of all fingerprints, in tiles.

Fingerprints (of one 64-bit word or more) are put into strata that cannot hold links with each other unless their numbers
are close: the population counts of the four 16-bit parts of a word (two fingerprints differ in at least as many bits as
the counts of their parts differ in sum), or classes of the number of shingles (sets of similarity s differ in size by no
more than 1/s). A stratum is cut into tiles of about TILE fingerprints, each one row. A tile meets the tiles of its own and
its partner strata in numpy, with exclusive-or and bit counts; blocks whose population counts differ by more than the
radius are skipped. A task holds one home tile, or a few, and at most TILES partner tiles of each partner stratum at a time, and
hands on not all linked pairs but a spanning forest of them. A tile is sent once for each home it meets: the more tiles
a home has, the fewer copies are exchanged.

Equal fingerprints, or equal shingle sets, are one node throughout, so thousands of copies of a text cost what one costs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import SHINGLE_WORDS, drop_table, written
from .components import components, forest

SEED, SHINGLE, RADIUS, TILE, TILES, BITS = 42, 3, 2, 4096, 64, 64
PARTS = 4
#: For representatives(): the similarity is PART / WHOLE. Of 256 bits, sets at it differ in 38.8 on average, with a deviation
#: of 5.7 (the worst case, sets of 4 and 5: 48 and 6.2): more than NEAR for one such pair in some 2,000, less often for others.
#: Unlike large sets differ in 128, with a deviation of 8, so chance does not chain up groups as the input grows; of unlike
#: sets of two shingles (96 and 7.7) some 2 pairs in 10,000 are proposed.
PART, WHOLE, WORDS, NEAR, COMPARED = 4, 5, 4, 68, 512
#: Tiles of a home for representatives(); most 64-bit words of marks, which go to every task; marks are 1 bit in SPARSE at most while they fit.
HOMES, MARKS, SPARSE = 16, 1 << 18, 32
#: Classes of sizes: somewhat wider than the ratio that linked sets can have, so these are of neighbouring classes at most.
CLASS = 1.26


def fingerprint(text: bytes) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's word 3-shingles, repeats included.

    bytes.lower() and bytes.split() touch A-Z and the six ASCII spaces only. Long texts are taken in blocks.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    n, counts = len(words) - SHINGLE + 1, np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        part = words[at : at + (1 << 15) + SHINGLE - 1]
        hashes = np.fromiter((xxh64_intdigest(b"%b %b %b" % t, SEED) for t in zip(part, part[1:], part[2:])), dtype=np.uint64, count=len(part) - SHINGLE + 1)
        counts += _ones(hashes)
    return _majority(counts, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds fp, the fingerprint's 64 bits as a signed long. A null text is an empty one: fingerprint 0."""
    keep = [c for c in df.columns if c != "fp"] if keep is None else keep
    there = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch.column("__text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found)], names=[*keep, "fp"])

    return there.mapInArrow(run, T.StructType([f for f in there.schema.fields if f.name != "__text"]).add("fp", T.LongType()))


def _stratum(fp: Column) -> Column:
    """The four population counts in one int."""
    return sum((F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(0xFFFF)).cast("int") * 32**k for k in range(PARTS)), F.lit(0)).cast("int")


def _steps(radius: int) -> list[int]:
    """How far partner strata are from a stratum, by their population counts: of each pair of strata one direction."""
    found = [s for s in product(range(-radius, radius + 1), repeat=PARTS) if 0 < sum(map(abs, s)) <= radius]
    return [sum(x * 32**k for k, x in enumerate(s)) for s in found if s > tuple(-x for x in s)]


def meet(home: np.ndarray, other: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (of home, of other) of rows of words that differ in at most radius bits; same: other is home, pairs come once.

    Both are taken in the order of their population counts, so a block of one meets only the rows of the other whose
    counts are within the radius.
    """
    ones, others = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (home, other))
    order, orders = np.argsort(ones, kind="stable"), np.argsort(others, kind="stable")
    home, ones, other, others = home[order], ones[order], other[orders], others[orders]
    step = max(1, (1 << 17) // max(1, len(other)))
    for at in range(0, len(home), step):
        end = min(at + step, len(home))
        first, last = np.searchsorted(others, ones[at] - radius), np.searchsorted(others, ones[end - 1] + radius, side="right")
        first = max(first, at) if same else first
        if first >= last:
            continue
        far = np.bitwise_count(home[at:end, None, 0] ^ other[None, first:last, 0])
        for k in range(1, home.shape[1]):
            far = far + np.bitwise_count(home[at:end, None, k] ^ other[None, first:last, k])
        a, b = np.nonzero(far <= radius)
        a, b = a + at, b + first
        if same:
            a, b = a[a < b], b[a < b]
        yield order[a], orders[b]


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, steps: list[int] | None = None, homes: int = 1) -> DataFrame:
    """Edges (u, v), a written table, between nodes that join all those whose words differ in radius or fewer bits.

    nodes: node (long), words (array of longs), s (stratum), or fp alone (then node and word, with the strata of its
    parts). steps: the partner strata of a stratum, as differences of s, one direction of each pair. homes: how many
    tiles are the home of one task.
    """
    if "fp" in nodes.columns:
        nodes, steps = nodes.select(F.col("fp").alias("node"), F.array("fp").alias("words"), _stratum(F.col("fp")).alias("s")), _steps(radius)
    # Strata are bounded in number, whatever the input (17**4 by parts): small enough to send everywhere.
    tiles = nodes.groupBy("s").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    most = tiles.agg(F.max("tiles")).first()[0] or 1
    cut = nodes.join(F.broadcast(tiles), "s").withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # A row for each tile: node and words of its members one after another.
    held = written(cut.groupBy("s", "t", "tiles").agg(F.count("*").alias("n"), F.flatten(F.collect_list(F.concat(F.array("node"), "words"))).alias("members")), "tiles")
    # Task (s, home, part) compares the tiles of which t div homes is home with those tiles t of its own (t div homes > home) and the partner strata of which t div TILES is part.
    at = F.expr(f"cast(t div {homes} as int)")
    own = held.select("s", F.explode(F.sequence(F.lit(0), at)).alias("home"), F.floor(F.col("t") / TILES).cast("int").alias("part"), at.alias("at"), "n", "members")
    own = own.select("s", "home", "part", (F.col("at") == F.col("home")).alias("here"), "n", "members")
    # The home tiles themselves also go to the tasks of their other parts.
    again = F.expr(f"filter(sequence(0, {(most - 1) // TILES}), p -> p != t div {TILES})")
    more = held.select("s", at.alias("home"), F.explode(again).alias("part"), F.lit(True).alias("here"), "n", "members")
    probes = held.select(F.explode(F.array(*[F.col("s") + F.lit(d) for d in steps])).alias("s"), F.floor(F.col("t") / TILES).cast("int").alias("part"), "n", "members") if steps else None
    rows = own.unionByName(more.select(own.columns))
    if steps:
        probes = probes.join(F.broadcast(tiles), "s").select("s", F.explode(F.expr(f"sequence(0, cast((tiles - 1) div {homes} as int))")).alias("home"), "part", F.lit(False).alias("here"), "n", "members")
        rows = rows.unionByName(probes)

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        here = group["here"].to_numpy()
        parts = [np.asarray(m).reshape(n, -1) for m, n in zip(group["members"], group["n"], strict=True)]
        # Home tiles come in each of their tasks; they are compared with themselves in the one that has the part of the first.
        mine, guests = [p for p, h in zip(parts, here, strict=True) if h], [p for p, h in zip(parts, here, strict=True) if not h]
        if not mine:
            return pd.DataFrame({"u": [], "v": []}, dtype=np.int64)
        every = np.concatenate([*mine, *guests])
        starts = np.cumsum([sum(map(len, mine)), *map(len, guests)])

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            home = every[: starts[0], 1:].view(np.uint64)
            if key[2] == key[1] * homes // TILES:
                yield from meet(home, home, radius, True)
            for at, guest in zip(starts, guests, strict=False):
                for a, b in meet(home, guest[:, 1:].view(np.uint64), radius, False):
                    yield a, b + at

        tree = np.array(forest(len(every), pairs()), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": every[tree[:, 0], 0], "v": every[tree[:, 1], 0]})

    edges = written(rows.groupBy("s", "home", "part").applyInPandas(compare, "u long, v long"), "links")
    drop_table(held)
    return edges


def _joined(edges: DataFrame) -> DataFrame:
    found = components(edges)
    drop_table(edges)
    return found


def _classes(rows: DataFrame, key: str, radius: int, tile: int) -> DataFrame:
    """(fp, least, root) for each distinct fingerprint: its least key and the least fingerprint that can be reached."""
    nodes = written(rows.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    found = _joined(links(nodes.select("fp"), radius, tile))
    return nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(key, fp, component_id): component_id is the least key of the texts that can be reached by links.

    Every row of the input has a row in the result, repeated keys included. A null key is passed over as a least one: a
    component of null keys alone has component_id null. Empty and null texts have fingerprint 0 and are linked as any
    other. Long texts are read whole, in blocks.
    """
    rows = written(fingerprints(df, text, keep=[key]), "fingerprints")
    linked = _classes(rows, key, radius, tile)
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    # A written table, so that both sides of the join are plain exchanges and the copies of one text can be split.
    ids = written(linked.join(least, "root").select("fp", "component_id"), "classes")
    return rows.join(ids, "fp").select(key, "fp", "component_id")


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the text's distinct 5-word shingles, sorted. A text of fewer words has one, a text without words none."""
    words = text.lower().split()
    if len(words) <= SHINGLE_WORDS:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    n = len(words) - SHINGLE_WORDS + 1
    return np.unique(np.fromiter((xxh64_intdigest(b"%b %b %b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:], words[3:], words[4:])), dtype=np.uint64, count=n))


def set_fingerprint(hashes: np.ndarray) -> list[int]:
    """WORDS words of bits that most of a set's hashes have, the later words from the hashes mixed anew; zeros for an empty set."""
    out = []
    for _ in range(WORDS):
        counts = sum((_ones(hashes[at : at + (1 << 15)]) for at in range(0, len(hashes), 1 << 15)), np.zeros(BITS, dtype=np.int64))
        out.append(_majority(counts, len(hashes)))
        hashes = (hashes ^ hashes >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
        hashes = hashes ^ hashes >> np.uint64(29)
    return out


def _signed(df: DataFrame) -> DataFrame:
    """__key, __same, node (a hash of the shingle set), words and size of rows (__key, __same, __text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingles(x.as_py()) for x in batch.column("__text"))
            made = [(xxh64_intdigest(s.tobytes(), SEED), set_fingerprint(s), len(s)) for s in sets]
            node = np.array([n for n, _, _ in made], dtype=np.uint64).view(np.int64)
            words = np.array([w for _, w, _ in made], dtype=np.uint64).view(np.int64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, WORDS, dtype=np.int32)), pa.array(words))
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("__same"), pa.array(node), lists, pa.array([n for _, _, n in made], pa.int32())], names=["__key", "__same", "node", "words", "size"])

    kept = [f for f in df.schema.fields if f.name != "__text"]
    return df.mapInArrow(run, T.StructType(kept).add("node", T.LongType()).add("words", T.ArrayType(T.LongType())).add("size", T.IntegerType()))


def similar(sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (as arrays of first and second) of the sets at the similarity, by the places where each shingle occurs."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner, (_, code) = np.repeat(np.arange(len(sets)), sizes), np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    held, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    for i, end in enumerate(np.cumsum(sizes)):
        mine = code[end - sizes[i] : end]
        n = starts[mine + 1] - starts[mine]
        places = np.repeat(starts[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(held[places], minlength=len(sets))
        # shared / (a + b - shared) >= PART / WHOLE, in whole numbers.
        other = np.flatnonzero((shared > 0) & ((PART + WHOLE) * shared >= PART * (sizes + sizes[i])))
        other = other[other > i]
        yield np.full(len(other), i), other


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    group = group.drop_duplicates("node")
    node = group["node"].to_numpy()
    edges = np.array(forest(len(node), similar([shingles(t) for t in group["text"]])), dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame({"u": node[edges[:, 0]], "v": node[edges[:, 1]]})


def _marked(df: DataFrame, told: Column, rows: DataFrame) -> DataFrame:
    """Adds __marked: true where rows (__key, __same) has what told hashes to, and for a few more; told: the hash of df's key and text hash.

    One bit of each row's hash, in MARKS words at most, goes to every task, whatever the input. Rows beyond what these
    can hold mark more of df, up to all of it: none is lost, but less is spared of the exchange that follows.
    """
    words = min(MARKS, 1 << max(0, (rows.count() * SPARSE // 64).bit_length()))
    word, bit = lambda h: F.pmod(h, F.lit(words)), lambda h: F.shiftrightunsigned(h, 58).cast("int")
    h = F.xxhash64("__key", "__same")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(h))
    marks = rows.select(word(h).alias("__word"), one.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    there = F.call_function("shiftright", F.col("__bits"), bit(told)).bitwiseAND(1) == 1
    return df.join(F.broadcast(marks), word(told) == F.col("__word"), "left").withColumn("__marked", F.coalesce(there, F.lit(False))).drop("__word", "__bits")


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = NEAR, tile: int = TILE, compared: int = COMPARED) -> DataFrame:
    """One row of each component of texts whose 5-word shingle sets have a similarity of 0.8 or more.

    Fingerprints of 256 bits of the sets are compared in tiles, by classes of set size; they only propose. Texts proposed
    together, along chains, are then compared by their exact sets, in tiles of about compared texts, and only pairs at the
    similarity are linked. Texts without words are copies of each other; a null text is an empty one.

    The row that stays is that of the least key (nulls last), and of the least text hash if several have it. Rows that
    repeat key and text are told apart only where there are any. Columns of any name stay. Texts are not exchanged as a
    whole: only those of proposed groups, to be joined and once for each of their group's tiles, and those of rows that
    go, each with the few others that share a mark with them.
    """
    same = F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    raw = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    rows = written(_signed(df.select(F.col(f"`{key}`").alias("__key"), same.alias("__same"), raw.alias("__text"))), "signatures")
    first = F.min(F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("key"), F.col("__same").alias("same"))).alias("first")
    nodes = written(rows.groupBy("node").agg(F.first("words").alias("words"), F.first("size").alias("size"), first), "nodes")
    classes = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / math.log(CLASS)).cast("int")
    found = _joined(links(nodes.select("node", "words", classes.alias("s")), radius, tile, steps=[1], homes=HOMES))
    near = written(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "groups")
    # One text of each node goes to the tiles of its group.
    tiles = near.groupBy("root").agg(F.ceil(F.count("*") / compared).cast("int").alias("tiles"))
    asked = near.join(tiles, "root").join(nodes.select("node", "first"), "node")
    asked = written(asked.select("node", "root", "tiles", F.pmod(F.xxhash64("node"), "tiles").cast("int").alias("tile"), F.col("first.key").alias("__asked"), F.col("first.same").alias("__as")), "asked")
    plain = rows.groupBy("__key", "__same").count().filter("count > 1").isEmpty()
    # By key and text: of many copies of a text one row is joined, not all. By merge, whatever the size: one plan, whose exchanges follow the input.
    told = F.xxhash64(F.col(f"`{key}`"), same)
    texts = _marked(df, told, asked.select(F.col("__asked").alias("__key"), F.col("__as").alias("__same"))).filter("__marked")
    texts = texts.select(F.col(f"`{key}`").alias("__key"), same.alias("__same"), raw.alias("text")).join(asked.hint("merge"), F.col("__key").eqNullSafe(F.col("__asked")) & (F.col("__same") == F.col("__as")))
    texts = texts if plain else texts.dropDuplicates(["node"])
    dealt = texts.select("node", "text", "root", "tile", F.explode(F.expr("sequence(0, tiles - 1)")).alias("t"))
    dealt = dealt.select("node", "text", "root", F.least("tile", "t").alias("one"), F.greatest("tile", "t").alias("other"))
    linked = components(dealt.groupBy("root", "one", "other").applyInPandas(_compare, "u long, v long"))
    roots = nodes.select("node").join(linked.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("node", F.coalesce("root", "node").alias("root"))
    # Rows of a node are reduced before the join, so copies are not joined one by one.
    least = nodes.select("node", "first").join(roots, "node").groupBy("root").agg(F.min("first").alias("first"))
    chosen = written(least.select(F.col("first.key").alias("__key"), F.col("first.same").alias("__same")), "chosen")
    match = rows["__key"].eqNullSafe(chosen["__key"]) & (rows["__same"] == chosen["__same"])
    gone = written(rows.select("__key", "__same").join(chosen, match, "left_anti").distinct(), "gone")
    # Only rows with a mark are exchanged: all that go, and all that repeat key and text.
    marked = gone if plain else written(gone.unionByName(rows.groupBy("__key", "__same").count().filter("count > 1").select("__key", "__same")), "marked")
    held = _marked(df, told, marked)
    for done in (rows, nodes, near, asked, chosen):
        drop_table(done)
    doubt = held.filter("__marked").withColumn("__is", same).join(gone.hint("merge"), F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.col("__is") == F.col("__same")), "left_anti")
    doubt = doubt if plain else doubt.dropDuplicates([key, "__is"])
    return held.filter("not __marked").select(*[F.col(f"`{c}`") for c in df.columns]).unionByName(doubt.select(*[F.col(f"`{c}`") for c in df.columns]))
