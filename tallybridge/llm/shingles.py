"""Near-duplicate documents by the likeness of their word shingles.

Two texts are linked if the distinct runs of ``SIZE`` words they share are at least ``LIKE`` of
those either has (Jaccard). Every such pair is found, and no other is linked:

1. Candidates. Of a text with n shingles, n - ceil(0.8 n) + 1 come first in an order that is the
   same for all texts; two texts that are alike share one of these (prefix filter), which in the
   smaller text is one of its first n - ceil(8/9 n) + 1. A shingle whose two texts cannot be alike
   by that or by their sizes is no bucket: such chance meetings grow with the square of the texts. The order
   puts shingles that are frequent in a sample last, so that what many texts share is seldom
   among them. The sample only decides how many candidates there are.
2. Links within ``RADIUS`` bits by SimHash are candidates too: they join most of a large group
   before its texts are compared pair by pair.
3. Candidates are cut by an exact bound first: a sketch of a text has a bit for each shingle's hash,
   and every bit that one text has and the other has not is a shingle they do not share. Sketches
   are a sixteenth of the sets, so only texts of pairs that pass are moved and made into sets.
4. Each pair that is left is checked on the whole shingle sets. Texts that are already in one component
   are not compared again. In a bucket of many pairs of unconnected texts each text meets
   one pivot first; buckets of few pairs, and what the pivots leave, meet pair by pair.

Edge cases. Words are those of ``simhash``, A-Z in lower case. Fewer words than a shingle make one
shingle. Null and wordless texts are one text. Equal texts are one point from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from ..session import settle
from . import simhash
from .components import components
from .shared import SLICE, WORDED, Remembered, stored

SIZE = 5
# Likeness at which texts are linked, as a fraction.
OVER, UNDER = 4, 5
# Rounds of pivots at most, and the pairs per row of a bucket above which a round is worth it.
ROUNDS, DENSE = 2, 4
# Texts in the sample, texts that make a shingle frequent in it, and frequent shingles told apart.
SAMPLE, FREQUENT, TOLD = 1 << 14, 4, 1 << 15
# Pairs of one text that are checked in one task.
TILE = 256

_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]


def _word(word: bytes) -> int:
    return xxh64_intdigest(word, simhash.SEED)


def shingles(text: str | None, word=_word) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit numbers."""
    words = (text or "").encode().translate(simhash._LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < SIZE:
        return np.array([_word(b" ".join(words))], np.uint64).view(np.int64)
    hashes = np.fromiter(map(word, words), np.uint64, len(words))
    n = len(words) - SIZE + 1
    mixed = np.zeros(n, np.uint64)
    for i, factor in enumerate(_FACTORS):
        mixed += hashes[i : i + n] * np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def _sets(column: pa.Array):
    remembered = Remembered(_word, 1 << 16).__getitem__
    for at in range(0, len(column), SLICE):
        for text in column.slice(at, SLICE).to_pylist():
            yield shingles(text, remembered)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))


def shingle_sets(text: Column) -> Column:
    def each(column: pa.Array) -> pa.Array:
        return _lists(list(_sets(column)))

    each.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "array<bigint>")(text)


def sketch(shingle_set: np.ndarray) -> bytes:
    """One bit per shingle, by the low bits of its hash, in the first power of two above four bits a shingle."""
    bits = max(64, 1 << (4 * len(shingle_set) - 1).bit_length())
    flags = np.zeros(bits, bool)
    flags[shingle_set & (bits - 1)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def can_be_alike(a: bytes, b: bytes, n: int, m: int) -> bool:
    """Whether two sets of ``n`` and ``m`` shingles may be alike, as far as their sketches tell."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    # The low bits of a longer one are those of a shorter one.
    x, y = (np.bitwise_or.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    shared = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return UNDER * shared >= OVER * (n + m - shared)


def features(text: Column, frequent: np.ndarray) -> Column:
    """``n`` (distinct shingles), ``prefix`` and ``sketch``; ``frequent`` lists shingles, the rarer first."""
    by_value = np.argsort(frequent)
    values = frequent[by_value]

    def each(column: pa.Array) -> pa.Array:
        sizes, firsts, sketches = [], [], []
        for s in _sets(column):
            rank = np.zeros(len(s), np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                rank = np.where(values[at] == s, by_value[at] + 1, 0)
            sizes.append(len(s))
            firsts.append(s[np.lexsort((s, rank))][: len(s) - -(-OVER * len(s) // UNDER) + 1])
            sketches.append(sketch(s))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), _lists(firsts), pa.array(sketches, pa.binary())], names=["n", "prefix", "sketch"])

    each.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "struct<n:int,prefix:array<bigint>,sketch:binary>")(text)


def frequent_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """The most frequent shingles of a sample of the distinct texts, the rarer first."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    sample = docs.select(F.col(text).alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < int(share * (1 << 20))).distinct()
    held = sample.select(F.explode(shingle_sets(F.col("t"))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    often = settle(held.filter(F.col("c") >= FREQUENT))
    # The count from which on there are TOLD at most, so that no more than these reach the driver.
    room, least = TOLD, None
    for row in sorted(often.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.c):
        room -= row.n
        if room < 0:
            break
        least = row.c
    if least is None:
        return np.zeros(0, np.int64)
    top = often.filter(F.col("c") >= least).toArrow()
    values, counts = top["h"].to_numpy(), top["c"].to_numpy()
    return values[np.lexsort((values, counts))]


def _side_by_side(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) with each side's ``fact`` (``x``, ``y``). A text with many pairs meets them in tiles."""
    tiles = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("k")))
    left = facts.join(tiles, facts["node"] == tiles["a"]).select("a", F.col("fact").alias("x"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("tile"))
    right = pairs.join(tiles, "a").select("a", "b", F.pmod(F.xxhash64("b"), "k").alias("tile")).join(facts.select(F.col("node").alias("b"), F.col("fact").alias("y")), "b")
    return right.join(left, ["a", "tile"])


def _possible(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Those of the pairs that may be alike by their sketches."""

    def each(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        return pa.array([can_be_alike(*row) for row in zip(*(c.to_pylist() for c in (a, b, n, m)))], pa.bool_())

    each.__annotations__ = {**dict.fromkeys("abnm", pa.Array), "return": pa.Array}
    met = _side_by_side(pairs, points.select("node", F.struct("n", "sketch").alias("fact")))
    return met.filter(F.arrow_udf(each, "boolean")(F.col("x.sketch"), F.col("y.sketch"), F.col("x.n"), F.col("y.n"))).select("a", "b")


def _alike(pairs: DataFrame, points: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs that are alike, by whole sets."""
    pairs = settle(_possible(pairs, points))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # One copy of each text is read.
    keys = stored(points.select("node", "copy").join(wanted, "node"))
    own = texts.join(keys, ["node", "copy"]).groupBy("node").agg(F.first("text").alias("text"))
    sets = settle(own.select("node", shingle_sets(F.col("text")).alias("fact")))
    shared = F.size(F.array_intersect("x", "y"))
    met = _side_by_side(pairs, sets).select("a", "b", shared.alias("s"), (F.size("x") + F.size("y")).alias("t"))
    return settle(met.filter(UNDER * F.col("s") >= OVER * (F.col("t") - F.col("s"))).select("a", "b"))


def _pairs(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _near(n: Column, m: Column) -> Column:
    return UNDER * F.least(n, m) >= OVER * F.greatest(n, m)


def _ahead(n: Column, at: Column) -> Column:
    """Whether a shingle comes so early in a text of ``n`` that it can be the first one shared with a larger one."""
    return (OVER + UNDER) * (n - at) >= 2 * OVER * n


def _buckets(points: DataFrame) -> DataFrame:
    """``h``, ``node``, ``n``, ``ahead``: the first shingles of texts, without those that can link nothing."""
    rows = points.select("node", "n", F.posexplode("prefix").alias("at", "h")).select("h", "node", "n", _ahead(F.col("n"), F.col("at")).alias("ahead"))
    # Size and place in one number, by size first.
    both = F.col("n") * 2 + F.col("ahead").cast("int")
    held = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(both).alias("low"), F.max(both).alias("high")).filter("c > 1")
    small, large = F.shiftright("low", 1), F.shiftright("high", 1)
    first = (F.col("low") % 2 == 1) | ((small == large) & (F.col("high") % 2 == 1))
    often = held.filter((F.col("c") > 2) | (first & _near(small, large))).select("h")
    return rows.join(stored(often), "h")


def grouped(points: DataFrame, texts: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every text that has a link.

    ``points``: one row per text, ``node``, ``copy`` (which of its rows), ``fp``, ``n``, ``prefix``, ``sketch``.
    ``texts``: ``node``, ``copy``, ``text``, repeated as it may be.
    """
    buckets = settle(_buckets(points))
    prints = points.select("fp", "node")
    ends = prints.groupBy("fp").agg(F.min("node").alias("least"))
    equal = prints.join(ends, "fp").filter("node != least").select(*_pairs(F.col("node"), F.col("least")))
    spans = simhash.links(ends.select("fp"))
    one, two = ends.toDF("a", "x"), ends.toDF("b", "y")
    pairs = equal.unionByName(spans.join(one, "a").join(two, "b").select(*_pairs(F.col("x"), F.col("y"))))
    sizes = points.select("node", "n")
    low, high = sizes.toDF("a", "na"), sizes.toDF("b", "nb")
    pairs = settle(pairs.join(low, "a").join(high, "b").filter(_near(F.col("na"), F.col("nb"))).select("a", "b").distinct())
    links = _alike(pairs, points, texts)
    for turn in range(ROUNDS + 1):
        found = components(links)
        placed = settle(buckets.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))
        # Buckets that are one component are done.
        several = placed.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(
            F.count(F.lit(1)).alias("roots"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("same"),
            F.min_by("root", F.xxhash64(F.lit(turn), "root")).alias("pivot_root"),
        ).filter("roots > 1")
        dense = F.lit(turn < ROUNDS) & (F.col("c") * F.col("c") - F.col("same") > 2 * DENSE * F.col("c"))
        open_ = settle(placed.join(stored(several.select("h", "pivot_root", dense.alias("dense"))), "h"))
        kinds = {row.dense for row in open_.select("dense").distinct().collect()}
        if not kinds:
            return found
        few = open_.filter(~F.col("dense"))
        x, y = few.select("h", *(F.col(c).alias(f"{c}_x") for c in ("node", "n", "ahead", "root"))), few.select("h", *(F.col(c).alias(f"{c}_y") for c in ("node", "n", "ahead", "root")))
        apart = (F.col("node_x") < F.col("node_y")) & (F.col("root_x") != F.col("root_y")) & _near(F.col("n_x"), F.col("n_y"))
        first = F.when(F.col("n_x") < F.col("n_y"), F.col("ahead_x")).when(F.col("n_x") > F.col("n_y"), F.col("ahead_y")).otherwise(F.col("ahead_x") & F.col("ahead_y"))
        pairs = x.join(y, "h").filter(apart & first).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))
        if True in kinds:
            buckets = open_.filter("dense").select("h", "node", "n", "ahead", "root", "pivot_root")
            mine = F.struct("node", "n", "root")
            pivots = stored(buckets.filter("root = pivot_root").groupBy("h").agg(F.min_by(mine, F.xxhash64(F.lit(turn), "node")).alias("p")))
            met = buckets.join(pivots, "h").filter((F.col("root") != F.col("p.root")) & _near(F.col("n"), F.col("p.n")))
            # The pivot is side a, whose tiles spread its pairs.
            pairs = pairs.unionByName(met.select(F.col("p.node").alias("a"), F.col("node").alias("b")))
            buckets = buckets.select("h", "node", "n", "ahead")
        links = settle(links.unionByName(_alike(settle(pairs.distinct()), points, texts)))
        if True not in kinds:
            return components(links)


def kept_documents(docs: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: the first by id, then by text; all columns, nothing else.

    The choice is made on narrow rows (id, 128 bits of id and text, node) and joined back.
    Of rows that agree in id and text one stays, the first by a hash of the whole row.
    """
    key = [F.xxhash64(F.col(ids)).alias("_a"), F.xxhash64(F.col(text)).alias("_b")]
    named = F.when(F.coalesce(F.col(text).rlike(WORDED), F.lit(False)), F.xxhash64(F.col(text))).otherwise(F.lit(0).cast("bigint"))
    prints = settle(docs.select(F.col(ids).alias("_id"), *key, named.alias("node")))
    read = docs.select(named.alias("node"), F.xxhash64(F.col(ids)).alias("copy"), F.col(text).alias("text"))
    worded = read.filter("node != 0")
    found = simhash.fingerprints(worded, [F.col("node"), F.col("copy"), features(F.col("text"), frequent_shingles(docs, text)).alias("_p")], F.col("text"))
    points = settle(found.select("node", "copy", "fp", "_p.n", "_p.prefix", "_p.sketch").dropDuplicates(["node"]))
    found = grouped(points, worded)
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_b"))
    narrow = prints.select("_id", "_a", "_b", "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    chosen = narrow.groupBy("root").agg(F.min_by(F.struct("_a", "_b"), order).alias("m"))
    whole = docs.select(F.struct("*").alias("_row"), *key)
    met = whole.join(chosen.select("m._a", "m._b"), ["_a", "_b"], "left_semi")
    first = Window.partitionBy("_a", "_b").orderBy(F.xxhash64("_row"))
    return met.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("_row.*")
