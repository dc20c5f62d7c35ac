"""Near-duplicate documents by SimHash fingerprints and vantage-point trees.

1. Fingerprint: one bit per hash bit, set where over half of the shingle hashes set it.
2. Forest: the 64 bits are cut into ``blocks`` parts. Fingerprints that differ in at most
   ``radius`` bits agree wholly on at least ``blocks - radius`` parts. There is a tree for each
   choice of so many parts. Its first level splits by the distance measured on these parts alone
   (a metric of its own, in which a wanted pair is at distance 0, so the triangle bound leaves
   no overlap between shards); below that, a shard is a vantage-point tree over all 64 bits with
   boundary overlaps (``vptree``). A plain tree over 64 bits would have to visit seven tenths of
   both sides at every split, as distances between unrelated fingerprints crowd about 32.
3. Links found are reduced to a spanning set per shard and task, then joined up by ``components``.

Equal fingerprints are one point from the start, so copies never meet each other. Every pair
within the radius is found: nothing is capped or sampled.

Edge cases. Null and wordless texts have fingerprint zero and are linked like any other. Fewer
words than a shingle make one shingle. Null ids take part; the component's id is the smallest
id that is not null, null if there is none. Repeated rows give a row each.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from ..session import settle
from .components import components
from .registry import query, table
from .vptree import LEAF, connected, distance, roots

SHINGLE = 4
RADIUS = 4
BLOCKS = 6
SEED = 42

# Lower-cases A-Z in UTF-8 bytes.
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, as an unsigned number."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) < size:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        starts = [0, *ends]
        hashes = [xxh64_intdigest(joined[i : j - 1], SEED) for i, j in zip(starts, ends[size - 1 :])]
    numbers = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(numbers), 1 << 15):
        octets = numbers[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(numbers), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[Column], text: Column, size: int = SHINGLE) -> DataFrame:
    """``keep`` and ``fp`` (the fingerprint's bits as a signed long), one row per row."""

    def each(column: pa.Array) -> pa.Array:
        values: list[int] = []
        for at in range(0, len(column), 256):
            values += [fingerprint(t, size) for t in column.slice(at, 256).to_pylist()]
        return pa.array(np.array(values, dtype=np.uint64).view(np.int64))

    each.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return docs.select(*keep, F.arrow_udf(each, "bigint")(text).alias("fp"))


def masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """One bit mask per choice of ``blocks - radius`` parts of the 64 bits, as signed longs."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    whole = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in whole]


def _shards(batches, radius: int):
    """Links within each run of equal (tree, cell); a run that reaches over batches is kept whole."""

    def found(tree, cell, fp):
        new = np.flatnonzero((tree[1:] != tree[:-1]) | (cell[1:] != cell[:-1])) + 1
        starts = np.concatenate([[0], new])
        sizes = np.diff(np.concatenate([starts, [len(fp)]]))
        run = np.repeat(np.arange(len(starts)), sizes)
        points = fp.view(np.uint64)
        # Short runs: compare each point with its 1st, 2nd, ... successor of the same run.
        here = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= LEAF), sizes))
        by = 1
        while len(here):
            here = here[here + by < len(fp)]
            here = here[run[here] == run[here + by]]
            close = here[distance(points[here], points[here + by]) <= radius]
            yield fp[close], fp[close + by]
            by += 1
        for at in np.flatnonzero(sizes > LEAF):
            part = slice(starts[at], starts[at] + sizes[at])
            root = connected(points[part], radius)
            own = np.flatnonzero(root != np.arange(len(root)))
            yield fp[part][own], fp[part][root[own]]

    def rows(columns):
        a, b = (np.concatenate(x) for x in zip(*found(*columns), (np.zeros(0, np.int64),) * 2))
        if len(a):
            # A spanning set of what this piece found.
            nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
            star = roots(len(nodes), ends[: len(a)], ends[len(a) :])
            own = np.flatnonzero(star != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[star[own]])], names=["a", "b"])

    held = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        tree, cell, _ = columns
        last = np.flatnonzero((tree != tree[-1]) | (cell != cell[-1]))
        cut = last[-1] + 1 if len(last) else 0
        held = [c[cut:] for c in columns]
        if cut:
            yield from rows([c[:cut] for c in columns])
    if held is not None:
        yield from rows(held)


def links(points: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """A spanning set (``a``, ``b``) of the pairs of distinct ``fp`` within ``radius`` bits.

    Cells with one point are dropped before the rows are sorted.
    """
    cells = F.array(*(F.struct(F.lit(t).alias("tree"), F.col("fp").bitwiseAND(F.lit(m)).alias("cell")) for t, m in enumerate(masks(blocks, radius))))
    placed = points.select("fp", F.explode(cells).alias("c")).select("c.tree", "c.cell", "fp")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = placed.repartition(n, "tree", "cell").sortWithinPartitions("tree", "cell", "fp")
    return sorted_.mapInArrow(lambda batches: _shards(batches, radius), "a long, b long")


def grouped(prints: DataFrame, ids: str, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``fp`` and ``component_id`` (smallest id reachable) for every distinct fingerprint."""
    points = prints.groupBy("fp").agg(F.min(ids).alias("_least"))
    found = components(links(points.select("fp"), radius, blocks))
    placed = points.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("_least").alias("component_id"))
    return placed.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """``ids``, ``fp`` and ``component_id``, one row per row of ``docs``."""
    prints = settle(fingerprints(docs, [F.col(ids)], F.col(text)))
    return prints.join(grouped(prints, ids), "fp").select(ids, "fp", "component_id")


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def kept_documents(docs: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: the first by id, then by text; all columns, nothing else.

    The choice is made on narrow rows (id, 128 bits of id and text, fingerprint) and joined back.
    Of rows that agree in id and text one stays, the first by a hash of the whole row.
    """
    key = [F.xxhash64(F.col(ids)).alias("_a"), F.xxhash64(F.col(text)).alias("_b")]
    whole = docs.select(F.struct("*").alias("_row"), *key)
    prints = settle(fingerprints(docs, [F.col(ids).alias("_id"), *key], F.col(text)))
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_b"))
    chosen = prints.join(grouped(prints, "_id"), "fp").groupBy("root").agg(F.min_by(F.struct("_a", "_b"), order).alias("m"))
    met = whole.join(chosen.select("m._a", "m._b"), ["_a", "_b"], "left_semi")
    first = Window.partitionBy("_a", "_b").orderBy(F.xxhash64("_row"))
    return met.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("_row.*")


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark, sf_dir):
    """Every document with its fingerprint and component."""
    done = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")
