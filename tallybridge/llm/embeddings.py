"""Near-duplicate embeddings by spherical-cap filters.

1. Equal vectors are one point, so copies never meet each other.
2. A unit vector is turned at random and cut into blocks; each block has its own random unit
   directions, and a filter is one direction per block (a structured product code: many filters
   from few directions, as many as give a vector ``hits`` filters on average). A vector belongs
   to every filter whose score exceeds ``threshold`` standard deviations. List decoding finds
   them without scoring all filters: directions that cannot reach the threshold even with the
   best of the other blocks are left out. There are ``codes`` such codes, each turned its own
   way, as a single one leaves some vectors without any filter.
3. Vectors meet in the filters they share. Every pair is counted once, in the first filter the
   two have in common, and verified by cosine in double precision.
4. A filter with more rows than ``tile`` is cut into tiles; each two tiles meet in a task of
   their own, so memory is bounded by two tiles whatever the group.

What comes out of a task is a link count per vector and a spanning set of its links, not all
pairs. Two vectors at the limit share several filters on average, so few links are missed; a
pair's chance depends on its angle alone, not on how many rows there are.

Edge cases. Null, empty and zero vectors, and vectors with null or non-finite components, link
with nothing and are components of their own. Vectors of different lengths never link. Repeated
rows are rows of their own, linked with each other. A null id takes part; the component's id is
its smallest id. Labels and other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .components import components
from .registry import query, table
from .shared import stored
from .vptree import roots

LIMIT = 0.9
CODES = 16
BLOCKS = 2
HITS = 3
THRESHOLD = 3.0
# A cap is never narrower than this cosine, however few components a vector has.
NARROWEST = 0.6
TILE = 1024
SEED = 42
# Filters of vectors of different widths are different filters: width * WIDTHS + number.
WIDTHS = 1 << 40


def cap(width: int, threshold: float) -> float:
    """The least cosine between a vector and the filters it belongs to."""
    return min(threshold / np.sqrt(width), NARROWEST)


def per_block(width: int, blocks: int, threshold: float, hits: int) -> int:
    """Directions per block for ``hits`` filters per vector on average: hits over a cap's share of the sphere."""
    if width < 2:
        return hits
    angles = np.linspace(0, np.pi, 20_001)
    density = np.sin(angles) ** (width - 2)
    share = density[angles <= np.arccos(cap(width, threshold))].sum() / density.sum()
    return int(np.ceil((hits / share) ** (1 / min(blocks, width))))


class Code(NamedTuple):
    """A rotation of the space and, per block of the rotated vector, a matrix of unit directions."""

    turn: np.ndarray
    books: list[np.ndarray]


@lru_cache(maxsize=8)
def product_codes(width: int, codes: int, blocks: int, threshold: float, hits: int, seed: int) -> list[Code]:
    """``codes`` independent random product codes; fewer blocks where the vector is shorter."""
    n, found = per_block(width, blocks, threshold, hits), []
    for number in range(codes):
        rng = np.random.default_rng([seed, width, number])
        turn, _ = np.linalg.qr(rng.standard_normal((width, width)))
        books = []
        for part in np.array_split(np.arange(width), min(blocks, width)):
            rows = rng.standard_normal((n, len(part)))
            books.append(rows / np.linalg.norm(rows, axis=1, keepdims=True))
        found.append(Code(turn, books))
    return found


def decode(units: np.ndarray, books: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for every filter within cosine ``least`` of a row, by row and filter."""
    n, per_block = len(units), len(books[0])
    cuts = np.cumsum([0, *(b.shape[1] for b in books)])
    scores = [units[:, lo:hi] @ b.T for lo, hi, b in zip(cuts, cuts[1:], books)]
    wanted = least * np.sqrt(len(books))
    best = np.array([s.max(axis=1) for s in scores])
    after = best[::-1].cumsum(axis=0)[::-1] - best
    row, code, score = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
    for k, s in enumerate(scores):
        # Prefixes that can still reach the threshold with the best of the later blocks.
        keep_row, keep_code, keep_score = [row[:0]], [code[:0]], [score[:0]]
        for at in range(0, len(row), 4096):
            r = row[at : at + 4096]
            sums = score[at : at + 4096, None] + s[r]
            i, j = np.nonzero(sums + after[k][r][:, None] >= wanted)
            keep_row.append(r[i])
            keep_code.append(code[at : at + 4096][i] * per_block + j)
            keep_score.append(sums[i, j])
        row, code, score = (np.concatenate(x) for x in (keep_row, keep_code, keep_score))
    order = np.lexsort((code, row))
    return row[order], code[order]


def _decoded(batches, options: tuple):
    """Adds to (gid, vector) the ordered list of its filters, numbered through all codes."""
    codes, blocks, hits, threshold, seed = options
    for batch in batches:
        gids, vectors = batch.column(0), batch.column(1)
        widths = np.diff(vectors.offsets.to_numpy())
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate([[0], widths.cumsum()])
        for width in map(int, np.unique(widths)):
            chosen = np.flatnonzero(widths == width)
            every, least = product_codes(width, codes, blocks, threshold, hits, seed), cap(width, threshold)
            for at in range(0, len(chosen), 2048):
                part = chosen[at : at + 2048]
                rows = values[starts[part][:, None] + np.arange(width)]
                units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
                row, filter_ = [], []
                for number, code in enumerate(every):
                    r, f = decode(units @ code.turn, code.books, least)
                    row.append(r)
                    filter_.append(f + number * len(code.books[0]) ** len(code.books))
                row, filter_ = np.concatenate(row), np.concatenate(filter_)
                order = np.lexsort((filter_, row))
                ends = np.concatenate([[0], np.bincount(row, minlength=len(part)).cumsum()])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(filter_[order], pa.int32()))
                taken = vectors.take(pa.array(part))
                yield pa.RecordBatch.from_arrays([gids.take(pa.array(part)), taken, lists], names=["gid", "vector", "filters"])


def _earlier(filters: list[np.ndarray], here: int) -> np.ndarray:
    """A row per vector, a column per filter below ``here``: 1 where the vector is in it."""
    sizes = np.array([len(f) for f in filters])
    every = np.concatenate(filters)
    owner = np.repeat(np.arange(len(filters)), sizes)
    below = every < here
    names, column = np.unique(every[below], return_inverse=True)
    matrix = np.zeros((len(filters), len(names)), dtype=np.float32)
    matrix[owner[below], column] = 1
    return matrix


def _verified(units, filters, weights, gids, tiles, here, limit):
    """(gid, links) and (gid, gid) of the pairs within one run of equal (filter, tile, tile)."""
    n = len(gids)
    cross = tiles.min() != tiles.max()
    early = _earlier(filters, here)
    counts, a, b = np.zeros(n, np.int64), [], []
    for at in range(0, n, 512):
        part = slice(at, at + 512)
        close = units[part] @ units.T >= limit
        if early.shape[1]:
            close &= early[part] @ early.T == 0
        close[np.arange(close.shape[0]), np.arange(at, at + close.shape[0])] = False
        if cross:
            close &= tiles[part][:, None] != tiles[None, :]
        counts[part] = close @ weights
        i, j = np.nonzero(close)
        a.append(i + at)
        b.append(j)
    root = roots(n, np.concatenate(a), np.concatenate(b))
    own, some = np.flatnonzero(root != np.arange(n)), np.flatnonzero(counts)
    return gids[some], counts[some], gids[own], gids[root[own]]


def _met(batches, limit: float):
    """Rows sorted by (filter, low tile, high tile); runs may reach over batches."""

    def rows(table_):
        key = [table_.column(i).to_numpy() for i in range(3)]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key[0])]])
        tile, gid, weight = (table_.column(i).to_numpy() for i in (3, 4, 5))
        out = []
        for lo, hi in zip(starts, ends):
            if hi - lo < 2:
                continue
            part = table_.slice(lo, hi - lo)
            lists, vectors = part.column(7).combine_chunks(), part.column(6).combine_chunks()
            units = vectors.flatten().to_numpy().astype(np.float64).reshape(hi - lo, -1)
            units = units / np.linalg.norm(units, axis=1, keepdims=True)
            filters = np.split(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).cumsum()[:-1])
            out.append(_verified(units, filters, weight[lo:hi], gid[lo:hi], tile[lo:hi], key[0][lo] % WIDTHS, limit))
        if out:
            g, n, a, b = (np.concatenate(x) for x in zip(*out))
            if len(a):
                nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                star = roots(len(nodes), place[: len(a)], place[len(a) :])
                own = np.flatnonzero(star != np.arange(len(nodes)))
                a, b = nodes[own], nodes[star[own]]
            named, at = np.unique(g, return_inverse=True)
            sums = np.bincount(at, weights=n, minlength=len(named)).astype(np.int64)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(named), pa.array(a)]),
                    pa.concat_arrays([pa.array(sums), none]),
                    pa.concat_arrays([pa.nulls(len(named), pa.int64()), pa.array(b)]),
                ],
                names=["gid", "links", "other"],
            )

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        joined = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        joined = joined.combine_chunks()
        key = [joined.column(i).to_numpy() for i in range(3)]
        other = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        held = joined.slice(cut)
        if cut:
            yield from rows(joined.slice(0, cut))
    if held is not None:
        yield from rows(held)


def near_duplicates(
    rows: DataFrame, ids: str = "vec_id", vector: str = "embedding", limit: float = LIMIT, codes: int = CODES,
    blocks: int = BLOCKS, hits: int = HITS, threshold: float = THRESHOLD, tile: int = TILE, seed: int = SEED,
) -> DataFrame:
    """``ids``, ``n_links``, ``component_id`` and ``kept``, one row per row."""
    each = rows.select(F.col(ids).alias("_id"), F.col(vector).alias("_v"))
    sound = F.coalesce(
        (F.size("_v") > 0)
        & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("_v", lambda x: x != 0),
        F.lit(False),
    )
    marked = each.withColumn("_sound", sound)
    points = settle(
        marked.filter("_sound").groupBy(F.col("_v").alias("vector")).agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("weight"))
        .withColumn("gid", F.monotonically_increasing_id())
    )
    kind, options = points.schema["vector"].dataType.simpleString(), (codes, blocks, hits, threshold, seed)
    decoded = settle(
        points.select("gid", "vector").mapInArrow(lambda batches: _decoded(batches, options), f"gid long, vector {kind}, filters array<int>")
    )
    name = F.size("vector").cast("bigint") * WIDTHS
    crowd = decoded.select(name.alias("width"), F.explode("filters").alias("f")).groupBy((F.col("width") + F.col("f")).alias("filter")).count()
    # Only filters with more rows than a tile; none in most tables.
    crowded = stored(crowd.filter(F.col("count") > tile).select("filter", F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    placed = decoded.join(points.select("gid", "weight"), "gid").withColumn("filter", F.explode(F.transform("filters", lambda f: name + f)))
    tiled = placed.join(crowded, "filter", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    paired = tiled.withColumn("tile", F.pmod(F.xxhash64("gid"), F.col("tiles")).cast("int")).withColumn(
        "with", F.explode(F.expr("sequence(0, tiles - 1)"))
    )
    paired = paired.select("filter", F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high"), "tile", "gid", "weight", "vector", "filters")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = paired.repartition(n, "filter", "low", "high").sortWithinPartitions("filter", "low", "high", "gid")
    found = settle(sorted_.mapInArrow(lambda batches: _met(batches, limit), "gid long, links long, other long"))
    counts = found.filter("links IS NOT NULL").groupBy("gid").agg(F.sum("links").alias("links"))
    linked = components(found.filter("other IS NOT NULL"), "gid", "other").withColumnRenamed("node", "gid")
    groups = points.join(linked, "gid", "left").join(counts, "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    known = groups.join(least, "root").select(
        F.col("vector").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    joined = marked.filter("_sound").join(known, "_v").select("_id", "n_links", "component_id")
    alone = marked.filter("NOT _sound").select("_id", F.lit(0).cast("bigint").alias("n_links"), F.col("_id").alias("component_id"))
    done = joined.unionByName(alone)
    return done.select(F.col("_id").alias(ids), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"))


@query("op10_cap_filters")
def op10_cap_filters(spark, sf_dir):
    """Every vector with its links, component and whether it stays."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
