"""Merkle manifest of a dataset, with proofs made by Octopus multiproofs.

Every row is a leaf. Leaves of a group stand in order; every ``ARITY`` neighbours become the hash of
their concatenation, level by level, until one node is left, the group's subroot; subroots become
the root in the same way. A row's proof is the siblings on its way to the root.

1. Leaves are numbered over the whole table by range slices and slice offsets.
2. Trees grow by tiles of 729 leaves, six levels to a shuffle, then tiles of tiles. Kept are the
   tops of tiles, and whole tiles only where a border between leaf partitions runs through them:
   no other lower node is ever asked for.
3. A leaf partition is ``block`` neighbouring leaves, whatever their groups. It works out the least
   set of node coordinates that its leaves need and cannot derive from each other (Octopus), for
   the trees it holds a part of and for the tree of subroots, and fetches these once, by one join.
4. It then derives the shared inner nodes and expands each leaf's own proof locally.

Equal rows are counted before they are sorted and unfolded in the partition they lie in, so neither a
row nor a group that holds a third of the table meets in one task.

Edge cases. Leaves ascend by id (null first), then by hash; equal rows are leaves of their own, side by
side. A null group is a group of its own and comes first. Null and empty values, and texts of any
length, are hashed with their length, so none is taken for another. An empty table has no leaves, no
root and no rows. Columns are read by name and renamed at once, so further ones cannot clash.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scale import number_rows
from ..session import settle
from .registry import query, table
from .shared import let, stored

ARITY = 3
# Levels that grow in one shuffle, and the leaves of a tile.
RISE = 6
TILE = ARITY**RISE
# Leaves of a partition that proves its leaves together.
BLOCK = 8192
# The tree of subroots.
TOP = -1
HEX = 64


def hashed(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def record_hash(columns: list[Column]) -> Column:
    """The hash of some values: each its length in bytes, a colon and itself; a dash for null."""

    def one(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(one, columns)), 256)


def parents(n: int) -> int:
    return -(-n // ARITY)


def missing(known: np.ndarray, size: int) -> list[np.ndarray]:
    """Octopus: level by level, the places of the nodes that the known leaves of a tree of
    ``size`` leaves lack for all their proofs. What is known or derived is not among them."""
    out, known = [], np.unique(known)
    while size > 1:
        above = np.unique(known // ARITY)
        family = (above[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append(np.setdiff1d(family[family < size], known, assume_unique=True))
        known, size = above, parents(size)
    return out


def expanded(first: int, nodes: list[str], size: int, fetched: dict, tree: int) -> tuple[str, list[list[str]]]:
    """The top of a tree and, for each of the neighbouring leaves from ``first`` on, its siblings.

    ``fetched`` holds the nodes of ``missing`` by (tree, level, place). Each inner node is hashed
    once, and the upper part of a proof is shared by the leaves below it.
    """
    levels, level = [], 0
    while size > 1:
        low, high = first // ARITY * ARITY, min(size, ((first + len(nodes) - 1) // ARITY + 1) * ARITY)
        row = [fetched[tree, level, i] for i in range(low, first)] + nodes
        row += [fetched[tree, level, i] for i in range(first + len(nodes), high)]
        levels.append((first, len(nodes), low, row))
        nodes = [hashed("".join(row[i : i + ARITY])) for i in range(0, len(row), ARITY)]
        first, size, level = low // ARITY, parents(size), level + 1
    proofs = [""] * len(nodes)
    for start, count, low, row in reversed(levels):
        below = []
        for i in range(start - low, start - low + count):
            run = i // ARITY * ARITY
            below.append("".join(row[run:i]) + "".join(row[i + 1 : run + ARITY]) + proofs[i // ARITY])
        proofs = below
    return nodes[0], proofs


def folded(leaf: str, siblings: str, ways: list[tuple[int, int]]) -> str:
    """The root that a leaf and its siblings lead to; ``ways``: (place, size) per tree, lowest first."""
    at = 0
    for place, size in ways:
        while size > 1:
            run = place // ARITY * ARITY
            left, others = place - run, min(ARITY, size - run) - 1
            cut, end = at + left * HEX, at + others * HEX
            leaf = hashed(siblings[at:cut] + leaf + siblings[cut:end])
            place, size, at = place // ARITY, parents(size), end
    return leaf


def fold(leaf: Column, siblings: Column, place: Column, leaves: Column, group_place: Column, groups: Column) -> Column:
    """``folded`` of a row of ``manifest``, or of another leaf in its place."""

    def each(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, e: pa.Array, f: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (a, b, c, d, e, f)))
        return pa.array([folded(h, s, [(i, n), (j, m)]) for h, s, i, n, j, m in rows], pa.string())

    each.__annotations__ = {**dict.fromkeys("abcdef", pa.Array), "return": pa.Array}
    return F.arrow_udf(each, "string")(leaf, siblings, place, leaves, group_place, groups)


def _running(batches):
    """Adds the slice, and the leaves before each row in it."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        counts = batch.column("_n").to_numpy()
        before = total + np.cumsum(counts) - counts
        total += int(counts.sum())
        table = pa.Table.from_batches([batch])
        table = table.append_column("_slice", pa.array(np.full(len(counts), part), pa.int64())).append_column("_from", pa.array(before, pa.int64()))
        yield from table.to_batches()


def _leaves(rows: DataFrame) -> DataFrame:
    """Distinct rows (``_g``, ``_id``, ``_leaf``, ``_more``) with their number ``_n`` and ``_at``, the leaves before them."""
    keys = ["_g", "_id", "_leaf", "_more"]
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counted.repartitionByRange(slices, *keys).sortWithinPartitions(*keys)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in ranged.schema)}, _slice bigint, _from bigint"
    placed = settle(ranged.mapInArrow(_running, schema))
    # One row per slice.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_slice").agg(F.sum("_n").alias("_s")).select("_slice", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    return placed.join(stored(offsets), "_slice").select(*keys, "_n", (F.col("_from") + F.col("_before")).alias("_at"))


def _cut(runs: DataFrame, start: str, width: int, piece: str) -> DataFrame:
    """Runs of ``n`` from ``start`` on, cut where pieces of ``width`` end; ``low`` and ``k`` say what lies in a piece."""
    last = F.col(start) + F.col("n") - 1
    cut = runs.withColumn(piece, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))
    low = F.greatest(F.col(start), F.col(piece) * width)
    return cut.withColumn("low", low).withColumn("k", F.least(last, (F.col(piece) + 1) * width - 1) - low + 1)


def _grown(hashes: Column, size: Column) -> Column:
    """The levels of a tile, its own first; fewer where the tree ends within it."""

    def above(row: Column) -> Column:
        runs = F.sequence(F.lit(0), F.ceil(F.size(row) / ARITY).cast("int") - 1)
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(row, i * ARITY + 1, ARITY), ""), 256))

    def rise(row: Column, left: Column, level: int) -> Column:
        if level == RISE:
            return F.array(row)
        higher = let(above(row), lambda r: rise(r, F.ceil(left / ARITY), level + 1))
        return F.concat(F.array(row), F.when(left > 1, higher).otherwise(F.array().cast("array<array<string>>")))

    return rise(hashes, size, 0)


def _nodes(tiles: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """All kept nodes (``tree``, ``level``, ``place``, ``hash``) and the top of every tree (``tree``, ``hash``).

    ``tiles``: ``tree``, ``size`` (of the tree), ``tile``, ``hashes`` in order and ``whole`` (keep
    every node). ``most``: the size of the largest tree.
    """
    nodes, tops, base = [], [], 0
    while True:
        grown = settle(tiles.withColumn("levels", _grown(F.col("hashes"), F.col("size"))).drop("hashes"))
        each = grown.select("tree", "tile", "size", "whole", F.posexplode("levels").alias("up", "row"))
        each = each.filter(F.col("whole") | (F.col("up") == RISE) | (F.col("size") <= TILE))
        opened = each.select("tree", "tile", "up", F.posexplode("row").alias("i", "hash"))
        width = F.element_at(F.array(*(F.lit(ARITY ** (RISE - k)) for k in range(RISE + 1))), F.col("up") + 1)
        nodes.append(opened.select("tree", (F.col("up") + base).alias("level"), (F.col("tile") * width + F.col("i")).alias("place"), "hash"))
        last = F.get(F.element_at("levels", -1), F.lit(0))
        tops.append(grown.filter(F.col("size") <= TILE).select("tree", last.alias("hash")))
        if most <= TILE:
            break
        base, most = base + RISE, -(-most // TILE)
        higher = grown.filter(F.col("size") > TILE).select("tree", F.ceil(F.col("size") / TILE).alias("size"), F.col("tile").alias("place"), last.alias("hash"))
        tiles = _tiled(higher.select("tree", "size", F.col("place").alias("at"), F.lit(1).cast("bigint").alias("n"), "hash")).withColumn("whole", F.lit(True))
    every, top = nodes[0], tops[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    for more in tops[1:]:
        top = top.unionByName(more)
    return every, top


def _tiled(runs: DataFrame) -> DataFrame:
    """Runs of equal nodes (``tree``, ``size``, ``at``, ``n``, ``hash``) gathered into tiles, at most TILE nodes each."""
    members = F.sort_array(F.collect_list(F.struct("low", F.col("k").cast("int").alias("k"), "hash")))
    gathered = _cut(runs, "at", TILE, "tile").groupBy("tree", "tile").agg(F.first("size").alias("size"), members.alias("m"))
    return gathered.select("tree", "tile", "size", F.flatten(F.transform("m", lambda x: F.array_repeat(x["hash"], x["k"]))).alias("hashes"))


_WANTED = "block bigint, tree bigint, level int, place bigint"


def _wanted(spans: pa.Table) -> pa.Table:
    """The coordinates a leaf partition must fetch, from the stretches of trees it holds."""
    block = spans["block"][0].as_py()
    held = [spans[c].to_numpy() for c in ("tree", "low", "k", "size")]
    trees, levels, found = [], [], []

    def add(tree: int, lacks: list[np.ndarray]) -> None:
        for level, lack in enumerate(lacks):
            trees.append(np.full(len(lack), tree))
            levels.append(np.full(len(lack), level))
            found.append(lack)

    for tree, low, k, size in zip(*held):
        if k < size:
            add(tree, missing(np.arange(low, low + k), int(size)))
    add(TOP, missing(held[0], spans["groups"][0].as_py()))
    none = [np.zeros(0, np.int64)]
    places = np.concatenate([*found, *none])
    return pa.table({
        "block": pa.array(np.full(len(places), block), pa.int64()), "tree": pa.array(np.concatenate([*trees, *none]), pa.int64()),
        "level": pa.array(np.concatenate([*levels, *none]), pa.int32()), "place": pa.array(places, pa.int64()),
    })


def _expand(leaves: pa.Table, nodes: pa.Table) -> pa.Table:
    """A leaf partition's rows, each with its own proof."""
    leaves = leaves.sort_by([("tree", "ascending"), ("low", "ascending")])
    fetched = dict(zip(zip(*(nodes[c].to_pylist() for c in ("tree", "level", "place"))), nodes["hash"].to_pylist()))
    leaves = leaves.take(pa.array(np.repeat(np.arange(len(leaves)), leaves["k"].to_numpy()))) if len(leaves) else leaves
    trees, hashes, sizes = leaves["tree"].to_numpy(), leaves["hash"].to_pylist(), leaves["size"].to_numpy()
    starts = np.flatnonzero(np.r_[True, trees[1:] != trees[:-1]]) if len(trees) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(trees)]
    low = leaves["low"].to_numpy()
    subroots, siblings, places = [], [], []
    for a, b in zip(starts, ends):
        first = int(low[a])
        top, proofs = expanded(first, hashes[a:b], int(sizes[a]), fetched, int(trees[a]))
        subroots.append(top)
        siblings += proofs
        places.append(np.arange(first, first + b - a))
    root, over = expanded(int(trees[0]), subroots, leaves["groups"][0].as_py(), fetched, TOP)
    counts = ends - starts
    siblings = [own + over[g] for own, g in zip(siblings, np.repeat(np.arange(len(starts)), counts))]
    more = pa.table({
        "place": pa.array(np.concatenate(places), pa.int64()),
        "subroot": pa.array([subroots[g] for g in np.repeat(np.arange(len(starts)), counts)], pa.string()),
        "root": pa.array([root] * len(leaves), pa.string()), "siblings": pa.array(siblings, pa.string()),
    })
    keep = leaves.select(["g", "id", "hash", "more", "size", "tree", "groups"]).rename_columns(["g", "id", "leaf", "more", "leaves", "group_place", "groups"])
    for name in more.column_names:
        keep = keep.append_column(name, more[name])
    return keep


def manifest(docs: DataFrame, ids: str, group: str, leaf: Column, more: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row: ``g`` (its group), ``id``, ``leaf``, ``more`` (a struct of what is to be carried along), its
    ``place`` among the ``leaves`` of its group, ``group_place`` among ``groups``, ``subroot``, ``root`` and
    ``siblings`` (concatenated, from the leaf's level to the root, left to right)."""
    carried = F.struct(*(c.alias(n) for n, c in (more or {"none": F.lit(None).cast("string")}).items()))
    rows = docs.select(F.col(group).alias("_g"), F.col(ids).alias("_id"), leaf.alias("_leaf"), carried.alias("_more"))
    at = _leaves(rows)
    groups = at.groupBy("_g").agg(F.min("_at").alias("start"), F.sum("_n").alias("size"))
    groups = stored(number_rows(groups, [], ["start"], "tree").withColumn("tree", F.col("tree") - 1))
    facts = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.max("size"), F.lit(1)).alias("most")).first()
    named = groups.withColumnRenamed("_g", "_named").withColumn("groups", F.lit(facts["groups"]).cast("bigint"))
    runs = at.join(named, F.col("_g").eqNullSafe(F.col("_named"))).select(
        "tree", "size", "start", "groups", F.col("_n").alias("n"), F.col("_at").alias("whole_at"), (F.col("_at") - F.col("start")).alias("at"),
        F.col("_leaf").alias("hash"), F.col("_g").alias("g"), F.col("_id").alias("id"), F.col("_more").alias("more"),
    )
    # A tile is kept whole where a border between leaf partitions runs through it.
    first = F.col("start") + F.col("tile") * TILE
    last = F.col("start") + F.least(F.col("size"), (F.col("tile") + 1) * TILE) - 1
    tiles = _tiled(runs.select("tree", "size", "at", "n", "hash")).join(groups.select("tree", "start"), "tree")
    tiles = tiles.withColumn("whole", F.floor(first / block) != F.floor(last / block)).drop("start")
    nodes, tops = _nodes(tiles, facts["most"])
    over = tops.select(F.lit(TOP).cast("bigint").alias("tree"), F.lit(facts["groups"]).cast("bigint").alias("size"), F.col("tree").alias("at"), F.lit(1).cast("bigint").alias("n"), "hash")
    upper, _ = _nodes(_tiled(over).withColumn("whole", F.lit(True)), facts["groups"])
    spans = _cut(named.select("tree", "size", "groups", "start", F.col("size").alias("n")), "start", block, "block")
    spans = spans.select("block", "tree", "size", "groups", (F.col("low") - F.col("start")).alias("low"), "k")
    wanted = spans.groupBy("block").applyInArrow(_wanted, _WANTED)
    fetched = wanted.join(nodes.unionByName(upper).withColumn("level", F.col("level").cast("int")), ["tree", "level", "place"])
    parts = _cut(runs, "whole_at", block, "block").withColumn("low", F.col("low") - F.col("start"))
    parts = parts.select("block", "tree", "size", "groups", "low", "k", "hash", "g", "id", "more")
    out = "g {g}, id {id}, leaf string, more {more}, leaves bigint, group_place bigint, groups bigint, place bigint, subroot string, root string, siblings string"
    types = {f.name: f.dataType.simpleString() for f in parts.schema}
    fetched = fetched.select("block", "tree", "level", "place", "hash")
    return parts.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(_expand, out.format(**types))


_RECORD = "sha256(" + " || ".join(
    f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")
) + ")"
_CRC32 = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda z: CAST(z AS BIGINT))), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"""


def _tree_sql(name: str, leaves: str) -> str:
    return f"""{name} AS (
  SELECT tree, CAST(0 AS BIGINT) AS lvl, place, h, n FROM {leaves}
  UNION ALL
  SELECT tree, lvl + 1, place // {ARITY}, sha256(string_agg(h, '' ORDER BY place)), any_value((n + {ARITY - 1}) // {ARITY})
  FROM {name} WHERE n > 1 GROUP BY tree, lvl, place // {ARITY})"""


@query("op11_merkle_manifest", f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, {_RECORD.format(text="text")} AS leaf,
    CASE WHEN {_CRC32} % 2 = 0 THEN {_RECORD.format(text="replace(text, chr(10), '')")} END AS bad FROM documents),
sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, n FROM (SELECT source, count(*) AS n FROM rows GROUP BY source)),
leaves AS (
  SELECT row_number() OVER () AS r, doc_id, leaf, bad, tree, n, leaf AS h,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM rows JOIN sources ON rows.source IS NOT DISTINCT FROM sources.source),
{_tree_sql("low", "leaves")},
subroots AS (SELECT CAST(-1 AS BIGINT) AS tree, tree AS place, h, (SELECT count(*) FROM sources) AS n FROM low WHERE low.n = 1),
{_tree_sql("high", "subroots")},
steps AS (
  SELECT leaves.r, s.lvl, s.place, s.h, s.place < leaves.place // CAST(pow({ARITY}, s.lvl) AS BIGINT) AS before
  FROM leaves JOIN low AS s ON s.tree = leaves.tree AND s.n > 1
    AND s.place // {ARITY} = leaves.place // CAST(pow({ARITY}, s.lvl + 1) AS BIGINT) AND s.place <> leaves.place // CAST(pow({ARITY}, s.lvl) AS BIGINT)
  UNION ALL
  SELECT leaves.r, s.lvl + 1000, s.place, s.h, s.place < leaves.tree // CAST(pow({ARITY}, s.lvl) AS BIGINT)
  FROM leaves JOIN high AS s ON s.n > 1
    AND s.place // {ARITY} = leaves.tree // CAST(pow({ARITY}, s.lvl + 1) AS BIGINT) AND s.place <> leaves.tree // CAST(pow({ARITY}, s.lvl) AS BIGINT)),
rounds AS (
  SELECT r, lvl, row_number() OVER (PARTITION BY r ORDER BY lvl) AS turn FROM (
    SELECT leaves.r, l.lvl FROM leaves JOIN (SELECT DISTINCT tree, lvl FROM low WHERE n > 1) AS l ON l.tree = leaves.tree
    UNION ALL SELECT leaves.r, l.lvl + 1000 FROM leaves, (SELECT DISTINCT lvl FROM high WHERE n > 1) AS l)),
turns AS (
  SELECT rounds.r, turn, coalesce(string_agg(h, '' ORDER BY place) FILTER (WHERE before), '') AS l, coalesce(string_agg(h, '' ORDER BY place) FILTER (WHERE NOT before), '') AS g
  FROM rounds LEFT JOIN steps ON rounds.r = steps.r AND rounds.lvl = steps.lvl GROUP BY rounds.r, turn),
folds AS (
  SELECT r, CAST(0 AS BIGINT) AS turn, coalesce(bad, leaf) AS h FROM leaves
  UNION ALL
  SELECT folds.r, turns.turn, sha256(l || h || g) FROM folds JOIN turns ON folds.r = turns.r AND turns.turn = folds.turn + 1),
proofs AS (SELECT r, string_agg(h, '' ORDER BY lvl, place) AS p FROM steps GROUP BY r)
SELECT doc_id, leaf, s.h AS subroot, root.h AS root, sha256(coalesce(p, '')) AS proof_sha256, f.h AS folded_root, f.h = root.h AS verified
FROM leaves JOIN subroots AS s ON s.place = leaves.tree JOIN (SELECT h FROM high WHERE n = 1) AS root ON true
  JOIN (SELECT r, arg_max(h, turn) AS h FROM folds GROUP BY r) AS f ON f.r = leaves.r LEFT JOIN proofs ON proofs.r = leaves.r""")
def op11_merkle_manifest(spark, sf_dir):
    """Every document's leaf, proof and what a tampered text would lead to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    facts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    bad = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, record_hash([*facts, F.replace(F.col("text"), F.lit("\n"), F.lit(""))]))
    rows = manifest(docs, "doc_id", "source", record_hash([*facts, F.col("text")]), {"bad": bad})
    back = fold(F.coalesce("more.bad", "leaf"), F.col("siblings"), F.col("place"), F.col("leaves"), F.col("group_place"), F.col("groups"))
    rows = rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), back.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
