"""Connected components of a link table, by contraction.

Each round points every node at the first of its neighbours and itself, in an order drawn anew by
hash, follows the pointer once more, and replaces the links by links between what was pointed at.
As the order is random, a constant share of the nodes goes in every round, chains included. A
round is a few equi joins and aggregates that combine before the shuffle, so a node with very
many links costs one row per task. Rounds are cut with ``settle``. Nothing is collected but the
answer to "is any link left".
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .shared import stored
from .vptree import roots

# Links of a task that are joined up at a time, and links that one task joins up at the end.
PIECE = 1 << 18


def _star(rows: pa.Table) -> pa.RecordBatch:
    """``a``, ``b``: every node of the links and the first one, by ``p`` and ``q``, that it is connected with."""
    ends = pa.concat_arrays([c for name in "ab" for c in rows[name].chunks]).dictionary_encode()
    at, names = ends.indices.to_numpy(), ends.dictionary
    place = np.zeros(len(names), np.int64)
    place[at] = np.concatenate([rows["p"].to_numpy(), rows["q"].to_numpy()])
    order = np.argsort(place)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    at = rank[at]
    root = roots(len(names), at[: len(rows)], at[len(rows) :])
    # A node that is linked only with itself keeps that link.
    own = np.flatnonzero((root != np.arange(len(root))) | (np.bincount(root, minlength=len(root)) == 1))
    return pa.RecordBatch.from_arrays([names.take(pa.array(order[own])), names.take(pa.array(order[root[own]]))], names=["a", "b"])


def _place(turn: int, node: str) -> Column:
    return F.xxhash64(F.lit(turn), F.col(node))


def stars(edges: DataFrame, turn: int) -> DataFrame:
    """Links (``a``, ``b``) that connect what ``edges`` connect, no more of them and mostly fewer."""
    size = PIECE

    def each(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= size:
                yield _star(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield _star(pa.Table.from_batches(held))

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b", _place(turn, "a").alias("p"), _place(turn, "b").alias("q")).mapInArrow(each, f"a {kind}, b {kind}")


def _joined(rows: pa.Table) -> pa.RecordBatch:
    """``node``, ``root``: every node of the links and the smallest one it is connected with."""
    ends = pa.concat_arrays([c for name in "ab" for c in rows[name].chunks]).dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    names = ends.dictionary.take(order)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    at = rank[ends.indices.to_numpy()]
    return pa.RecordBatch.from_arrays([names, names.take(pa.array(roots(len(names), at[: len(rows)], at[len(rows) :])))], names=["node", "root"])


def _last(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` of the last links, ``PIECE`` at most, by one task."""

    def each(batches):
        held = [batch for batch in batches if batch.num_rows]
        if held:
            yield _joined(pa.Table.from_batches(held))

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(each, f"node {kind}, root {kind}")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root``: every node that has a link, and the smallest node it is connected with.

    Null ends are not nodes; a link from a node to itself only names the node.
    """
    pairs = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = settle(stars(pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), 0))
    found, held = None, PIECE
    for turn in count():
        if edges.count() <= held:
            break
        ends = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))

        def placed(node: str) -> Column:
            return F.struct(_place(turn, node).alias("place"), F.col(node).alias("name"))

        near = ends.groupBy(F.col("a").alias("node")).agg(F.min(placed("b")).alias("near"))
        step = near.select("node", F.least(placed("node"), F.col("near"))["name"].alias("root"))
        on = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        # What a node points at is itself linked, so every pointer is found here.
        step = settle(step.join(on, "root").select("node", F.col("next").alias("root")))
        found = step if found is None else settle(_followed(found, step))
        low = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        high = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(low, "a").join(high, "b").filter(F.col("ra") != F.col("rb"))
        edges = settle(stars(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), turn + 1))
    if found is None:
        return stored(_last(edges))
    found = stored(_followed(found, _last(edges)))
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    return stored(found.join(least, "root").select("node", F.col("least").alias("root")))


def _followed(found: DataFrame, step: DataFrame) -> DataFrame:
    """``found`` with each root replaced by what ``step`` points it at, if anything."""
    again = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return found.join(again, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
