"""Connected components of edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

#: Up to this many edges are joined up by one task; more are contracted first.
ONE_TASK = 100_000


def _order(node: str) -> Column:
    return F.struct(F.xxhash64(node).alias("hash"), F.col(node).alias("node"))


def _ends(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: every node hooks to the node of smallest hash among itself and its neighbours.

    Returns (node, up) and the edges between different hooks.  The order is that of
    hashes, so no numbering of the nodes makes long ways; on a path, about half of
    the nodes stay.  Both are written and read again: a later plan sees file sizes,
    not estimates that joins have multiplied.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooks = both.groupBy("a").agg(F.min(_order("b")).alias("near")).select(F.col("a").alias("node"), F.least(_order("a"), "near")["node"].alias("up"))
    hooks = stored(hooks)
    one, two = (hooks.select(F.col("node").alias(f"{c}_node"), F.col("up").alias(f"{c}_up")) for c in "ab")
    moved = edges.join(one, F.col("a") == F.col("a_node")).join(two, F.col("b") == F.col("b_node"))
    return hooks, stored(moved.select(*_ends("a_up", "b_up")).filter("a != b").distinct())


def _joined(edges: DataFrame) -> DataFrame:
    """(node, component) of a bounded edge table, by union and find in one task."""

    def plain(node: object) -> object:
        return tuple(node.values()) if isinstance(node, dict) else node

    def rank(node: object) -> tuple:
        return tuple((x is not None, x) for x in node) if isinstance(node, tuple) else (node is not None, node)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def find(x: object) -> object:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        given: dict = {}
        kind = None
        for part in batches:
            kind = part.schema.field(0).type
            for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                p, q = plain(a), plain(b)
                given.setdefault(p, a), given.setdefault(q, b)
                up.setdefault(p, p), up.setdefault(q, q)
                p, q = find(p), find(q)
                if p != q:
                    low, high = (p, q) if rank(p) < rank(q) else (q, p)
                    up[high] = low
        if given:
            yield pa.RecordBatch.from_arrays([pa.array(list(given.values()), kind), pa.array([given[find(x)] for x in given], kind)], ["node", "component"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node it can reach.

    Rounds of ``contracted`` end when at most ``one_task`` edges are left, which
    one task joins up; a path of n nodes takes about log2(n / one_task) of them,
    whatever its numbering.  The hooks of all rounds are then followed from the
    last to the first.  An edge from a node to itself names a component of one node.
    """
    left, hops = stored(edges.select(*_ends("a", "b")).distinct()), []
    while left.count() > one_task:
        hooks, left = contracted(left)
        hops.append(hooks)
    label = stored(_joined(left))
    if not hops:
        return label
    for hooks in reversed(hops):
        above = label.select(F.col("node").alias("at"), F.col("component").alias("top"))
        label = stored(hooks.join(above, F.col("up") == F.col("at"), "left").select("node", F.coalesce("top", "up").alias("component")))
    lowest = label.groupBy(F.col("component").alias("top")).agg(F.min("node").alias("lowest"))
    return stored(label.join(lowest, F.col("component") == F.col("top")).select("node", F.col("lowest").alias("component")))
