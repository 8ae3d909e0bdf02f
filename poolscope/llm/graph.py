"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import released, staged

HELD = 2_000_000  # edges that a task contracts at a time


def components(edges: DataFrame) -> DataFrame:
    """Rows ``id, component`` (its smallest id) for every id in ``edges`` (columns ``a, b``).

    Each round every node is merged into the one that comes first among itself and its neighbours.
    The ids themselves are the order, which takes stars around a smallest id
    at once; after a round that left more than half of the links, a hash draws a new order, which leaves at most about three
    quarters of the nodes in expectation, whatever the graph and its ids look like. So a chain
    takes a number of rounds in the logarithm of its length. Links inside a merged node vanish, and each task replaces the
    links it reads by a spanning forest of them, so their number never grows. The rounds' mergers
    are then followed from the last one back, over as many nodes as each round had.

    Aggregations combine before the shuffle, and every round's tables are in the shared folder. An
    id whose only edges lead to itself is a component of its own.
    """
    edges = staged(edges.select("a", "b").distinct(), "graph-edges")
    links = staged(_forest(edges), "graph-links")
    mergers: list[DataFrame] = []
    n, seed, drawn = links.count(), 0, False  # seed: 0 for the ids as they are
    while n:
        arcs = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        nearest = (
            links.select(arcs.alias("arc")).groupBy(F.col("arc.a").alias("id"))
            .agg(F.min_by("arc.b", _order("arc.b", seed)).alias("near"))
        )
        root = F.when(_order("near", seed) < _order("id", seed), F.col("near")).otherwise(F.col("id"))
        merger = staged(nearest.select("id", root.alias("root")), "graph-roots")
        mergers.append(merger)
        of_a, of_b = (merger.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        moved = links.join(of_a, "a").join(of_b, "b").where("root_a <> root_b")
        links = staged(
            _forest(staged(moved.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), "graph-moved")),
            "graph-links",
        )
        before, n = n, links.count()
        seed = len(mergers) if not seed and 2 * n > before else 0
        drawn = drawn or (n > 0 and seed > 0)
    if not mergers:
        ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        return ids.withColumn("component", F.col("id"))
    labels = mergers.pop().withColumnRenamed("root", "top")
    while mergers:
        onward = labels.select(F.col("id").alias("root"), "top")
        labels = staged(
            mergers.pop().join(onward, "root", "left").select("id", F.coalesce("top", "root").alias("top")),
            "graph-labels",
        )
    if drawn:
        least = labels.groupBy("top").agg(F.min("id").alias("component"))
        named = labels.join(least, "top").select("id", "component")
    else:  # a smallest id is never merged into another
        named = labels.select("id", F.col("top").alias("component"))
    loops = edges.where("a = b").select(F.col("a").alias("id"))
    if loops.isEmpty():
        return named
    alone = loops.distinct().join(labels, "id", "left_anti")
    return named.unionByName(alone.withColumn("component", F.col("id")))


def _order(column: str, seed: int) -> Column:
    """What a round orders nodes by: their ids, or a hash if there is a seed."""
    return F.xxhash64(F.col(column), F.lit(seed)) if seed else F.col(column)


def _forest(links: DataFrame) -> DataFrame:
    """Links between different nodes that connect what those of each task connect."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy() for k in (0, 1)]))
            if sum(h.shape[1] for h in held) > HELD:
                yield _record(np.concatenate(held, axis=1))
                held = []
        if held:
            yield _record(np.concatenate(held, axis=1))

    return links.select("a", "b").mapInArrow(released(forest), "a long, b long")


def _record(links: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in stars(*links)], ["a", "b"])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between ``a`` and ``b``, a link from the smallest node of each component to each other one."""
    nodes, places = np.unique(np.stack([a, b]), return_inverse=True)
    x, y = places.reshape(2, -1)
    parent = np.arange(len(nodes))
    while len(x):
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        onward = parent[parent]
        while not np.array_equal(onward, parent):
            parent, onward = onward, onward[onward]
        x, y = parent[x], parent[y]
        apart = x != y
        x, y = x[apart], y[apart]
    moved = parent != np.arange(len(nodes))
    return nodes[parent[moved]], nodes[moved]
