"""Connected components of a graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm.stages import discard, store

#: Nodes a task holds before it passes on what it has linked.
HELD = 200_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _to_least(pairs: DataFrame, keep) -> DataFrame:
    """Connects the neighbours of each node that `keep` selects, and the node, to the least of them."""
    least = pairs.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select(F.col("a").alias("_a"), F.least("a", "least").alias("least"))
    return pairs.join(least, F.col("a") == F.col("_a")).where(keep).select(F.col("b"), F.col("a"), F.col("least"))


def _round(edges: DataFrame) -> DataFrame:
    larger = _to_least(_both_ways(edges), F.col("b") > F.col("a"))
    larger = larger.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    smaller = _to_least(larger, F.lit(True))
    return smaller.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as (node, least node its edges reach), as few as connect what they connect."""
    parent: dict = {}
    kind = None

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in parent]
        pairs = [(x, least) for x, least in pairs if x != least]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield stars()
            parent.clear()
    if parent:
        yield stars()


def _linked(edges: DataFrame) -> DataFrame:
    """Forests of the tasks, then forests of what meets in the tasks after a shuffle."""
    kind = edges.schema["a"].dataType.simpleString()
    once = edges.select("a", "b").mapInArrow(_forest, f"a {kind}, b {kind}").distinct()
    return store(once.mapInArrow(_forest, f"a {kind}, b {kind}").distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge to a lesser one, or only edges to greater ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    mixed = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
    return not mixed.limit(1).count()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b) between different nodes: the least node that can be reached.

    Each task first reduces its edges to a forest, so a graph that fits a task is settled at once. Then large-star and
    small-star rounds alternate until every node has one edge, to its least one; the number of rounds grows with the
    logarithm of the size of a component, and a hub's edges combine before the shuffle.
    """
    state = _linked(edges.where("a <> b"))
    while not _settled(state):
        before = state
        state = _linked(_round(state))
        discard(before)
    return state.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(
        state.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
