"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gistline.llm.common import stage

FEW = 100_000  #: So many edges end the rounds.

_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(edges: DataFrame) -> DataFrame:
    """For each task's batches, edges that connect the same nodes without a cycle: (a, root) with a > root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rooted(union(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))

    return edges.mapInArrow(run, "a long, b long")


def _rooted(up: dict[int, int]) -> pa.RecordBatch:
    out = [(x, r) for x in up if (r := find(up, x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], schema=_EDGES)


def _few(edges: DataFrame) -> DataFrame:
    """(a, up) of at most ``FEW`` edges, by one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _rooted(union(e for b in batches for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist())))

    return edges.coalesce(1).mapInArrow(run, "a long, b long").withColumnRenamed("b", "up")


def find(up: dict[int, int], x: int) -> int:
    """The least known member of x's tree."""
    root = x
    while up[root] != root:
        root = up[root]
    while up[x] != root:
        up[x], x = root, up[x]
    return root


def union(pairs) -> dict[int, int]:
    up: dict[int, int] = {}
    for a, b in pairs:
        up.setdefault(a, a)
        up.setdefault(b, b)
        a, b = find(up, a), find(up, b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return up


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns); the root is the least node of its component.

    Each round hangs every node on its least lower neighbour, follows two steps upwards, and carries
    the edges over to the roots; edges inside a tree vanish, so the edge table shrinks, and the last
    ``FEW`` edges are joined by one task. Minima are aggregated before the shuffle, so a node with very many edges is no hot spot.
    """
    a, b = edges.columns
    edges = forest(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b"))
    edges = stage(edges.distinct())
    labels = stage(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")))
    while (count := edges.count()):
        if count <= FEW:
            up = stage(_few(edges))
        else:
            up = stage(edges.groupBy("a").agg(F.min("b").alias("up")))
            for _ in range(2):
                further = up.select(F.col("a").alias("up"), F.col("up").alias("upper"))
                up = up.join(further, "up", "left").select("a", F.coalesce("upper", "up").alias("up"))
            up = stage(up)
        labels = labels.join(up, labels.root == up.a, "left").select("node", F.coalesce("up", "root").alias("root"))
        if count <= FEW:
            break
        labels = stage(labels)
        left, right = up.select("a", F.col("up").alias("ua")), up.select(F.col("a").alias("b"), F.col("up").alias("ub"))
        moved = edges.join(left, "a", "left").join(right, "b", "left").select(
            F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y")).filter("x <> y")
        edges = stage(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    return stage(labels)
