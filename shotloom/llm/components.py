"""Connected components of a distributed edge list, by random-priority contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import free, staged

#: Edges that one task finishes by itself; longer lists are contracted until they are as short.
TASK_EDGES = 200_000


def _finish(left: DataFrame) -> DataFrame:
    """(node, to) for a list of at most TASK_EDGES edges: every node moves to its component's smallest."""

    def run(batches):
        to: dict[int, int] = {}

        def find(x: int) -> int:
            while to.setdefault(x, x) != x:
                to[x] = to[to[x]]
                x = to[x]
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = find(a), find(b)
                to[max(a, b)] = min(a, b)
        if to:
            yield pa.RecordBatch.from_arrays([pa.array(list(to)), pa.array([find(x) for x in list(to)])], names=["node", "to"])

    return left.coalesce(1).mapInArrow(run, "node long, to long")


def connected_components(edges: DataFrame, name: str = "components", task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); the component is its smallest node.

    In each round every node moves to the node of least priority among itself and its neighbours, the priority being a
    hash of the node and the round; edges between moved nodes are what is left. A constant share of the nodes goes in
    each round whatever the shape, so rounds grow with the logarithm of the largest component. Minima are taken by
    aggregates that combine before they shuffle, so a hub costs no more than its edges' share of a scan; the joins that
    move edges are between an edge list and one row per node, whose skewed partitions adaptive execution splits.
    Nulls and loops are ignored; repeated edges count once.
    """
    a, b = F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")
    left = staged(edges.select(a, b).where("a <> b").distinct(), name)
    size, turn = left.count(), 0
    if size <= task_edges:
        out = staged(_finish(left).select("node", F.col("to").alias("component")), f"{name}-labels")
        free(left)
        return out
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    moved, spent = nodes.withColumn("label", F.col("node")), left
    while size:
        if size <= task_edges:
            least = staged(_finish(left), f"{name}-moves")
            last, moved = moved, staged(_move(moved, least), f"{name}-labels")
            free(last, least)
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("p"), F.col(c).alias("v"))  # noqa: B023, E731
        least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(rank("b")), F.min(rank("a")))["v"].alias("to"))
        least = staged(least, f"{name}-moves")
        to_a, to_b = least.select(F.col("node").alias("a"), F.col("to").alias("ta")), least.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        left = left.join(to_a, "a").join(to_b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        before, left = spent, staged(left, name)
        last, moved = moved, staged(_move(moved, least), f"{name}-labels")
        free(before, last, least)
        spent = left
        size, turn = left.count(), turn + 1
    smallest = moved.groupBy("label").agg(F.min("node").alias("component"))
    out = staged(moved.join(smallest, "label").select("node", "component"), f"{name}-components")
    free(spent, moved)
    return out


def _move(moved: DataFrame, least: DataFrame) -> DataFrame:
    return moved.join(least.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
