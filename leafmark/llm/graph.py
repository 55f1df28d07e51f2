"""Connected components of an edge table, without collecting edges or labels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import copied, dealt, hold, hot_keys, to_arrow, workers_find_us

#: Nodes that a task joins at a time.
NODES = 2_000_000


def components(edges: DataFrame, nodes: int = NODES) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Each round has two steps. Every task joins the edges it has, ``nodes`` of them at a
    time, into stars around the smallest node of each part. Then an alternating star
    contraction hangs every node's larger neighbours, then its smaller ones, on its
    smallest neighbour, with minima combined before the shuffle and a hub's edges dealt to
    parts, so a node with very many edges gathers nothing. Rounds end when each node hangs on one that hangs on none;
    they grow with the logarithm of the nodes that no task has together. Each is held.
    """
    edges = hold(edges.selectExpr("greatest(a, b) as a", "least(a, b) as b").filter("a <> b").distinct(), "edges")
    while True:
        edges = hold(_joined(edges, nodes).distinct(), "stars")
        if _settled(edges):
            return edges.selectExpr("a as node", "b as component").unionByName(edges.selectExpr("b as node", "b as component").distinct())
        both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m")
        large = _hung(both.filter("b > a"), least)
        large = hold(large.filter("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _hung(large, least).unionByName(least.selectExpr("a", "m as b"))
        edges = hold(small.filter("a <> b").distinct(), "edges")


def _hung(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each node's neighbours, hung on its least one; a hub's edges are dealt to parts."""
    hot = hot_keys(edges, "a")
    return dealt(edges, hot, "a", "b").join(copied(least, hot, "a"), ["a", "salt"]).selectExpr("b as a", "m as b")


def _settled(edges: DataFrame) -> bool:
    """Whether each node hangs on one node, and on one that hangs on none."""
    roots = edges.select(F.col("b").alias("a")).distinct()
    return edges.count() == edges.select("a").distinct().count() and edges.join(roots, "a", "left_semi").isEmpty()


def _joined(edges: DataFrame, most: int) -> DataFrame:
    """Union-find over each task's edges: (node, smallest node of its part)."""
    schema = "a long, b long"
    workers_find_us(edges.sparkSession)
    target = to_arrow(edges.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def stars() -> Iterator[pa.RecordBatch]:
            nodes = [x for x in up if up[x] != x]
            for at in range(0, len(nodes), 10_000):
                part = nodes[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([top(x) for x in part], pa.int64())], schema=target)
            up.clear()

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
            if len(up) >= most:
                yield from stars()
        yield from stars()

    return edges.mapInArrow(run, schema)
