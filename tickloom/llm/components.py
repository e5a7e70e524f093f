"""Connected components of an edge table by alternating large and small stars.

Every step is an aggregation with partial sums and a join that the adaptive
planner may split, so no node's neighbours meet in one task; the edges of each
round are a table in the shared folder.  A forest of at most ``ONE_TASK`` edges
needs no rounds: one task finds its roots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.workspace import Workspace


#: Edges (16 bytes each) whose roots one task may find; more take the rounds.
ONE_TASK = 500_000


class Forest:
    """Union-find over the keys seen so far, with the least key as root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every Arrow batch of edges, a spanning forest as (node, root): fewer edges, the same components."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        pairs = [(x, r) for x in list(forest.up) if (r := forest.root(x)) != x]
        if pairs:
            a, b = np.array(pairs, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges in one stream: (node, root) of every node."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
    nodes = list(forest.up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(node, component) of every node of an edge; component is the least node reachable.

    edges: two long columns (a, b), any order, repeats and loops allowed; rows with a null are ignored.
    """
    edges = edges.toDF("a", "b").where("a <> b").mapInArrow(_forests, "a long, b long").distinct()
    table, seen, k = ws.write(edges, f"{name}0"), None, 0
    if table.count() <= ONE_TASK:
        nodes = ws.write(table.repartition(1).mapInArrow(_roots, "node long, component long"), f"{name}1")
        ws.drop(f"{name}0")
        return nodes
    while True:
        both = table.union(table.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node go to the least node around it
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its lower neighbours go to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        )
        k += 1
        new = ws.write(small, f"{name}{k}")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        ws.drop(f"{name}{k - 1}")
        table = new
        if mark == seen or not mark[0]:
            break
        seen = mark
    nodes = table.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(table.select(F.col("b"), F.col("b")).distinct())
