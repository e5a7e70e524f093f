"""Embedding near-dedup: spherical k-means cells, blocked cosine products within them.

Equal vectors become one node with a count.  Centroids come from spherical
k-means on a bounded sample; every node has one home cell, its nearest, and is
a guest of each later cell that may hold a vector linked with it: two bounds
prove that the others hold none, so no link is lost.  A cell's own nodes are
held in blocks, which its guests stream past in slices; a pair meets once, in
the later of its two homes.  Tasks return link counts and spanning forests,
never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tickloom.llm.components import components
from tickloom.llm.workspace import Workspace

#: Vectors that k-means is fitted on, or FIT_EACH for each cell where that is more; vectors aimed at in a cell; vectors of a block; most nodes that may stream past a block in one task.
FIT_ROWS, FIT_EACH, CELL, BLOCK, SLICE = 20_000, 4, 2048, 2048, 1 << 16
#: Numbers in one product of vectors and centroids: many cells take fewer vectors at a time.
PRODUCT = 1 << 20
#: Slack of the bounds, far over the rounding of a dot product.
_EPS = 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Unit centroids of the unit vectors x; an empty cell starts anew at a random vector."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)[0]
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        empty = size < 1e-12
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        size[empty] = 1
        c = total / size[:, None]
    return c


def _strips(n: int, cells: int) -> Iterator[slice]:
    """Slices of n rows whose product with the cells holds about PRODUCT numbers."""
    size = max(1, PRODUCT // cells)
    yield from (slice(i, i + size) for i in range(0, n, size))


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of the greatest inner product of each vector, and that product."""
    near, best = np.zeros(len(x), np.int32), np.zeros(len(x))
    for at in _strips(len(x), len(c)):
        dot = x[at] @ c.T
        near[at], best[at] = dot.argmax(1), dot.max(1)
    return near, best


def _partial_sums(centroids):
    """(vector) to (cell, total): each task's sum of the unit vectors nearest to a centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        total = np.zeros_like(c)
        for batch in batches:
            if len(batch):
                x = _unit(batch.column(0))
                np.add.at(total, _nearest(x, c)[0], x)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["cell", "total"])

    return run


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partial sums (cell, total) of a task's cells."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for cell, total in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = total.values.to_numpy()
            totals[cell] = totals[cell] + v if cell in totals else v
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.list_(pa.float64()))], names=["cell", "total"])


def spread_kmeans(vectors: DataFrame, k: int, ws: Workspace, rounds: int = 12) -> np.ndarray:
    """kmeans with its rounds on the executors: assign, sum by cell; the driver holds the k centroids alone.

    Starts from the k vectors of least hash; an empty cell keeps its centroid.
    """
    vectors = ws.write(vectors, "fit")
    first = vectors.orderBy(F.xxhash64("vector"), "vector").limit(k).toArrow()  # k rows
    c = _unit(first["vector"].combine_chunks())
    for _ in range(rounds):
        seen = vectors.sparkSession.sparkContext.broadcast(c)
        parts = vectors.mapInArrow(_partial_sums(seen), "cell int, total array<double>")
        sums = parts.repartition("cell").mapInArrow(_add_sums, "cell int, total array<double>").toArrow()  # a row a cell
        total, at = np.array(sums["total"].to_pylist(), np.float64), sums["cell"].to_numpy()
        size = np.linalg.norm(total, axis=1)
        c = c.copy()
        c[at[size > 1e-12]] = total[size > 1e-12] / size[size > 1e-12, None]
        seen.destroy()
    ws.drop("fit")
    return c


def cells_of(n: int) -> int:
    """Cells for n vectors of one length: of CELL each, but no more than four times the root of n, at least two."""
    return max(2, min(n // CELL, 4 * math.isqrt(n)))


def _unit(column: pa.Array) -> np.ndarray:
    """The list column's vectors, all of one length, scaled to unit length in double precision."""
    x = np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of rows with equal values."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    ends = [*np.flatnonzero(new).tolist(), len(new)]
    yield from zip([0, *ends[:-1]], ends)


def _homes(centroids):
    """(dim, node, mult, vector) to (dim, home, node, mult, angle, vector): the nearest cell and the angle to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            home, angle = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for at, end in _runs(dims):
                c = centroids.value.get(int(dims[at]))
                if c is not None:
                    home[at:end], dot = _nearest(_unit(batch.column(3).slice(at, end - at)), c)
                    angle[at:end] = np.arccos(np.clip(dot, -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(home), batch.column(1), batch.column(2), pa.array(angle), batch.column(3)], names=["dim", "home", "node", "mult", "angle", "vector"])

    return run


def _visits(cells, threshold: float):
    """(dim, home, node, mult, vector) to (dim, cell, guest, node, mult, vector): each node at home and as guest of later cells.

    A vector linked with x lies within the threshold's angle of it.  So a cell
    has none if x is farther from the centroid than the cell's radius and that
    angle, or farther than that angle beyond the plane midway to its own centroid.
    """
    reach = float(np.arccos(np.clip(threshold, -1, 1)))
    across = np.sin(reach) if reach < np.pi / 2 else 2.0  # 2: the plane excludes nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, home = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            row, cell = [np.arange(len(dims))], [home]
            for at, end in _runs(dims):
                if int(dims[at]) not in cells.value:
                    continue
                c, radius = cells.value[int(dims[at])]
                x = _unit(batch.column(4).slice(at, end - at))
                for strip in _strips(len(x), len(c)):
                    dot, own = x[strip] @ c.T, home[at:end][strip]
                    # an angle is within a bound below pi where its cosine is not less
                    may = dot >= np.cos(np.minimum(radius + reach + _EPS, np.pi)) - 1e-12
                    may &= radius > -4  # a cell of no node
                    may &= dot[np.arange(len(own)), own][:, None] - dot <= across * np.sqrt(np.maximum(2 - 2 * (c[own] @ c.T), 0)) + _EPS
                    may &= np.arange(len(c)) > own[:, None]
                    i, k = np.nonzero(may)
                    row.append(i + at + strip.start)
                    cell.append(k.astype(np.int32))
            guest = np.arange(sum(map(len, row))) >= len(dims)
            row, cell = np.concatenate(row), np.concatenate(cell)
            for k in range(0, len(row), 4096):
                each = pa.array(row[k : k + 4096])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(each), pa.array(cell[k : k + 4096]), pa.array(guest[k : k + 4096]), *(batch.column(i).take(each) for i in (2, 3, 4))],
                    names=["dim", "cell", "guest", "node", "mult", "vector"],
                )

    return run


class _Block:
    """The held nodes of a block, their link counts and their forest."""

    def __init__(self, alone: bool, threshold: float) -> None:
        self.alone, self.threshold, self.parts, self.x = alone, threshold, [], None

    def hold(self, *part: np.ndarray) -> None:
        self.parts.append(part)

    def _close(self) -> None:
        """All held nodes are here; links among them count in one slice."""
        self.node, self.mult, self.x = (np.concatenate(c) for c in zip(*self.parts))
        self.links, self.tree = np.zeros(len(self.node), np.int64), np.arange(len(self.node))
        for at in range(0, len(self.node) if self.alone else 0, 512):
            p, q = np.nonzero(self.x @ self.x[at : at + 512].T >= self.threshold)
            q += at
            p, q = p[p < q], q[p < q]
            np.add.at(self.links, p, self.mult[q])
            np.add.at(self.links, q, self.mult[p])
            self._unite(p, self.tree[q])

    def _unite(self, p: np.ndarray, root: np.ndarray) -> None:
        """Joins the trees of the nodes p with the given roots, pair by pair."""
        while len(p):
            a, b = self.tree[p], self.tree[root]
            open_ = a != b
            p, root, a, b = p[open_], root[open_], a[open_], b[open_]
            up = np.arange(len(self.tree))
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while (up != up[up]).any():
                up = up[up]
            self.tree = up[self.tree]

    def guests(self, node: np.ndarray, mult: np.ndarray, x: np.ndarray) -> pa.RecordBatch | None:
        if self.x is None:
            self._close()
        p, q = np.nonzero(self.x @ x.T >= self.threshold)
        if not len(p):
            return None
        links = np.bincount(q, self.mult[p], len(node)).astype(np.int64)
        self.links += np.bincount(p, mult[q], len(self.node)).astype(np.int64)
        first = np.full(len(node), len(self.node))
        np.minimum.at(first, q, p)
        self._unite(p, first[q])
        some = np.flatnonzero(links)
        return _found(node[some], self.node[first[some]], node[some], links[some])

    def end(self) -> pa.RecordBatch | None:
        if self.x is None:
            self._close()
        some, low = np.flatnonzero(self.links), np.flatnonzero(self.tree != np.arange(len(self.tree)))
        return _found(self.node[low], self.node[self.tree[low]], self.node[some], self.links[some]) if len(some) else None


def _found(a: np.ndarray, b: np.ndarray, node: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    """Rows (a, b, 0) of forest edges and (node, null, links) of counts."""
    none = np.arange(len(a) + len(node)) >= len(a)
    rows = [np.concatenate(c) for c in ((a, node), (b, node), (np.zeros_like(a), links))]
    return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1], mask=none), pa.array(rows[2])], names=["a", "b", "n"])


def _compare(threshold: float):
    """Rows (dim, cell, part, slice, guest, node, mult, vector) sorted by the first five: (a, b) forest edges, (a, null, n) link counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = block = None
        for batch in batches:
            *keys, guest, node, mult = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            for at, end in _runs(*keys, guest):
                if key != (new := tuple(int(k[at]) for k in keys)):
                    if block and (out := block.end()) is not None:
                        yield out
                    key, block = new, _Block(new[3] == 0, threshold)
                rows = node[at:end], mult[at:end], _unit(batch.column(7).slice(at, end - at))
                if not guest[at]:
                    block.hold(*rows)
                elif block.parts and (out := block.guests(*rows)) is not None:  # a part may have no node
                    yield out
        if block and (out := block.end()) is not None:
            yield out

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors.

    Vectors link when their cosine in double precision reaches the threshold;
    n_links counts the other rows linked directly, component_id is the least id
    reachable, kept marks it.

    A vector that is null, empty, zero or has null or non-finite components
    links with nothing and is its own component.  Vectors of different lengths
    never link.  A null id takes part and is least only where its class has no
    other.  Repeated rows link with each other.  Empty table: no rows.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "embedding")
    kind = "array<float>" if vectors.schema[vector_col].dataType == ArrayType(FloatType(), True) else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    usable = F.expr("size(vector) > 0 and not exists(vector, x -> x is null or isnan(x) or abs(double(x)) = double('infinity')) and exists(vector, x -> x <> 0)")
    rows = rows.withColumn("vector", F.when(F.coalesce(usable, F.lit(False)), F.expr("transform(vector, x -> x + cast(0 as float))")))
    nodes = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    nodes = ws.write(nodes.select(F.monotonically_increasing_id().alias("node"), "rep", "mult", F.size("vector").alias("dim"), "vector"), "nodes")
    centroids = {}
    for r in nodes.groupBy("dim").count().where("count > 1").orderBy("dim").collect():  # a row a length of vectors
        k = cells_of(r["count"])
        these = nodes.where(F.col("dim") == r.dim)
        if FIT_EACH * k > FIT_ROWS:  # more than the driver fits itself
            share = math.ceil((1 << 30) * FIT_EACH * k / r["count"])
            fit = these.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < share)
            centroids[r.dim] = spread_kmeans(fit.select("vector"), k, ws)
            continue
        sample = these.orderBy(F.xxhash64("vector"), "vector").limit(FIT_ROWS).select("vector").toArrow()  # of a stated size
        centroids[r.dim] = kmeans(_unit(sample["vector"].combine_chunks()), min(k, len(sample)))
    homes = nodes.select("dim", "node", "mult", "vector").mapInArrow(_homes(spark.sparkContext.broadcast(centroids)), f"dim int, home int, node long, mult long, angle double, vector {kind}")
    homes = ws.write(homes, "cells")
    many = homes.groupBy("dim", F.col("home").alias("cell")).agg(F.count("*").alias("own"), F.max("angle").alias("radius"))
    many = ws.write(many.withColumn("before", F.sum("own").over(Window.partitionBy("dim").orderBy("cell"))), "many")  # a row a cell
    radius = {dim: np.full(len(c), -4.0) for dim, c in centroids.items()}  # a cell of no node has no guest
    for r in many.where(F.col("dim").isin(*centroids)).collect() if centroids else ():
        radius[r.dim][r.cell] = r.radius
    cells = spark.sparkContext.broadcast({dim: (c, radius[dim]) for dim, c in centroids.items()})
    many = many.select("dim", "cell", F.ceil(F.col("own") / BLOCK).cast("int").alias("parts"), F.ceil(F.col("before") / SLICE).cast("int").alias("slices"))
    visits = homes.select("dim", "home", "node", "mult", "vector").mapInArrow(_visits(cells, threshold), f"dim int, cell int, guest boolean, node long, mult long, vector {kind}")
    past = "transform(sequence(0, {} - 1), i -> struct(i as part, slice, true as guest))"
    held = f"concat(transform(sequence(0, slices - 1), s -> struct(part, s as slice, false as guest)), if(part > 0, {past.format('part')}, array()))"
    dealt = (
        visits.join(F.broadcast(many) if many.count() <= 100_000 else many, ["dim", "cell"])
        .withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("slice", F.pmod(F.xxhash64("node", F.lit(1)), "slices").cast("int"))
        .withColumn("to", F.explode(F.expr(f"if(guest, {past.format('parts')}, {held})")))
        .select("dim", "cell", "to.part", "to.slice", "to.guest", "node", "mult", "vector")
        .repartition("dim", "cell", "part", "slice").sortWithinPartitions("dim", "cell", "part", "slice", "guest")
    )
    found = ws.write(dealt.mapInArrow(_compare(threshold), "a long, b long, n long"), "found")
    ws.drop("cells")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"), ws, "links").toDF("node", "root")
    home = nodes.join(counts, "node", "left").join(roots, "node", "left").select("vector", "rep", F.coalesce("links", F.lit(0)).alias("links"), "mult", F.coalesce("root", "node").alias("root"))
    least = home.groupBy("root").agg(F.min("rep").alias("least"))
    home = home.join(least, "root").select("vector", (F.col("links") + F.col("mult") - 1).alias("links"), "least")
    out = rows.where("vector is not null").join(home, "vector").select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("least").alias("component_id"))
    out = out.union(rows.where("vector is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return ws.write(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "out")
