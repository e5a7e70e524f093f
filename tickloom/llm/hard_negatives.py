"""Hard negatives by a dual-tree search: trees over anchors and over candidates, whole node pairs pruned at once.

Rows are put in the order of a split tree fitted on a bounded sample (every row
is indexed) and packed into leaves of at most LEAF candidates or ANCHORS
anchors; FAN consecutive nodes make a parent, up to one root.  A node knows the
box and the ball of its vectors, which bound the inner products of a pair of
nodes from both sides, and an anchor node the scores that its anchors still ask
for.  The search goes down both trees level by level, each level a pair of
equi-joins: pairs whose interval misses the anchors' wants, or whose labels
cannot fit, are dropped with all below them; leaf pairs are scored exactly.

Each anchor first meets the leaves it comes from, which gives the k-th best
score so far as its bound.  Leaves are of bounded size whatever values or labels
are frequent; no group of rows is held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tickloom.llm.workspace import Workspace

#: Candidates and anchors of a leaf, children of a node, leaves of a range of rows, rows the split tree is fitted on, its depth.
LEAF, ANCHORS, FAN, LEAVES, FIT_ROWS, DEPTH = 2048, 256, 32, 16, 20_000, 10
LOW, HIGH = -(2**63), 2**63 - 1
NODE = "id long, dim int, label0 long, label1 long, low binary, high binary, center binary, radius double"


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """The vectors of a list column of equal lengths as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind).reshape(len(column), -1 if len(flat) else 0)


def fit_splits(x: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Directions and thresholds of a complete split tree: each node halves its rows along the direction of most spread."""
    at, ways, cuts = np.zeros(len(x), np.int64), [], []
    for level in range(depth):
        for node in range(1 << level):
            part = x[at == node]
            way = np.zeros(x.shape[1])
            cut = 0.0
            if len(part) > 1:
                off = part - part.mean(0)
                way = off[np.argmax((off * off).sum(1))]
                for _ in range(4):  # power steps towards the direction of most spread
                    way = off.T @ (off @ way)
                    way = way / (np.abs(way).max() or 1.0)
                cut = float(np.median(part @ way))
            ways.append(way)
            cuts.append(cut)
        first = (1 << level) - 1
        here = first + at
        at = 2 * at + ((x * np.array(ways)[here]).sum(1) > np.array(cuts)[here])
    return np.array(ways), np.array(cuts)


def _coded(trees: Broadcast):
    """(dim, ..., v) with the code of v's place in its length's split tree in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            code = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                if dim in trees.value:
                    ways, cuts = trees.value[dim]
                    mine = np.flatnonzero(dims == dim)
                    x = _matrix(batch.column(batch.num_columns - 1).take(pa.array(mine)), np.float64)
                    at = np.zeros(len(mine), np.int64)
                    for level in range((len(cuts) + 1).bit_length() - 1):
                        here = (1 << level) - 1 + at
                        at = 2 * at + (np.einsum("ij,ij->i", x, ways[here]) > cuts[here])
                    code[mine] = at
            yield pa.RecordBatch.from_arrays([pa.array(code), *batch.columns], names=["code", *batch.schema.names])

    return run


def _node(ids: int, dim: int, labels: np.ndarray, v: np.ndarray) -> tuple:
    """The columns of NODE for vectors v."""
    low, high = v.min(0), v.max(0)
    center = v.mean(0)
    radius = float(np.sqrt(((v - center) ** 2).sum(1).max())) if v.size else 0.0
    return ids, dim, int(labels.min()), int(labels.max()), low.astype("<i8").tobytes(), high.astype("<i8").tobytes(), center.astype("<f8").tobytes(), radius


_LEAF = f"{NODE}, part int, anchors boolean, homes array<long>, keys binary, ids binary, labels binary, vectors binary"


def _leaves(leaf_rows: int, group: int):
    """(code, dim, vec_id, label, anchor, v) in order to leaves of candidates and of anchors; ids count the task's leaves of a kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        count = {False: 0, True: 0}
        held: list = []  # the rows of the open leaf of candidates
        waiting: list = []  # anchors of closed leaves, with their leaf and place
        size = waits = 0
        schema = ["id", "dim", "label0", "label1", "low", "high", "center", "radius", "part", "anchors", "homes", "keys", "ids", "labels", "vectors"]

        def made(anchors: bool, dim: int, ids, labels, v, keys, homes) -> pa.RecordBatch:
            node = _node(count[anchors], dim, labels, v)
            count[anchors] += 1
            row = (*node, part, anchors, homes, keys.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), v.astype("<i4").tobytes())
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=schema)

        def close(dim: int) -> Iterator[pa.RecordBatch]:
            nonlocal size, waits
            if not held:
                return
            ids, labels, anchor, v = (np.concatenate(c) for c in zip(*held))
            held.clear()
            size = 0
            leaf = count[False]
            keys = (np.int64(part) << 40) | (np.int64(leaf) * leaf_rows + np.arange(len(ids)))
            if anchor.any():
                waiting.append((ids[anchor], labels[anchor], v[anchor], keys[anchor], np.full(anchor.sum(), leaf)))
                waits += int(anchor.sum())
            yield made(False, dim, ids, labels, v, keys, [leaf])
            if waits >= group:
                yield from close_anchors(dim, waits // group * group)

        def close_anchors(dim: int, upto: int) -> Iterator[pa.RecordBatch]:
            nonlocal waits
            if not waits:
                return
            all_of = [np.concatenate(c) for c in zip(*waiting)]
            waiting.clear()
            for a in range(0, upto, group):
                ids, labels, v, keys, homes = (c[a : min(a + group, upto)] for c in all_of)
                yield made(True, dim, ids, labels, v, keys, np.unique(homes).tolist())
            waits -= upto
            if waits:
                waiting.append(tuple(c[upto:] for c in all_of))

        dim = None
        for batch in batches:
            dims = batch.column(1).to_numpy()
            at = 0
            while at < len(dims):
                if dim is not None and dims[at] != dim:
                    yield from close(dim)
                    yield from close_anchors(dim, waits)
                dim = int(dims[at])
                same = np.flatnonzero(dims[at:] != dim)
                end = min(at + leaf_rows - size, at + int(same[0]) if len(same) else len(dims))
                part_of = batch.slice(at, end - at)
                ids, labels, anchor = (part_of.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4))
                held.append((ids, labels, anchor.astype(bool), _matrix(part_of.column(5), np.int64)))
                size += end - at
                at = end
                if size == leaf_rows:
                    yield from close(dim)
        if dim is not None:
            yield from close(dim)
            yield from close_anchors(dim, waits)

    return run


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(parent, kids) to a node that covers its kids, with the kids."""
    for batch in batches:
        for parent, kids in zip(batch.column(0), batch.column(1)):
            k = kids.values
            get = lambda name, kind: [np.frombuffer(x.as_py(), kind) for x in k.field(name)]  # noqa: B023, E731
            dims = k.field("dim").to_numpy()
            alike = bool((dims == dims[0]).all())
            low = high = center = np.zeros(0)
            radius = float("inf")  # of vectors of different lengths nothing is known
            if alike:
                low, high = np.min(get("low", "<i8"), 0), np.max(get("high", "<i8"), 0)
                centers = np.array(get("center", "<f8"))
                center = centers.mean(0)
                radius = float((np.sqrt(((centers - center) ** 2).sum(1)) + k.field("radius").to_numpy()).max())
            row = (parent.as_py(), int(dims[0]) if alike else -1, min(k.field("label0").to_pylist()), max(k.field("label1").to_pylist()), low.astype("<i8").tobytes(), high.astype("<i8").tobytes(), center.astype("<f8").tobytes(), radius)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(row, kinds)), pa.ListArray.from_arrays(pa.array([0, len(k)], pa.int32()), k)], names=["id", "dim", "label0", "label1", "low", "high", "center", "radius", "kids"])


_COLUMNS = ["id", "dim", "label0", "label1", "low", "high", "center", "radius"]


def tree(leaves: DataFrame, ws: Workspace, name: str, fan: int) -> list[DataFrame]:
    """The levels above the leaves, root first: (id, NODE's columns, kids), each kid with NODE's columns."""
    levels: list[DataFrame] = []
    nodes = leaves.select(*_COLUMNS)
    while True:
        kids = nodes.groupBy(F.expr(f"id div {fan}").alias("parent")).agg(F.sort_array(F.collect_list(F.struct(*_COLUMNS))).alias("kids"))
        level = ws.write(kids.mapInArrow(_parents, f"{NODE}, kids array<struct<{NODE.replace(' long', ':long').replace(' int', ':int').replace(' binary', ':binary').replace(' double', ':double')}>>"), f"{name}-{len(levels)}")
        levels.append(level)
        if level.count() <= 1:
            return levels[::-1]
        nodes = level.select(*_COLUMNS)


def _side(kids: pa.StructArray) -> list[dict]:
    """The kids as dicts of numpy values."""
    return [{**k, **{x: np.frombuffer(k[x], "<f8" if x == "center" else "<i8").astype(float) for x in ("low", "high", "center")}} for k in kids.to_pylist()]


def bounds(a: list[dict], c: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products between the vectors of nodes a (rows) and c (columns), by boxes and balls, rounded outwards."""
    al, ah, ac, ar = (np.array([k[x] for k in a]) for x in ("low", "high", "center", "radius"))
    cl, ch, cc, cr = (np.array([k[x] for k in c]) for x in ("low", "high", "center", "radius"))
    four = np.stack([al[:, None] * cl, al[:, None] * ch, ah[:, None] * cl, ah[:, None] * ch])
    low, high = four.min(0).sum(-1), four.max(0).sum(-1)
    an, cn = np.sqrt((ac * ac).sum(1)), np.sqrt((cc * cc).sum(1))
    mid = ac @ cc.T
    reach = ar[:, None] * cn + an[:, None] * cr + ar[:, None] * cr
    slack = 1 + 1e-9 * (np.abs(four).max(0).sum(-1) + (an[:, None] + ar[:, None]) * (cn + cr))
    return np.maximum(low, mid - reach) - slack, np.minimum(high, mid + reach) + slack


def _down(same: bool):
    """(kids of an anchor node, their wants, kids of a candidate node) to the pairs (a, c) of kids that may hold a wanted pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_c = [], []
            for i in range(batch.num_rows):
                wants = {w["id"]: (w["least"], w["most"]) for w in batch.column(1)[i].as_py()}
                kids_a = [k for k in _side(batch.column(0)[i].values) if k["id"] in wants]
                kids_c = _side(batch.column(2)[i].values)
                for dim in {k["dim"] for k in kids_a}:
                    known = dim >= 0
                    a = [k for k in kids_a if k["dim"] == dim]
                    for mixed in (False, True):  # candidates of the same length, then nodes of several lengths
                        c = [k for k in kids_c if (k["dim"] == -1 if mixed else known and k["dim"] == dim or not known and k["dim"] >= 0)]
                        if not c:
                            continue
                        ok = np.ones((len(a), len(c)), bool)
                        if known and not mixed:
                            low, high = bounds(a, c)
                            least, most = (np.array([wants[k["id"]][x] for k in a], float)[:, None] for x in (0, 1))
                            ok = (high >= least) & (low <= most)
                        a0, a1 = (np.array([k[x] for k in a])[:, None] for x in ("label0", "label1"))
                        c0, c1 = (np.array([k[x] for k in c]) for x in ("label0", "label1"))
                        ok &= (a0 <= c1) & (c0 <= a1) if same else ~((a0 == a1) & (c0 == c1) & (a0 == c0))
                        x, y = np.nonzero(ok)
                        out_a += [a[k]["id"] for k in x]
                        out_c += [c[k]["id"] for k in y]
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_c, pa.int64())], names=["a", "c"])

    return run


def descend(anchors: list[DataFrame], wants: DataFrame, candidates: list[DataFrame], same: bool, fan: int) -> DataFrame:
    """(a, c): all leaf pairs that may hold a pair the anchors want; wants has (id, least, most) of the anchor leaves that want any.

    The lower tree's levels are met by the higher one's root until both are at one height.
    """
    spark = wants.sparkSession
    depth = max(len(anchors), len(candidates))
    # A tree that is lower than the other is entered by nodes with one kid.
    pairs = spark.createDataFrame([(0, 0)], "a long, c long")
    for level in range(depth):
        up = depth - level - 1  # levels below this one's kids
        at_a, at_c = level - (depth - len(anchors)), level - (depth - len(candidates))
        kids_a = _level(anchors, at_a).select(F.col("id").alias("a"), F.col("kids").alias("kids_a"))
        kids_c = _level(candidates, at_c).select(F.col("id").alias("c"), F.col("kids").alias("kids_c"))
        grown = wants.groupBy(F.expr(f"id div {fan**up}").alias("id")).agg(F.min("least").alias("least"), F.max("most").alias("most"))
        grown = grown.groupBy(F.expr(f"id div {fan}").alias("a")).agg(F.collect_list(F.struct("id", "least", "most")).alias("wants"))
        rows = pairs.join(kids_a.join(grown, "a"), "a").join(kids_c, "c").select("kids_a", "wants", "kids_c")
        pairs = rows.mapInArrow(_down(same), "a long, c long")
    return pairs


def _level(levels: list[DataFrame], at: int) -> DataFrame:
    """A level of a tree; above the root stand nodes whose only kid is the root."""
    if at >= 0:
        return levels[at]
    return levels[0].select("id", F.array(F.struct(*_COLUMNS)).alias("kids"))


def _scored(same: bool, k: int):
    """Leaf pairs with all they hold to (key, slot, score, negative row, id): each want's best k of the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                if dim != batch.column("c_dim")[i].as_py():
                    continue
                keys, labels, c_keys, c_ids, c_labels = (np.frombuffer(batch.column(x)[i].as_py(), "<i8") for x in ("keys", "labels", "c_keys", "c_ids", "c_labels"))
                v = np.frombuffer(batch.column("vectors")[i].as_py(), "<i4").reshape(len(keys), dim)
                w = np.frombuffer(batch.column("c_vectors")[i].as_py(), "<i4").reshape(len(c_keys), dim)
                top = float(np.abs(v).max(initial=0)) * float(np.abs(w).max(initial=0)) * max(dim, 1)
                kind = np.float64 if top < 2**53 else np.int64  # exact either way
                score = (v.astype(kind) @ w.astype(kind).T).astype(np.int64)
                fits = (labels[:, None] == c_labels) & (keys[:, None] != c_keys) if same else labels[:, None] != c_labels
                wants = batch.column("wants")[i].values
                row = np.searchsorted(keys, wants.field("key").to_numpy())
                slot, least, most = (wants.field(x).to_numpy() for x in ("slot", "least", "most"))
                s = score[row]
                s = np.where(fits[row] & (s >= least[:, None]) & (s <= most[:, None]), s, LOW)
                n = min(k, s.shape[1])
                floor = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                x, y = np.nonzero((s >= floor[:, None]) & (s > LOW))
                order = np.lexsort((c_keys[y], c_ids[y], -s[x, y], x))
                x, y = x[order], y[order]
                place = np.arange(len(x)) - np.maximum.accumulate(np.where(np.r_[True, x[1:] != x[:-1]], np.arange(len(x)), 0)) if len(x) else x
                x, y = x[place < k], y[place < k]
                columns = [keys[row[x]], slot[x], s[x, y], c_ids[y], c_keys[y]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "slot", "score", "found", "found_key"])

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each want, with their rank."""
    by = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "found", "found_key")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


class _Search:
    """The two trees of a table and the searches over them."""

    def __init__(self, ws: Workspace, leaves: DataFrame, fan: int) -> None:
        self.ws, self.fan = ws, fan
        payload = ["dim", "keys", "ids", "labels", "vectors"]
        self.anchors = leaves.where("anchors").select("id", "homes", *payload)
        self.candidates = leaves.where("not anchors").select(F.col("id").alias("c"), *(F.col(x).alias(f"c_{x}") for x in payload if x != "id"))
        self.up = tree(leaves.where("anchors"), ws, "anchors", fan)
        self.down = tree(leaves.where("not anchors"), ws, "candidates", fan)

    def _score(self, pairs: DataFrame, wants: DataFrame, same: bool, k: int) -> DataFrame:
        """The best rows of leaf pairs (a, c); candidates meet all their anchor leaves in one place."""
        asked = wants.groupBy("a").agg(F.collect_list(F.struct("key", "slot", "least", "most")).alias("wants"))
        held = self.anchors.select(F.col("id").alias("a"), "dim", "keys", "labels", "vectors").join(asked, "a")
        rows = pairs.join(held, "a").join(self.candidates, "c")
        return rows.mapInArrow(_scored(same, k), "key long, slot int, score long, found long, found_key long")

    def best(self, wants: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """(key, slot, score, found, rank): of each want (a, key, slot, least, most) the k best rows of the same label or of others."""
        ws = self.ws
        homes = self.anchors.select(F.col("id").alias("a"), F.explode("homes").alias("c"))
        first = ws.write(_best(self._score(homes, wants, same, k), k), f"{name}-first")
        kth = first.where(F.col("rank") == k).select("key", "slot", F.col("score").alias("kth"))
        left = wants.join(kth, ["key", "slot"], "left").select("a", "key", "slot", F.greatest("least", F.coalesce("kth", F.lit(LOW))).alias("least"), "most")
        left = ws.write(left, f"{name}-wants")
        need = left.groupBy(F.col("a").alias("id")).agg(F.min("least").alias("least"), F.max("most").alias("most"))
        pairs = descend(self.up, need, self.down, same, self.fan).join(homes, ["a", "c"], "left_anti")
        more = self._score(ws.write(pairs, f"{name}-pairs"), left, same, k)
        columns = ["key", "slot", "score", "found", "found_key"]
        return ws.write(_best(first.select(columns).union(more.select(columns)), k), name)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", leaf: int = LEAF, group: int = ANCHORS, fan: int = FAN) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of the rows where anchor is true.

    A row's score is its integer inner product with the anchor; higher scores
    come first, ties by smaller id (of equal ids, any fixed order).  An anchor's
    positives are its first ``positives`` other rows of its label; for each, the first
    ``negatives`` rows of other labels with low * positive_score <= 100 *
    negative_score <= high * positive_score come out, rank from 1.  All are
    found exactly.

    vector_col holds integers.  Rows with a null id, label, vector or component
    take no part, nor do rows whose own inner product reaches 2**62, as scores
    would not fit a long.  Vectors of different lengths never meet.  Repeated
    rows are rows of their own.  An anchor without positives, or a positive
    without negatives, gives no row; so does an empty table.

    leaf, group and fan are the sizes of the trees' parts and change no result.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "negatives")
    rows = vectors.select(
        F.size(vector_col).alias("dim"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"),
    )
    usable = "vec_id is not null and label is not null and v is not null and not exists(v, x -> x is null) and aggregate(v, 0d, (s, x) -> s + x * x) < 4.6e18d"
    rows = ws.write(rows.where(usable).withColumn("v", F.col("v").cast("array<int>")), "rows")
    trees, total = {}, 0
    for r in rows.groupBy("dim").count().orderBy("dim").collect():  # a row a length of vectors
        total += r["count"]
        if r["count"] > leaf and r.dim:
            sample = rows.where(F.col("dim") == r.dim).orderBy(F.xxhash64("v", "vec_id"), "vec_id").limit(FIT_ROWS).select("v").toArrow()  # of a stated size
            trees[r.dim] = fit_splits(_matrix(sample["v"].combine_chunks(), np.float64))
    kind = "code int, dim int, vec_id long, label long, anchor boolean, v array<int>"
    coded = rows.mapInArrow(_coded(spark.sparkContext.broadcast(trees)), kind)
    dealt = coded.repartitionByRange(-(-total // (leaf * LEAVES)) or 1, "dim", "code", "vec_id").sortWithinPartitions("dim", "code", "vec_id")
    leaves = ws.write(dealt.mapInArrow(_leaves(leaf, group), _LEAF), "leaves")
    ws.drop("rows")
    counted = leaves.groupBy("part", "anchors").count()  # two rows a range of leaf * LEAVES rows
    before = counted.select("part", "anchors", (F.sum("count").over(Window.partitionBy("anchors").orderBy("part")) - F.col("count")).alias("before"))
    base = before.where("not anchors").select("part", F.col("before").alias("base"))
    leaves = leaves.join(before, ["part", "anchors"]).join(base, "part")
    leaves = leaves.withColumn("homes", F.expr("transform(homes, h -> h + base)")).withColumn("id", F.col("id") + F.col("before")).drop("before", "base", "part")
    leaves = ws.write(leaves, "numbered")
    nothing = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if leaves.where("anchors").isEmpty():
        return nothing
    search = _Search(ws, leaves, fan)
    named = ws.write(search.anchors.select(F.col("id").alias("a"), "keys", "ids").mapInArrow(_unpacked, "a long, key long, anchor_id long"), "named")
    wants = named.select("a", "key", F.lit(0).alias("slot"), F.lit(LOW + 1).alias("least"), F.lit(HIGH).alias("most"))
    good = search.best(wants, True, positives, "positives")
    good = good.select("key", F.col("rank").alias("slot"), F.col("score").alias("positive_score"), F.col("found").alias("positive_id"))
    # 100 * score within low and high per cent, in whole numbers without leaving the range of a long.
    whole = "{0} * (positive_score div 100) + {1}(({0} * (positive_score % 100)) / 100)"
    wants = good.join(named.select("a", "key"), "key").select("a", "key", "slot", F.expr(whole.format(low, "ceil")).alias("least"), F.expr(whole.format(high, "floor")).alias("most"))
    found = search.best(wants.where("least <= most"), False, negatives, "found")
    out = found.select("key", "slot", "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(good, ["key", "slot"]).join(named.select("key", "anchor_id"), "key")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, keys, ids) of leaves to (a, key, id) of rows."""
    for batch in batches:
        for a, keys, ids in zip(batch.column(0), batch.column(1), batch.column(2)):
            k, i = (np.frombuffer(x.as_py(), "<i8") for x in (keys, ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), a.as_py())), pa.array(k), pa.array(i)], names=["a", "key", "anchor_id"])
