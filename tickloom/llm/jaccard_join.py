"""N-gram Jaccard join by parity sketches: every pair at or over the threshold, linked into classes.

A document's set holds its distinct n-word shingles as 64-bit hashes.  Each set
is dealt by hash into the parts of a long bit vector in which every shingle
flips one bit; a part is kept as the XOR of its bits' 64-bit codes.  Two sets
that differ in d shingles differ in at most d parts, so with more parts than the
largest difference the threshold allows for a size band, some part agrees
(pigeonhole).  Equal parts make candidates; a short sketch whose Hamming
distance never exceeds the symmetric difference prunes them; the sets decide.

Losslessness with empty parts: an empty part says nothing, so it is not
emitted.  A band has ``slack`` parts to spare: a pair all of whose equal parts
are empty has more than ``slack`` empty parts on both sides, and such sets go
through further levels dealt by other hashes (the last one emits empty parts).

Copies share one node (a digest of the set) and are never expanded.  Nodes with
equal parts gather in candidate classes; within them sizes and sketches are
compared, which leaves classes of likely links, and within those the sets.  Both
comparisons deal a class by size bands in pairs of blocks (of one band, or of
neighbouring ones), so no group meets in one task, and give a spanning forest of
the links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.llm.text import mix, shingles, signed
from tickloom.llm.workspace import Workspace

#: Nodes of a block whose sketches, or whose sets, are compared with another block's in one task.
SKETCH_BLOCK, BLOCK = 2048, 512
#: Bytes of sets, or of sketches, in a block (a longer set makes one of its own).
BLOCK_BYTES = 8 << 20
#: A table of at most so many ids (16 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
#: Sets that a map task remembers in order to emit copies once.
SEEN = 1_000_000
LEVELS = 6
_WORDS = 16  # 64-bit words of the smallest pruning sketch


class Bands:
    """Size bands for one threshold num/den: partners are in the same or the next band."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.low = num, den, [1, den // num + 1]

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.low, n, "right")) - 1

    @lru_cache(maxsize=None)  # noqa: B019  one object per task
    def scheme(self, band: int) -> tuple[int, int, int]:
        """(largest difference, parts, slack) where the larger set is in the band."""
        self.of(self.low[-1])
        while len(self.low) < band + 2:
            self.of(self.low[-1])
        most = self.low[band + 1] - 1
        diff = 2 * most * (self.den - self.num) // (self.den + self.num)
        slack = 2 + round(2 * (diff + 1) * math.exp(-self.low[max(band - 1, 0)] / (diff + 1)))
        return diff, diff + 1 + slack, slack


def digest(hashes: np.ndarray, seed: int) -> np.uint64:
    """A 64-bit digest of a set, whatever its order."""
    with np.errstate(over="ignore"):
        a = np.bitwise_xor.reduce(mix(hashes + np.uint64(2 * seed + 1)))
        b = np.add.reduce(mix(hashes ^ np.uint64(0xA5A5A5A5 + seed)))
        return mix(np.array([a + mix(np.array([b + np.uint64(len(hashes))]))[0]], np.uint64))[0]


def _parts(hashes: np.ndarray, bands: Bands, band: int) -> list[np.ndarray]:
    """The keys of the parts of one set under the scheme of a band."""
    diff, m, slack = bands.scheme(band)
    out: list[np.ndarray] = []
    if not diff:
        return out  # only equal sets reach the threshold; they are one node
    for level in range(LEVELS):
        h = hashes if not level else np.sort(mix(hashes + np.uint64(level)))
        part = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        code = np.bitwise_xor.reduceat(mix(h), at)
        base = (band << 40) + (level << 34)
        out.append(mix(code ^ mix(part[at] + np.uint64(base))))
        if m - len(at) <= slack:
            break
        if level == LEVELS - 1:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), part[at])
            out.append(mix(empty + np.uint64(base + (1 << 39))))
    return out


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(batch, row, sorted distinct shingle hashes) of every row; the text is the last column."""
    for batch in batches:
        for row, h in shingles(batch.column(batch.num_columns - 1), n):
            yield batch, row, np.unique(h)


def _nodes(n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, node, proof = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
            bits: list[bytes | None] = [None] * batch.num_rows
            for _, row, s in _sets(iter([batch]), n):
                size[row] = len(s)
                if len(s):
                    node[row], proof[row], bits[row] = digest(s, seed), digest(s, seed + 1000), sketch(s).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(signed(node)), pa.array(signed(proof)), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "node", "proof", "sketch"])

    return run


def _keys(n: int, num: int, den: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        rows = 0
        for _, _, s in _sets(batches, n):
            if not len(s) or (node := digest(s, seed)) in seen:
                continue
            if len(seen) < SEEN:
                seen.add(node)
            band = bands.of(len(s))
            for k in (*_parts(s, bands, band), *_parts(s, bands, band + 1)):
                keys.append(k)
                nodes.append(np.full(len(k), node, np.uint64))
                rows += len(k)
            if rows >= 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(x))) for x in (keys, nodes)], names=["key", "node"])
                keys, nodes, rows = [], [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(x))) for x in (keys, nodes)], names=["key", "node"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, node): an edge from each key's first node to every other."""
    last_key = last_hub = None
    for batch in batches:
        key, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        new = np.concatenate(([last_key is None or key[0] != last_key], key[1:] != key[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        hub = np.where(at < 0, last_hub if last_hub is not None else 0, node[np.maximum(at, 0)])
        last_key, last_hub = key[-1], hub[-1]
        pick = node != hub
        if pick.any():
            pairs = np.unique(np.stack([hub[pick], node[pick]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _members(n: int, seed: int):
    """(node, cls, band, blocks, up, down, text) to (cls, band, blocks, up, down, node, set); a row whose text has another digest goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sets = [], []
            for _, row, s in _sets(iter([batch]), n):
                if len(s) and signed(np.array([digest(s, seed)], np.uint64))[0] == batch.column(0)[row].as_py():
                    rows.append(row)
                    sets.append(s.tobytes())
            take = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*take.columns[1:6], take.column(0), pa.array(sets, pa.binary())], names=["cls", "band", "blocks", "up", "down", "node", "members"])

    return run


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity of a set's hashes over a power of two of bits, two to four a member: Hamming distances of sketches never
    exceed symmetric differences.  XOR of its halves is the sketch of half as many bits."""
    bits = 64 * _WORDS << max(0, int(len(s) - 1).bit_length() - 9)
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(s: np.ndarray, words: int) -> np.ndarray:
    while len(s) > words:
        half = len(s) // 2
        s = s[:half] ^ s[half:]
    return s


class _Pairs:
    """Pairs of a group that sizes and sketches allow, where they may still join two trees of its forest."""

    def __init__(self, sizes: np.ndarray, sketches: list[np.ndarray], sides: np.ndarray, num: int, den: int) -> None:
        self.sizes, self.sketches, self.sides, self.num, self.den = sizes, sketches, sides, num, den
        self.words = np.array([len(x) for x in sketches])
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.across = len(np.unique(sides)) > 1
        self.tree = np.arange(len(sizes))

    def after(self, i: int) -> np.ndarray:
        """Rows over i, in another tree, that may link with it; where two sides occur, of the other side."""
        b = np.flatnonzero(self.tree[i + 1 :] != self.tree[i]) + i + 1
        if self.across:
            b = b[self.sides[b] != self.sides[i]]
        lo, hi = np.minimum(self.sizes[b], self.sizes[i]), np.maximum(self.sizes[b], self.sizes[i])
        b = b[self.den * lo >= self.num * hi]
        if not len(b):
            return b
        common, far = np.minimum(self.words[b], self.words[i]), np.zeros(len(b), np.int64)
        for w in np.unique(common).tolist():
            table, place = self.of(w)
            far[common == w] = np.bitwise_count(table[place[b[common == w]]] ^ table[place[i]]).sum(axis=1, dtype=np.int64)
        return b[far * (self.den + self.num) <= (self.den - self.num) * (self.sizes[b] + self.sizes[i])]

    def of(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Sketches of so many words, of the rows whose own may meet that, and each row's place among them."""
        if words not in self.tables:
            rows = np.flatnonzero((self.words >= words) & (self.words <= 4 * words))
            place = np.full(len(self.words), -1)
            place[rows] = np.arange(len(rows))
            self.tables[words] = np.stack([folded(self.sketches[r], words) for r in rows]), place
        return self.tables[words]

    def join(self, i: int, j: int) -> None:
        self.tree[self.tree == self.tree[j]] = self.tree[i]


def likely(sizes: np.ndarray, sketches: list[np.ndarray], sides: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that sizes and sketches allow."""
    pairs, out = _Pairs(sizes, sketches, sides, num, den), []
    for i in range(len(sizes) - 1):
        b = pairs.after(i)
        for j in b[np.unique(pairs.tree[b], return_index=True)[1]].tolist():
            pairs.join(i, j)
            out.append((i, j))
    return out


def linked(sets: list[np.ndarray], sides: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at or over num/den."""
    sizes = np.array([len(s) for s in sets], np.int64)
    pairs, out = _Pairs(sizes, [sketch(s) for s in sets], sides, num, den), []
    for i in range(len(sets) - 1):
        for j in pairs.after(i).tolist():
            if pairs.tree[i] != pairs.tree[j]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if den * both >= num * (sizes[i] + sizes[j] - both):
                    pairs.join(i, j)
                    out.append((i, j))
    return out


def _within(compare):
    """Rows (cls, band, kind, i, j, side, node, ...) sorted by the first five: compare() gives each block pair's forest of links."""

    def flush(group: list[tuple]) -> pa.RecordBatch | None:
        if len(group) < 2:
            return None
        side, node, *rest = zip(*group)
        found = compare(np.array(side), *rest)
        if not found:
            return None
        nodes = np.array(node, np.int64)
        a, b = np.array(found, np.int64).T
        return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:5] != key:
                    if (out := flush(group)) is not None:
                        yield out
                    key, group = row[:5], []
                group.append(row[5:])
        if (out := flush(group)) is not None:
            yield out

    return run


def _block_pairs(members: DataFrame, *columns: str) -> DataFrame:
    """Members of classes dealt to all pairs of blocks of their band (kind 0), and with the next band's blocks (kind 1), side by side."""
    own = "transform(sequence(0, blocks - 1), o -> struct(band, 0 as kind, least(_b, o) as i, greatest(_b, o) as j, _b as side))"
    up = "transform(filter(sequence(0, up), o -> o < up), o -> struct(band, 1 as kind, _b as i, o as j, 0 as side))"
    down = "transform(filter(sequence(0, down), o -> o < down), o -> struct(band - 1 as band, 1 as kind, o as i, _b as j, 1 as side))"
    key = ["cls", "band", "kind", "i", "j"]
    dealt = members.withColumn("_b", F.pmod("node", "blocks").cast("int")).withColumn("_at", F.explode(F.expr(f"concat({own}, {up}, {down})")))
    return dealt.select("cls", "_at.*", "node", *columns).repartition(*key).sortWithinPartitions(*key)


def _with_blocks(label: DataFrame, classes: DataFrame, size: int, bytes_each: float, num: int, den: int) -> DataFrame:
    """(node, n, sketch, rep, cls, band, blocks, up, down): sizes that link are in one band or in neighbours; a class has in each
    band blocks of about size nodes, or BLOCK_BYTES of bytes_each a member of their sets; up and down are those of the bands beside."""
    band = F.floor(F.log("n") / math.log(den / num * 1.000001)).cast("int")  # a little wide, so that rounding parts no pair
    rows = label.join(classes.select("node", "n", "sketch", "rep"), "node").withColumn("band", band)
    need = F.greatest(F.count("*") / size, F.sum("n") * bytes_each / BLOCK_BYTES)
    counts = rows.groupBy("cls", "band").agg(F.ceil(need).cast("int").alias("blocks"))
    beside = lambda k, name: counts.select("cls", (F.col("band") - k).alias("band"), F.col("blocks").alias(name))
    full = counts.join(beside(1, "up"), ["cls", "band"], "left").join(beside(-1, "down"), ["cls", "band"], "left").fillna(0, ["up", "down"])
    return rows.join(full, ["cls", "band"])


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs.

    Two documents link when den * |A & B| >= num * |A | B| over their sets of
    distinct n-word shingles (a text of fewer words is one shingle).
    component_id is the least id reachable by links.

    Null or wordless text: n_shingles 0, linked with nothing, component_id its
    own id.  Null id: the row takes part; it is never the least id unless its
    class has no other (then null).  Repeated rows and ids: each row is
    returned.  Columns besides id and text are not read.  Empty table: no rows.
    """
    ws = Workspace(docs.sparkSession, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seed = 0
    while True:
        table = ws.write(rows.mapInArrow(_nodes(n, seed), "doc_id long, n_shingles long, node long, proof long, sketch binary"), f"nodes{seed}")
        least = table.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("proof").alias("p"), F.max("proof").alias("q"), F.max("n_shingles").alias("n"), F.min("sketch").alias("sketch"))
        classes = ws.write(least, f"classes{seed}")
        if classes.where("p <> q").isEmpty():  # else two different sets share a node: another digest
            break
        ws.drop(f"nodes{seed}", f"classes{seed}")
        seed += 1
    keys = rows.mapInArrow(_keys(n, num, den, seed), "key long, node long")
    stars = keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_stars, "a long, b long")
    label = components(stars, ws, "candidates").toDF("node", "cls")
    members = _with_blocks(label, classes, SKETCH_BLOCK, 0.5, num, den)

    def by_sketch(sides, n, bits):
        return likely(np.array(n, np.int64), [np.frombuffer(x, np.uint64) for x in bits], sides, num, den)

    def by_set(sides, sets):
        return linked([np.frombuffer(x, np.uint64) for x in sets], sides, num, den)

    label = components(_block_pairs(members, "n", "sketch").mapInArrow(_within(by_sketch), "a long, b long"), ws, "likely").toDF("node", "cls")
    wanted = ws.write(_with_blocks(label, classes, BLOCK, 8, num, den).select("node", "cls", "band", "blocks", "up", "down", "rep"), "wanted")
    small = wanted.count() <= BROADCAST_ROWS
    found = rows.join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "cls", "band", "blocks", "up", "down", "text")
    sets = found.mapInArrow(_members(n, seed), "cls long, band int, blocks int, up int, down int, node long, members binary")
    links = components(_block_pairs(sets, "members").mapInArrow(_within(by_set), "a long, b long"), ws, "links").toDF("node", "root")

    home = classes.select("node", "rep").join(links, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = home.groupBy("root").agg(F.min("rep").alias("component_id"))
    home = home.join(least, "root").select("node", "component_id")
    out = table.join(home, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = ws.write(out, "out")
    ws.drop(f"nodes{seed}", f"classes{seed}", "wanted")
    return out


def drop_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are not the least of their class; columns and texts as they were.

    Of a class the row of the least id stays, a null id being the greatest.
    """
    rows = Workspace(docs.sparkSession, "copies").keyed(docs, id_col)
    classes = jaccard_classes(rows, n, num, den, "_row", text_col)
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    small = gone.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if small else gone, F.col("_row") == F.col("_gone"), "left_anti").select(*docs.columns)
