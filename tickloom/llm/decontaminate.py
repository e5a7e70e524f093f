"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their set of five-word shingles.  An item
of q shingles is indexed by its least-hash shingles, as many as its partition
needs: more than the (1 - threshold) * q that a document may lack, so a document
that contains the item holds at least one of them.  Such hits are verified with
the exact count of the item's shingles in the document.

The items are a stated query set: they go to the tasks in blocks of bounded
size, each block against all documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.jaccard_join import BROADCAST_ROWS
from tickloom.llm.text import shingles
from tickloom.llm.workspace import Workspace, bound_batches

#: Bytes of item texts in a block; the documents are read once for each block.
ITEM_BYTES = 16 << 20
_MASK_BITS = 20


class ItemIndex:
    """The items of one block: sorted shingle sets and the table of their least hashes."""

    def __init__(self, ids: list[int], texts: list[str | None], n: int, num: int, den: int) -> None:
        self.n, self.num, self.den = n, num, den
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        lengths = [len([w for w in (t or "").translate(_SPACES).split(" ") if w]) for t in texts]
        for row, h in shingles(pa.array(texts, pa.large_string()), n):
            if lengths[row] >= n:
                self.ids.append(ids[row])
                self.sets.append(np.unique(h))
        # items of fewer words: by their number, the sorted hashes of whole items and their ids
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for q in sorted({k for k in lengths if 0 < k < n}):
            rows = [i for i, k in enumerate(lengths) if k == q]
            whole = np.array([h[0] for _, h in shingles(pa.array([texts[i] for i in rows], pa.large_string()), q)], np.uint64)
            order = np.argsort(whole, kind="stable")
            self.short[q] = whole[order], np.array(rows)[order]
        self.all_ids = ids
        keys, owners = [], []
        for k, s in enumerate(self.sets):
            part = 1 << int(len(s)).bit_length()  # sizes under this bound share a partition
            least = s[: min(len(s), (part - 1) * (den - num) // den + 1)]
            keys.append(least)
            owners.append(np.full(len(least), k))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owners = self.keys[order], self.owners[order]
        self.mask = np.zeros(1 << _MASK_BITS, bool)
        self.mask[(self.keys & np.uint64((1 << _MASK_BITS) - 1)).astype(np.int64)] = True

    def search(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, its shingles, those in the document) of every contained item."""
        hits = h[self.mask[(h & np.uint64((1 << _MASK_BITS) - 1)).astype(np.int64)]]
        if not len(hits):
            return []
        lo, hi = np.searchsorted(self.keys, hits, "left"), np.searchsorted(self.keys, hits, "right")
        found = {int(k) for a, b in zip(lo[hi > lo], hi[hi > lo]) for k in self.owners[a:b]}
        if not found:
            return []
        own, out = np.unique(h), []
        for k in sorted(found):
            s = self.sets[k]
            at = np.minimum(np.searchsorted(own, s), len(own) - 1)
            both = int((own[at] == s).sum())
            if self.den * both >= self.num * len(s):
                out.append((self.ids[k], len(s), both))
        return out


    def search_short(self, q: int, h: np.ndarray) -> list[tuple[int, int, int]]:
        """The same of the items of q words, fewer than n, from a document's runs of q words."""
        keys, rows = self.short[q]
        return [(self.all_ids[i], 1, 1) for i in rows[np.isin(keys, h)].tolist()]


_SPACES = dict.fromkeys(range(9, 14), " ")


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        for batch in batches:
            out = [(row, *x) for row, h in shingles(batch.column(1), items.n) for x in items.search(h)]
            for q in items.short:
                out += [(row, *x) for row, h in shingles(batch.column(1), q) for x in items.search_short(q, h)]
            if out:
                rows, ids, sizes, both = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (ids, sizes, both))], names=["doc_id", "item_id", "item_shingles", "shared"])

    return run


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) of each item with num/den of its n-word shingles in a document.

    An item of fewer than n words is one shingle, its whole word sequence.  Items
    without words, or null, are never found; documents without words hold none.  A null id is returned as it is; repeated
    rows of either table give repeated rows.  Empty tables: no rows.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // ITEM_BYTES
    parts = []
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        got = block.collect()  # one block: about ITEM_BYTES
        index = spark.sparkContext.broadcast(ItemIndex([r.id for r in got], [r.text for r in got], n, num, den))
        parts.append(rows.mapInArrow(_search(index), "doc_id long, item_id long, item_shingles long, shared long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that contain an item, whatever their ids; columns and texts as they were."""
    ws = Workspace(docs.sparkSession, "decontaminate")
    rows = ws.keyed(docs, id_col)
    gone = ws.write(contained_items(rows, items, n, num, den, "_row", text_col).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    small = gone.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if small else gone, F.col("_row") == F.col("_gone"), "left_anti").select(*docs.columns)
