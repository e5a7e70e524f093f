"""Substring deduplication by content-defined chunking with a gear rolling hash.

A chunk ends where a gear hash of the last 16 bytes falls under a threshold, or
is the least of the hashes around it (which cuts text that repeats a phrase too),
so an insertion moves the cuts around it and no others.  Chunks are compared by
digest; a chunk is repeated where a lower document id holds the same bytes.
Runs of neighbouring repeated chunks that hold enough words are the repeated
passages: the first document keeps its copy, the others lose theirs.

Chunks are pre-aggregated before the shuffle: of the documents of a batch that
hold a digest only the lowest is dealt by it, since the others already know a
lower one; they are dealt at random.  So a passage of a third of all documents
does not meet in one task.  A sorted stream with constant state finds each
digest's first document among the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.jaccard_join import BROADCAST_ROWS
from tickloom.llm.text import block_hashes, mix, signed, slices, words
from tickloom.llm.workspace import Workspace, bound_batches

#: Bytes for each cut by the threshold; longer chunks than LONGEST bytes are cut there.
MEAN, LONGEST = 18, 1 << 15
#: Bytes that the hash reads, and bytes before and after within which the least hash makes a cut.
WINDOW, AROUND = 16, 64
#: Words that a run of repeated chunks must hold.  Up to a chunk is lost at either end of a passage.
MIN_WORDS = 30
#: Words from which a repeated chunk surely belongs to its run.
SURE = 4
#: Bits of the length in characters and of the number of words of a chunk in its place.
_SIZE, _WORDS = 16, 15
_GEAR = np.random.default_rng(7).integers(0, 1 << 16, 256, dtype=np.uint16)
#: Bytes whose hashes are held at a time, and the bytes on either side that a cut depends on.
SEGMENT, _MARGIN = 1 << 20, 2 * AROUND + 64
_NO_ID = -(1 << 63)


def _least_around(h: np.ndarray) -> np.ndarray:
    """Where a hash is the least of the AROUND - 1 on either side, and less than each of the 8 before it.

    Such places lie under the threshold anyway but in text that repeats few hashes.
    """
    low, span, least = h, 1, np.zeros(len(h), bool)
    while span < AROUND and span < len(h):  # low[i] is the least of the last span hashes
        low = np.concatenate((low[:span], np.minimum(low[span:], low[:-span])))
        span *= 2
        if span == 8:
            least[8:] = h[8:] < low[7:-1]
    ahead = np.concatenate((low[span - 1 :], np.full(min(span - 1, len(h)), h.min() if len(h) else 0, h.dtype)))
    return least & (h == low) & (h == ahead)


def _hash_cuts(raw: np.ndarray) -> np.ndarray:
    """Where the gear hash cuts: under the threshold or the least around."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8):  # sums over 2, 4, 8, 16 bytes
        shifted = h.copy()
        h[k:] += shifted[:-k] << np.uint16(k)
    return (h < np.uint16((1 << 16) // MEAN)) | _least_around(h)


def chunk_ends(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Ends of all chunks of the texts, each text's end included; no cut falls inside a character."""
    n = len(raw)
    cut = np.zeros(n, bool)
    for at in range(0, n, SEGMENT):
        a, b = max(at - _MARGIN, 0), min(at + SEGMENT, n)
        cut[at:b] = _hash_cuts(raw[a : b + _MARGIN])[at - a : b - a]
    cut[:-1] &= (raw[1:] & 0xC0) != 0x80
    for k in range(WINDOW - 1):  # the hash still reaches into the text before
        at = offsets[:-1] + k
        cut[at[at < np.minimum(offsets[1:], n)]] = False
    ends = offsets[1:][np.diff(offsets) > 0]
    cut[ends - 1] = True
    at = np.flatnonzero(cut) + 1
    size = np.diff(np.concatenate(([0], at)))
    if len(at) and size.max() > LONGEST:
        more = []
        for end, k in zip(at[size > LONGEST].tolist(), size[size > LONGEST].tolist()):
            for x in range(end - k + LONGEST, end, LONGEST):
                while (raw[x] & 0xC0) == 0x80:
                    x -= 1
                more.append(x)
        at = np.unique(np.concatenate((at, np.array(more, np.int64))))
    return at


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (digest, doc_id, place, first): place holds start, length in characters and words of the chunk.

    first is the lowest document of the batch that holds the chunk, null on that
    document's own rows; a row with a first has a random digest.
    """
    for batch in batches:
        ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        parts = []
        for row, offsets, raw in slices(batch.column(1)):
            if not len(raw):
                continue
            ends = chunk_ends(offsets, raw)
            starts = np.concatenate(([0], ends[:-1]))
            doc = np.searchsorted(offsets, starts, "right") - 1
            size = np.add.reduceat(((raw & 0xC0) != 0x80).view(np.uint8), starts, dtype=np.int64)  # characters of each chunk
            chars = np.cumsum(size) - size
            first = words(offsets, raw)[0]
            count = np.diff(np.searchsorted(first, np.concatenate(([0], ends))))
            place = ((chars - chars[np.searchsorted(starts, offsets[doc])]) << (_SIZE + _WORDS)) | (size << _WORDS) | count
            parts.append((block_hashes(raw, starts, ends), ids[row + doc], place))
        if not parts:
            continue
        digest, doc, place = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, digest))
        digest, doc, place = digest[order], doc[order], place[order]
        lowest = doc[np.maximum.accumulate(np.where(np.concatenate(([True], digest[1:] != digest[:-1])), np.arange(len(digest)), 0))]
        later = doc != lowest
        digest[later] = mix(digest[later] ^ mix(doc[later].view(np.uint64) + place[later].view(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(signed(digest)), pa.array(doc), pa.array(place), pa.array(lowest, mask=~later)], names=["digest", "doc_id", "place", "first"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (digest, doc_id): those with a first, and those whose digest a lower document has, with the lowest one."""
    last = owner = None
    for whole in batches:
        known = whole.filter(whole.column(3).is_valid())
        if known.num_rows:
            yield pa.RecordBatch.from_arrays([known.column(1), known.column(2), known.column(3)], names=["doc_id", "place", "first"])
        batch = whole.filter(whole.column(3).is_null())
        digest, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(digest):
            continue
        new = np.concatenate(([last is None or digest[0] != last], digest[1:] != digest[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(digest)), -1))
        first = np.where(at < 0, 0 if owner is None else owner, doc[np.maximum(at, 0)])
        last, owner = digest[-1], first[-1]
        pick = np.flatnonzero(doc != first)
        if len(pick):
            yield pa.RecordBatch.from_arrays([pa.array(doc[pick]), batch.column(2).take(pa.array(pick)), pa.array(first[pick])], names=["doc_id", "place", "first"])


class _Run:
    """A run of adjoining repeated chunks of one document.

    Its owner is that of its longest chunk.  A chunk of under SURE words may be elsewhere by accident: such chunks at either
    end of the run are left out as far as their owner is another.
    """

    def __init__(self, doc: int, start: int) -> None:
        self.doc, self.start, self.end, self.longest, self.owner = doc, start, start, -1, doc
        self.core: int | None = None  # where the first sure chunk starts
        self.core_end = start  # where the last one ends
        self.words, self.lead_words, self.trail_words = 0, 0, 0  # words of the sure chunks and between them, before and after
        self.lead: dict[int, tuple[int, int]] = {}  # where an owner's first chunk before the core starts, words before it
        self.trail: dict[int, tuple[int, int]] = {}  # where an owner's last chunk after the core ends, words up to there

    def add(self, size: int, count: int, owner: int) -> None:
        if size > self.longest:
            self.longest, self.owner = size, owner
        if count >= SURE:
            if self.core is None:
                self.core = self.end
            self.words += self.trail_words + count
            self.core_end, self.trail_words = self.end + size, 0
            self.trail.clear()
        elif self.core is None:
            self.lead.setdefault(owner, (self.end, self.lead_words))
            self.lead_words += count
        else:
            self.trail_words += count
            self.trail[owner] = self.end + size, self.trail_words
        self.end += size

    def passage(self) -> tuple[int, int, int, int, int]:
        if self.core is None:  # no sure chunk
            return self.doc, self.start, self.end, self.lead_words, self.owner
        start, before = self.lead.get(self.owner, (self.core, self.lead_words))
        end, after = self.trail.get(self.owner, (self.core_end, 0))
        return self.doc, start, end, self.words + self.lead_words - before + after, self.owner


def _runs(min_words: int):
    """Rows sorted by (doc_id, place): runs of adjoining chunks with min_words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Run | None = None
        out: list[tuple[int, int, int, int, int]] = []

        def close() -> None:
            if state and (found := state.passage())[3] >= min_words:
                out.append(found)

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["doc_id", "start", "end", "n_words", "first_doc_id"])

        for batch in batches:
            for doc, place, owner in zip(*(c.to_pylist() for c in batch.columns)):
                start, size, count = place >> (_SIZE + _WORDS), (place >> _WORDS) & ((1 << _SIZE) - 1), place & ((1 << _WORDS) - 1)
                if state is None or state.doc != doc or start > state.end:
                    close()
                    state = _Run(doc, start)
                if start == state.end:  # a repeated row starts before it and adds nothing
                    state.add(size, count, owner)
            if out:
                yield table()
                out.clear()
        close()
        if out:
            yield table()

    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id): the passages that a document of a lower id also has.

    start and end are character offsets, end exclusive; n_words counts words
    that begin in the passage.  Its chunks are repeated by 64-bit digest; repeats
    within one document are left alone.  first_doc_id is a document of a lower id
    with the longest chunk of the passage, not always the lowest one: which, may
    depend on how the documents are dealt to batches.

    Null or empty text: no rows.  Rows with one id, or with a null id, count as
    one document (a null id is the lowest).  Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = rows.mapInArrow(_chunks, "digest long, doc_id long, place long, first long")
    again = chunks.repartition("digest").sortWithinPartitions("digest", "doc_id").mapInArrow(_repeated, "doc_id long, place long, first long")
    runs = again.repartition("doc_id").sortWithinPartitions("doc_id", "place").mapInArrow(_runs(min_words), "doc_id long, start long, end long, n_words long, first_doc_id long")
    known = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return runs.select(known("doc_id"), "start", "end", "n_words", known("first_doc_id"))


def cut_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every repeated passage cut from all documents but its first; a document left without words goes.

    Columns are those of docs; n_chars, where there is one, is counted anew in
    the cut documents.  Documents without repeats, empty ones too, stay as they are.
    Each row is a document of its own, whatever its id; a null id is the lowest.
    """
    ws = Workspace(docs.sparkSession, "substring")
    rows = ws.keyed(docs, id_col, nulls_first=True)
    spans = repeated_passages(rows, min_words, "_row", text_col)
    spans = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_cut")).toDF("_id", "_cut")
    spans = ws.write(spans, "spans")
    small = spans.count() <= BROADCAST_ROWS
    both = rows.join(F.broadcast(spans) if small else spans, F.col("_row") == F.col("_id"), "left")
    text = f"`{text_col}`"
    kept = F.expr(
        f"array_join(transform(sequence(0, size(_cut)), i -> substring({text}, if(i = 0, 0, element_at(_cut, i).end) + 1, "
        f"if(i < size(_cut), element_at(_cut, i + 1).start, char_length({text})) - if(i = 0, 0, element_at(_cut, i).end))), '')"
    )
    both = both.withColumn(text_col, F.when(F.col("_cut").isNull(), F.col(text_col)).otherwise(kept))
    both = both.where(F.col("_cut").isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        both = both.withColumn("n_chars", F.when(F.col("_cut").isNull(), F.col("n_chars")).otherwise(F.char_length(text_col).cast(kind)))
    return both.select(*docs.columns)
