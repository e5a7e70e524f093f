"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Documents are dealt by ranges of doc_id and sorted; each range is encoded once
and written as files of whole documents.  A file ranks its ids by how often all
its documents use them (rank 0 is the most frequent) and codes each rank in one
to four bytes, with the length in two bits of a control byte:

    magic "TKF1", documents (u32), distinct ids (u32), control bytes (u32), data bytes (u32), crc32 of the rest (u32),
    doc ids (i64 each), flags (u8 each, 1: the id is null), ids of each document (u32 each),
    id of each rank (u32 each), control bytes, data bytes

all little-endian.  Files are cells of a Parquet table, so any file system that
Spark writes will do and its commit protocol guards them.  Reading looks the
four lengths of a control byte up in a table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.tokens import encoded
from tickloom.llm.workspace import bound_batches

MAGIC = b"TKF1"
#: Ids in a file (a longer document makes one of its own), and text bytes aimed at in a doc_id range.
FILE_IDS, RANGE_BYTES = 4 << 20, 32 << 20
_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_FILE = "part int, file int, before long, n_tokens long, content binary"


def code(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros((len(ranks) + 3) // 4 * 4, np.uint8)
    padded[: len(ranks)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks that code() was given."""
    size = _LENGTHS[control].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_file(docs: list[int | None], texts: list[bytes]) -> bytes:
    """One file of the documents' ids, given as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(texts), "<u4")
    count = np.bincount(ids)
    used = np.flatnonzero(count)
    ranked = used[np.lexsort((used, -count[used]))].astype("<u4")
    rank_of = np.zeros(len(count), np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    control, data = code(rank_of[ids])
    rest = b"".join((
        np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is None for d in docs], np.uint8).tobytes(),
        np.array([len(t) // 4 for t in texts], "<u4").tobytes(), ranked.tobytes(), control, data,
    ))
    return MAGIC + np.array([len(docs), len(ranked), len(control), len(data), zlib.crc32(rest)], "<u4").tobytes() + rest


def unpack_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Doc ids, which of them are null, ids of each document, and all ids."""
    n, n_ranks, n_control, n_data, crc = np.frombuffer(raw, "<u4", 5, 4).tolist()
    if raw[:4] != MAGIC or zlib.crc32(memoryview(raw)[24:]) != crc:
        raise ValueError("a file of token ids is damaged")
    counts = np.frombuffer(raw, "<u4", n, 24 + 9 * n).astype(np.int64)
    at = 24 + 13 * n
    id_of = np.frombuffer(raw, "<u4", n_ranks, at)
    at += 4 * n_ranks
    ranks = decode(np.frombuffer(raw, np.uint8, n_control, at), np.frombuffer(raw, np.uint8, n_data, at + n_control), int(counts.sum()))
    return np.frombuffer(raw, "<i8", n, 24), np.frombuffer(raw, np.uint8, n, 24 + 8 * n).astype(bool), counts, id_of[ranks]


def _files(path: str, end: int):
    """Rows sorted by doc_id to files; before counts the ids of the range's earlier files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, before, ids = TaskContext.get().partitionId(), 0, 0, 0
        docs: list[int | None] = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([before], pa.int64()), pa.array([ids], pa.int64()), pa.array([pack_file(docs, held)], pa.binary())],
                names=["part", "file", "before", "n_tokens", "content"],
            )

        for batch, row, x in encoded(batches, path, end):
            if held and ids + len(x) // 4 > FILE_IDS:
                yield flush()
                file, before, ids = file + 1, before + ids, 0
                docs.clear()
                held.clear()
            docs.append(batch.column(0)[row].as_py())
            held.append(x)
            ids += len(x) // 4
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all documents, in ascending doc_id order, as files under path.

    Null or empty text: the end id alone.  Null ids come first; rows that share
    an id stand side by side.  Other columns are not read.  Empty table: no files.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.repartitionByRange(1 + total // RANGE_BYTES, "doc_id").sortWithinPartitions("doc_id")
    files = dealt.mapInArrow(_files(tokenizer, end), _FILE)
    files.write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for before, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            docs, null, counts, ids = unpack_file(content.as_py())
            ends = np.cumsum(counts)
            offsets = np.concatenate(([0], 4 * ends)).astype(np.int32)
            cells = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(docs, mask=null), pa.array(before + ends - counts), pa.array(counts), cells], names=["doc_id", "start", "n_tokens", "ids"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document: start counts the ids of all documents before it."""
    files = spark.read.schema(_FILE).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a number a range
    bases = np.concatenate(([0], np.cumsum([r.n for r in totals])))[:-1].tolist()
    bases = spark.createDataFrame([(r.part, b) for r, b in zip(totals, bases)], "part int, base long")
    placed = files.join(F.broadcast(bases), "part").select(F.col("before") + F.col("base"), "content")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")
