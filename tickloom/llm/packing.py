"""Packing by concatenating and cutting: global token offsets from two prefix sums, then fixed windows.

Pass one writes each document's ids with its offset inside its task's stream.
The tasks' totals (one number a task) give every task's global offset; pass two
cuts each document at the window bounds it crosses.  No row is shuffled, and a
window is full but for the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.tokens import encoded
from tickloom.llm.workspace import Workspace

#: Bytes of ids in a batch on its way out of Python.
OUT_BYTES = 4 << 20


def _streams(path: str, end: int):
    """(doc_id, text) to (part, doc_id, at, ids): at counts the ids before it in the task's stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, size = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        ats: list[int] = []
        ids: list[bytes] = []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(docs, pa.int64()), pa.array(ats, pa.int64()), pa.array(ids, pa.binary())], names=["part", "doc_id", "at", "ids"])

        for batch, row, x in encoded(batches, path, end):
            docs.append(batch.column(0)[row].as_py())
            ats.append(at)
            ids.append(x)
            at += len(x) // 4
            size += len(x)
            if size >= OUT_BYTES:
                yield table()
                docs, ats, ids, size = [], [], [], 0
        if ids:
            yield table()

    return run


def _cut(length: int):
    """(doc_id, at, ids) with global offsets to the pieces between window bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy()
            ids = [x.as_py() for x in batch.column(2)]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            first, last = at // length, (at + n - 1) // length
            row = np.repeat(np.arange(len(n)), last - first + 1)
            window = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
            begin = np.maximum(window * length, at[row])
            stop = np.minimum((window + 1) * length, (at + n)[row])
            start = begin - at[row]
            pieces = [ids[r][4 * a : 4 * b] for r, a, b in zip(row.tolist(), start.tolist(), (stop - at[row]).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(stop - begin), pa.array(pieces, pa.binary()), pa.array(n[row]), pa.array(window), pa.array(begin - window * length)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, end: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all documents in sequences of length tokens.

    ids holds the piece's ids as little-endian unsigned 32-bit integers.  Each
    document's ids end with the end id; start counts its ids before the piece,
    offset the ids before it in its sequence.  Only the last sequence may be
    short (see padded_length).

    Null or empty text: the end id alone.  Null or repeated ids: every row is
    packed as a document.  Other columns are not read.  Empty table: no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    streams = ws.write(rows.mapInArrow(_streams(tokenizer, end), "part int, doc_id long, at long, ids binary"), "streams")
    totals = streams.groupBy("part").agg(F.max(F.col("at") + F.length("ids") / 4).cast("long").alias("n")).orderBy("part").collect()  # a number a task
    before = np.concatenate(([0], np.cumsum([r.n for r in totals])))[:-1].tolist()
    bases = spark.createDataFrame([(r.part, b) for r, b in zip(totals, before)], "part int, base long")
    placed = streams.join(F.broadcast(bases), "part").select("doc_id", F.col("at") + F.col("base"), "ids")
    return placed.mapInArrow(_cut(length), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def padded_length(n: int, length: int = 2048) -> int:
    """The length to which a sequence of n tokens is padded: itself at a power of two, else length."""
    return n if n and not n & (n - 1) else length


def sequences(pieces: DataFrame, pad: int = 0, length: int = 2048) -> DataFrame:
    """(sequence_id, ids array<long>, n_tokens, bounds): the padded sequences and the documents' bounds in them."""

    def build(key, table):
        table = table.sort_by("offset")
        ids = np.frombuffer(b"".join(table["ids"].to_pylist()), "<u4").astype(np.int64)
        full = np.concatenate((ids, np.full(padded_length(len(ids), length) - len(ids), pad, np.int64)))
        return pa.table({"sequence_id": table["sequence_id"][:1], "ids": pa.array([full], pa.list_(pa.int64())), "n_tokens": pa.array([len(ids)], pa.int64()), "bounds": pa.array([table["offset"].to_pylist()], pa.list_(pa.int64()))})

    return pieces.groupBy("sequence_id").applyInArrow(build, "sequence_id long, ids array<long>, n_tokens long, bounds array<long>")
