"""Order-dependent operators over each symbol's rows in bounded memory.

A tape is dealt by symbol and sorted; a task reads its rows as a stream of Arrow
batches and never holds a symbol whole.  ``fold`` carries a state from batch to
batch (threshold bars, filters, recursive averages); ``windowed`` carries the
last ``width - 1`` rows (kernels over a trailing window).  Both keep every row
and add columns to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Arrays = dict[str, np.ndarray]
#: The ordering contract: rows of a symbol by time, then by sequence number.
ORDER = ("ts_ns", "seq")


def sorted_by_symbol(df: DataFrame, by: str = "symbol", order: Sequence[str] = ORDER) -> DataFrame:
    return df.repartition(by).sortWithinPartitions(by, *[c for c in order if c in df.columns])


def _numbers(column: pa.Array) -> np.ndarray:
    """A column as numpy; a null double is NaN."""
    if pa.types.is_floating(column.type):
        return column.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    return column.to_numpy(zero_copy_only=False)


def _runs(batch: pa.RecordBatch, at: int) -> Iterator[tuple[Any, pa.RecordBatch]]:
    """(symbol, rows) of each run of one symbol in a batch."""
    key = batch.column(at).to_pylist()
    start = 0
    for i in range(1, len(key) + 1):
        if i == len(key) or key[i] != key[start]:
            yield key[start], batch.slice(start, i - start)
            start = i


def _columns(out: Arrays, fields: list[T.StructField], schema: pa.Schema) -> list[pa.Array]:
    made = []
    for f in fields:
        x, kind = out[f.name], schema.field(f.name).type
        if isinstance(x, np.ndarray) and x.dtype.kind == "f":
            bad = ~np.isfinite(x) if not pa.types.is_floating(kind) else np.isnan(x)
            made.append(pa.array(np.where(bad, 0, x), mask=bad).cast(kind, safe=False))
        else:
            made.append(pa.array(x, kind))
    return made


def fold(df: DataFrame, start: Callable[[], Any], step: Callable[[Any, Arrays], Arrays], inputs: Sequence[str], outputs: str, by: str = "symbol", order: Sequence[str] = ORDER) -> DataFrame:
    """df with the columns of the DDL string outputs, made by step(state, arrays of the inputs), which may change the state.

    NaN results become null.  Rows with a null symbol are one symbol.
    """
    fields = T.StructType.fromDDL(outputs)
    schema = T.StructType([*df.schema.fields, *fields.fields])
    arrow, at = to_arrow_schema(schema), df.columns.index(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, first = None, None, True
        for batch in batches:
            for key, rows in _runs(batch, at):
                if first or key != current:
                    current, state, first = key, start(), False
                out = step(state, {c: _numbers(rows.column(rows.schema.get_field_index(c))) for c in inputs})
                yield pa.RecordBatch.from_arrays([*rows.columns, *_columns(out, fields.fields, arrow)], schema=pa.schema([*rows.schema, *(arrow.field(f.name) for f in fields.fields)]))

    return sorted_by_symbol(df, by, order).mapInArrow(run, schema)


def windowed(df: DataFrame, kernel: Callable[[Arrays], Arrays], width: int, inputs: Sequence[str], outputs: str, by: str = "symbol", order: Sequence[str] = ORDER, rows: int | None = None) -> DataFrame:
    """df with the columns of outputs, made by kernel over arrays of the inputs; row i may depend on rows i - width + 1 to i.

    With rows, each symbol is dealt in blocks of so many rows (see ``ranges``), so that it takes many tasks; the result is the same.
    """
    if rows:
        from tickloom.operators import ranges

        return ranges.windowed(df, kernel, width, inputs, outputs, order, rows)
    start = lambda: {c: np.zeros(0) for c in inputs}

    def step(tail: Arrays, new: Arrays) -> Arrays:
        whole = {c: np.concatenate((tail[c], new[c])) if len(tail[c]) else new[c] for c in inputs}
        skip = len(tail[inputs[0]])
        out = {c: x[skip:] for c, x in kernel(whole).items()}
        for c in inputs:
            tail[c] = whole[c][max(0, len(whole[c]) - (width - 1)) :] if width > 1 else whole[c][:0]
        return out

    return fold(df, start, step, inputs, outputs, by, order)
