"""Runs of words that repeat with a period, found on harmonic grids.

A run of period p and at least max(least, times * p) words holds adjacent
multiples of p at which the words p further on are the same.  So for every p
the words at jp and (j + 1)p are compared, all p of one doubling band at once;
what survives a few more probes inside the span that a run must cover is
extended to both sides by comparing chunks of growing size.  Grid points that a
found run covers are skipped: by the periodicity lemma whatever they would find
is that run again, or one whose least period is smaller, since a run of a period
that divides p is found in an earlier band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import block_hashes, slices, words
from tickloom.llm.workspace import bound_batches

#: Grid points compared at a time, words joined at a time, words compared in the first chunk of an extension, bytes of text in a batch on its way out.
POINTS, WORDS, CHUNK, OUT_BYTES = 1 << 20, 1 << 16, 64, 4 << 20


def _agreeing(h: np.ndarray, i: int, p: int, stop: int, step: int) -> int:
    """How many places from i on, in the direction of step and before stop, hold the word that stands p further on."""
    n, size = 0, CHUNK
    room = (stop - i) * step
    while n < room:
        size = min(size, room - n)
        a = i + n if step > 0 else i - n - size + 1
        differ = h[a : a + size] != h[a + p : a + p + size]
        if differ.any():
            return n + (int(differ.argmax()) if step > 0 else size - 1 - int(np.flatnonzero(differ)[-1]))
        n += size
        size *= 2
    return n


def _grids(heads: np.ndarray, low: int, high: int, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, period, place, span) of all grid points with periods in low <= p < high, at most POINTS at a time, by document, period and place."""
    n = np.diff(heads)
    docs = np.flatnonzero(n >= max(least, times * low))
    if not len(docs):
        return
    top = np.minimum(n[docs] // times, high - 1)
    many = top - low + 1
    row = 0
    ends = np.cumsum(many)
    total = int(ends[-1])
    while row < total:  # (document, period) rows, POINTS of them at a time
        r = np.arange(row, min(row + POINTS, total))
        row += len(r)
        d = np.searchsorted(ends, r, "right")
        p = low + r - (ends[d] - many[d])
        d = docs[d]
        span = np.maximum(times - 2, (least - p) // p - 1) * p  # all places of a run's first grid point and span after it agree
        count = (n[d] - 1 - p - span) // p + 1
        done = np.cumsum(np.maximum(count, 0))
        at, all_points = 0, int(done[-1])
        while at < all_points:
            x = np.arange(at, min(at + POINTS, all_points))
            at += len(x)
            k = np.searchsorted(done, x, "right")
            j = x - (done[k] - np.maximum(count[k], 0))
            yield d[k], p[k], heads[d[k]] + j * p[k], span[k]


def runs_of(h: np.ndarray, heads: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of all runs in the word hashes h, by document, start and period; document d holds h[heads[d] : heads[d + 1]]."""
    found: list[tuple[int, int, int, int]] = []
    longest = int(np.diff(heads).max(initial=0))
    low = 1
    while times * low <= longest and longest >= least:
        first = np.sort(np.array([heads[d] + s for d, s, _, _ in found], np.int64))
        by = sorted((int(heads[d] + s), int(heads[d] + s + n)) for d, s, n, _ in found)
        reach = np.maximum.accumulate(np.array([e for _, e in by], np.int64)) if by else first
        last = (-1, 0, 0, 0)  # document, period, from and to of the run found last
        for d, p, x, span in _grids(heads, low, 2 * low, least, times):
            ok = np.flatnonzero(h[x] == h[x + p])
            for at in (span, p, span // 2, np.ones_like(p), span - 1, span // 3, span // 5, 2 * span // 3):
                y = x[ok] + np.clip(at[ok], 0, span[ok])
                ok = ok[h[y] == h[y + p[ok]]]
            if len(ok) and len(first):  # grid points within runs found in earlier bands
                k = np.searchsorted(first, x[ok], "right") - 1
                ok = ok[(k < 0) | (reach[k] <= x[ok] + 2 * p[ok])]
            for doc, q, y, m in zip(d[ok].tolist(), p[ok].tolist(), x[ok].tolist(), span[ok].tolist()):
                if last[:2] == (doc, q) and last[2] <= y < last[3] - q:
                    continue
                a, b = int(heads[doc]), int(heads[doc + 1])
                start = y - _agreeing(h, y - 1, q, a - 1, -1)
                stop = y + _agreeing(h, y, q, b - q, 1) + q
                last = (doc, q, start, stop)
                if stop - q > y + m and stop - start >= max(least, times * q):  # else a found run's end, or too short
                    found.append((doc, start - a, stop - start, q))
        low *= 2
    return sorted(found, key=lambda r: (r[0], r[1], r[3]))


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """The words outside of every run's repeats (its words after the first period)."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.flatnonzero(np.cumsum(edge[:n]) == 0)


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words between starts and ends, joined by one space."""
    parts = []
    for i in range(0, len(starts), WORDS):
        a, n = starts[i : i + WORDS], ends[i : i + WORDS] - starts[i : i + WORDS] + 1
        stop = np.cumsum(n)
        where = np.repeat(a - (stop - n), n) + np.arange(stop[-1])
        where[stop - 1] = 0
        out = raw[where]
        out[stop - 1] = 32
        parts.append(out.tobytes())
    return b"".join(parts)[:-1]


def _repeated(n: int, seed: int) -> np.ndarray:
    """Which original word stands at each of n places once the text from word g % n on repeats its words, g being seed // 10."""
    g, i = seed // 10, np.arange(n)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(i < a, i, a + (i - a) % p)


def _found(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, ids = batch.column(2).to_pylist(), batch.column(0)
            rows, texts, found, size = [], [], [], 0

            def out() -> pa.RecordBatch:
                run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(found, run_type), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

            for row, offsets, raw in slices(batch.column(1)):
                starts, ends, heads = words(offsets, raw)
                h = block_hashes(raw, starts, ends)
                for i in range(len(offsets) - 1):
                    a, b = int(heads[i]), int(heads[i + 1])
                    if seeds[row + i] is not None and b > a:
                        order = a + _repeated(b - a, seeds[row + i])
                        starts[a:b], ends[a:b], h[a:b] = starts[order], ends[order], h[order]
                of: dict[int, list] = {}
                for d, *r in runs_of(h, heads, least, times):
                    of.setdefault(d, []).append(tuple(r))
                for i in range(len(offsets) - 1):
                    a, b = int(heads[i]), int(heads[i + 1])
                    mine = of.get(i, [])
                    keep = a + _kept(b - a, mine) if mine else slice(a, b)
                    rows.append(row + i)
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in mine])
                    texts.append(_joined(raw, starts[keep], ends[keep]).decode())
                    size += b - a
                    if size * 8 > OUT_BYTES:
                        yield out()
                        rows, texts, found, size = [], [], [], 0
            if rows:
                yield out()

    return run


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text", repeat: Column | None = None) -> DataFrame:
    """(doc_id, runs, collapsed): the periodic runs of each whole text and the text without their repeats, one row a row of docs.

    A word is a run of bytes other than space and \\x09-\\x0D.  runs holds
    (start, length, period), by start and period: stretches of consecutive words,
    numbered from 0, whose least period is period, of at least ``least`` words
    and ``times`` periods (three or more), that no neighbouring word extends.  collapsed joins by one
    space the words that stand in no run, or in the first period only of all runs
    that hold them.

    Null or empty text, or one without words: no runs and an empty text.  Null or
    repeated ids: every row is judged.  A text of any length is judged whole.
    Other columns are not read.  Empty table: no rows.

    ``repeat``, for planted rows: a column of numbers; where it is not null, the
    text's words are first made periodic from a word on by ``_repeated``.
    """
    if times < 3:
        raise ValueError("a run has three periods at least")
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.lit(None) if repeat is None else repeat).cast("long").alias("repeat"))
    return rows.mapInArrow(_found(least, times), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
