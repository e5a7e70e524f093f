"""Word and shingle hashing of Arrow string columns with numpy, whole texts in bounded slices.

A word is a run of bytes other than space and \\x09-\\x0D; A-Z count as a-z.
Hashes are 64 bits wide; two different shingles of one pair of documents share
a hash with a probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in a slice; one longer text makes a slice of its own, whose spans block_hashes hashes HASH_BYTES at a time.
SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240101).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, raw


#: What a task leaves for the next one of the same operator in this Python worker; other operators give the memory back.
KEPT: dict = {}


def release() -> None:
    """Drops what earlier tasks left in this Python worker and gives Arrow's unused memory back."""
    KEPT.clear()
    pa.default_memory_pool().release_unused()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of rows of about limit bytes."""
    if KEPT:
        release()
    offsets, raw = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]]
        i = j


def words(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more entry at the end)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, alike wherever the span stands."""
    n = len(raw)
    if not len(starts):
        return np.zeros(0, np.uint64)
    power = np.full(n + 1, _P, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:n], dtype=np.uint64, out=total[1:])
    back = np.full(n + 1, _P_INV, np.uint64)
    back[0] = 1
    back = np.cumprod(back, dtype=np.uint64)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _Q)


#: Bytes of text whose spans are hashed at a time by block_hashes.
HASH_BYTES = 1 << 20


def block_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hashes of spans that are in order and apart, holding the sums of about HASH_BYTES bytes at a time, or of one longer span."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + HASH_BYTES, "right")), i + 1)
        a, b = int(starts[i]), int(ends[j - 1])
        out[i:j] = span_hashes(raw[a:b], starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def shingles(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its n-word shingles in text order).

    A text of fewer words is one shingle; one without words, or null, has none.
    """
    for row, offsets, raw in slices(column):
        raw = _LOWER[raw]
        starts, ends, heads = words(offsets, raw)
        h = block_hashes(raw, starts, ends)
        acc = np.zeros(max(len(h) - n + 1, 0), np.uint64)
        for k in range(n):
            acc = acc * _Q + h[k : k + len(acc)]
        acc = mix(acc)
        for i in range(len(offsets) - 1):
            a, b = int(heads[i]), int(heads[i + 1])
            if b - a >= n:
                yield row + i, acc[a : b - n + 1]
            elif b > a:
                one = np.uint64(b - a)
                for x in h[a:b]:
                    with np.errstate(over="ignore"):
                        one = one * _P + x
                yield row + i, mix(np.array([one], np.uint64))
            else:
                yield row + i, acc[:0]


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long, bit for bit."""
    return x.astype(np.uint64).view(np.int64)
