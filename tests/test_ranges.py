"""Operators dealt by ranges equal those dealt by symbol, whatever the size of a block."""

import random

import numpy as np
import pytest

from tickloom.functions import breaks, entropy, recursive
from tickloom.operators import fold, ranges

ROWS = [1, 7, 1000]


def frame(spark, nulls=False, seed=2):
    rnd, rows = random.Random(seed), []
    for s, n in (("a", 90), ("b", 23), ("c", 1), (None, 12)):
        t, p = 0, 50.0
        for i in range(n):
            t += rnd.choice((0, 0, 1, 5, 400))  # bursts and gaps
            p += rnd.choice((-1, -0.5, 0, 0.5, 1))
            rows.append((s, t, i, None if nulls and rnd.random() < 0.2 else p, p + 1, p - rnd.random(), "x"))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts_ns long, seq long, close double, high double, low double, extra string").repartition(4)


def values(df, name):
    return {(r.symbol, r.ts_ns, r.seq): r[name] for r in df.select("symbol", "ts_ns", "seq", name).collect()}


def close_to(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) <= 1e-9 * max(1, abs(b[k]))), (k, a[k], b[k])


@pytest.mark.parametrize("rows", ROWS)
def test_blocks_number_rows_and_copy_halos(spark, rows):
    df = frame(spark)
    by: dict = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.symbol), r.ts_ns, r.seq)):
        by.setdefault(r.symbol, []).append((r.ts_ns, r.seq))
    want = []
    for s, keys in by.items():
        for i, k in enumerate(keys):
            want += [(s, *k, i, b, b > i // rows) for b in range(i // rows, min((i + 4) // rows, (len(keys) - 1) // rows) + 1)]
    got = [(r.symbol, r.ts_ns, r.seq, r._rn, r._block, r._halo) for r in ranges.blocks(df, rows, 4).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("rows", ROWS)
def test_recursions(spark, rows):
    df = frame(spark)
    close_to(values(ranges.ewma(df, "close", 9, rows=rows), "ewma"), values(recursive.ewma(df, "close", 9), "ewma"))
    close_to(values(ranges.rsi(df, n=5, rows=rows), "rsi"), values(recursive.rsi(df, n=5), "rsi"))
    both = ranges.recursions(df, ewma={"e": ("close", 4)}, atr={"t": 5}, rows=rows)
    close_to(values(both, "e"), values(recursive.ewma(df, "close", 4), "ewma"))
    close_to(values(both, "t"), values(recursive.atr(df, 5), "atr"))
    assert ranges.ewma(df, "close", 9, rows=rows).columns == recursive.ewma(df, "close", 9).columns


@pytest.mark.parametrize("rows", ROWS)
def test_nulls(spark, rows):
    df = frame(spark, nulls=True)
    close_to(values(ranges.ewma(df, "close", 9, rows=rows), "ewma"), values(recursive.ewma(df, "close", 9), "ewma"))
    close_to(values(ranges.ew_std(df, "close", 9, rows=rows), "ewms"), values(recursive.ew_std(df, "close", 9), "ewms"))


@pytest.mark.parametrize("rows", ROWS)
def test_windows(spark, rows):
    def kernel(c):
        x = c["close"]
        return {"m": np.array([x[max(0, i - 4) : i + 1].sum() for i in range(len(x))])}

    df = frame(spark)
    a = ranges.windowed(df, kernel, 5, ["close"], "m double", rows=rows)
    assert a.columns == [*df.columns, "m"]
    close_to(values(a, "m"), values(fold.windowed(df, kernel, 5, ["close"], "m double"), "m"))


@pytest.mark.parametrize("call", [
    lambda d, **k: breaks.csw_cusum(d, "close", 12, 5, **k), lambda d, **k: breaks.adf_rolling(d, "close", 12, **k),
    lambda d, **k: breaks.frac_diff(d, "close", 0.5, 0.05, **k), lambda d, **k: entropy.rolling_pca(d, ["close", "high"], 12, 1, **k),
])
def test_kernels_by_range(spark, call):
    df = frame(spark).where("symbol in ('a', 'b')")
    a, b = call(df), call(df, rows=11)
    assert a.columns == b.columns
    for c in a.columns[len(df.columns) :]:
        close_to(values(b, c), values(a, c))


def test_empty(spark):
    df = frame(spark).limit(0)
    assert ranges.ewma(df, "close", 9).count() == ranges.ew_std(df, "close", 9).count() == ranges.rsi(df).count() == 0
