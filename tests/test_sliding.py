"""Sliding order statistics and rolling components against plain windows."""

import numpy as np
import pytest
from test_ranges import close_to, frame, values

from tickloom.functions import entropy, sliding
from tickloom.operators import bars
from tickloom.sources.tapes import events_tape

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [1, 2, 7, 64, 300])
def test_quantiles_of_windows(n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=400), 1)  # ties
    x[rng.random(400) < 0.01] = np.nan
    x[7] = 0.0
    x[8] = -0.0
    qs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = sliding.quantiles_of(x, n, qs)
    for i in range(len(x)):
        v = x[i - n + 1 : i + 1] if i >= n - 1 else x[:0]
        if len(v) == n and not np.isnan(v).any():
            assert np.allclose(got[i], np.quantile(v, qs), atol=1e-12)
        else:
            assert np.isnan(got[i]).all()


@pytest.mark.parametrize("nulls", [False, True])
def test_quantiles_by_symbol_and_by_blocks(spark, nulls):
    df = frame(spark, nulls=nulls)
    a = sliding.sliding_quantiles(df, "close", 6, {"q1": 0.25, "q2": 0.5})
    b = sliding.sliding_quantiles(df, "close", 6, {"q1": 0.25, "q2": 0.5}, rows=11)
    assert a.columns == b.columns == [*df.columns, "q1", "q2"]
    for c in ("q1", "q2"):
        close_to(values(b, c), values(a, c))
    tape: dict = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.symbol), r.ts_ns, r.seq)):
        tape.setdefault(r.symbol, []).append(r)
    want = {}
    for rows in tape.values():
        for i, r in enumerate(rows):
            v = [s.close for s in rows[max(0, i - 5) : i + 1]]
            want[r.symbol, r.ts_ns, r.seq] = None if len(v) < 6 or None in v else float(np.median(v))
    close_to(values(a, "q2"), want)
    median = values(a, "q2")
    bursts = values(sliding.sliding_burst(df, "close", 6, rows=11), "burst")
    assert all((b is None) == (median[k] is None) for k, b in bursts.items()) and any(bursts.values())
    assert sliding.sliding_quantiles(df.limit(0), "close", 6, {"q": 0.5}).count() == 0


def test_quantiles_refuse_what_is_none(spark):
    for n, q in ((0, 0.5), (3, 1.5), (3, -0.1)):
        with pytest.raises(ValueError):
            sliding.sliding_quantiles(frame(spark), "close", n, {"q": q})


@pytest.mark.parametrize("n, window", [(1, 16), (2, 16), (3, 2)])
def test_rolling_components_equal_singular_vectors(spark, n, window):
    b = bars.ohlcv(bars.assign_tick_bars(events_tape(spark, SF), 20))
    columns = ["close", "high", "volume"]
    got = entropy.rolling_pca(b, columns, window, n, "pc", order=("bar_id",)).collect()
    rows: dict = {}
    for r in sorted(got, key=lambda r: (r.symbol, r.bar_id)):
        rows.setdefault(r.symbol, []).append(r)
    seen = 0
    for bars_of in rows.values():
        x = np.array([[r[c] for c in columns] for r in bars_of], float)
        for i, r in enumerate(bars_of):
            if i < window - 1:
                assert r.pc_0 is None
                continue
            axes = np.linalg.svd(x[i - window + 1 : i + 1], full_matrices=False)[2][:n]
            for k, w in enumerate(axes):
                assert abs(abs(r[f"pc_{k}"]) - abs(w @ x[i])) < 1e-6 * np.abs(x[i]).max() and (r[f"pc_{k}"] - w[np.abs(w).argmax()] / np.abs(w).max() * (w @ x[i])) ** 2 < 1e-6
                seen += 1
            assert all(r[f"pc_{k}"] is None for k in range(len(axes), n))
    assert seen > 100
