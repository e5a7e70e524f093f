"""Deep screening against plain loops over pandas, and its edges."""

import numpy as np
import pandas as pd
import pytest

from tickloom.functions.rolling import BARS
from tickloom.operators import backtest
from tickloom.operators.screening import collapse, deep_metrics, nearest_label, screen

RATES = [{"rate": 0.1, "k": 0.05}, {"rate": 0.2, "k": 0.02}]
COMBOS = backtest.deep_grid(backtest.light_grid((0.1, 0.2), (3, 5), (8,)), (2, 7))
DAY = 86_400_000_000_000


def series(n=160, seed=1):
    rnd = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rnd.normal(size=n) * 0.02))
    t = np.cumsum(rnd.integers(1, 9, n)) * (DAY // 4)
    side = np.where(rnd.random(n) < 0.3, 0, np.sign(rnd.normal(size=n))).astype(int)
    return pd.DataFrame({"symbol": "a", "bar_id": range(n), "ts_ns": t, "open": close * (1 + rnd.normal(size=n) * 0.001), "close": close, "side": side})


def cusum(close, k):
    up = down = 0.0
    out = []
    for i in range(1, len(close)):
        x = np.log(close[i] / close[i - 1])
        up, down = max(0, up + x), min(0, down + x)
        if down < -k:
            out.append(i)
            down = 0.0
        elif up > k:
            out.append(i)
            up = 0.0
    return out


def sides(close, fast, slow):
    f, s = (close.ewm(span=n, adjust=False).mean() for n in (fast, slow))
    return np.where(f > s, 1, -1)


def plain(p, k, fast, slow, v, exit_="reverse", hold=20):
    close, label = p["close"], p["side"].to_numpy()
    ev, dma, n = cusum(close.to_numpy(), k), sides(close, fast, slow), len(p)
    c = np.zeros(n)
    for e in ev:
        c[e : e + v + 1] += 1
    out = {"uniqueness": np.mean([np.mean(1 / c[e : e + v + 1]) for e in ev])}
    days = pd.Series([t // DAY for t in p["ts_ns"].iloc[ev]])
    out["turnover"] = len(ev) / ((p["ts_ns"].iloc[-1] - p["ts_ns"].iloc[0]) // DAY / 365.25) * days.value_counts().mean()
    vol = close.pct_change().ewm(span=20).std()
    rates = []
    for mask in (vol > vol.median(), vol <= vol.median()):
        met = [e for e in ev if mask[e] and label[e]]
        rates += [np.mean([dma[e] == label[e] for e in met])] if met else []
    out["stability"] = 1 - np.std(rates) if len(rates) == 2 else 0.0
    met = [e for e in ev if label[e]]
    out["recall"] = (tp := sum(dma[e] == label[e] for e in met)) / (tp + (label != 0).sum() - len(met))
    at = int(n * 0.7)
    q = p.iloc[at:].reset_index(drop=True)
    ev, dma, label = cusum(q["close"].to_numpy(), k), sides(q["close"], fast, slow), q["side"].to_numpy()
    met = [e for e in ev if label[e]]
    tp = sum(dma[e] == label[e] for e in met)
    out["oos_recall"] = tp / (tp + (label != 0).sum() - len(met)) if met else 0.0
    trades, pos = [], None
    for e in ev:
        if pos:
            leave = dma[e] != pos[0] if exit_ == "reverse" else e - pos[1] >= hold
            price = q["close"][e] if e == ev[-1] else q["open"][e] if leave else None
            if price is not None:
                trades.append((price - pos[2]) * pos[0] - (pos[2] + price) * 0.001 - 2 * 0.05)
                pos = None
        if pos is None:
            pos = (dma[e], e, q["open"][e])
    x = pd.Series(trades, dtype=float)
    out |= {"trade_count": len(x), "net_pnl": x.sum(), "sharpe": x.mean() / x.std(ddof=0) if len(x) > 1 else 0.0, "mdd": (x.cumsum() - x.cumsum().cummax()).min() if len(x) else 0.0}
    return out


@pytest.mark.parametrize("exit_, hold", [("reverse", 20), ("hold", 3)])
def test_metrics_against_plain_loops(spark, exit_, hold):
    a, b = series(160, 1), series(90, 2).assign(symbol="b")
    df = spark.createDataFrame(pd.concat([a, b]))
    got = deep_metrics(df.drop("side"), df.select("symbol", "ts_ns", "side"), RATES, COMBOS, exit_=exit_, hold=hold, commission=0.001, slippage=0.05).collect()
    assert len(got) == 2 * len(COMBOS)
    k = {r["rate"]: r["k"] for r in RATES}
    for r in got:
        for name, v in plain(a if r.symbol == "a" else b, k[r.rate], r.fast, r.slow, r.vertical_bars, exit_, hold).items():
            assert abs(r[name] - v) < 1e-9, (r.combo_id, name, r[name], v)
    assert any(r.trade_count > 3 for r in got) and not any(r.oos_unreliable for r in got)


def test_few_labels_are_unreliable_and_one_row_stays_a_base(spark):
    a = series(160, 3)
    df = spark.createDataFrame(a)
    deep = deep_metrics(df.drop("side"), df.select("symbol", "ts_ns", "side").where("bar_id < 120"), RATES, COMBOS)
    assert all(r.oos_unreliable and r.oos_recall == 0 for r in deep.collect())
    best = screen(deep).collect()
    assert sorted(r.rank for r in best) == [1, 2, 3, 4] and len({r.base_combo_id for r in best}) == 4
    assert {r.reason for r in best} <= {"low_oos_recall"} and all(r.score < -1 for r in best)
    kept = {r.base_combo_id: r for r in collapse(deep).collect()}
    for r in deep.collect():  # without held-out differences the more unique horizon stays
        assert kept[r.base_combo_id].uniqueness >= r.uniqueness


def test_no_events_and_no_rows(spark):
    df = spark.createDataFrame(series(40, 4))
    none = deep_metrics(df.drop("side"), df.select("symbol", "ts_ns", "side"), [{"rate": 0.1, "k": 99.0}, {"rate": 0.2, "k": 99.0}], COMBOS).collect()
    assert all(r.low_info and (r.events, r.trade_count, r.turnover, r.stability) == (0, 0, 0.0, 0.0) for r in none) and len(none) == 8
    empty = df.limit(0)
    assert deep_metrics(empty.drop("side"), empty.select("symbol", "ts_ns", "side"), RATES, COMBOS).count() == 0


def test_nearest_label(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 10, 14, 15, 16, 40)], "symbol string, ts_ns long")
    trend = spark.createDataFrame([("a", 10, 1), ("a", 12, 0), ("a", 20, -1)], "symbol string, ts_ns long, side int")
    got = {r.ts_ns: r._label and (r._label.side, r._label.ts_ns) for r in nearest_label(rows, trend, 6).collect()}
    assert got == {0: None, 10: (1, 10), 14: (1, 10), 15: (1, 10), 16: (-1, 20), 40: None}
    assert BARS.order == ("bar_id",)
