"""Tests from cross-products equal the tests on whole columns."""

import numpy as np
import pytest

from tickloom.functions import breaks
from tickloom.operators.stationarity import adf_by_feature, stationary_orders


def table(spark, n=(220, 61, 9, 30)):
    rnd, rows = np.random.default_rng(5), []
    for s, k in zip("abcd", n):
        walk, noise = 500 + np.cumsum(rnd.normal(size=k)), rnd.normal(size=k)
        for i in range(k):
            rows.append((s, i // 3, i, float(walk[i]), None if i % 7 == 3 else float(noise[i]), 4.0 if s == "d" else float("nan") if i % 11 == 0 else float(walk[i] + 0.1 * i)))
    rnd.shuffle(rows)
    rows = [(str(r[0]), int(r[1]), int(r[2]), *(None if x is None else float(x) for x in r[3:])) for r in rows]
    return rows, spark.createDataFrame(rows, "symbol string, ts_ns long, seq long, walk double, noise double, third double").repartition(3)


@pytest.mark.parametrize("rows, lag, trend", [(1000, None, True), (16, None, True), (16, 3, False), (5, 0, True), (1, 2, True)])
def test_against_whole_columns(spark, rows, lag, trend):
    data, df = table(spark)
    got = {(r.symbol, r.feature): r for r in adf_by_feature(df, ["walk", "noise", "third"], lag, trend, rows=rows).collect()}
    assert len(got) == 12
    for s in "abcd":
        part = sorted((r for r in data if r[0] == s), key=lambda r: r[1:3])
        for k, f in enumerate(("walk", "noise", "third")):
            want = breaks.adf(np.array([np.nan if r[3 + k] is None else r[3 + k] for r in part], float), lag, trend)
            r = got[s, f]
            if want["t"] != want["t"]:
                assert r.t is None and r.p is None, (s, f)
                continue
            assert (r.lag, r.n, r.p) == (want["lag"], want["n"], want["p"]), (s, f, r, want)
            assert abs(r.t - want["t"]) < 1e-7 * max(1, abs(want["t"])) and abs(r.aic - want["aic"]) < 1e-6


def test_orders_equal_the_search_by_symbol(spark):
    _, df = table(spark, (220, 90, 40, 30))
    df = df.drop("third")
    got = {(r.symbol, r.feature): r for r in stationary_orders(df, ["walk", "noise"], 0.25, threshold=0.01, rows=50).collect()}
    for f in ("walk", "noise"):
        want = {r.symbol: r.d for r in breaks.optimal_d(df.where(f"{f} is not null"), f, 0.25, threshold=0.01).collect()}
        if f == "walk":
            assert {s: r.d for (s, g), r in got.items() if g == f} == want and len(set(want.values())) > 1
    assert got["a", "noise"].d == 0 and got["a", "noise"].p < 0.05 and abs(got["a", "noise"].corr - 1) < 1e-12


def test_empty(spark):
    _, df = table(spark)
    assert adf_by_feature(df.limit(0), ["walk"]).count() == 0
    assert adf_by_feature(df.where("false").drop("noise"), ["walk", "third"], 2).count() == 0
