"""Back-tests that leave at the label's touch, developing profiles, splits, expanding differences: against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.breaks import expanding, ffd_weights
from tickloom.operators import backtest, bars, validation

MINUTE = 60 * 10**9


def market(spark, signals, n=8):
    """n bars of one symbol that rise by 1; signals maps a row to (side, touch, meta, prob)."""
    rows = [("a", i * MINUTE, i, 100.0 + i, 100.0 + i, *signals.get(i, (None, None, None, None))) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts_ns long, seq long, open double, close double, side int, touch long, meta int, prob double")


def reasons(df):
    return [r.reason for r in df.orderBy("entry_ns").collect()]


def test_holding_time_blocks_an_early_reversal(spark):
    b = market(spark, {0: (1, 6, 1, 0.7), 1: (-1, 7, 1, 0.7)})
    assert reasons(backtest.touch_backtest(b, meta="meta")) == ["reverse", "final"]
    assert reasons(backtest.touch_backtest(b, meta="meta", min_hold=3)) == ["final"]


def test_cooldown_blocks_an_entry_after_a_touch(spark):
    b = market(spark, {0: (1, 1, 1, 0.7), 2: (-1, 7, 1, 0.7)})
    free = backtest.touch_backtest(b, meta="meta").orderBy("entry_ns").collect()
    assert [r.reason for r in free] == ["touch", "final"] and free[0].exit_price == 101 and free[1].exit_price == 107 and free[1].pnl == -4
    assert reasons(backtest.touch_backtest(b, meta="meta", cooldown=2)) == ["touch"]


@pytest.mark.parametrize("p, turns", [(0.55, 0), (0.65, 1), (None, 0)])
def test_reversal_needs_a_higher_probability(spark, p, turns):
    b = market(spark, {0: (1, 6, 1, 0.7), 1: (-1, 7, 1, p)})
    assert reasons(backtest.touch_backtest(b, meta="meta", prob="prob", reverse_delta=0.1)).count("reverse") == turns


def test_meta_side_multiplier_and_signals_without_a_fill(spark):
    b = market(spark, {0: (1, None, 0, 0.7), 3: (1, 99, 1, 0.7), 7: (1, None, 1, 0.7)}).withColumn("m", F.lit(3.0))
    one = backtest.touch_backtest(b, meta="meta", multiplier="m").collect()
    assert [(r.entry_price, r.exit_price, r.side, r.pnl, r.reason, r.multiplier) for r in one] == [(104, 107, 1, 9, "final", 3)]
    both = backtest.touch_backtest(b, meta="meta", reverse_meta=True).orderBy("entry_ns").collect()
    assert [(r.side, r.entry_price, r.exit_price, r.reason) for r in both] == [(-1, 101, 104, "reverse"), (1, 104, 107, "final")]
    assert backtest.touch_backtest(b, meta="meta", side_mode="short").count() == 0
    assert backtest.touch_backtest(b.limit(0), meta="meta").count() == 0


def plain_area(sums, share):
    """Value area of a dict of levels by the stated rule, without arrays."""
    low, high = min(sums), max(sums)
    v = lambda k: sums.get(k, 0.0) if low <= k <= high else 0.0
    total = sum(sums.values())
    poc = max(range(low, high + 1), key=lambda k: (v(k), -k))
    a = b = poc
    inside = v(poc)
    while inside < share * total and (a > low or b < high):
        up, down = v(b + 1) + v(b + 2), v(a - 1) + v(a - 2)
        grow = [b < high and (up >= down or a == low), a > low and (down >= up or b == high)]
        if grow[0]:
            b, inside = min(high, b + 2), inside + up
        if grow[1]:
            a, inside = max(low, a - 2), inside + down
    return poc, b, a


def test_developing_profile_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows, times = [], []
    for s in ("a", "b"):
        at = 50
        for i in range(60):
            at += int(rng.integers(-3, 4))
            times.append((s, i, i * MINUTE))
            rows += [(s, i, k, float(rng.integers(0, 9)), float(rng.integers(0, 9)), 1, 1, False, False) for k in range(at, at + int(rng.integers(1, 6)))]
    levels = spark.createDataFrame(rows, "symbol string, bar_id long, level long, buy_volume double, sell_volume double, buy_ticks long, sell_ticks long, buy_imbalance boolean, sell_imbalance boolean")
    b = spark.createDataFrame(times, "symbol string, bar_id long, ts_ns long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = {(r.symbol, r.bar_id): r for r in bars.developing_profile(levels, b, 0.5, start_ns=5 * MINUTE, end_ns=50 * MINUTE).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    assert len(got) == 2 * 46
    for s in ("a", "b"):
        sums = {}
        for i in range(5, 51):
            for r in rows:
                if r[0] == s and r[1] == i:
                    sums[r[2]] = sums.get(r[2], 0.0) + r[3] + r[4]
            poc, hva, lva = plain_area(sums, 0.6834)
            r = got[s, i]
            assert (r.poc, r.hva, r.lva) == (poc * 0.5, hva * 0.5, lva * 0.5)
    some = bars.volume_profile_between(levels, b, 20 * MINUTE, 30 * MINUTE, 5 * MINUTE, 1.0).collect()
    whole = {(r.symbol, r.bar_id): r for r in bars.volume_profile(levels, b, 5 * MINUTE, 1.0).collect()}
    assert len(some) == 22 and all(whole[r.symbol, r.bar_id] == r for r in some)
    assert bars.footprint_ok(levels).where("ok").count() == 120 and bars.footprints_between(levels, b, 0, 0).select("bar_id").distinct().count() == 1
    assert not bars.footprint_ok(levels.union(levels)).where("ok").count()


def test_bins_of_one_width():
    names, volume = bars.rebin_levels(np.arange(10, 31), np.ones(21), 6)  # 20 // 6 = 3: 10-12, ..., 28-30
    assert names.tolist() == [11, 14, 17, 20, 23, 26, 29] and volume.tolist() == [3.0] * 7
    names, volume = bars.rebin_levels(np.arange(10, 20), np.arange(10.0), 3)  # the highest level begins a width
    assert names.tolist() == [11, 14, 17, 19] and volume.tolist() == [3, 12, 21, 9]
    assert bars.profile_area(np.arange(10, 31), np.r_[np.zeros(3), np.ones(18)], 0.5, 6)[0] == 14
    assert bars.rebin_levels(np.array([5]), np.ones(1), 6)[0].tolist() == [5]


@pytest.mark.parametrize("n, train, test, step", [(100, 30, 10, None), (100, 30, 10, 3), (57, 20, 20, 25), (10, 30, 10, None)])
def test_walk_forward_rows_follow_from_their_number(spark, n, train, test, step):
    got = {tuple(r) for r in validation.walk_forward_splits(spark.range(n).withColumnRenamed("id", "row_id"), train, test, step, 0.2).collect()}
    want = {(k, i, role) for k, (a, b, c, d) in enumerate(validation.walk_forward(n, train, test, step, 0.2)) for i, role in [*((i, "train") for i in range(a, b)), *((i, "test") for i in range(c, d))]}
    assert got == want


def test_purged_splits_against_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    starts = np.sort(rng.integers(0, 300, 60))
    ends = [None if i % 7 == 0 else int(s + rng.integers(0, 30)) for i, s in enumerate(starts)]
    df = spark.createDataFrame([(i, int(s), e) for i, (s, e) in enumerate(zip(starts, ends))], "row_id long, ts_ns long, t1_ns long")
    got = {tuple(r) for r in validation.purged_kfold(df, 4, 0.05).collect()}
    end = [int(s) if e is None else e for s, e in zip(starts, ends)]
    want = set()
    for k, (a, b) in enumerate(validation.fold_bounds(60, 4)):
        first, last = starts[a], max(end[a:b])
        for i in range(60):
            if a <= i < b:
                want.add((k, i, "test"))
            elif not (starts[i] < last and end[i] > first) and not b <= i < b + 3:
                want.add((k, i, "train"))
    assert got == want


def test_expanding_difference_is_the_whole_convolution():
    x = 100 + np.random.default_rng(1).normal(size=700).cumsum()
    want = np.convolve(x, ffd_weights(0.4, 0.0, 700))[:700]
    got = expanding(x, 0.4, 10)
    assert np.isnan(got[:9]).all() and np.allclose(got[9:], want[9:], atol=1e-8)
    x[300] = np.nan
    got = expanding(x, 0.4, 10)
    assert np.allclose(got[9:300], want[9:300], atol=1e-8) and np.isnan(got[300:]).all()
    assert len(expanding(np.zeros(0), 0.4)) == 0 and isinstance(pd.Series(got).sum(), float)


def test_walk_forward_report_and_stability(spark):
    from tickloom.operators import backtest

    sharpes = {"good": [1.0, 1.1, 0.9, 1.0, 1.2, 1.0, 1.1], "bad": [2.0, 1.9, 1.0, 0.2, -1.0, -1.5, -2.0], "wild": [-2.0, 2.0, -1.0, 3.0], "flat": [0.1, 0.1, 0.1], "one": [0.3]}
    rows = [(s, i + 1, x, 0.5 + 0.01 * i) for s, xs in sharpes.items() for i, x in enumerate(xs)] + [("one", 9, None, 0.1)]
    df = spark.createDataFrame(rows, "symbol string, period long, sharpe double, win_rate double").repartition(3)
    got = {r.symbol: r for r in backtest.walk_forward_stability(df).collect()}
    assert {s: r.verdict for s, r in got.items()} == {"good": "accept", "bad": "reject", "wild": "warning", "flat": "borderline", "one": "borderline"}
    for s, xs in sharpes.items():
        n = len(xs)
        fall = np.mean(xs[: n // 3]) - np.mean(xs[-n // 3 :]) if n >= 3 else 0.0
        assert got[s].periods == n and abs(got[s].degradation - fall) < 1e-12 and abs(got[s].sr_range - (max(xs) - min(xs))) < 1e-12
    text = {r.symbol: r.report for r in backtest.walk_forward_report(df).collect()}
    assert text["wild"].split("\n")[:3] == ["Walk-forward", "[1] Sharpe -2.0000, win rate 50.0%", "[2] Sharpe 2.0000, win rate 51.0%"]
    assert text["bad"].endswith("Verdict: reject") and "Periods: 7" in text["bad"]
    assert backtest.walk_forward_report(df.limit(0)).count() == 0


def test_honest_signals_and_label_backtest(spark):
    from tickloom.operators import backtest

    kind = "symbol string, event_ns long, side int, prob double"
    oof = spark.createDataFrame([("a", 1, 1, 0.9), ("a", 1, 1, 0.2), ("a", 2, -1, 0.6), ("a", 3, 1, None), (None, 4, 1, 0.5)], kind)
    held = spark.createDataFrame([("a", 2, -1, 0.65), ("a", 5, 1, 0.5)], kind)
    got = {r.event_ns: (r.side, r.prob, r.held_out, r.pred) for r in backtest.honest_signals(oof, held, 0.5, 0.2).collect()}
    assert got == {1: (1, 0.9, False, 1), 2: (-1, 0.65, True, 0), 5: (1, 0.5, True, 1)}
    signals = spark.createDataFrame([("a", 1, 1), ("a", 2, -1), ("a", 3, 0), ("a", 4, 1), ("b", 1, 1)], "symbol string, event_ns long, signal int")
    known = spark.createDataFrame([("a", 1, 0.4), ("a", 2, 0.1), ("a", 3, 9.0), ("a", 4, None), ("b", 1, 0.2)], "symbol string, event_ns long, ret double")
    a, b = backtest.label_backtest(signals, known).orderBy("symbol").collect()
    assert (a.n, a.wins, a.losses, a.win_rate, b.n, b.pl_ratio) == (2, 1, 1, 0.5, 1, 0.0) and abs(a.pl_ratio - 4) < 1e-9 and abs(a.total_ret - 0.3) < 1e-9


def _exit_bars(spark, n=140):
    rng = np.random.default_rng(8)
    frames = []
    for s in "ab":
        close = 50 + np.cumsum(rng.normal(size=n))
        open_ = close + rng.normal(size=n) * 0.2
        frames.append(pd.DataFrame({"symbol": s, "ts_ns": np.arange(n) * 10, "seq": np.arange(n), "open": open_, "high": np.maximum(open_, close) + 0.3, "low": np.minimum(open_, close) - 0.3, "close": close, "side": rng.choice([1.0, -1.0, 0.0, np.nan], n, p=[0.2, 0.2, 0.3, 0.3]), "atr": rng.choice([np.nan, 0.8, 1.2], n)}))
    pdf = pd.concat(frames)
    return pdf, spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("side", "atr")}).repartition(3)


@pytest.mark.parametrize("exit_, args", [("reverse", {}), ("hold", {"hold": 7}), ("trail", {"multiplier": 1.5})])
def test_exits_against_a_plain_loop(spark, exit_, args):
    pdf, df = _exit_bars(spark)
    want = []
    for s, p in pdf.groupby("symbol"):
        p, pos = p.reset_index(drop=True), None
        for i, r in p.iterrows():
            side, gone = 0 if np.isnan(r.side) else int(r.side), False
            if pos:
                e, d = pos
                since, end = p.iloc[e : i + 1], i == len(p) - 1
                out = None
                if exit_ == "trail" and r.atr > 0:
                    far = since["high"].max() - r.close if d > 0 else r.close - since["low"].min()
                    out = (r.close, "trail") if far > 1.5 * r.atr else None
                elif exit_ == "reverse" and side * d < 0 or exit_ == "hold" and i - e >= 7:
                    out = r.open, exit_
                if end and not (out and out[1] == "trail"):
                    out = r.close, "final"
                if out:
                    want.append((s, e * 10, i * 10, d, round(p.open[e], 9), round(out[0], 9), round((out[0] - p.open[e]) * d, 9), out[1]))
                    pos, gone = None, out[1] == "trail"
            if pos is None and side and not gone and i < len(p) - 1:
                pos = i, side
    got = [(r.symbol, r.entry_ns, r.exit_ns, r.side, round(r.entry_price, 9), round(r.exit_price, 9), round(r.pnl, 9), r.reason) for r in backtest.exit_backtest(df, "side", exit_, **args).collect()]
    assert sorted(got) == sorted(want) and len(want) > 8
    table = {r.symbol: r for r in backtest.exit_comparison(df, "side", {"x": {"exit_": exit_, **args}}, 0.01, 0.02).collect()}
    x = pd.Series([w[6] for w in want if w[0] == "a"])
    assert table["a"].trade_count == len(x) and abs(table["a"].total_pnl - (x.sum() - 0.03 * len(x))) < 1e-6 and abs(table["a"].sharpe - x.mean() / x.std()) < 1e-6


def test_supertrend_votes(spark):
    from tickloom.functions import recursive

    _, df = _exit_bars(spark)
    df = df.drop("side", "atr")
    one = {}
    for n, m in ((5, 1.0), (9, 2.0)):
        for r in recursive.supertrend(recursive.atr(df, n), "atr", m).collect():
            one.setdefault((r.symbol, r.ts_ns), []).append(r.direction)
    for how in ("or", "and"):
        rows = backtest.supertrend_votes(df, [(5, 1.0), (9, 2.0)], how).collect()
        assert len(rows) == len(one)
        for r in rows:
            d = one[r.symbol, r.ts_ns]
            ups = sum(x == 1 for x in d)
            want = (None, None) if d == [None, None] else (1 if ups >= (1 if how == "or" else 2) else -1, ups / 2)
            assert (r.side, r.confidence) == want
        assert {r.confidence for r in rows} == {None, 0.0, 0.5, 1.0}


def test_bar_scores(spark):
    kind = "symbol string, ac1 double, acf_sum double, vov_ratio double, jarque_bera double, skew double, kurt double, bars_per_day double"
    rows = [("best", 0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 20.0), ("worst", -0.2, 0.9, None, 1e12, -5.0, 99.0, 0.0), ("mid", 0.05, 0.25, 0.05, 1000.0, 1.0, 23.5, 12.0), ("thin", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 7.5)]
    got = {r.symbol: r.score for r in backtest.bar_scores(spark.createDataFrame(rows, kind)).collect()}
    want = {"best": 0.0, "worst": 1.1, "mid": 0.175 + 0.075 + 0.125 + 0.1 / 3 + 0.025 + 0.025 + 0.15 * 0.18, "thin": 0.15 * 0.5}
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def shuffled_spans(spark, n):
    """n spans in no order, whose rank is their start, with more columns than the order needs."""
    starts = np.random.default_rng(7).permutation(n)
    return spark.createDataFrame(pd.DataFrame({"ts_ns": starts, "symbol": "x", "t1_ns": starts + starts % 40}), "ts_ns long, symbol string, t1_ns long").repartition(5)


def plain_splits(n, tests, embargo):
    start = np.arange(n)
    end, want = start + start % 40, []
    for k, ranges in enumerate(tests):
        test, out = np.zeros(n, bool), np.zeros(n, bool)
        for a, b in ranges:
            test |= (start >= a) & (start < b)
            out |= ((start < end[a:b].max()) & (end > a)) | ((start >= b) & (start < b + embargo))
        want += [(k, i, "test" if test[i] else "train") for i in start[test | ~out].tolist()]
    return want


@pytest.mark.parametrize("n, chunks", [(20_000, None), (20_000, 3), (5, 4), (0, 4)])
def test_row_ids_are_ranks_whatever_columns_are_read(spark, n, chunks):
    rows = validation.with_row_id(shuffled_spans(spark, n), "ts_ns", "symbol", chunks=chunks)
    assert rows.columns == ["ts_ns", "symbol", "t1_ns", "row_id"]
    for some in (rows, rows.select("ts_ns", "row_id"), rows.where("t1_ns > ts_ns")):
        assert all(r.row_id == r.ts_ns for r in some.collect())
    assert sorted(r.row_id for r in rows.select("row_id").collect()) == list(range(n))


def test_purged_splits_of_numbered_rows(spark):
    rows = validation.with_row_id(shuffled_spans(spark, 20_000), "ts_ns", "symbol")
    got = sorted(tuple(r) for r in validation.purged_kfold(rows, 5, 0.01).collect())
    assert got == sorted(plain_splits(20_000, [[r] for r in validation.fold_bounds(20_000, 5)], 200))


def test_combinatorial_splits_of_numbered_rows(spark):
    rows = validation.with_row_id(shuffled_spans(spark, 20_000), "ts_ns", "symbol")
    bounds = validation.fold_bounds(20_000, 6)
    tests = [[a, b] for i, a in enumerate(bounds) for b in bounds[i + 1 :]]
    got = sorted(tuple(r) for r in validation.combinatorial_purged(rows, 6, 2, 0.01).collect())
    assert got == sorted(plain_splits(20_000, tests, 200))


def test_permuted_columns_keep_all_rows(spark):
    from tickloom.operators.importance import permuted
    from tickloom.sources.scratch import Scratch

    df, scratch = spark.range(20_000).select(F.col("id").alias("row_id"), (F.col("id") + 1).alias("a"), (F.col("id") + 2).alias("b"), (F.col("id") + 3).alias("kept")), Scratch(spark)
    rows = permuted(df, ["a", "b"], 3, scratch).toPandas().sort_values("row_id")
    assert rows["row_id"].tolist() == list(range(20_000)) and (rows["kept"] == rows["row_id"] + 3).all()
    assert sorted(rows["a"]) == list(range(1, 20_001)) and (rows["b"] == rows["a"] + 1).all() and (rows["a"] != rows["row_id"] + 1).mean() > 0.99
    scratch.drop()
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch.root)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
