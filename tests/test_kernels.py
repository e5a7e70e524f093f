"""Fold and window kernels against plain restatements; results must not depend on Arrow batches."""

import math

import numpy as np
import pandas as pd
import pytest

from tickloom.functions import breaks, entropy, recursive
from tickloom.functions.recursive import decayed
from tickloom.operators import backtest, importance, labels, validation
from tickloom.operators.bars import profile_area, rebin_levels, threshold_closes


@pytest.fixture(scope="module")
def series(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    rng = np.random.default_rng(42)
    c = 100 + np.cumsum(rng.normal(size=300))
    pdf = pd.DataFrame({"symbol": "a", "ts_ns": np.arange(300) * 10**9, "seq": np.arange(300), "close": c, "high": c + 1, "low": c - 1, "open": c, "x": rng.normal(size=300)})
    yield pdf, spark.createDataFrame(pdf)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)


def out(df, *names):
    p = df.orderBy("seq").toPandas()
    return [p[n].to_numpy(float) for n in names]


def test_decayed_is_the_recursion():
    x, s, want = np.random.default_rng(0).normal(size=5000), 0.7, []
    for v in x:
        s = 0.9 * s + v
        want.append(s)
    assert np.allclose(decayed(x, 0.9, 0.7), want)


def test_exponential_averages_match_pandas(series):
    pdf, df = series
    assert np.allclose(out(recursive.ewma(df, "close", 20), "ewma")[0], pdf["close"].ewm(span=20).mean(), rtol=1e-10)
    got, want = out(recursive.ew_std(df, "x", 20), "ewms")[0], pdf["x"].ewm(span=20).std().to_numpy()
    assert np.allclose(got[1:], want[1:], rtol=1e-8) and np.isnan(got[0])


def test_wilder_indicators(series):
    pdf, df = series
    d = pdf["close"].diff().to_numpy()[1:]
    up, down = np.maximum(d, 0), np.maximum(-d, 0)
    a, b = up[:14].mean(), down[:14].mean()
    want = [100 - 100 / (1 + a / b)]
    for u, v in zip(up[14:], down[14:]):
        a, b = (a * 13 + u) / 14, (b * 13 + v) / 14
        want.append(100 - 100 / (1 + a / b))
    got = out(recursive.rsi(df), "rsi")[0]
    assert np.isnan(got[:14]).all() and np.allclose(got[14:], want)
    tr = np.fmax(pdf.high - pdf.low, np.fmax(abs(pdf.high - pdf.close.shift()), abs(pdf.low - pdf.close.shift())))
    assert np.allclose(out(recursive.atr(df, 14, wilder=False), "atr")[0][13:], tr.rolling(14).mean()[13:])
    adx = out(recursive.adx(df), "adx")[0]
    assert np.isnan(adx[:26]).all() and ((adx[27:] >= 0) & (adx[27:] <= 100)).all()
    line, direction = out(recursive.supertrend(recursive.atr(df, 10)), "line", "direction")
    known = ~np.isnan(line)
    assert set(direction[known]) <= {1.0, -1.0} and (np.sign(pdf.close.to_numpy()[known] - line[known]) == direction[known]).all()


def test_fractional_differences(series):
    pdf, df = series
    c = pdf["close"].to_numpy()
    w = breaks.ffd_weights(0.4, 1e-2)
    want = [np.dot(w, c[i - len(w) + 1 : i + 1][::-1]) for i in range(len(w) - 1, len(c))]
    assert np.allclose(out(breaks.frac_diff(df, "close", 0.4, 1e-2), "ffd")[0][len(w) - 1 :], want)
    assert np.allclose(breaks.ffd(c, 1.0)[1:], np.diff(c))
    e = out(breaks.frac_diff_expanding(df, "close", 0.4), "fracdiff")[0]
    full = breaks.ffd_weights(0.4, 0.0, 300)
    assert np.isnan(e[:9]).all() and np.isclose(e[200], np.dot(full[:201], c[:201][::-1]))


def test_unit_root_tests(series):
    pdf, df = series
    c = pdf["close"].to_numpy()
    got = out(breaks.adf_rolling(df, "close", 30), "adf")[0]
    assert np.isclose(got[100], breaks._regress(c[71:101], 0, True)[0])
    s = out(breaks.sadf(df, "close", 20, 25, log=False), "sadf")[0]
    assert np.isclose(s[60], max(breaks.adf_t_windows(c[61 - w : 61], w)[-1] for w in range(20, 26)))
    assert breaks.adf(np.random.default_rng(1).normal(size=200))["p"] == 0.01 and breaks.adf(c)["p"] > 0.01
    assert breaks.schwert_lag(100) == 12 and breaks.schwert_lag(5) == 1


def test_cusum_of_chu_stinchcombe_white(series):
    pdf, df = series
    y = np.log(pdf["close"].to_numpy())
    got = breaks.csw_rolling(y, 50, 10)
    for i in (20, 49, 120, 299):
        assert np.allclose(got[i], breaks.csw_scores(y[max(0, i - 49) : i + 1]))
    assert np.allclose(out(breaks.csw_cusum(df, "close", 50, 10), "csw_up")[0], got[:, 0], equal_nan=True)


def test_trend_scan(series):
    pdf, df = series
    t, span = out(breaks.trend_scan(df, "close", (5, 10, 20)), "trend_t", "trend_span")
    y = pdf["close"].to_numpy()

    def line(v):
        k = np.arange(len(v)) - (len(v) - 1) / 2
        b = v @ k / (k @ k)
        r = ((v - v.mean() - b * k) ** 2).sum()
        return b / math.sqrt(r / (len(v) - 2) / (k @ k))

    for i in (0, 50, 279, 290):
        best = max((n for n in (5, 10, 20) if i + n <= 300), key=lambda n: abs(line(y[i : i + n])))
        assert span[i] == best and np.isclose(t[i], line(y[i : i + best]))
    assert np.isnan(t[297:]).all()


def test_entropies():
    s = np.array([0, 1, 2, 0, 1, 2, 0, 1, 2])
    assert np.isclose(entropy.shannon(s), math.log2(3)) and entropy.entropy_rate(s) == 0
    assert entropy.lempel_ziv(np.zeros(50, int)) < entropy.lempel_ziv(np.random.default_rng(0).integers(0, 3, 50))
    assert entropy.kontoyiannis(np.zeros(50, int)) < entropy.kontoyiannis(np.random.default_rng(0).integers(0, 3, 50))
    assert (entropy.discretize(np.array([-1.0, 0.0, 1.0])) == [0, 1, 2]).all()


def test_threshold_closes():
    v = np.array([1.0, 2, 3, 4, 5])
    assert threshold_closes(v, np.full(5, 4.0), 0.0, False)[0].tolist() == [0, 0, 1, 1, 1]
    closes, rest = threshold_closes(v, np.full(5, 4.0), 0.0, True)
    assert closes.tolist() == [0, 0, 1, 1, 1] and rest == 3.0


def test_value_area():
    poc, hva, lva, above = profile_area(np.array([10, 11, 12, 13, 14]), np.array([1.0, 2, 10, 2, 1]), 0.7)
    assert (poc, above) == (12, 3 / 16) and lva <= 12 <= hva
    level, vol = rebin_levels(np.arange(10), np.ones(10), 3)
    assert vol.sum() == 10 and len(level) <= 4


def test_bootstrap_prefers_unique_events():
    starts = np.arange(40)
    ends = np.minimum(starts + 10, 49)
    seq = [labels.bag_uniqueness(starts, ends, labels.sequential_bootstrap(starts, ends, 40, s)) for s in range(5)]
    rnd = [labels.bag_uniqueness(starts, ends, np.random.default_rng(s).integers(0, 40, 40)) for s in range(5)]
    assert np.mean(seq) > np.mean(rnd)
    assert (labels.sequential_bootstrap(starts, ends, 5, None) == labels.sequential_bootstrap(starts, ends, 5, 0)).all()


def test_paths_and_overfitting():
    paths = validation.cpcv_paths(6, 2)
    assert len(paths) == 5 and all(len(p) == 6 for p in paths)
    rng = np.random.default_rng(0)
    noise = validation.pbo(rng.normal(size=(400, 10)), rng.normal(size=(400, 10)))
    skill = rng.normal(size=(400, 10)) + np.arange(10) * 2
    assert 0.4 < noise < 0.6 and validation.pbo(skill, skill + rng.normal(size=(400, 10)) * 0.1) < 0.05
    assert validation.walk_forward(100, 50, 20)[0] == (0, 50, 50, 70)
    assert validation.probabilistic_sharpe(0.1, 40, 0, 0) == 0 and validation.probabilistic_sharpe(0.1, 500, 0, 0) > 0.95


def test_grids_and_trees():
    assert len(backtest.light_grid([0.1, 0.2], [5, 10], [10, 20])) == 6
    assert len(backtest.deep_grid(backtest.light_grid([0.1], [5], [10, 20]), [1, 2, 3])) == 6
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(size=(5, 2)), rng.normal(size=(5, 2)) + 20])
    dist = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    cut = importance.cut_tree(importance.ward_tree(dist), 10, 2)
    assert (cut == [0] * 5 + [1] * 5).all() and importance.silhouette(dist, cut) > 0.8


def test_streaming_bars_equal_batch_bars(spark, tmp_path):
    from tickloom.operators.bars import assign_dollar_bars, ohlcv
    from tickloom.streaming.live import LiveRuntime, live_threshold_bars

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"symbol": rng.choice(["a", "b"], 400), "ts_ns": (1000 + np.arange(400)) * 10**9, "seq": np.arange(400), "price": 50 + rng.normal(size=400), "amount": rng.integers(1, 9, 400).astype(float)})
    for k in range(4):
        spark.createDataFrame(pdf[k * 100 : (k + 1) * 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    later = pd.DataFrame({"symbol": ["a", "b"], "ts_ns": 10**13, "seq": [900, 901], "price": 1.0, "amount": 0.0})  # the watermark passes the others
    spark.createDataFrame(later).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.readStream.schema("symbol string, ts_ns long, seq long, price double, amount double").option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    q = live_threshold_bars(src, 1500.0).writeStream.format("memory").queryName("live_bars").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.symbol, r.bar_id): (r.ts_ns, r.open, r.close, r.trades) for r in spark.table("live_bars").collect()}
    want = {(r.symbol, r.bar_id): (r.ts_ns, r.open, r.close, r.trades) for r in ohlcv(assign_dollar_bars(spark.createDataFrame(pdf), 1500.0)).collect()}
    assert got == want and len(got) > 10
    live = LiveRuntime(1500.0)
    new = sum(len(live.update(int(t), p, a)) for t, p, a in zip(pdf["ts_ns"], pdf["price"], pdf["amount"]))
    assert new == len(live.bars()) and live.on_bar(live.bars())["safe_mode"]
    live.save(str(tmp_path / "s.json"))
    again = LiveRuntime(1500.0, symbols={"a": "a2601"})
    again.load(str(tmp_path / "s.json"))
    assert again.bars().equals(live.bars()) and again.last_ns == live.last_ns and not len(again.update(int(pdf["ts_ns"][0]), pdf["price"][0], pdf["amount"][0]))
    assert again.resolve("a") == "a2601"
    with pytest.raises(KeyError):
        again.resolve("b")


def test_month_store_and_csv_zip(spark, tmp_path):
    import zipfile

    from tickloom.sources import tapes

    month = 30 * 86400 * 10**9
    pdf = pd.DataFrame({"symbol": "a", "ts_ns": [0, 10**9, month * 2, month * 2 + 5], "seq": [1, 2, 3, 4], "price": [1.0, 2, 3, 4], "amount": 1.0})
    path = str(tmp_path / "store")
    tapes.save_months(spark.createDataFrame(pdf), path)
    tapes.save_months(spark.createDataFrame(pdf[:1]), path)
    assert tapes.load_months(spark, path).count() == 3 and tapes.load_months(spark, path, 0, 10**9).count() == 1
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.csv", "id,price,qty,quote_qty,time,is_buyer_maker\n1,2.5,3,7.5,1000,true\n2,bad,3,7.5,1001,False\n")
    rows = tapes.csv_zip_trades(spark, str(tmp_path / "t.zip")).orderBy("id").collect()
    assert [(r.id, r.price, r.is_buyer_maker) for r in rows] == [(1, 2.5, True), (2, None, False)]
    assert all(r.ok and len(r.sha256) == 64 for r in tapes.checksums(spark, str(tmp_path / "t.zip")).collect())


def test_model_pipeline(spark):
    rng = np.random.default_rng(0)
    n = 240
    x = rng.normal(size=(n, 3))
    pdf = pd.DataFrame({"row_id": np.arange(n), "ts_ns": np.arange(n) * 10, "t1_ns": np.arange(n) * 10 + 15, "a": x[:, 0], "b": x[:, 0] + 0.01 * x[:, 1], "c": x[:, 2], "k": 1.0, "label": (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)})
    df = spark.createDataFrame(pdf)
    assert importance.cluster_features(df, ["a", "b", "c", "k"], 2) == {0: ["a", "b"], 1: ["c"]}
    splits = validation.purged_kfold(df, 3, 0.01)
    mda = importance.clustered_mda(df, splits, {0: ["a", "b"], 1: ["c"]}, importance.forest(trees=10))
    assert mda[0]["mean"] > mda[1]["mean"]
    fit = entropy.pca_fit(df, ["a", "b", "c"])
    assert len(fit["components"]) == 2 and np.isclose(fit["share"].sum(), 1, atol=0.05)


def test_feature_configuration_rejects_unknown_names():
    from tickloom.plans.kit import Feature

    with pytest.raises(ValueError):
        Feature.native("os.system", "close")
    with pytest.raises(ValueError):
        Feature.from_config({"kind": "import", "name": "x", "inputs": [], "params": {}})


def test_kline_store(spark, tmp_path):
    from tickloom.plans import pipelines
    from tickloom.sources.tapes import month

    rng = np.random.default_rng(5)
    day = 86_400 * 10**9
    pdf = pd.DataFrame({"symbol": "a", "ts_ns": np.sort(rng.integers(day, 5 * day, 500)), "seq": np.arange(500), "price": 10 + rng.normal(size=500), "amount": 1.0})
    path = str(tmp_path / "k")
    tape = spark.createDataFrame(pdf)
    pipelines.store_klines(tape, path, 3600 * 10**9)
    before = pipelines.read_klines(spark, path).count()
    pipelines.store_klines(tape.where("seq < 5"), path, 3600 * 10**9)  # the months are there: nothing changes
    assert pipelines.read_klines(spark, path).count() == before
    one = pipelines.read_klines(spark, path, day, 2 * day)
    assert one.agg({"ts_ns": "max"}).first()[0] > 2 * day and one.select(month()).distinct().count() == 1
    daily = pipelines.read_klines(spark, path, day, 3 * day, day)
    assert daily.agg({"ts_start_ns": "max"}).first()[0] <= 2 * day


def test_bars_that_share_their_bounds(spark):
    from tickloom.plans.pipelines import overlapping_bars

    pdf = pd.DataFrame({"symbol": "a", "ts_ns": range(7), "open": range(7), "high": range(7), "low": range(7), "close": range(7), "volume": 1.0, "_close": [1, 0, 0, 1, 0, 1, 0]})
    rows = overlapping_bars(spark.createDataFrame(pdf)).orderBy("bar_id").collect()
    assert [(r.open, r.close, r.volume) for r in rows] == [(0, 3, 4.0), (3, 5, 3.0)]


def test_weights_run_to_their_threshold_or_say_so():
    for d, threshold, longest in [(0.4, 1e-2, None), (0.1, 1e-4, None), (1.0, 1e-5, None), (0.0, 1e-5, None), (0.35, 0.0, 5000), (0.7, 0.0, 1)]:
        want = [1.0]
        while longest is None or len(want) < longest:
            x = -want[-1] * (d - len(want) + 1) / len(want)
            if abs(x) < threshold:
                break
            want.append(x)
        assert np.allclose(breaks.ffd_weights(d, threshold, longest), want, rtol=1e-12, atol=0)
    assert len(breaks.ffd_weights(0.3, 1e-8)) > 100_000
    with pytest.raises(ValueError):
        breaks.ffd_weights(-0.9)
