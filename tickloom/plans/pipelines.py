"""Jobs made of the operators: kline store, feature tables by configuration, labels and weights, bet sizing, candidate search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import breaks, entropy, recursive
from tickloom.functions import rolling as R
from tickloom.operators import backtest, bars, labels, validation
from tickloom.sources import tapes

DAY_NS = 86_400_000_000_000


# klines
def store_klines(tape: DataFrame, path: str, step_ns: int = 1_000_000_000, overwrite: bool = False) -> None:
    """Time bars of a tape as a store by symbol and month; months that the store has are left unless overwrite."""
    spark = tape.sparkSession
    out = bars.time_bars(tape, step_ns)
    if not overwrite:
        try:
            have = spark.read.parquet(path).select("symbol", "month").distinct()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            have = None
        if have is not None:
            out = out.withColumn("month", tapes.month()).join(F.broadcast(have), ["symbol", "month"], "left_anti").drop("month")
    tapes.save_months(out, path)


def read_klines(spark: SparkSession, path: str, start_ns: int | None = None, end_ns: int | None = None, step_ns: int | None = None) -> DataFrame:
    """Klines in [start, end]; an end at midnight takes in its whole day; resampled to step_ns, by days up to the day before that midnight's next."""
    midnight = end_ns is not None and end_ns % DAY_NS == 0
    out = tapes.load_months(spark, path, start_ns, end_ns + DAY_NS - 1 if midnight else end_ns)
    if step_ns is None:
        return out
    out = bars.resample(out, step_ns)
    return out.where(F.col("ts_start_ns") <= end_ns - DAY_NS) if midnight and step_ns % DAY_NS == 0 else out


def overlapping_bars(minutes: DataFrame, close_col: str = "_close") -> DataFrame:
    """OHLCV of minute bars between marked closes, both ends included: a closing row is the last of its bar and the first of the next."""
    w = Window.partitionBy("symbol").orderBy("ts_ns")
    done = F.coalesce(F.sum(close_col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = minutes.withColumn("bar_id", done).withColumn("_total", F.sum(close_col).over(Window.partitionBy("symbol")))
    again = rows.where(F.col(close_col) == 1).withColumn("bar_id", F.col("bar_id") + 1)
    both = rows.unionByName(again).where((F.col("bar_id") > 0) & (F.col("bar_id") < F.col("_total")))
    aggs = [F.max("ts_ns").alias("ts_ns"), F.min_by("open", "ts_ns").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts_ns").alias("close"), F.sum("volume").alias("volume")]
    if "open_interest" in minutes.columns:
        aggs.append(F.max_by("open_interest", "ts_ns").alias("open_interest"))
    return both.groupBy("symbol", "bar_id").agg(*aggs)


def minute_dollar_bars(minutes: DataFrame, bars_a_day: float = 15, span: int = 20, multiplier: float = 1.0, session_hour: int | None = None) -> DataFrame:
    """Dynamic dollar bars of minute bars (close as price, volume as amount), by calendar day or by futures session."""
    ts = F.timestamp_micros(F.floor(F.col("ts_ns") / 1000))
    day = F.to_date(ts) if session_hour is None else bars.session_date(ts, session_hour)
    tape = minutes.withColumn("price", F.col("close")).withColumn("amount", F.col("volume"))
    limit = bars.daily_thresholds(tape, bars_a_day / multiplier, span, day=day)
    marked = bars.assign_dynamic_dollar_bars(tape, limit, day, multiplier)
    last = F.lead("bar_id").over(Window.partitionBy("symbol").orderBy("ts_ns", "seq"))
    marked = marked.withColumn("_close", F.when(F.col("bar_id").isNotNull() & (last.isNull() | (last != F.col("bar_id"))), 1).otherwise(0))
    return overlapping_bars(marked)


def dollar_bars_by_frequency(tape: DataFrame, bars_a_day: Sequence[float], span: int = 20) -> DataFrame:
    """Dynamic dollar bars for several target frequencies at once: symbol and frequency are one key, so all folds run side by side."""
    limits = bars.daily_thresholds(tape, 1.0, span)
    freqs = F.explode(F.array(*[F.lit(float(f)) for f in bars_a_day]))
    wide = tape.withColumn("freq", freqs).withColumn("symbol", F.concat_ws("@", "symbol", "freq"))
    limits = limits.withColumn("freq", freqs).select(F.concat_ws("@", "symbol", "freq").alias("symbol"), "day", (F.col("limit") / F.col("freq")).alias("limit"))
    out = bars.ohlcv(bars.assign_dynamic_dollar_bars(wide.drop("freq"), limits))
    return out.withColumn("freq", F.element_at(F.split("symbol", "@"), -1).cast("double")).withColumn("symbol", F.regexp_replace("symbol", "@[^@]*$", ""))


# feature tables
def momentum_features(b: DataFrame, o: R.Over, rsi: Sequence[int] = (14,), roc: Sequence[int] = (10,), stoch: Sequence[int] = (14,)) -> DataFrame:
    for n in rsi:
        b = recursive.rsi(b, n=n, name=f"rsi_{n}", order=o.order)
    return b.withColumns({f"roc_{n}": R.roc("close", n, o) for n in roc} | {f"stoch_{n}": R.stoch_k("close", "low", "high", n, o) for n in stoch})


def volatility_features(b: DataFrame, o: R.Over, spans: Sequence[int] = (20,), windows: Sequence[int] = (20,)) -> DataFrame:
    b = b.withColumn("_ret", R.ret("close", 1, True, o))
    for n in spans:
        b = recursive.ew_std(b, "_ret", n, f"ew_std_{n}", order=o.order)
    b = b.withColumns({f"parkinson_{n}": R.parkinson("high", "low", n, o) for n in windows} | {f"percent_b_{n}": R.bollinger_percent_b("close", n, 2.0, o) for n in windows})
    return recursive.atr(b, 14, name="atr_14", order=o.order).drop("_ret")


def trend_features(b: DataFrame, o: R.Over, adx: Sequence[int] = (14,), pairs: Sequence[tuple[int, int]] = ((5, 20),)) -> DataFrame:
    for n in adx:
        b = recursive.adx(b, n, name=f"adx_{n}", order=o.order)
    for f, s in pairs:
        x = R.cross_ma("close", f, s, o)
        b = b.withColumns({f"ma_ratio_{f}_{s}": x["ratio"], f"ma_signal_{f}_{s}": x["signal"]})
    return b


def microstructure_features(b: DataFrame, o: R.Over, n: int = 20) -> DataFrame:
    b = b.withColumn("_ret", R.ret("close", 1, over=o)).withColumn("_dollars", F.col("close") * F.col("volume"))
    cs = R.corwin_schultz("high", "low", o)
    b = b.withColumns({"amihud": R.amihud("_ret", "_dollars", n, o), "roll_spread": R.roll_spread("close", n, o), "corwin_schultz": cs, "vwap_distance": R.vwap_distance("close", "volume", n, over=o)})
    b = b.withColumn("corwin_schultz_mean", F.avg("corwin_schultz").over(o.rows(n)))
    up = F.when(R.lag("close", 1, o) > F.col("close"), 0.0).otherwise(F.col("volume"))
    b = b.withColumn("_buy", up).withColumn("vpin", R.vpin("_buy", F.col("volume") - F.col("_buy"), n, o)).withColumn("flow_acceleration", R.flow_acceleration("volume", n, max(1, n // 4), over=o))
    return b.drop("_ret", "_dollars", "_buy")


def information_features(b: DataFrame, o: R.Over, n: int = 50, lags: int = 5) -> DataFrame:
    b = b.withColumn("_ret", F.coalesce(R.ret("close", 1, over=o), F.lit(0.0)))
    for m in ("shannon", "lempel_ziv", "rate"):
        b = entropy.rolling_entropy(b, "_ret", n, 3, m, f"entropy_{m}", order=o.order)
    b = b.withColumns({f"autocorr_{k}": R.serial_correlation("_ret", k, n, o) for k in range(1, lags + 1)} | {"ljung_box": R.ljung_box("_ret", lags, n, o)})
    return b.withColumns(R.theil_imbalance(*R.clv_split("close", "low", "high", "volume"), n, o)).drop("_ret")


def break_features(b: DataFrame, o: R.Over, window: int = 50, d: float = 0.4) -> DataFrame:
    b = breaks.adf_rolling(b, "close", window, name="adf", order=o.order)
    b = breaks.sadf(b, "close", 20, window, name="sadf", order=o.order)
    return breaks.frac_diff(b, "close", d, 1e-3, name="ffd", order=o.order)


FAMILIES = {"momentum": momentum_features, "volatility": volatility_features, "trend": trend_features, "microstructure": microstructure_features, "information": information_features, "breaks": break_features}


def feature_table(b: DataFrame, config: dict[str, dict], over: R.Over = R.BARS) -> DataFrame:
    """bars with the feature families that config names, with its parameters; time cues under "time"."""
    for name, params in config.items():
        if name == "time":
            b = b.withColumns(R.time_cues())
        elif name in FAMILIES:
            b = FAMILIES[name](b, over, **params)
        else:
            raise ValueError(f"no feature family {name}")
    return b


def align_with_labels(features: DataFrame, labelled: DataFrame, columns: Sequence[str] = ("bin", "ret", "t1_ns")) -> DataFrame:
    """Features at the events, with the label columns; rows with a null go."""
    got = labelled.select("symbol", F.col("event_ns").alias("ts_ns"), *columns)
    return features.join(got, ["symbol", "ts_ns"]).dropna()


# labels, sizes, search
def labels_and_weights(events: DataFrame, prices: DataFrame, vertical_ns: int, min_target: float = 0.0, trend: DataFrame | None = None, price: str = "price", **barriers) -> DataFrame:
    """Triple-barrier labels with all weights; trend (symbol, ts_ns, trend_side) gives sides, and events of side 0 go."""
    if trend is not None:
        events = events.join(trend.select("symbol", "ts_ns", F.col("trend_side").alias("side")), ["symbol", "ts_ns"]).where("side <> 0")
    ev = labels.label_events(events, prices, min_target, vertical_ns)
    found = labels.triple_barrier(ev, prices, vertical_ns, price=price, **barriers)
    return labels.final_weights(labels.info_weights(found, prices, price))


def bet_sizing(oof: DataFrame, labelled: DataFrame, step: float = 0.1) -> DataFrame:
    """(symbol, ts_ns, active, size): discretised mean size of the bets open at each time, from probabilities (symbol, event_ns, prob)."""
    bets = oof.join(labelled.select("symbol", "event_ns", "t1_ns", "side"), ["symbol", "event_ns"]).withColumn("size", labels.signal_size(F.col("prob"), F.col("side")))
    return labels.concurrent_sizes(bets).withColumn("size", labels.discretize_size(F.col("size"), step))


def size_backtest(b: DataFrame, sizes: DataFrame, cost: float = 0.0, over: R.Over = R.TAPE) -> DataFrame:
    """Back-test of sizes as-of joined to bars."""
    joined = labels.asof_last(b, sizes.select("symbol", "ts_ns", "size"), "ts_ns", "size")
    return backtest.position_backtest(joined, "size", cost, over=over)


def candidate_events(b: DataFrame, calibrated: Sequence[dict], combos: Sequence[dict], over: R.Over = R.BARS) -> DataFrame:
    """(combo_id, rate, symbol, ts_ns, side) of every combination: CUSUM events of its rate with the side of its averages.

    Each rate is one fold and each pair of averages one column, however many combinations share them.
    """
    rows = b.withColumn("_r", R.ret("close", 1, True, over))
    for i, c in enumerate(calibrated):
        rows = labels.cusum_events(rows, "_r", c["k"], order=over.order).drop("s_up", "s_down").withColumnRenamed("event", f"_e{i}")
    rate_of = {c["rate"]: i for i, c in enumerate(calibrated)}
    pairs = sorted({(c["fast"], c["slow"]) for c in combos})
    rows = rows.withColumns({f"_s{f}_{s}": R.cross_ma("close", f, s, over)["signal"] for f, s in pairs})
    hits = [
        F.when(F.col(f"_e{rate_of[c['rate']]}") != 0, F.struct(F.lit(c["combo_id"]).alias("combo_id"), F.lit(float(c["rate"])).alias("rate"), F.col(f"_s{c['fast']}_{c['slow']}").alias("side")))
        for c in combos
    ]
    out = rows.select("symbol", "ts_ns", F.explode(F.array(*hits)).alias("_c")).where("_c is not null")
    return out.select("_c.combo_id", "_c.rate", "symbol", "ts_ns", "_c.side")


def primary_factory(b: DataFrame, rates: Sequence[float], fast: Sequence[int], slow: Sequence[int], spans: Sequence[int] = (5, 10, 20), top: int = 5, over: R.Over = R.BARS) -> DataFrame:
    """Calibrates CUSUM thresholds, scores every combination against trend-scan labels and returns the best."""
    known = backtest.calibrate_cusum(b, "close", rates, order=over.order)
    combos = backtest.light_grid(rates, fast, slow)
    trend = breaks.trend_scan(b.withColumn("seq", F.col(over.order[-1])), "close", spans).select("symbol", "ts_ns", F.coalesce("trend_side", F.lit(0)).alias("side"))
    metrics = backtest.light_metrics(candidate_events(b, known, combos, over), trend, ("combo_id", "rate"))
    return backtest.top_candidates(backtest.composite_score(metrics, {"recall": 1.0, "precision": 1.0, "lift": 1.0, "coverage": 0.5}, lower=("coverage",)), top)


def cost_pressure(trades: DataFrame, costs: Sequence[tuple[float, float]], by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Trade statistics at every pair of commission and slippage, from the trades without costs."""
    pair = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("commission"), F.lit(float(s)).alias("slippage")) for c, s in costs]))
    wide = trades.withColumn("_k", pair).select(*trades.columns, "_k.*").withColumn("ret", F.col("ret") - 2 * (F.col("commission") + F.col("slippage")))
    return backtest.trade_statistics(wide, (*by, "commission", "slippage"))


def compare_candidates(walk: DataFrame, costs: DataFrame) -> DataFrame:
    """One ranked row a combination from walk-forward and cost results (combo_id, sharpe, trades): a full outer join of two summaries."""
    a = walk.groupBy("combo_id").agg(F.percentile("sharpe", F.lit(0.5)).alias("median_sharpe"), F.avg("sharpe").alias("mean_sharpe"), F.sum("trades").alias("trades"))
    c = costs.groupBy("combo_id").agg(F.min("sharpe").alias("worst_cost_sharpe"))
    order = [F.desc_nulls_last("median_sharpe"), F.desc_nulls_last("worst_cost_sharpe"), F.desc_nulls_last("trades"), F.asc("combo_id")]
    return a.join(c, "combo_id", "full").withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def walk_forward_backtest(b: DataFrame, signal: str, splits: int = 3, train_ratio: float = 0.6, test_ratio: float = 0.2, over: R.Over = R.BARS, **guards) -> DataFrame:
    """Trade statistics of each symbol's out-of-sample slices behind a fixed training prefix."""
    rows = b.withColumn("_n", F.row_number().over(over.all)).withColumn("_all", F.count("*").over(Window.partitionBy("symbol")))
    head, size = F.floor(F.col("_all") * train_ratio), F.floor(F.col("_all") * test_ratio)
    rows = rows.withColumn("_slice", F.floor(F.try_divide(F.col("_n") - 1 - head, size))).where((F.col("_n") > head) & (F.col("_slice") < splits))
    keyed = rows.withColumn("symbol", F.concat_ws("@", "symbol", "_slice"))
    out = backtest.trade_statistics(backtest.rolling_backtest(keyed, signal, order=over.order, **guards))
    return out.withColumn("slice", F.element_at(F.split("symbol", "@"), -1).cast("int")).withColumn("symbol", F.regexp_replace("symbol", "@[^@]*$", ""))


def drift_of(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, str]:
    """PSI of the columns and its report."""
    table = validation.psi(train, test, columns)
    return table, validation.psi_report(table)
