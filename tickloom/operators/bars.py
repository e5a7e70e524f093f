"""Bars: segmentation of a tape and the aggregates of each bar.

Segmentation adds bar_id to the trades; a trade with a null bar_id belongs to no
bar (the first trade of count, volume and dollar bars, and an incomplete last
bar).  Time and tick bars are closed forms over windows; bars whose threshold
resets are folds.  Aggregates are plain groupBys on (symbol, bar_id).
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tickloom.functions.rolling import natural_log
from tickloom.operators.fold import fold


def _by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts_ns", "seq")


def _up_to() -> WindowSpec:
    return _by_time().rowsBetween(Window.unboundedPreceding, 0)


def _bar() -> WindowSpec:
    return Window.partitionBy("symbol", "bar_id").orderBy("ts_ns", "seq")


def assign_time_bars(tape: DataFrame, step_ns: int) -> DataFrame:
    """bar_id: the number of the interval (open, close] of step_ns that holds the trade, from the epoch."""
    return tape.withColumn("bar_id", F.floor((F.col("ts_ns") - 1) / step_ns) + 1)


def assign_tick_bars(tape: DataFrame, n: int) -> DataFrame:
    """bar_id counts bars of n trades; the first bar opens after the first trade and so has n - 1."""
    numbered = tape.withColumn("_rn", F.row_number().over(_by_time()) - 1).withColumn("_all", F.count("*").over(Window.partitionBy("symbol")))
    bar = F.floor(F.col("_rn") / n)
    whole = (F.col("_rn") >= 1) & ((bar + 1) * n <= F.col("_all"))
    return numbered.withColumn("bar_id", F.when(whole, bar)).drop("_rn", "_all")


def _close_fold(tape: DataFrame, step: Callable, start: Callable, inputs: list[str]) -> DataFrame:
    """bar_id from a fold that marks the trades that close a bar."""
    marked = fold(tape, start, step, inputs, "_close int")
    done = F.sum("_close").over(_up_to()) - F.col("_close")
    total = F.sum("_close").over(Window.partitionBy("symbol"))
    numbered = marked.withColumn("_bar", done).withColumn("_total", total).withColumn("_rn", F.row_number().over(_by_time()))
    return numbered.withColumn("bar_id", F.when((F.col("_rn") > 1) & (F.col("_bar") < F.col("_total")), F.col("_bar"))).drop("_close", "_bar", "_total", "_rn")


def threshold_closes(values: np.ndarray, limits: np.ndarray, carried: float, keep_rest: bool, skip: int = 0) -> tuple[np.ndarray, float]:
    """Which rows bring the running sum to its limit; then the sum restarts at 0 or keeps what is over."""
    closes = np.zeros(len(values), np.int32)
    total = carried
    for i, (v, limit) in enumerate(zip(values.tolist(), limits.tolist())):
        if i < skip:
            continue
        total += v
        if total >= limit:
            closes[i] = 1
            total = total - limit if keep_rest else 0.0
    return closes, total


def _threshold(keep_rest: bool, value: Callable, limit: Callable):
    def step(state, x):
        skip = 0 if state["begun"] else 1
        closes, state["sum"] = threshold_closes(value(x), limit(x), state["sum"], keep_rest, skip)
        state["begun"] = True
        return {"_close": closes}

    return step, lambda: {"sum": 0.0, "begun": False}


def assign_volume_bars(tape: DataFrame, volume: float) -> DataFrame:
    """A bar closes when its amounts reach volume; the sum then restarts at zero."""
    step, start = _threshold(False, lambda x: x["amount"], lambda x: np.full(len(x["amount"]), volume))
    return _close_fold(tape, step, start, ["amount"])


def assign_dollar_bars(tape: DataFrame, dollars: float) -> DataFrame:
    """A bar closes when price * amount reaches dollars; what is over counts for the next bar, one close a trade."""
    step, start = _threshold(True, lambda x: x["price"] * x["amount"], lambda x: np.full(len(x["amount"]), dollars))
    return _close_fold(tape, step, start, ["price", "amount"])


def daily_thresholds(tape: DataFrame, bars_a_day: float = 50, span: int = 20, lag_days: int = 0, day: Column | None = None) -> DataFrame:
    """(symbol, day, limit): the EWMA (adjusted) of daily dollar volume over bars_a_day; lag_days days late to avoid look-ahead."""
    day = F.to_date(F.timestamp_micros(F.floor(F.col("ts_ns") / 1000))) if day is None else day
    daily = tape.groupBy("symbol", day.alias("day")).agg(F.sum(F.col("price") * F.col("amount")).alias("dollars"))
    a = 1 - 2 / (span + 1)

    def step(state, x):
        out = np.zeros(len(x["dollars"]))
        for i, v in enumerate(x["dollars"].tolist()):
            state["top"], state["weight"] = state["top"] * a + v, state["weight"] * a + 1
            out[i] = state["top"] / state["weight"]
        return {"limit": out / bars_a_day}

    out = fold(daily, lambda: {"top": 0.0, "weight": 0.0}, step, ["dollars"], "limit double", order=("day",))
    if lag_days:
        w = Window.partitionBy("symbol").orderBy("day")
        out = out.withColumn("limit", F.coalesce(F.lag("limit", lag_days).over(w), F.first("limit").over(w)))
    return out.select("symbol", "day", "limit")


def assign_dynamic_dollar_bars(tape: DataFrame, thresholds: DataFrame, day: Column | None = None, multiplier: float = 1.0) -> DataFrame:
    """Dollar bars whose limit is that of the trade's day; days without one take the last before, then the first after."""
    day = F.to_date(F.timestamp_micros(F.floor(F.col("ts_ns") / 1000))) if day is None else day
    joined = tape.withColumn("_day", day).join(thresholds.withColumnRenamed("day", "_day"), ["symbol", "_day"], "left")
    back = Window.partitionBy("symbol").orderBy(F.desc("ts_ns"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("limit", F.coalesce(F.last("limit", ignorenulls=True).over(_up_to()), F.last("limit", ignorenulls=True).over(back)))
    step, start = _threshold(True, lambda x: x["price"] * x["amount"] * multiplier, lambda x: x["limit"])
    return _close_fold(joined, step, start, ["price", "amount", "limit"]).drop("_day", "limit")


def assign_cusum_bars(tape: DataFrame, sigma: str, floor: float = 0.0005, mult: float = 2.0, whole_times: bool = True) -> DataFrame:
    """A bar closes where the upward or downward sum of log returns passes max(mult * sigma, floor), at the end of a block of one time or, without whole_times, at any trade.

    sigma is carried forward; bars begin with the first known sigma; only the side that fired restarts.
    """
    ready = tape.withColumn("_sigma", F.last(sigma, ignorenulls=True).over(_up_to())).withColumn("_r", natural_log("price")).withColumn("_r", F.col("_r") - F.lag("_r").over(_by_time()))
    ready = ready.withColumn("_r", F.when(F.isnan("_r"), math.inf).otherwise(F.col("_r")))  # between prices of 0; passes any bound, where null is nothing
    ready = ready.withColumn("_last", F.coalesce(F.lead("ts_ns").over(_by_time()) != F.col("ts_ns"), F.lit(True)).cast("int"))

    def step(state, x):
        closes = np.zeros(len(x["_r"]), np.int32)
        for i, (r, s, last) in enumerate(zip(x["_r"].tolist(), x["_sigma"].tolist(), x["_last"].tolist())):
            if s != s or r != r:
                continue
            state["up"], state["down"] = max(0.0, state["up"] + r), min(0.0, state["down"] + r)
            bound = max(mult * s, floor)
            if last or not whole_times:
                if state["up"] >= bound:
                    closes[i], state["up"] = 1, 0.0
                elif state["down"] <= -bound:
                    closes[i], state["down"] = 1, 0.0
        return {"_close": closes}

    return _close_fold(ready, step, lambda: {"up": 0.0, "down": 0.0}, ["_r", "_sigma", "_last"]).drop("_sigma", "_r", "_last")


def ohlcv(trades: DataFrame) -> DataFrame:
    """One row for each bar: close time, open, high, low, close, volume, vwap, trades, median trade size."""
    at = F.struct("ts_ns", "seq")
    return (
        trades.where("bar_id is not null").groupBy("symbol", "bar_id").agg(
            F.max("ts_ns").alias("ts_ns"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
            F.sum("amount").alias("volume"), F.sum(F.col("price") * F.col("amount")).alias("_pv"), F.count("*").alias("trades"), F.percentile("amount", F.lit(0.5)).alias("median_trade_size"),
        )
        .withColumn("vwap", F.coalesce(F.try_divide("_pv", "volume"), F.lit(0.0))).drop("_pv")
    )


def time_bars(tape: DataFrame, step_ns: int) -> DataFrame:
    """OHLCV of every interval from a symbol's first to its last; an interval without trades repeats the last close with volume 0."""
    bars = ohlcv(assign_time_bars(tape, step_ns))
    clock = bars.groupBy("symbol").agg(F.explode(F.sequence(F.min("bar_id"), F.max("bar_id"))).alias("bar_id"))
    full = clock.join(bars, ["symbol", "bar_id"], "left")
    last = F.last("close", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("bar_id").rowsBetween(Window.unboundedPreceding, 0))
    full = full.withColumn("close", last)
    for c in ("open", "high", "low"):
        full = full.withColumn(c, F.coalesce(c, "close"))
    for c in ("volume", "vwap", "trades", "median_trade_size"):
        full = full.withColumn(c, F.coalesce(c, F.lit(0)).cast(bars.schema[c].dataType))
    return full.withColumn("ts_ns", F.col("bar_id") * step_ns).select(bars.columns)


def resample(bars: DataFrame, step_ns: int) -> DataFrame:
    """Bars over step_ns: extremes, sums, volume-weighted vwap and the trade-count-weighted median of median_trade_size."""
    floor = F.col("ts_ns") - F.pmod(F.col("ts_ns"), F.lit(step_ns))
    rows = bars.where("open is not null").withColumn("_b", floor)
    by_size = Window.partitionBy("symbol", "_b").orderBy("median_trade_size", "ts_ns")
    rows = rows.withColumn("_cum", F.sum("trades").over(by_size)).withColumn("_all", F.sum("trades").over(Window.partitionBy("symbol", "_b")))
    return (
        rows.groupBy("symbol", F.col("_b").alias("ts_start_ns")).agg(
            F.min_by("open", "ts_ns").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts_ns").alias("close"), F.sum("volume").alias("volume"),
            F.sum("trades").alias("trades"), F.try_divide(F.sum(F.col("vwap") * F.col("volume")), F.sum("volume")).alias("vwap"),
            F.min(F.when(F.col("_cum") >= 0.5 * F.col("_all"), F.col("median_trade_size"))).alias("median_trade_size"),
        )
    )


def directional(trades: DataFrame) -> DataFrame:
    """Order flow of each bar from trades with side: ticks, volume and dollars bought and sold, spreads at side changes, extremes of the running signed sums."""
    run = _bar().rowsBetween(Window.unboundedPreceding, 0)
    sided = F.col("side") != 0
    value = {"ticks": F.lit(1.0), "volume": F.col("amount"), "dollars": F.col("price") * F.col("amount")}
    rows = trades.withColumn("_s", F.when(F.col("side") != F.lag("side").over(_by_time()), F.abs(F.col("price") - F.lag("price").over(_by_time())))).where("bar_id is not null")
    for name, v in value.items():
        rows = rows.withColumn(f"_{name}", v).withColumn(f"_cum_{name}", F.sum(F.col("side") * v).over(run))
    aggs = []
    for name in value:
        aggs += [F.sum(F.when(F.col("side") > 0, F.col(f"_{name}")).otherwise(0)).alias(f"{name}_buy"), F.sum(F.when(F.col("side") < 0, F.col(f"_{name}")).otherwise(0)).alias(f"{name}_sell")]
    aggs += [F.coalesce(F.try_divide(F.sum(F.when(sided, F.col("_s"))), F.count_if(sided)), F.lit(0.0)).alias("mean_spread"), F.coalesce(F.max(F.when(sided, F.col("_s"))), F.lit(0.0)).alias("max_spread")]
    for name in value:
        aggs += [F.coalesce(F.min(F.when(sided, F.col(f"_cum_{name}"))), F.lit(1e9)).alias(f"cum_{name}_min"), F.coalesce(F.max(F.when(sided, F.col(f"_cum_{name}"))), F.lit(-1e9)).alias(f"cum_{name}_max")]
    return rows.groupBy("symbol", "bar_id").agg(*aggs)


def trade_sizes(trades: DataFrame, theta: str, mult: float = 5.0) -> DataFrame:
    """Trade sizes of each bar relative to the bar's size theta (its last value in the bar); null where theta is 0."""
    limit = F.when(F.col("_theta") != 0, F.col("_theta") * mult)
    rows = trades.where("bar_id is not null").groupBy("symbol", "bar_id").agg(
        F.max_by(theta, F.struct("ts_ns", "seq")).alias("_theta"), F.avg("amount").alias("_mean"), F.percentile("amount", F.lit(0.95)).alias("_p95"),
        F.sum("amount").alias("_sum"), F.sum(F.col("amount") * F.col("amount")).alias("_sq"),
    )
    block = trades.where("bar_id is not null").join(rows.select("symbol", "bar_id", limit.alias("_limit")), ["symbol", "bar_id"]).groupBy("symbol", "bar_id").agg(F.sum(F.when(F.col("amount") > F.col("_limit"), F.col("amount")).otherwise(0.0)).alias("_block"))
    return rows.join(block, ["symbol", "bar_id"]).select(
        "symbol", "bar_id", F.log1p(F.col("_mean") / limit).alias("mean_size_rel"), F.log1p(F.col("_p95") / limit).alias("size_95_rel"),
        F.when(limit.isNotNull(), F.try_divide("_block", "_sum")).alias("pct_block"), F.when(limit.isNotNull(), 1 - F.try_divide("_sq", F.col("_sum") * F.col("_sum"))).alias("size_gini"),
    )


def footprints(trades: DataFrame, tick: float, factor: float = 3.0) -> DataFrame:
    """A row for each bar and each price level from its low to its high: bought and sold volume and ticks, and diagonal imbalances."""
    rows = trades.where("bar_id is not null").withColumn("level", F.bround(F.col("price") / tick).cast("long"))
    side = lambda s, v: F.sum(F.when(F.col("side") == s, v).otherwise(0))
    found = rows.groupBy("symbol", "bar_id", "level").agg(
        side(1, F.col("amount")).alias("buy_volume"), side(-1, F.col("amount")).alias("sell_volume"), side(1, F.lit(1)).alias("buy_ticks"), side(-1, F.lit(1)).alias("sell_ticks")
    )
    dense = rows.groupBy("symbol", "bar_id").agg(F.explode(F.sequence(F.min("level"), F.max("level"))).alias("level"))
    full = dense.join(found, ["symbol", "bar_id", "level"], "left").fillna(0)
    w = Window.partitionBy("symbol", "bar_id").orderBy("level")
    return full.withColumn("sell_imbalance", F.coalesce(F.col("sell_volume") > factor * F.lead("buy_volume").over(w), F.lit(False))).withColumn(
        "buy_imbalance", F.coalesce(F.col("buy_volume") > factor * F.lag("sell_volume").over(w), F.lit(False))
    )


def footprint_features(levels: DataFrame) -> DataFrame:
    """Of each bar's footprint: imbalance counts, longest signed run of imbalances (the first of equals), level of most volume, Gini of volume, skew about the vwap."""
    w = Window.partitionBy("symbol", "bar_id").orderBy("level")
    sign = F.when(F.col("buy_imbalance"), 1).when(F.col("sell_imbalance"), -1).otherwise(0)
    rows = levels.withColumn("_v", F.col("buy_volume") + F.col("sell_volume")).withColumn("_s", sign)
    rows = rows.withColumn("_new", F.when(F.col("_s") == F.lag("_s").over(w), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    runs = rows.where("_s <> 0").groupBy("symbol", "bar_id", "_run", "_s").agg(F.count("*").alias("_n"))
    longest = runs.groupBy("symbol", "bar_id").agg(F.max_by(F.col("_s") * F.col("_n"), F.struct("_n", -F.col("_run"))).alias("imbalance_max_run"))
    out = rows.groupBy("symbol", "bar_id").agg(
        F.count_if("buy_imbalance").alias("buy_imbalances"), F.count_if("sell_imbalance").alias("sell_imbalances"),
        F.max_by("level", F.struct("_v", -F.col("level"))).alias("cot_level"), (1 - F.try_divide(F.sum(F.col("_v") * F.col("_v")), F.sum("_v") * F.sum("_v"))).alias("vp_gini"),
        F.sum(F.col("level") * F.col("_v")).alias("_lv"), F.sum("_v").alias("_sum"),
    )
    out = out.withColumn("vp_skew", F.when(F.col("_sum") > 0, F.lit(0.0))).drop("_lv", "_sum")  # a first central moment: zero by its definition
    return out.join(longest, ["symbol", "bar_id"], "left").fillna({"imbalance_max_run": 0})


def footprint_arrays(levels: DataFrame) -> DataFrame:
    """One row for each bar with its levels as an array of structs in ascending order."""
    return levels.groupBy("symbol", "bar_id").agg(F.sort_array(F.collect_list(F.struct("level", "buy_volume", "sell_volume", "buy_ticks", "sell_ticks", "buy_imbalance", "sell_imbalance"))).alias("levels"))


def explode_footprints(arrays: DataFrame, tick: float) -> DataFrame:
    """Footprint rows with prices, bars ascending and prices descending."""
    out = arrays.select("symbol", "bar_id", F.explode("levels").alias("_l")).select("symbol", "bar_id", "_l.*")
    return out.withColumn("price", F.col("level") * tick).orderBy("symbol", "bar_id", F.desc("price"))


def volume_profile(levels: DataFrame, bars: DataFrame, window_ns: int, tick: float, share: float = 0.6834, bins: int | None = None) -> DataFrame:
    """(symbol, bar_id, poc, hva, lva, pct_above_poc) of the levels of each bar and the bars up to window_ns before it.

    The value area grows from the level of most volume by the two levels on the side that has more, both sides at a tie.
    With bins, the levels are first put together in about so many of one width.

    Bars are dealt by time buckets of window_ns, each with the bucket before it, and folded in order: the levels of a
    bar are added once and taken off once, whatever the window holds.  Bars of one time have one window.
    """
    times = bars.where(F.col("symbol").isNotNull() & F.col("ts_ns").isNotNull()).select("symbol", "bar_id", "ts_ns")
    volume = levels.join(times, ["symbol", "bar_id"]).groupBy("symbol", "ts_ns", "level").agg(F.sum(F.col("buy_volume") + F.col("sell_volume")).cast("double").alias("v"))
    volume = volume.groupBy("symbol", "ts_ns").agg(F.sort_array(F.collect_list(F.struct("level", "v"))).alias("_p"))
    first = times.groupBy("symbol").agg(F.min("ts_ns").alias("_t0"))
    rows = times.select("symbol", "ts_ns").distinct().join(volume, ["symbol", "ts_ns"], "left").join(F.broadcast(first), "symbol")
    rows = rows.select("symbol", "ts_ns", F.col("_p.level").alias("_level"), F.col("_p.v").alias("_volume"), (F.col("ts_ns") >= F.col("_t0") + window_ns).alias("_full"), F.explode(F.array(F.lit(0), F.lit(1))).alias("_later"))
    rows = rows.withColumn("_full", F.col("_full") & (F.col("_later") == 0)).withColumn("_key", F.concat_ws("@", "symbol", F.floor(F.col("ts_ns") / window_ns) + F.col("_later")))

    def step(s, c):
        out = {k: np.full(len(c["ts_ns"]), np.nan) for k in ("poc", "hva", "lva", "pct_above_poc")}

        def put(level, x, count):
            """Adds x to the levels' sums, kept as two doubles each, so that what is taken off leaves no trace."""
            i = np.searchsorted(s["level"], level)
            h = s["high"][i]
            total = h + x
            part = total - h
            s["low"][i] += (h - (total - part)) + (x - part)
            s["high"][i] = total
            s["n"][i] += count

        for i, (t, level, volume, full) in enumerate(zip(c["ts_ns"].tolist(), c["_level"], c["_volume"], c["_full"].tolist())):
            while s["open"] and s["open"][0][0] < t - window_ns:
                _, old, x = s["open"].popleft()
                put(old, -x, -1)
            if level is not None and len(level):
                level, volume = np.asarray(level), np.asarray(volume, float)
                new = np.setdiff1d(level, s["level"], assume_unique=True)
                if len(new):
                    live = s["n"] > 0
                    at = np.searchsorted(s["level"][live], new)
                    s.update({k: np.insert(s[k][live], at, new if k == "level" else 0) for k in ("level", "high", "low", "n")})
                    # a level of the bar may have been dropped with those that no bar holds
                    lost = np.setdiff1d(level, s["level"], assume_unique=True)
                    at = np.searchsorted(s["level"], lost)
                    s.update({k: np.insert(s[k], at, lost if k == "level" else 0) for k in ("level", "high", "low", "n")})
                put(level, volume, 1)
                s["open"].append((t, level, volume))
            live = np.flatnonzero(s["n"] > 0) if full else ()
            if len(live):
                poc, hva, lva, above = profile_area(s["level"][live], s["high"][live] + s["low"][live], share, bins)
                out["poc"][i], out["hva"][i], out["lva"][i], out["pct_above_poc"][i] = poc * tick, hva * tick, lva * tick, above
        return out

    start = lambda: {"open": deque(), "level": np.zeros(0, np.int64), "high": np.zeros(0), "low": np.zeros(0), "n": np.zeros(0, np.int64)}
    made = fold(rows, start, step, ["ts_ns", "_level", "_volume", "_full"], "poc double, hva double, lva double, pct_above_poc double", by="_key", order=("ts_ns",))
    return times.join(made.where("_full and poc is not null").drop("_level", "_volume", "_full", "_later", "_key", "_t0"), ["symbol", "ts_ns"]).select("symbol", "bar_id", "poc", "hva", "lva", "pct_above_poc")


def volume_profile_between(levels: DataFrame, bars: DataFrame, start_ns: int, end_ns: int, window_ns: int, tick: float, share: float = 0.6834, bins: int | None = None) -> DataFrame:
    """volume_profile of the bars from start_ns to end_ns; the window before start_ns is read too, so the first bars have theirs whole where the bars reach back so far."""
    near = bars.where(F.col("ts_ns").between(start_ns - window_ns, end_ns))
    inside = near.where(F.col("ts_ns") >= start_ns).select("symbol", "bar_id")
    return volume_profile(levels, near, window_ns, tick, share, bins).join(inside, ["symbol", "bar_id"], "left_semi")


def developing_profile(levels: DataFrame, bars: DataFrame, tick: float, start_ns: int | None = None, end_ns: int | None = None, share: float = 0.6834, bins: int | None = None) -> DataFrame:
    """(symbol, bar_id, ts_ns, poc, hva, lva, pct_above_poc) after each bar from start_ns to end_ns of all volume since start_ns.

    A fold: the state is one sum for each level between a symbol's lowest and highest so far.  A bar before
    which nothing was bought or sold has nulls.
    """
    at = F.col("ts_ns")
    inside = (F.lit(True) if start_ns is None else at >= start_ns) & (F.lit(True) if end_ns is None else at <= end_ns)
    one = levels.groupBy("symbol", "bar_id").agg(F.sort_array(F.collect_list(F.struct("level", (F.col("buy_volume") + F.col("sell_volume")).cast("double").alias("v")))).alias("_p"))
    rows = bars.where(inside).select("symbol", "bar_id", "ts_ns").join(one, ["symbol", "bar_id"]).select("symbol", "bar_id", "ts_ns", F.col("_p.level").alias("_level"), F.col("_p.v").alias("_volume"))

    def step(s, c):
        out = {k: np.full(len(c["_level"]), np.nan) for k in ("poc", "hva", "lva", "pct_above_poc")}
        for i, (level, volume) in enumerate(zip(c["_level"], c["_volume"])):
            if not len(level):
                continue
            low, high = int(level[0]), int(level[-1])
            if not len(s["sum"]):
                s["low"] = low
            before, after = max(0, s["low"] - low), max(0, high - (s["low"] + len(s["sum"]) - 1))
            s["sum"], s["low"] = np.pad(s["sum"], (before, after)), s["low"] - before
            s["sum"][np.asarray(level) - s["low"]] += volume
            if s["sum"].any():
                area = profile_area(s["low"] + np.arange(len(s["sum"])), s["sum"], share, bins)
                for k, v in zip(out, area):
                    out[k][i] = v if k == "pct_above_poc" else v * tick
        return out

    made = fold(rows, lambda: {"low": 0, "sum": np.zeros(0)}, step, ["_level", "_volume"], "poc double, hva double, lva double, pct_above_poc double", order=("ts_ns", "bar_id"))
    return made.drop("_level", "_volume")


def profile_area(level: np.ndarray, volume: np.ndarray, share: float = 0.6834, bins: int | None = None) -> tuple[float, float, float, float]:
    """Level of most volume, highest and lowest level of the value area, share of volume above the first."""
    names = np.arange(int(level[0]), int(level[-1]) + 1)
    dense = np.zeros(len(names))
    dense[(level - level[0]).astype(int)] = volume
    if bins is not None and dense.any():
        used = np.flatnonzero(dense)
        names, dense = rebin_levels(names[used[0] : used[-1] + 1], dense[used[0] : used[-1] + 1], bins)
    total, at = dense.sum(), int(dense.argmax())
    lo = hi = at
    inside = dense[at]
    while inside < share * total and (lo > 0 or hi < len(dense) - 1):
        up, down = dense[hi + 1 : hi + 3].sum(), dense[max(0, lo - 2) : lo].sum()
        grow_up = hi < len(dense) - 1 and (up >= down or lo == 0)
        grow_down = lo > 0 and (down >= up or hi == len(dense) - 1)
        if grow_up:
            hi, inside = min(len(dense) - 1, hi + 2), inside + up
        if grow_down:
            lo, inside = max(0, lo - 2), inside + down
    return float(names[at]), float(names[hi]), float(names[lo]), float(dense[at + 1 :].sum() / total) if total else 0.0


def rebin_levels(level: np.ndarray, volume: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """About bins levels of one odd width, each named by its middle; a highest level that begins a width is its own."""
    low, high = int(level[0]), int(level[-1])
    width = max(1, (high - low) // bins) | 1
    k = ((level - low) // width).astype(int)
    names = low + np.arange(int(k.max()) + 1) * width + width // 2
    if (high - low) % width == 0:
        names[-1] = high
    return names, np.bincount(k, volume, len(names))


def footprint_ok(levels: DataFrame) -> DataFrame:
    """(symbol, bar_id, ok): whether a bar's levels have no gap, no repeat, no null and no volume or tick count below 0."""
    parts = ("buy_volume", "sell_volume", "buy_ticks", "sell_ticks")
    good = F.count_if(F.least(*parts) >= 0) == F.count("*")
    whole = F.coalesce((F.max("level") - F.min("level") + 1 == F.count("*")) & (F.count_distinct("level") == F.count("*")), F.lit(False))
    known = F.count_if(F.col("buy_imbalance").isNull() | F.col("sell_imbalance").isNull() | F.least(*[F.col(c).isNotNull() for c in parts]).eqNullSafe(False)) == 0
    return levels.groupBy("symbol", "bar_id").agg((good & whole & known).alias("ok"))


def footprints_between(levels: DataFrame, bars: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """The levels of the bars that close from start_ns to end_ns."""
    return levels.join(bars.where(F.col("ts_ns").between(start_ns, end_ns)).select("symbol", "bar_id"), ["symbol", "bar_id"], "left_semi")


def session_date(ts: Column, from_hour: int = 21) -> Column:
    """The session of a futures trade: the next day from from_hour on, else the same."""
    return F.when(F.hour(ts) >= from_hour, F.date_add(F.to_date(ts), 1)).otherwise(F.to_date(ts))
