"""Deep screening of rule candidates: reliability, burden and held-out trading of every combination at once.

A combination is a CUSUM rate, a fast and a slow average and, for uniqueness, a
horizon in bars.  One fold over the bars makes the averages and filters of all
combinations, for the whole series and anew from the first held-out bar; one
explode keys their events; everything after it is grouped by (symbol,
combination), so no combination costs a pass of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.recursive import decayed, ew_std
from tickloom.functions.rolling import BARS, Over, natural_log, quotient, ret
from tickloom.operators import labels
from tickloom.operators.backtest import unit_rank
from tickloom.operators.fold import fold

# What an unreliable or thin candidate loses of its score, and when.
PENALTIES = {"oos_unreliable": 0.75, "low_info": 0.50, "low_trade_count": 0.50, "low_oos_recall": 0.50}
MIN_TRADES, MIN_RECALL = 10, 0.01
# The weights of the ranks of a candidate.
WEIGHTS = {"effective_recall": 0.45, "turnover": 0.10, "uniqueness": 0.10, "sharpe": 0.20, "net_pnl": 0.10, "mdd": 0.05}
DAY_NS = 86_400_000_000_000


def _recursions(rows: DataFrame, rates: Sequence[dict], spans: Sequence[int], order: Sequence[str]) -> DataFrame:
    """rows (close, _r, _test) with _m<span> and _n<span>, exponential averages of close from the first and from the first held-out row, and _e<i> and _t<i>, the CUSUM events of each rate likewise."""

    def average(s, key, x, a):
        if not len(x):
            return x
        head = s.get(key)
        out = decayed(a * x, 1 - a, x[0] if head is None else head)
        if head is None:
            out = np.concatenate((x[:1], decayed(a * x[1:], 1 - a, x[0])))
        s[key] = out[-1]
        return out

    def events(s, key, x, k):
        up, down, begun = s.get(key, (0.0, 0.0, False))
        out = np.zeros(len(x), np.int32)
        for i, v in enumerate(x.tolist()):
            if begun and v == v:
                up, down = max(0.0, up + v), min(0.0, down + v)
                if down < -k:
                    out[i], down = -1, 0.0
                elif up > k:
                    out[i], up = 1, 0.0
            begun = True
        s[key] = up, down, begun
        return out

    def step(s, c):
        test = c["_test"].astype(bool)
        at = int(len(test) - test.sum())  # held-out rows come last
        out = {}
        for n in spans:
            a = 2 / (n + 1)
            out[f"_m{n}"] = average(s, f"m{n}", c["close"], a)
            out[f"_n{n}"] = np.concatenate((np.full(at, np.nan), average(s, f"n{n}", c["close"][at:], a)))
        for i, r in enumerate(rates):
            out[f"_e{i}"] = events(s, f"e{i}", c["_r"], r["k"])
            out[f"_t{i}"] = np.concatenate((np.zeros(at, np.int32), events(s, f"t{i}", c["_r"][at:], r["k"])))
        return out

    made = [f"_m{n} double, _n{n} double" for n in spans] + [f"_e{i} int, _t{i} int" for i in range(len(rates))]
    return fold(rows, dict, step, ["close", "_r", "_test"], ", ".join(made), order=order)


def nearest_label(rows: DataFrame, trend: DataFrame, tolerance_ns: int = 0) -> DataFrame:
    """rows with _label (side, ts_ns) of the nearest row of trend with a side, within tolerance_ns; of two as near the earlier.

    The label before and the one after are running values over the union of both, so no range is joined.
    """
    known = trend.where("side <> 0").select("symbol", "ts_ns", F.struct(F.col("side").cast("int").alias("side"), "ts_ns").alias("_label"))
    both = labels.asof_next(labels.asof_last(rows, known.withColumnRenamed("_label", "_before"), "ts_ns", "_before"), known.withColumnRenamed("_label", "_after"), "ts_ns", "_after")
    back, ahead = F.col("ts_ns") - F.col("_before.ts_ns"), F.col("_after.ts_ns") - F.col("ts_ns")
    near = F.when(back <= F.coalesce(ahead, back), F.col("_before")).otherwise(F.coalesce("_after", "_before"))
    at = F.abs(F.col("ts_ns") - F.col("_label.ts_ns"))
    return both.withColumn("_label", near).withColumn("_label", F.when(at <= tolerance_ns, F.col("_label"))).drop("_before", "_after")


def _trades(events: DataFrame, exit_: str, hold: int, commission: float, slippage: float) -> DataFrame:
    """(key, rn, pnl): what each position of a candidate's held-out events earns after costs.

    A flat candidate enters at the open of an event's bar with its side.  It leaves at the open of an event that shows
    the other side (reverse) or comes hold bars later (hold), and at the close of its last event.
    """
    last = F.lead("rn").over(Window.partitionBy("key").orderBy("rn")).isNull()

    def step(s, c):
        out = np.full(len(c["rn"]), np.nan)
        for i, (rn, side, open_, close, end) in enumerate(zip(c["rn"].tolist(), c["side"].tolist(), c["open"].tolist(), c["close"].tolist(), c["_last"].tolist())):
            if s["side"]:
                leave = side * s["side"] < 0 if exit_ == "reverse" else rn - s["rn"] >= hold
                price = close if end else open_ if leave else None
                if price is not None:
                    out[i] = (price - s["price"]) * s["side"] - ((s["price"] + price) * commission + 2 * slippage)
                    s["side"] = 0
            if not s["side"] and side:
                s.update(side=side, rn=rn, price=open_)
        return {"pnl": out}

    rows = events.select("key", "rn", "side", "open", "close").withColumn("_last", last)
    return fold(rows, lambda: {"side": 0, "rn": 0, "price": 0.0}, step, ["rn", "side", "open", "close", "_last"], "pnl double", by="key", order=("rn",)).where("pnl is not null").select("key", "rn", "pnl")


def deep_metrics(
    b: DataFrame, trend: DataFrame, rates: Sequence[dict], combos: Sequence[dict], test_ratio: float = 0.3, tolerance_ns: int = 0, least: int = 10,
    exit_: str = "reverse", hold: int = 20, commission: float = 0.0, slippage: float = 0.0, over: Over = BARS,
) -> DataFrame:
    """One row a symbol and combination of ``backtest.deep_grid``.

    b has symbol, ts_ns, open, close and the columns of over's order; trend has (symbol, ts_ns, side); rates holds the
    threshold k of each rate (``backtest.calibrate_cusum``).

    Of the labels with a side those that an event of the combination stands at (coverage), the share of them with its
    side (precision, and lift over always naming the commoner side), and recall, the right ones over those and the
    labels without an event; uniqueness (mean, of events that each last
    vertical_bars bars; low_info without events); turnover (events a year times events of a day that has any) and the
    mean gap of events in hours; stability, 1 less the deviation of the share of right sides between bars of high and
    low volatility (0 unless both have labelled events); oos_recall, the recall on the last test_ratio of the bars with
    averages and filter begun anew there, an event standing for the nearest label within tolerance_ns (oos_unreliable,
    and 0, where they hold under least labels); net_pnl, sharpe, mdd and trade_count of the held-out trades
    (see ``_trades``; none in under max(slow + 2, 10) bars).  What cannot be told is 0.
    """
    spans = sorted({c[x] for c in combos for x in ("fast", "slow")})
    index = {r["rate"]: i for i, r in enumerate(rates)}
    base = {(c["rate"], c["fast"], c["slow"]): c["base_combo_id"] for c in combos}
    whole = Window.partitionBy("symbol")
    rows = b.withColumn("rn", F.row_number().over(over.all)).withColumn("_n", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("_split", F.floor(F.col("_n") * (1 - test_ratio))).withColumn("_test", F.col("rn") > F.col("_split"))
    rows = rows.withColumn("_r", natural_log(quotient("close", F.lag("close").over(over.all)))).withColumn("_pct", ret("close", 1, over=over, ieee=True))
    rows = rows.withColumn("_r", F.when(F.isnan("_r"), math.inf).otherwise(F.col("_r")))  # 0 over 0 fires upwards as 1 over 0 does, only null is nothing
    rows = ew_std(rows, "_pct", 20, "_vol", order=over.order)
    lost = F.max(F.isnan("_pct") | (F.abs("_pct") == math.inf)).over(over.up_to)  # no deviation behind a return that is no number
    rows = rows.withColumn("_vol", F.when(F.col("_pct").isNotNull() & lost, math.nan).otherwise(F.col("_vol")))
    rows = _recursions(rows, rates, spans, over.order).drop("_pct", "_r")
    rows = nearest_label(rows, trend, tolerance_ns)
    rows = rows.join(trend.select("symbol", "ts_ns", F.col("side").cast("int").alias("_own")), ["symbol", "ts_ns"], "left")
    mark = rows.groupBy("symbol").agg(F.percentile("_vol", F.lit(0.5)).alias("_mark"), F.max("_n").alias("_bars"), F.max("_split").alias("_split"), F.min(F.when(F.col("_test"), F.col("ts_ns"))).alias("_from"), (F.floor((F.max("ts_ns") - F.min("ts_ns")) / DAY_NS) / 365.25).alias("_years"))

    def side(name: str, fast: int, slow: int):
        return F.when(F.col(f"{name}{fast}") > F.col(f"{name}{slow}"), 1).otherwise(-1)

    keyed = F.array(*[
        F.when(F.col(f"{event}{index[rate]}") != 0, F.struct(F.lit(name).alias("base_combo_id"), F.lit(float(rate)).alias("rate"), F.lit(slow).alias("slow"), F.lit(held).alias("held"), side(average, fast, slow).alias("side")))
        for (rate, fast, slow), name in base.items() for event, average, held in (("_e", "_m", False), ("_t", "_n", True))
    ])
    events = rows.select("symbol", "ts_ns", "rn", "open", "close", "_vol", "_label", "_own", F.explode(F.filter(keyed, lambda x: x.isNotNull())).alias("c"))
    events = events.select("symbol", "ts_ns", "rn", "open", "close", "_vol", "_label", "_own", "c.*")
    key = ["symbol", "base_combo_id"]

    # Labels: how many there are, and in the held-out part.
    of = trend.join(mark.select("symbol", "_from"), "symbol").groupBy("symbol").agg(
        F.count_if(F.col("side") != 0).alias("_sides"), F.greatest(F.count_if(F.col("side") > 0), F.count_if(F.col("side") < 0)).alias("_most"), F.count_if(F.col("ts_ns") >= F.col("_from")).alias("_held"), F.count_if((F.col("ts_ns") >= F.col("_from")) & (F.col("side") != 0)).alias("_held_sides")
    )
    exact = (F.col("_own") == F.col("side")) & (F.col("_own") != 0)
    near_hit = F.when(F.col("_label.side") == F.col("side"), F.col("_label.ts_ns"))
    held = F.col("held") & (F.col("_label.ts_ns") >= F.col("_from"))
    high = F.col("_vol") > F.col("_mark")
    labelled = ~F.col("held") & (F.col("_own") != 0)
    right = lambda regime: F.avg(F.when(labelled & regime, exact.cast("double")))
    counts = events.join(mark, "symbol").groupBy(*key).agg(
        F.count_if(~F.col("held")).alias("events"), F.count_if(labelled).alias("_met"), F.count_if(~F.col("held") & exact).alias("_hits"), right(high).alias("_high"), right(~high).alias("_low"),
        F.countDistinct(F.when(held, near_hit)).alias("_tp"), F.countDistinct(F.when(held, F.col("_label.ts_ns"))).alias("_near"),
    )
    # Burden of each rate's events.
    first = {rate: name for (rate, _, _), name in base.items()}  # any pair of averages has all events of its rate
    own = events.where(~F.col("held") & F.col("base_combo_id").isin(*first.values()))
    days = own.groupBy("symbol", "rate", F.floor(F.col("ts_ns") / DAY_NS).alias("_day")).agg(F.count(F.lit(1)).alias("_n"), F.min("ts_ns").alias("_a"), F.max("ts_ns").alias("_b"))
    burden = days.groupBy("symbol", "rate").agg(F.sum("_n").alias("_all"), F.avg("_n").alias("_mean"), ((F.max("_b") - F.min("_a")) / 3.6e12).alias("_hours"))
    # Uniqueness: all events of a rate last as many bars, so concurrency is a running count of events.
    horizons = sorted({(c["rate"], c["vertical_bars"]) for c in combos})
    up, order = rows, Window.partitionBy("symbol").orderBy("rn")
    for j, (rate, v) in enumerate(horizons):
        open_ = F.sum((F.col(f"_e{index[rate]}") != 0).cast("int")).over(order.rowsBetween(-v, 0))
        up = up.withColumn(f"_i{j}", F.when(open_ > 0, 1 / open_))
    unique = [F.avg(F.when(F.col(f"_e{index[rate]}") != 0, F.col(f"_u{j}"))).alias(f"_u{j}") for j, (rate, _) in enumerate(horizons)]
    up = up.select("symbol", *[f"_e{i}" for i in range(len(rates))], *[F.avg(f"_i{j}").over(order.rowsBetween(0, v)).alias(f"_u{j}") for j, (_, v) in enumerate(horizons)]).groupBy("symbol").agg(*unique)
    up = up.select("symbol", F.explode(F.array(*[F.struct(F.lit(float(rate)).alias("rate"), F.lit(v).alias("vertical_bars"), F.col(f"_u{j}").alias("_u")) for j, (rate, v) in enumerate(horizons)])).alias("u")).select("symbol", "u.*")
    # Held-out trades.
    tradable = events.join(mark.select("symbol", "_bars", "_split"), "symbol").where(F.col("held") & (F.col("_bars") - F.col("_split") >= F.greatest(F.col("slow") + 2, F.lit(10))))
    done = _trades(tradable.withColumn("key", F.to_json(F.struct(*key))), exit_, hold, commission, slippage)
    run = Window.partitionBy("key").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    done = done.withColumn("_sum", F.sum("pnl").over(run)).withColumn("_fall", F.col("_sum") - F.max("_sum").over(run))
    made = done.groupBy("key").agg(F.sum("pnl").alias("net_pnl"), F.when(F.stddev_pop("pnl") > 0, F.avg("pnl") / F.stddev_pop("pnl")).alias("sharpe"), F.min("_fall").alias("mdd"), F.count("pnl").alias("trade_count"))
    made = made.withColumn("key", F.from_json("key", "symbol string, base_combo_id string")).select("key.*", "net_pnl", "sharpe", "mdd", "trade_count")

    table = F.explode(F.array(*[F.struct(*[F.lit(float(c[x]) if x == "rate" else c[x]).alias(x) for x in ("combo_id", "base_combo_id", "rate", "fast", "slow", "vertical_bars")]) for c in combos]))
    out = mark.withColumn("c", table).select("symbol", "_bars", "_years", "c.*")
    out = out.join(counts, key, "left").join(made, key, "left").join(burden, ["symbol", "rate"], "left").join(up, ["symbol", "rate", "vertical_bars"], "left").join(of, "symbol", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    low_labels = F.coalesce(F.col("_held") < least, F.lit(True))
    precision = F.try_divide("_hits", "_met")
    spread = F.abs(F.col("_high") - F.col("_low")) / 2  # the deviation of two numbers
    return out.select(
        "symbol", "combo_id", "base_combo_id", "rate", "fast", "slow", "vertical_bars", F.coalesce("events", F.lit(0)).alias("events"),
        zero(F.try_divide("_hits", F.col("_hits") + F.col("_sides") - F.col("_met"))).alias("recall"), zero(precision).alias("precision"), zero(F.try_divide("_met", "_sides")).alias("coverage"), zero(F.try_divide(precision * F.col("_sides"), F.col("_most"))).alias("lift"),
        zero(F.col("_u")).alias("uniqueness"), (zero(F.col("_u")) == 0).alias("low_info"),
        zero(F.try_divide("_all", "_years") * F.col("_mean")).alias("turnover"), zero(F.try_divide("_hours", F.col("_all") - 1)).alias("mean_gap_hours"),
        zero(1 - spread).alias("stability"),
        F.when(low_labels, 0.0).otherwise(zero(F.when(F.col("_near") > 0, F.try_divide("_tp", F.col("_tp") + F.col("_held_sides") - F.col("_near"))))).alias("oos_recall"), low_labels.alias("oos_unreliable"),
        zero(F.col("net_pnl")).alias("net_pnl"), zero(F.col("sharpe")).alias("sharpe"), zero(F.col("mdd")).alias("mdd"), F.coalesce("trade_count", F.lit(0)).alias("trade_count"),
    )


def collapse(deep: DataFrame) -> DataFrame:
    """The best row of each symbol's base combination: reliable before unreliable, informed before not, then by held-out recall, trades, sharpe, net result, drawdown and uniqueness; ties by the shorter horizon."""
    best = [F.asc("oos_unreliable"), F.asc("low_info"), *[F.desc(F.round(c, 9)) for c in ("oos_recall", "trade_count", "sharpe", "net_pnl", "mdd", "uniqueness")], F.asc("vertical_bars")]
    return deep.withColumn("_k", F.row_number().over(Window.partitionBy("symbol", "base_combo_id").orderBy(*best))).where("_k = 1").drop("_k")


def screen(deep: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """One ranked row a symbol and base combination: the weighted unit ranks of its best row, less penalties.

    effective_recall (recall times lift) is ranked within its rate, the others among the symbol's candidates; less
    turnover is better.  reason names the last penalty that applies.
    """
    rows = collapse(deep).withColumn("effective_recall", F.col("recall") * F.col("lift"))
    rows = rows.withColumns({f"_{c}": F.round(c, 9) for c in weights})  # sums differ by their order; ties must not
    scored = sum((unit_rank(f"_{c}", c != "turnover", ("symbol", "rate") if c == "effective_recall" else ("symbol",)) * w for c, w in weights.items()), F.lit(0.0))
    flags = {"oos_unreliable": F.col("oos_unreliable"), "low_info": F.col("low_info"), "low_trade_count": F.col("trade_count") < MIN_TRADES, "low_oos_recall": F.col("oos_recall") < MIN_RECALL}
    penalty = sum((F.when(flags[k], v).otherwise(0.0) for k, v in PENALTIES.items()), F.lit(0.0))
    reason = F.coalesce(*[F.when(flags[k], k) for k in reversed(PENALTIES)], F.lit("verified"))
    out = rows.withColumn("score", scored - penalty).withColumn("reason", reason).drop(*[f"_{c}" for c in weights])
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(F.round("score", 9)), "base_combo_id")))
