"""Barriers of many events, and grids of barriers, by first passages.

A barrier of an event is a price level, and the path reaches it first at the first
row beyond it.  Events are grouped by symbol and by time buckets as wide as the
longest horizon; a group has its events and the prices of two buckets, so a price
is dealt twice whatever the number of events, and no event is joined with the rows
of its path.  In a group the prices' running maxima and minima by powers of two
(a tree) answer each barrier of all events at once in as many steps as the tree is high.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.buckets import normal_cdf
from tickloom.operators.validation import expected_max_sharpe, sample_kurtosis, sample_skew

_OUT = "symbol string, event_ns long, target double, side int, profit double, loss double, vertical_ns long, t1_ns long, ret double, entry double, exit double, touch string"
_TOUCHES = ("upper", "lower", "vertical")


def records(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the record highs and record lows of p, the first row among both."""
    if not len(p):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    high, low = np.maximum.accumulate(p), np.minimum.accumulate(p)
    return np.flatnonzero(np.r_[True, p[1:] > high[:-1]]), np.flatnonzero(np.r_[True, p[1:] < low[:-1]])


def tree(p: np.ndarray, high: bool) -> list[np.ndarray]:
    """Maxima (minima) of p by blocks of 1, 2, 4, ... rows; NaN rows and those behind the end are never beyond a level."""
    none = -np.inf if high else np.inf
    levels = [np.where(np.isnan(p), none, p)]
    while len(levels[-1]) > 1:
        x = levels[-1]
        x = np.append(x, none) if len(x) % 2 else x
        levels.append((np.maximum if high else np.minimum)(x[::2], x[1::2]))
    return levels


def first_beyond(levels: list[np.ndarray], start: np.ndarray, last: np.ndarray, beyond) -> np.ndarray:
    """For each i the first row from start[i] to last[i] for which beyond(values, i) holds, else the number of rows.

    beyond is true of a block's maximum (minimum) if and only if it is true of one of the block's rows.
    """
    n = len(levels[0])
    out = np.full(len(start), n)
    i = np.flatnonzero(start <= np.minimum(last, n - 1))
    at, h = start[i].copy(), 0
    while len(i):  # up: blocks that begin where all before them is seen
        odd = np.flatnonzero((at & 1 == 1) | (h == len(levels) - 1))
        hit = odd[beyond(levels[h][at[odd]], i[odd])]
        row, who = at[hit], i[hit]
        for below in range(h - 1, -1, -1):  # down: the left half if it holds the row
            row = row * 2
            left = beyond(levels[below][row], who)
            row = np.where(left, row, row + 1)
        out[who] = np.where(row <= last[who], row, n)
        at[odd] += 1
        left = np.ones(len(i), bool)
        left[hit] = False
        at, i, h = at[left] >> 1, i[left], h + 1
        if h == len(levels):
            break
        more = (at << h <= last[i]) & (at < len(levels[h]))
        at, i = at[more], i[more]
    return out


def _log_ratio(p: np.ndarray, p0: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log(p / p0)


def passages(t: np.ndarray, p: np.ndarray, event_ns: np.ndarray, target: np.ndarray, side: np.ndarray, pairs: Sequence[tuple[float | None, float | None]], verticals: Sequence[int], min_close_ns: int, trees: tuple | None = None):
    """(event, pair, vertical, row of the exit, ret, row of the entry, touch) arrays of all events, pairs of barriers and horizons that have a row behind the entry.

    t and p are the rows of the path in order; a price of NaN is unknown: it is no touch, and a return from or to it is NaN.
    """
    highs, lows = trees or (tree(p, True), tree(p, False))
    entry = np.searchsorted(t, event_ns, "left")
    ends = [np.searchsorted(t, event_ns + v, "right") - 1 for v in verticals]
    far = np.max(ends, axis=0) if len(ends) else np.full(len(entry), -1)
    some = np.flatnonzero(far > entry)
    entry, far, side, target, e_ns = entry[some], far[some], side[some], target[some], event_ns[some]
    start = np.maximum(entry + 1, np.searchsorted(t, e_ns + min_close_ns, "left"))
    p0, up = p[entry], side >= 0
    plain = p0 > 0
    n = len(p)
    got: dict[tuple[bool, float | None], np.ndarray] = {}

    def search(levels, which, beyond):
        out = np.full(len(entry), n)
        k = np.flatnonzero(which)
        out[k] = first_beyond(levels, start[k], far[k], lambda x, i: beyond(x, k[i]))
        return out

    def reach(gain: bool, multiple: float | None) -> np.ndarray:
        """The first row whose return is at least target * multiple (gain), or at most minus that."""
        if (gain, multiple) in got:
            return got[gain, multiple]
        out = np.full(len(entry), n)
        if multiple is not None:
            limit, sign = target * multiple, 1 if gain else -1
            for levels, which in ((highs, up == gain), (lows, up != gain)):
                out = np.minimum(out, search(levels, plain & which, lambda x, k: sign * _log_ratio(x, p0[k]) * side[k] >= limit[k]))
            # from 0 every price above is an infinite return, and 0 is NaN, which is greater than any number
            zero = p0 == 0
            out = np.minimum(out, search(highs, zero & (up == gain) & (side != 0), lambda x, k: x > 0))
            if gain:
                out = np.minimum(out, search(lows, zero, lambda x, k: x == 0))
        return got.setdefault((gain, multiple), out)

    found = []
    for v, end in enumerate(ends):
        end = end[some]
        for k, (profit, loss) in enumerate(pairs):
            gain, pain = reach(True, profit), reach(False, loss)
            row = np.minimum(gain, pain)
            hit = row <= np.minimum(end, n - 1)
            touch = np.where(~hit, 2, np.where(gain <= pain, 0, 1))
            row = np.where(hit, row, end)
            has = np.flatnonzero(end > entry)
            row, touch = row[has], touch[has]
            with np.errstate(invalid="ignore"):
                found.append((some[has], np.full(len(has), k), np.full(len(has), v), row, _log_ratio(p[row], p0[has]) * side[has], entry[has], touch))
    return [np.concatenate(x) for x in zip(*found)]


def _gridded(pairs: Sequence[tuple[float | None, float | None]], verticals: Sequence[int], min_close_ns: int, rows: int):
    names = [x.split()[0] for x in _OUT.split(", ")]

    def known(x: np.ndarray, null: np.ndarray) -> pa.Array:
        return pa.array(x, pa.float64(), mask=null)

    def run(events: pa.Table, prices: pa.Table) -> pa.Table:
        numbers = lambda table, c: table.column(c).to_numpy()
        t, q = numbers(prices, "t"), numbers(prices, "q")
        p = prices.column("p").combine_chunks().fill_null(math.nan).to_numpy(zero_copy_only=False)
        order = np.lexsort((q, t))
        t, p = t[order], p[order]
        trees = (tree(p, True), tree(p, False)) if len(p) else None
        event_ns, target, side = numbers(events, "event_ns"), numbers(events, "target"), numbers(events, "side").astype(np.int64)
        made = []
        for a in range(0, len(event_ns) if len(p) else 0, rows):
            b = slice(a, a + rows)
            e, k, v, row, ret, entry, touch = passages(t, p, event_ns[b], target[b], side[b], pairs, verticals, min_close_ns, trees)
            key = [events.column(c).combine_chunks().take(pa.array(a + e)) for c in ("symbol", "event_ns", "target", "side")]
            multiples = [pa.array([x[i] for x in pairs], pa.float64()).take(pa.array(k)) for i in (0, 1)]
            first, last = np.isnan(p[entry]), np.isnan(p[row])
            made.append(pa.table([
                *key, *multiples, pa.array(list(verticals), pa.int64()).take(pa.array(v)), pa.array(t[row]), known(ret, first | last), known(p[entry], first), known(p[row], last), pa.array(_TOUCHES).take(pa.array(touch)),
            ], names=names))
        kinds = pa.schema([pa.field(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[x.split()[1]]) for n, x in zip(names, _OUT.split(", "))])
        return pa.concat_tables(made).cast(kinds) if made else kinds.empty_table()

    return run


def barrier_grid(events: DataFrame, prices: DataFrame, pairs: Sequence[tuple[float | None, float | None]], verticals: Sequence[int], min_close_ns: int = 0, price: str = "price", rows: int = 4096, every: bool = False) -> DataFrame:
    """(symbol, event_ns, target, side, profit, loss, vertical_ns, t1_ns, ret, entry, exit, touch): each event's label for every pair of barriers and every horizon.

    As ``labels.triple_barrier`` with that pair and horizon: the path runs from the first price at or after the event,
    the first log return times side that reaches target * profit, or -target * loss, no sooner than min_close_ns after
    the event, ends it, else the last price of the horizon does.  A None barrier is none.

    events has symbol, ts_ns, target and, if sides differ from 1, side; equal events are one.  Events whose target is
    null or NaN, or without symbol or time, have no label, nor has a horizon without a price behind the entry.  Prices that are null or not above 0
    are left out, unless every row counts: then logs of 0 and quotients over 0 are infinite or NaN (which reaches a
    profit), as in SQL, and a price that is null or under 0 is a row without a return.  Events are searched so many rows at a time, which changes no result.
    A task holds the prices of two of the longest horizons of a symbol.
    """
    longest = max(verticals)
    side = F.coalesce(F.col("side").cast("int"), F.lit(1)) if "side" in events.columns else F.lit(1)
    ev = events.where(F.col("symbol").isNotNull() & F.col("ts_ns").isNotNull() & F.col("target").isNotNull() & ~F.isnan("target")).select("symbol", F.col("ts_ns").alias("event_ns"), F.col("target").cast("double").alias("target"), side.alias("side"))
    ev = ev.distinct().withColumn("_k", F.floor(F.col("event_ns") / longest))
    tape = prices.where(F.col("symbol").isNotNull() & F.col("ts_ns").isNotNull() & (F.lit(True) if every else F.col(price) > 0))
    k = F.floor(F.col("ts_ns") / longest)
    tape = tape.select("symbol", F.col("ts_ns").alias("t"), F.col("seq").alias("q"), F.when(F.col(price) >= 0, F.col(price).cast("double")).alias("p"), F.explode(F.array(k - 1, k)).alias("_k"))
    both = ev.groupBy("symbol", "_k").cogroup(tape.groupBy("symbol", "_k"))
    return both.applyInArrow(_gridded(list(pairs), list(verticals), min_close_ns, rows), _OUT)


def barrier_scores(grid: DataFrame, min_rets: Sequence[float] = (0.0,), by: Sequence[str] = (), periods: int = 1500, trials: int = 20, least: int = 50) -> DataFrame:
    """One ranked row a combination of barriers, horizon and min_ret, from the labels of ``barrier_grid``.

    Counts and rates of wins and touches, returns and points (side times exit less entry), the ratio of the mean win to
    the mean loss, sharpe (a year has so many periods), dsr (the chance that the ratio beats the best of so many trials;
    0 under least labels), positive (the share of meta labels that min_ret leaves) and quality:
    0.4 * (win rate from 0.5 to 0.6) + 0.4 * (win-loss ratio from 0.8 to 1.6) + 0.2 * (labels up to 500), each part
    within 0 and 1.  Ranked by quality, then dsr, then the combination itself; by keeps groups apart.
    """
    keys = [*by, "profit", "loss", "vertical_ns"]
    win, lose = F.col("ret") > 0, F.col("ret") < 0
    share = lambda c: F.avg(c.cast("double"))
    points = F.col("side") * (F.col("exit") - F.col("entry"))
    table = grid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(win).alias("wins"), F.count_if(lose).alias("losses"), F.avg("ret").alias("avg_ret"), F.sum("ret").alias("total_ret"),
        F.coalesce(F.avg(F.when(win, F.col("ret"))), F.lit(0.0)).alias("avg_win"), F.coalesce(-F.avg(F.when(lose, F.col("ret"))), F.lit(0.0)).alias("avg_loss"),
        F.sum(points).alias("total_points"), share(points > 0).alias("point_win_rate"), *[share(F.col("touch") == x).alias(f"{x}_rate") for x in ("upper", "lower", "vertical")],
        F.stddev_samp("ret").alias("_s"), sample_skew("ret").alias("_skew"), sample_kurtosis("ret").alias("_kurt"),
        F.array(*[F.struct(F.lit(float(m)).alias("min_ret"), share(F.col("ret") >= m).alias("positive")) for m in min_rets]).alias("_m"),
    )
    n, sr = F.col("n"), F.col("_sr")
    spread = F.sqrt(F.try_divide(1 - F.col("_skew") * sr + (F.col("_kurt") + 2) / 4 * sr * sr, n - 1))
    within = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    table = table.withColumns({"win_rate": F.col("wins") / n, "pl_ratio": F.coalesce(F.try_divide("avg_win", "avg_loss"), F.lit(0.0)), "_sr": F.coalesce(F.try_divide("avg_ret", "_s"), F.lit(0.0))})
    dsr: Column = F.when(n >= least, normal_cdf(F.try_divide(sr - expected_max_sharpe(trials) / math.sqrt(periods), spread))).otherwise(0.0)
    quality = 0.4 * within((F.col("win_rate") - 0.5) / 0.1) + 0.4 * within((F.col("pl_ratio") - 0.8) / 0.8) + 0.2 * within(n / 500)
    table = table.withColumns({"sharpe": sr * math.sqrt(periods), "dsr": dsr, "quality": quality}).withColumn("_m", F.explode("_m"))
    order = [F.desc(F.round("quality", 9)), F.desc(F.round("dsr", 9)), "profit", "loss", "vertical_ns", "_m.min_ret"]
    rank = F.row_number().over(Window.partitionBy(*by, F.lit(0)).orderBy(*order))  # a row a combination
    names = ["n", "wins", "losses", "win_rate", "avg_ret", "total_ret", "avg_win", "avg_loss", "pl_ratio", "sharpe", "dsr", "upper_rate", "lower_rate", "vertical_rate", "total_points", "point_win_rate", "quality"]
    return table.select(*keys, "_m.min_ret", "_m.positive", *names, rank.alias("rank"))
