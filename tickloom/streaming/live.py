"""Live bars by Structured Streaming: threshold bars with keyed state, time bars with a watermark.

``live_threshold_bars`` folds each symbol's trades in event-time order behind a
watermark and emits a bar once, when it closes; trades later than the watermark
are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

BAR = "symbol string, bar_id long, ts_ns long, open double, high double, low double, close double, volume double, vwap double, trades long"
_STATE = "begun boolean, bar_id long, total double, open double, high double, low double, close double, volume double, pv double, trades long"


def fold_bars(trades: pd.DataFrame, state: list, limit: float, carry: bool = True) -> list[tuple]:
    """Bars closed by trades in order; state is the list of _STATE's fields and is changed.

    The first trade of a symbol belongs to no bar; what is over the limit counts for the next bar if carry.
    """
    out = []
    for ts, price, amount in zip(trades["ts_ns"], trades["price"], trades["amount"]):
        if not state[0]:
            state[0] = True
            continue
        if not state[9]:
            state[3:] = [price, price, price, price, 0.0, 0.0, 0]
        state[4], state[5], state[6] = max(state[4], price), min(state[5], price), price
        state[7] += amount
        state[8] += price * amount
        state[9] += 1
        state[2] += price * amount if carry else amount
        if state[2] >= limit:
            out.append((state[1], int(ts), *state[3:8], state[8] / state[7] if state[7] else 0.0, state[9]))
            state[1] += 1
            state[2] = state[2] - limit if carry else 0.0
            state[9] = 0
    return out


def _new() -> list:
    return [False, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0]


class _Ordered(StatefulProcessor):
    """Bars of one symbol's trades, folded in event-time order once the watermark has passed them."""

    def __init__(self, limit: float, carry: bool) -> None:
        self.limit, self.carry = limit, carry

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_ns long, seq long, price double, amount double")
        self.folded = handle.getValueState("folded", f"{_STATE}, last_ns long, last_seq long")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat([r[["ts_ns", "seq", "price", "amount"]] for r in rows])
        held = self.folded.get() if self.folded.exists() else None
        if held is not None:  # what was folded before does not come again
            new = new[(new["ts_ns"] > held[10]) | ((new["ts_ns"] == held[10]) & (new["seq"] > held[11]))]
        if len(new):
            self.waiting.appendList(list(new.itertuples(index=False, name=None)))
        yield from self._fold(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._fold(key, timerValues.getCurrentWatermarkInMs())

    def _fold(self, key, passed_ms: int):
        """Folds the waiting trades before the watermark, keeps the others and sets the timer of the first of them."""
        rows = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=["ts_ns", "seq", "price", "amount"])
        rows = rows.drop_duplicates(["ts_ns", "seq"]).sort_values(["ts_ns", "seq"])
        ready = rows["ts_ns"] < passed_ms * 1_000_000
        bars = []
        if ready.any():
            held = list(self.folded.get()) if self.folded.exists() else [*_new(), 0, 0]
            state = held[:10]
            bars = fold_bars(rows[ready], state, self.limit, self.carry)
            last = rows[ready].iloc[-1]
            self.folded.update((*state, int(last["ts_ns"]), int(last["seq"])))
        left = rows[~ready]
        if len(left):
            self.waiting.put(list(left.itertuples(index=False, name=None)))
            self.handle.registerTimer(int(left["ts_ns"].iloc[0]) // 1_000_000 + 1)
        elif len(rows):
            self.waiting.clear()
        yield pd.DataFrame([(key[0], *b) for b in bars], columns=[c.split(" ")[0] for c in BAR.split(", ")])

    def close(self) -> None:
        pass


def live_threshold_bars(tape: DataFrame, limit: float, carry: bool = True, late: str = "10 minutes") -> DataFrame:
    """Bars of a streaming tape (symbol, ts_ns, seq, price, amount): dollar bars, or volume bars without carry.

    Trades wait in state until the watermark, late behind the newest trade, has passed them; then they are folded in
    the order of (ts_ns, seq) and a bar is emitted once, when it closes.  So the bars are those of the batch operator,
    whatever the order and size of the micro-batches, over all trades that come at most late behind the newest.  Later
    ones, and repeated (ts_ns, seq), are left out; rows without symbol, time, price or amount too.  Trades of the last
    stretch stay in state until newer ones come.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).  State is one fold and the trades of
    the lateness a symbol; it survives a restart from the checkpoint.
    """
    rows = tape.where("symbol is not null and ts_ns is not null and seq is not null and price is not null and amount is not null")
    timed = rows.withColumn("_at", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000))).withWatermark("_at", late)
    return timed.groupBy("symbol").transformWithStateInPandas(_Ordered(limit, carry), BAR, "Append", "EventTime")


def live_time_bars(tape: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """OHLCV of each interval of a streaming tape with a timestamp column ts; an interval is emitted once the watermark passes its end."""
    at = F.struct("ts_ns", "seq")
    w = tape.withWatermark("ts", late).groupBy("symbol", F.window("ts", every).alias("w"))
    out = w.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("amount").alias("volume"), F.count("*").alias("trades"))
    return out.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume", "trades")


def live_exits(signals: DataFrame, prices: DataFrame, horizon_ns: int, profit: float | None = 1.0, loss: float | None = 1.0, late: str = "10 minutes") -> DataFrame:
    """(symbol, event_ns, target, side, entry, t1_ns, ret, exit, touch): where each streaming signal's position ends, emitted once.

    signals has (symbol, ts_ns, seq, price, target, side): the trade at which a position opens; prices is the streaming
    tape (symbol, ts_ns, seq, price).  A position ends at the first later trade within horizon_ns whose log return
    times side reaches target * profit or -target * loss, else at the last one: the label of ``labels.triple_barrier``
    for the same event.  A None barrier is none.  Signals without a later trade in their horizon have no row.

    Both streams may come late behind their newest row; the interval join keeps a signal, and the trades it may still
    meet, until both watermarks have passed its horizon, and no longer.  Then its row comes out.  Rows with a null in
    these columns are left out, and repeated signals are one.
    """
    at = lambda c: F.timestamp_micros(F.floor(F.col(c) / 1000))
    known = lambda df, *cols: df.where(" and ".join(f"{c} is not null" for c in cols))
    s = known(signals, "symbol", "ts_ns", "seq", "price", "target", "side").select("symbol", F.col("ts_ns").alias("event_ns"), F.col("seq").alias("_eq"), F.col("price").alias("entry"), "target", "side", at("ts_ns").alias("_at")).withWatermark("_at", late)
    p = known(prices, "symbol", "ts_ns", "seq", "price").select(F.col("symbol").alias("_s"), F.col("ts_ns").alias("_t"), F.col("seq").alias("_q"), F.col("price").alias("_p"), at("ts_ns").alias("_when")).withWatermark("_when", late)
    micros = horizon_ns // 1000 + 1  # times are cut to microseconds for the join; the exact bounds follow
    near = F.expr(f"symbol = _s and _when >= _at and _when <= _at + interval {micros // 1_000_000} seconds {micros % 1_000_000} microseconds")
    exact = (F.struct("_t", "_q") > F.struct("event_ns", "_eq")) & (F.col("_t") <= F.col("event_ns") + horizon_ns)
    r = F.ln(F.try_divide("_p", "entry")) * F.col("side")
    hit = F.lit(False)
    if profit is not None:
        hit = hit | (r >= F.col("target") * profit)
    if loss is not None:
        hit = hit | (r <= -F.col("target") * loss)
    order, what = F.struct("_t", "_q"), F.struct("_t", "_p", r.alias("r"))
    met = s.join(p, near).where(exact)
    keys = ["symbol", "event_ns", "_eq", "target", "side", "entry"]
    ends = met.groupBy(F.window("_at", "1 second").alias("_w"), *keys).agg(F.min_by(what, F.when(hit, order)).alias("_hit"), F.max_by(what, order).alias("_end"))
    out = F.coalesce("_hit", "_end")
    touch = F.when(F.col("_hit").isNull(), "vertical").when(out["r"] > 0, "upper").otherwise("lower")
    return ends.select("symbol", "event_ns", "target", "side", "entry", out["_t"].alias("t1_ns"), out["r"].alias("ret"), out["_p"].alias("exit"), touch.alias("touch"))


class SignalModel:
    """A model of class 1's probability for a feature table; without a model, or on an error, it is in safe mode and gives no signals."""

    def __init__(self, predict: Callable[[pd.DataFrame], list[float]] | None, threshold: float = 0.5) -> None:
        self.predict_proba, self.threshold, self.safe = predict, threshold, predict is None

    def signals(self, features: pd.DataFrame) -> tuple[list[int], list[float]]:
        if self.safe or features.empty:
            return [0] * len(features), [0.0] * len(features)
        try:
            p = list(self.predict_proba(features.fillna(0.0)))
        except Exception:  # noqa: BLE001  a live model must not stop the stream; the state says so
            self.safe = True
            return [0] * len(features), [0.0] * len(features)
        return [int(v >= self.threshold) for v in p], p


class LiveRuntime:
    """The minute-bar runtime: upserts bars by time, folds dollar bars, gives a snapshot for each new event bar.

    Late or corrected minutes replace theirs and the folds are made anew; only
    bars with a new time are returned.  State is JSON.
    """

    def __init__(self, limit: float, model: SignalModel | None = None, profit: float = 0.01, loss: float = 0.01, horizon_ns: int = 3_600_000_000_000, is_event: Callable[[pd.DataFrame], bool] = lambda bars: True, symbols: dict[str, str] | None = None) -> None:
        self.limit, self.model = limit, model or SignalModel(None)
        self.profit, self.loss, self.horizon_ns, self.is_event = profit, loss, horizon_ns, is_event
        self.symbols, self.minutes, self.last_ns, self.last_signal = symbols or {}, {}, -1, 0

    def resolve(self, symbol: str) -> str:
        """The traded symbol of a research symbol; one that is not mapped is an error."""
        if symbol not in self.symbols:
            raise KeyError(f"no traded symbol for {symbol}")
        return self.symbols[symbol]

    def bars(self) -> pd.DataFrame:
        rows = pd.DataFrame([{"ts_ns": t, **m} for t, m in sorted(self.minutes.items())])
        out = fold_bars(rows.rename(columns={"close": "price", "volume": "amount"}), _new(), self.limit) if len(rows) else []
        return pd.DataFrame(out, columns=["bar_id", "ts_ns", "open", "high", "low", "close", "volume", "vwap", "trades"])

    def update(self, ts_ns: int, close: float, volume: float) -> pd.DataFrame:
        self.minutes[ts_ns] = {"close": close, "volume": volume}
        bars = self.bars()
        new = bars[bars["ts_ns"] > self.last_ns]
        if len(new):
            self.last_ns = int(new["ts_ns"].iloc[-1])
        return new

    def on_bar(self, bars: pd.DataFrame) -> dict | None:
        """The signal of the last bar with its exits, or None where it is no event."""
        if not len(bars) or not self.is_event(bars):
            return None
        (signal,), (prob,) = self.model.signals(bars.tail(1)[["close", "volume", "vwap"]])
        price, ts = float(bars["close"].iloc[-1]), int(bars["ts_ns"].iloc[-1])
        self.last_signal = signal
        return {"ts_ns": ts, "side": signal, "prob": prob, "take_profit": price * (1 + self.profit), "stop_loss": price * (1 - self.loss), "expires_ns": ts + self.horizon_ns, "safe_mode": self.model.safe}

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({"last_ns": self.last_ns, "last_signal": self.last_signal, "minutes": sorted(self.minutes.items())}, f)

    def load(self, path: str) -> None:
        with open(path) as f:
            state = json.load(f)
        self.last_ns, self.last_signal, self.minutes = state["last_ns"], state["last_signal"], {t: m for t, m in state["minutes"]}
