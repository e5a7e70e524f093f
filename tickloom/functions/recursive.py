"""Recursive indicators as folds: exponential averages and deviations, RSI, ATR, ADX, SuperTrend.

All linear recursions go through ``decayed``, which runs s[i] = a * s[i-1] + x[i]
in vectorised blocks and carries s from one Arrow batch to the next.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.rolling import Over, bar_duration
from tickloom.operators.fold import ORDER, fold


def decayed(x: np.ndarray, a: float, carry: float = 0.0) -> np.ndarray:
    """s[i] = a * s[i-1] + x[i] with s[-1] = carry; NaN stays from its row on."""
    out = np.empty(len(x))
    size = max(1, min(4096, int(27 / -math.log(a)))) if 0 < a < 1 else (1 if a == 0 else len(x) or 1)
    if a == 0:
        return x.astype(float)
    power = a ** np.arange(1, size + 1)
    for i in range(0, len(x), size):
        part = x[i : i + size]
        p = power[: len(part)]
        out[i : i + size] = p * (carry + np.cumsum(part / p))
        carry = out[i + len(part) - 1]
    return out


def decayed_between(x: np.ndarray, keep: np.ndarray, carry: float) -> np.ndarray:
    """s[i] = keep[i] * s[i-1] + x[i] where the decay differs from row to row."""
    out = np.empty(len(x))
    for i, (v, k) in enumerate(zip(x.tolist(), keep.tolist())):
        carry = k * carry + v
        out[i] = carry
    return out


def ewma(df: DataFrame, x: str, span: int, name: str = "ewma", order=ORDER) -> DataFrame:
    """Adjusted exponential average; a null makes all later values of the symbol null."""
    a = 1 - 2 / (span + 1)

    def step(s, c):
        top = decayed(c[x], a, s["top"])
        weight = decayed(np.ones(len(top)), a, s["weight"])
        s["top"], s["weight"] = top[-1], weight[-1]
        return {name: top / weight}

    return fold(df, lambda: {"top": 0.0, "weight": 0.0}, step, [x], f"{name} double", order=order)


def bar_duration_ewma(df: DataFrame, span: int = 20, name: str = "bar_duration_ewma", order=ORDER) -> DataFrame:
    """Adjusted exponential average of the seconds since the row before; the first row has none and is null."""
    over = Over(order=tuple(order))
    rows = df.withColumn("_s", bar_duration(1, over))
    known = ewma(rows.withColumn("_x", F.coalesce("_s", F.lit(0.0))).withColumn("_w", F.col("_s").isNotNull().cast("double")), "_x", span, "_top", order)
    return ewma(known, "_w", span, "_weight", order).withColumn(name, F.when(F.col("_s").isNotNull(), F.try_divide("_top", "_weight"))).drop("_s", "_x", "_w", "_top", "_weight")


def ew_std(df: DataFrame, x: str, span: int, name: str = "ewms", order=ORDER) -> DataFrame:
    """Bias-corrected exponential standard deviation; a null keeps its place in time and adds nothing."""
    a = 1 - 2 / (span + 1)
    keys = ("w", "w2", "x", "xx")

    def step(s, c):
        if s["shift"] is None and np.isfinite(c[x]).any():
            s["shift"] = float(c[x][np.isfinite(c[x])][0])  # deviations from a first value lose no digits
        ok = np.isfinite(c[x])
        v = np.where(ok, c[x] - (s["shift"] or 0.0), 0.0)
        w, w2, sx, sxx = (decayed(p, q, s[k]) for p, q, k in ((ok.astype(float), a, "w"), (ok.astype(float), a * a, "w2"), (v, a, "x"), (v * v, a, "xx")))
        for k, q in zip(keys, (w, w2, sx, sxx)):
            s[k] = q[-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            biased = np.maximum(sxx / w - (sx / w) ** 2, 0)
            free = w * w - w2
            return {name: np.where(ok & (free > 1e-12 * w * w), np.sqrt(biased * w * w / free), np.nan)}

    return fold(df, lambda: dict.fromkeys(keys, 0.0) | {"shift": None}, step, [x], f"{name} double", order=order)


def ew_std_over_time(df: DataFrame, x: str, half_life_s: float, floor: float = 1e-12, mean0: bool = False, name: str = "ewmst", time: str = "ts_ns", order=ORDER) -> DataFrame:
    """Exponential standard deviation whose weights fall by exp(-seconds / half_life_s); about zero, or bias-corrected about the mean."""

    def step(s, c):
        t = c[time].astype(float) / 1e9
        gap = np.diff(np.concatenate(([t[0] if s["t"] is None else s["t"]], t)))
        keep = np.exp(-np.maximum(gap, 0) / half_life_s)
        ok = np.isfinite(c[x])
        v = np.where(ok, c[x], 0.0)
        w, w2 = decayed_between(ok.astype(float), keep, s["w"]), decayed_between(ok.astype(float), keep * keep, s["w2"])
        sx, sxx = decayed_between(v, keep, s["x"]), decayed_between(v * v, keep, s["xx"])
        s.update(t=t[-1], w=w[-1], w2=w2[-1], x=sx[-1], xx=sxx[-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            if mean0:
                sd = np.sqrt(sxx / w)
            else:
                free = 1 - w2 / (w * w)
                sd = np.where(free > 1e-12, np.sqrt(np.maximum(sxx / w - (sx / w) ** 2, 0) / free), np.nan)
        return {name: np.where(ok, np.maximum(sd, floor), np.nan)}

    return fold(df, lambda: {"t": None, "w": 0.0, "w2": 0.0, "x": 0.0, "xx": 0.0}, step, [x, time], f"{name} double", order=order)


def _wilder(x: np.ndarray, n: int, s: dict, key: str) -> np.ndarray:
    """Wilder's average: the mean of the first n values, then (n - 1) / n of the last plus x / n; NaN before."""
    seen, total, out = s.get(key + "n", 0), s.get(key, 0.0), np.full(len(x), np.nan)
    head = min(max(n - seen, 0), len(x))
    if head:
        sums = total + np.cumsum(x[:head])
        total = sums[-1]
        if seen + head == n:
            total = total / n
            out[head - 1] = total
    if len(x) > head:
        rest = decayed(x[head:] / n, 1 - 1 / n, total)
        out[head:] = rest
        total = rest[-1]
    s[key], s[key + "n"] = total, seen + len(x)
    return out


def _before(s: dict, key: str, x: np.ndarray) -> np.ndarray:
    """x one row earlier, over the batch's edge."""
    out = np.concatenate(([s.get("prev_" + key, np.nan)], x[:-1]))
    s["prev_" + key] = x[-1]
    return out


def rsi(df: DataFrame, close: str = "close", n: int = 14, name: str = "rsi", order=ORDER) -> DataFrame:
    """Wilder's relative strength index; null before n changes and where there was no loss."""

    def step(s, c):
        d = c[close] - _before(s, "c", c[close])
        skip = 1 if np.isnan(d[0]) and not s.get("upn") else 0
        up, down = (_wilder(np.maximum(v, 0)[skip:], n, s, k) if len(v) > skip else np.zeros(0) for v, k in ((d, "up"), (-d, "down")))
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(down > 0, 100 - 100 / (1 + up / down), np.nan)
        return {name: np.concatenate((np.full(skip, np.nan), value))}

    return fold(df, dict, step, [close], f"{name} double", order=order)


def _true_range(s: dict, h: np.ndarray, low: np.ndarray, c: np.ndarray) -> np.ndarray:
    before = _before(s, "close", c)
    return np.fmax(h - low, np.fmax(np.abs(h - before), np.abs(low - before)))


def atr(df: DataFrame, n: int = 14, wilder: bool = True, normalize: bool = False, high: str = "high", low: str = "low", close: str = "close", name: str = "atr", order=ORDER) -> DataFrame:
    """Average true range, Wilder's or simple; normalised by the middle of the range."""

    def step(s, c):
        tr = _true_range(s, c[high], c[low], c[close])
        if wilder:
            out = _wilder(tr, n, s, "tr")
        else:
            whole = np.concatenate((s.get("tail", np.zeros(0)), tr))
            sums = np.concatenate(([0.0], np.cumsum(whole)))
            out = np.full(len(whole), np.nan)
            out[n - 1 :] = (sums[n:] - sums[:-n]) / n if len(whole) >= n else []
            out = out[len(whole) - len(tr) :]
            s["tail"] = whole[-(n - 1) :] if n > 1 else whole[:0]
        return {name: out / ((c[high] + c[low]) / 2) if normalize else out}

    return fold(df, dict, step, [high, low, close], f"{name} double", order=order)


def adx(df: DataFrame, n: int = 14, high: str = "high", low: str = "low", close: str = "close", name: str = "adx", order=ORDER) -> DataFrame:
    """Wilder's average directional index; null until it is known."""

    def step(s, c):
        first = "prev_h" not in s
        up, down = c[high] - _before(s, "h", c[high]), _before(s, "l", c[low]) - c[low]
        tr = _true_range(s, c[high], c[low], c[close])
        skip = int(first)
        plus = np.where((up > down) & (up > 0), up, 0.0)[skip:]
        minus = np.where((down > up) & (down > 0), down, 0.0)[skip:]
        a, p, m = (_wilder(v, n, s, k) for v, k in ((tr[skip:], "tr"), (plus, "plus"), (minus, "minus")))
        with np.errstate(divide="ignore", invalid="ignore"):
            dx = 100 * np.abs(p - m) / (p + m)
        known = ~np.isnan(a)
        dx = np.where(np.isfinite(dx), dx, 0.0)
        out = np.full(len(c[high]), np.nan)
        out[skip:][known] = _wilder(dx[known], n, s, "dx")
        return {name: out}

    return fold(df, dict, step, [high, low, close], f"{name} double", order=order)


def supertrend(df: DataFrame, atr_col: str = "atr", multiplier: float = 3.0, close: str = "close", order=ORDER) -> DataFrame:
    """line, direction (1 up, -1 down), upper and lower: bands of multiplier * atr about the close that only tighten while the trend holds."""

    def step(s, c):
        n = len(c[close])
        line, direction, upper, lower = (np.full(n, np.nan) for _ in range(4))
        for i, (p, a) in enumerate(zip(c[close].tolist(), c[atr_col].tolist())):
            if a != a:
                continue
            up, down = p + multiplier * a, p - multiplier * a
            if s["d"] == 0:
                s["d"] = 1
            elif s["d"] > 0 and p < s["lower"]:
                s["d"] = -1
            elif s["d"] < 0 and p > s["upper"]:
                s["d"] = 1
            elif s["d"] > 0:
                down = max(down, s["lower"])
            else:
                up = min(up, s["upper"])
            s["upper"], s["lower"] = up, down
            line[i], direction[i], upper[i], lower[i] = (down if s["d"] > 0 else up), s["d"], up, down
        return {"line": line, "direction": direction, "upper": upper, "lower": lower}

    return fold(df, lambda: {"d": 0, "upper": 0.0, "lower": 0.0}, step, [close, atr_col], "line double, direction int, upper double, lower double", order=order)
