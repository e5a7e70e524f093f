"""Fractional differencing, unit-root tests, structural breaks and trend scans as window kernels."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.fold import ORDER, fold, windowed


#: Widest fractional difference that is worked out to a threshold; one that needs more is an error, not cut.
WIDEST = 10_000_000


def ffd_weights(d: float, threshold: float = 1e-5, longest: int | None = None) -> np.ndarray:
    """Weights of (1 - L)^d, newest first, down to the threshold, or the first longest of them if that is given and less.

    The weights come in batches: each is the product of the ratios before it.
    """
    w, size = np.ones(1), 1024
    while longest is None or len(w) < longest:
        if longest is None and len(w) > WIDEST:
            raise ValueError(f"the weights of order {d} do not fall under {threshold} within {WIDEST} rows; give longest")
        k = np.arange(len(w), len(w) + size)
        more = w[-1] * np.cumprod((k - 1 - d) / k)
        under = np.flatnonzero(np.abs(more) < threshold)
        w = np.concatenate((w, more[: under[0]] if len(under) else more))
        if len(under):
            break
        size = min(2 * size, 1 << 20)
    return w[:longest]


def ffd(x: np.ndarray, d: float, threshold: float = 1e-5) -> np.ndarray:
    """Fixed-width fractional difference; NaN where the width is not full."""
    w = ffd_weights(d, threshold)
    out = np.full(len(x), np.nan)
    if len(x) >= len(w):
        out[len(w) - 1 :] = np.convolve(x, w, "valid")
    return out


def frac_diff(df: DataFrame, x: str, d: float, threshold: float = 1e-5, name: str = "ffd", order=ORDER, rows: int | None = None) -> DataFrame:
    return windowed(df, lambda c: {name: ffd(c[x], d, threshold)}, len(ffd_weights(d, threshold)), [x], f"{name} double", order=order, rows=rows)


def frac_diff_rolling(df: DataFrame, x: str, d: float, window: int, name: str = "fracdiff", order=ORDER, rows: int | None = None) -> DataFrame:
    """Fractional difference with the weights of the last window rows."""
    w = ffd_weights(d, 0.0, window)
    pad = np.zeros(window)
    pad[: len(w)] = w

    def kernel(c):
        out = np.full(len(c[x]), np.nan)
        if len(out) >= window:
            out[window - 1 :] = sliding_window_view(c[x], window) @ pad[::-1]
        return {name: out}

    return windowed(df, kernel, window, [x], f"{name} double", order=order, rows=rows)


def expanding(x: np.ndarray, d: float, min_window: int = 10) -> np.ndarray:
    """Fractional difference over all rows so far; NaN before min_window."""
    bad = np.flatnonzero(np.isnan(x))
    out, n = np.full(len(x), np.nan), int(bad[0]) if len(bad) else len(x)  # a gap leaves nothing known after it
    if n:
        w, size = ffd_weights(d, 0.0, n), 1 << (2 * n - 1).bit_length()
        out[:n] = np.fft.irfft(np.fft.rfft(x[:n], size) * np.fft.rfft(w, size), size)[:n]
    out[: min(min_window - 1, len(out))] = np.nan
    return out


def frac_diff_expanding(df: DataFrame, x: str, d: float, min_window: int = 10, name: str = "fracdiff", order=ORDER) -> DataFrame:
    """Expanding fractional difference: every row needs its whole past, so a symbol's column is kept by its task."""

    def step(s, c):
        s["x"] = np.concatenate((s["x"], c[x]))
        return {name: expanding(s["x"], d, min_window)[len(s["x"]) - len(c[x]) :]}

    return fold(df, lambda: {"x": np.zeros(0)}, step, [x], f"{name} double", order=order)


def frac_diff_both(df: DataFrame, x: str, d: float, window: int, order=ORDER) -> DataFrame:
    """df with fracdiff_fixed (weights of the last window rows) and fracdiff_expanding (of all rows so far), to set one against the other."""
    return frac_diff_expanding(frac_diff_rolling(df, x, d, window, "fracdiff_fixed", order), x, d, window, "fracdiff_expanding", order)


def schwert_lag(n: int) -> int:
    return int(12 * (n / 100) ** 0.25) if n >= 10 else 1


#: Published Dickey-Fuller critical values at 1, 5 and 10 percent by sample size, with a constant, and with a trend.
_SIZES = np.array([25, 50, 100, 250, 500, 100_000], float)
_CONST = np.array([[-3.75, -3.00, -2.63], [-3.58, -2.93, -2.60], [-3.51, -2.89, -2.58], [-3.46, -2.88, -2.57], [-3.44, -2.87, -2.57], [-3.43, -2.86, -2.57]])
_TREND = np.array([[-4.38, -3.60, -3.24], [-4.15, -3.50, -3.18], [-4.04, -3.45, -3.15], [-3.99, -3.43, -3.13], [-3.98, -3.42, -3.13], [-3.96, -3.41, -3.12]])


def critical_values(n: int, trend: bool = True) -> np.ndarray:
    table = _TREND if trend else _CONST
    return np.array([np.interp(n, _SIZES, table[:, k]) for k in range(3)])


def p_step(t: float, n: int, trend: bool = True) -> float:
    """0.01, 0.05, 0.10 or 0.20: the first level whose critical value t is under."""
    return float((0.01, 0.05, 0.10, 0.20)[int((t >= critical_values(n, trend)).sum())])


def _regress(y: np.ndarray, lag: int, trend: bool) -> tuple[float, int, int, float]:
    """t of the level's coefficient, observations, parameters and residual sum of squares of an ADF regression."""
    d = np.diff(y)
    n = len(d) - lag
    cols = [np.ones(n), y[lag:-1]] + [d[lag - k : -k] for k in range(1, lag + 1)] + ([np.arange(n, dtype=float)] if trend else [])
    m, target = np.stack(cols, 1), d[lag:]
    if n < m.shape[1] + 1:
        return math.nan, n, m.shape[1], math.nan
    b, _, rank, _ = np.linalg.lstsq(m, target, rcond=None)
    rss = float(((target - m @ b) ** 2).sum())
    if rank < m.shape[1] or rss <= 1e-20:
        return math.nan, n, m.shape[1], rss
    cov = np.linalg.inv(m.T @ m)[1, 1] * rss / (n - m.shape[1])
    return (float(b[1] / math.sqrt(cov)) if cov > 0 else math.nan), n, m.shape[1], rss


def adf(y: np.ndarray, max_lag: int | None = None, trend: bool = True) -> dict:
    """Augmented Dickey-Fuller: statistic, step p-value, lag of least AIC, observations and critical values; NaN under 10 rows."""
    y = y[np.isfinite(y)]
    if len(y) < 10:
        return {"t": math.nan, "p": math.nan, "lag": 0, "n": len(y), "aic": math.nan, "critical": [math.nan] * 3}
    best = None
    for lag in range(min(schwert_lag(len(y)) if max_lag is None else max_lag, len(y) // 3) + 1):
        t, n, k, rss = _regress(y, lag, trend)
        if t == t and (best is None or n * math.log(rss / n) + 2 * k < best["aic"]):
            best = {"t": t, "p": p_step(t, n, trend), "lag": lag, "n": n, "aic": n * math.log(rss / n) + 2 * k, "critical": critical_values(n, trend).tolist()}
    return best or {"t": math.nan, "p": math.nan, "lag": 0, "n": len(y), "aic": math.nan, "critical": [math.nan] * 3}


def adf_by_symbol(df: DataFrame, x: str, max_lag: int | None = None, trend: bool = True, order=ORDER) -> DataFrame:
    """(symbol, t, p, lag, n, aic): one test for each symbol, whose column its task keeps."""

    def run(key, table):
        import pyarrow as pa

        r = adf(np.array(table.sort_by([(c, "ascending") for c in order])[x].to_pylist(), float), max_lag, trend)
        return pa.table({"symbol": [key[0].as_py()], **{k: [r[k]] for k in ("t", "p", "lag", "n", "aic")}})

    return df.select("symbol", *order, x).groupBy("symbol").applyInArrow(run, "symbol string, t double, p double, lag long, n long, aic double")


def adf_t_windows(y: np.ndarray, window: int, trend: bool = True) -> np.ndarray:
    """Lag-0 ADF t of each window by cumulative cross-products about the window's own start; NaN before the first."""
    out = np.full(len(y), np.nan)
    if len(y) < window or window < 6:
        return out
    v = sliding_window_view(y, window)
    v = v - v[:, :1]
    level, d = v[:, :-1], np.diff(v, axis=1)
    n = window - 1
    base = np.ones((n, 1)) if not trend else np.stack([np.ones(n), np.arange(n) - (n - 1) / 2], 1)
    q = np.linalg.qr(base)[0]
    lr, dr = level - (level @ q) @ q.T, d - (d @ q) @ q.T
    ll = (lr * lr).sum(1)
    ok = ll > 1e-20
    b = np.divide((lr * dr).sum(1), ll, where=ok, out=np.full(len(ll), np.nan))
    rss = ((dr - b[:, None] * lr) ** 2).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out[window - 1 :] = np.where(rss > 1e-20, b / np.sqrt(rss / (n - base.shape[1] - 1) / ll), np.nan)
    return out


def adf_rolling(df: DataFrame, x: str, window: int, trend: bool = True, name: str = "adf", order=ORDER, rows: int | None = None) -> DataFrame:
    return windowed(df, lambda c: {name: adf_t_windows(c[x], window, trend)}, window, [x], f"{name} double", order=order, rows=rows)


def sadf_values(y: np.ndarray, shortest: int = 20, longest: int = 100, trend: bool = True) -> np.ndarray:
    """At each row the greatest lag-0 ADF t of the windows of shortest to longest rows that end there."""
    out = np.full(len(y), np.nan)
    for w in range(shortest, min(longest, len(y)) + 1):
        out = np.fmax(out, adf_t_windows(y, w, trend))
    return out


def sadf(df: DataFrame, x: str, shortest: int = 20, longest: int = 100, trend: bool = True, log: bool = True, name: str = "sadf", order=ORDER, rows: int | None = None) -> DataFrame:
    return windowed(df, lambda c: {name: sadf_values(np.log(c[x]) if log else c[x], shortest, longest, trend)}, longest, [x], f"{name} double", order=order, rows=rows)


def qadf(values: str = "sadf", window: int = 20, q: float = 0.95, over=None):
    """Column: the q-quantile of the last window SADF values."""
    from tickloom.functions.rolling import TAPE, rolling_quantile

    return rolling_quantile(values, window, q, over or TAPE)


def cadf(values: str = "sadf", quantiles: str = "qadf", window: int = 20, over=None):
    """Column: the mean of the last window SADF values that reach their own quantile."""
    from tickloom.functions.rolling import TAPE

    over = over or TAPE
    return F.avg(F.when(F.col(values) >= F.col(quantiles), F.col(values))).over(over.rows(window))


def martingale(df: DataFrame, x: str = "close", decay: float = 0.95, window: int | None = None, order=ORDER, rows: int | None = None) -> DataFrame:
    """sub_martingale and super_martingale: the decayed sum of returns over the root of the sum of squared weights, and its negative."""
    from tickloom.functions.recursive import decayed

    def expanding_step(s, c):
        before = np.concatenate(([s["last"]], c[x][:-1]))
        s["last"] = c[x][-1]
        r = c[x] / before - 1
        ok = np.isfinite(r)
        top, w2 = decayed(np.where(ok, r, 0), decay, s["top"]), decayed(ok.astype(float), decay * decay, s["w2"])
        s["top"], s["w2"] = top[-1], w2[-1]
        v = np.where(w2 > 0, top / np.sqrt(np.maximum(w2, 1e-300)), np.nan)
        return {"sub_martingale": v, "super_martingale": -v}

    if window is None:
        return fold(df, lambda: {"last": np.nan, "top": 0.0, "w2": 0.0}, expanding_step, [x], "sub_martingale double, super_martingale double", order=order)
    w = decay ** np.arange(window - 1, -1, -1)

    def kernel(c):
        v = np.full(len(c[x]), np.nan)
        if len(v) > window:
            v[window:] = sliding_window_view(c[x][1:] / c[x][:-1] - 1, window) @ w / math.sqrt((w * w).sum())
        return {"sub_martingale": v, "super_martingale": -v}

    return windowed(df, kernel, window + 1, [x], "sub_martingale double, super_martingale double", order=order, rows=rows)


def csw_scores(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Chu-Stinchcombe-White at the last row of log prices y: greatest upward and downward departure and their critical values."""
    n = len(y) - 1
    sigma = math.sqrt(float((np.diff(y) ** 2).mean())) if n else 0.0
    if n < 2 or sigma <= 0:
        return math.nan, math.nan, math.nan, math.nan
    gap = np.arange(n, 0, -1)[: n - 1]
    s = (y[-1] - y[: n - 1]) / (sigma * np.sqrt(gap))
    up, down = int(s.argmax()), int((-s).argmax())
    bound = np.sqrt(4.6 + np.log(gap))
    return float(s[up]), float(-s[down]), float(bound[up]), float(bound[down])


def csw_rolling(y: np.ndarray, window: int, warmup: int = 30) -> np.ndarray:
    """(rows, 4) of csw_scores over the last window rows; expanding until the window is full, NaN before warmup.

    Full windows are one matrix: all departures of all rows at once, in blocks.
    """
    out = np.full((len(y), 4), np.nan)
    for i in range(min(max(warmup, 2), len(y)), min(window - 1, len(y))):
        out[i] = csw_scores(y[: i + 1])
    if len(y) < window:
        return out
    gap = np.arange(window - 1, 1, -1)
    root, bound = np.sqrt(gap), np.sqrt(4.6 + np.log(gap))
    sq = np.concatenate(([0.0], np.cumsum(np.diff(y) ** 2)))
    sigma = np.sqrt(np.maximum(sq[window - 1 :] - sq[: len(y) - window + 1], 0) / (window - 1))
    for i in range(0, len(sigma), 2048):
        v = sliding_window_view(y[i : i + 2048 + window - 1], window)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = (v[:, -1:] - v[:, :-2]) / (sigma[i : i + len(v), None] * root)
        up, down = s.argmax(1), s.argmin(1)
        k = np.arange(len(v))
        out[window - 1 + i : window - 1 + i + len(v)] = np.stack([s[k, up], -s[k, down], bound[up], bound[down]], 1)
    return out


def csw_cusum(df: DataFrame, x: str = "close", window: int = 1000, warmup: int = 30, order=ORDER, rows: int | None = None) -> DataFrame:
    """csw_up, csw_down and their critical values over the last window rows of log prices."""
    names = ("csw_up", "csw_down", "csw_up_critical", "csw_down_critical")

    def kernel(c):
        return dict(zip(names, csw_rolling(np.log(c[x]), window, warmup).T))

    return windowed(df, kernel, window, [x], ", ".join(f"{n} double" for n in names), order=order, rows=rows)


def csw_features(df: DataFrame, max_age: int = 144, order=ORDER) -> DataFrame:
    """From csw_cusum columns: score over critical (clipped to +-10), flag, and rows since the last flag (at most max_age), up and down."""

    def step(s, c):
        out = {}
        for side in ("up", "down"):
            score, bound = c[f"csw_{side}"], c[f"csw_{side}_critical"]
            flag = np.nan_to_num(score) > np.nan_to_num(bound, nan=np.inf)
            age = np.empty(len(flag))
            for i, f in enumerate(flag.tolist()):
                s[side] = 0 if f else min(max_age, s[side] + 1)
                age[i] = s[side]
            out |= {f"{side}_score": np.clip(score - bound, -10, 10), f"{side}_flag": flag, f"{side}_age": age}
        return out

    fields = ", ".join(f"{s}_score double, {s}_flag boolean, {s}_age int" for s in ("up", "down"))
    return fold(df, lambda: {"up": max_age, "down": max_age}, step, ["csw_up", "csw_down", "csw_up_critical", "csw_down_critical"], fields, order=order)


def trend_scan_values(y: np.ndarray, spans: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the span of the forward line of greatest |t|, that t and slope; the shortest span at a tie, NaN where none fits."""
    best_t, best_l, slope = np.full(len(y), np.nan), np.zeros(len(y)), np.full(len(y), np.nan)
    for span in sorted(spans):
        if span < 3 or len(y) < span:
            continue
        v = sliding_window_view(y, span)
        k = np.arange(span) - (span - 1) / 2
        kk = float((k * k).sum())
        b = v @ k / kk
        rss = ((v - v.mean(1, keepdims=True) - b[:, None] * k) ** 2).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(rss > 1e-20, b / np.sqrt(rss / (span - 2) / kk), np.where(b == 0, 0.0, np.sign(b) * 1e12))
        head = slice(0, len(t))
        better = ~(np.abs(best_t[head]) >= np.abs(t))
        best_t[head] = np.where(better, t, best_t[head])
        slope[head] = np.where(better, b, slope[head])
        best_l[head] = np.where(better, span, best_l[head])
    return best_t, best_l, slope


def trend_scan(df: DataFrame, x: str, spans: Sequence[int], order=ORDER) -> DataFrame:
    """trend_t, trend_span, trend_slope, trend_side and trend_end_ns: the best line over the rows from each row on (future rows: labels only)."""
    longest = max(spans)
    back = df.withColumn("_neg", -F.col(order[0])).withColumn("_neg2", -F.col(order[-1]))

    def kernel(c):
        y, t = c[x][::-1], c["ts_ns"][::-1]
        best, span, slope = trend_scan_values(y, spans)
        end = t[np.minimum(np.arange(len(t)) + np.maximum(span.astype(int) - 1, 0), len(t) - 1)].astype(np.int64)
        known = ~np.isnan(best)
        return {"trend_t": best[::-1], "trend_span": np.where(known, span, np.nan)[::-1], "trend_slope": slope[::-1], "trend_side": np.where(known, np.sign(best), np.nan)[::-1], "trend_end_ns": end[::-1]}

    out = windowed(back, kernel, longest, [x, "ts_ns"], "trend_t double, trend_span int, trend_slope double, trend_side int, trend_end_ns long", order=("_neg", "_neg2"))
    return out.drop("_neg", "_neg2")


def optimal_d(df: DataFrame, x: str, step: float = 0.05, most: float = 1.0, threshold: float = 1e-4, min_corr: float = 0.0, order=ORDER) -> DataFrame:
    """(symbol, d): the least order on a grid whose difference has an ADF p under 0.05 and a correlation of min_corr with the series."""

    def run(key, table):
        import pyarrow as pa

        y = np.array(table.sort_by([(c, "ascending") for c in order])[x].to_pylist(), float)
        for d in np.arange(0, most + 1e-9, step):
            z = ffd(y, d, threshold) if d else y
            ok = np.isfinite(z)
            if ok.sum() >= 10 and adf(z)["p"] < 0.05 and (min_corr <= 0 or np.corrcoef(z[ok], y[ok])[0, 1] >= min_corr):
                return pa.table({"symbol": [key[0].as_py()], "d": [float(round(d, 10))]})
        return pa.table({"symbol": [key[0].as_py()], "d": [float(most)]})

    return df.select("symbol", *order, x).groupBy("symbol").applyInArrow(run, "symbol string, d double")
