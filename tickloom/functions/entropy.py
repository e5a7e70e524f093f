"""Entropy of discretised returns and principal components over windows of rows."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.rolling import safe_corr
from tickloom.operators.fold import ORDER, windowed


def discretize(x: np.ndarray, bins: int = 3) -> np.ndarray:
    """Symbols of a window: with 3 bins down, flat (within a tenth of the deviation) and up, else quantile bins."""
    if bins == 3:
        edge = 0.1 * x.std()
        return np.where(x > edge, 2, np.where(x < -edge, 0, 1))
    edges = np.sort(x)[[(i + 1) * len(x) // bins for i in range(bins - 1)]]
    return np.searchsorted(edges, x, "right")


def shannon(symbols: np.ndarray) -> float:
    p = np.bincount(symbols) / len(symbols)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def entropy_rate(symbols: np.ndarray, order: int = 1) -> float:
    """Entropy of a symbol given the order before it."""
    s = symbols.tolist()
    if len(s) <= order:
        return 0.0
    long, short = (Counter(tuple(s[i : i + k]) for i in range(len(s) - order)) for k in (order + 1, order))
    n = len(s) - order
    return -sum(c / n * math.log2(c / short[w[:-1]]) for w, c in long.items())


def lempel_ziv(symbols: np.ndarray) -> float:
    """Phrases of an LZ78 parse, scaled by log2(n) / n."""
    seen, phrase, count = set(), (), 0
    for x in symbols.tolist():
        phrase += (x,)
        if phrase not in seen:
            seen.add(phrase)
            count, phrase = count + 1, ()
    count += bool(phrase)
    n = len(symbols)
    return count * math.log2(n) / n if n > 1 else 0.0


def kontoyiannis(symbols: np.ndarray) -> float:
    """Mean of log2(i + 1) over the length of the shortest new word at i, over expanding pasts."""
    s = "".join(map(chr, (symbols + 48).tolist()))
    total, n = 0.0, 0
    for i in range(1, len(s) // 2 + 1):
        k = 1
        while i + k <= len(s) and s[i : i + k] in s[:i]:
            k += 1
        total, n = total + math.log2(i + 1) / k, n + 1
    return total / n if n else 0.0


def implied_volatility(entropy, annualize: bool = True):
    """Volatility of a Gaussian of that entropy, as a Column."""
    return math.sqrt(2 * math.pi * math.e) * F.pow(F.lit(2.0), -entropy) * (math.sqrt(252) if annualize else 1.0)


METHODS: dict[str, Callable[[np.ndarray], float]] = {"shannon": shannon, "lempel_ziv": lempel_ziv, "kontoyiannis": kontoyiannis, "rate": entropy_rate}


def rolling_entropy(df: DataFrame, x: str, window: int, bins: int = 3, method: str = "shannon", name: str = "entropy", order=ORDER, rows: int | None = None) -> DataFrame:
    """Entropy of the discretised last window rows; null where one is null."""
    f = METHODS[method]

    def kernel(c):
        out = np.full(len(c[x]), np.nan)
        if len(out) >= window:
            v = sliding_window_view(c[x], window)
            for i in np.flatnonzero(np.isfinite(v).all(1)):
                out[window - 1 + i] = f(discretize(v[i], bins))
        return {name: out}

    return windowed(df, kernel, window, [x], f"{name} double", order=order, rows=rows)


def hurst(df: DataFrame, x: str, window: int = 24, name: str = "hurst", order=ORDER, rows: int | None = None) -> DataFrame:
    """Slope of the log deviation of k-row differences of the summed returns on log k, k = 1, 2, 4, 8."""
    ks = np.array([1, 2, 4, 8])
    lk = np.log(ks) - np.log(ks).mean()

    def kernel(c):
        out = np.full(len(c[x]), np.nan)
        if len(out) >= window:
            y = np.cumsum(sliding_window_view(c[x], window), axis=1)
            tau = np.stack([(y[:, k:] - y[:, :-k]).std(1) for k in ks], 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[window - 1 :] = np.where((tau > 0).all(1), np.log(tau) @ lk / (lk @ lk), np.nan)
        return {name: out}

    return windowed(df, kernel, window, [x], f"{name} double", order=order, rows=rows)


def approximate_entropy(df: DataFrame, x: str, window: int = 24, m: int = 2, tolerance: float = 0.2, name: str = "apen", order=ORDER, rows: int | None = None) -> DataFrame:
    """Approximate entropy of the last window rows: patterns of m and m + 1 rows within tolerance deviations (Chebyshev)."""

    def phi(v, k, r):
        p = sliding_window_view(v, k)
        near = (np.abs(p[:, None] - p[None]).max(2) <= r).mean(1)
        return float(np.log(near).mean())

    def kernel(c):
        out = np.full(len(c[x]), np.nan)
        if len(out) >= window:
            for i, v in enumerate(sliding_window_view(c[x], window)):
                r = tolerance * v.std()
                if r > 0:
                    out[window - 1 + i] = phi(v, m, r) - phi(v, m + 1, r)
        return {name: out}

    return windowed(df, kernel, window, [x], f"{name} double", order=order, rows=rows)


def pca_fit(df: DataFrame, columns: list[str], n: int | None = None, variance: float = 0.95, standardize: bool = True) -> dict:
    """Mean, scale, components and variance shares of the columns; from one distributed pass of moments (columns squared numbers to the driver)."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    whole = df.dropna(subset=columns)
    first = whole.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    mean = np.array([first[f"m{i}"] or 0.0 for i in range(k)], float)
    sums = whole.agg(*[F.sum((F.col(columns[i]) - float(mean[i])) * (F.col(columns[j]) - float(mean[j]))).alias(f"s{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = (sums[f"s{i}_{j}"] or 0.0) / max(first["n"] - 1, 1)
    scale = np.where(np.sqrt(np.diag(cov)) > 0, np.sqrt(np.diag(cov)), 1.0) if standardize else np.ones(k)
    value, vector = np.linalg.eigh(cov / np.outer(scale, scale))
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1].T
    vector *= np.sign(vector[np.arange(k), np.abs(vector).argmax(1)])[:, None]  # one sign
    share = value / value.sum() if value.sum() else value
    n = n or int(np.searchsorted(np.cumsum(share), variance - 1e-12) + 1)
    return {"mean": mean, "scale": scale, "components": vector[:n], "share": share[:n]}


def pca_transform(df: DataFrame, columns: list[str], fit: dict, prefix: str = "pca") -> DataFrame:
    """df with a column for each component, as plain sums."""
    unit = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(columns, fit["mean"], fit["scale"])]
    return df.select("*", *[sum((u * float(w) for u, w in zip(unit, row)), F.lit(0.0)).alias(f"{prefix}_{i}") for i, row in enumerate(fit["components"])])


def rolling_pca(df: DataFrame, columns: list[str], window: int, n: int = 1, prefix: str = "rolling_pca", order=ORDER, rows: int | None = None) -> DataFrame:
    """The last row's scores on the first n principal axes of the (uncentred) last window rows, largest weight positive.

    Axes are those of the windows' Gram matrices, columns squared numbers a row, made and solved for many rows at once.
    Null where a value of the window is, or where there are fewer than n columns or rows.
    """
    step = max(1, (1 << 20) // (window * len(columns)))  # windows at a time

    def kernel(c):
        x = np.stack([c[k] for k in columns], 1)
        out = np.full((len(x), n), np.nan)
        if len(x) >= window:
            v = sliding_window_view(x, window, axis=0)  # row, column, place
            whole = np.flatnonzero(np.isfinite(v).all((1, 2)))
            for at in (whole[i : i + step] for i in range(0, len(whole), step)):
                some = v[at]
                w = np.linalg.eigh(some @ some.transpose(0, 2, 1))[1][:, :, ::-1].transpose(0, 2, 1)[:, : min(n, window)]
                largest = np.take_along_axis(w, np.abs(w).argmax(2)[:, :, None], 2)
                out[window - 1 + at, : w.shape[1]] = (w * np.sign(largest) @ x[window - 1 + at][:, :, None])[:, :, 0]
        return {f"{prefix}_{k}": out[:, k] for k in range(n)}

    return windowed(df, kernel, window, columns, ", ".join(f"{prefix}_{k} double" for k in range(n)), order=order, rows=rows)


def correlation_distance(df: DataFrame, columns: list[str]) -> np.ndarray:
    """sqrt((1 - rho) / 2) of every pair of columns; an undefined correlation counts as 0."""
    k = len(columns)
    row = df.agg(*[safe_corr(F.col(columns[i]), F.col(columns[j])).alias(f"{i}_{j}") for i in range(k) for j in range(i)]).first() if k > 1 else {}
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i):
            rho = row[f"{i}_{j}"]
            out[i, j] = out[j, i] = math.sqrt(max(0.0, (1 - (rho if rho is not None and rho == rho else 0.0)) / 2))
    return out
