"""Order statistics over trailing windows of rows from one sorted window that slides.

A frame of ``percentile`` sorts itself anew at every row; here a row's value is
put in and the value that leaves is taken out by binary search, and any number of
quantiles is read off by place.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.rolling import div
from tickloom.operators.fold import ORDER, windowed


def quantiles_of(x: np.ndarray, n: int, qs: Sequence[float]) -> np.ndarray:
    """Row i: the quantiles qs (linear between neighbours) of x[i - n + 1 : i + 1], NaN where that is not n known values."""
    places = [(int(q * (n - 1)), q * (n - 1) - int(q * (n - 1))) for q in qs]
    out = np.full((len(x), len(qs)), np.nan)
    values, window = x.tolist(), []
    for i, v in enumerate(values):
        if i >= n and values[i - n] == values[i - n]:
            del window[bisect_left(window, values[i - n])]
        if v == v:
            insort(window, v)
        if len(window) == n:
            out[i] = [window[k] if not part else window[k] + (window[k + 1] - window[k]) * part for k, part in places]
    return out


def sliding_quantiles(df: DataFrame, x: str, n: int, qs: dict[str, float], order=ORDER, rows: int | None = None) -> DataFrame:
    """df with a column for each of qs (name: quantile from 0 to 1) of the last n rows of x; null until these are n known values.

    With rows, a symbol is dealt in blocks of so many rows.  A null x is in the window and makes it null; repeated
    values count as often as they occur; an empty table gives none.
    """
    if n < 1 or not all(0 <= q <= 1 for q in qs.values()):
        raise ValueError("a window has one row or more, a quantile is from 0 to 1")

    def kernel(c):
        found = quantiles_of(c[x].astype(float), n, list(qs.values()))
        return {name: found[:, k] for k, name in enumerate(qs)}

    return windowed(df, kernel, n, [x], ", ".join(f"`{name}` double" for name in qs), order=order, rows=rows)


def sliding_burst(df: DataFrame, x: str, n: int, name: str = "burst", order=ORDER, rows: int | None = None) -> DataFrame:
    """x over the median of its last n rows; null where that is not positive or not known."""
    return sliding_quantiles(df, x, n, {"_median": 0.5}, order, rows).withColumn(name, F.when(F.col("_median") > 0, div(F.col(x).cast("double"), F.col("_median")))).drop("_median")
