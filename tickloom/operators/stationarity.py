"""Stationarity of many features at once: augmented Dickey-Fuller tests from mergeable cross-products.

A regression with any number of lags needs only sums of products of the level, the changes, the lagged changes, the
constant and the trend.  Rows are dealt in blocks (``ranges``) that hold the few rows before them once more; a block
gives one matrix of sums, matrices of blocks are added, and each series' regressions for all lags are solved from one
matrix of the size of the lags squared, whatever its length.  Lags drop rows at the front only, so those few rows are
kept apart and added for the shorter ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.breaks import critical_values, ffd, ffd_weights, p_step, schwert_lag
from tickloom.operators import ranges
from tickloom.operators.fold import ORDER, windowed

#: Fewest values of a series that is tested.
LEAST = 10


def products(y: np.ndarray, begin: int, lags: int) -> np.ndarray:
    """Rows (1, level, trend, change, lagged changes) of a series from its place begin on, y holding up to lags + 1 values before; what is not known is 0.

    The row of place i (from 1) has the change from i - 1 to i; its first lags places come without all their lags.
    """
    d = np.diff(y)
    first = max(begin, 1)
    n = begin + len(y)  # y's last place + 1, where y[0] stands at place begin
    out = np.zeros((n - first, lags + 4))
    if not len(out):
        return out
    i = np.arange(first, n)
    at = i - begin  # places in y; at >= 1 but for halos that the caller drops
    out[:, 0] = 1
    ok = at >= 1
    out[ok, 1], out[ok, 3] = y[at[ok] - 1], d[at[ok] - 1]
    out[:, 2] = i
    for k in range(1, lags + 1):
        have = at - k >= 1
        out[have, 3 + k] = d[at[have] - 1 - k]
    return out


def solve(total: np.ndarray, head: np.ndarray, n: int, lags: int, most: int, trend: bool) -> dict:
    """The test of least AIC over 0 to lags lags; total sums the rows from place most + 1 on, head holds the rows of places 1 to most."""
    best = None
    for lag in range(lags + 1):
        rows = head[lag:]
        gram = total + rows.T @ rows
        pick = [0, 1, *range(4, 4 + lag), *([2] if trend else [])]
        obs, k = n - 1 - lag, len(pick)
        if obs < k + 1:
            continue
        xx, xy, yy = gram[np.ix_(pick, pick)], gram[pick, 3], gram[3, 3]
        scale = np.sqrt(np.diag(xx))
        if not (scale > 0).all():
            continue
        unit = xx / np.outer(scale, scale)
        if np.linalg.matrix_rank(unit, hermitian=True, tol=1e-13 * k) < k:
            continue
        inverse = np.linalg.inv(unit)
        b = inverse @ (xy / scale)
        rss = float(yy - b @ (xy / scale))
        if rss <= max(1e-20, 1e-12 * yy):
            continue
        t = float(b[1] / math.sqrt(inverse[1, 1] * rss / (obs - k)))
        aic = obs * math.log(rss / obs) + 2 * k
        if best is None or aic < best["aic"]:
            best = {"t": t, "p": p_step(t, obs, trend), "lag": lag, "n": obs, "aic": aic, "critical": critical_values(obs, trend).tolist()}
    return best or {"t": None, "p": None, "lag": 0, "n": n, "aic": None, "critical": [None] * 3}


def adf_by_feature(df: DataFrame, features: Sequence[str], max_lag: int | None = None, trend: bool = True, order: Sequence[str] = ORDER, rows: int = ranges.ROWS) -> DataFrame:
    """(symbol, feature, t, p, lag, n, aic, critical): ``breaks.adf`` of every symbol's every feature, in one aggregation.

    Values that are null or not finite are left out of their series.  A series of under ten values, or one whose
    regressions are singular, has null t, p and aic.  p is the step value of ``breaks.p_step``.
    """
    order = [c for c in order if c in df.columns]
    wide = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("y")) for f in features]))
    long = df.select(F.col("symbol").alias("_symbol"), *order, wide.alias("_f")).select("_symbol", *order, "_f.feature", "_f.y")
    long = long.where("y is not null and not isnan(y) and abs(y) <> double('infinity')").withColumn("symbol", F.struct("_symbol", "feature"))
    sizes = long.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), F.min_by("y", F.struct(*order)).alias("_first"))
    longest = sizes.agg(F.max("_n")).first()[0] or 0  # one number
    most = min(schwert_lag(longest) if max_lag is None else max_lag, longest // 3)
    width = most + 4

    def lags_of(n: int) -> int:
        return min(schwert_lag(n) if max_lag is None else max_lag, n // 3)

    dealt = ranges.blocks(long, rows, most + 1, order).join(sizes.select(F.col("symbol").alias("_s"), "_first"), F.col("symbol").eqNullSafe(F.col("_s")))
    dealt = dealt.select("_key", "symbol", "_block", "_rn", "_halo", (F.col("y") - F.col("_first")).alias("y"))  # levels from the first value on lose no digits

    def summed(key, table):
        table = table.sort_by("_rn")
        halo = int(np.sum(table["_halo"].to_numpy()))
        at = int(table["_rn"][0].as_py())
        y = table["y"].to_numpy()
        z = products(y, at, most)
        place = np.arange(max(at, 1), at + len(y))
        own = place >= at + halo
        head, tail = z[own & (place <= most)], z[own & (place > most)]
        total = tail.T @ tail
        names = ["_symbol", "feature", "cell", "value"]
        of, kinds = table["symbol"][0].as_py(), table.schema.field("symbol").type
        cells = np.concatenate((total.ravel(), head.ravel()))
        # Cells of the matrix, then those of the first places' rows, which come from one block or a few.
        first = np.concatenate([np.arange(width) + width * (width + int(p)) for p in place[own & (place <= most)]]) if len(head) else np.zeros(0, np.int64)
        where = np.concatenate((np.arange(width * width), first)).astype(np.int64)
        return pa.table([pa.array([of["_symbol"]] * len(cells), kinds.field(0).type), pa.array([of["feature"]] * len(cells)), pa.array(where), pa.array(cells)], names=names)

    kind = df.schema["symbol"].dataType.simpleString()
    cells = dealt.groupBy("_key").applyInArrow(summed, f"_symbol {kind}, feature string, cell long, value double")
    added = cells.groupBy("_symbol", "feature", "cell").agg(F.sum("value").alias("value"))  # blocks' matrices are added where they are
    whole = added.groupBy(F.col("_symbol").alias("_s"), F.col("feature").alias("_f")).agg(F.map_from_entries(F.collect_list(F.struct("cell", "value"))).alias("cells"))
    sizes = sizes.select("symbol.*", "_n")
    table = sizes.join(whole, F.col("_symbol").eqNullSafe(F.col("_s")) & (F.col("feature") == F.col("_f")), "left").select("_symbol", "feature", "_n", "cells")

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for n, pairs in zip(batch.column(2).to_pylist(), batch.column(3)):
                flat = np.zeros(width * (width + most + 1))
                if pairs.is_valid:
                    for cell, value in pairs.as_py():
                        flat[cell] = value
                total = flat[: width * width].reshape(width, width)
                head = flat[width * (width + 1) :].reshape(most, width) if most else np.zeros((0, width))
                got.append(solve(total, head, n, lags_of(n), most, trend) if n >= LEAST else {"t": None, "p": None, "lag": 0, "n": n, "aic": None, "critical": [None] * 3})
            made = [pa.array([g[k] for g in got], t) for k, t in (("t", pa.float64()), ("p", pa.float64()), ("lag", pa.int64()), ("n", pa.int64()), ("aic", pa.float64()), ("critical", pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["symbol", "feature", "t", "p", "lag", "n", "aic", "critical"])

    return table.mapInArrow(solved, f"symbol {kind}, feature string, t double, p double, lag long, n long, aic double, critical array<double>")


def stationary_orders(df: DataFrame, features: Sequence[str], step: float = 0.05, most: float = 1.0, threshold: float = 1e-4, min_corr: float = 0.0, order: Sequence[str] = ORDER, rows: int = ranges.ROWS) -> DataFrame:
    """(symbol, feature, d, t, p, corr): for every feature the least order of a grid whose fractional difference has an ADF p under 0.05 and a correlation of min_corr with the series; where none has, the greatest order with null t, p and corr.

    All orders of all features are differenced in one pass over blocks, and tested in one aggregation.
    """
    grid = [round(float(d), 10) for d in np.arange(0, most + 1e-9, step)]
    at = [(f, d, f"_d{i}_{k}") for i, f in enumerate(features) for k, d in enumerate(grid)]
    width = max(len(ffd_weights(d, threshold)) if d else 1 for d in grid)

    def kernel(c):
        return {name: ffd(c[f], d, threshold) if d else c[f] for f, d, name in at}

    made = windowed(df, kernel, width, list(features), ", ".join(f"{name} double" for *_, name in at), order=order, rows=rows)
    tests = adf_by_feature(made, [name for *_, name in at], order=order, rows=rows)
    corr = made.groupBy("symbol").agg(*[F.corr(name, f).alias(name) for f, _, name in at])
    corr = corr.select(F.col("symbol").alias("_s"), F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), F.lit(f).alias("_of"), F.lit(d).alias("d"), F.col(name).alias("corr")) for f, d, name in at])).alias("c")).select("_s", "c.*")
    rows_ = corr.join(tests.withColumnRenamed("feature", "_t"), F.col("_s").eqNullSafe(F.col("symbol")) & (F.col("_name") == F.col("_t")), "left")
    ok = (F.col("p") < 0.05) & (F.lit(min_corr <= 0) | (F.col("corr") >= min_corr))
    pick = rows_.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("_k", F.row_number().over(Window.partitionBy("_s", "_of").orderBy(F.desc("_ok"), "d"))).where("_k = 1")
    kept = lambda c: F.when(F.col("_ok"), F.col(c)).alias(c)
    return pick.select(F.col("_s").alias("symbol"), F.col("_of").alias("feature"), F.when(F.col("_ok"), F.col("d")).otherwise(F.lit(float(most))).alias("d"), kept("t"), kept("p"), kept("corr"))
