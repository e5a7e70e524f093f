"""Cross-validation splits as tables, overfitting and drift statistics, Sharpe statistics.

Splits are rows (split_id, row_id, role); row ids number a symbol-free event
table by time.  A fold is a range of row ids, so purging compares every row with
a few fold ranges only (broadcast; their number is a parameter).
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.buckets import sample_kurtosis, sample_skew
from tickloom.sources.scratch import Scratch

NORMAL = NormalDist()


def with_row_id(df: DataFrame, *order: str, chunks: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """df with row_id from 0 in the order of the columns, without one task for all: ranges, their counts, then a number in each.

    There are chunks ranges, as many as the session's shuffle partitions where it is not given.  Spark draws their limits
    from a sample, another one wherever the plan occurs, so the dealt rows are written once (to scratch) and both the
    counts and the rows are read from that table.
    """
    chunks = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(chunks, *order).sortWithinPartitions(*order)
    # the range in the upper bits, the row's number in it in the lower 33
    dealt = (scratch or Scratch(df.sparkSession)).write(ranges.withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_n", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_k"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_k")
    return dealt.join(F.broadcast(base), "_part").withColumn("row_id", F.col("_base") + F.col("_n")).drop("_part", "_n", "_base")


def fold_bounds(n: int, folds: int) -> list[tuple[int, int]]:
    """Ranges [start, end) of contiguous folds; the first n % folds have one row more."""
    size = [n // folds + (k < n % folds) for k in range(folds)]
    ends = np.cumsum(size).tolist()
    return [(e - s, e) for s, e in zip(size, ends)]


def _splits(df: DataFrame, tests: list[list[tuple[int, int]]], embargo: int) -> DataFrame:
    """Rows of each split: test inside a range, train outside unless the row's [start, t1] meets a test range's or it lies in the embargo after one.

    The times of the test ranges, of which there are as many as folds, are gathered first; then each row is judged by itself.
    """
    df = df.select("row_id", "ts_ns", F.greatest("ts_ns", F.coalesce("t1_ns", "ts_ns")).alias("_end"), F.coalesce("t1_ns", "ts_ns").alias("t1"))
    folds = sorted({r for t in tests for r in t})
    i = F.col("row_id")
    inside = [(i >= a) & (i < b) for a, b in folds]
    times = df.agg(*[F.min(F.when(x, F.col("ts_ns"))).alias(f"a{k}") for k, x in enumerate(inside)], *[F.max(F.when(x, F.col("_end"))).alias(f"b{k}") for k, x in enumerate(inside)]).first()
    near = []
    for k, (_, b) in enumerate(folds):
        met = F.lit(False) if times[f"a{k}"] is None else (F.col("ts_ns") < times[f"b{k}"]) & (F.col("t1") > times[f"a{k}"])
        near.append(met | ((i >= b) & (i < b + embargo)))
    rows = df.select("row_id", F.array(*inside).alias("_in"), F.array(*near).alias("_near"))
    of = {r: k for k, r in enumerate(folds)}
    any_ = lambda c, t: functools.reduce(lambda x, y: x | y, [F.col(c)[of[r]] for r in t])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("split_id"), any_("_in", t).alias("test"), any_("_near", t).alias("out")) for k, t in enumerate(tests)]))
    seen = rows.select("row_id", each.alias("_s")).select("_s.*", "row_id")
    return seen.where(F.col("test") | ~F.col("out")).select("split_id", "row_id", F.when(F.col("test"), "test").otherwise("train").alias("role"))


def purged_kfold(df: DataFrame, folds: int = 5, embargo_pct: float = 0.01) -> DataFrame:
    """Splits of df (row_id, ts_ns, t1_ns) into contiguous test folds with purged and embargoed training rows."""
    n = df.count()
    return _splits(df, [[b] for b in fold_bounds(n, folds)], int(n * embargo_pct))


def combinatorial_purged(df: DataFrame, folds: int = 6, test_folds: int = 2, embargo_pct: float = 0.01) -> DataFrame:
    """Splits for every choice of test_folds of the folds."""
    n = df.count()
    bounds = fold_bounds(n, folds)
    return _splits(df, [[bounds[k] for k in c] for c in itertools.combinations(range(folds), test_folds)], int(n * embargo_pct))


def cpcv_paths(folds: int, test_folds: int) -> list[list[int]]:
    """For each path, the split that gives each fold's test returns: path p takes the p-th split that holds the fold."""
    combos = list(itertools.combinations(range(folds), test_folds))
    holding = [[i for i, c in enumerate(combos) if f in c] for f in range(folds)]
    return [[holding[f][p] for f in range(folds)] for p in range(math.comb(folds - 1, test_folds - 1))]


def path_returns(returns: DataFrame, folds: int, test_folds: int) -> DataFrame:
    """(path_id, row_id, ret) from returns (split_id, fold_id, row_id, ret)."""
    rows = [(p, f, s) for p, path in enumerate(cpcv_paths(folds, test_folds)) for f, s in enumerate(path)]
    table = returns.sparkSession.createDataFrame(rows, "path_id int, fold_id int, split_id int")
    return returns.join(F.broadcast(table), ["fold_id", "split_id"]).select("path_id", "row_id", "ret")


def sharpe(x: str = "ret", per_year: float = 252.0) -> Column:
    """Annualised Sharpe ratio; 0 under two rows or without deviation."""
    sd = F.stddev_samp(x)
    return F.when((F.count(x) >= 2) & (sd > 0), F.avg(x) / sd * math.sqrt(per_year)).otherwise(0.0)


def pbo(inside: np.ndarray, outside: np.ndarray | None = None, method: str = "rank") -> float:
    """Probability of backtest overfitting of Sharpe ratios (splits, strategies): how often the best inside is under the median outside.

    method "probability" takes the normal chance that outside ratios are negative.
    """
    inside = np.asarray(inside, float)
    if inside.ndim == 1 or outside is None:
        x = inside.ravel()
        return float(NORMAL.cdf(-x.mean() / x.std(ddof=1))) if len(x) > 1 and x.std(ddof=1) > 0 else float((x < 0).mean())
    outside = np.asarray(outside, float)
    best = outside[np.arange(len(inside)), inside.argmax(1)]
    if method == "probability":
        return float(NORMAL.cdf(-best.mean() / best.std(ddof=1))) if len(best) > 1 and best.std(ddof=1) > 0 else float((best < 0).mean())
    return float((best < np.median(outside, axis=1)).mean())


def pbo_from_paths(paths: DataFrame, per_year: float = 252.0, min_rows: int = 20, min_paths: int = 10) -> float:
    """PBO of the Sharpe ratios of paths (path_id, ret); NaN with too few."""
    rows = paths.groupBy("path_id").agg(F.count("ret").alias("n"), sharpe("ret", per_year).alias("s")).where(F.col("n") >= min_rows).collect()  # a row a path
    return pbo(np.array([r.s for r in rows])) if len(rows) >= min_paths else math.nan


def trials(grid: dict[str, Sequence]) -> int:
    return math.prod(len(v) for v in grid.values())


def pbo_report(sharpes: Sequence[float], n_trials: int, level: float = 0.05) -> str:
    p = pbo(np.array(sharpes))
    return f"paths {len(sharpes)}, trials {n_trials}, mean Sharpe {np.mean(sharpes):.3f}, PBO {p:.3f}: {'accepted' if p < level else 'rejected'} at {level:g}"


def psi(train: DataFrame, test: DataFrame, columns: Sequence[str], bins: int = 10, floor: float = 0.01, warning: float = 0.1, critical: float = 0.25) -> DataFrame:
    """(feature, psi, status, train_missing, test_missing): population stability over the train quantiles' bins; 0 under ten rows.

    The bin edges are a few numbers a column; both tables are read twice with partial sums.
    """
    edges = train.agg(*[F.percentile(c, F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias(c) for c in columns]).first()

    def shares(df: DataFrame, name: str) -> DataFrame:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), sum((F.when(F.col(c) > e, 1).otherwise(0) for e in sorted(set(edges[c] or []))), F.lit(0)).alias("bin"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
        ok = F.col("v").isNotNull() & ~F.isnan("v")
        n = long.groupBy("feature").agg(F.count_if(ok).alias(f"{name}_n"), F.avg(F.when(ok, 0.0).otherwise(1.0)).alias(f"{name}_missing"))
        return long.where(ok).groupBy("feature", "bin").agg(F.count("*").alias(name)).join(F.broadcast(n), "feature", "right")

    all_bins = train.sparkSession.createDataFrame([(c, b) for c in columns for b in range(len(set(edges[c] or [])) + 1)], "feature string, bin int")
    a, b = shares(train, "train"), shares(test, "test")
    heads = a.select("feature", "train_n", "train_missing").distinct().join(b.select("feature", "test_n", "test_missing").distinct(), "feature")
    both = all_bins.join(a.select("feature", "bin", "train"), ["feature", "bin"], "left").join(b.select("feature", "bin", "test"), ["feature", "bin"], "left").join(heads, "feature")
    w = Window.partitionBy("feature")
    for k in ("train", "test"):
        both = both.withColumn(k, F.greatest(F.coalesce(F.try_divide(F.coalesce(k, F.lit(0)), f"{k}_n"), F.lit(0.0)), F.lit(floor)))
        both = both.withColumn(k, F.col(k) / F.sum(k).over(w))
    value = F.when((F.first("train_n") < 10) | (F.first("test_n") < 10), 0.0).otherwise(F.sum((F.col("test") - F.col("train")) * F.ln(F.col("test") / F.col("train"))))
    out = both.groupBy("feature").agg(value.alias("psi"), F.first("train_missing").alias("train_missing"), F.first("test_missing").alias("test_missing"))
    return out.withColumn("status", F.when(F.col("psi") >= critical, "critical").when(F.col("psi") >= warning, "warning").otherwise("stable"))


def psi_report(table: DataFrame) -> str:
    return "\n".join(f"{r.feature}: {r.psi:.4f} {r.status}" for r in table.orderBy(F.desc("psi")).collect())  # a row a feature


def walk_forward(n: int, train: int, test: int, step: int | None = None, embargo_pct: float = 0.01) -> list[tuple[int, int, int, int]]:
    """Sliding (train from, to, test from, to) row ranges with an embargo of a share of the test length between."""
    gap, out, at = int(test * embargo_pct), [], 0
    while at + train + gap + test <= n:
        out.append((at, at + train, at + train + gap, at + train + gap + test))
        at += step or test
    return out


def walk_forward_splits(df: DataFrame, train: int, test: int, step: int | None = None, embargo_pct: float = 0.01) -> DataFrame:
    """(split_id, row_id, role) of sliding windows over row_id; the splits of a row follow from its number."""
    gap, hop = int(test * embargo_pct), step or test
    width, n = train + gap + test, df.count()
    splits = 0 if n < width else (n - width) // hop + 1
    i = F.col("row_id")
    first, last = F.greatest(F.lit(0), F.floor((i - width) / hop) + 1), F.least(F.lit(splits - 1), F.floor(i / hop))
    rows = df.select("row_id").where(first <= last).withColumn("split_id", F.explode(F.sequence(first, last).cast("array<int>")))
    at = i - F.col("split_id") * hop
    role = F.when(at < train, "train").when(at >= train + gap, "test")
    return rows.select("split_id", "row_id", role.alias("role")).where("role is not null")


def walk_forward_validate(df: DataFrame, splits: DataFrame, strategy: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], per_year: float = 252.0) -> DataFrame:
    """(split_id, n, sharpe, mean, win_rate, worst, best) of strategy(train, test) returns, each split in its own task."""

    def run(key, frame):
        train, test = (frame[frame["role"] == r].sort_values("row_id") for r in ("train", "test"))
        x = np.asarray(strategy(train, test), float)
        sd = x.std(ddof=1) if len(x) > 1 else 0.0
        s = x.mean() / sd * math.sqrt(per_year) if sd > 0 else 0.0
        return pd.DataFrame([(key[0], len(x), s, x.mean() if len(x) else 0.0, (x > 0).mean() if len(x) else 0.0, x.min(initial=0.0), x.max(initial=0.0))], columns=["split_id", "n", "sharpe", "mean", "win_rate", "worst", "best"])

    return df.join(splits, "row_id").groupBy("split_id").applyInPandas(run, "split_id int, n long, sharpe double, mean double, win_rate double, worst double, best double")


def stability(results: DataFrame) -> dict:
    """Mean, deviation and extremes of the splits' Sharpe ratios, and their fall from the first third to the last."""
    s = np.array([r.sharpe for r in results.orderBy("split_id").collect()])  # a row a split
    k = max(1, len(s) // 3)
    fall = float(s[:k].mean() - s[-k:].mean()) if len(s) else 0.0
    return {"mean": float(s.mean()), "std": float(s.std(ddof=1)) if len(s) > 1 else 0.0, "min": float(s.min()), "max": float(s.max()), "degradation": fall, "stable": bool(fall < 0.5 and (s > 0).mean() >= 0.5)}


def probabilistic_sharpe(sr: float, n: int, skew: float, excess: float, benchmark: float = 0.0) -> float:
    """Chance that a per-period Sharpe ratio exceeds the benchmark; 0 under 50 rows."""
    if n < 50:
        return 0.0
    spread = 1 - skew * sr + (excess + 2) / 4 * sr * sr
    return NORMAL.cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(spread)) if spread > 0 else 0.0


def expected_max_sharpe(n_trials: int, sd: float = 0.5) -> float:
    """Expected greatest Sharpe ratio of n_trials strategies without skill."""
    if n_trials < 2:
        return 0.0
    g = 0.5772156649015329
    return sd * ((1 - g) * NORMAL.inv_cdf(1 - 1 / n_trials) + g * NORMAL.inv_cdf(1 - 1 / (n_trials * math.e)))


def sharpe_statistics(returns: DataFrame, by: Sequence[str] = (), n_trials: int = 100, sr_sd: float = 0.5, per_year: float = 252.0) -> DataFrame:
    """Per group: n, sharpe (annual), psr and dsr of the column ret; moments come from one aggregation."""
    m = returns.groupBy(*by).agg(F.count("ret").alias("n"), F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("sr"), sample_skew("ret").alias("skew"), sample_kurtosis("ret").alias("kurt"))
    best = expected_max_sharpe(n_trials, sr_sd) / math.sqrt(per_year)

    def run(frames):
        for f in frames:
            for name, level in (("psr", 0.0), ("dsr", best)):
                f[name] = [probabilistic_sharpe(*(0.0 if v != v else v for v in (s, n, k, e)), level) for s, n, k, e in zip(f["sr"].fillna(0), f["n"], f["skew"].fillna(0), f["kurt"].fillna(0))]
            yield f.assign(sharpe=f["sr"].fillna(0) * math.sqrt(per_year))[[*by, "n", "sharpe", "psr", "dsr"]]

    fields = [m.schema[c] for c in by]
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in fields)
    return m.mapInPandas(run, f"{kinds}n long, sharpe double, psr double, dsr double")
