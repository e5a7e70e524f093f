"""Order-dependent operators dealt by ranges of rows, so that one symbol uses as many tasks as it has ranges.

``blocks`` numbers each symbol's rows without a task that holds a symbol: rows
are dealt by equal widths of the first order column, counted there, and numbered
from the counts of the widths before; blocks are then exactly ``rows`` rows,
however the symbol's rows lie in time.

A kernel over a trailing window needs the rows just before its block: they are
copied into it (``windowed``).  A linear recursion s[i] = a * s[i-1] + x[i] is an
affine step, and steps compose: each block's composite is one aggregate, the
composites are run through in order (one row a block), and each block then
starts from what came before it (``decaying``).  Both read their input more than
once: indicators that are wanted together are made together (``recursions``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.recursive import decayed
from tickloom.operators import fold as folds
from tickloom.operators.fold import ORDER

#: Rows of a block.
ROWS = 1 << 18
HELP = ("_rn", "_block", "_halo", "_key")


def blocks(df: DataFrame, rows: int = ROWS, halo: int = 0, order: Sequence[str] = ORDER) -> DataFrame:
    """df with _rn (rows of the symbol before this one), _block (_rn div rows), _halo and a hash _key of symbol and block.

    The halo rows before a block are in it once more, with _halo true.  order must tell a symbol's rows apart and its
    first column be a number; rows where that is null come first.  A null symbol is a symbol.
    """
    order = [c for c in order if c in df.columns]
    first = F.col(order[0]).cast("double")
    span = df.groupBy("symbol").agg(F.min(first).alias("_low"), F.max(first).alias("_high"), F.count(F.lit(1)).alias("_all"))
    parts = F.ceil(F.col("_all") / rows)
    at = F.least(F.floor(F.try_divide(first - F.col("_low"), F.col("_high") - F.col("_low")) * parts), parts - 1)
    dealt = df.alias("d").join(span.withColumnRenamed("symbol", "_s"), F.col("symbol").eqNullSafe(F.col("_s"))).withColumn("_part", F.coalesce(F.when(first.isNull(), -1).otherwise(at), F.lit(0))).drop("_s", "_low", "_high", "_all")
    before = Window.partitionBy("symbol").orderBy("_part")
    counts = dealt.groupBy("symbol", "_part").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select(F.col("symbol").alias("_s"), F.col("_part").alias("_p"), (F.sum("_n").over(before) - F.col("_n")).alias("_base"))  # a row for about every `rows` rows
    pos = F.row_number().over(Window.partitionBy("symbol", "_part").orderBy(*order)) - 1
    out = dealt.withColumn("_rn", pos).join(base, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p"))).withColumn("_rn", F.col("_rn") + F.col("_base")).drop("_part", "_s", "_p", "_base")
    own = F.expr(f"_rn div {rows}")
    if halo:
        out = out.withColumn("_block", F.explode(F.sequence(own, F.expr(f"(_rn + {halo}) div {rows}")))).withColumn("_halo", F.col("_block") > own)
        ends = counts.select("symbol", F.expr(f"(sum(_n) over (partition by symbol) - 1) div {rows}").alias("_end")).distinct().withColumnRenamed("symbol", "_s")
        out = out.join(ends, F.col("symbol").eqNullSafe(F.col("_s"))).where(F.col("_block") <= F.col("_end")).drop("_s", "_end")
    else:
        out = out.withColumn("_block", own).withColumn("_halo", F.lit(False))
    return out.withColumn("_key", F.xxhash64("symbol", "_block"))


def windowed(df: DataFrame, kernel: Callable[[folds.Arrays], folds.Arrays], width: int, inputs: Sequence[str], outputs: str, order: Sequence[str] = ORDER, rows: int = ROWS) -> DataFrame:
    """``fold.windowed`` dealt by blocks: the same rows and columns, in as many tasks as there are blocks."""
    dealt = blocks(df, rows, width - 1, order)
    return folds.windowed(dealt, kernel, width, inputs, outputs, by="_key", order=("symbol", "_block", "_rn")).where("not _halo").drop(*HELP)


def decaying(df: DataFrame, sums: dict[str, tuple[Column, float]], rows: int = ROWS) -> DataFrame:
    """df (from ``blocks``, without halo) with a column for each of sums: s[i] = keep * s[i-1] + x[i] over a symbol's rows, s before the first row being 0.

    sums maps a name to (x, keep) with 0 <= keep < 1.  A null or NaN x makes its row and all later ones null.
    """
    names, keeps = list(sums), {n: keep for n, (_, keep) in sums.items()}  # tasks get numbers, not columns
    df = df.withColumns({f"_x_{n}": F.coalesce(x.cast("double"), F.lit(float("nan"))) for n, (x, _) in sums.items()})
    left = F.lit(rows - 1) - F.expr(f"_rn % {rows}")
    one = df.groupBy("symbol", "_block").agg(*[F.sum(F.col(f"_x_{n}") * F.pow(F.lit(float(keep)), left)).alias(n) for n, (_, keep) in sums.items()])

    def compose(s, c):
        """What a block starts from: the sums of the blocks before it."""
        out = {}
        for n, keep in keeps.items():
            after = decayed(c[n], keep**rows if keep else 0.0, s[n]) if len(c[n]) else c[n]
            out[f"_c_{n}"] = np.concatenate(([s[n]], after[:-1]))
            s[n] = after[-1]
        return {k: np.where(np.isnan(v), np.inf, v) for k, v in out.items()}  # NaN would become null, which is 0 below

    starts = folds.fold(one, lambda: dict.fromkeys(names, 0.0), compose, names, ", ".join(f"_c_{n} double" for n in names), order=("_block",))
    starts = starts.select(F.col("symbol").alias("_s"), F.col("_block").alias("_b"), *[f"_c_{n}" for n in names])
    whole = df.join(starts, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))).drop("_s", "_b")

    def apply(s, c):
        out = {}
        for n, keep in keeps.items():
            carry = s.get(n, c[f"_c_{n}"][0] if len(c[f"_c_{n}"]) else 0.0)
            got = decayed(c[f"_x_{n}"], keep, float("nan") if math.isinf(carry) else carry)
            s[n] = got[-1]
            out[n] = got
        return out

    inputs = [f"_{k}_{n}" for n in names for k in "xc"]
    return folds.fold(whole, dict, apply, inputs, ", ".join(f"{n} double" for n in names), by="_key", order=("symbol", "_block", "_rn")).drop(*inputs)


def recursions(
    df: DataFrame, ewma: dict | None = None, ew_std: dict | None = None, rsi: dict | None = None, atr: dict | None = None,
    high: str = "high", low: str = "low", close: str = "close", order: Sequence[str] = ORDER, rows: int = ROWS,
) -> DataFrame:
    """df with the named columns of ``recursive.ewma``, ``ew_std``, ``rsi`` and Wilder's ``atr``, dealt by blocks: one numbering and one scan, however many.

    ewma and ew_std map a name to (column, span), rsi to (column, n), atr to n.  The columns of rsi and atr have no nulls.
    """
    ewma, ew_std, rsi, atr = ewma or {}, ew_std or {}, rsi or {}, atr or {}
    order = [c for c in order if c in df.columns]
    names = df.columns
    lagged = sorted({c for c, _ in rsi.values()} | ({close} if atr else set()))
    rowed = blocks(df, rows, 1 if lagged else 0, order)
    if lagged:
        over = Window.partitionBy("symbol", "_block").orderBy("_rn")
        rowed = rowed.withColumns({f"_b_{c}": F.lag(c).over(over) for c in lagged}).where("not _halo")
    k = F.col("_rn")
    # What is summed: (x, how much is kept), and one number a symbol that some of them need first.
    sums: dict[str, tuple[Column, float]] = {}
    first: dict[str, Column] = {}
    done: dict[str, Column] = {}

    def wilder(name: str, x: Column, n: int, begin: int) -> Column:
        """The mean of the first n values is one step of the recursion; the rows before it are steps of nothing."""
        at = k - begin
        first[f"_h_{name}"] = F.sum(F.when(at.between(0, n - 1), x))
        sums[name] = F.when(at < n - 1, 0.0).when(at == n - 1, F.col(f"_h_{name}") / n).otherwise(x / n), 1 - 1 / n
        return F.when(at >= n - 1, F.col(name))

    for name, (x, span) in ewma.items():
        a = 1 - 2 / (span + 1)
        sums[f"_e_{name}"] = F.col(x), a
        done[name] = F.col(f"_e_{name}") / (-F.expm1((k + 1) * math.log(a)) / (1 - a) if a else F.lit(1.0))
    for name, (x, span) in ew_std.items():
        a = 1 - 2 / (span + 1)
        v = F.col(x).cast("double")
        ok = F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))
        first[f"_s_{name}"] = F.min_by(F.when(ok, v), F.when(ok, k))  # deviations from a first value lose no digits
        d, one = F.when(ok, v - F.col(f"_s_{name}")).otherwise(0.0), ok.cast("double")
        sums |= {f"_w_{name}": (one, a), f"_w2_{name}": (one, a * a), f"_d_{name}": (d, a), f"_dd_{name}": (d * d, a)}
        w, w2, mean = F.col(f"_w_{name}"), F.col(f"_w2_{name}"), F.col(f"_d_{name}") / F.col(f"_w_{name}")
        free = w * w - w2
        done[name] = F.when(ok & (free > 1e-12 * w * w), F.sqrt(F.greatest(F.col(f"_dd_{name}") / w - mean * mean, F.lit(0.0)) * w * w / free))
    for name, (x, n) in rsi.items():
        change = F.when(k > 0, F.col(x) - F.col(f"_b_{x}")).otherwise(0.0)
        up, down = wilder(f"_u_{name}", F.greatest(change, F.lit(0.0)), n, 1), wilder(f"_l_{name}", F.greatest(-change, F.lit(0.0)), n, 1)
        done[name] = F.when(down > 0, 100 - 100 / (1 + up / down))
    for name, n in atr.items():
        before = F.col(f"_b_{close}")
        done[name] = wilder(f"_t_{name}", F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before)), n, 0)
    if first:
        known = rowed.groupBy(F.col("symbol").alias("_s")).agg(*[x.alias(name) for name, x in first.items()])
        rowed = rowed.join(known, F.col("symbol").eqNullSafe(F.col("_s"))).drop("_s")
    return decaying(rowed, sums, rows).select(*[F.col(c) for c in names if c not in done], *[x.alias(name) for name, x in done.items()])


def ewma(df: DataFrame, x: str, span: int, name: str = "ewma", order: Sequence[str] = ORDER, rows: int = ROWS) -> DataFrame:
    """``recursive.ewma`` dealt by blocks."""
    return recursions(df, ewma={name: (x, span)}, order=order, rows=rows)


def ew_std(df: DataFrame, x: str, span: int, name: str = "ewms", order: Sequence[str] = ORDER, rows: int = ROWS) -> DataFrame:
    """``recursive.ew_std`` dealt by blocks."""
    return recursions(df, ew_std={name: (x, span)}, order=order, rows=rows)


def rsi(df: DataFrame, close: str = "close", n: int = 14, name: str = "rsi", order: Sequence[str] = ORDER, rows: int = ROWS) -> DataFrame:
    """``recursive.rsi`` dealt by blocks, for a close without nulls."""
    return recursions(df, rsi={name: (close, n)}, order=order, rows=rows)


def atr(df: DataFrame, n: int = 14, high: str = "high", low: str = "low", close: str = "close", name: str = "atr", order: Sequence[str] = ORDER, rows: int = ROWS) -> DataFrame:
    """``recursive.atr`` by Wilder, dealt by blocks, for prices without nulls."""
    return recursions(df, atr={name: n}, high=high, low=low, close=close, order=order, rows=rows)
