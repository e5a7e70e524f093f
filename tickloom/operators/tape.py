"""Trade preprocessing: units, order, duplicates, split trades, time resolution, tick rule, tick size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def _by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts_ns", "seq")


def unit_of(largest: Column) -> Column:
    """The unit that a largest timestamp is in: ns, us, ms or s."""
    return F.when(largest > 10**18, "ns").when(largest > 10**15, "us").when(largest > 10**12, "ms").otherwise("s")


def to_ns(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """df with ts_ns: ts in nanoseconds, its unit inferred from its largest value."""
    unit = df.agg(unit_of(F.max(ts)).alias("u")).first()["u"]
    return df.withColumn("ts_ns", F.col(ts).cast("long") * {"ns": 1, "us": 1000, "ms": 10**6, "s": 10**9}[unit])


def first_of_each_seq(tape: DataFrame, arrival: str | None = None) -> DataFrame:
    """One row for each (symbol, seq): the one that arrived first (by the column arrival, else the earliest, then the lowest price and amount)."""
    w = Window.partitionBy("symbol", "seq").orderBy(*([arrival] if arrival else ["ts_ns", "price", "amount"]))
    return tape.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_split_trades(tape: DataFrame) -> DataFrame:
    """Neighbouring trades of one time, price (within 1e-8) and maker side become one; amounts add up; side is -1 for a buyer-maker, else 1."""
    same = (
        (F.col("ts_ns") == F.lag("ts_ns").over(_by_time()))
        & (F.abs(F.col("price") - F.lag("price").over(_by_time())) < 1e-8)
        & F.col("is_buyer_maker").eqNullSafe(F.lag("is_buyer_maker").over(_by_time()))
    )
    runs = tape.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(_by_time()))
    out = runs.groupBy("symbol", "_run").agg(
        F.min("ts_ns").alias("ts_ns"), F.min("seq").alias("seq"), F.min_by("price", "seq").alias("price"), F.sum("amount").alias("amount"), F.min_by("is_buyer_maker", "seq").alias("is_buyer_maker")
    )
    return out.drop("_run").withColumn("side", F.when(F.col("is_buyer_maker"), -1).otherwise(1).cast("byte"))


def floor_time(ts_ns: Column, unit_ns: int) -> Column:
    return ts_ns - F.pmod(ts_ns, F.lit(unit_ns))


def tick_rule(tape: DataFrame, price: str = "price") -> DataFrame:
    """tape with side: the sign of the last price change over 1e-12, 0 before there is one."""
    change = F.col(price) - F.lag(price).over(_by_time())
    return tape.withColumn("_d", F.when(F.abs(change) > 1e-12, F.signum(change))).withColumn(
        "side", F.coalesce(F.last("_d", ignorenulls=True).over(_by_time().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)).cast("int")
    ).drop("_d")


def is_ordered(tape: DataFrame) -> DataFrame:
    """(symbol, ordered): whether time never falls along the sequence numbers."""
    w = Window.partitionBy("symbol").orderBy("seq")
    late = tape.select("symbol", (F.col("ts_ns") < F.lag("ts_ns").over(w)).alias("late"))
    return late.groupBy("symbol").agg((F.count_if("late") == 0).alias("ordered"))


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def preprocess(tape: DataFrame, unit_ns: int = 1) -> DataFrame:
    """First of each seq, split trades merged, times floored to unit_ns, side known."""
    tape = first_of_each_seq(tape)
    if "is_buyer_maker" in tape.columns:
        tape = merge_split_trades(tape)
        return tape.withColumn("ts_ns", floor_time(F.col("ts_ns"), unit_ns))
    return tick_rule(tape.withColumn("ts_ns", floor_time(F.col("ts_ns"), unit_ns)))


def tick_size(tape: DataFrame, rows: int = 10_000, digits: int = 8) -> DataFrame:
    """(symbol, tick_size): the greatest common divisor of the differences of the distinct prices among a symbol's
    first rows trades, in units of 10**-digits; 0 with one price.  The prices of a task's symbol are at most rows."""

    def gcd(key, table):
        units = np.unique(np.rint(np.array(table["price"].to_pylist()) * 10**digits).astype(np.int64))
        size = math.gcd(*np.diff(units).tolist()) if len(units) > 1 else 0
        return pa.table({"symbol": [key[0].as_py()], "tick_size": [size / 10**digits]})

    first = tape.withColumn("_n", F.row_number().over(_by_time())).where(F.col("_n") <= rows)
    return first.select("symbol", "price").distinct().groupBy("symbol").applyInArrow(gcd, "symbol string, tick_size double")


def tick_size_by_median(tape: DataFrame) -> DataFrame:
    """(symbol, tick_size): the median difference of neighbouring distinct prices, to two significant digits."""
    distinct = tape.select("symbol", "price").distinct()
    step = distinct.select("symbol", (F.col("price") - F.lag("price").over(Window.partitionBy("symbol").orderBy("price"))).alias("d")).where("d is not null")
    median = step.groupBy("symbol").agg(F.percentile("d", F.lit(0.5)).alias("m"))
    scale = F.pow(F.lit(10.0), F.floor(F.log10("m")) - 1)
    return median.select("symbol", (F.round(F.col("m") / scale) * scale).alias("tick_size"))
