"""Prices of 0, alone and in runs: quotients and logs are infinite or NaN as in the queries' SQL, and null nowhere else than there."""

import math

import duckdb
import numpy as np
import pytest

from tickloom.queries import ORACLE_SQL, QUERIES

NAMES = ["rolling_backtest", "backtest_statistics", "cost_pressure", "filter_diagnostics"]
NAMES += ["deep_metrics", "deep_screen", "bar_quality", "time_window_return", "touch_backtest", "volatility_factors", "volume_factors", "walk_forward_stability", "rolling_levels", "rolling_returns", "run_lengths", "cross_ma"]
NAMES += ["cusum_bars", "cusum_events", "event_turnover", "triple_barrier", "barrier_grid", "purged_kfold", "combinatorial_purged"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """events of two symbols over four days: single prices of 0, runs of them, and one symbol without."""
    d = tmp_path_factory.mktemp("zero")
    rng = np.random.default_rng(5)
    rows = []
    for k, symbol in enumerate(("a", "b", "c")):
        price = np.round(rng.exponential(60, 900) + 0.01, 2)
        if symbol != "c":
            price[rng.random(900) < 0.05] = 0
            price[300 + k : 365 + k] = 0
            price[np.arange(20, 900, 60)] = 0  # closes of bars, and opens
            price[np.arange(41, 900, 100)] = 0
        rows += [(i * 3 + k, i * 380_000_000 + k * 1_000_000 + 7, symbol, float(p), '{"k": %d}' % rng.integers(0, 99)) for i, p in enumerate(price)]
    c = duckdb.connect()
    c.execute("create table e (event_id bigint, us bigint, event_type varchar, value double, props varchar)")
    c.executemany("insert into e values (?, ?, ?, ?, ?)", rows)
    c.execute(f"copy (select event_id, make_timestamp(1704067200000000 + us) as ts, event_id as user_id, event_type, value, props from e) to '{d}/events.parquet'")
    c.execute(f"create view events as select * from '{d}/events.parquet'")
    return str(d), c


def test_cusum_bars_close_within_a_block_of_one_time(spark, tmp_path):
    """As the SQL has it; the operator's default closes at the end of the block."""
    from pyspark.sql import functions as F

    from tickloom.operators import bars

    prices = [1.0, 1.0, 9.0, 1.0, 1.0, 9.0]
    t = spark.createDataFrame([("a", 10 + i // 3, i, p, 1.0) for i, p in enumerate(prices)], "symbol string, ts_ns long, seq long, price double, amount double").withColumn("sigma", F.lit(0.5))
    of = lambda **k: [r.bar_id for r in bars.assign_cusum_bars(t, "sigma", **k).orderBy("seq").collect()]
    assert of(whole_times=False) == [None, 0, 0, 1, 2, 2] and of() == [None, 0, 0, 1, 1, 1]
    c = duckdb.connect()
    c.execute("create table events as select i as event_id, make_timestamp(1704067200000000 + i // 3) as ts, i as user_id, 'a' as event_type, [1.0, 1, 9, 1, 1, 9][i + 1]::double as value, '{\"k\": 0}' as props from range(6) r(i)")
    c.execute(f"copy events to '{tmp_path}/events.parquet'")
    got = {(r.bar_id, r.trades) for r in QUERIES["cusum_bars"](spark, str(tmp_path)).collect()}
    assert got == set(c.execute(f"select bar_id, trades from ({ORACLE_SQL['cusum_bars']})").fetchall()) == {(0, 2), (1, 1), (2, 2)}


def comparable(v):
    """Null, NaN and the infinities apart from each other and from numbers."""
    if not isinstance(v, float):
        return str(v)
    return "NaN" if math.isnan(v) else str(v) if math.isinf(v) else round(v, 3) + 0.0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, tables, name):
    d, c = tables
    df = QUERIES[name](spark, d)
    got = df.collect()
    rel = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in rel.description]
    want = rel.fetchall()
    assert sorted(names) == sorted(df.columns) and len(got) == len(want) > 0
    order = sorted(names)
    a = sorted((tuple(comparable(r[c]) for c in order) for r in got), key=str)
    b = sorted((tuple(comparable(dict(zip(names, r))[c]) for c in order) for r in want), key=str)
    for x, y in zip(a, b):
        for u, v, column in zip(x, y, order):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-3 * max(1, abs(v))), (column, x, y)


def test_walk_forward_slices_of_zero_prices_and_of_few_rows(spark, tables):
    rows = QUERIES["walk_forward_backtest"](spark, tables[0]).collect()
    assert {r.symbol for r in rows} == {"a", "b", "c"}
    from pyspark.sql import functions as F

    from tickloom.plans import pipelines

    few = spark.range(4).select(F.lit("a").alias("symbol"), F.col("id").alias("bar_id"), F.col("id").alias("ts_ns"), F.lit(1.0).alias("open"), F.lit(1.0).alias("close"), F.lit(1).alias("signal"))
    assert pipelines.walk_forward_backtest(few, "signal", 2).collect() == []
