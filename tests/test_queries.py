"""Every registered query of the library on sf0.001, held against its DuckDB SQL where it has one."""

import math
import os

import duckdb
import pytest

from tickloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "events", "orders"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def key(row):
    return tuple((v is not None, 0 if isinstance(v, float) and math.isnan(v) else v) if not isinstance(v, float) else (v is not None, round(v, 3)) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name not in ORACLE_SQL:
        return
    rel = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    a = sorted((tuple(r[c] for c in order) for r in got), key=lambda r: str(key(r)))
    b = sorted((tuple(dict(zip(names, r))[c] for c in order) for r in want), key=lambda r: str(key(r)))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and v is not None and abs(u - v) <= 1e-5 * max(1, abs(v))), (x, y)


def test_order_of_rows_and_partitions_do_not_matter(spark):
    from tickloom.operators import bars
    from tickloom.sources.tapes import events_tape

    t = events_tape(spark, SF)
    for make in (lambda d: bars.assign_dollar_bars(d, 30_000), lambda d: bars.assign_tick_bars(d, 7), lambda d: bars.assign_volume_bars(d, 300)):
        a = sorted(map(str, bars.ohlcv(make(t)).collect()))
        b = sorted(map(str, bars.ohlcv(make(t.orderBy("price").repartition(7))).collect()))
        assert a == b and a
