"""Barrier grids against one plain triple barrier a combination."""

import math
import random

import pytest

from tickloom.operators import labels
from tickloom.operators.passage import barrier_grid, barrier_scores, records

PAIRS, VERTICALS = [(1.0, 1.0), (2.0, 0.5), (None, 1.0), (3.0, None)], [40, 200]


def tape(n=900, seed=4):
    rnd, rows, t = random.Random(seed), [], {"a": 0, "b": 50}
    price = {"a": 100.0, "b": 7.0}
    for i in range(n):
        s = rnd.choice("aab")
        t[s] += rnd.choice((0, 1, 1, 2, 9))
        price[s] = max(0.5, price[s] + rnd.choice((-1, 0, 0, 1)) * 0.25)
        rows.append((s, t[s], i, price[s]))
    return rows


def events(rows, seed=5):
    rnd = random.Random(seed)
    at = rnd.sample(rows, 120)
    return [(s, t + rnd.choice((0, 0, 3)), rnd.choice((0.0, 0.01, 0.05)), rnd.choice((1, -1))) for s, t, *_ in at] + [("a", -30, 0.01, 1), ("b", 10**6, 0.01, 1), ("c", 5, 0.01, 1)]


def plain(rows, evs, min_close):
    out = set()
    for s, e, target, side in set(evs):
        path = sorted((t, q, p) for x, t, q, p in rows if x == s and t >= e)
        for profit, loss in PAIRS:
            for v in VERTICALS:
                inside = [x for x in path if x[0] <= e + v]
                if len(inside) < 2:
                    continue
                p0, touch = inside[0][2], "vertical"
                for t, _, p in inside[1:]:
                    r = math.log(p / p0) * side
                    if t - e >= min_close and (profit is not None and r >= target * profit or loss is not None and r <= -target * loss):
                        touch = "upper" if profit is not None and r >= target * profit else "lower"
                        break
                out.add((s, e, target, side, profit, loss, v, t, round(r, 9), p0, p, touch))
    return out


@pytest.mark.parametrize("rows, min_close", [(1, 0), (7, 0), (7, 25), (4096, 5)])
def test_grid_against_a_plain_loop(spark, rows, min_close):
    prices = tape()
    evs = [e for e in events(prices) if e[2] > 0]
    df = spark.createDataFrame(prices + [("a", 3, 5000, None), ("a", 3, 5001, 0.0)], "symbol string, ts_ns long, seq long, price double").repartition(5)
    ev = spark.createDataFrame(evs + evs[:3] + [("a", 5, None, 1), ("a", 5, math.nan, 1), (None, 5, 0.1, 1)], "symbol string, ts_ns long, target double, side int")
    got = barrier_grid(ev, df, PAIRS, VERTICALS, min_close, rows=rows).collect()
    assert {(*r[:8], round(r.ret, 9), *r[9:]) for r in got} == plain(prices, evs, min_close)
    assert len(got) == len(set(got)) and {r.touch for r in got} == {"upper", "lower", "vertical"}


def test_grid_equals_one_triple_barrier_a_combination(spark):
    prices = tape(500, 9)
    df = spark.createDataFrame(prices, "symbol string, ts_ns long, seq long, price double")
    ev = spark.createDataFrame(events(prices), "symbol string, ts_ns long, target double, side int")  # targets of 0 too
    grid = barrier_grid(ev, df, PAIRS, VERTICALS, rows=16).collect()
    for profit, loss in PAIRS:
        for v in VERTICALS:
            want = {(r.symbol, r.event_ns, r.target, r.side, r.t1_ns, round(r.ret, 9)) for r in labels.triple_barrier(ev.distinct(), df, v, profit, loss).collect()}
            assert {(r.symbol, r.event_ns, r.target, r.side, r.t1_ns, round(r.ret, 9)) for r in grid if (r.profit, r.loss, r.vertical_ns) == (profit, loss, v)} == want


def test_no_rows(spark):
    df = spark.createDataFrame([], "symbol string, ts_ns long, seq long, price double")
    ev = spark.createDataFrame([("a", 1, 0.1)], "symbol string, ts_ns long, target double")
    assert barrier_grid(ev, df, PAIRS, VERTICALS).count() == 0
    assert barrier_grid(ev.limit(0), df, PAIRS, VERTICALS).count() == 0


def test_no_event_is_joined_with_the_rows_of_its_path(spark):
    df = spark.createDataFrame(tape(50), "symbol string, ts_ns long, seq long, price double")
    ev = spark.createDataFrame(events(tape()), "symbol string, ts_ns long, target double, side int")
    for found in (labels.triple_barrier(ev, df, 40), barrier_grid(ev, df, PAIRS, VERTICALS)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "CoGroup" in plan


def test_rows_of_unknown_and_of_no_price(spark):
    """Null and negative prices are rows without a return; from 0 the first price above is an infinite one."""
    rows = [("a", 0, 0, 1.0), ("a", 1, 1, None), ("a", 2, 2, -1.0), ("b", 0, 0, 0.0), ("b", 1, 1, None), ("b", 2, 2, 5.0), ("c", 0, 0, None), ("c", 1, 1, 2.0), ("d", 0, 0, 3.0), ("d", 1, 1, 0.0), ("d", 2, 2, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, ts_ns long, seq long, price double")
    ev = spark.createDataFrame([(s, 0, 0.1) for s in "abcd"], "symbol string, ts_ns long, target double")
    got = {r.symbol: (r.t1_ns, r.ret, r.touch, r.bin) for r in labels.triple_barrier(ev, df, 10).collect()}
    assert got == {"a": (2, None, "vertical", None), "b": (2, math.inf, "upper", 1), "c": (1, None, "vertical", None), "d": (1, -math.inf, "lower", -1)}


def test_first_beyond_against_a_loop():
    import numpy as np

    from tickloom.operators.passage import first_beyond, tree

    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 64, 100):
        p = np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n))
        start, last, level = rng.integers(0, n + 2, 300), rng.integers(-1, n + 3, 300), rng.normal(size=300) * 1.5
        for high, sign in ((True, 1), (False, -1)):
            got = first_beyond(tree(p, high), start, last, lambda x, i, sign=sign: sign * x >= level[i])
            want = [next((j for j in range(a, min(b, n - 1) + 1) if sign * p[j] >= k), n) for a, b, k in zip(start.tolist(), last.tolist(), level.tolist())]
            assert got.tolist() == want


def test_records():
    import numpy as np

    high, low = records(np.array([2.0, 2.0, 3.0, 1.0, 3.0, 4.0]))
    assert high.tolist() == [0, 2, 5] and low.tolist() == [0, 3]


def test_scores(spark):
    rows = [("a", 0, 0.1, 1, 1.0, 1.0, 10, 5, r, 10.0, 10.0 + r, "upper" if r > 0 else "lower") for r in (0.3, 0.1, -0.1, 0.02)]
    grid = spark.createDataFrame(rows, "symbol string, event_ns long, target double, side int, profit double, loss double, vertical_ns long, t1_ns long, ret double, entry double, exit double, touch string")
    a, b = barrier_scores(grid, (0.0, 0.05)).orderBy("rank").collect()
    assert (a.n, a.wins, a.losses, a.win_rate, a.dsr, a.min_ret, a.positive, b.positive) == (4, 3, 1, 0.75, 0.0, 0.0, 0.75, 0.5)
    assert abs(a.pl_ratio - 1.4) < 1e-9 and abs(a.quality - (0.4 + 0.4 * 0.75 + 0.2 * 4 / 500)) < 1e-9
    assert abs(a.total_points - 0.32) < 1e-9 and a.upper_rate == 0.75
