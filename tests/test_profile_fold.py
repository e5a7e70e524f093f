"""Volume profiles of sliding windows, held against a loop over every bar's whole window."""

import random
from collections import defaultdict

import numpy as np

from tickloom.operators import bars


def made(spark, n=300, seed=3):
    """Bars of two symbols with equal times, gaps over the window, levels far apart and bars without levels."""
    rnd, times, levels = random.Random(seed), [], []
    for symbol in ("a@1", "b"):
        t = 1000
        for i in range(n):
            t += rnd.choice((0, 1, 1, 3, 90 if i % 97 == 0 else 2))
            times.append((symbol, i, t))
            for level in sorted(rnd.sample(range(-4, 9), rnd.choice((0, 1, 3)))) + ([4000] if i % 50 == 7 else []):
                levels.append((symbol, i, level, rnd.random() * 1e6, rnd.choice((0.0, 0.1, 1e-7))))
    return times, levels


def test_against_a_loop_over_each_window(spark):
    times, levels = made(spark)
    b = spark.createDataFrame(times, "symbol string, bar_id long, ts_ns long").repartition(3)
    lv = spark.createDataFrame(levels, "symbol string, bar_id long, level long, buy_volume double, sell_volume double").repartition(4)
    of = defaultdict(list)
    for symbol, bar, level, x, y in levels:
        of[symbol, bar].append((level, x + y))
    want, width = {}, 40
    for symbol, bar, t in times:
        sums = defaultdict(float)
        for s, other, u in times:
            if s == symbol and t - width <= u <= t:
                for level, v in of[s, other]:
                    sums[level] += v
        if t >= 1000 + width and min(u for s, _, u in times if s == symbol) + width <= t and sums:
            k = sorted(sums)
            want[symbol, bar] = bars.profile_area(np.array(k), np.array([sums[x] for x in k]))
    found = bars.volume_profile(lv, b, width, 1.0)
    got = {(r.symbol, r.bar_id): (r.poc, r.hva, r.lva, r.pct_above_poc) for r in found.collect()}
    assert got.keys() == want.keys() and len(got) > 400
    for k, v in want.items():
        assert got[k][:3] == v[:3] and abs(got[k][3] - v[3]) < 1e-9, (k, got[k], v)
    assert "_k#" not in found._jdf.queryExecution().executedPlan().toString()  # no bar meets its window's rows by buckets
