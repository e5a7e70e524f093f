"""Live threshold bars equal the batch bars whatever way the trades come in."""

import math
import random

import pandas as pd
import pytest

from tickloom.operators.labels import triple_barrier
from tickloom.streaming.live import _new, fold_bars, live_exits, live_threshold_bars

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KIND = "symbol string, ts_ns long, seq long, price double, amount double"
SECOND = 1_000_000_000


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def trades(n=400):
    rnd = random.Random(6)
    t, rows = 1000 * SECOND, []  # Spark takes times at or before 1970 for late
    for i in range(n):
        t += rnd.choice((0, 1, 2, 5)) * SECOND
        rows.append((rnd.choice("ab"), t, i, 10 + rnd.random(), rnd.randint(1, 9) * 1.0))
    return rows


def batch(rows, limit, carry):
    out = []
    for s, part in pd.DataFrame(sorted(rows, key=lambda r: r[1:3]), columns=["symbol", "ts_ns", "seq", "price", "amount"]).groupby("symbol"):
        out += [(s, *b) for b in fold_bars(part, _new(), limit, carry)]
    return out


def run(spark, folder, checkpoint, limit, carry, name):
    src = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(folder)
    q = live_threshold_bars(src, limit, carry, "30 seconds").writeStream.format("parquet").option("path", name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None and not q.isActive
    return [tuple(r) for r in spark.read.parquet(name).collect()]


def write(folder, i, rows):
    pd.DataFrame(rows, columns=["symbol", "ts_ns", "seq", "price", "amount"]).to_json(folder / f"{i:03d}.json", orient="records", lines=True)


@pytest.mark.parametrize("limit, carry", [(400.0, True), (60.0, False)])
def test_late_repeated_and_shuffled_batches_and_a_restart(rocks, tmp_path, limit, carry):
    rnd, rows = random.Random(7), trades()
    want = sorted(batch(rows, limit, carry))
    assert len(want) > 20
    # Each trade comes up to 25 seconds late, some come twice; one comes far too late.
    came = sorted([(r[1] + rnd.randint(0, 25) * SECOND, r) for r in rows] + [(r[1] + rnd.randint(0, 25) * SECOND, r) for r in rows[::7]], key=lambda x: x[0])
    came = [r for _, r in came]
    src = tmp_path / "in"
    src.mkdir()
    step = len(came) // 5 + 1
    for i in range(3):
        part = came[i * step : (i + 1) * step]
        rnd.shuffle(part)
        write(src, i, part)
    first = run(rocks, str(src), str(tmp_path / "cp"), limit, carry, str(tmp_path / "out"))
    assert 0 < len(first) < len(want)
    for i in range(3, 5):  # after a restart from the checkpoint
        part = came[i * step : (i + 1) * step]
        rnd.shuffle(part)
        write(src, i, part)
    write(src, 5, [("a", 10 * SECOND, 9999, 99.0, 99.0)])
    write(src, 6, [(s, rows[-1][1] + 1000 * SECOND, 5000 + i, 1.0, 0.0) for i, s in enumerate("ab")])
    got = run(rocks, str(src), str(tmp_path / "cp"), limit, carry, str(tmp_path / "out"))
    key = lambda b: (*b[:3], *(round(x, 6) for x in b[3:9]), b[9])
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_exits_equal_the_batch_labels(rocks, tmp_path):
    """Signals and prices come late and shuffled, in other batches of files than each other."""
    rnd, rows = random.Random(11), [r[:4] for r in trades(300)]
    signals = [(*r, 0.02 + 0.01 * (r[2] % 3), rnd.choice((1, -1))) for r in rows[::9]]
    kinds = {"p": "symbol string, ts_ns long, seq long, price double", "s": "symbol string, ts_ns long, seq long, price double, target double, side int"}
    flush = rows[-1][1] + 5000 * SECOND
    for name, data, last in (("p", rows, [("z", flush, 9000, 1.0)]), ("s", signals + signals[:2], [("z", flush, 9000, 1.0, 0.1, 1)])):
        (tmp_path / name).mkdir()
        came = [r for _, r in sorted(((r[1] + rnd.randint(0, 25) * SECOND, r) for r in data), key=lambda x: x[0])]
        step = len(came) // 4 + 1
        for i, part in enumerate([*(came[k * step : (k + 1) * step] for k in range(4)), last]):
            part = list(part)
            rnd.shuffle(part)
            columns = [c.split(" ")[0] for c in kinds[name].split(", ")]
            pd.DataFrame(part, columns=columns).to_json(tmp_path / name / f"{i:03d}.json", orient="records", lines=True)
    src = {k: rocks.readStream.schema(v).option("maxFilesPerTrigger", 1).json(str(tmp_path / k)) for k, v in kinds.items()}
    horizon = 40 * SECOND
    q = live_exits(src["s"], src["p"], horizon, 1.0, 2.0, "30 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    got = sorted((r.symbol, r.event_ns, round(r.target, 6), r.side, r.t1_ns, round(r.ret, 6), r.touch) for r in rocks.read.parquet(str(tmp_path / "out")).collect())
    want, prices = set(), {}
    for s, t, seq, p in rows:
        prices.setdefault(s, []).append((t, seq, p))
    for s, t, seq, p, target, side in signals:
        path = [x for x in sorted(prices[s]) if x[:2] > (t, seq) and x[0] <= t + horizon]
        end = next((x for x in path if math.log(x[2] / p) * side >= target or math.log(x[2] / p) * side <= -2 * target), None)
        if path:
            x = end or path[-1]
            r = math.log(x[2] / p) * side
            want.add((s, t, round(target, 6), side, x[0], round(r, 6), "vertical" if end is None else "upper" if r > 0 else "lower"))
    assert got == sorted(want) and {r[-1] for r in got} == {"upper", "lower", "vertical"}
    # where no other trade shares its time, that is what the batch operator says
    alone = [e for e in signals if sum(r[:2] == e[:2] for r in rows) == 1]
    events = rocks.createDataFrame([(s, t, target, side) for s, t, _, _, target, side in alone], "symbol string, ts_ns long, target double, side int")
    batch_ = {(r.symbol, r.event_ns, round(r.target, 6), r.side, r.t1_ns, round(r.ret, 6), r.touch) for r in triple_barrier(events, rocks.createDataFrame(rows, kinds["p"]), horizon, 1.0, 2.0).collect()}
    assert batch_ and batch_ <= set(got)
