import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm.hard_negatives import bounds, hard_negatives

KIND = "vec_id long, label int, embedding array<long>, key int, anchor string"


def plain(rows):
    rows = [r for r in rows if None not in r[:3] and None not in r[2]]
    out = []
    for i, (a, label, v, *_) in enumerate(rows):
        if a % 5:
            continue
        score = [(-sum(x * y for x, y in zip(v, w)), b, other) for j, (b, other, w, *_) in enumerate(rows) if j != i and len(w) == len(v)]
        for ps, p, _ in sorted(s for s in score if s[2] == label)[:5]:
            fit = sorted(s for s in score if s[2] != label and 50 * -ps <= 100 * -s[0] <= 95 * -ps)[:3]
            out += [(a, p, r + 1, b, -ps, -ns) for r, (ns, b, _) in enumerate(fit)]
    return sorted(out)


def table(n, dim, spread, seed=3):
    rnd = np.random.default_rng(seed)
    heads = rnd.normal(size=(6, dim)) * 40
    at = rnd.integers(0, 6, n)
    v = np.floor(heads[at] + rnd.normal(size=(n, dim)) * spread).astype(int)
    return [(i, int((at[i] + (rnd.random() < 0.2)) % 4), v[i].tolist(), i, "x") for i in range(n)]


@pytest.mark.parametrize("spread, leaf, group, fan", [(4, 16, 3, 2), (40, 50, 7, 4), (15, 2048, 256, 32)])
def test_against_brute_force(spark, spread, leaf, group, fan):
    rows = table(700, 6, spread)
    rows += [(10_000 + i, 1, rows[4][2], i, "x") for i in range(90)]  # one very frequent vector, its anchors too
    rows += [(20_000, None, [1] * 6, 0, "x"), (20_005, 1, None, 0, "x"), (20_010, 2, [1, None, 3, 4, 5, 6], 0, "x"), (None, 2, [9] * 6, 0, "x")]
    rows += [(30_000 + i, i % 3, [i, -i, 7], 0, "x") for i in range(40)]  # vectors of another length
    rows += [(40_000 + i, i % 2, [], 0, "x") for i in range(6)]
    rows += [(50_000 + i, i % 2, [0] * 6, 0, "x") for i in range(6)]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got = sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 5 == 0, leaf=leaf, group=group, fan=fan).collect())
    assert got == plain(rows) and len(got) > 1000


def test_large_numbers_are_exact(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, i % 3, [int(x) for x in rnd.integers(5 * 10**8, 6 * 10**8, 3)], 0, "x") for i in range(60)] + [(100, 1, [2**40, 0, 0], 0, "x")]
    got = sorted(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, KIND), F.col("vec_id") % 5 == 0).collect())
    assert got == plain(rows[:-1])  # the last row's own product does not fit


def test_few_rows(spark):
    df = spark.createDataFrame([(0, 1, [3, 4], 0, "x"), (0, 1, [3, 4], 0, "x"), (1, 2, [2, 3], 0, "x")], KIND)
    got = [tuple(r) for r in hard_negatives(df, F.col("vec_id") % 5 == 0).collect()]
    assert got == [(0, 0, 1, 1, 25, 18)] * 2  # repeated rows are each other's positives
    assert hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert hard_negatives(df, F.lit(False)).count() == 0


def test_bounds_hold():
    rnd = np.random.default_rng(2)
    sets = [rnd.integers(-50, 50, (9, 5)) + rnd.integers(-300, 300, 5) for _ in range(8)]
    node = [{"low": s.min(0).astype(float), "high": s.max(0).astype(float), "center": s.mean(0), "radius": np.sqrt(((s - s.mean(0)) ** 2).sum(1).max())} for s in sets]
    low, high = bounds(node, node)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert low[i, j] <= (a @ b.T).min() and (a @ b.T).max() <= high[i, j]
    assert (low > 0).any() and (high < 0).any()  # some pairs are told apart


def test_query(spark):
    from tickloom.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet{'/*.parquet' if __import__('os').path.isdir(sf + '/embeddings.parquet') else ''}'")
    rel = c.execute(ORACLE_SQL["op13_hard_negatives"])
    names = [d[0] for d in rel.description]
    want = sorted(tuple(dict(zip(names, r)).values()) for r in rel.fetchall())
    got = QUERIES["op13_hard_negatives"](spark, sf)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == want and want
