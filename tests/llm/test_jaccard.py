import itertools
import random
import re

import pytest

from tickloom.llm.jaccard_join import drop_copies, jaccard_classes


def brute(rows, n, num, den):
    sets = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * len(a & b) >= num * len(a | b):
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 5, 8, 20, 60, 300]))]
        rows.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((" " if rnd.random() < 0.5 else "\n").join(w).upper() if rnd.random() < 0.3 else " ".join(w))
    rows += ["", None, "   \n", "one", "one", "ONE", "ä b c d e", "x" * 50000, "é " * 20000]
    ids = list(range(len(rows)))
    rnd.shuffle(ids)
    return list(zip(ids, rows))


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_classes_match_brute_force(spark, n, num):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, node int").repartition(3)
    got = sorted(tuple(r) for r in jaccard_classes(df, n, num, 100).collect())
    assert got == brute(rows, n, num, 100)


def test_blocks_give_the_same_classes(spark, monkeypatch):
    import tickloom.llm.jaccard_join as m

    monkeypatch.setattr(m, "BLOCK", 3)
    monkeypatch.setattr(m, "SKETCH_BLOCK", 5)
    rnd = random.Random(1)
    base = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(30):
        base = list(base)
        base[rnd.randrange(200)] = f"z{i}"
        rows.append((i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_classes(df, 4, 85, 100).collect())
    assert got == brute(rows, 4, 85, 100)


def test_empty_and_nulls(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_classes(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(map(str, jaccard_classes(df).collect()))
    assert len(got) == 4 and sum("component_id=3" in x for x in got) == 3


def test_drop_copies_keeps_columns(spark):
    df = spark.createDataFrame([(2, "a b c d e f", "s"), (1, "A b c d e f", None), (5, None, "q")], "doc_id long, text string, source string")
    out = drop_copies(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {1, 5}
