import random

import pytest

import tickloom.llm.components as m
from tickloom.llm.workspace import Workspace


@pytest.mark.parametrize("one_task", [0, 500_000])
def test_components_are_those_of_a_plain_search_either_way(spark, monkeypatch, one_task):
    """A path, a star, a ring, random pairs, loops, repeats and nulls; in one task and in distributed rounds."""
    monkeypatch.setattr(m, "ONE_TASK", one_task)
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    edges += [(3000 + rnd.randrange(400), 3000 + rnd.randrange(400)) for _ in range(250)] + [(-5, -4), (-4, -5), (7, 7), (9000, 9000)]
    rnd.shuffle(edges)
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, seen = {}, set()
    for start in sorted(near):
        if start not in seen:
            todo = [start]
            seen.add(start)
            while todo:
                x = todo.pop()
                want[x] = start
                todo += near[x] - seen
                seen |= near[x]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long").repartition(5)
    got = m.components(df, Workspace(spark, "test"), "t").collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert m.components(df.limit(0), Workspace(spark, "test"), "none").count() == 0
