import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tickloom.llm import periodic_runs as module
from tickloom.llm.periodic_runs import periodic_runs, runs_of

SF = "/root/testdata/sf0.001"


def plain_runs(w, least=24, times=3):
    """By definition: for every period the maximal stretches, less those that a smaller period has too."""
    out = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            s, n = i, j + p - i
            if n >= max(least, times * p) and not any(all(w[k] == w[k + q] for k in range(s, s + n - q)) for q in range(1, p)):
                out.append((s, n, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text, planted=True):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    return runs, " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(n=400):
    rnd = random.Random(8)
    out = []
    for _ in range(n):
        w = []
        for _ in range(rnd.randint(0, 6)):
            base = [rnd.choice("abcde") for _ in range(rnd.choice((1, 2, 3, 5, 8, 13, 20)))]
            part = (base * 30)[: rnd.randint(0, 70)]
            if part and rnd.random() < 0.3:
                part[rnd.randrange(len(part))] = "x"
            w += part + [rnd.choice("abcde") for _ in range(rnd.randint(0, 9))]
        out.append(w)
    return out


@pytest.mark.parametrize("points, chunk", [(1 << 20, 64), (7, 1)])
def test_runs_of_nested_and_broken_periods(monkeypatch, points, chunk):
    monkeypatch.setattr(module, "POINTS", points)
    monkeypatch.setattr(module, "CHUNK", chunk)
    all_words = texts(400 if points > 7 else 60)
    heads = np.r_[0, np.cumsum([len(w) for w in all_words])]
    h = np.array([ord(x) for w in all_words for x in w], np.uint64)
    got = runs_of(h, heads)
    assert got == [(d, *r) for d, w in enumerate(all_words) for r in plain_runs(w)]
    assert any(r[3] > 8 for r in got) and any(r[3] == 1 for r in got)


def test_other_lengths():
    all_words = texts(150)
    heads = np.r_[0, np.cumsum([len(w) for w in all_words])]
    h = np.array([ord(x) for w in all_words for x in w], np.uint64)
    for least, times in ((1, 3), (10, 4), (60, 5)):
        assert runs_of(h, heads, least, times) == [(d, *r) for d, w in enumerate(all_words) for r in plain_runs(w, least, times)]


def test_rows(spark):
    long = " ".join(str(i % 70_000) for i in range(400_000))
    rows = [(1, "a b " * 20, "x"), (1, "a b " * 20, "x"), (None, "no id", "x"), (2, None, "x"), (3, "", "x"), (4, " \t\n", "x"), (5, "é́ " * 24 + "  z\x0b", "x"), (6, long, "x"), (7, "q " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect())
    want = [(str(i), *plain(i, t, planted=False)) for i, t, _ in rows if i not in (6, 7)]
    want += [("6", [(0, 400_000, 70_000)], " ".join(map(str, range(70_000)))), ("7", [(0, 30_000, 1)], "q")]
    assert got == sorted(want)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_query(spark):
    from tickloom.llm.queries import QUERIES

    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 12_000]
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert sum(r.n_runs > 0 for r in got.values()) >= 10
    for i, t in docs:
        runs, rest = plain(i, t)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if runs else None
        assert tuple(got[i]) == (i, len(runs), *best, milli, hexed("".join(f"{a},{b},{c}\n" for a, b, c in runs)), hexed(rest)), i
