import random

import numpy as np
import pyarrow as pa

from tickloom.llm.decontaminate import contained_items, drop_contaminated
from tickloom.llm.substring_dedup import SURE, _Run, chunk_ends, cut_passages, repeated_passages

VOCAB = [f"{a}{b}{c}" for a in ("ka", "to", "mir", "és", "ul") for b in ("ne", "so", "rat", "üb") for c in ("", "n", "den", "lo", "z")]


def prose(rnd, n):
    return " ".join(rnd.choice(VOCAB) + str(rnd.randrange(1000)) for _ in range(n))


def test_chunks_resist_shifts_and_cover_the_text():
    rnd = random.Random(0)
    t = prose(rnd, 2000).encode()
    cut = lambda b: chunk_ends(np.array([0, len(b)]), np.frombuffer(b, np.uint8))
    a, b = cut(t), cut(b"inserted words at the start " + t)
    assert a[-1] == len(t) and len(set(a + 28) - set(b)) <= 3
    assert 10 < np.diff(a).mean() < 30
    again = ("the same few words, " * 100).encode()
    shifted = b"unlike text before it " + again
    assert len(set(cut(again) + 22) & set(cut(shifted))) > 60  # text that repeats a phrase is cut in every round


def test_passages_are_found_and_cut(spark):
    rnd = random.Random(1)
    passages = [prose(rnd, 51) for _ in range(40)]
    rows, planted = [], set()
    for i in range(200):
        t = prose(rnd, rnd.randint(5, 200))
        if i % 2:
            k = rnd.randrange(len(passages))
            t = f"{t} {passages[k]} {prose(rnd, rnd.randint(0, 80))}"
            planted.add((i, k))
        rows.append((i, t, len(t)))
    rows += [(1000, None, None), (1001, "", 0), (1002, "ab" * 100000, 200000), (None, passages[0], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)
    got = repeated_passages(df).collect()
    text = {d: t for d, t, _ in rows}
    first = {}
    for i, k in sorted(planted):
        first.setdefault(k, i)
    late = {i for i, k in planted if first[k] != i} | {i for i, k in planted if k == 0}
    assert {r.doc_id for r in got} == late
    for r in got:
        assert text[r.doc_id][r.start : r.end] in text[r.first_doc_id] and r.n_words >= 30
    out = {r.doc_id: r for r in cut_passages(df).collect()}
    for i, t, n in rows:
        if i not in late:
            assert out[i].text == t and out[i].n_chars == n
        else:
            assert out[i].n_chars == len(out[i].text) < n
    assert repeated_passages(df.limit(0)).count() == 0


def test_runs_are_those_of_a_plain_restatement(spark):
    """Chunks as strings, owners by a dictionary of whole chunks: the same documents, spans and words."""
    rnd = random.Random(5)
    shared = [prose(rnd, rnd.choice([20, 45, 80, 200])) for _ in range(12)]
    texts = {}
    for i in range(90):
        parts = [prose(rnd, rnd.randint(0, 60)) for _ in range(3)]
        texts[i] = " ".join([parts[0], rnd.choice(shared), parts[1], rnd.choice(shared), parts[2]]) if i % 3 else " ".join(parts)
    texts[90] = "a " * 40000
    texts[91] = "x " + texts[90]
    texts[92] = "one phrase said again and again. " * 60
    texts[93] = "Before it: " + texts[92]
    first, chunks = {}, {}
    for d, t in texts.items():
        raw = t.encode()
        ends = chunk_ends(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8)).tolist()
        at = 0
        chunks[d] = []
        for e in ends:
            first.setdefault(raw[at:e], d)
            chunks[d].append((at, e, raw[at:e]))
            at = e
    want = set()
    for d, t in texts.items():
        raw, begin = t.encode(), None
        char = lambda k, raw=raw: len(raw[:k].decode())
        for at, e, c in [*chunks[d], (len(raw), len(raw), None)]:
            again = c is not None and first[c] != d
            if again and begin is None:
                begin = at
            if not again and begin is not None:
                heads = sum(1 for k in range(begin, at) if raw[k : k + 1].strip() and (k == 0 or not raw[k - 1 : k].strip()))
                if heads >= 30:
                    want.add((d, char(begin), char(at), heads))
                begin = None
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(5)
    got = {(r.doc_id, r.start, r.end, r.n_words) for r in repeated_passages(df).collect()}
    for d, a, b, n in got:  # inside a plain run, less short chunks that another document has by accident
        assert any(d == e and p <= a and b <= q and k - 12 <= n <= k for e, p, q, k in want)
    for e, p, q, k in want:
        assert k < 42 or any(d == e and p <= a and b <= q for d, a, b, _ in got)
    assert any(d == 93 for d, *_ in got) and max(n for *_, n in got) == 16384  # one whole chunk of the longest kind


def test_items_are_found_inside_documents(spark):
    rnd = random.Random(2)
    items = [(k, prose(rnd, rnd.choice([3, 5, 7, 20, 60]))) for k in range(40)] + [(90, None), (91, "")]
    docs = []
    for i in range(120):
        t = prose(rnd, rnd.randint(0, 400))
        if i % 3 == 0:
            w = items[i % 40][1].split()
            if i % 2 and len(w) > 30:
                w[rnd.randrange(len(w))] = "changed"
            t = f"{t} {' '.join(w).replace('k', 'K')} {prose(rnd, 30)}"
        docs.append((i, t, 1))
    docs += [(500, None, 1), (None, items[3][1], 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    it = spark.createDataFrame(items, "item_id long, text string")

    def grams(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    def short(q, t):  # the whole word sequence of an item of fewer words
        low = lambda x: " ".join("".join(c.lower() if c.isascii() else c for c in x or "").split())
        return low(q) and f" {low(q)} " in f" {low(t)} "

    want = sorted((str(d), k) for d, t, _ in docs for k, q in items if (len(grams(t) & grams(q)) >= 0.8 * len(grams(q)) if grams(q) else short(q, t)))
    got = sorted((str(r.doc_id), r.item_id) for r in contained_items(df, it).collect())
    assert got == want and len(want) > 20 and any(len(items[k][1].split()) == 3 for _, k in want)
    import tickloom.llm.decontaminate as m

    m.ITEM_BYTES, old = 500, m.ITEM_BYTES
    try:
        assert sorted((str(r.doc_id), r.item_id) for r in contained_items(df, it).collect()) == want
    finally:
        m.ITEM_BYTES = old
    kept = drop_contaminated(df, it)
    assert kept.columns == df.columns and {str(r.doc_id) for r in kept.collect()} == {str(d[0]) for d in docs} - {d for d, _ in want}
    assert drop_contaminated(df, it.limit(0)).count() == len(docs)


def test_rows_are_decided_by_row_where_ids_are_null_or_shared(spark):
    from tickloom.llm.jaccard_join import drop_copies

    rnd = random.Random(9)
    clean, shared, item = [prose(rnd, 120) for _ in range(4)], prose(rnd, 80), prose(rnd, 20)
    mine = [f"{prose(rnd, 60)} {shared}" for _ in range(2)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    texts = lambda out: sorted(r.text for r in out.collect())
    for i, j in ((None, None), (7, 7)):
        cut = texts(cut_passages(df([(i, clean[0]), (j, clean[1]), (i, mine[0]), (j, mine[1])])))
        assert {clean[0], clean[1]} < set(cut) and sum(t in cut for t in mine) == 1 and len(cut) == 4
        leak = f"{clean[0]} {item}"
        assert texts(drop_contaminated(df([(i, leak), (j, clean[1]), (i, clean[2])]), spark.createDataFrame([(1, item)], "item_id long, text string"))) == sorted(clean[1:3])
        assert texts(drop_copies(df([(i, clean[0]), (j, clean[0]), (i, clean[1]), (j, clean[2])]))) == sorted(clean[:3])
    assert texts(drop_copies(df([(1, clean[0]), (7, clean[0]), (7, clean[1])]))) == sorted(clean[:2])


def test_ends_of_runs_of_any_number_of_short_chunks():
    """Against all chunks in a list: short ones at either end go as far as they are another owner's."""
    rnd = random.Random(4)
    for n in [*range(1, 60), 5000, 5001]:
        chunks = [(rnd.randint(3, 30), rnd.choice([1, 2, 3] if rnd.random() < 0.9 or n >= 5000 else [SURE, 6]), rnd.randrange(4)) for _ in range(n)]
        if n == 5001:
            chunks[2500] = 31, SURE, 2
            chunks[:1800] = [(5, 1, 3)] * 1800
        run = _Run(9, 100)
        for chunk in chunks:
            run.add(*chunk)
        owner = max(chunks, key=lambda c: c[0])[2]
        sure = [i for i, c in enumerate(chunks) if c[1] >= SURE]
        i, j = 0, n
        if sure:
            while i < sure[0] and chunks[i][2] != owner:
                i += 1
            while j > sure[-1] + 1 and chunks[j - 1][2] != owner:
                j -= 1
        place = lambda k: 100 + sum(c[0] for c in chunks[:k])
        assert run.passage() == (9, place(i), place(j), sum(c[1] for c in chunks[i:j]), owner)


def test_a_long_text_is_hashed_in_segments_as_a_whole(monkeypatch):
    from tickloom.llm import language_id, substring_dedup, text, toxicity

    rnd = random.Random(4)
    word = [("".join(rnd.choice("abcdefé中h") for _ in range(rnd.randint(1, 9)))) for _ in range(300)]
    column = pa.array(["short one", None, " ".join(rnd.choice(word) for _ in range(9000)), "", "la " * 9000, "x" * 30000, "kurz"])
    net = language_id.BiGRU(3)

    def all_of():
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(column))), column], names=["doc_id", "text"])
        return (
            [(row, h.tolist()) for f in (lambda c: text.shingles(c, 4), toxicity.features) for row, h in f(column)],
            [x.to_pydict() for x in substring_dedup._chunks(iter([batch]))],
            language_id.document_probabilities(net, column).tolist(),
        )

    monkeypatch.setattr(text, "HASH_BYTES", 1 << 30)
    monkeypatch.setattr(substring_dedup, "SEGMENT", 1 << 30)
    monkeypatch.setattr(language_id, "BATCH", 1 << 20)
    whole = all_of()
    monkeypatch.setattr(text, "HASH_BYTES", 700)
    monkeypatch.setattr(substring_dedup, "SEGMENT", 1500)
    monkeypatch.setattr(language_id, "BATCH", 4)
    parts = all_of()
    assert parts[:2] == whole[:2]
    assert np.allclose(parts[2], whole[2], rtol=0, atol=1e-6)  # the network counts in single precision
