import random
import zlib

import numpy as np
import pytest

from tickloom.llm.embedding_dedup import near_vectors
from tickloom.llm.html_text import extract, main_text
from tickloom.llm.language_id import BiGRU, document_probabilities, fit_languages, identify
from tickloom.llm.queries import URL_RULES
from tickloom.llm.toxicity import FLOOR, PENALTY, TOXIC, drop_toxic, features, fit, fit_binary, fit_labelled, toxicity
from tickloom.llm.url_filter import filter_urls, judge_urls


def test_gradients_of_the_network_agree_with_differences():
    rng = np.random.default_rng(0)
    net = BiGRU(3, hidden=3, seed=1)
    x, y = rng.integers(0, 20, (5, 4)), np.array([0, 2, 1, 0])
    _, g = net.gradients(x, y)
    for name, at in (("uf", (1, 4)), ("xb", (int(x[2, 1]), 7)), ("v", (2, 1)), ("xf", (int(x[0, 0]), 0)), ("ub", (0, 8))):
        w = net.w[name]
        old, d = w[at], 1e-2
        w[at] = old + d
        up = net.gradients(x, y)[0]
        w[at] = old - d
        down = net.gradients(x, y)[0]
        w[at] = old
        assert abs((up - down) / (2 * d) - g[name][at]) < 2e-3 + 0.05 * abs(g[name][at]), name


LANGS = {"aa": "ka lo mi ta ro ne".split(), "bb": "über schön groß tür haß".split(), "cc": "xi xu zhe qing wang".split()}


def test_languages_are_told_apart(spark):
    rnd = random.Random(0)
    rows = []
    for i in range(240):
        lang = rnd.choice(list(LANGS))
        rows.append((i, " ".join(rnd.choice(LANGS[lang]) for _ in range(rnd.choice([3, 30, 400]))), lang if i % 7 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    net, labels = fit_languages(df.where(~df.doc_id.isin(held)), steps=120)
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "123 ... 456"), (None, "ka lo mi ta ro"), (903, "ka lo " * 40000)], "doc_id long, text string")
    out = {r.doc_id: r for r in identify(df.select("doc_id", "text").union(odd), net, labels).collect()}
    truth = {i: next(k for k, v in LANGS.items() if t.split()[0] in v) for i, t, _ in rows}
    assert np.mean([out[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902))
    assert out[None].lang_pred == "aa" and out[903].lang_pred == "aa" and all(0 <= r.score <= 1 for r in out.values())
    assert fit_languages(df.limit(0)) == (None, [])
    assert {r.lang_pred for r in identify(df, None, []).collect()} == {"und"}
    import pyarrow as pa

    whole = document_probabilities(net, pa.array(["ka lo " * 100, None], pa.string()))
    assert abs(whole[0].sum() - 1) < 1e-4 and not whole[1].any()


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(3)
    clean, bad = [f"word{i}" for i in range(500)], ["vile", "scumbag", "rottenego", "rottenala", "rottenmi"]
    rows, labels = [], []
    for i in range(900):
        w = [rnd.choice(clean) for _ in range(rnd.choice([5, 60, 400]))]
        toxic = rnd.random() < 0.3
        if toxic:
            for _ in range(rnd.randint(2, 9)):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad).capitalize() + rnd.choice(["", ",", "."]))
        rows.append((i, " ".join(w), int(toxic)))
        if i % 2:
            labels.append((i, int(toxic), 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = fit_labelled(df, spark.createDataFrame([*labels, (None, 1, 0), (5, None, 1)], "doc_id long, toxic int, quality int"))
    assert len(model.thresholds) >= 2 and (np.diff(model.thresholds) >= 0).all()
    odd = spark.createDataFrame([(2000, None, 0), (2001, "", 0), (None, "vile scumbag vile rottenxy", 0), (2002, "é " * 50000, 0)], df.schema)
    got = {r.doc_id: r for r in toxicity(df.union(odd), model).collect()}
    held = [(i, y) for i, _, y in rows if not i % 2]
    assert np.mean([got[i].toxic == bool(y) for i, y in held]) > 0.98
    assert not got[2000].toxic and not got[2001].toxic and not got[2002].toxic and got[None].toxic
    kept = drop_toxic(df.union(odd), model)
    assert kept.schema == df.schema and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}
    none = fit_labelled(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not toxicity(df, none).where("toxic").count()


@pytest.mark.parametrize("n", [1, 3, 7])
def test_toxicity_of_few_labels(spark, n):
    rnd = random.Random(n)
    text = lambda *more: " ".join([*(rnd.choice("abcdefgh") * 3 + str(rnd.randrange(9)) for _ in range(80)), *more])
    rows = [(i, text("vile", "scum", "rotten") if i < 2 * n else text()) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < n)) for i in [*range(n), *range(2 * n, 100)]], "doc_id long, toxic int")
    assert {r.doc_id for r in toxicity(df, fit_labelled(df, labels)).where("toxic").collect()} == set(range(2 * n))


@pytest.mark.parametrize("sf, recall, rejected", [("sf0.001", 0.25, 0.03), ("sf0.01", 0.6, 0.02), ("sf0.1", 0.82, 0.01)])
def test_toxicity_held_out_on_given_tables(sf, recall, rejected):
    """Half the labels in turn, over all labelled documents, in three splits."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    toxic = dict(zip(*(pq.read_table(f"/root/testdata/{sf}/labels.parquet")[c].to_pylist() for c in ("doc_id", "toxic"))))
    docs = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    docs = [r for r in docs if toxic.get(r["doc_id"]) is not None]
    rows = [np.unique(h) for _, h in features(pa.array([r["text"] for r in docs], pa.string()))]
    y = np.array([toxic[r["doc_id"]] > 0 for r in docs])
    seen = np.zeros((3, len(y)), bool)
    for split in range(3):
        at = np.random.default_rng(5 + split).permutation(len(y))
        for half in (0, 1):
            model = fit_binary([rows[i] for i in at[half::2]], y[at[half::2]])
            seen[split, at[1 - half :: 2]] = [model.over(rows[i]).sum() >= TOXIC for i in at[1 - half :: 2]]
    assert seen[:, y].mean() >= recall and seen[:, ~y].mean() <= rejected
    model = fit_binary(rows, y)
    caught = np.array([model.over(r).sum() >= TOXIC for r in rows])
    assert caught[y].mean() > 0.98 and not caught[~y].any()


def test_toxicity_fit_has_the_least_loss():
    """A plain cumulative-link loss with its penalty grows where a weight or threshold of the fit is moved."""
    rng = np.random.default_rng(1)
    grades = rng.choice([0, 1, 2], 300, p=[0.6, 0.3, 0.1])
    rows = [np.flatnonzero(rng.random(12) < np.r_[np.full(6, 0.2 + 0.3 * g), np.full(6, 0.4)]).astype(np.uint64) for g in grades]
    model = fit(rows, grades, steps=5000)

    def loss(w, t):
        total = PENALTY * w.sum()
        for r, g in zip(rows, grades):
            x = sum(w[list(model.keys).index(k)] for k in r if k in model.keys)
            for k in range(2):
                p = 1 / (1 + np.exp(t[k] - x))
                total -= np.log(p if g > k else 1 - p)
        return total

    least = loss(model.weights, model.thresholds)
    assert (model.weights > 0).all() and (np.diff(model.thresholds) >= 0).all() and model.thresholds[0] >= FLOOR
    for i in range(len(model.keys)):
        for by in (-0.3, 0.3):
            w = model.weights.copy()
            w[i] = max(w[i] + by, 0)
            assert loss(w, model.thresholds) >= least - 1e-2
    assert loss(model.weights, np.maximum(model.thresholds - 0.3, FLOOR)) >= least - 1e-2 and loss(model.weights, model.thresholds + 0.3) >= least - 1e-2


def test_ordinal_grades_are_ordered():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(600):
        k = i % 4
        rows.append(np.unique(np.concatenate((rng.integers(100, 200, 10), rng.choice(10, 2 * k, replace=False)))).astype(np.uint64))
        y.append(k)
    m = fit(rows, np.array(y))
    severity = np.array([m.over(r).sum() for r in rows])
    means = [severity[np.array(y) == k].mean() for k in range(4)]
    assert all(b - a > 0.5 for a, b in zip(means, means[1:]))


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="post"><header><h1>Site name here</h1></header>
<nav><ul><li><a href=/a>one</a><li><a href=/b>two</a></ul></nav><div class="cookie-notice">We use cookies &amp; more text than one would want to read here</div>
<article><header class="entry-header"><h1>The  title</h1></header><p>First <b>bold</b> para&shy;graph &amp; more<br>text &lt;tag&gt;<p>Short.<p>A <a href=x>link</a> in text.
<script>var a = "</p><p>no</p>";</script><div class="ad">Buy this now, it is a long advert text with many words in it</div><p>Last one</p>
<section id="comments"><h2>Comments</h2><p>I am a reader and write a long comment about the article</p></section></article>
<aside><p>Sidebar text of some length that should not be in it at all</p></aside><form><label>Search</label><input></form><footer>&copy; footer text that is long enough</footer></body></html>"""


def test_main_text_of_a_page(spark):
    want = "The title\nFirst bold para\xadgraph & more text <tag>\nShort.\nA link in text.\nLast one"
    assert main_text(PAGE) == want
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p" * 5000), (4, "x", "plain words without any markup at all"), (5, "y", "<div><!-- open"), (6, "z", "<a href='" * 3000)]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == want and got[1].n_chars == len(want) and got[2].text == "" and got[None].url == "v"
    assert got[4].text == "plain words without any markup at all" and got[5].n_chars == 0


@pytest.mark.parametrize(("fit_rows", "product"), [(20_000, 1 << 20), (0, 64)])  # fitted on the driver, and on the executors in narrow strips
def test_vectors_match_brute_force(spark, monkeypatch, fit_rows, product):
    import tickloom.llm.embedding_dedup as m

    monkeypatch.setattr(m, "FIT_ROWS", fit_rows)
    monkeypatch.setattr(m, "PRODUCT", product)
    monkeypatch.setattr(m, "CELL", 64)
    monkeypatch.setattr(m, "BLOCK", 40)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((300, 16))
    x = np.concatenate([base, base[:80] + 0.06 * rng.standard_normal((80, 16)), base[:60] + 0.08 * rng.standard_normal((60, 16)), base[:20], np.repeat(base[:1], 70, 0) + 0.02 * rng.standard_normal((70, 16))])
    rows = [(int(i), [float(np.float32(v)) for v in r], 1) for i, r in enumerate(x)]
    odd = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, [1.0] * 15 + [None], 1), (9004, [], 1), (9005, [1.0, 2.0], 1), (9006, [2.0, 4.0], 1), (9007, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, node int")
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    link = v @ v.T >= 0.95
    np.fill_diagonal(link, False)
    comp = np.arange(len(v))
    while True:
        new = np.array([min(comp[i], comp[link[i]].min() if link[i].any() else comp[i]) for i in range(len(v))])
        if (new == comp).all():
            break
        comp = new
    for i in range(len(v)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), comp[i], comp[i] == i), i
    for k in (9000, 9001, 9002, 9003, 9004, 9007):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert got[9006].component_id == 9005 and got[9005].n_links == 1
    assert near_vectors(df.limit(0)).count() == 0


def test_names_of_page_wrappers_do_not_empty_the_article():
    para = "This is a long enough paragraph of an article which has many words and not a single link in it at all"
    for attrs in ("class='layout has-sidebar'", "class='post comments-open'", "class='with-related'", "class='no-menu'", "id='search-results-page'", "class='related wide'", "id=comment-view"):
        assert main_text(f"<body><div {attrs}><p>{para}<p>{para}</div>") == f"{para}\n{para}", attrs
    for inner in ("article", "main", "h1"):
        page = f"<body><div class='sidebar left'><p>{para}<{inner}>The title</{inner}><p>{para}<div class=ad>{para}</div></div><p>Outer {para}"
        assert main_text(page) == f"{para}\nThe title\n{para}\nOuter {para}", inner
    kept = f"<article><h1>The title</h1><p>{para}</article>"
    for tail in (f"<div id=comments><article class=comment>{para}</article></div>", f"<div class=related><article>{para}</article></div>", f"<div class=newsletter>{para}</div>"):
        assert main_text(f"<body>{kept}{tail}") == f"The title\n{para}", tail


def links_and_components(v, threshold=0.95):
    """Brute force: link counts and least linked index of each unit vector."""
    links, label = np.zeros(len(v), int), np.arange(len(v))
    while True:
        new, jumped = label.copy(), label[label]
        for at in range(0, len(v), 2000):
            near = v[at : at + 2000] @ v.T >= threshold
            links[at : at + 2000] = near.sum(1) - 1
            for i, row in enumerate(near, at):
                if links[i]:
                    new[i] = min(jumped[i], label[row].min())
        if (new == label).all():
            return links, label
        label = new


def dense_table(n, width, noise, seed):
    """Vectors a third of which are distinct near copies of one."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width))
    x[: n // 3] = x[0] + noise * rng.standard_normal((n // 3, width))
    return x[rng.permutation(n)].astype(np.float32)


def check_against_brute_force(spark, x, path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": rows}), path, row_group_size=4000)
    got = near_vectors(spark.read.parquet(path)).toPandas().sort_values("vec_id")
    v = x.astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links, label = links_and_components(v)
    assert links.sum() > len(x) ** 2 / 40
    assert got.n_links.sum() / links.sum() == 1.0
    assert (got.n_links.to_numpy() == links).all() and (got.component_id.to_numpy() == label).all()


def test_all_links_of_a_dense_group_in_many_cells(spark, monkeypatch, tmp_path):
    import tickloom.llm.embedding_dedup as m

    monkeypatch.setattr(m, "CELL", 64)
    monkeypatch.setattr(m, "BLOCK", 48)
    monkeypatch.setattr(m, "SLICE", 500, raising=False)
    check_against_brute_force(spark, dense_table(4000, 64, 0.21, 5), f"{tmp_path}/v.parquet")


def test_all_links_of_a_dense_group_in_a_large_table(spark, tmp_path):
    check_against_brute_force(spark, dense_table(51_000, 64, 0.19, 6), f"{tmp_path}/v.parquet")


def test_urls(spark):
    rows = [
        (1, "https://Shop.EXAMPLE.com/en/x?q=1"), (2, "http://www.example.com/en/"), (3, "http://a.net/es/p#t"), (4, "http://net/fr/"), (5, "ftp://x.com"), (6, "http://x.com/"),
        (7, None), (8, "no scheme"), (9, "http://notexample.com/en/"), (10, "http://mynet/es/"), (11, ""), (None, "http://b.net/fr/z"), (12, "http://é.org/😀"),
    ]
    rows += [(100 + i, f"http://good{i}.com/story/{i}") for i in range(60)] + [(200 + i, f"http://spam-casino{i}.net/es/{i}") for i in range(60)]
    rows += [(300, "http://spam-casino.org/es/7"), (301, "http://good.org/story/5")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in judge_urls(df, URL_RULES).collect()}
    want = {1: ("shop.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 3: ("a.net", "/es/p", "net/es/", "block"), 4: ("net", "/fr/", "net/fr/", "block"), 6: ("x.com", "/", "com/", "allow"), 9: ("notexample.com", "/en/", "com/", "allow"), None: ("b.net", "/fr/z", "net/fr/", "block")}
    for k, v in want.items():
        assert tuple(got[k])[1:5] == v, k
    assert tuple(got[5])[1:4] == ("x.com", "", None) and got[10].rule is None and got[10].host == "mynet"
    assert tuple(got[7])[1:5] == ("", "", None, "allow") and tuple(got[8])[1:4] == ("", "", None) and got[11].verdict == "allow"
    assert got[300].verdict == "block" and got[301].verdict == "allow"
    assert len(got) == len(rows) and filter_urls(df, URL_RULES).where("verdict = 'block'").count() == 0
    assert judge_urls(df.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in judge_urls(df, []).collect()} == {"allow"}
