"""The character models against a plain restatement of Witten-Bell smoothing."""

import math
import random
import re
from collections import Counter, defaultdict

from tickloom.llm.queries import URL_RULES
from tickloom.llm.url_filter import ORDER, judge_urls


def symbols(u):
    """The url's characters, A-Z lower-cased up to the end of its host, after the pad."""
    end = re.match("[^:]*://[^/?#]*", u).end()
    return ["\0"] * ORDER + [c.lower() if c.isascii() and i < end else c for i, c in enumerate(u)]


class Model:
    def __init__(self, urls, kinds):
        self.uniform = 1 / kinds
        self.n = [Counter() for _ in range(ORDER + 1)]
        self.all, self.kinds = ([defaultdict(int) for _ in range(ORDER + 1)] for _ in range(2))
        for u in urls:
            s = symbols(u)
            for i in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    self.n[k][tuple(s[i - k : i + 1])] += 1
        for k in range(ORDER + 1):
            for g, n in self.n[k].items():
                self.all[k][g[:-1]] += n
                self.kinds[k][g[:-1]] += 1

    def p(self, gram):
        out = self.uniform
        for k in range(ORDER + 1):
            g = gram[ORDER - k :]
            if self.all[k][g[:-1]]:
                out = (self.n[k][g] + self.kinds[k][g[:-1]] * out) / (self.all[k][g[:-1]] + self.kinds[k][g[:-1]])
        return out


def test_scores_and_threshold(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdeé-XY0") for _ in range(rnd.randint(1, 7)))
    urls = [f"http{rnd.choice(['', 's'])}://{word()}.{rnd.choice(['com', 'net', 'org'])}/{rnd.choice(['en', 'es', 'fr', word()])}/{word()}" for _ in range(300)]
    got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES).collect()
    rule = {r.page_id: r.rule for r in got}
    allow = [urls[i] for i in rule if rule[i] in ("com/", "www.example.com/en/")]
    block = [urls[i] for i in rule if rule[i] in ("example.com/en/", "net/es/", "net/fr/")]
    kinds = len({c for u in urls for c in symbols(u)})  # the pad is one
    yes, no = Model(allow, kinds), Model(block, kinds)
    assert len(allow) > 50 and len(block) > 20

    def score(u):
        s = symbols(u)
        grams = [tuple(s[i - ORDER : i + 1]) for i in range(ORDER, len(s))]
        return sum(math.log(yes.p(g)) - math.log(no.p(g)) for g in grams) / len(grams)

    scores = {r.page_id: score(urls[r.page_id]) for r in got}
    assert all(abs(r.score - scores[r.page_id]) < 1e-9 for r in got)
    low = sorted(scores[i] for i in rule if urls[i] in set(allow))
    high = sorted(scores[i] for i in rule if urls[i] in set(block))
    mark = lambda x, q: x[max(0, math.ceil(q * len(x)) - 1)]
    middle = (mark(low, 0.02) + mark(high, 0.98)) / 2
    for r in got:
        if r.rule is None:
            assert r.verdict == ("block" if scores[r.page_id] < middle else "allow")


def test_real_characters_and_long_contexts_decide(spark):
    pairs = [("2", "7"), ("?id=", "&id="), ("жук", "мяу"), ("abcd/x", "bbcd/y")]
    for good, bad in pairs:
        rows = [(i, f"http://a{'bcd'[i % 3]}.com/{good}") for i in range(30)] + [(100 + i, f"http://a{'bcd'[i % 3]}.net/es/{bad}") for i in range(30)]
        rows += [(200, f"http://ab.org/{good}"), (201, f"http://ab.org/{bad}"), (202, f"http://ab.org/{bad}"), (203, None)]
        got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
        assert len(got) == len(rows) and got[203].score is None
        assert got[200].score > got[201].score == got[202].score, (good, bad)


def test_contexts_of_five_characters_count(spark):
    rows = [(i, f"http://a.com/{w}") for i, w in enumerate(["kxyzt", "lxyzu"] * 20)] + [(100 + i, f"http://a.net/es/{w}") for i, w in enumerate(["kxyzu", "lxyzt"] * 20)]
    rows += [(200, "http://a.org/kxyzt"), (201, "http://a.org/kxyzu")]
    got = {r.page_id: r.score for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    assert got[200] > got[201] + 0.05


def test_tables_that_grow_do_not_pass_the_driver(spark, monkeypatch):
    """Tables of long contexts are merged, however small the planner thinks them; scores are the same by either join."""
    from pyspark.sql import functions as F

    from tickloom.llm import url_filter

    counts = spark.range(2000).select(F.lpad(F.conv(F.col("id"), 10, 6), 6, "a").alias("gram"), (F.col("id") % 3).alias("yes"), (F.col("id") % 2).alias("no"))
    plan = url_filter.log_ratios(counts, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 8
    rows = [(i, f"http://a{'bcd'[i % 3]}.com/{i}") for i in range(40)] + [(100 + i, f"http://a.net/es/{i}") for i in range(40)] + [(200, "http://x.org/7")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    score = lambda: {r.page_id: round(r.score, 9) for r in judge_urls(pages, URL_RULES).collect()}
    one = score()
    monkeypatch.setattr(url_filter, "BROADCAST_GRAMS", 0)
    assert score() == one and len(one) == 81
