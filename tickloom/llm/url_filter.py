"""URL filter by the ratio of two smoothed variable-order Markov character models, in DataFrame functions only.

URLs that a rule decides are the examples: one model learns the accepted, one
the rejected.  A character's probability after its last ``ORDER`` mixes all
orders by Witten-Bell smoothing.  A URL's score is the mean difference of the
two log-likelihoods; the threshold lies midway between the score that a share
``FALSE_BLOCKS`` of the accepted examples fall under and the one that as many of
the rejected exceed.  Counts, thresholds and scores use every row.

Grams are counted into a table that grows with the input.  Equal URLs are
counted and scored once; a URL's grams meet the table of log ratios in a join.
Neither that table nor those of the contexts pass the driver, but small ones do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.workspace import Workspace

#: Longest context, and the share of either side's examples beyond the mark that calibrates the threshold.
ORDER, FALSE_BLOCKS = 5, 0.02
#: Grams whose ratios are broadcast, which the driver holds several times over; more are joined by shuffle.
BROADCAST_GRAMS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # verdict (allow or block), host, path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(size, rule, verdict) of the longest rule for the host or a domain over it whose path begins the url's path; else null."""
    found = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def grams(url: Column, host: Column) -> Column:
    """The run of ORDER + 1 characters that ends at each character, the start padded by NUL, as array<string>.

    The characters are the url's own, A-Z lower-cased up to the end of its host.
    """
    end = F.when(F.instr(url, "://") > 0, F.instr(url, "://") + 2 + F.length(host)).otherwise(0)
    text = F.concat(F.translate(F.substring(url, F.lit(1), end), _UPPER, _LOWER), F.substring(url, end + 1, F.length(url)))
    padded = F.concat(F.array_repeat(F.lit("\0"), ORDER), F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    return F.transform(F.array(padded), lambda s: F.transform(F.sequence(F.lit(1), F.size(s) - ORDER), lambda i: F.array_join(F.slice(s, i, ORDER + 1), "")))[0]


def log_ratios(counts: DataFrame, symbols: int) -> DataFrame:
    """Of (gram, yes, no), how often accepted and rejected examples hold it: (gram, ratio), log p(accepted) - log p(rejected).

    symbols is the size of the alphabet.  Without accepted or without rejected
    examples all ratios are 0.
    """
    table = None
    for order in range(ORDER + 1):
        seen = counts.groupBy(F.substring("gram", ORDER + 1 - order, order + 1).alias("gram")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        seen = seen.withColumn("context", F.substring("gram", 1, order)).withColumn("lower", F.substring("gram", 2, order))
        sums = [f(c).alias(f"{c}_{n}") for c in ("yes", "no") for n, f in (("all", F.sum), ("kinds", lambda c: F.count_if(F.col(c) > 0)))]
        # tables of long contexts grow with the input: a planner that broadcasts what is small when compressed would gather them at the driver
        apart = (lambda df: df.hint("merge")) if order > 1 else (lambda df: df)
        seen = seen.join(apart(seen.groupBy("context").agg(*sums)), "context")
        if table is None:
            seen = seen.withColumn("p_yes", F.lit(1.0 / symbols)).withColumn("p_no", F.lit(1.0 / symbols))
        else:
            seen = seen.join(apart(table.withColumnRenamed("gram", "lower")), "lower")
        mixed = lambda c: F.when(F.col(f"{c}_all") > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"p_{c}")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))).otherwise(F.col(f"p_{c}")).alias(f"p_{c}")
        table = seen.select("gram", mixed("yes"), mixed("no"))
    both = counts.agg((F.coalesce(F.sum("yes"), F.lit(0)) > 0) & (F.coalesce(F.sum("no"), F.lit(0)) > 0)).scalar()
    return table.select("gram", F.when(both, F.log("p_yes") - F.log("p_no")).otherwise(0.0).alias("ratio"))


def judge_urls(pages: DataFrame, rules: list[Rule], false_blocks: float = FALSE_BLOCKS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per row of pages.

    The longest fitting rule gives the verdict; elsewhere a score under the
    threshold blocks.  score is null for a null or empty url, which is allowed.
    Null ids and repeated rows are judged alike; other columns are not read.
    Without examples of both verdicts all scores are 0 and nothing is blocked
    but by rule.  Empty table: no rows.
    """
    ws = Workspace(pages.sparkSession, "url-filter")
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("accepted", F.col("fits.verdict") == "allow")
    urls = rows.where("url <> ''").groupBy("url", "host", "accepted").agg(F.count("*").alias("n"))
    urls = ws.write(urls.withColumn("u", F.monotonically_increasing_id()), "urls")
    each = urls.select("u", "n", "accepted", F.explode(grams(F.col("url"), F.col("host"))).alias("gram"))
    counts = each.groupBy("gram").agg(*(F.coalesce(F.sum(F.when(w, F.col("n"))), F.lit(0)).alias(c) for c, w in (("yes", F.col("accepted")), ("no", ~F.col("accepted")))))
    counts = ws.write(counts, "counts")
    symbols = 1 + counts.select(F.substring("gram", ORDER + 1, 1)).distinct().count()  # the pad is one
    ratios = ws.write(log_ratios(counts, symbols), "ratios")
    small = ratios.count() <= BROADCAST_GRAMS
    scores = each.select("u", "gram").join(F.broadcast(ratios) if small else ratios.hint("merge"), "gram").groupBy("u").agg(F.avg("ratio").alias("score"))
    scored = ws.write(rows.join(urls.join(scores, "u").select("url", "score"), "url", "left"), "scored")
    marks = scored.groupBy().agg(
        F.expr(f"percentile_approx(score, {false_blocks}, 10000) filter (where accepted)").alias("low"),
        F.expr(f"percentile_approx(score, {1 - false_blocks}, 10000) filter (where not accepted)").alias("high"),
    )
    threshold = marks.select((F.col("low") + F.col("high")) / 2).scalar()
    by_model = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce(F.col("fits.verdict"), by_model).alias("verdict"), "score")


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of the allowed rows."""
    return judge_urls(pages, rules, id_col=id_col, url_col=url_col).where("verdict = 'allow'")
