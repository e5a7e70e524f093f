"""The registered queries of the ten operators: thin digests of what each operator returns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.decontaminate import contained_items
from tickloom.llm.embedding_dedup import near_vectors
from tickloom.llm.hard_negatives import hard_negatives
from tickloom.llm.html_text import extract
from tickloom.llm.jaccard_join import jaccard_classes
from tickloom.llm.language_id import fit_languages, identify
from tickloom.llm.packing import pack
from tickloom.llm.periodic_runs import periodic_runs
from tickloom.llm.piece_tokens import decode_pieces, encode_pieces
from tickloom.llm.substring_dedup import repeated_passages
from tickloom.llm.token_files import read_token_files, write_token_files
from tickloom.llm.toxicity import fit_labelled, toxicity
from tickloom.llm.url_filter import Rule, judge_urls
from tickloom.llm.workspace import Workspace

#: The rules that judge the urls of pages.
URL_RULES: list[Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity(docs, fit_labelled(docs, _table(spark, sf_dir, "labels")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    net, labels = fit_languages(docs.where(~held_out))
    out = identify(docs, net, labels)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark, 'token-files').root}/files"
    write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1, length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's SentencePiece ids, with the end id, and of the text they decode to; a null text is an empty one."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = decode_pieces(encode_pieces(_table(spark, sf_dir, "documents"), model), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's periodic runs (their number, the one of most periods, digests of all and of the text without repeats); planted in every tenth crc of the ids."""
    seed = F.crc32(F.col("doc_id").cast("string"))
    rows = periodic_runs(_table(spark, sf_dir, "documents"), least=24, times=3, repeat=F.when(seed % 10 == 0, seed))
    # The least element in this order: more periods, then the smaller start, then the smaller period.
    more = "a.length * b.period <=> b.length * a.period"
    ordered = f"array_sort(runs, (a, b) -> case when not ({more}) then if(a.length * b.period > b.length * a.period, -1, 1) when a.start <> b.start then if(a.start < b.start, -1, 1) else if(a.period < b.period, -1, if(a.period = b.period, 0, 1)) end)"
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.expr(f"get({ordered}, 0)").alias("best"), F.sha2(F.expr(listed), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, labels moved on by one for every seventh; unusable rows take no part."""
    rows = _table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null")
    finite = "not exists(embedding, x -> x is null or isnan(x) or abs(double(x)) = double('infinity'))"
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.where(finite).select("vec_id", label.alias("label"), F.expr("transform(embedding, x -> floor(256 * double(x)))").alias("embedding"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_token_files": op3_token_files,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_packing": op6_packing,
    "op7_html_text": op7_html_text,
    "op8_decontamination": op8_decontamination,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
 e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
 r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.reach) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY 1, 2""",
    "op8_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS sh FROM d WHERE len(w) >= 5),
 si AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS sh FROM i WHERE len(w) >= 5),
 n AS (SELECT item_id, count(*) AS n FROM si GROUP BY 1), p AS (SELECT doc_id, item_id, count(*) AS c FROM ds JOIN si USING (sh) GROUP BY 1, 2)
 SELECT doc_id, item_id, n AS item_shingles, c AS shared, c / n AS containment FROM p JOIN n USING (item_id) WHERE 100 * c >= 80 * n UNION ALL
 SELECT doc_id, item_id, 1, 1, 1.0 FROM d, i WHERE len(i.w) BETWEEN 1 AND 4 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ')""",
    "op9_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
 r AS (SELECT vec_id, vec_id AS reach FROM v UNION SELECT r.vec_id, l.y FROM r JOIN l ON r.reach = l.x),
 c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY 1), n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY 1)
 SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op13_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
 n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
 SELECT * FROM n WHERE rank <= 3""",
}
