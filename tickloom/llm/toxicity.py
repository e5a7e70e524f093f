"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector w for all thresholds
t_0 <= t_1 <= ...; the expected severity is the sum of these probabilities.
Features are the words of a text and their first four and five bytes, present
or absent, known by 64-bit hash.  Weights are not negative and their sum is
penalised, so features that do not mark toxic texts have none, whatever the number
of labelled rows; neither a long clean text nor an empty one gathers noise.

The classifier is fitted on a bounded sample of labelled rows (``FIT_ROWS`` of
toxic and ``CLEAN`` times as many clean ones); every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import _LOWER, block_hashes, signed, slices
from tickloom.llm.workspace import bound_batches

#: Toxic labelled rows to fit on, clean ones for each of them, and severity from which a document is toxic.
FIT_ROWS, CLEAN, TOXIC = 2500, 3, 0.3
#: Distinct markers that make a toxic text of grade 2 and 3 where labels only say toxic or not.
GRADES = (7, 13)
#: Penalty of each weight beside the summed loss of all rows, and the least threshold: a text without a known feature is clean.
PENALTY, FLOOR = 0.1, 3.0
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MASK = (1 << 20) - 1


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, feature hashes in text order, repeats included)."""
    for row, offsets, raw in slices(column):
        if not len(raw):
            yield from ((row + i, np.zeros(0, np.uint64)) for i in range(len(offsets) - 1))
            continue
        inside = _LETTER[raw]
        raw = _LOWER[raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(raw))]
        first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        h = np.empty((len(a), 3), np.uint64)
        h[:, 0] = block_hashes(raw, a, b)
        for i, k in enumerate((4, 5), 1):
            h[:, i] = block_hashes(raw, a, np.minimum(a + k, b)) ^ np.uint64(k)
        heads = np.searchsorted(a, offsets)
        for i in range(len(offsets) - 1):
            yield row + i, h[heads[i] : heads[i + 1]].ravel()


class Ordinal:
    """Shared weights of known features and ascending thresholds."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.weights, self.thresholds = keys[order], weights[order], thresholds
        self.mask = np.zeros(_MASK + 1, bool)
        self.mask[(self.keys & np.uint64(_MASK)).astype(np.int64)] = True

    def over(self, h: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold of a text with features h."""
        total = 0.0
        if len(self.keys):
            h = np.unique(h[self.mask[(h & np.uint64(_MASK)).astype(np.int64)]])
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            total = self.weights[at[self.keys[at] == h]].sum()
        return 1 / (1 + np.exp(-np.clip(total - self.thresholds, -40, 40)))


def _hits(rows: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key index) of every known feature of the rows."""
    out_row, out_col = [], []
    for i, r in enumerate(rows):
        at = np.minimum(np.searchsorted(keys, r), len(keys) - 1)
        at = at[keys[at] == r].astype(np.int32)
        out_row.append(np.full(len(at), i, np.int32))
        out_col.append(at)
    none = [np.zeros(0, np.int32)]
    return np.concatenate(out_row or none), np.concatenate(out_col or none)


def fit(rows: list[np.ndarray], grades: np.ndarray, keys: np.ndarray | None = None, penalty: float = PENALTY, steps: int = 300) -> Ordinal:
    """The model of least cumulative-link loss and penalty over rows of distinct feature hashes.

    Proximal gradient steps over keys, or else over every feature of a row of grade 1 or more: no other can have a
    weight, as weights are not negative.  Features whose weight is 0 after some rounds are left.
    """
    top = int(grades.max()) if len(grades) else 0
    if keys is None:
        keys = np.unique(np.concatenate([r for r, y in zip(rows, grades) if y > 0])) if top else np.zeros(0, np.uint64)
    if not len(keys):
        return Ordinal(keys, np.zeros(0), np.full(max(top, 1), 40.0))
    row, col = _hits(rows, keys)
    over = grades[:, None] > np.arange(top)
    w, t = np.zeros(len(keys)), np.maximum.accumulate(np.maximum(np.log((~over).sum(0) + 0.5) - np.log(over.sum(0) + 0.5), FLOOR))
    steps_w, steps_t = np.full(len(w), 1e-12), np.full(top, 1e-12)
    for step in range(steps):
        x = np.bincount(row, w[col], len(rows))
        g = 1 / (1 + np.exp(-np.clip(x[:, None] - t, -40, 40))) - over
        gw, gt = np.bincount(col, g.sum(1)[row], len(w)), -g.sum(0)
        steps_w += gw**2
        steps_t += gt**2
        w = np.maximum(w - 0.5 * (gw + penalty) / np.sqrt(steps_w), 0)
        t = np.maximum.accumulate(np.maximum(t - 0.5 * gt / np.sqrt(steps_t), FLOOR))
        if step in (20, 60, 150, steps - 1):
            live = w > 0
            some = live[col]
            row, col = row[some], (np.cumsum(live) - 1)[col[some]]
            keys, w, steps_w = keys[live], w[live], steps_w[live]
    return Ordinal(keys, w, t)


def fit_binary(rows: list[np.ndarray], toxic: np.ndarray, steps: tuple[int, ...] = GRADES) -> Ordinal:
    """A model where labels only say toxic or not: toxic rows are of grade 1 and one more for each step that the
    number of the row's features with a weight in a fit of the labels reaches; these features are then fitted to the grades."""
    toxic = (toxic > 0).astype(np.int64)
    first = fit(rows, toxic)
    n = np.bincount(_hits(rows, first.keys)[0], minlength=len(rows)) if len(first.keys) else np.zeros(len(rows), np.int64)
    return fit(rows, toxic + toxic * sum((n >= s).astype(np.int64) for s in steps), first.keys)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(h).tobytes() for _, h in features(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["grade", "features"])


def fit_labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Ordinal:
    """A model from at most fit_rows rows labelled over 0 and CLEAN times as many labelled 0.

    Labels of more than two values are the grades; labels 0 and 1 are graded by
    fit_binary().  Rows with a null label, id or text are not used.  Without a toxic
    row the model finds nothing toxic.
    """
    bound_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("grade")).where("_id is not null and grade >= 0")
    sides = [known.where(c).orderBy(F.xxhash64("_id"), "_id").limit(n) for c, n in (("grade > 0", fit_rows), ("grade = 0", CLEAN * fit_rows))]  # of a stated size
    known = F.broadcast(sides[0].union(sides[1]))
    text = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    got = text.join(known, "_id").select("grade", "_text").mapInArrow(_gather, "grade int, features binary").toArrow()
    rows = [np.frombuffer(x.as_py(), np.uint64) for x in got["features"]]
    grades = np.array(got["grade"].to_pylist(), np.int64)
    return fit_binary(rows, grades) if len(grades) and grades.max() == 1 else fit(rows, grades)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over = np.zeros((batch.num_rows, len(model.value.thresholds)))
            for row, h in features(batch.column(1)):
                over[row] = model.value.over(h)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(over.sum(1)), pa.array((over >= 0.5).sum(1), pa.int32()), pa.array(over[:, 0])], names=["doc_id", "severity", "grade", "p_toxic"])

    return run


def toxicity(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) of every row: expected and likeliest grade, P(grade > 0), and severity >= TOXIC.

    Null or empty text has no features and counts as clean.  Null and repeated
    ids: every row is returned.  Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(sent), "doc_id long, severity double, grade int, p_toxic double").withColumn("toxic", F.col("severity") >= TOXIC)


def _keep(model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [row for row, h in features(batch.column(text_at)) if model.value.over(h).sum() < TOXIC]
            yield batch.take(pa.array(keep, pa.int64()))

    return run


def drop_toxic(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """docs without the toxic rows; columns and texts as they were, texts that are null or empty stay."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(sent, docs.columns.index(text_col)), docs.schema)
