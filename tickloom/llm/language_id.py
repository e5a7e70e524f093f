"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` bytes in both directions and gives every
byte position a distribution over the languages; a document's probabilities are
the mean over all its positions, every window counted.  It is trained here in
numpy by backpropagation through time, with Adam, on windows drawn from a
bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import buffers
from tickloom.llm.workspace import bound_batches

#: Bytes of a window, hidden units of a direction, windows scored at a time.
WINDOW, HIDDEN, BATCH = 96, 8, 2048
#: Labelled documents to learn from, windows drawn from each, bytes of a training window, steps, windows of a step.
FIT_ROWS, DRAWS, TRAIN_WINDOW, STEPS, TRAIN_BATCH = 4000, 8, 48, 700, 192
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGRU:
    """Weights: for each direction input rows (256, 3H), recurrent (H, 3H); output (2H, L) and bias."""

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        f = np.float32
        self.h = hidden
        self.w: dict[str, np.ndarray] = {"v": (rng.standard_normal((2 * hidden, n_labels)) * 0.3).astype(f), "c": np.zeros(n_labels, f)}
        for d in ("f", "b"):
            self.w["x" + d] = (rng.standard_normal((257, 3 * hidden)) * 0.3).astype(f)  # row 256: padding
            self.w["u" + d] = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f)

    def states(self, d: str, bytes_: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, B, H) of one direction over bytes (T, B), in reading order of the text."""
        w, u, n = self.w["x" + d], self.w["u" + d], self.h
        t, b = bytes_.shape
        out, h = np.empty((t, b, n), np.float32), np.zeros((b, n), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            x = w[bytes_[k]]
            g = _sigmoid(x[:, : 2 * n] + h @ u[:, : 2 * n])
            z, r = g[:, :n], g[:, n:]
            a = np.tanh(x[:, 2 * n :] + (r * h) @ u[:, 2 * n :])
            if keep is not None:
                keep.append((k, h, z, r, a))
            h = h + z * (a - h)
            out[k] = h
        return out

    def positions(self, bytes_: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, L) of every position."""
        s = np.concatenate((self.states("f", bytes_), self.states("b", bytes_)), axis=2)
        y = s @ self.w["v"] + self.w["c"]
        y = np.exp(y - y.max(axis=2, keepdims=True))
        return y / y.sum(axis=2, keepdims=True)

    def gradients(self, bytes_: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions and its gradients, by backpropagation through time."""
        n, (t, b) = self.h, bytes_.shape
        kept: dict[str, list] = {"f": [], "b": []}
        s = np.concatenate([self.states(d, bytes_, kept[d]) for d in ("f", "b")], axis=2)
        y = s @ self.w["v"] + self.w["c"]
        y = np.exp(y - y.max(axis=2, keepdims=True))
        p = y / y.sum(axis=2, keepdims=True)
        loss = float(-np.log(p[:, np.arange(b), labels] + 1e-9).mean())
        p[:, np.arange(b), labels] -= 1
        p /= t * b
        g = {"v": np.einsum("tbh,tbl->hl", s, p), "c": p.sum((0, 1))}
        ds = p @ self.w["v"].T
        for d, part in (("f", ds[:, :, :n]), ("b", ds[:, :, n:])):
            u, dx, du = self.w["u" + d], np.zeros_like(self.w["x" + d]), np.zeros_like(self.w["u" + d])
            dh = np.zeros((b, n), np.float32)
            for k, h, z, r, a in reversed(kept[d]):
                dh = dh + part[k]
                da = dh * z * (1 - a * a)
                dz = dh * (a - h) * z * (1 - z)
                back = da @ u[:, 2 * n :].T
                dr = back * h * r * (1 - r)
                dg = np.concatenate((dz, dr), axis=1)
                du[:, 2 * n :] += (r * h).T @ da
                du[:, : 2 * n] += h.T @ dg
                np.add.at(dx, bytes_[k], np.concatenate((dg, da), axis=1))
                dh = dh * (1 - z) + back * r + dg @ u[:, : 2 * n].T
            g["x" + d], g["u" + d] = dx, du
        return loss, g


def train(windows: np.ndarray, labels: np.ndarray, n_labels: int, steps: int = STEPS, batch: int = TRAIN_BATCH, seed: int = 0) -> BiGRU:
    """A network fitted to windows (N, T) of bytes and their labels; every label is drawn equally often."""
    net, rng = BiGRU(n_labels, seed=seed), np.random.default_rng(seed + 1)
    rows = [np.flatnonzero(labels == k) for k in range(n_labels)]
    rows = [r for r in rows if len(r)]
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(r, -(-batch // len(rows))) for r in rows])
        _, g = net.gradients(windows[pick].T, labels[pick])
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = 0.02 * min(1.0, 3 * (1 - step / (steps + 1))) / (1 if size < 1 else size)
        for k, v in g.items():
            m1[k] += 0.1 * (v - m1[k])
            m2[k] += 0.01 * (v * v - m2[k])
            net.w[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return net


def cut_windows(offsets: np.ndarray, raw: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows (N, size) that cover every text, padded with 256, and the row of each."""
    lengths = np.diff(offsets)
    count = -(-lengths // size)
    row = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + k * size
    at = start[:, None] + np.arange(size)
    inside = at < offsets[row + 1][:, None]
    return np.where(inside, raw.astype(np.int16)[np.minimum(at, max(len(raw) - 1, 0))], np.int16(256)), row


def document_probabilities(net: BiGRU, column: pa.Array) -> np.ndarray:
    """(rows, labels): means over all byte positions of a string column; zeros where there are none."""
    offsets, raw = buffers(column)
    n, out = len(offsets) - 1, np.zeros((len(offsets) - 1, len(net.w["c"])))
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + BATCH * WINDOW, "right")) - 1
        j = min(max(j, i + 1), n)
        for a in range(offsets[i], offsets[j], 2 * BATCH * WINDOW):  # several only in one text that is longer
            b = min(a + 2 * BATCH * WINDOW, offsets[j])
            windows, row = cut_windows(np.clip(offsets[i : j + 1], a, b) - a, raw[a:b])
            for k in range(0, len(windows), 2 * BATCH):
                w = windows[k : k + 2 * BATCH].T
                p = net.positions(w)
                p[w == 256] = 0
                np.add.at(out, i + row[k : k + 2 * BATCH], p.sum(0))
        i = j
    size = np.maximum(np.diff(offsets), 1)
    return out / size[:, None]


def _draw(draws: int, size: int):
    """(lang, doc_id, text) to (lang, window): windows at random places of whole texts, the same in every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, windows = [], []
            for lang, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                rng = np.random.default_rng([abs(doc or 0), len(raw)])
                for at in rng.integers(0, max(len(raw) - size, 0) + 1, draws).tolist():
                    part = np.full(size, 256, np.int16)
                    cut = np.frombuffer(raw, np.uint8)[at : at + size]
                    part[: len(cut)] = cut
                    langs.append(lang)
                    windows.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], names=["lang", "window"])

    return run


def fit_languages(docs: DataFrame, fit_rows: int = FIT_ROWS, steps: int = STEPS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[BiGRU | None, list[str]]:
    """A network and its languages, from at most fit_rows rows of docs with a text and a language; None without any."""
    bound_batches(docs.sparkSession)
    known = docs.select(F.col(lang_col).alias("lang"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null and text <> ''")
    labels = sorted(r[0] for r in known.select("lang").distinct().collect())  # the languages
    if not labels:
        return None, []
    ids = known.select(F.col("id").alias("_id"), F.col("lang").alias("_lang"))
    chosen = None
    for lang in labels:  # a stated number of each
        part = ids.where(F.col("_lang") == lang).orderBy(F.xxhash64("_id"), "_id").limit(max(1, fit_rows // len(labels))).select("_id")
        chosen = part if chosen is None else chosen.union(part)
    sample = known.join(F.broadcast(chosen.distinct()), F.col("id").eqNullSafe(F.col("_id"))).select("lang", "id", "text")
    got = sample.mapInArrow(_draw(DRAWS, TRAIN_WINDOW), "lang string, window binary").toArrow()
    windows = np.frombuffer(b"".join(got["window"].to_pylist()), np.int16).reshape(-1, TRAIN_WINDOW)
    index = {x: k for k, x in enumerate(labels)}
    y = np.array([index[x] for x in got["lang"].to_pylist()])
    order = np.lexsort((*windows[:, :8].T, y))  # whatever order the rows came in
    return train(windows[order], y[order], len(labels), steps), labels


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, labels = model.value
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            p = document_probabilities(net, text)
            best = p.argmax(1)
            lang = [labels[k] if has else UNKNOWN for k, has in zip(best.tolist(), letters.tolist())]
            score = np.where(letters, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: BiGRU | None, labels: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row: the likeliest language of the whole text and its probability.

    Null text, or text without a letter: ``und`` with score 0, as is every text
    where nothing could be learned.  Null and repeated ids: every row is
    returned.  Only id and text are read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast((net, labels))
    return rows.mapInArrow(_predict(sent), "doc_id long, lang_pred string, score double")
