"""Feature clustering, clustered permutation importance and the purged-CV models, on pyspark.ml."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.entropy import correlation_distance
from tickloom.sources.scratch import Scratch


def varying(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that are not constant."""
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def ward_tree(dist: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (cluster, cluster, height, size) by Ward's rule on a distance matrix; new clusters are numbered on from its size."""
    n = len(dist)
    d = {(i, j): float(dist[i, j]) for i in range(n) for j in range(i + 1, n)}
    size, out = dict.fromkeys(range(n), 1), []
    for new in range(n, 2 * n - 1):
        (a, b), h = min(d.items(), key=lambda kv: (kv[1], kv[0]))
        na, nb = size.pop(a), size.pop(b)
        for k, nk in size.items():
            da, db = d.pop((min(a, k), max(a, k))), d.pop((min(b, k), max(b, k)))
            d[(k, new)] = math.sqrt(max(0.0, ((na + nk) * da * da + (nb + nk) * db * db - nk * h * h) / (na + nb + nk)))
        d.pop((a, b))
        size[new] = na + nb
        out.append((a, b, h, na + nb))
    return out


def cut_tree(tree: list[tuple[int, int, float, int]], n: int, k: int) -> np.ndarray:
    """Labels 0..k-1 of n leaves when k clusters are left."""
    members = {i: [i] for i in range(n)}
    for new, (a, b, _, _) in enumerate(tree[: n - k], n):
        members[new] = members.pop(a) + members.pop(b)
    labels = np.zeros(n, int)
    for j, group in enumerate(sorted(members.values(), key=min)):
        labels[group] = j
    return labels


def silhouette(dist: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette width; a single-member cluster counts 0."""
    out = []
    for i, k in enumerate(labels):
        own = (labels == k) & (np.arange(len(labels)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a, b = dist[i, own].mean(), min(dist[i, labels == j].mean() for j in set(labels) - {k})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def cluster_features(df: DataFrame, columns: Sequence[str], k: int | None = None, most: int = 20) -> dict[int, list[str]]:
    """Clusters of the varying columns by Ward on correlation distance, as many as the silhouette likes best.

    Only the matrix of the columns' distances comes to the driver.
    """
    names = varying(df, columns)
    if len(names) < 3:
        return {i: [c] for i, c in enumerate(names)}
    dist = correlation_distance(df, names)
    tree = ward_tree(dist)
    if k is None:
        k = max(range(2, min(most, len(names) - 1) + 1), key=lambda j: silhouette(dist, cut_tree(tree, len(names), j)))
    labels = cut_tree(tree, len(names), k)
    return {j: [c for c, x in zip(names, labels) if x == j] for j in range(k)}


def forest(uniqueness: float = 1.0, trees: int = 50, seed: int = 42) -> RandomForestClassifier:
    """Bagged entropy trees, one feature a split, each on a share of rows equal to the mean uniqueness."""
    return RandomForestClassifier(featuresCol="_x", labelCol="label", weightCol="weight", impurity="entropy", numTrees=trees, featureSubsetStrategy="1", subsamplingRate=float(min(1.0, max(uniqueness, 0.01))), seed=seed, maxDepth=8)


def boosted(rounds: int = 50, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(featuresCol="_x", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=4, stepSize=0.1, seed=seed)


def with_vector(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip").transform(df if "weight" in df.columns else df.withColumn("weight", F.lit(1.0)))


def out_of_fold(df: DataFrame, splits: DataFrame, columns: Sequence[str], model=None) -> DataFrame:
    """(row_id, split_id, label, prob) of each split's test rows by a model of its training rows; splits are a few."""
    model, out = model or forest(), None
    for (k,) in splits.select("split_id").distinct().orderBy("split_id").collect():
        rows = df.join(splits.where(F.col("split_id") == k), "row_id")
        fitted = model.fit(with_vector(rows.where("role = 'train'"), columns))
        part = fitted.transform(with_vector(rows.where("role = 'test'"), columns)).select("row_id", "split_id", "label", vector_to_array("probability")[1].alias("prob"))
        out = part if out is None else out.unionByName(part)
    return out


def log_loss(df: DataFrame, prob: str = "prob") -> float:
    p = F.least(F.greatest(F.col(prob), F.lit(1e-15)), F.lit(1 - 1e-15))
    return float(df.agg(-F.avg(F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p))).first()[0] or 0.0)


def permuted(df: DataFrame, columns: Sequence[str], seed: int, scratch: Scratch | None = None) -> DataFrame:
    """df with the columns jointly permuted among its rows: two hash orders of the row ids matched by rank, no single-task sort."""
    from tickloom.operators.validation import with_row_id

    a = with_row_id(df.withColumn("_h", F.xxhash64("row_id", F.lit(seed))).withColumnRenamed("row_id", "_id"), "_h", "_id", scratch=scratch)
    b = with_row_id(df.select(F.col("row_id").alias("_id"), *columns, F.xxhash64("row_id", F.lit(seed + 1)).alias("_h")), "_h", "_id", scratch=scratch).select("row_id", *columns)
    return a.drop(*columns, "_h").join(b, "row_id").drop("row_id").withColumnRenamed("_id", "row_id")


def clustered_mda(df: DataFrame, splits: DataFrame, clusters: dict[int, list[str]], model=None, repeats: int = 1, seed: int = 42) -> list[dict]:
    """Per cluster the mean and deviation over the splits of the rise of log loss when its columns are permuted in the test rows."""
    columns = [c for v in clusters.values() for c in v]
    model, rises = model or forest(seed=seed), {k: [] for k in clusters}
    for (s,) in splits.select("split_id").distinct().orderBy("split_id").collect():
        rows = df.join(splits.where(F.col("split_id") == s), "row_id")
        fitted = model.fit(with_vector(rows.where("role = 'train'"), columns))
        test = rows.where("role = 'test'").drop("split_id", "role").persist()
        score = lambda d: log_loss(fitted.transform(with_vector(d, columns)).select("label", vector_to_array("probability")[1].alias("prob")))  # noqa: E731, B023
        base = score(test)
        for k, names in clusters.items():
            risen = []
            for r in range(repeats):
                scratch = Scratch(df.sparkSession)
                risen.append(score(permuted(test, names, seed + 2 * r, scratch)) - base)
                scratch.drop()
            rises[k].append(float(np.mean(risen)))
        test.unpersist()
    return [{"cluster": k, "mean": float(np.mean(v)), "std": float(np.std(v, ddof=1)) if len(v) > 1 else 0.0} for k, v in rises.items()]


def threshold_sweep(oof: DataFrame, thresholds: Sequence[float] = tuple(k / 20 for k in range(1, 20))) -> DataFrame:
    """(threshold, precision, recall, f1) of out-of-fold probabilities, all thresholds in one pass."""
    hit = lambda t: F.count_if((F.col("prob") >= t) & (F.col("label") == 1))
    sums = oof.agg(F.count_if(F.col("label") == 1).alias("pos"), *[x for i, t in enumerate(thresholds) for x in (hit(t).alias(f"h{i}"), F.count_if(F.col("prob") >= t).alias(f"n{i}"))])
    rows = sums.select("pos", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"h{i}").alias("h"), F.col(f"n{i}").alias("n")) for i, t in enumerate(thresholds)])).alias("r"))
    return rows.select("r.threshold", F.try_divide("r.h", "r.n").alias("precision"), F.try_divide("r.h", "pos").alias("recall"), F.try_divide(2 * F.col("r.h"), F.col("r.n") + F.col("pos")).alias("f1"))


def best_f1(oof: DataFrame) -> float:
    return float(threshold_sweep(oof).orderBy(F.desc_nulls_last("f1"), "threshold").first()["threshold"])
