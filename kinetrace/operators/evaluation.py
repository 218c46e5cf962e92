"""Quality measures: splits, centroids, accuracy, precision at k, confusion stress."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions.columns import cosine, rounded


def split(df: DataFrame, label: str, order: str, share: float = 0.7, least: int = 1) -> DataFrame:
    """Adds ``is_train``: the first share of each label's rows, one at least; labels with fewer than ``least`` rows are dropped."""
    per = Window.partitionBy(label)
    n = F.count("*").over(per)
    nth = F.row_number().over(per.orderBy(order))
    return df.withColumns({"_n": n, "_nth": nth}).where(F.col("_n") >= least).withColumn("is_train", F.col("_nth") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_n", "_nth")


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, vec): the element-wise mean of each label's vectors."""
    cells = df.select(label, F.posexplode(vector).alias("p", "x")).groupBy(label, "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return cells.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("p", "x")))["x"].alias("vec"))


def classify(df: DataFrame, means: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(key, label, predicted): the centroid of the largest cosine, the lowest label of equals. There is a centroid a label."""
    m = means.select(F.col(label).alias("candidate"), F.col("vec").alias("_mean"))
    scored = df.crossJoin(m).select(key, label, "candidate", rounded(cosine(F.col(vector), F.col("_mean")), 9).alias("score"))
    best = scored.groupBy(key, label).agg(F.max_by(F.col("candidate"), F.struct("score", -F.col("candidate"))).alias("predicted"))
    return best


def accuracy(df: DataFrame, by: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    hit = (F.col(label) == F.col(predicted)).cast("int")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(hit).alias("correct"), F.avg(hit).alias("accuracy"))


def precision_at_k(near: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Mean over queries of the share of the k neighbours that carry the query's label."""
    per = near.groupBy("query", "query_label").agg((F.count_if(F.col("label") == F.col("query_label")) / F.lit(k)).alias("p"))
    return per.groupBy(*(by or [])).agg(F.count("*").alias("queries"), F.avg("p").alias("precision"))


def confusion_stress(labels: np.ndarray, paths: np.ndarray, histogram, seed: int, k: int = 10, trials: int = 80) -> dict[str, float]:
    """Blends random pairs of unlike paths; how often do the k most similar paths all carry one label?

    ``histogram`` maps a path to its token histogram. Pairs of one label are skipped but count among the trials.
    """
    rng = np.random.default_rng(seed)
    lib = np.stack([histogram(p) for p in paths])
    norm, wrong = np.linalg.norm(lib, axis=1), 0
    for _ in range(trials):
        a, b = rng.choice(len(paths), 2, replace=False)
        if labels[a] == labels[b]:
            continue
        share = rng.uniform(0.4, 0.6)
        q = histogram(share * paths[a] + (1 - share) * paths[b])
        score = (lib @ q) / np.maximum(norm * np.linalg.norm(q), 1e-12)
        wrong += len(set(labels[np.argsort(-score, kind="stable")[:k]])) < 2
    rate = wrong / max(1, trials)
    return {"queries": float(max(1, trials)), "false_positive_rate": rate, "pass": rate <= 0.25}
