"""Logistic probes on feature arrays: grouped cross-validation and Platt calibration."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators import evaluate


def _balanced(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    share = counts.crossJoin(F.broadcast(total)).select(F.col(label).alias("__l"), (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("__w"))
    return df.join(F.broadcast(share), F.col(label) == F.col("__l")).drop("__l")  # one row per label


def _margin(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("__margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")


def fit_probe(df: DataFrame, label: str, c: float = 1.0):
    """Scaled, balanced logistic regression; c is the inverse strength of the penalty on the sum of losses."""
    data = _balanced(df, label)
    n = max(1, data.count())
    scaler = StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True).fit(data)
    model = LogisticRegression(featuresCol="__scaled", labelCol=label, weightCol="__w", regParam=1 / (c * n), standardization=False, maxIter=100).fit(scaler.transform(data))
    return scaler, model


def calibrated_probabilities(df: DataFrame, key: str, features: str, label: str, fold: str, folds: int, c: float = 1.0) -> DataFrame:
    """(key, label, fold, p): out-of-fold probabilities; each fold's margins are calibrated by a logistic curve fitted on another fold.

    Groups never straddle folds if fold comes from a grouped split, so neither the probe nor its calibration sees the group it scores.
    """
    data = df.select(key, F.col(label).cast("double").alias("__y"), F.col(fold).alias("__fold"), array_to_vector(F.col(features).cast("array<double>")).alias("__raw"))
    out = None
    for i in range(folds):
        held, tune = data.where(F.col("__fold") == i), data.where(F.col("__fold") == (i + 1) % folds)
        train = data.where((F.col("__fold") != i) & (F.col("__fold") != (i + 1) % folds))
        scaler, model = fit_probe(train, "__y", c)
        one = lambda d: _margin(model, scaler.transform(d)).withColumn("__m", array_to_vector(F.array("__margin")))
        platt = LogisticRegression(featuresCol="__m", labelCol="__y", maxIter=100).fit(one(tune))
        scored = platt.transform(one(held)).select(key, F.col("__y").cast("int").alias(label), F.col("__fold").alias(fold), vector_to_array("probability")[1].alias("p"))
        out = scored if out is None else out.unionByName(scored)
    return out


def _fitted_without(df: DataFrame, label: str, fold: str, c: float, i: int):
    """(scaler, model) fitted on all folds but i, over df with the column __raw."""
    return fit_probe(df.where(F.col(fold) != i), label, c)


def with_vector(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("__raw", array_to_vector(F.col(features).cast("array<double>")))


def cv_scores(df: DataFrame, features: str, label: str, fold: str, folds: int, c: float = 1.0) -> DataFrame:
    """(fold, n, f1, ece, auroc) of a probe fitted on the other folds; mean_and_deviation() sums them up."""
    data = with_vector(df, features).withColumn("__y", F.col(label).cast("double"))
    out = None
    for i in range(folds):
        scaler, model = _fitted_without(data, "__y", fold, c, i)
        scored = model.transform(scaler.transform(data.where(F.col(fold) == i))).select(F.lit(i).alias("fold"), F.col("__y").cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))
        out = scored if out is None else out.unionByName(scored)
    return evaluate.probe_metrics(out, "p", "y", ["fold"]).select("fold", "n", "f1", "ece", "auroc")


def head_scores(heads: DataFrame, group: Sequence[str], features: str, label: str, fold: str, folds: int, c: float = 1.0, rounds: int = 25) -> DataFrame:
    """(group, f1, ece) of one balanced logistic probe per group, as layer and head, by grouped cross-validation.

    Groups are fitted side by side in tasks, by iterated least squares on scaled features; a group holds a row per measurement, which is
    a labelled set of bounded size, and is checked to be at most 200,000 rows.
    """
    keys = list(group)
    schema = ", ".join(f"`{g}` {heads.schema[g].dataType.simpleString()}" for g in keys) + ", f1 double, ece double"

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        if len(f) > 200_000:
            raise ValueError("a head has more than 200000 labelled rows; probe a bounded sample of them")
        x, y, at = np.stack([np.asarray(v, float) for v in f[features]]), f[label].to_numpy(float), f[fold].to_numpy()
        f1s, eces = [], []
        for i in range(folds):
            train, test = at != i, at == i
            if not test.any() or len(set(y[train])) < 2:
                continue
            p = _logistic(x[train], y[train], x[test], c, rounds)
            said, true = p > 0.5, y[test] == 1
            f1s.append(2 * (said & true).sum() / max(1, said.sum() + true.sum()))
            bins = np.minimum((p * 10).astype(int), 9)
            eces.append(sum(abs(p[bins == b].mean() - y[test][bins == b].mean()) * (bins == b).mean() for b in set(bins.tolist())))
        return pd.DataFrame([(*(f[k].iloc[0] for k in keys), float(np.mean(f1s)) if f1s else None, float(np.mean(eces)) if eces else None)], columns=[*keys, "f1", "ece"])

    return heads.select(*keys, features, F.col(label).cast("int").alias(label), fold).groupBy(*keys).applyInPandas(fit, schema)


def _logistic(x: np.ndarray, y: np.ndarray, test: np.ndarray, c: float, rounds: int) -> np.ndarray:
    """Probabilities of test by balanced ridge logistic regression on standardised features, the intercept free."""
    mean, deviation = x.mean(0), x.std(0)
    deviation[deviation == 0] = 1
    a, b = np.c_[(x - mean) / deviation, np.ones(len(x))], np.c_[(test - mean) / deviation, np.ones(len(test))]
    weight = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    ridge = np.diag([1 / c] * x.shape[1] + [1e-9])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + ridge, a.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(b @ w, -30, 30)))


def top_heads(scores: DataFrame, k: int, score: str, index: Sequence[str]) -> DataFrame:
    """The k best by score, ties to the greater index; a report of k rows."""
    return scores.orderBy(F.col(score).desc_nulls_last(), *(F.col(i).desc() for i in index)).limit(k)


def best_layer(scores: DataFrame, layer: str, score: str) -> DataFrame:
    """One row: the layer of the greatest score, the first of equals."""
    return scores.where(F.col(score).isNotNull()).agg(F.max(F.struct(F.col(score), (-F.col(layer)).alias("m"))).alias("b")).select((-F.col("b.m")).alias(layer), F.col(f"b.{score}").alias(score))


def shared_heads(scores: dict[str, DataFrame], k: int, score: str, index: Sequence[str]) -> DataFrame:
    """(index) of the heads that are among the k best of every dataset."""
    tops = [top_heads(s, k, score, index).select(*index) for s in scores.values()]
    return reduce(lambda a, b: a.intersect(b), tops)


def joined_features(heads: DataFrame, chosen: DataFrame, key: str, index: Sequence[str], features: str) -> DataFrame:
    """(key, features): the features of the chosen heads of each key one after the other, in the order of index; keys that lack one are left out."""
    picked = heads.join(F.broadcast(chosen.select(*index)), list(index))  # k rows
    wanted = chosen.count()
    packed = picked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*index, F.col(features).alias("__f")))).alias("l"))
    return packed.where(F.size("l") == wanted).select(key, F.flatten(F.transform("l", lambda x: x["__f"])).alias(features))


def calibrated_ensemble(df: DataFrame, scored: DataFrame, key: str, features: str, label: str, fold: str, folds: int, c: float = 1.0) -> DataFrame:
    """(key, p) of scored: the mean over folds of probes fitted on the other folds and calibrated by a logistic curve on their own.

    With a feature array of one number, as a probability from tokens, it calibrates that number; with the features of a layer it is a layer's probe.
    """
    data, new = with_vector(df, features).withColumn("__y", F.col(label).cast("double")), with_vector(scored.select(key, features), features)
    one = lambda d, scaler, model: _margin(model, scaler.transform(d)).withColumn("__m", array_to_vector(F.array("__margin")))
    parts = None
    for i in range(folds):
        scaler, model = _fitted_without(data, "__y", fold, c, i)
        platt = LogisticRegression(featuresCol="__m", labelCol="__y", maxIter=100).fit(one(data.where(F.col(fold) == i), scaler, model))
        part = platt.transform(one(new, scaler, model)).select(key, vector_to_array("probability")[1].alias("p"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(key).agg(F.avg("p").alias("p"))


def save_probe(model, metadata: dict, path: str) -> None:
    """A fitted MLlib model with its metadata beside it."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "metadata string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_probe(kind, path: str) -> tuple[object, dict]:
    """(model, metadata) of save_probe; kind is the model's class."""
    row = SparkSession.active().read.schema("metadata string").json(f"{path}/metadata").first()
    return kind.load(f"{path}/model"), json.loads(row.metadata)
