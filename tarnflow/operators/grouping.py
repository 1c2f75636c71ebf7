"""Group-aware splits, dense identifiers, pivots and the matrices used for clustering."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.matching import assignment
from tarnflow.runtime import bounded_rows, cut, ranked, running


def holdout(df: DataFrame, group: str, order: Column, train: float, calibration: float) -> DataFrame:
    """(group, n, split): groups in order, ties by name, fill train, then calibration, up to the rounded share of rows; the rest is test."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("__all"))
    run = running(sizes, [order, F.col(group)], "n", "__before").crossJoin(F.broadcast(total))  # one row
    first, second = F.round(F.col("__all") * train), F.round(F.col("__all") * (train + calibration))
    return run.select(group, "n", F.when(F.col("__before") < first, "train").when(F.col("__before") < second, "calibration").otherwise("test").alias("split"))


def kfold(df: DataFrame, group: str, folds: int, max_groups: int = 1_000_000) -> DataFrame:
    """(group, n, fold): groups, the largest first and then by name, each to the smallest fold so far."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    rows = sorted(bounded_rows(sizes, max_groups, "the table of groups"), key=lambda r: (-r.n, str(r[group])))
    load, out = [0] * folds, []
    for r in rows:
        at = load.index(min(load))
        load[at] += r.n
        out.append((r[group], r.n, at))
    return df.sparkSession.createDataFrame(out, f"`{group}` {df.schema[group].dataType.simpleString()}, n bigint, fold int")


def group_number(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """df with a dense 0-based number of its keys in sorted order, nulls last; distinct keys are numbered range by range."""
    distinct = df.select(*keys).distinct()
    numbered = ranked(distinct, [F.col(k).asc_nulls_last() for k in keys], name).select(*(F.col(k).alias(f"__{k}") for k in keys), name)
    return df.join(numbered, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*(f"__{k}" for k in keys))


def pivot_first(df: DataFrame, index: str, column: str, values: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """One row per index, a column for each of values: the first value that isn't null, by order."""
    first = F.min(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("__value"))))["__value"]
    return df.groupBy(index).pivot(column, list(values)).agg(first)


def dense_rows(wide: DataFrame, columns: Sequence[str], key: str, most_missing: float = 0.2) -> DataFrame:
    """(key, nulls) of the rows kept when the row with most nulls, the least key first, is dropped until at most most_missing of the cells are null.

    Rows are dropped in one order, so what remains is a suffix of it: it is found from the counts of rows by number of nulls, and only
    rows with the boundary's number of nulls are ranked. One row always stays.
    """
    nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    rows = wide.select(key, nulls.alias("nulls"))
    counts = {r.nulls: r.n for r in rows.groupBy("nulls").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row per column, and one
    left, missing, limit, partial = sum(counts.values()), sum(k * n for k, n in counts.items()), len(columns) + 1, 0
    for k in sorted(counts, reverse=True):
        if left <= 1 or missing <= most_missing * left * len(columns):
            break
        drop = 0
        while drop < counts[k] and left > 1 and missing > most_missing * left * len(columns):
            need = 1
            if k > most_missing * len(columns):  # each drop brings the share nearer: solve for how many
                need = max(1, int((missing - most_missing * left * len(columns)) // (k - most_missing * len(columns))))
            need = min(need, counts[k] - drop, left - 1)
            drop, left, missing = drop + need, left - need, missing - need * k
        limit, partial = k, drop
        if drop < counts[k]:
            break
    whole = rows.where(F.col("nulls") < limit)
    edge = ranked(rows.where(F.col("nulls") == limit), [F.col(key)], "__r").where(F.col("__r") >= partial).drop("__r")
    return whole.unionByName(edge)


def standardized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """columns less their mean, over their population deviation; a constant column becomes 0."""
    stats = df.agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"__s_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")), F.when(F.col(c).isNotNull(), 0.0)) for c in columns}).drop(*(f"__{x}_{c}" for c in columns for x in "ms"))


def knn_fill(df: DataFrame, key: str, columns: Sequence[str], k: int = 5, block_rows: int = 50_000) -> DataFrame:
    """(key, columns as doubles) with nulls filled by the k nearest other rows that have the value, weighted by the inverse of the distance.

    The distance leaves out coordinates that either row lacks and is scaled up for them; rows at distance 0 count alone, ties go to the lesser
    key. Without a donor the column's mean is used. Donors are sent to the rows to fill in blocks by hash, each of about block_rows rows; a row
    keeps k neighbours of each block, so the result doesn't depend on the blocks. Keys must be unique and not null.
    """
    wide = cut(df.where(F.col(key).isNotNull()).select(key, *(F.col(c).cast("double").alias(c) for c in columns)))
    lacks = F.lit(False)
    for c in columns:
        lacks = lacks | F.col(c).isNull()
    open_ = wide.where(lacks)
    blocks = max(1, -(-wide.count() // block_rows))
    spark, kind = df.sparkSession, wide.schema[key].dataType.simpleString()
    found = None
    for b in range(blocks):
        rows = bounded_rows(wide.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b), 4 * block_rows, "a block of donors")
        rows.sort(key=lambda r: r[key])
        matrix = np.array([[np.nan if r[c] is None else r[c] for c in columns] for r in rows], float).reshape(len(rows), len(columns))
        shared = spark.sparkContext.broadcast((matrix, [r[key] for r in rows]))

        def near(frames, shared=shared):
            m, keys = shared.value
            has, at = ~np.isnan(m), {x: i for i, x in enumerate(keys)}
            full = np.where(has, m, 0)
            for f in frames:
                out, x = [], f[list(columns)].to_numpy(float)
                for row, me in zip(x, f[key].tolist()):
                    both = has & ~np.isnan(row)
                    count = both.sum(1)
                    d = (np.where(both, full - np.nan_to_num(row), 0) ** 2).sum(1)
                    d = np.where(count > 0, np.sqrt(d * len(columns) / np.maximum(count, 1)), np.inf)
                    if me in at:
                        d[at[me]] = np.inf
                    for j in np.flatnonzero(np.isnan(row)):
                        some = np.flatnonzero(has[:, j] & np.isfinite(d))
                        out += [(me, int(j), float(d[i]), keys[i], float(m[i, j])) for i in some[np.argsort(d[some], kind="stable")[:k]]]
                yield pd.DataFrame(out, columns=[key, "j", "d", "donor", "v"])

        part = open_.mapInPandas(near, f"`{key}` {kind}, j int, d double, donor {kind}, v double")
        found = part if found is None else found.unionByName(part)
    best = F.slice(F.array_sort(F.collect_list(F.struct("d", "donor", "v"))), 1, k)
    cells = found.groupBy(key, "j").agg(best.alias("n"))
    equal = F.filter("n", lambda x: x["d"] == 0)
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    value = F.when(F.size(equal) > 0, total(equal, lambda x: x["v"]) / F.size(equal)).otherwise(total(F.col("n"), lambda x: x["v"] / x["d"]) / total(F.col("n"), lambda x: 1 / x["d"]))
    filled = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("j", value.alias("v")))).alias("__m"))
    means = wide.agg(*(F.avg(c).alias(f"__mean_{c}") for c in columns))
    done = open_.join(filled, key, "left").crossJoin(F.broadcast(means))  # one row
    return wide.where(~lacks).unionByName(done.select(key, *(F.coalesce(c, F.try_element_at("__m", F.lit(j)), f"__mean_{c}").alias(c) for j, c in enumerate(columns))))


def centroid_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Mean distance of the centroids of a to those of b matched to them, under the best one-to-one assignment; b has at least as many."""
    if len(a) > len(b):
        raise ValueError("fewer centroids to match than to be matched")
    d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))
    to = assignment((d.max() + 1 - d).tolist())  # every weight is over 0, so each row is matched
    return float(np.mean([d[i, j] for i, j in enumerate(to)]))


def weighted_kmeans(df: DataFrame, features: str, weight: str | None, k: int, seed: int = 342):
    """A fitted MLlib KMeans model over an array column, rows weighted."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))
    model = KMeans(featuresCol="__v", k=k, seed=seed, **({"weightCol": weight} if weight else {}))
    return model.fit(data)


def best_columns(wide: DataFrame, columns: Sequence[str], sizes: Sequence[int] = (2, 3, 4, 5), most_missing: float = 0.2) -> DataFrame:
    """(columns, rows, score) of every combination of columns with as many as one of sizes: rows that dense_rows keeps, score = rows times
    columns; the best first, ties by the names.

    Rows are counted by which of the columns they lack, so combinations are tried on at most 2 ** len(columns) counts, on 16 columns at most.
    """
    if len(columns) > 16:
        raise ValueError("more than 16 columns have too many combinations")
    mask = sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)), F.lit(0))
    counts = {r.m: r.n for r in wide.groupBy(mask.alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for d in sizes:
        for chosen in combinations(range(len(columns)), d):
            by_nulls: dict[int, int] = {}
            for m, n in counts.items():
                k = sum(m >> i & 1 for i in chosen)
                by_nulls[k] = by_nulls.get(k, 0) + n
            kept = _kept(by_nulls, d, most_missing)
            out.append(([columns[i] for i in chosen], kept, kept * d))
    out.sort(key=lambda x: (-x[2], x[0]))
    return wide.sparkSession.createDataFrame(out, "columns array<string>, rows bigint, score bigint")


def _kept(counts: dict[int, int], columns: int, most_missing: float) -> int:
    """How many rows stay when those with most nulls are dropped one by one until few enough cells are missing; one always stays."""
    left, missing = sum(counts.values()), sum(k * n for k, n in counts.items())
    for k in sorted(counts, reverse=True):
        over = missing - most_missing * left * columns
        if left <= 1 or over <= 0:
            break
        gain = k - most_missing * columns
        need = min(counts[k], left - 1, int(-(-over // gain)) if gain > 0 else counts[k])
        left, missing = left - need, missing - need * k
    return left


def largest(scored: DataFrame, score: str, ties: Sequence[str]) -> DataFrame:
    """The one row of the greatest score, ties by ties."""
    return scored.orderBy(F.col(score).desc(), *ties).limit(1)


def elbow(df: DataFrame, features: str, ks: Sequence[int], seed: int = 342) -> DataFrame:
    """(k, cost): the sum of squared distances to the nearest of k fitted centres, for each k."""
    # one centre is the mean
    spread = F.sum(F.col("n") * F.col("v"))
    one = df.select(F.posexplode(features).alias("i", "x")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.var_pop(F.col("x").cast("double")).alias("v")).agg(spread).first()[0]
    costs = [(k, float(one or 0.0) if k == 1 else float(weighted_kmeans(df, features, None, k, seed).summary.trainingCost)) for k in ks]
    return df.sparkSession.createDataFrame(costs, "k int, cost double")


def principal_components(df: DataFrame, key: str, features: str, k: int = 2) -> DataFrame:
    """(key, components array): the first k principal components of centred features, each with its greatest loading positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = df.where(F.col(features).isNotNull()).select(key, array_to_vector(F.col(features).cast("array<double>")).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(data)
    loadings = model.pc.toArray()
    means = df.select(F.posexplode(features).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()  # one row per feature
    centre = np.zeros(loadings.shape[0])
    for r in means:
        centre[r.i] = r.m
    shift, sign = centre @ loadings, np.sign(loadings[np.abs(loadings).argmax(0), range(k)])
    parts = vector_to_array("p")
    return model.transform(data).select(key, F.array(*((parts[i] - float(shift[i])) * float(sign[i]) for i in range(k))).alias("components"))


def gamma_sweep(df: DataFrame, features: str, probability: str, truth: np.ndarray, gammas: Sequence[float], seeds: Sequence[int], k: int = 5, rounds: int = 50) -> DataFrame:
    """(gamma, mean, std, n): distance of weighted k-means centres to true ones, weights probability ** gamma, over seeds.

    The features are a labelled set of bounded size, at most 200,000 rows, sent to every task; each (gamma, seed) is a row of its own.
    """
    rows = bounded_rows(df.select(features, probability), 200_000, "the table to be clustered")
    x, p = np.array([r[features] for r in rows], float), np.array([r[probability] for r in rows], float)
    shared = df.sparkSession.sparkContext.broadcast((x, p))
    grid = df.sparkSession.createDataFrame([(float(g), int(s)) for g in gammas for s in seeds], "gamma double, seed int").repartition(max(1, df.sparkSession.sparkContext.defaultParallelism))

    def solve(frames):
        points, chance = shared.value
        for f in frames:
            yield pd.DataFrame({"gamma": f["gamma"], "distance": [centroid_distance(lloyd(points, chance**g, k, s, rounds), truth) for g, s in zip(f["gamma"], f["seed"])]})

    return grid.mapInPandas(solve, "gamma double, distance double").groupBy("gamma").agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std"), F.count(F.lit(1)).alias("n"))


def lloyd(points: np.ndarray, weights: np.ndarray, k: int, seed: int, rounds: int = 50) -> np.ndarray:
    """Centres of weighted k-means, started by distance-weighted draws; a centre without points stays where it was."""
    rng = np.random.default_rng(seed)
    centres = points[[rng.choice(len(points), p=weights / weights.sum() if weights.sum() > 0 else None)]]
    while len(centres) < k:
        d = ((points[:, None] - centres[None]) ** 2).sum(2).min(1) * weights
        centres = np.r_[centres, points[[rng.choice(len(points), p=d / d.sum() if d.sum() > 0 else None)]]]
    for _ in range(rounds):
        near = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([np.average(points[near == j], axis=0, weights=weights[near == j]) if weights[near == j].sum() > 0 else centres[j] for j in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def random_baseline_distance(df: DataFrame, columns: Sequence[str], truth: np.ndarray, k: int, trials: int = 100, seed: int = 342) -> tuple[float, float]:
    """Mean and population deviation of the distance to true centres of k uniform points in the box that holds the rows."""
    ends = df.agg(*(F.min(c).alias(f"lo_{c}") for c in columns), *(F.max(c).alias(f"hi_{c}") for c in columns)).first()
    low, high = np.array([ends[f"lo_{c}"] for c in columns], float), np.array([ends[f"hi_{c}"] for c in columns], float)
    rng = np.random.default_rng(seed)
    distances = [centroid_distance(rng.uniform(low, high, (k, len(columns))), truth) for _ in range(trials)]
    return float(np.mean(distances)), float(np.std(distances))


def label_share(pivoted: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, label): the mean of the labels a row has, 0 where it has none."""
    known = F.filter(F.array(*(F.col(c).cast("double") for c in columns)), lambda x: x.isNotNull())
    return pivoted.select(key, F.coalesce(F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known)), F.lit(0.0)).alias("label"))
