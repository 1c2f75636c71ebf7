"""Rates, intervals, votes, classification metrics, calibration and sweeps; all are plain aggregates and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson score interval; null for n = 0."""
    p = F.try_divide(k, n)
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    ok = n > 0
    return F.when(ok, (centre - spread) / scale), F.when(ok, (centre + spread) / scale)


def rate(df: DataFrame, flag: Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """name, name_lo, name_hi, name_n: share of rows with flag and its interval."""
    counted = df.groupBy(*by).agg(F.sum(F.coalesce(flag, F.lit(False)).cast("int")).alias("__k"), F.count(F.lit(1)).alias("__n"))
    lo, hi = wilson(F.col("__k").cast("double"), F.col("__n").cast("double"))
    return counted.select(*by, F.try_divide(F.col("__k"), F.col("__n")).alias(name), lo.alias(f"{name}_lo"), hi.alias(f"{name}_hi"), F.col("__n").alias(f"{name}_n"))


def flagged(df: DataFrame, key: str, edges: DataFrame, edge_key: str, name: str) -> DataFrame:
    """df with name: whether an edge has the key."""
    has = edges.select(F.col(edge_key).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    return df.join(has, F.col(key) == F.col("__k"), "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__k", "__hit")


def binary_metrics(df: DataFrame, truth: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """n, n_pos, accuracy, precision, recall, f1; undefined ratios are null."""
    one = lambda c: F.sum(c.cast("int"))
    c = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), one(truth).alias("n_pos"), one(truth & predicted).alias("tp"), one(~truth & predicted).alias("fp"), one(truth & ~predicted).alias("fn"), one(truth == predicted).alias("right"))
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(*by, "n", "n_pos", F.try_divide(F.col("right"), F.col("n")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def votes(judgements: DataFrame, key: str, judge: str, vote: str, least: int | None = None) -> DataFrame:
    """(key, yes, judges, combined): yes votes >= least, by default half of the judges rounded up; a null vote is no yes."""
    yes = F.sum(F.coalesce(F.col(vote), F.lit(False)).cast("int"))
    counted = judgements.groupBy(key).agg(yes.alias("yes"), F.count_distinct(judge).alias("judges"))
    need = F.lit(least) if least is not None else F.ceil(F.col("judges") / 2)
    return counted.select(key, "yes", "judges", (F.col("yes") >= need).alias("combined"))


def strict_majority(judgements: DataFrame, key: str, vote: str) -> DataFrame:
    """(key, majority): yes votes over half of the votes that are not null."""
    return judgements.groupBy(key).agg((F.sum(F.when(F.col(vote), 1).otherwise(0)) > F.count(vote) / 2).alias("majority"))


def bin_of(p: Column, bins: int) -> Column:
    """0-based equal-width bin over [0, 1], the last closed; edges are i * (1 / bins) as floats; null outside."""
    at = F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: (p >= i * F.lit(1.0 / bins)) & ((p < (i + 1) * F.lit(1.0 / bins)) | ((i == bins - 1) & (p <= 1.0))))
    return F.get(at, F.lit(0))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, n, confidence, accuracy, sem) of the bins that hold rows."""
    return df.withColumn("bin", bin_of(F.col(p), bins)).where("bin is not null").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy")).withColumn("sem", F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n")))


def ece(df: DataFrame, p: str, y: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by, ece): mean distance of confidence and accuracy, weighted by the bins' shares of all rows."""
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__all"))
    gaps = reliability(df, p, y, bins, by).groupBy(*by).agg(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))).alias("__gap"))
    joined = gaps.join(total, list(by)) if by else gaps.crossJoin(F.broadcast(total))  # one row each
    return joined.select(*by, (F.col("__gap") / F.col("__all")).alias("ece"))


def _range(p: Column) -> Column:
    """One of 66 ranges of scores, in order; scores outside of [0, 1) are in the first and the last."""
    return F.least(F.greatest(F.floor(p * 64), F.lit(-1)), F.lit(64))


def auroc(df: DataFrame, p: str, y: str) -> DataFrame:
    """One row auroc, by the rank sum over distinct scores; ties count half.

    Scores are counted first, so the running sum is over distinct scores, and it is split by score ranges of equal width: ranges run in
    parallel, each offset by the negatives before it.
    """
    per = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("neg", F.col("n") - F.col("pos")).withColumn("__r", _range(F.col("__p")))
    ranges = per.groupBy("__r").agg(F.sum("neg").alias("__neg"))
    before = ranges.withColumn("__before", F.coalesce(F.sum("__neg").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__r", "__before")
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("__r").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__before")
    ranked = per.join(F.broadcast(before), "__r").withColumn("__below", below)
    return ranked.agg(F.try_divide(F.sum(F.col("pos") * (F.col("__below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auroc"))


def pr_curve(df: DataFrame, p: str, y: str) -> DataFrame:
    """(threshold, precision, recall) at each distinct score, rows at or over it predicted true."""
    per = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).alias("threshold")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("__r", _range(F.col("threshold")))
    ranges = per.groupBy("__r").agg(F.sum("pos").alias("__pos"), F.sum("n").alias("__n"))
    over = Window.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, -1)  # over ranges of scores
    above = ranges.select("__r", F.coalesce(F.sum("__pos").over(over), F.lit(0)).alias("__pos"), F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__n"))
    down = Window.partitionBy("__r").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    total = per.agg(F.sum("pos").alias("__all"))
    run = per.join(F.broadcast(above), "__r").select("threshold", (F.sum("pos").over(down) + F.col("__pos")).alias("tp"), (F.sum("n").over(down) + F.col("__n")).alias("said"))
    c = run.crossJoin(F.broadcast(total))  # one row
    return c.select("threshold", F.try_divide(F.col("tp"), F.col("said")).alias("precision"), F.try_divide(F.col("tp"), F.col("__all")).alias("recall"))


def sweep(df: DataFrame, p: str, y: str, steps: int, width: float) -> DataFrame:
    """(step, threshold, said, tp, recovery, validity) at thresholds step * width, strictly over; thresholds without a prediction are left out.

    Each row adds to one step, the last threshold it exceeds; the counts are then summed from above, over steps rows.
    """
    over = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("step", F.ceil(F.col(p) / width).cast("int") - 1)
    # the division may be off by one step at an edge: settle it by comparing
    over = over.withColumn("step", F.when(F.col(p) > (F.col("step") + 1) * F.lit(width), F.col("step") + 1).when(F.col(p) <= F.col("step") * F.lit(width), F.col("step") - 1).otherwise(F.col("step")))
    per = over.withColumn("step", F.least("step", F.lit(steps - 1))).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos"))
    grid = df.sparkSession.range(steps).select(F.col("id").cast("int").alias("step"))
    # steps is a small constant, so the triangle of steps is too
    up = grid.alias("g").join(F.broadcast(per.alias("c")), F.col("c.step") >= F.col("g.step")).groupBy("g.step").agg(F.sum("n").alias("said"), F.sum("pos").alias("tp"))
    total = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).agg(F.sum(F.col(y).cast("bigint")).alias("__all"))
    return up.crossJoin(F.broadcast(total)).select("step", (F.col("step") * F.lit(width)).alias("threshold"), "said", "tp", F.try_divide(F.col("tp"), F.col("__all")).alias("recovery"), F.try_divide(F.col("tp"), F.col("said")).alias("validity"))


def shifted_prior(p: Column, pi_tr: Column | float, pi_te: Column | float, eps: float = 1e-12) -> Column:
    """p under another prior: the logit moved by the difference of the priors' logits."""
    clip = lambda c: F.least(F.greatest(c, F.lit(eps)), F.lit(1 - eps))
    logit = lambda c: F.ln(c / (1 - c))
    wrap = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    z = logit(clip(p)) + logit(clip(wrap(pi_te))) - logit(clip(wrap(pi_tr)))
    return 1 / (1 + F.exp(-z))


def em_prior(df: DataFrame, p: str, pi_tr: float, rounds: int = 1000, tolerance: float = 1e-8) -> float | None:
    """The prior of df by EM: one average a round, over a persisted column; stops when it moves less than tolerance."""
    scores = df.select(F.col(p).alias("__p")).where("__p is not null").persist()
    try:
        now = pi_tr
        for _ in range(rounds):
            last = now
            a, b = F.col("__p") * (last / pi_tr), (1 - F.col("__p")) * ((1 - last) / (1 - pi_tr))
            now = scores.agg(F.avg(a / (a + b))).first()[0]
            if now is None or abs(now - last) < tolerance:
                break
        return now
    finally:
        scores.unpersist()


def p_true(upper_true: Column, lower_true: Column, upper_false: Column, lower_false: Column) -> Column:
    """Softmax over the two answers, each the log-sum-exp of its two spellings' logits."""

    def lse(a: Column, b: Column) -> Column:
        top = F.greatest(a, b)
        return top + F.ln(F.exp(a - top) + F.exp(b - top))

    return 1 / (1 + F.exp(lse(upper_false, lower_false) - lse(upper_true, lower_true)))


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, distinct, missing_rate) of each of columns, over all rows in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("__n"), *(x for c in columns for x in (F.count_distinct(c).alias(f"__d_{c}"), F.sum(F.col(c).isNull().cast("int")).alias(f"__m_{c}"))))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"__d_{c}").alias("distinct"), F.try_divide(F.col(f"__m_{c}"), F.col("__n")).alias("missing_rate")) for c in columns))
    return one.select(F.explode(cells).alias("c")).select("c.*")


def recovery_from_labels(truth: DataFrame, edges: DataFrame, predicted: DataFrame, ids: tuple[str, str], label: str, name: str = "recovery") -> DataFrame:
    """rate() of the truth rows that have an edge to a row predicted valid; ids are the columns of truth and of predicted in edges."""
    gt, ex = ids
    good = edges.join(predicted.where(F.col(label)).select(ex).distinct(), ex, "left_semi")
    return rate(flagged(truth, gt, good, gt, "__found"), F.col("__found"), name)


def validity_from_labels(df: DataFrame, truth: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, validity): the share of the predicted rows that are true, 0 where none is predicted."""
    said = F.sum((truth & predicted).cast("int")), F.sum(predicted.cast("int"))
    return df.groupBy(*by).agg(F.coalesce(F.try_divide(*said), F.lit(0.0)).alias("validity"))


def validity_or_judged(extracted: DataFrame, edges: DataFrame, key: str, judged: Column, name: str = "validity") -> DataFrame:
    """rate() of the extracted rows that have an edge or were judged true; a null judgement is no vote."""
    return rate(flagged(extracted, key, edges, key, "__edge"), F.col("__edge") | F.coalesce(judged, F.lit(False)), name)


def probe_metrics(df: DataFrame, p: str, y: str, by: Sequence[str] = (), threshold: float = 0.5, bins: int = 10) -> DataFrame:
    """(by, n, n_pos, accuracy, precision, recall, f1, auroc, ece, brier, brier_skill) of probabilities p for labels y of 0 and 1.

    The skill compares with the rate of positives; it is null where all labels are alike. Rows without a probability or label are left out.
    """
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    keys = list(by)
    base = binary_metrics(rows, F.col(y) == 1, F.col(p) > threshold, keys)
    scores = rows.groupBy(*keys).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), F.avg(F.col(y).cast("double")).alias("__rate"))
    scores = scores.withColumn("brier_skill", 1 - F.try_divide(F.col("brier"), F.col("__rate") * (1 - F.col("__rate")))).drop("__rate")
    out = base
    for other in (auroc_by(rows, p, y, keys), ece(rows, p, y, bins, keys), scores):
        out = out.join(other, keys) if keys else out.crossJoin(F.broadcast(other))  # one row each
    return out


def auroc_by(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, auroc) of each group, by the rank sum over its distinct scores; ties count half, groups of one label give null.

    Scores are counted first; ranks run within ranges of scores, which start from the negatives of the ranges below.
    """
    keys = list(by)
    if not keys:
        return auroc(df, p, y)
    per = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(p).alias("__p")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("neg", F.col("n") - F.col("pos")).withColumn("__r", _range(F.col("__p")))
    ranges = per.groupBy(*keys, "__r").agg(F.sum("neg").alias("__neg"))
    before = ranges.withColumn("__before", F.coalesce(F.sum("__neg").over(Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__neg")
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys, "__r").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__before")
    ranked = per.join(before, [*keys, "__r"]).withColumn("__below", below)
    return ranked.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * (F.col("__below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auroc"))


def reliability_diagram(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, centre, n, confidence, accuracy, sem) of every bin; bins without rows have n = 0 and nulls."""
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), ((F.col("id") + 0.5) / bins).alias("centre"))
    # bins rows on both sides
    return grid.join(F.broadcast(reliability(df, p, y, bins)), "bin", "left").select("bin", "centre", F.coalesce("n", F.lit(0)).alias("n"), "confidence", "accuracy", "sem")


def mean_and_deviation(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, mean, std, n) with the deviation of the whole population."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def row_product(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, product) of the values of each key that aren't null; 1 where all are."""
    return df.groupBy(key).agg(F.coalesce(F.product(F.col(value)), F.lit(1.0)).alias("product"))


def edge_sweep(extracted: DataFrame, edges: DataFrame, key: str, weight: str, label: Column, steps: int = 101) -> DataFrame:
    """(step, threshold, n, n_pos, accuracy, precision, recall, f1): an extracted row is predicted true if its greatest edge weight is over
    the threshold, for thresholds from 0 to 1. Rows are counted by the last step they exceed first, so each adds one row to the sweep."""
    best = edges.groupBy(key).agg(F.max(weight).alias("__w"))
    width = 1.0 / (steps - 1)
    rows = extracted.withColumn("__y", label).join(best, key, "left").where(F.col("__y").isNotNull())
    over = F.when(F.col("__w") > 0, F.least(F.lit(steps - 1), F.ceil(F.round(F.col("__w") / width, 9)).cast("int") - 1)).otherwise(-1)
    per = rows.groupBy(over.alias("__at")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("__y").cast("bigint")).alias("pos"))
    total = per.agg(F.sum("c").alias("n"), F.sum("pos").alias("n_pos"))
    grid = df_range(extracted, steps)
    # steps is a small constant, so the triangle of steps is too
    up = grid.join(F.broadcast(per), F.col("__at") >= F.col("step"), "left").groupBy("step").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("said"), F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"))
    c = up.crossJoin(F.broadcast(total))
    right = F.col("tp") + (F.col("n") - F.col("said")) - (F.col("n_pos") - F.col("tp"))
    return c.select(
        "step", (F.col("step") * F.lit(width)).alias("threshold"), "n", "n_pos", F.try_divide(right, F.col("n")).alias("accuracy"), F.try_divide(F.col("tp"), F.col("said")).alias("precision"),
        F.try_divide(F.col("tp"), F.col("n_pos")).alias("recall"), F.try_divide(2 * F.col("tp"), F.col("said") + F.col("n_pos")).alias("f1"),
    )


def df_range(like: DataFrame, n: int) -> DataFrame:
    return like.sparkSession.range(n).select(F.col("id").cast("int").alias("step"))


def random_baseline(df: DataFrame, y: str, key: str, steps: int, width: float, draws: int = 50, seed: int = 342) -> DataFrame:
    """(step, recovery, validity): means over draws in which each row gets a random score instead of its own; the scores are hashes of
    draw and key, so they don't change with the order of rows. Draws in which nothing is predicted count for recovery only."""
    score = F.pmod(F.xxhash64(F.lit(seed), F.col("__draw"), F.col(key)), F.lit(1_000_000)) / 1_000_000.0
    drawn = df.where(F.col(y).isNotNull()).withColumn("__draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("step", F.ceil(score / width).cast("int") - 1)
    per = drawn.groupBy("__draw", F.least("step", F.lit(steps - 1)).alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos"))
    total = df.where(F.col(y).isNotNull()).agg(F.sum(F.col(y).cast("bigint")).alias("__all"))
    grid = df_range(df, steps)
    up = per.join(F.broadcast(grid), F.col("at") >= F.col("step")).groupBy("__draw", "step").agg(F.sum("n").alias("said"), F.sum("pos").alias("tp"))  # draws times steps rows
    c = up.crossJoin(F.broadcast(total))
    return c.groupBy("step").agg((F.sum(F.try_divide(F.col("tp"), F.col("__all"))) / draws).alias("recovery"), F.avg(F.try_divide(F.col("tp"), F.col("said"))).alias("validity"))


def noise_sensitivity(df: DataFrame, p: str, y: str, key: str, levels: Sequence[float], trials: int, bins: int = 10, seed: int = 342) -> DataFrame:
    """(noise, mean, std, n): calibration error over trials in which each label is flipped with the probability noise, by a hash of trial and key."""
    noise = F.explode(F.array(*(F.lit(float(x)) for x in levels)))
    drawn = df.withColumn("noise", noise).withColumn("__trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    flip = F.pmod(F.xxhash64(F.lit(seed), F.col("__trial"), F.col(key)), F.lit(1_000_000)) / 1_000_000.0 < F.col("noise")
    errors = ece(drawn.withColumn(y, F.when(flip, 1 - F.col(y)).otherwise(F.col(y))), p, y, bins, ["noise", "__trial"])
    return mean_and_deviation(errors, "ece", ["noise"])


def rescaled_by_em(df: DataFrame, p: str, pi_tr: float, rounds: int = 1000, tolerance: float = 1e-8) -> tuple[DataFrame, list[float]]:
    """(df with <p>_rescaled, the priors of all rounds): probabilities under the prior that EM finds for df, the training prior first.

    Null probabilities stay null. The training prior must lie between 0 and 1.
    """
    if not 0 < pi_tr < 1:
        raise ValueError("the training prior must lie between 0 and 1")
    scores = df.select(F.col(p).alias("__p")).where("__p is not null").persist()
    history = [pi_tr]
    try:
        for _ in range(rounds):
            a, b = F.col("__p") * (history[-1] / pi_tr), (1 - F.col("__p")) * ((1 - history[-1]) / (1 - pi_tr))
            now = scores.agg(F.avg(a / (a + b))).first()[0]
            if now is None:
                break
            history.append(now)
            if abs(now - history[-2]) < tolerance:
                break
    finally:
        scores.unpersist()
    a, b = F.col(p) * (history[-1] / pi_tr), (1 - F.col(p)) * ((1 - history[-1]) / (1 - pi_tr))
    return df.withColumn(f"{p}_rescaled", a / (a + b)), history


def settings_metrics(predictions: DataFrame, setting: Sequence[str], p: dict[str, str], y: str) -> DataFrame:
    """probe_metrics of every setting and every kind of prediction in one table: p gives the column of each kind."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("type"), F.col(c).cast("double").alias("p")) for k, c in p.items())))
    long = predictions.select(*setting, y, kinds.alias("k")).select(*setting, y, "k.type", "k.p")
    return probe_metrics(long, "p", y, [*setting, "type"])
