"""Filling missing values from similar records by hierarchical group statistics.

Levels go from the finest group to the coarsest. Each missing cell takes the median (numbers) or the mode (categories) of the
finest group that has enough present values, and keeps a flag and the level used. Statistics are pre-aggregated before the shuffle,
so a group with a third of all rows costs no more than any other, and only the missing rows are joined to them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.runtime import cut


def medians(present: DataFrame, keys: Sequence[str], value: str, accuracy: int = 10_000) -> DataFrame:
    """(keys, __stat, __support): the exact lower middle value of each group and its number of values.

    A sketch of bounded size gives the value itself for groups of up to accuracy / 2 values, and for larger ones two values between which
    the median must lie. Of those groups only the values in between, about four in accuracy of a group, are counted by value and
    ordered; the others are counted as one number.
    """
    keys, step = list(keys), 2.0 / accuracy
    sketched = present.groupBy(*keys).agg(F.percentile_approx(value, [0.5, 0.5 - step, 0.5 + step], accuracy).alias("__q"), F.count(F.lit(1)).alias("__support"))
    sketched = cut(sketched)
    small, large = sketched.where(F.col("__support") <= accuracy // 2), sketched.where(F.col("__support") > accuracy // 2)
    exact = small.select(*keys, F.col("__q")[0].alias("__stat"), "__support")
    if large.isEmpty():
        return exact
    bounds = large.select(*(F.col(k).alias(f"__b_{k}") for k in keys), F.col("__q")[1].alias("__lo"), F.col("__q")[2].alias("__hi"), "__support")
    on = [F.col(k) == F.col(f"__b_{k}") for k in keys]
    inside = present.join(bounds, on) if keys else present.crossJoin(F.broadcast(bounds))  # one row without keys
    inside = inside.where(F.col(value) <= F.col("__hi")).withColumn("__v", F.when(F.col(value) >= F.col("__lo"), F.col(value)))
    counted = inside.groupBy(*keys, "__support", "__v").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, 0)
    reached = counted.withColumn("__at", F.sum("__n").over(order)).where(F.col("__v").isNotNull() & (F.col("__at") >= F.ceil(F.col("__support") / 2)))
    return exact.unionByName(reached.groupBy(*keys, "__support").agg(F.min("__v").alias("__stat")).select(*keys, "__stat", "__support"))


def modes(present: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, __stat, __support): the most frequent value of each group, of equally frequent ones the least, and the number of values."""
    counted = present.groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col("__v").alias("v")))
    return counted.groupBy(*keys).agg(best["v"].alias("__stat"), F.sum("__n").alias("__support"))


def fill_from_groups(
    df: DataFrame, value: Column, levels: Sequence[tuple[str, Sequence[str], int]], kind: str, out: str = "filled", accuracy: int = 10_000, missing: Column | None = None
) -> DataFrame:
    """df with out, out_was_missing (boolean) and out_level (name of the level a filled cell came from, null for present cells).

    value: the cell, null where nothing usable is in it. levels: (name, key columns, least number of present values), finest first; a
    level with no keys is the whole table. kind: 'median' (the exact lower middle value) or 'mode' (ties: the least value). missing: which
    cells are missing, by default those with a null value; a cell that isn't missing and has no value stays as it is and counts for no group.

    A row whose key of a level is null has no group there and goes to the next level. A cell for which no level has support stays null,
    flagged and without level. Rows are neither dropped nor doubled, repeated rows are all kept, an empty table gives an empty one, and
    columns of the result's names in df are replaced. df is materialised once, as every level reads it.
    """
    if kind not in ("median", "mode"):
        raise ValueError(f"kind must be median or mode, not {kind}")
    flag, level = f"{out}_was_missing", f"{out}_level"
    gone = F.col("__value").isNull() if missing is None else F.coalesce(F.col("__missing"), F.lit(False))
    base = cut(df.withColumns({"__value": value, "__missing": missing if missing is not None else F.lit(False)}).drop(out, flag, level))
    present, lacking = base.where(F.col("__value").isNotNull() & ~gone), base.where(gone)
    stats = []
    for i, (_, keys, least) in enumerate(levels):
        keys = list(keys)
        usable = (present.dropna(subset=keys) if keys else present).select(*keys, "__value")
        stat = (medians(usable, keys, "__value", accuracy) if kind == "median" else modes(usable, keys, "__value")).where(F.col("__support") >= least)
        stat = stat.select(*(F.col(k).alias(f"__k{i}_{j}") for j, k in enumerate(keys)), F.col("__stat").alias(f"__s{i}"))
        stats.append(f"__s{i}")
        if keys:
            same = [F.col(k) == F.col(f"__k{i}_{j}") for j, k in enumerate(keys)]
            lacking = lacking.join(stat, same, "left").drop(*(f"__k{i}_{j}" for j in range(len(keys))))
        else:  # one row
            lacking = lacking.join(F.broadcast(stat), F.lit(True), "left")
    kept = [c for c in base.columns if c not in ("__value", "__missing")]
    named = F.coalesce(*(F.when(F.col(s).isNotNull(), F.lit(levels[i][0])) for i, s in enumerate(stats)))
    filled = lacking.select(*kept, F.coalesce(*stats).alias(out), F.lit(True).alias(flag), named.alias(level))
    return base.where(~gone).select(*kept, F.col("__value").alias(out), F.lit(False).alias(flag), F.lit(None).cast("string").alias(level)).unionByName(filled)
