"""Duplicate measurements of one entity, attribute and event, merged with their provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_fit(df: DataFrame, group: Sequence[str], value: str, units: str, order: Sequence[str], provenance: Sequence[str], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """(group, value, units, provenance array): rows of a group taken in order, each joined to the first kept value it equals.

    Two values are equal if both are numbers with |a - kept| <= atol + rtol |kept|, else if their texts are equal without case and outer
    white space; units must be equal the same way. Equality of numbers isn't transitive, so the order counts. Equal texts are merged before
    rows of a group meet, and a group is parted where two neighbouring numbers are too far apart for any values across the gap to be equal;
    only such a part, or the rows of one text, meet in a task.
    """
    norm = lambda c: F.lower(F.trim(c.cast("string")))
    keys = list(group)
    row = F.struct(*(F.col(o) for o in order), *(F.col(p) for p in provenance if p not in order))
    texts = df.groupBy(*keys, norm(F.col(value)).alias("__v"), norm(F.col(units)).alias("__u")).agg(
        F.min(F.struct(*order, F.col(value).alias("value"), F.col(units).alias("units"))).alias("__first"), F.collect_list(row).alias("__rows")
    )
    number = F.col("__v").try_cast("double")
    texts = texts.withColumn("__x", F.when(~F.isnan(number), number))
    # equal values lie within the tolerance of the kept one; neighbours further apart than that of the greater part a group
    near = Window.partitionBy(*keys, "__u").orderBy("__x")
    gap = F.col("__x") - F.lag("__x").over(near)
    opens = F.when(gap <= 1.001 * (atol + rtol * F.greatest(F.abs("__x"), F.abs(F.lag("__x").over(near)))), 0).otherwise(1)
    numbers = texts.where("__x is not null").withColumn("__open", opens).withColumn("__part", F.sum("__open").over(near.rowsBetween(Window.unboundedPreceding, 0)).cast("string")).drop("__open")
    texts = numbers.unionByName(texts.where("__x is null").withColumn("__part", F.concat(F.lit("t"), F.coalesce("__v", F.lit("")), F.col("__v").isNull().cast("string"))))
    item = F.struct(F.col("__first"), F.col("__v").alias("v"), F.col("__u").alias("u"), F.col("__v").try_cast("double").alias("n"), F.col("__rows").alias("rows"))
    folded = texts.groupBy(*keys, "__u", "__part").agg(F.array_sort(F.collect_list(item)).alias("__items"))

    def same(kept: Column, x: Column) -> Column:
        numbers = kept["n"].isNotNull() & x["n"].isNotNull()
        return F.when(numbers, F.abs(x["n"] - kept["n"]) <= atol + rtol * F.abs(kept["n"])).otherwise(kept["v"].eqNullSafe(x["v"])) & kept["u"].eqNullSafe(x["u"])

    def add(kept: Column, x: Column) -> Column:
        at = F.get(F.filter(F.sequence(F.lit(0), F.greatest(F.size(kept) - 1, F.lit(0))), lambda i: same(F.get(kept, i), x)), F.lit(0))
        merged = F.transform(kept, lambda k, i: F.when(i == at, k.withField("rows", F.concat(k["rows"], x["rows"]))).otherwise(k))
        return F.when((F.size(kept) == 0) | at.isNull(), F.concat(kept, F.array(x))).otherwise(merged)

    empty = F.filter(F.col("__items"), lambda x: F.lit(False))
    out = folded.select(*keys, F.explode(F.aggregate("__items", empty, add)).alias("k"))
    return out.select(*keys, F.col("k.__first.value").alias("value"), F.col("k.__first.units").alias("units"), F.array_sort("k.rows").alias("provenance"))
