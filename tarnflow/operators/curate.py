"""Ground-truth curation: review tables, page attribution, synthetic probe records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def review_priority(df: DataFrame, document: str, confidence: str, pages: str, ranks: dict[str, int]) -> DataFrame:
    """df with priority (rank of the confidence times ten, plus one where several pages are named) and document_priority, its least in the document."""
    rank = F.create_map(*(x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))))
    p = F.coalesce(F.try_element_at(rank, F.col(confidence)), F.lit(max(ranks.values()) + 1)) * 10 + F.when(F.size(pages) > 1, 1).otherwise(0)
    return df.withColumn("priority", p).withColumn("document_priority", F.min("priority").over(Window.partitionBy(document)))


def review_table(rows: DataFrame, old: DataFrame | None, key: str, document: str, confidence: str, pages: str, ranks: dict[str, int], corrections: Sequence[str]) -> DataFrame:
    """review_priority with empty correction columns, carried over from an old review of the same key, sorted by document priority, document
    and priority: the table to be written for reviewers."""
    ready = review_priority(rows, document, confidence, pages, ranks)
    if old is None:
        filled = ready.withColumns({c: F.lit(None).cast("string") for c in corrections})
    else:
        last = old.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(*(F.max(c).alias(c) for c in corrections))
        filled = ready.join(last, F.col(key) == F.col("__k"), "left").drop("__k")
    return filled.orderBy("document_priority", document, "priority", key)


def apply_review(rows: DataFrame, review: DataFrame, key: str, order: str, fields: Sequence[tuple[str, str]], excluded: str) -> DataFrame:
    """rows without the excluded ones, each field replaced by its correction where one is given; of several reviews of a row the last stands."""
    last = review.groupBy(F.col(key).alias("__k")).agg(F.max(F.struct(order, excluded, *(c for _, c in fields))).alias("__r"))
    joined = rows.join(last, F.col(key) == F.col("__k"), "left").where(~F.coalesce(F.col(f"__r.{excluded}"), F.lit(False)))
    return joined.withColumns({f: F.coalesce(F.col(f"__r.{c}").cast(rows.schema[f].dataType), F.col(f)) for f, c in fields}).drop("__k", "__r")


def attribute_pages(scores: DataFrame, key: str, page: str, score: str, delta: float = 0.05) -> DataFrame:
    """(key, page, score, pages, tier): the best page, ties to the first; pages within delta of it; high for one, medium for two, else ambiguous."""
    best = scores.groupBy(key).agg(F.max(F.struct(F.col(score), (-F.col(page)).alias("m"))).alias("__b"))
    near = scores.join(best, key).where(F.col(score) >= F.col(f"__b.{score}") - delta)
    out = near.groupBy(key).agg(F.first(-F.col("__b.m")).cast("int").alias(page), F.round(F.first(f"__b.{score}"), 4).alias(score), F.array_sort(F.collect_set(page)).alias("pages"))
    return out.withColumn("tier", F.when(F.size("pages") == 1, "high").when(F.size("pages") == 2, "medium").otherwise("ambiguous"))


def pick_donor(rows: DataFrame, key: str, tiers: Sequence[tuple[str, Sequence[str]]], value: str, choice: Column) -> DataFrame:
    """rows with tier, donor_<key> and donor_<value>: of the finest tier (equal tier keys) that has a row of another value, the least by choice.

    Two aggregations per tier are enough, however large a group: its least row by choice, and the least among the rows of another value
    than that one's. A row takes the first unless it has the same value, then the second. Null values neither give nor take.
    """
    out = rows
    for name, keys in tiers:
        keys = list(keys)
        cand = rows.where(F.col(value).isNotNull()).select(*keys, F.struct(choice.alias("c"), F.col(value).alias("v"), F.col(key).alias("k")).alias("s"))
        best = cand.groupBy(*keys).agg(F.min("s").alias("b1"))
        if keys:
            second = cand.join(best, keys).where("s.v <> b1.v").groupBy(*keys).agg(F.min("s").alias("b2"))
            pool = best.join(second, keys, "left").select(*(F.col(k).alias(f"__{k}") for k in keys), "b1", "b2")
            out = out.join(pool, [F.col(k) == F.col(f"__{k}") for k in keys], "left").drop(*(f"__{k}" for k in keys))
        else:  # one row for all
            second = cand.crossJoin(F.broadcast(best)).where("s.v <> b1.v").agg(F.min("s").alias("b2"))
            out = out.crossJoin(F.broadcast(best.crossJoin(F.broadcast(second))))
        out = out.withColumn(f"__{name}", F.when(F.col(value).isNotNull(), F.when(F.col("b1.v") != F.col(value), F.col("b1")).otherwise(F.col("b2")))).drop("b1", "b2")
    tier = F.coalesce(*(F.when(F.col(f"__{n}").isNotNull(), F.lit(n)) for n, _ in tiers))
    chosen = F.coalesce(*(F.col(f"__{n}") for n, _ in tiers))
    return out.select(*rows.columns, tier.alias("tier"), chosen["k"].alias(f"donor_{key}"), chosen["v"].alias(f"donor_{value}"))
