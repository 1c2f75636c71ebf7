"""Which page of its paper a record stands on: fields are scored against page texts, tables narrow the choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions import measures
from tarnflow.functions.fuzzy import partial_ratio, token_set_ratio

#: what a missing field adds, neither for nor against a page
NEUTRAL = 0.5
#: letters from which the words of a field are compared instead of its letters in order
LONG_FIELD = 50


def field_score(field: Column, text: Column) -> Column:
    """0 to 1: how well a field stands in a text; 0.5 for fields that are null, empty or 'nan'."""

    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x = x.strip().lower() if isinstance(x, str) else ""
            if x in ("", "nan"):
                out.append(NEUTRAL)
                continue
            y = y.lower() if isinstance(y, str) else ""
            if x in y:
                out.append(1.0)
            else:
                out.append((token_set_ratio(x, y) if len(x) > LONG_FIELD else partial_ratio(x, y)) / 100)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(score, "double")(field, text)


def page_score(weights: Mapping[str, float], value: str, text: Column, numbers: Column) -> Column:
    """The weighted mean over fields; value is compared as a number where it is one, else as a text. Without weights 0."""
    total = sum(weights.values())
    if not total:
        return F.lit(0.0)
    parsed = measures.parse_numeric(F.col(value).cast("string")) if value in weights else F.lit(None).cast("double")

    def part(name: str) -> Column:
        plain = field_score(F.col(name).cast("string"), text)
        return F.when(parsed.isNotNull(), measures.numeric_score(parsed, numbers)).otherwise(plain) if name == value else plain

    return reduce(lambda x, y: x + y, (part(n) * w for n, w in weights.items())) / total


def attribute_pages(rows: DataFrame, pages: DataFrame, doc: str, key: str, weights: Mapping[str, float], value: str = "value", candidates: str | None = None, delta: float = 0.05) -> DataFrame:
    """(key, page_number array, page_score, page_confidence) of each row that has pages in its paper.

    pages: doc, page, text, and table_numbers (array<double> of the numbers in the page's table cells). A row is scored on its candidate
    pages, on all if it names none that exist; if its value stands in tables of some of them, only those count. The pages within delta
    of the best, best first and ties by page, are given, with the best score rounded to 4 places; one page is 'high', two 'medium', more 'ambiguous'.
    Rows are joined to the pages of their own paper only, and each row's pages are ordered by themselves. Null keys and papers give no rows.
    """
    some = F.col(candidates) if candidates else F.lit(None).cast("array<int>")
    asked = rows.where(F.col(key).isNotNull()).withColumn("__want", some)
    numbered = pages.select(doc, F.col("page").alias("__page"), F.col("text").alias("__text"), F.col("table_numbers").alias("__cells"), measures.numbers_in(F.col("text")).alias("__numbers"))
    both = asked.join(numbered, doc)
    v = measures.parse_numeric(F.col(value).cast("string"))
    hit = F.exists(F.coalesce("__cells", F.array().cast("array<double>")), lambda n: F.when(v == 0, F.abs(n) < 1e-12).otherwise(F.abs(n - v) / F.abs(v) <= 1e-4))
    both = both.withColumns({"__in": F.coalesce(F.array_contains("__want", F.col("__page")), F.lit(False)), "__hit": F.coalesce(hit, F.lit(False))})
    # of each row: whether a candidate exists, and whether a page to be looked at has the value in a table
    seen = both.groupBy(key).agg(F.max("__in").alias("__any"), F.max(F.col("__hit") & F.col("__in")).alias("__hit_in"), F.max("__hit").alias("__hit_any"))
    narrowed = both.join(seen, key).where((~F.col("__any") | F.col("__in")) & (~F.when(F.col("__any"), F.col("__hit_in")).otherwise(F.col("__hit_any")) | F.col("__hit")))
    scored = narrowed.select(key, "__page", page_score(weights, value, F.col("__text"), F.col("__numbers")).alias("__score"))
    packed = scored.groupBy(key).agg(F.array_sort(F.collect_set(F.struct((-F.col("__score")).alias("s"), F.col("__page").alias("p")))).alias("__all"))
    near = F.filter("__all", lambda x: x["s"] <= F.col("__all")[0]["s"] + delta)
    out = packed.select(key, F.transform(near, lambda x: x["p"]).alias("page_number"), F.round(-F.col("__all")[0]["s"], 4).alias("page_score"))
    return out.withColumn("page_confidence", confidence(F.size("page_number")))


def confidence(pages: Column) -> Column:
    return F.when(pages == 1, "high").when(pages == 2, "medium").otherwise("ambiguous")


def anchored(attributed: DataFrame, named: Column) -> DataFrame:
    """attributed with 'high' confidence where the record's location named a single table that one page holds."""
    return attributed.withColumn("page_confidence", F.when(named & (F.size("page_number") == 1), "high").otherwise(F.col("page_confidence")))


def scan_pages(contexts: DataFrame, doc: str, page: str, text: str, cells: Sequence[Column] | None = None) -> DataFrame:
    """pages() input of attribute_pages from one row per scan; of repeated pages the texts are one after the other."""
    one = contexts.where(F.col(doc).isNotNull() & F.col(page).isNotNull() & F.col(text).isNotNull())
    joined = one.groupBy(doc, F.col(page).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("text"))
    return joined.withColumn("table_numbers", F.array(*(cells or [])).cast("array<double>"))
