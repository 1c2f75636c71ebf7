"""Duplicates hidden by formatting: Merkle-style hashing of nested records.

Leaves are normalised and hashed, the digests of an unordered node's children are sorted before they are hashed in turn, and rows are
grouped by the root digest. Every group of more than one row is confirmed by comparing its normalised records in full, which also parts
different records that share a digest.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions import names as N

#: what parts the entries of a list in one string
LIST_SEPARATORS = r"[,;/|\n]"


def record(fields: Mapping[str, str]) -> tuple[Column, Column]:
    """(root digest, normalised record) of columns that are a 'leaf' or an unordered 'list'; null equals empty."""
    digests, whole = [], []
    for name, kind in fields.items():
        leaves = F.array(N.bare(F.col(name))) if kind == "leaf" else F.array_sort(N.list_parts(F.col(name), LIST_SEPARATORS))
        whole.append(leaves)
        digests.append(F.xxhash64(F.array_sort(F.transform(leaves, lambda x: F.xxhash64(x))), F.size(leaves)))
    return F.xxhash64(*digests), F.to_json(F.struct(*(w.alias(f"f{i}") for i, w in enumerate(whole))))


def copy_classes(rows: DataFrame, key: str, fields: Mapping[str, str]) -> DataFrame:
    """(key, first, copies): for each row the least key of its set and the number of rows in it; one row per row with a key.

    fields: column -> 'leaf' or 'list'. Ignored are white space, case, punctuation and the order of a list's parts; how often a part occurs
    counts. Rows that are empty in all fields are one set. Rows with a null key are left out; repeated keys count as rows of
    their own. An empty table gives an empty one; other columns, whatever their names, play no part.
    """
    digest, whole = record(fields)
    usable = rows.where(F.col(key).isNotNull())
    groups = usable.select(F.col(key).alias("__key"), digest.alias("__digest")).groupBy("__digest").agg(F.min("__key").alias("__first"), F.count(F.lit(1)).alias("__n"))
    alone = groups.where("__n = 1").select(F.col("__first").alias(key), F.col("__first").alias("first"), F.lit(1).cast("bigint").alias("copies"))
    # only rows that share a digest are compared in full, by their normalised records
    shared = usable.select(F.col(key).alias("__key"), digest.alias("__digest"), whole.alias("__whole")).join(groups.where("__n > 1").select("__digest"), "__digest", "left_semi")
    sets = shared.groupBy("__digest", "__whole").agg(F.min("__key").alias("__first"), F.count(F.lit(1)).alias("__copies"))
    joined = shared.join(sets, ["__digest", "__whole"])
    return alone.unionByName(joined.select(F.col("__key").alias(key), F.col("__first").alias("first"), F.col("__copies").alias("copies")))


def collapsed(rows: DataFrame, key: str, fields: Mapping[str, str]) -> DataFrame:
    """The first row of each set, all its columns kept, with its number of copies (a column copies of rows is replaced)."""
    classes = copy_classes(rows, key, fields).where(F.col(key) == F.col("first")).select(F.col(key).alias("__key"), F.col("copies").alias("__copies")).distinct()
    return rows.drop("copies").join(classes, F.col(key) == F.col("__key")).drop("__key").withColumnRenamed("__copies", "copies").dropDuplicates([key])
