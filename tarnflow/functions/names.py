"""Comparable forms of names and of lists kept in one string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: everything that is neither letter, mark nor digit
FORMATTING = r"[^\p{L}\p{M}\p{N}]+"


def bare(c: Column) -> Column:
    """Lower case without white space and punctuation; null becomes ''."""
    return F.coalesce(F.regexp_replace(F.lower(c), FORMATTING, ""), F.lit(""))


def words(c: Column) -> Column:
    """Lower case with one blank for each run of white space and punctuation; null becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(c), FORMATTING, " ")), F.lit(""))


def list_parts(c: Column, separators: str) -> Column:
    """Bare parts of a list in one string, in the order written, empty parts left out; null becomes an empty array."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), separators), bare)
    return F.filter(parts, lambda x: x != "")
