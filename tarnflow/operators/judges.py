"""Judgements of several judges: discovery, merge, votes, replies, chat entries, and the human judge's progress."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions import markup

COMBINED = "combined"


def discover(runs: DataFrame, judge: str = "judge", date: str = "run_date", path: str = "path") -> DataFrame:
    """(judge, run_date, path): of each judge but the combined one its latest run; runs without a path don't count."""
    usable = runs.where(F.col(path).isNotNull() & F.col(judge).isNotNull() & (F.col(judge) != COMBINED))
    return usable.groupBy(judge).agg(F.max(F.struct(date, path)).alias("r")).select(judge, f"r.{date}", f"r.{path}")


def suffixed(df: DataFrame, columns: Sequence[str], judge: str) -> DataFrame:
    """df with the columns that it has of these named <column>_<judge>."""
    return df.withColumnsRenamed({c: f"{c}_{judge}" for c in columns if c in df.columns})


def merge(judged: dict[str, DataFrame], key: str, base: Sequence[str], own: Sequence[str]) -> DataFrame:
    """One row per key that any judge has: base columns from the first judge that has the key, and each judge's own columns with its name.

    A full outer join on key; of repeated keys of one judge one row counts. A judge that lacks a key gives nulls.
    """
    parts = []
    for i, (judge, df) in enumerate(judged.items()):
        one = df.where(F.col(key).isNotNull()).select(key, F.struct(*base).alias(f"__b{i}"), *(F.col(c).alias(f"{c}_{judge}") for c in own)).dropDuplicates([key])
        parts.append(one)
    joined = reduce(lambda a, b: a.join(b, key, "full"), parts)
    first = F.coalesce(*(F.col(f"__b{i}") for i in range(len(parts))))
    return joined.select(key, *(first[c].alias(c) for c in base), *(f"{c}_{j}" for j in judged for c in own))


def combined_vote(merged: DataFrame, voting: Sequence[str], prefix: str = "judgement", least: int | None = None) -> DataFrame:
    """merged with judgement_combined: yes votes of the voting judges that are there reach least, by default half of them rounded up."""
    present = [j for j in voting if f"{prefix}_{j}" in merged.columns]
    if not present:
        raise ValueError(f"none of the voting judges {list(voting)} has judged")
    yes = reduce(lambda a, b: a + b, (F.coalesce(F.col(f"{prefix}_{j}"), F.lit(False)).cast("int") for j in present))
    return merged.withColumn(f"{prefix}_combined", yes >= (least if least is not None else -(-len(present) // 2)))


def reply_vote(reply: Column) -> Column:
    """A judge's reply as a vote: true where it says so anywhere, else false where it says so, else null."""
    low = F.lower(reply)
    return F.when(low.contains("true"), True).when(low.contains("false"), False)


def token_vote(reply: Column) -> Column:
    """A reply of one token as a vote; all but true, a missing reply included, is false."""
    return F.coalesce(F.lower(reply).contains("true"), F.lit(False))


def with_reference(rows: DataFrame, other: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """rows with the other side's column by key under name, null where it has none; repeated keys take the greatest value."""
    one = other.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max(column).alias(name))
    return rows.drop(name).join(one, F.col(key) == F.col("__k"), "left").drop("__k")


def chat_entries(rows: DataFrame, documents: DataFrame, attributes: DataFrame, doc: str, attribute: str, text: str, pages: str, prompt: Column, dropped: Sequence[str] = ()) -> DataFrame:
    """rows of known papers and attributes with context and prompt, sorted within partitions by paper.

    context is the named pages of the paper's text, the whole text where none is named or there. Columns of dropped are left out of the result.
    """
    known = rows.join(attributes.select(attribute).distinct(), attribute, "left_semi").join(documents.where(F.col(text).isNotNull()).select(doc, F.col(text).alias("__text")), doc)
    wanted = F.coalesce(F.filter(F.col(pages), lambda p: p.isNotNull()), F.array().cast(rows.schema[pages].dataType))
    out = known.select(*(c for c in rows.columns if c not in dropped), markup.pages_or_whole(F.col("__text"), wanted).alias("context"), prompt.alias("prompt"))
    return out.repartition(doc).sortWithinPartitions(doc)


def sections(instructions: Column, context: Column, query: Column) -> Column:
    """struct(text, and begin and end of each section in characters from 0) of a prompt of three headed parts; null parts are empty."""
    parts = {"instructions": instructions, "context": context, "query": query}
    text, at, spans = F.lit(""), F.lit(0), {}
    for i, (name, body) in enumerate(parts.items()):
        head = ("" if i == 0 else "\n\n") + f"## {name.upper()}\n"
        filled = F.coalesce(body, F.lit(""))
        begin = at + len(head)
        at = begin + F.length(filled)
        text = F.concat(text, F.lit(head), filled)
        spans[name] = F.struct(begin.alias("begin"), at.alias("end"))
    return F.struct(text.alias("text"), *(s.alias(n) for n, s in spans.items()))


# What a human judge may answer, and the kinds of error of an invalid record.
ANSWERS = ["valid", "invalid", "skip"]
ERRORS = ["hallucination", "disorientation", "deviation"]


def human_progress(sample: DataFrame, answers: DataFrame, key: str, answer: str, at: str, error: str) -> tuple[DataFrame, DataFrame]:
    """(rows still to be judged, one row of counts): the last answer of each key stands; unknown answers are none, errors count for 'invalid' only."""
    last = answers.where(F.col(answer).isin(ANSWERS)).groupBy(key).agg(F.max(F.struct(at, answer, error)).alias("a")).select(key, f"a.{answer}", f"a.{error}")
    done = sample.select(key).distinct().join(last, key, "left")
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    counts = done.agg(
        F.count(F.lit(1)).alias("total"), *(one(F.col(answer) == a).alias(a) for a in ANSWERS), one(F.col(answer).isNull()).alias("open"),
        *(one((F.col(answer) == "invalid") & (F.col(error) == e)).alias(e) for e in ERRORS),
    )
    return sample.join(last.select(key), key, "left_anti"), counts
