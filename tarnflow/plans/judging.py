"""Prompts for judges and the reading of their replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fields(names: list[str]) -> Column:
    return F.concat_ws(", ", *(F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}: "), F.col(n).cast("string"))) for n in names))


def judge_query(entity: list[str], event: list[str], attribute: str, value: str, units: str) -> Column:
    """Sections parted by blank lines: entity, attribute, event where any of its fields is known, value and units, the question."""
    event_text = _fields(event)
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Entity: "), _fields(entity)),
        F.concat(F.lit("Attribute: "), F.col(attribute)),
        F.when(event_text != "", F.concat(F.lit("Event: "), event_text)),
        F.concat(F.lit("Value: "), F.coalesce(value, F.lit("none")), F.lit("\nUnits: "), F.coalesce(units, F.lit("not reported"))),
        F.lit("Is this extraction correct? Answer true or false."),
    )


def verdict(reply: Column) -> Column:
    """true where the reply says true, else false where it says false, else null."""
    low = F.lower(reply)
    return F.when(low.contains("true"), True).when(low.contains("false"), False)
