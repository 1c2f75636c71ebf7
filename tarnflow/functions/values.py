"""Numbers and empty cells as they are written in measurement tables.

All functions are Column expressions, so they run inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that say nothing, after lower() and removal of the outer white space and brackets.
EMPTY_WORDS = [
    "", "-", "--", "–", "—", "?", "*", "x", ".", "..", "...", "na", "n/a", "n.a.", "nan", "none", "null", "nil", "nd", "n.d.",
    "unknown", "unspecified", "undetermined", "blank", "empty", "missing", "no data", "no value", "not given", "not stated", "not reported", "not measured",
    "not available", "not applicable", "not known", "not determined", "not recorded", "tbd",
]

SUPERSCRIPTS = ("⁻⁺⁰¹²³⁴⁵⁶⁷⁸⁹−", "-+0123456789-")
SPACES = r"[\s\x{00A0}\x{2000}-\x{200B}\x{202F}\x{3000}\x{FEFF}]+"
_NUM = r"[0-9Ol]{1,9}(?:[' ][0-9Ol]{3})+(?:[.,][0-9Ol]*)?|[0-9Ol]+(?:[.,][0-9Ol]*)?|[.,][0-9Ol]+"
_EXP = r"(?: ?[x×*] ?10 ?\^? ?[-+]?[0-9]+|[eE][-+]?[0-9]+)"
#: groups: bound, number, exponent, what follows (a unit, if anything)
NUMBER = (
    r"^(<|>|≤|≥|(?i:below|above|under|over)(?= )|)(?: ?(?:[~≈]|(?i:ca|c|approx|approximately|about)\b\.?))? ?([-+]?(?:" + _NUM + r"))(" + _EXP + r"?)"
    r"(?: ?(?:±|\+/-) ?(?:" + _NUM + ")" + _EXP + r"?)?(?: ?\( ?[-+]?(?:" + _NUM + r") ?(?:to|-|–|—) ?[-+]?(?:" + _NUM + r") ?\))?(?: ?(.*))$"
)


def squeezed(c: Column) -> Column:
    """Outer white space removed, inner runs (no-break spaces included) made one blank."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def is_empty_word(c: Column) -> Column:
    """Null, blank, or a stand-in that says nothing. Never null itself."""
    word = F.regexp_replace(F.lower(squeezed(c)), r"^[(\[]\s*|\s*[)\]]$", "")
    return c.isNull() | F.coalesce(word.isin(EMPTY_WORDS), F.lit(True))


def number_struct(c: Column) -> Column:
    """struct(num double, bound string, unit string) of a written number; num is null where none is written.

    Reads decimal commas and points, blanks and apostrophes between thousands, O and l for 0 and 1, powers of ten,
    spreads and ranges behind the number (left out), bounds before it, and a unit after it.
    """
    plain = F.translate(squeezed(c), *SUPERSCRIPTS)
    split = F.split(F.regexp_replace(plain, NUMBER, "\u0001$1\u0001$2\u0001$3\u0001$4"), "\u0001")
    got = F.size(split) == 5
    part = lambda i: F.when(got, F.get(split, F.lit(i)))
    digits = F.translate(F.regexp_replace(part(2), r"[' +]", ""), "Ol,", "01.")
    power = F.coalesce(F.regexp_extract(part(3), r"(?:10 ?\^? ?|[eE])([-+]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.struct(
        F.concat(digits, F.lit("e"), power.cast("string")).try_cast("double").alias("num"),
        F.nullif(F.lower(part(1)), F.lit("")).alias("bound"),
        F.nullif(F.trim(part(4)), F.lit("")).alias("unit"),
    )
