"""Scalar functions on written numbers, units, dates and locations of extracted measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Superscript digits and signs with their plain forms.
SUPERSCRIPTS = ("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
#: inside brackets: white space, the no-break and narrow blanks between thousands included, which \s leaves out
BLANKS = r"\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: a power of ten behind its sign of multiplication, the exponent bare, raised, or in braces
POWER = rf"[×x][{BLANKS}]*10\^?\{{?([-+]?[0-9]+)\}}?"
#: a number within a text: a sign, digits, one part behind a point or comma, an exponent
IN_TEXT = r"[-−]?[0-9]+(?:[.,][0-9]+)?(?:[eE][-+]?[0-9]+)?"
FLOAT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def with_exponents(c: Column) -> Column:
    """Powers of ten as e-notation, superscripts and the minus sign as plain characters."""
    return F.translate(F.regexp_replace(F.translate(c, *SUPERSCRIPTS), POWER, "e$1"), "−", "-")


def parse_numeric(c: Column) -> Column:
    """A written number as double, decimal commas and O / l for 0 / 1 allowed; null where it is none."""
    s = F.regexp_replace(with_exponents(F.regexp_replace(c, rf"^[{BLANKS}]+|[{BLANKS}]+$", "")), rf"['{BLANKS}]+", "")
    s = F.translate(F.regexp_replace(s, r"(\d),(\d)", "$1.$2"), "Ol", "01")
    return F.when(s.rlike(FLOAT), s.try_cast("double"))


def numbers_in(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(with_exponents(text), F.lit(IN_TEXT), F.lit(0)), parse_numeric), lambda x: x.isNotNull())


def numeric_score(value: Column, numbers: Column, rtol: float = 1e-4) -> Column:
    """1.0 where a number is within rtol of value, else the best 1 / (1 + relative error), at least 0.1; 0 needs a zero."""
    relative = lambda n: F.abs(n - value) / F.abs(value)
    closest = F.array_min(F.transform(numbers, relative))
    score = F.when(closest <= rtol, 1.0).otherwise(F.greatest(F.lit(0.1), 1 / (1 + closest)))
    return F.when(value == 0, F.when(F.exists(numbers, lambda n: F.abs(n) < 1e-12), 1.0).otherwise(0.1)).otherwise(F.coalesce(score, F.lit(0.1)))


def table_numbers(detail: Column) -> Column:
    """Numbers of the tables a location names; null if it names none."""
    lists = F.regexp_extract_all(F.lower(detail), F.lit(r"\btables?\s((?:[\s;,]*[0-9]+)+)"), F.lit(1))
    numbers = F.filter(F.split(F.array_join(lists, ";"), "[^0-9]+"), lambda n: n != "")
    return F.when(F.size(numbers) > 0, F.transform(numbers, lambda n: n.try_cast("int")))


# Units written in small letters, and the powers that are raised.
SMALL_UNITS = {"l": "L", "ml": "mL", "y": "yr"}
RAISED = ("123", "¹²³")


def _parts(c: Column) -> Column:
    """array of struct(unit, power, element) of the words of a unit: 'm-2' has a power, 'nmol-n' an element, others only a unit."""

    def part(word: Column) -> Column:
        unit, behind = F.substring_index(word, "-", 1), F.when(word.contains("-"), F.substring(word, F.instr(word, "-") + 1, F.length(word)))
        power = F.when(behind.rlike("^[0-9]"), behind)
        return F.struct(unit.alias("unit"), power.alias("power"), F.when(power.isNull(), behind).alias("element"))

    return F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), part)


def normalized_units(c: Column) -> Column:
    """'nmol-n g-1 h-1' as 'nmol N g⁻¹ h⁻¹': powers of 1 to 3 raised, elements as words of their own, micro as µ."""
    small = F.create_map(*(F.lit(x) for pair in SMALL_UNITS.items() for x in pair))

    def written(p: Column) -> Column:
        raised = F.when(p["power"].isin(*RAISED[0]), F.concat(F.lit("⁻"), F.translate(p["power"], *RAISED))).otherwise(F.concat(F.lit("-"), p["power"]))
        below = F.concat(F.coalesce(F.try_element_at(small, F.lower(p["unit"])), p["unit"]), raised)
        amount = F.concat_ws(" ", F.regexp_replace(p["unit"], "^[uU](?=.)", "µ"), F.upper(p["element"]))
        return F.coalesce(below, F.when(p["element"].isNotNull(), amount), p["unit"])

    return F.when(c.isNotNull(), F.array_join(F.transform(_parts(c), written), " "))


# What a rate is taken over, by the denominators that tell it, the first kind that matches.
DENOMINATORS = {"mass": ["g⁻¹", "kg⁻¹"], "areal": ["m⁻²", "cm⁻²"], "volumetric": ["l⁻¹", "m⁻³", "ml⁻¹", "cm⁻³"]}


def rate_kind(units: Column) -> Column:
    """mass, areal, volumetric or generic, by the denominators of a normalised unit, in this order."""
    words = F.split(F.lower(units), " ")
    kinds = F.array(*(F.when(F.arrays_overlap(words, F.array(*map(F.lit, ds))), F.lit(k)) for k, ds in DENOMINATORS.items()))
    return F.coalesce(F.get(F.filter(kinds, lambda k: k.isNotNull()), F.lit(0)), F.lit("generic"))


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY, YYYY-mm or YYYY-mm-dd, as far as the parts are known."""
    y, m, d = F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")
    return F.when(year.isNull(), None).when(month.isNull(), y).when(day.isNull(), F.concat_ws("-", y, m)).otherwise(F.concat_ws("-", y, m, d))


def page_list(c: Column) -> Column:
    """'[1, 2.0]' as array<int>; null if any part is no number."""
    parts = F.transform(F.split(F.regexp_replace(c, r"[\[\]\s]", ""), ","), lambda p: p.try_cast("double").cast("int"))
    return F.when(~F.exists(parts, lambda p: p.isNull()), parts)


def central_value(c: Column) -> Column:
    """The value proper of 'a ± b', 'a (b-c)' and '< a'."""
    s = F.regexp_replace(F.regexp_replace(c, rf"[{BLANKS}]*(?:±|\+/-).*$", ""), rf"[{BLANKS}]*\(.*\)[{BLANKS}]*$", "")
    return F.regexp_replace(s, rf"^[{BLANKS}]*(?:[<>≤≥~]|ca\.|approx\.|below|above)[{BLANKS}]*|[{BLANKS}]+$", "")
