"""Written attributes, units and numbers, read against a catalogue.

The catalogue decides what is known: its attribute names and the head of their descriptions become sets of words, its units become
products of unit symbols with powers. A written name or unit is read the same way and looked up, so a new catalogue row is
recognised in all its spellings. Reading is by Arrow batches in which each distinct spelling is parsed once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnflow.functions.values import EMPTY_WORDS, NUMBER, SUPERSCRIPTS

# Short forms and synonyms in names of measured attributes, as words in lower case.
WORDS = {
    "tot": "total", "t": "temperature", "temp": "temperature", "n": "nitrogen", "p": "phosphorus", "max": "depth max", "maximum": "max", "greatest": "max", "deepest": "depth max", "zmax": "depth max", "z": "depth",
    "surf": "surface", "horizontal": "surface", "open": "surface", "veg": "vegetation", "macrophyte": "vegetation", "macrophytes": "vegetation", "chl": "chlorophyll", "chla": "chlorophyll a", "cond": "conductivity", "conductance": "conductivity",
    "ec": "conductivity", "ec25": "conductivity", "tn": "total nitrogen", "tp": "total phosphorus", "secchi": "secchi depth", "disc": "secchi depth", "disk": "secchi depth", "transparency": "secchi depth",
}
#: words that tell nothing about which attribute is meant
FILLERS = {"of", "the", "in", "at", "water", "body", "column", "point", "specific", "itself", "share", "covered", "by", "no", "unit"}
# Unit words and their symbols; prefixes, and the symbols that take them.
UNIT_WORDS = {
    "metre": "m", "meter": "m", "gram": "g", "gramme": "g", "litre": "l", "liter": "l", "siemens": "s", "mole": "mol", "mol": "mol", "molar": "M", "celsius": "c", "fahrenheit": "f", "kelvin": "k", "oc": "c", "of": "f", "hectare": "ha", "acre": "ac", "foot": "ft", "feet": "ft", "mile": "mi",
    "percent": "%", "pct": "%", "fraction": "frac", "frac": "frac", "proportion": "frac", "share": "frac", "ratio": "frac", "second": "s", "hour": "h", "hr": "h", "day": "d", "year": "yr", "inch": "in", "yard": "yd", "volt": "v",
}
PREFIXES = {"nano": "n", "micro": "u", "milli": "m", "centi": "c", "deci": "d", "hecto": "h", "kilo": "k", "mega": "mega"}
PREFIXED = {"metre": "m", "meter": "m", "gram": "g", "gramme": "g", "litre": "l", "liter": "l", "siemens": "s", "mole": "mol", "mol": "mol", "molar": "M", "m": "m", "g": "g", "l": "l", "s": "s"}
#: beside units and not part of them
UNIT_FILLERS = {"deg", "degree", "degrees", "cover", "units", "unit", "as", "a", "the", "values"}
#: what stands in a units column and names none
NO_UNIT = {*EMPTY_WORDS, "see text", "see remarks", "see table", "unitless", "no unit", "no units", "dimensionless", "ph units", "ph unit", "ph", "standard units", "as text"}

_SPACES = re.compile("[\\s\u00a0\u2000-\u200b\u202f\u3000\ufeff]+")
_NUMBER = re.compile(NUMBER, re.S)
_SENTINEL = re.compile(r"-9{2,}(?:[.,]0+)?$")
_SUPER = str.maketrans(*SUPERSCRIPTS)
_SUFFIX = re.compile(r"^(.*?)\s*(?:\(([^()]*(?:\([^()]*\))?)\)|\[([^\[\]]*)\]|\s/\s+(.*)|\sin\s+(.*))$", re.S)
_REMARK = re.compile(r"(?:given in|reported in|expressed in|measured in|values (?:are )?in|values are|units?:)\s*([^;]+)", re.I)


def squeezed(text: str) -> str:
    return _SPACES.sub(" ", text).strip()


def attribute_words(name: str) -> frozenset[str]:
    """The set of words a written attribute consists of, short forms spelled out, order and fillers dropped."""
    text = unicodedata.normalize("NFKC", name).casefold()
    text = re.sub(r"\b([a-z])\.\s?([a-z])\.", r"\1\2", text)  # t.p.
    found = [w for t in re.findall(r"[^\W_]+", text) for w in WORDS.get(t, t).split()]
    kept = {w for w in found if w not in FILLERS}
    return frozenset(kept or found)


def unit_keys(text: str) -> list[str]:
    """Readings of a written unit, the likeliest first: a power of ten and symbols with powers. A text that is no unit gives itself."""
    s = unicodedata.normalize("NFKC", text)
    s = re.sub(r"[º°]|(?<![^\W_])o(?=[CF]\b)", " deg ", s.replace("−", "-").replace("×", " x ").replace("μ", "u").replace("µ", "u"))
    molar = re.search(r"(?:^|[^a-zA-Z])[unm]?M$", s.strip()) is not None
    s = s.casefold()
    s = re.sub(r"\bper[ -]?cents?\b", "percent", s)
    s = re.sub(r"\bparts per (million|billion)\b", lambda m: {"million": "ppm", "billion": "ppb"}[m.group(1)], s)
    s = re.sub(r"\b([a-z])\.(?=[a-z]\b)", r"\1", s).replace("%", " percent ")
    s = re.sub(r"\([\d\s.,–-]*\)", " ", s)
    power = re.match(r"^\s*(?:x|\*)?\s*10\s*\^?\s*([-+]?\d+)\s+", s)
    scale = int(power.group(1)) if power else 0
    s = s[power.end() :] if power else s
    parts, sign, factor = [], 1, 1
    for token in re.findall(r"/|[^\W\d_]+(?:\s?\^?\s?[-+]?\d+(?![^\W\d_]))?|\d+", s):
        if token in ("/", "per"):
            sign = -1
            continue
        m = re.match(r"([^\W\d_]+)\s?\^?\s?([-+]?\d+)?$", token)
        if not m or m.group(1) in UNIT_FILLERS:
            continue
        word, exponent = m.group(1), int(m.group(2) or 1)
        if word in ("sq", "square", "cubic", "cu"):
            factor = 3 if word.startswith("cu") else 2
            continue
        parts.append((_symbol(word), sign * exponent * factor))
        sign, factor = 1, 1
    if not parts:
        return [" ".join(s.split())]
    show = lambda ps: f"{scale};" + " ".join(f"{a}^{n}" for a, n in sorted(ps))
    spelled = show([(a.replace("M", "mol"), n) for a, n in parts])
    first, exponent = parts[0]
    if len(parts) > 1 or exponent != 1 or not re.fullmatch(r"[num]?[mM]", first):
        return [spelled]
    concentration = show([(first[:-1] + "mol", 1), ("l", -1)])
    if first.endswith("M"):
        return [concentration]
    return [concentration, spelled] if molar else [spelled, concentration]  # a capital M is read as molar first


def _symbol(word: str) -> str:
    for w in (word, word.removesuffix("s")):
        if w in UNIT_WORDS:
            return UNIT_WORDS[w]
        for prefix, short in PREFIXES.items():
            if w.startswith(prefix) and w[len(prefix) :] in PREFIXED:
                return short + PREFIXED[w[len(prefix) :]]
    return word


def number_of(text: str) -> tuple[float | None, str | None, str | None]:
    """(number, bound, what follows) of a written number: decimal commas, blanks and apostrophes between thousands, O and l for 0 and 1,
    powers of ten, spreads and ranges behind it (left out)."""
    m = _NUMBER.match(squeezed(text).translate(_SUPER))
    if not m:
        return None, None, None
    digits = re.sub(r"[' +]", "", m.group(2)).translate(str.maketrans("Ol,", "01."))
    power = re.search(r"(?:10 ?\^? ?|[eE])([-+]?[0-9]+)$", m.group(3) or "")
    try:
        number = float(f"{digits}e{int(power.group(1)) if power else 0}")
    except (ValueError, OverflowError):
        number = None
    if number is not None and number in (float("inf"), float("-inf")):
        number = None
    return number, (m.group(1) or "").lower() or None, (m.group(4) or "").strip() or None


def says_nothing(text: str) -> bool:
    return re.sub(r"^[(\[]\s*|\s*[)\]]$", "", squeezed(text).lower()) in NO_UNIT


@dataclass(frozen=True)
class Lexicon:
    """What a catalogue knows: attributes by their words, units by attribute and reading, and each attribute's common unit."""

    attributes: dict[frozenset[str], str] = field(default_factory=dict)
    units: dict[tuple[str, str], str] = field(default_factory=dict)
    common: dict[str, str | None] = field(default_factory=dict)
    unitless: frozenset[str] = frozenset()

    @classmethod
    def of(cls, rows: Iterable[tuple[str, str | None, str | None, bool | None]]) -> Lexicon:
        """rows: (attribute, description, unit, is_common). Of two attributes of the same words the lesser name stands."""
        attributes: dict[frozenset[str], str] = {}
        units: dict[tuple[str, str], str] = {}
        common: dict[str, str | None] = {}
        described: dict[frozenset[str], str] = {}
        unitless = set()
        for attribute, description, unit, is_common in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[2] or "", not r[3])):
            attributes.setdefault(attribute_words(attribute), attribute)
            head = re.split(r"\s+(?:of|at|in|on)\s+the\b|,|\(", description or "")[0]
            if any(w not in FILLERS for t in re.findall(r"[^\W_]+", head.casefold()) for w in WORDS.get(t, t).split()):
                described.setdefault(attribute_words(head), attribute)
            common.setdefault(attribute, None)
            if unit is not None:
                units.setdefault((attribute, unit_keys(unit)[0]), unit)
                if is_common:
                    common[attribute] = unit
            elif is_common:
                unitless.add(attribute)
        for words, attribute in described.items():
            attributes.setdefault(words, attribute)
        return cls(attributes, units, common, frozenset(unitless))

    def attribute(self, name: str) -> tuple[str | None, str | None, str]:
        """(catalogue attribute, unit text behind the name, the words of the name without a unit)"""
        text = squeezed(name)
        words = attribute_words(text)
        whole = self.attributes.get(words)
        m = _SUFFIX.match(text)
        if m:
            inner = self.attributes.get(attribute_words(m.group(1)))
            suffix = next((g.strip() for g in m.groups()[1:] if g and g.strip()), None)
            # what stands in brackets may belong to the name, as in depth (max)
            if inner is not None and (whole is None or suffix and self.unit(inner, suffix)[0] is not None):
                return inner, suffix, " ".join(sorted(attribute_words(m.group(1))))
        if whole is not None:
            return whole, None, " ".join(sorted(words))
        return None, None, " ".join(sorted(words))

    def unit(self, attribute: str | None, text: str) -> tuple[str | None, str]:
        """(the catalogue's spelling for the attribute, None if it has no such unit; the first reading)"""
        keys = unit_keys(text)
        return next((self.units[attribute, k] for k in keys if (attribute, k) in self.units), None) if attribute else None, keys[0]


READ = "attribute_std string, about string, num double, bound string, missing boolean, row_unit string, row_unit_source string, common_unit string"


def _factor(s: pd.Series) -> tuple[list[int], list[str]]:
    codes, texts = pd.factorize(s)
    return codes.tolist(), [t if isinstance(t, str) else "" for t in texts]


def read(lexicon: Lexicon, attribute: Column, value: Column, units: Column, remarks: Column) -> Column:
    """struct READ of a measurement row.

    The unit is taken from the units column, behind the value, behind the attribute or in the remarks, in this order; the first of them
    that says anything stands. row_unit is its catalogue spelling, null where the catalogue has no such unit for the attribute, and then
    row_unit_source is 'unknown'; without any statement both are null. missing: the cell has no number, or a negative all-nines stand-in.
    about is the attribute, outside the catalogue the words of its name and the reading of its unit. Nulls in any column are allowed.
    """

    def batch(attribute: pd.Series, value: pd.Series, units: pd.Series, remarks: pd.Series) -> pd.DataFrame:
        ac, at = _factor(attribute)
        vc, vt = _factor(value)
        uc, ut = _factor(units)
        rc, rt = _factor(remarks)
        names = [lexicon.attribute(t) for t in at]
        numbers = [(*number_of(t), not any(c.isdigit() for c in t) or _SENTINEL.match(squeezed(t).translate(_SUPER)) is not None) for t in vt]
        said = [None if says_nothing(t) else t for t in ut]
        noted = [None if m is None or says_nothing(m.group(1)) else m.group(1).strip() for m in (_REMARK.search(t) for t in map(squeezed, rt))]
        known: dict[tuple[str | None, str], tuple[str | None, str]] = {}
        out = []
        for a, v, u, r in zip(ac, vc, uc, rc):
            std, suffix, words = names[a] if a >= 0 else (None, None, "")
            num, bound, rest, empty = numbers[v] if v >= 0 else (None, None, None, True)
            unit = source = None
            reading = ""
            for text, where in ((said[u] if u >= 0 else None, "units"), (rest, "value"), (suffix, "attribute"), (noted[r] if r >= 0 else None, "remark")):
                if text:
                    got = known.get((std, text))
                    if got is None:
                        got = known[std, text] = lexicon.unit(std, text)
                    unit, reading = got
                    source = where if unit is not None else "unknown"
                    break
            missing = empty or num is None
            out.append((std, std or f"{words}\u0001{reading}", None if missing else num, bound, missing, unit, source, lexicon.common[std] if std else None))
        return pd.DataFrame(out, columns=["attribute_std", "about", "num", "bound", "missing", "row_unit", "row_unit_source", "common_unit"])

    batch.__annotations__ = {"attribute": pd.Series, "value": pd.Series, "units": pd.Series, "remarks": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(batch, READ)(attribute, value, units, remarks)
