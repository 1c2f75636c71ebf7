"""Queries of the problems solved in the core: p1 (filling), p3 (units), p4 (wide tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions import names as N
from tarnflow.functions import values as V
from tarnflow.operators import impute, units, widen
from tarnflow.runtime import bounded_rows, cut
from tarnflow.sources.tables import table

LEAST_SUPPORT = 3
MEASURED = ["document_id", "attribute", "value", "units", "additional_details"]


def _converted(spark: SparkSession, d: str, more=()) -> DataFrame:
    """extraction_values, each item as it was delivered last, in common units."""
    items = units.latest_deliveries(table(spark, d, "extraction_values"), [*MEASURED, *more])
    return units.to_common_units(items, table(spark, d, "papers"), table(spark, d, "attribute_catalogue"), ["item_id", "document_id", *more])


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    """Every item once, its value in the unit its attribute is compared in, with missing values filled and flagged.

    Attributes of the catalogue are filled in common units; of the others only values whose stated unit is the same are
    compared, and a missing value without a unit takes the unit that its attribute has most often.
    """
    rows = _converted(spark, d, ["name", "date"])
    rows = rows.select(
        "item_id", "document_id", "attribute_std", "about", "missing", F.when(F.col("attribute_std").isNotNull(), F.col("value_common")).otherwise(F.col("num")).alias("comparable"),
        F.nullif(N.bare(F.col("name")), F.lit("")).alias("water_body"), F.nullif(F.regexp_extract("date", r"([0-9]{4})", 1), F.lit("")).alias("year"),
    )
    rows = cut(rows)
    # names outside the catalogue carry the reading of their unit behind \u0001
    bare = F.substring_index("about", "\u0001", 1)
    outside = rows.where("attribute_std is null and not missing").select(bare.alias("__bare"), F.col("about").alias("__usual"))
    usual = impute.modes(outside, ["__bare"], "__usual").select("__bare", F.col("__stat").alias("__usual"))
    unstated = F.col("missing") & F.col("attribute_std").isNull() & F.col("about").endswith("\u0001")
    completed = rows.where(unstated).join(usual, bare == F.col("__bare"), "left").withColumn("about", F.coalesce("__usual", "about")).select(*rows.columns)
    rows = rows.where(~unstated).unionByName(completed)
    levels = [
        ("water body and year", ["about", "water_body", "year"], LEAST_SUPPORT),
        ("water body", ["about", "water_body"], LEAST_SUPPORT),
        ("paper and year", ["about", "document_id", "year"], LEAST_SUPPORT),
        ("paper", ["about", "document_id"], LEAST_SUPPORT),
        ("year", ["about", "year"], LEAST_SUPPORT),
        ("attribute", ["about"], 1),
    ]
    filled = impute.fill_from_groups(rows, F.col("comparable"), levels, "median", out="value_filled", missing=F.col("missing"))
    return filled.select("item_id", "attribute_std", F.round("value_filled", 6).alias("value_filled"), "value_filled_was_missing", "value_filled_level")


def p1_ecosystems(spark: SparkSession, d: str) -> DataFrame:
    """entities with missing ecosystems filled and flagged; singular, lower-case types."""
    rows = table(spark, d, "entities").select(
        "row_id", "document_id", "ecosystem", F.nullif(N.bare(F.col("name")), F.lit("")).alias("water_body"),
        F.nullif(F.array_join(F.array_sort(N.list_parts(F.col("location"), r"[,;/|]")), "|"), F.lit("")).alias("place"),
    )
    kind = F.regexp_replace(F.lower(V.squeezed(F.col("ecosystem"))), r"(?<=[a-z]{3})s$", "")
    value = F.when(~V.is_empty_word(F.col("ecosystem")), kind)
    levels = [("water body and place", ["water_body", "place"], 1), ("water body", ["water_body"], 1), ("paper", ["document_id"], LEAST_SUPPORT), ("place", ["place"], LEAST_SUPPORT), ("all", [], 1)]
    filled = impute.fill_from_groups(rows, value, levels, "mode", out="ecosystem_filled")
    return filled.select("row_id", "ecosystem_filled", "ecosystem_filled_was_missing", "ecosystem_filled_level")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The cells that were missing and now hold a value."""
    values = p1_values(spark, d).where("value_filled_was_missing and value_filled is not null").select(F.lit("value").alias("field"), F.col("item_id").alias("row_key"))
    kinds = p1_ecosystems(spark, d).where("ecosystem_filled_was_missing and ecosystem_filled is not null").select(F.lit("ecosystem").alias("field"), F.col("row_id").alias("row_key"))
    return values.unionByName(kinds)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return units.other_units(_converted(spark, d))


def p3_common(spark: SparkSession, d: str) -> DataFrame:
    return _converted(spark, d).select("item_id", "attribute_std", "unit_stated", "unit_source", F.round("value_common", 6).alias("value_common"))


def catalogue_attributes(spark: SparkSession, d: str, bound: int = 10_000) -> list[str]:
    """The attributes of the catalogue in order: they are the columns of the wide table, so their number is bounded."""
    return [r.attribute for r in bounded_rows(table(spark, d, "attribute_catalogue").select("attribute").dropna().distinct().orderBy("attribute"), bound, "the list of catalogue attributes")]


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per entity_id: value_common__<attribute> double and item_id__<attribute> bigint for each attribute of the catalogue."""
    rows = _converted(spark, d, ["entity_id", "extracted_at"]).where("not missing")
    columns = [(a, s, k) for s, k in (("value_common", "double"), ("item_id", "bigint")) for a in catalogue_attributes(spark, d)]
    return widen.widen(rows, "entity_id", "attribute_std", columns, [F.col("extracted_at"), F.col("item_id")])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return widen.filled_cells(p4_wide(spark, d), "entity_id", [(a, f"item_id__{a}") for a in catalogue_attributes(spark, d)], "item_id")


QUERIES = {"p1_found": p1_found, "p1_values": p1_values, "p1_ecosystems": p1_ecosystems, "p3_found": p3_found, "p3_common": p3_common, "p4_found": p4_found, "p4_wide": p4_wide}

# ---- the same in SQL: spellings as tables, one regular expression for the number before a unit -------------------------------------

# Fixed values, for the SQL only: spellings of the catalogue's attributes.
ATTRIBUTE_NAMES = {
    "surface_area": ["surface area", "area surface", "surf area", "open water area"],
    "max_depth": ["max depth", "maximum depth", "depth (max)", "z max", "zmax", "deepest point"],
    "vegetation_cover": ["vegetation cover", "veg cover", "macrophyte cover", "cover of macrophytes"],
    "ph": ["ph", "ph (water)", "water ph"],
    "tn": ["tn", "total nitrogen", "total n", "tot n", "nitrogen total"],
    "tp": ["tp", "total phosphorus", "total p", "tot p", "phosphorus total"],
    "chla": ["chla", "chl a", "chlorophyll a"],
    "water_temp": ["water temp", "water temperature", "t (water)", "temperature of water"],
    "conductivity": ["conductivity", "cond", "ec", "ec25", "specific conductance"],
    "secchi_depth": ["secchi", "secchi depth", "secchi disc depth"],
}

# Fixed values, for the SQL only: spellings of the catalogue's units.
UNIT_NAMES = {
    "m^2": ["m2", "sqm", "squaremetres", "squaremeters"],
    "ha": ["ha", "hectare", "hectares"],
    "km^2": ["km2", "sqkm", "squarekilometres", "squarekilometers"],
    "acres": ["ac", "acre", "acres"],
    "mi^2": ["mi2", "sqmi", "squaremiles"],
    "x10^-2 km^2": ["x10-2km2", "10-2km2"],
    "m": ["m", "metre", "metres", "meter", "meters"],
    "cm": ["cm", "centimetre", "centimetres", "centimeter", "centimeters"],
    "ft": ["ft", "foot", "feet"],
    "km": ["km", "kilometre", "kilometres", "kilometer", "kilometers"],
    "percent": ["percent", "%", "%cover", "pct"],
    "fraction": ["fraction", "fraction(0-1)", "asafraction", "frac", "proportion"],
    "µg/L": ["ug/l"],
    "mg/L": ["mg/l"],
    "µmol/L": ["umol/l", "um", "micromolar"],
    "ppm": ["ppm", "partspermillion"],
    "ppb": ["ppb", "partsperbillion"],
    "mg/m^3": ["mg/m3"],
    "deg C": ["oc", "c", "degc", "degreescelsius"],
    "deg F": ["of", "f", "degf", "degreesfahrenheit"],
    "K": ["k", "kelvin"],
    "µS/cm": ["us/cm"],
    "mS/cm": ["ms/cm"],
    "mS/m": ["ms/m"],
}


def _rows(names: dict[str, list[str]]) -> str:
    return ", ".join("('{}', '{}')".format(k.replace("'", "''"), canonical) for canonical, keys in names.items() for k in keys)


_KEY = r"""regexp_replace(lower(translate({c}, '⁻⁺⁰¹²³⁴⁵⁶⁷⁸⁹−µμ×°º', '-+0123456789-uuxoo')), '[\s\x{{00A0}}\x{{202F}}·⋅.^*_]+', '', 'g')"""
for _a, _b in ((r"milligrams?", "mg"), (r"micrograms?|microg", "ug"), (r"millisiemens", "ms"), (r"microsiemens|micros", "us"), (r"(perlitre|perliter|l-1)$", "/l"), (r"(percubicmetre|percubicmeter|m-3)$", "/m3"), (r"(percm|cm-1)$", "/cm"), (r"(permetre|permeter|m-1)$", "/m"), (r"//", "/")):
    _KEY = f"regexp_replace({_KEY}, '{_a}', '{_b}', 'g')"
_N = r"(?:[0-9Ol]{1,9}(?:['' ][0-9Ol]{3})+(?:[.,][0-9Ol]*)?|[0-9Ol]+(?:[.,][0-9Ol]*)?)"
_E = r"(?: ?[x×] ?10 ?\^? ?[-+]?[0-9]+|[eE][-+]?[0-9]+)?"
_PLAIN = r"translate(trim(regexp_replace({v}, '[\s\x{{00A0}}\x{{202F}}]+', ' ', 'g')), '⁻⁺⁰¹²³⁴⁵⁶⁷⁸⁹−', '-+0123456789-')"
_PATTERN = r"^(?:<|>|below|above)? ?(?:~|ca\.|approx\.)? ?([-+]?" + _N + r")(" + _E + r")(?: ?(?:±|\+/-) ?" + _N + _E + r")?(?: ?\( ?" + _N + _E + r" ?(?:to|-|–) ?" + _N + _E + r" ?\))? ?(.*)$"
_NUMBER = f"try_cast(translate(regexp_replace(regexp_extract(plain, '{_PATTERN}', 1), '['' +]', '', 'g'), 'Ol,', '01.') || 'e' || coalesce(nullif(regexp_extract(regexp_extract(plain, '{_PATTERN}', 2), '(?:10 ?\\^? ?|[eE])([-+]?[0-9]+)$', 1), ''), '0') AS DOUBLE)"
NUMBER_PLAIN, NUMBER_SQL = _PLAIN, _NUMBER
_ATTRIBUTE_KEY = r"trim(regexp_replace(regexp_replace(lower({c}), '[.,]', '', 'g'), '[\s\x{{00A0}}_-]+', ' ', 'g'))"
_SUFFIX_SQL = r"^(.*?)\s*(?:\(([^()]*(?:\([^()]*\))?)\)|\[([^\[\]]*)\]|\s/\s+(.*)|\sin\s+(.*))$"
_EMPTY = "value IS NULL OR NOT regexp_matches(value, '[0-9]') OR regexp_matches(trim(value), '^-9{2,}([.,]0+)?$')"
_ITEMS = f"""names(k, attribute) AS (VALUES {_rows(ATTRIBUTE_NAMES)}), unit_names(k, unit) AS (VALUES {_rows(UNIT_NAMES)}),
latest AS (SELECT * FROM extraction_values QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY loaded_at DESC) = 1),
x AS (SELECT *, ({_EMPTY}) AS missing, {_PLAIN.format(v="coalesce(value, '')")} AS plain, {_ATTRIBUTE_KEY.format(c='attribute')} AS whole, regexp_extract(attribute, '{_SUFFIX_SQL}', 1) AS base, concat(regexp_extract(attribute, '{_SUFFIX_SQL}', 2), regexp_extract(attribute, '{_SUFFIX_SQL}', 3), regexp_extract(attribute, '{_SUFFIX_SQL}', 4), regexp_extract(attribute, '{_SUFFIX_SQL}', 5)) AS suffix FROM latest),
items AS (SELECT x.*, coalesce(a.attribute, b.attribute) AS std, a.attribute IS NULL AND b.attribute IS NOT NULL AS suffixed FROM x LEFT JOIN names a ON a.k = x.whole LEFT JOIN names b ON b.k = {_ATTRIBUTE_KEY.format(c='x.base')})"""
_STATED = f"""{_ITEMS},
said AS (SELECT i.*, {_NUMBER} AS num, coalesce(u1.unit, u2.unit, u3.unit, u4.unit) AS row_unit, CASE WHEN u1.unit IS NOT NULL THEN 'units' WHEN u2.unit IS NOT NULL THEN 'value' WHEN u3.unit IS NOT NULL THEN 'attribute' WHEN u4.unit IS NOT NULL THEN 'remark' END AS row_source FROM items i
 LEFT JOIN unit_names u1 ON u1.k = {_KEY.format(c='i.units')} LEFT JOIN unit_names u2 ON u2.k = {_KEY.format(c=f"regexp_extract(i.plain, '{_PATTERN}', 3)".replace('{', '{{').replace('}', '}}')).replace('{{', '{').replace('}}', '}')}
 LEFT JOIN unit_names u3 ON i.suffixed AND u3.k = {_KEY.format(c='i.suffix')} LEFT JOIN unit_names u4 ON u4.k = {_KEY.format(c="regexp_extract(i.additional_details, '(?:given in|reported in|values are|unit:) (.*)$', 1)")}),
pu AS (SELECT document_id, attribute, min(u.unit) AS unit FROM (SELECT document_id, unnest(json_keys(units)) AS attribute, units FROM papers WHERE json_valid(units)) p JOIN unit_names u ON u.k = {_KEY.format(c="json_extract_string(p.units, '$.' || p.attribute)")} GROUP BY ALL),
common AS (SELECT attribute, min(unit) AS unit FROM attribute_catalogue WHERE is_common GROUP BY attribute),
conv AS (SELECT s.*, k.unit AS common_unit, CASE WHEN s.row_unit IS NOT NULL THEN c.unit ELSE pu.unit END AS stated, CASE WHEN s.row_unit IS NOT NULL THEN CASE WHEN c.unit IS NULL THEN 'unknown' ELSE s.row_source END WHEN pu.unit IS NOT NULL THEN 'paper' ELSE 'none' END AS unit_source
 FROM said s LEFT JOIN attribute_catalogue c ON c.attribute = s.std AND c.unit = s.row_unit LEFT JOIN pu ON pu.document_id = s.document_id AND pu.attribute = s.std LEFT JOIN common k ON k.attribute = s.std),
converted AS (SELECT v.*, CASE WHEN NOT missing AND std IS NOT NULL THEN CASE WHEN common_unit IS NULL THEN num WHEN unit_source = 'none' THEN num * 1.0::DOUBLE + 0.0::DOUBLE ELSE num * w.factor + w.shift END END AS value_common FROM conv v LEFT JOIN attribute_catalogue w ON w.attribute = v.std AND w.unit = v.stated)"""
_BARE = r"nullif(regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g'), '')"
_PARTS = r"nullif(array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(coalesce(location, ''), '[,;/|]'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{M}\p{N}]+', '', 'g')), lambda x: x <> '')), '|'), '')"
_KIND = "CASE WHEN NOT (ecosystem IS NULL OR lower(trim(ecosystem)) IN ('', '?', '-', 'na', 'n/a', 'unknown', 'unspecified', 'not given', 'not stated', 'null', 'none')) THEN regexp_replace(lower(trim(ecosystem)), '([a-z]{3})s$', '\\1') END"


def _filled(levels: list[tuple[str, list[str], int]], statistic: str) -> tuple[str, str, str, str]:
    """CTEs l0, l1, ... with each level's statistic, and the joins and columns that take the first of them."""
    made, joins = [], []
    for i, (_, keys, least) in enumerate(levels):
        known = " AND ".join([f"{k} IS NOT NULL" for k in keys] or ["true"])
        made.append(f"l{i} AS (SELECT {', '.join([*keys, statistic])} AS s FROM present WHERE {known} GROUP BY ALL HAVING count(*) >= {least})")
        joins.append(f"LEFT JOIN l{i} ON b.gone AND " + " AND ".join([f"l{i}.{k} = b.{k}" for k in keys] or ["true"]))
    level = "CASE " + " ".join(f"WHEN l{i}.s IS NOT NULL THEN '{n}'" for i, (n, _, _) in enumerate(levels)) + " END"
    value = "coalesce(" + ", ".join(f"l{i}.s" for i in range(len(levels))) + ")"
    return ", ".join(made), " ".join(joins), level, value


_V_LEVELS, _V_JOINS, _V_LEVEL, _V_VALUE = _filled([("water body and year", ["about", "water_body", "year"], 3), ("water body", ["about", "water_body"], 3), ("paper and year", ["about", "document_id", "year"], 3), ("paper", ["about", "document_id"], 3), ("year", ["about", "year"], 3), ("attribute", ["about"], 1)], "quantile_disc(v, 0.5)")
_VALUES_SQL = f"""WITH {_STATED},
r AS (SELECT item_id, document_id, std, missing, CASE WHEN std IS NOT NULL THEN value_common ELSE num END AS v, whole, coalesce(std, whole || chr(1) || coalesce(row_unit, '')) AS about, {_BARE.format(c='name')} AS water_body, nullif(regexp_extract(date, '([0-9]{{4}})', 1), '') AS year FROM converted),
usual AS (SELECT whole, min(struct_pack(n := -n, a := about)).a AS about FROM (SELECT whole, about, count(*) AS n FROM r WHERE std IS NULL AND NOT missing GROUP BY ALL) GROUP BY whole),
b AS (SELECT r.* REPLACE (CASE WHEN r.missing AND r.std IS NULL AND r.about = r.whole || chr(1) THEN coalesce(u.about, r.about) ELSE r.about END AS about), r.missing AS gone FROM r LEFT JOIN usual u ON u.whole = r.whole),
present AS (SELECT * FROM b WHERE NOT gone AND v IS NOT NULL), {_V_LEVELS}
SELECT b.item_id, b.std AS attribute_std, round(CASE WHEN b.gone THEN {_V_VALUE} ELSE b.v END, 6) AS value_filled, b.gone AS value_filled_was_missing, CASE WHEN b.gone THEN {_V_LEVEL} END AS value_filled_level FROM b {_V_JOINS}"""
_MODES = "(SELECT {keys}, v, count(*) AS n FROM present WHERE {known} GROUP BY ALL)"
_KINDS_SQL = f"""WITH b AS (SELECT row_id, document_id, {_KIND} AS v, {_BARE.format(c='name')} AS water_body, {_PARTS} AS place FROM entities), present AS (SELECT * FROM b WHERE v IS NOT NULL),
l0 AS (SELECT water_body, place, min(struct_pack(n := -n, v := v)).v AS s FROM {_MODES.format(keys='water_body, place', known='water_body IS NOT NULL AND place IS NOT NULL')} GROUP BY ALL),
l1 AS (SELECT water_body, min(struct_pack(n := -n, v := v)).v AS s FROM {_MODES.format(keys='water_body', known='water_body IS NOT NULL')} GROUP BY ALL),
l2 AS (SELECT document_id, min(struct_pack(n := -n, v := v)).v AS s FROM {_MODES.format(keys='document_id', known='document_id IS NOT NULL')} GROUP BY ALL HAVING sum(n) >= 3),
l3 AS (SELECT place, min(struct_pack(n := -n, v := v)).v AS s FROM {_MODES.format(keys='place', known='place IS NOT NULL')} GROUP BY ALL HAVING sum(n) >= 3),
l4 AS (SELECT min(struct_pack(n := -n, v := v)).v AS s FROM (SELECT v, count(*) AS n FROM present GROUP BY v))
SELECT b.row_id, coalesce(b.v, l0.s, l1.s, l2.s, l3.s, l4.s) AS ecosystem_filled, b.v IS NULL AS ecosystem_filled_was_missing,
 CASE WHEN b.v IS NOT NULL THEN NULL WHEN l0.s IS NOT NULL THEN 'water body and place' WHEN l1.s IS NOT NULL THEN 'water body' WHEN l2.s IS NOT NULL THEN 'paper' WHEN l3.s IS NOT NULL THEN 'place' ELSE 'all' END AS ecosystem_filled_level
FROM b LEFT JOIN l0 ON l0.water_body = b.water_body AND l0.place = b.place LEFT JOIN l1 ON l1.water_body = b.water_body LEFT JOIN l2 ON l2.document_id = b.document_id LEFT JOIN l3 ON l3.place = b.place LEFT JOIN l4 ON true"""
_ATTRIBUTES = sorted(ATTRIBUTE_NAMES)
SQL = {
    "p1_found": f"""SELECT 'value' AS field, item_id AS row_key FROM ({_VALUES_SQL}) WHERE value_filled_was_missing AND value_filled IS NOT NULL
UNION ALL SELECT 'ecosystem', row_id FROM ({_KINDS_SQL}) WHERE ecosystem_filled_was_missing AND ecosystem_filled IS NOT NULL""",
    "p1_values": _VALUES_SQL,
    "p1_ecosystems": _KINDS_SQL,
    "p3_found": f"WITH {_STATED} SELECT DISTINCT item_id, stated AS unit FROM converted WHERE value_common IS NOT NULL AND common_unit IS NOT NULL AND stated <> common_unit",
    "p3_common": f"WITH {_STATED} SELECT item_id, std AS attribute_std, stated AS unit_stated, unit_source, round(value_common, 6) AS value_common FROM converted",
    "p4_found": f"""WITH {_ITEMS} SELECT entity_id, std AS attribute, arg_max(item_id, struct_pack(a := extracted_at, b := item_id)) AS item_id FROM items WHERE NOT missing AND std IS NOT NULL AND entity_id IS NOT NULL GROUP BY ALL""",
    "p4_wide": f"""WITH {_STATED}, s AS (SELECT entity_id, std, arg_max(struct_pack(i := item_id, v := value_common), struct_pack(a := extracted_at, b := item_id)) AS c FROM converted WHERE NOT missing AND std IS NOT NULL AND entity_id IS NOT NULL GROUP BY ALL)
SELECT entity_id, {', '.join(f"any_value(c.v) FILTER (std = '{a}') AS value_common__{a}, any_value(c.i) FILTER (std = '{a}') AS item_id__{a}" for a in _ATTRIBUTES)} FROM s GROUP BY entity_id""",
}
