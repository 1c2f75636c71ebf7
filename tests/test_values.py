import pytest
from pyspark.sql import functions as F

from tarnflow.functions import measures
from tarnflow.functions.spellings import Lexicon, read
from tarnflow.functions import values as V

CATALOGUE = [
    ("chla", "Chlorophyll-a of the water column", "µg/L", True), ("chla", "Chlorophyll-a of the water column", "mg/m^3", False), ("conductivity", "Specific conductance of the water", "µS/cm", True), ("conductivity", "Specific conductance of the water", "mS/cm", False), ("conductivity", "Specific conductance of the water", "mS/m", False),
    ("max_depth", "Greatest water depth of the water body", "m", True), ("max_depth", "Greatest water depth of the water body", "cm", False), ("max_depth", "Greatest water depth of the water body", "ft", False), ("ph", "pH of the water, no unit", None, True), ("surface_area", "Horizontal area of the open water", "m^2", True),
    ("surface_area", "Horizontal area of the open water", "x10^-2 km^2", False), ("tn", "Total nitrogen of the water column", "mg/L", True), ("tn", "Total nitrogen of the water column", "ppb", False), ("tn", "Total nitrogen of the water column", "µmol/L", False), ("vegetation_cover", "Share covered", "percent", True), ("vegetation_cover", "Share covered", "fraction", False),
    ("water_temp", "Temperature of the water", "deg C", True), ("water_temp", "Temperature of the water", "deg F", False),
]
LEXICON = Lexicon.of(CATALOGUE)
NUMBERS = [
    ("1.71", 1.71, None), (" 14.8  ", 14.8, None), ("7,47", 7.47, None), ("18.7 +/- 2.24", 18.7, None), ("1.56±0.1872", 1.56, None), ("7.44 (5.95-8.93)", 7.44, None), ("1.82 (1.46 to 2.19)", 1.82, None),
    ("183 (146–219)", 183.0, None), ("2.6l", 2.61, None), ("7.O4", 7.04, None), ("below 19.0", 19.0, None), ("< 0.597", 0.597, None), ("ca. 97.9", 97.9, None), ("approx. 36.6 percent", 36.6, "percent"), ("~28.7", 28.7, None),
    ("3.87 × 10^2", 387.0, None), ("2.67x10²", 267.0, None), ("5.98e-1", 0.598, None), ("1.75 × 10^-2", 0.0175, None), ("178 743", 178743.0, None), ("1'115", 1115.0, None), ("11 395", 11395.0, None), ("1878 353", 1878353.0, None),
    ("81.0\xa0percent", 81.0, "percent"), ("48.5 µg/L", 48.5, "µg/L"), ("5.54x10¹ uS/cm", 55.4, "uS/cm"), ("0.1786 fraction (0-1)", 0.1786, "fraction (0-1)"), ("0", 0.0, None), ("-3.5", -3.5, None),
    ("no data", None, None), ("", None, None), (None, None, None), ("..", None, None), ("—", None, None),
]


def test_written_numbers(spark):
    rows = spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(NUMBERS)], "i int, v string").select("i", V.number_struct(F.col("v")).alias("n")).collect()
    for r in rows:
        text, number, unit = NUMBERS[r.i]
        assert r.n.num == (pytest.approx(number) if number is not None else None), text
        assert r.n.unit == unit, text


def test_missing_cells(spark):
    missing = [None, "", " ", "-", "–", "—", "..", "?", "*", "x", "NaN", "None", "null", "N/A", "(blank)", "no data", "not measured", "-999", "-9999", "-999.0"]
    present = ["0", "0.0", "<5", "below 2", "99.0", "999", "-1.5", "9"]
    none = F.lit(None).cast("string")
    rows = spark.createDataFrame([(v,) for v in missing + present], "v string").select("v", read(LEXICON, none, F.col("v"), none, none)["missing"].alias("m")).collect()
    assert [r.m for r in rows] == [True] * len(missing) + [False] * len(present)
    words = spark.createDataFrame([(v,) for v in [*missing[:17], "Unknown", "unspecified", "not stated", "other", "lake"]], "v string").select(V.is_empty_word(F.col("v")).alias("m")).collect()
    assert [r.m for r in words] == [True] * 20 + [False] * 2


def test_units_and_attributes():
    units = {"µg·L⁻¹": "µg/L", "ug l^-1": "µg/L", "microg/l": "µg/L", "mg per litre": "mg/L", "MG/L": "mg/L", "milligrams per liter": "mg/L", "mg m⁻³": "mg/m^3", "mg per cubic metre": "mg/m^3", "×10⁻² km²": "x10^-2 km^2", "sq. m": "m^2", "M": "m", "°C": "deg C", "degrees Fahrenheit": "deg F", "millisiemens per cm": "mS/cm", "mS m⁻¹": "mS/m", "μmol L-1": "µmol/L", "µM": "µmol/L", "p.p.b.": "ppb", "% cover": "percent", "fraction (0-1)": "fraction", "see text": None, "-": None, "furlong": None}
    # each is looked up under the attributes that have the unit
    got = {u: next((f for a in LEXICON.common if (f := LEXICON.unit(a, u)[0])), None) for u in units}
    assert got == units
    names = {"depth (max)": ("max_depth", None), "depth (max) (cm)": ("max_depth", "cm"), "pH (water)": ("ph", None), "T (water) / deg C": ("water_temp", "deg C"), "tn in µg l⁻¹": ("tn", "µg l⁻¹"), "Surface  Area": ("surface_area", None), "macrophyte cover in fraction (0-1)": ("vegetation_cover", "fraction (0-1)"), "veg. cover (%)": ("vegetation_cover", "%"), "mean depth": (None, None), "sediment pH": (None, None), "total chlorophyll": (None, None)}
    assert {n: LEXICON.attribute(n)[:2] for n in names} == names


def test_new_catalogue_rows_are_recognised():
    more = Lexicon.of([*CATALOGUE, ("do", "Dissolved oxygen of the water", "mg/L", True), ("fetch", "Fetch of the lake", "furlong", True), ("fetch", "Fetch of the lake", "km", False)])
    assert more.attribute("dissolved Oxygen (mg l-1)")[:2] == ("do", "mg l-1") and more.attribute("DO")[0] == "do"
    assert more.unit("fetch", "Furlong")[0] == "furlong" and more.unit("fetch", "kilometres")[0] == "km" and more.unit("do", "furlong")[0] is None
    assert Lexicon.of([]).attribute("tn")[0] is None


def test_reading_states_the_source_of_a_unit(spark):
    rows = [(1, "Zmax", "3 furlong", None, None), (2, "Zmax", "3", "see text", "given in cm"), (3, "Zmax (ft)", "3", None, None), (4, None, None, None, None), (5, "Zmax", "3", "mg/L", None), (6, "", "", "", "")]
    df = spark.createDataFrame(rows, "i int, a string, v string, u string, r string")
    got = {r.i: r.x for r in df.select("i", read(LEXICON, F.col("a"), F.col("v"), F.col("u"), F.col("r")).alias("x")).collect()}
    assert [(got[i].row_unit, got[i].row_unit_source) for i in range(1, 7)] == [(None, "unknown"), ("cm", "remark"), ("ft", "attribute"), (None, None), (None, "unknown"), (None, None)]
    assert got[4].missing and got[6].missing and got[1].num == 3.0


def test_measures(spark):
    cases = [("1,5×10^2", 150.0), ("1 234.5", 1234.5), ("1,234,567", None), ("3.5d", None), ("1_000", None), ("−2", -2.0), ("1O", 10.0), ("5e2", 500.0), ("", None), (None, None)]
    rows = spark.createDataFrame(cases, "v string, x double").select("x", measures.parse_numeric(F.col("v")).alias("got")).collect()
    assert all(r.got == (pytest.approx(r.x) if r.x is not None else None) for r in rows)
    one = spark.range(1)
    tables = {"table 1 - results": [1], "tables 2; 3; 4; 6; 8 - figures": [2, 3, 4, 6, 8], "page 95; abstract": None, "supplemental tables s3; s5": None, "figure 2 - text": None}
    for text, want in tables.items():
        assert one.select(measures.table_numbers(F.lit(text))).first()[0] == want
    assert one.select(measures.normalized_units(F.lit("nmol-n g-1 h-1"))).first()[0] == "nmol N g⁻¹ h⁻¹"
    assert one.select(measures.page_list(F.lit("[1, 2.0]")), measures.page_list(F.lit("1, x"))).first() == ([1, 2], None)
    assert one.select(measures.numeric_score(F.lit(0.0), F.array(F.lit(0.0)))).first()[0] == 1.0
