import random

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import impute, units, widen

CATALOGUE = [("t", "deg C", 1.0, 0.0, True), ("t", "deg F", 5 / 9, -160 / 9, False), ("t", "K", 1.0, -273.15, False), ("ph", None, 1.0, 0.0, True), ("max_depth", "m", 1.0, 0.0, True), ("max_depth", "cm", 0.01, 0.0, False), ("max_depth", "ft", 0.3048, 0.0, False)]
ITEMS = "item_id bigint, document_id string, value string, units string, additional_details string, attribute string"


def catalogue(spark):
    return spark.createDataFrame([(a, "d", u, f, s, c) for a, u, f, s, c in CATALOGUE], "attribute string, description string, unit string, factor double, shift double, is_common boolean")


def test_fill_agrees_with_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("abc") if rng.random() > 0.1 else None, rng.choice("xy"), rng.choice([1.0, 2.0, 5.0, 9.0]) if rng.random() > 0.3 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, g string, h string, v double")
    got = {r.i: r for r in impute.fill_from_groups(df, F.col("v"), [("gh", ["g", "h"], 40), ("g", ["g"], 3), ("all", [], 1)], "median").collect()}
    assert len(got) == 300

    def median(xs):
        return sorted(xs)[(len(xs) - 1) // 2]

    for i, g, h, v in rows:
        if v is not None:
            assert (got[i].filled, got[i].filled_was_missing, got[i].filled_level) == (v, False, None)
            continue
        fine = [x for _, a, b, x in rows if (a, b) == (g, h) and x is not None] if g else []
        mid = [x for _, a, _, x in rows if a == g and x is not None] if g else []
        want = (median(fine), "gh") if len(fine) >= 40 else (median(mid), "g") if len(mid) >= 3 else (median([x for *_, x in rows if x is not None]), "all")
        assert (got[i].filled, got[i].filled_level, got[i].filled_was_missing) == (*want, True)


def test_fill_mode_ties_empty_and_clashing_names(spark):
    df = spark.createDataFrame([("a", "z", 1), ("a", "y", 2), ("a", None, 3), ("b", None, 4), ("b", None, 4)], "k string, v string, filled int")
    got = sorted(((r.k, r.filled, r.filled_was_missing, r.filled_level or "") for r in impute.fill_from_groups(df, F.col("v"), [("k", ["k"], 1)], "mode").collect()), key=str)
    assert got == [("a", "y", False, ""), ("a", "y", True, "k"), ("a", "z", False, ""), ("b", None, True, ""), ("b", None, True, "")]
    empty = impute.fill_from_groups(df.where("false"), F.col("v"), [("k", ["k"], 1), ("all", [], 1)], "mode")
    assert empty.count() == 0 and {"filled", "filled_was_missing", "filled_level"} <= set(empty.columns)
    with pytest.raises(ValueError):
        impute.fill_from_groups(df, F.col("v"), [], "mean")


def test_compositions_take_the_shortest_way_and_check_cycles():
    A = units.Affine
    edges = [("t", "F", "C", A(5 / 9, -160 / 9)), ("t", "K", "C", A(1, -273.15)), ("t", "R", "F", A(1, -459.67))]
    made = {u: (f, s, h) for _, u, f, s, h in units.compositions(edges, {"t": "C"})}
    assert made["C"] == (1.0, 0.0, 0) and made["R"][2] == 2
    assert made["R"][0] * 671.67 + made["R"][1] == pytest.approx(100.0)
    units.compositions([*edges, ("t", "K", "F", A(1.8, -459.67))], {"t": "C"})
    with pytest.raises(units.InconsistentUnits):
        units.compositions([*edges, ("t", "K", "F", A(1.8, -400.0))], {"t": "C"})
    with pytest.raises(units.InconsistentUnits):
        units.compositions([("t", "a", "C", A(0, 1))], {"t": "C"})
    assert units.compositions([], {}) == []


def test_conversion_prefers_the_row_over_the_paper(spark):
    items = spark.createDataFrame(
        [(1, "p", "100 cm", None, None, "Zmax"), (2, "p", "3", None, None, "max_depth"), (3, "p", "3", "m", None, "max_depth"), (4, "q", "3", None, None, "max_depth"), (5, "p", "x", "ft", None, "Zmax"), (6, "p", "10", None, "control; given in ft", "Zmax"), (7, "p", "7.1", "-", None, "pH"), (8, "p", "2", "ft", None, "mean depth"), (9, None, "5", "m", None, "Zmax"), (9, None, "5", "m", None, "Zmax"), (10, "p", "4", None, None, "max. depth [cm]"), (11, None, None, None, None, None)],
        ITEMS,
    ).withColumn("value_common", F.lit("clash")).withColumn("__stated", F.lit(1))
    papers = spark.createDataFrame([("p", '{"max_depth": "ft"}'), ("q", "not json"), (None, None)], "document_id string, units string")
    got = units.to_common_units(items, papers, catalogue(spark))
    rows = {r.item_id: r for r in got.collect()}
    assert got.count() == 12
    assert [round(rows[i].value_common, 4) if rows[i].value_common is not None else None for i in range(1, 12)] == [1.0, 0.9144, 3.0, 3.0, None, 3.048, 7.1, None, 5.0, 0.04, None]
    assert [rows[i].unit_source for i in (1, 2, 3, 4, 6, 10)] == ["value", "paper", "units", "none", "remark", "attribute"]
    assert sorted((r.item_id, r.unit) for r in units.other_units(got).collect()) == [(1, "cm"), (2, "ft"), (6, "ft"), (10, "cm")]
    assert units.to_common_units(items.where("false"), papers.where("false"), catalogue(spark)).count() == 0


def test_unknown_units_give_no_value(spark):
    items = spark.createDataFrame([(1, "p", "3 furlong", None, None, "Zmax"), (2, "p", "3 fathoms", None, None, "Zmax"), (3, "q", "3", "fathoms", None, "Zmax"), (4, "q", "3", "deg C", None, "Zmax")], ITEMS)
    papers = spark.createDataFrame([("p", '{"max_depth": "cm"}')], "document_id string, units string")
    got = units.to_common_units(items, papers, catalogue(spark)).collect()
    assert len(got) == 4 and all((r.value_common, r.unit_stated, r.unit_source) == (None, None, "unknown") for r in got)


def test_latest_delivery_stands(spark):
    rows = [(1, "9.0", 1), (1, "5.0", 2), (2, None, 3), (2, "4", 1), (3, "a", 1), (3, "b", 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "item_id bigint, value string, loaded_at int").withColumn("__p", F.lit(0))
    assert sorted((r.item_id, r.value or "") for r in units.latest_deliveries(df, ["value"]).collect()) == [(1, "5.0"), (2, ""), (3, "b")]


def test_medians_of_large_groups_are_exact(spark):
    rng = random.Random(5)
    rows = [("hot", rng.choice([rng.random(), 0.5, -1.0])) for _ in range(3000)] + [("even", float(i)) for i in range(40)] + [("one", 1.0)] + [("tied", 2.0)] * 101
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r["__stat"], r["__support"]) for r in impute.medians(df, ["k"], "v", accuracy=50).collect()}
    for k in ("hot", "even", "one", "tied"):
        xs = sorted(v for g, v in rows if g == k)
        assert got[k] == (xs[(len(xs) - 1) // 2], len(xs)), k
    everything = sorted(v for _, v in rows)
    assert impute.medians(df, [], "v", accuracy=50).first()["__stat"] == everything[(len(everything) - 1) // 2]


def test_cells_neither_missing_nor_usable_stay(spark):
    df = spark.createDataFrame([("a", 1.0, False), ("a", None, False), ("a", None, True), ("b", None, None)], "k string, v double, m boolean")
    got = impute.fill_from_groups(df, F.col("v"), [("k", ["k"], 1)], "median", missing=F.col("m")).collect()
    assert sorted((r.k, r.filled or 0, r.filled_was_missing) for r in got) == [("a", 0, False), ("a", 1.0, False), ("a", 1.0, True), ("b", 0, False)]


def test_wide_rows_agree_with_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["e1", "e2", "e3", None, "hot", "hot", "hot"]), rng.choice(["a", "b", "c", "zz", None]), rng.choice([1.5, 2.5, None]), i, rng.randint(0, 5), f"t{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "e string, a string, v double, i bigint, at int, s string").withColumn("v__a", F.lit(0))
    columns = [(a, s, k) for s, k in (("v", "double"), ("i", "bigint"), ("s", "string")) for a in "abc"]
    wide = {r.e: r for r in widen.widen(df, "e", "a", columns, [F.col("at"), F.col("i")], batch_rows=2).collect()}
    best = {}
    for e, a, v, i, at, s in rows:
        if e and a in ("a", "b", "c") and (at, i) >= best.get((e, a), ((-1, -1),))[0]:
            best[e, a] = ((at, i), v, i, s)
    assert set(wide) == {e for e, _ in best}
    for (e, a), (_, v, i, s) in best.items():
        assert (wide[e][f"v__{a}"], wide[e][f"i__{a}"], wide[e][f"s__{a}"]) == (v, i, s)
    assert widen.widen(df.where("false"), "e", "a", columns, [F.col("i")]).count() == 0
    cells = widen.filled_cells(widen.widen(df, "e", "a", columns, [F.col("at"), F.col("i")]), "e", [(a, f"i__{a}") for a in "abc"], "i")
    assert {(r.e, r.attribute, r.i) for r in cells.collect()} == {(e, a, x[2]) for (e, a), x in best.items()}
