"""Queries and operators over the whole of their input, against brute force or planted rows."""

import json
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.functions import measures
from tarnflow.functions.spellings import read
from tarnflow.operators import grouping, matching
from tarnflow.operators.units import lexicon_of
from tarnflow.plans import extraction
from tarnflow.queries import reference
from tarnflow.sources.tables import table


def test_pipeline_takes_every_catalogue_attribute(spark, small):
    _, attributes, _ = reference._known(spark, small)
    rows = table(spark, small, "extraction_values").withColumn("a", read(lexicon_of(table(spark, small, "attribute_catalogue")), F.col("attribute"), *[F.lit(None).cast("string")] * 3)["attribute_std"]).where("a is not null")
    assert rows.where("attribute <> a").count() > 0
    assert attributes.count() == rows.select("document_id", "a", "page_number", F.when(F.col("source") == "table", F.col("table_number"))).distinct().count()


def test_pipeline_prompts_hold_the_texts_and_run_every_stage(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def client(prompts):
        with open(seen, "a") as f:
            f.writelines(json.dumps(p) + "\n" for p in prompts)
        replies = {"attributes": {"items": [{"attribute_name": "tn", "detected": True}, {"attribute_name": "other", "detected": True}]}, "events": {"items": [{"date": "1999", "additional_details": None}]}, "standardise": {"value": "2", "units": "mg/L"}, "values": {"has_value": True, "value": "2 ± 1", "units": "mg"}}
        return [json.dumps(replies.get(t) or {"has_data": "deep water" in p, "in_table": "<table" in p}) for p in prompts for t in [p.split("\n")[0][6:]]]

    text = '<page number="0">deep water here</page><page number="1">deep water <table number="3"><tr><td>cell</td></tr></table></page><page number="2">nothing</page>'
    documents = spark.createDataFrame([(1, "W1", text)], "doc_id long, document_id string, text string")
    entities = spark.createDataFrame([("W1", "e1", "Tarn", None, None, None)], "document_id string, entity_id string, name string, identifiers string, location string, ecosystem string")
    attributes = spark.createDataFrame([("tn", "Nitrogen", "mg/L")], "attribute string, description string, unit_options string")
    none = spark.createDataFrame([], "document_id string, entity_id string, attribute string, page_number int, table_number int, date string, additional_details string")
    got = extraction.run(entities, attributes, documents, none, none, none, client).collect()
    assert sorted((r.attribute, r.page_number, r.table_number, r.source, r.date, r.value, r.units) for r in got) == [("tn", 0, None, "text", "1999", "2", "mg/L"), ("tn", 1, 3, "table", "1999", "2", "mg/L")], got
    asked = [json.loads(x) for x in open(seen)]
    assert {p.split("\n")[0][6:] for p in asked} == {"attributes", "provenance", "events", "values", "standardise"}
    values = {p for p in asked if p.startswith("Task: values")}
    assert len(values) == 2 and all("deep water here" in p or "<td>cell</td>" in p for p in values)


def _number(text):
    """parse_numeric in plain Python, whose white space has every blank"""
    s = re.sub(r"[×x]\s*10(?:\^\{?([+-]?[0-9]+)\}?|([+-]?[0-9]+))", lambda m: f"e{m[1] or m[2]}", text.strip().translate(str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")))
    s = re.sub(r"([0-9]),([0-9])", r"\1.\2", re.sub(r"['\s]+", "", s)).translate(str.maketrans("−Ol", "-01"))
    return float(s) if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", s) else None


def test_numbers_with_every_blank(spark, small):
    planted = {"1\u00a0234": 1234.0, "1\u202f234,5": 1234.5, "\u00a02\u2009×\u00a010³\u00a0": 2000.0, "5 µg/L": None, "1·2": None}
    df = spark.createDataFrame([(k,) for k in planted], "v string")
    assert {r.v: r.n for r in df.select("v", measures.parse_numeric(F.col("v")).alias("n")).collect()} == planted
    got = {(r.item_id, r.parsed) for r in reference.QUERIES["q10_parse_numeric"](spark, small).collect()}
    rows = table(spark, small, "extraction_values").where("value is not null").select("item_id", "value").distinct().collect()
    assert {i for i, _ in got} == {r.item_id for r in rows}
    assert got == {(r.item_id, None if (n := _number(r.value)) is None else round(n, 6)) for r in rows}


def test_central_values_with_every_blank(spark, small):
    df = spark.createDataFrame([("1\u00a0234\u00a0±\u00a05",), ("<\u202f3\u00a0",), ("5\u00a0(3\u20137)",)], "v string")
    assert [r[0] for r in df.select(measures.central_value(F.col("v"))).collect()] == ["1\u00a0234", "3", "5"]
    values = table(spark, small, "extraction_values").where("value is not null")
    assert reference.QUERIES["q51_central_value"](spark, small).select("item_id").distinct().count() == values.select("item_id").distinct().count()


def test_conversion_gives_null_for_what_only_spark_casts(spark, tmp_path):
    spark.createDataFrame([(1, "1d", "a", "m"), (2, "2_0", "a", "m"), (3, "3", "a", "m"), (4, None, "a", "m")], "measurement_id int, value string, attribute string, units string").write.parquet(str(tmp_path / "probe_dataset.parquet"))
    spark.createDataFrame([("a", "m", 2.0)], "attribute string, unit string, factor double").write.parquet(str(tmp_path / "attribute_catalogue.parquet"))
    assert {r.measurement_id: r.converted for r in reference.QUERIES["q20_unit_conversion"](spark, str(tmp_path)).collect()} == {1: None, 2: None, 3: 6.0, 4: None}


def test_relative_match_agrees_with_all_pairs(spark):
    vs = [0.0, 1.0, -1.0, 12.5, 1234.5, 3e-5, 2000.0, float("nan"), None, float("inf")]
    ns = [0.0, 1e-13, -1e-13, 1.00005, 1.0002, -0.99995, 12.5012, 12.4988, 1234.6, 3.0002e-5, 2000.2, 1999.81, None, float("inf")]
    left, right = spark.createDataFrame([("a", v) for v in vs], "k string, v double"), spark.createDataFrame([("a", n) for n in ns], "k string, n double")
    got = sorted((r.v, r.n) for r in matching.relative_match(left, right, ["k"], "v", "n").collect())
    finite = [v for v in vs if v is not None and abs(v) < float("inf")], [n for n in ns if n is not None and abs(n) < float("inf")]
    assert got == sorted((v, n) for v in finite[0] for n in finite[1] if (abs(n) < 1e-12 if v == 0 else abs(n - v) / abs(v) <= 1e-4))
    assert len(got) > 8


def test_values_in_every_written_form_are_found_in_tables(spark, tmp_path):
    values = ["7", "12,34", "1\u00a0234", "2×10³", "5.5 ± 0.2", "<9.25", "80 µg/L", "6.5", "none"]
    spark.createDataFrame([("W1", i, v) for i, v in enumerate(values)], "document_id string, item_id int, value string").write.parquet(str(tmp_path / "extraction_values.parquet"))
    cells = ["7 (n = 3)", "12.34", "1234.05", "2e3", "5,5", "9.25 mg", "80", "6.51"]
    body = "".join(f'<table number="{i}"><tr><td rowspan="2">{c}</td></tr></table>' for i, c in enumerate(cells))
    spark.createDataFrame([(1, "W1", body), (2, "W2", body)], "doc_id bigint, document_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("W1", 4, "the 1234 and 2000 of 7"), ("W1", 5, "12.34 5.5 9.25 80 6.5")], "document_id string, page_number int, context string").write.parquet(str(tmp_path / "contexts.parquet"))
    got = {(r.item_id, r.doc_id, r.table_number) for r in reference.QUERIES["q12_table_hits"](spark, str(tmp_path)).collect()}
    assert got == {(i, 1, i) for i in range(7)}
    assert {r.item_id: r.page_number for r in reference.QUERIES["q13_page_attribution"](spark, str(tmp_path)).collect()} == {0: 4, 1: 5, 2: 4, 3: 4, 4: 5, 5: 5, 6: 5, 7: 5}


def test_centroids_of_any_number_are_matched():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(5, 3)), rng.normal(size=(6, 3))
    brute = min(np.mean([np.linalg.norm(a[i] - b[j]) for i, j in enumerate(p)]) for p in permutations(range(6), 5))
    assert grouping.centroid_distance(a, b) == pytest.approx(brute)
    many = rng.normal(size=(40, 3))
    assert grouping.centroid_distance(many, many[rng.permutation(40)]) == 0
    with pytest.raises(ValueError):
        grouping.centroid_distance(b, a)


def test_centroid_distance_takes_all_labels(spark, small):
    r = reference.QUERIES["q49_centroid_distance"](spark, small).collect()[0]
    assert r.labels == table(spark, small, "embeddings").where("label is not null").select("label").distinct().count() and r.distance > 0


def test_every_coordinate_is_filled(spark, small):
    size = table(spark, small, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    filled = reference.QUERIES["q48_knn_fill"](spark, small)
    assert filled.columns == ["vec_id", *(f"x{i}" for i in range(size))]
    assert filled.where(" or ".join(f"x{i} is null" for i in range(size))).count() == 0


def _papers(spark):
    text = '<page number="0">deep water here</page><page number="1">deep water <table number="3"><tr><th>index</th><th>TN</th></tr><tr><td>Tarn</td><td>4.5</td></tr></table></page><page number="2">nothing</page>'
    return spark.createDataFrame([(1, "W1", text)], "doc_id long, document_id string, text string"), spark.createDataFrame([("tn", "Nitrogen", "mg/L"), ("tp", "Phosphorus", "mg/L")], "attribute string, description string, unit_options string")


def _answers(prompts):
    entity = {"name": "Tarn", "identifiers": None, "location": None, "ecosystem": None}
    out = []
    for p in prompts:
        task = p.partition("Task: ")[2].partition("\n")[0]
        replies = {
            "entities": {"items": [entity]}, "attributes": {"items": [{"attribute_name": "tn", "detected": True}]}, "events": {"items": []}, "standardise": {"value": None},
            "values": {"has_value": True, "value": "2", "units": "mg"}, "cells": {"has_value": True, "row_index": "Tarn", "column_index": "TN", "units": "mg"},
            "triples": {"items": [{**entity, "attribute": "tn", "value": "7", "units": "mg"}, {**entity, "attribute": "tp", "value": None}]}, "pairs": {"items": [{**entity, "attribute": "tn"}, {**entity, "attribute": "other"}]},
            "places": {"items": [{"page_number": 0, "table_number": None}]}, "provenance": {"has_data": "deep water" in p, "in_table": "<table" in p},
        }
        out.append(json.dumps(replies[task]))
    return out


def test_variants_of_the_pipeline(spark):
    documents, attributes = _papers(spark)
    got = {k: sorted((r.entity_id, r.attribute, r.page_number, r.source, r.value) for r in extraction.run_variant(v, None, attributes, documents, _answers).collect()) for k, v in {**extraction.ABLATIONS, "0": extraction.BASELINE}.items() if not v.triples}
    prose, direct, cell = ("doc_W1_entity_0", "tn", 0, "text", "2"), ("doc_W1_entity_0", "tn", 1, "table", "2"), ("doc_W1_entity_0", "tn", 1, "table", "4.5")
    assert got == {"0": [prose, cell], "2": [prose, direct], "3": [prose], "4": [prose, direct], "5": [prose, direct], "6": [prose, direct]}
    triples = extraction.run_variant(extraction.ABLATIONS["1"], None, attributes, documents, _answers).collect()
    assert [(r.document_id, r.name, r.attribute, r.value) for r in triples] == [("W1", "Tarn", "tn", "7")]


def test_model_stages_that_fail_give_nothing(spark):
    documents, attributes = _papers(spark)
    _, _, wholes = extraction.paper_texts(documents)
    silent = lambda prompts: ["" for _ in prompts]
    assert extraction.extracted_entities(wholes, silent).count() == 0 and extraction.direct_triples(wholes, silent).count() == 0 and extraction.extracted_pairs(wholes, attributes, silent).count() == 0
    pages, _, _ = extraction.paper_texts(documents)
    assert sorted(r.text for r in extraction.cleaned_tables(pages, silent).collect()) == sorted(r.text for r in pages.collect())
    cleaned = extraction.cleaned_tables(pages, lambda ps: [json.dumps({"text": "<table>new</table>"}) for _ in ps]).collect()
    assert {r.page_number: r.text for r in cleaned}[1] == "<table>new</table>" and "nothing" in {r.page_number: r.text for r in cleaned}[2]
    assert extraction.attribute_list(attributes).first().listed == "1. tn: Nitrogen\n2. tp: Phosphorus"


def test_orders_are_rated_after_one_shuffle_of_lines(spark, tmp_path):
    """q32b against its SQL: repeated lines, equal ids, values at the edge of the band, nulls in values and in keys; nothing but lines is shuffled."""
    import random

    from tarnflow.queries import reference
    from tests.oracle import both

    rng = random.Random(5)
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    value = lambda: rng.choice([None, 0.0, 1.0, 1.0006, 2.001, 2.0014, 3.0, float("nan"), float("inf"), rng.random()])
    plain = [(rng.randint(1, 40), rng.randint(5, 8), rng.randint(3, 6), rng.randint(1, 3), *(value() for _ in range(4))) for _ in range(600)]
    odd = [tuple(rng.choice([None, x]) if i < 4 and rng.random() < 0.1 else x for i, x in enumerate(r)) for r in plain]
    without = [(r[0], 7, *r[2:]) for r in odd]  # no predictions, so no edges
    for n, rows in enumerate((plain, odd, without, [r for r in odd if r[1] and r[2]], [])):
        d = tmp_path / str(n)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(d / "raw"))
        next((d / "raw").glob("*.parquet")).rename(d / "lineitem.parquet")
        left, right = both(spark, str(d), reference.QUERIES["q32b_per_paper"], reference.SQL["q32b_per_paper"])
        assert left == right and (left or not rows)
        plan = reference.QUERIES["q32b_per_paper"](spark, str(d))._jdf.queryExecution().executedPlan().toString()
        if n == 0:
            assert plan.count("Exchange hashpartitioning(") == 1 and "Join" not in plan
