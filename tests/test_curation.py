"""Table reading, page attribution, judges, probe records, probes and sources against brute force or worked cases."""

import json
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.functions import fuzzy, measures
from tarnflow.operators import curate, evaluate, grouping, judges, pages, probe_data, probes, tables
from tarnflow.sources import config, runs


def test_tables_are_read_with_spans_and_broken_markup(spark):
    html = "<table><tr><th>index</th><th colspan=2>TN</th></tr><tr><td rowspan='2'>a<td>1</td><td><b>2</b> x</tr><tr><td>3 ± 1</td></tr></table>"
    assert tables.read_rows(html) == [["index", "TN", "TN"], ["a", "1", "2 x"], ["a", "3 ± 1"]]
    assert tables.read_rows(None) == tables.read_rows("") == tables.read_rows("no table") == []
    df = spark.createDataFrame([(1, html), (2, None), (3, "<table><tr><td>x</td></tr></table>")], "k int, body string").withColumn("row_no", F.lit(9))
    got = tables.table_cells(df, ["k"], "body")
    assert sorted((r.row_no, r.row_name, r.column_name, r.cell or "") for r in got.collect()) == [(1, "a", "TN", "1"), (1, "a", "TN", "2 x"), (2, "a", "TN", ""), (2, "a", "TN", "3 ± 1")]
    wanted = spark.createDataFrame([(1, "a", "TN"), (1, "b", "TN")], "k int, row_name string, column_name string")
    assert {r.row_name: r.cell for r in tables.lookup(got.where("cell <> '2 x'"), wanted, ["k"]).collect()} == {"a": "1", "b": None}
    assert [(r.centre, r.spread) for r in tables.unpivoted(got, ["k"]).where("centre = '3'").collect()] == [("3", "1")]
    assert tables.table_cells(df.where("false"), ["k"], "body").count() == 0


def test_pages_are_attributed_by_fields_candidates_and_tables(spark):
    found = spark.createDataFrame(
        [("d", 1, "Tarn Lake lies high. Depth 12.5 m", []), ("d", 2, "Other Pond, depth 12.5 m", []), ("d", 3, "Tarn Lake 99", [12.5]), ("e", 1, "nothing", [])], "doc string, page int, text string, table_numbers array<double>"
    )
    rows = spark.createDataFrame([(1, "d", "Tarn Lake", "12.5", None), (2, "d", "Tarn Lake", "12.5", [1, 2]), (3, "d", "Tarn Lake", "x9", [77]), (4, "e", None, None, None), (5, "zz", "a", "1", None), (None, "d", "a", "1", None)], "k int, doc string, name string, value string, want array<int>")
    got = {r.k: (r.page_number, r.page_score, r.page_confidence) for r in pages.attribute_pages(rows, found, "doc", "k", {"name": 1.0, "value": 1.0}, "value", "want").collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1][0] == [3]  # the table with the value narrows the choice
    assert got[2] == ([1], 1.0, "high")  # of the candidates
    assert got[3][0][0] in (1, 3) and got[4] == ([1], 0.5, "high")
    assert spark.range(1).select(pages.field_score(F.lit("nan"), F.lit("x")), pages.field_score(F.lit("abc"), F.lit("xx ABC yy"))).first() == (0.5, 1.0)
    long = "one two three four five six seven eight nine ten eleven"
    assert spark.range(1).select(pages.field_score(F.lit(long), F.lit(" ".join(reversed(long.split()))))).first()[0] == pytest.approx(fuzzy.token_set_ratio(long, " ".join(reversed(long.split()))) / 100)


def test_judges_are_merged_and_vote(spark):
    a = spark.createDataFrame([(1, "x", True), (2, "y", None), (2, "y", None)], "id int, s string, j boolean")
    b = spark.createDataFrame([(2, "z", True), (3, "w", False), (None, "q", True)], "id int, s string, j boolean")
    merged = judges.merge({"a": a, "b": b}, "id", ["s"], ["j"])
    voted = {r.id: (r.s, r.j_a, r.j_b, r.j_combined) for r in judges.combined_vote(merged, ["a", "b", "c"], "j").collect()}
    assert voted == {1: ("x", True, None, True), 2: ("y", None, True, True), 3: ("w", None, False, False)}
    with pytest.raises(ValueError):
        judges.combined_vote(merged, ["human"], "j")
    assert judges.suffixed(a, ["j", "none"], "m").columns == ["id", "s", "j_m"]


def test_probe_records_differ_from_their_rows_and_stay_the_same(spark):
    rng = random.Random(4)
    rows = [(i, f"d{i % 4}", f"n{rng.randint(0, 9)}", rng.choice(["tn", "ph"]), f"{rng.randint(1, 99)}.{rng.randint(0, 9)}" if i % 9 else "n/a", "mg/L", [i % 3]) for i in range(80)]
    valid = spark.createDataFrame(rows, "k int, doc string, name string, attribute string, value string, units string, page_number array<int>")
    old = {r[0]: r for r in rows}
    swaps = probe_data.swapped(valid, "k", "doc", "page_number", ["value", "name"], {"tn": ["mg/L", "µg/L"]}).collect()
    assert len(swaps) == 80 and {r.modification_type for r in swaps} == {"change_value", "change_name", "change_units"}
    for r in swaps:
        changed = {"change_value": (r.value, old[r.k][4]), "change_name": (r.name, old[r.k][2]), "change_units": (r.units, old[r.k][5])}
        assert changed[r.modification_type][0] != changed[r.modification_type][1]
        assert sum(x != y for x, y in changed.values()) == 1
        if r.modification_type != "change_units":
            assert old[r.donor_k][{"change_value": 4, "change_name": 2}[r.modification_type]] == changed[r.modification_type][0]
    noise = probe_data.noised(valid, "k", "value", "name")
    got = {r.k: r for r in noise.collect()}
    assert all((got[k].value != r[4] and len(got[k].value.split(".")[1]) == 1) if r[4] != "n/a" else (got[k].value == "n/a" and got[k].name != r[2] and got[k].modification_type == "noise_name") for k, r in old.items())
    assert {r.k: r.value for r in probe_data.noised(valid.repartition(5), "k", "value", "name").collect()} == {k: r.value for k, r in got.items()}
    numbers = spark.createDataFrame([("d0", 0, "table", "5"), ("d0", 0, "table", "6"), ("d0", 1, "text", "7"), ("d1", 9, "text", "8"), ("d2", 9, "table", "9")], "doc string, page int, source string, number string")
    tiers = {r.k: (r.value, r.modification_type) for r in probe_data.from_tables(valid, numbers, "doc", "page_number", "value").collect()}
    assert set(tiers) == {k for k, r in old.items() if r[1] != "d3"}
    for k, (value, tier) in tiers.items():
        doc, page = old[k][1], old[k][6][0]
        assert tier == {"d0": {0: "page table", 1: "page text", 2: "paper table"}[page], "d1": "paper text", "d2": "paper table"}[doc] and value in {"d0": {0: "56", 1: "7", 2: "56"}[page], "d1": "8", "d2": "9"}[doc]
    sample = probe_data.valid_sample(valid, "doc").collect()
    papers = {r.doc for r in sample}
    assert len(sample) >= 40 and len(sample) == sum(r[1] in papers for r in rows) and len(sample) < 80
    out = probe_data.probe_output(valid, probe_data.swapped(valid, "k", "doc", "page_number", ["value"]), noise, probe_data.from_tables(valid, numbers, "doc", "page_number", "value"), "k").collect()
    assert sorted(r.measurement_id for r in out) == list(range(len(out))) and sum(r.label == "valid" for r in out) == 80 and all(sum(r.gt_row_index == k for r in out) == 3 for k in old)


def test_noisy_numbers_keep_their_decimals(spark):
    cases = [(1.2345, "9.99", "1.23"), (7.6, "12", "8"), (0.5, "0.1000", "0.5000"), (-2.25, "1.0", "-2.3")]
    df = spark.createDataFrame(cases, "v double, l string, w string")
    assert all(r.got == r.w for r in df.select("w", probe_data.noisy_text(F.col("v"), F.col("l")).alias("got")).collect())


def test_donors_of_the_whole_table(spark):
    df = spark.createDataFrame([(i, "p", "a" if i else "b") for i in range(5)], "k int, p string, v string")
    got = {r.k: r.donor_v for r in curate.pick_donor(df, "k", [("any", [])], "v", F.col("k")).collect()}
    assert got == {0: "a", 1: "b", 2: "b", 3: "b", 4: "b"}


def test_best_columns_agree_with_dropping_row_by_row(spark):
    rng = random.Random(2)
    rows = [(i, *(None if rng.random() < p else 1 for p in (0.1, 0.5, 0.3, 0.8))) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, a int, b int, c int, d int")

    def kept(chosen):
        left = sorted((sum(r[j] is None for j in chosen) for r in rows), reverse=True)
        while len(left) > 1 and sum(left) > 0.2 * len(left) * len(chosen):
            left.pop(0)
        return len(left)

    got = {tuple(r["columns"]): r["rows"] for r in grouping.best_columns(df, ["a", "b", "c", "d"], (2, 3)).collect()}
    assert got == {tuple("abcd"[j - 1] for j in c): kept(c) for d in (2, 3) for c in combinations((1, 2, 3, 4), d)}
    assert grouping.dense_rows(df.select("k", "a", "b"), ["a", "b"], "k").count() == got["a", "b"]


def test_probes_find_the_head_that_tells(spark):
    rng = np.random.default_rng(1)
    rows = [(i, head, i % 2, i % 3, (rng.normal(size=4) + (3 * (i % 2) if head == 1 else 0)).tolist()) for i in range(120) for head in range(3)]
    df = spark.createDataFrame(rows, "id int, head int, y int, fold int, x array<double>")
    scores = probes.head_scores(df, ["head"], "x", "y", "fold", 3)
    top = probes.top_heads(scores, 1, "f1", ["head"]).collect()
    assert top[0]["head"] == 1 and top[0].f1 > 0.95 and probes.best_layer(scores, "head", "f1").first()["head"] == 1
    one = df.where("head = 1")
    p = {r.id: r.p for r in probes.calibrated_ensemble(one, one, "id", "x", "y", "fold", 3).collect()}
    assert np.mean([(p[i] > 0.5) == (i % 2 == 1) for i in range(120)]) > 0.95
    both = probes.joined_features(df, scores.where("head <> 0"), "id", ["head"], "x").first()
    assert len(both.x) == 8
    assert probes.cv_scores(one, "x", "y", "fold", 3).where("f1 > 0.9").count() == 3


def test_standardised_columns_and_components(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0)], "k int, a double, b double")
    got = {r.k: (r.a, r.b) for r in grouping.standardized(df, ["a", "b"]).collect()}
    assert got == {1: (-1.0, 0.0), 2: (1.0, 0.0), 3: (None, 0.0)}
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 3)) * [5, 1, 0.1]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, x array<double>")
    pcs = {r.k: r.components for r in grouping.principal_components(rows, "k", "x").collect()}
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    mine = np.array([pcs[i] for i in range(50)])
    assert np.allclose(np.abs(mine), np.abs((u * s)[:, :2]), atol=1e-6)
    cost = {r.k: r.cost for r in grouping.elbow(rows, "x", [1, 2, 3]).collect()}
    assert cost[1] == pytest.approx(((x - x.mean(0)) ** 2).sum()) and cost[1] > cost[2] > cost[3]


def test_em_has_history_and_refuses_degenerate_priors(spark):
    df = spark.createDataFrame([(0.9,), (0.8,), (0.3,), (None,)], "p double")
    rows, history = evaluate.rescaled_by_em(df, "p", 0.5)
    assert history[0] == 0.5 and len(history) > 3 and abs(history[-1] - history[-2]) < 1e-8
    assert sum(r.p_rescaled is None for r in rows.collect()) == 1
    with pytest.raises(ValueError):
        evaluate.rescaled_by_em(df, "p", 1.0)


def test_settings_with_one_label_have_no_auroc(spark):
    df = spark.createDataFrame([("a", 0.2, 1), ("a", 0.9, 1), ("b", 0.2, 0), ("b", 0.9, 1), ("b", None, 1)], "g string, p double, y int")
    got = {r.g: r for r in evaluate.probe_metrics(df, "p", "y", ["g"]).collect()}
    assert got["a"].auroc is None and got["a"].brier_skill is None and got["b"].auroc == 1.0 and got["b"].n == 2


def test_units_are_parsed_into_parts(spark):
    cases = {"nmol-n g-1 h-1": "nmol N g⁻¹ h⁻¹", "ug-c2h4 l-1": "µg C2H4 L⁻¹", "mg y-4": "mg yr-4", "  m  ": "m", "": ""}
    df = spark.createDataFrame([*cases.items(), (None, None)], "u string, w string")
    assert all(r.got == r.w for r in df.select("w", measures.normalized_units(F.col("u")).alias("got")).collect())
    kinds = {"nmol N g⁻¹ h⁻¹": "mass", "mg m⁻² kg⁻¹": "mass", "mg cm⁻²": "areal", "µg L⁻¹": "volumetric", "mg": "generic", "g m⁻³": "volumetric"}
    df = spark.createDataFrame(list(kinds.items()), "u string, w string")
    assert all(r.got == r.w for r in df.select("w", measures.rate_kind(F.col("u")).alias("got")).collect())


def test_documents_are_chosen_by_joins(spark, tmp_path):
    for name, text in (("W1", "one"), ("W2", "two"), ("W3", "three")):
        (tmp_path / f"{name}.txt").write_text(text)
    (tmp_path / "W4.md").write_text("no")
    metadata = spark.createDataFrame([("W1", "A")], "document_id string, title string")
    got = {r.document_id: (r.text, r.title) for r in runs.documents(spark, str(tmp_path), keep=["W1", "W2", "W9"], exclude=["W2"], metadata=metadata).collect()}
    assert got == {"W1": ("one", "A")}
    assert sorted(r.document_id for r in runs.documents(spark, str(tmp_path)).collect()) == ["W1", "W2", "W3"]
    assert sorted(r.name for r in runs.files(spark, str(tmp_path), ["W4.md"]).collect()) == ["W1.txt", "W2.txt", "W3.txt"]


def test_sinks_and_records(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 0.5, "x")], "k int, v double, s string")
    runs.write_json(df, str(tmp_path / "j"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "j")).collect()) == ['{"k":1,"v":null,"s":null}', '{"k":2,"v":0.5,"s":"x"}']
    runs.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).where("v is null").count() == 1
    vectors = spark.createDataFrame([(7, [1.0, 2.0]), (8, [3.0]), (9, None)], "k int, v array<float>")
    runs.write_activations(vectors, "k", "v", str(tmp_path / "n"))
    assert {r.measurement_id: (list(r.shape), list(r["values"])) for r in runs.activations(spark, str(tmp_path / "n")).collect()} == {"7": ([2], [1.0, 2.0]), "8": ([1], [3.0])}
    (tmp_path / "p.json").write_text(json.dumps({"1|a": [{"page": 3}], "1|e|tn|4": [{"page": 5}]}))
    got = {(r.document_id, r.item, r.entity_id, r.attribute, r.page_number, r.value.page) for r in runs.keyed_records(spark, str(tmp_path / "p.json"), "struct<page:int>").collect()}
    assert got == {("1", "a", None, None, None, 3), ("1", None, "e", "tn", 4, 5)}
    assert runs.provenance_key("3|x|y") == (3, "x|y") and runs.provenance_key("3|e|a|4") == (3, "e", "a", 4)
    table = runs.latex_table(spark.createDataFrame([("m", 0.5, 0.4, 0.6), ("n", None, None, None)], "model string, f1 double, lo double, hi double"), "model", ["f1"], {"f1": ("lo", "hi")})
    assert "\\textbf{0.500 $\\pm$ 0.100}" in table and "n & -- \\\\" in table


def test_runs_and_metadata(spark, tmp_path):
    rows = spark.createDataFrame([("m", "2024_01_01", "a"), ("m", "2024_02_01", None), ("n", "2023_01_01", "c")], "model string, run_date string, path string")
    assert {r.model: r.path for r in runs.resolved(rows, ["model"], "run_date", "path").collect()} == {"m": "a", "n": "c"}
    assert {r.model for r in runs.resolved(rows, ["model"], "run_date", "path", "2023_01_01").collect()} == {"n"}
    with pytest.raises(FileNotFoundError):
        runs.resolved(rows, ["model"], "run_date", "path", "1999_01_01")
    stored = json.loads(runs.run_metadata(spark, started=0.0, warnings=["w"], model="m").first().metadata)
    assert stored["model"] == "m" and stored["runtime_seconds"] > 0 and runs.check_run(stored) == ["w"]
    with pytest.raises(RuntimeError):
        runs.check_run(stored, strict=True)


def test_configuration(tmp_path):
    (tmp_path / "c.yaml").write_text("# models\nmodels:\n  - name: a\n    size: 7\n  - name: ${MODEL:-b}\n    tags: [x, 2]\nroot: ${ROOT}/runs\nlimit: 0.5\nnone:\nflag: true\n")
    got = config.load_config(str(tmp_path / "c.yaml"), {"ROOT": "/data"})
    assert got == {"models": [{"name": "a", "size": 7}, {"name": "b", "tags": ["x", 2]}], "root": "/data/runs", "limit": 0.5, "none": None, "flag": True}
    datasets = config.Registry("dataset", {"pond": config.Dataset("pond", "data/pond")})
    assert datasets.get("pond").directory == "data/pond"
    with pytest.raises(KeyError, match="pond"):
        datasets.get("lake")
    assert config.Paths("r", "pond").file("extraction", "m", "2024_01_01", "final.json", "3") == "r/pond/ablation_3/m/2024_01_01/final.json"


def test_human_judge_resumes(spark):
    sample = spark.createDataFrame([(i,) for i in range(5)], "k int")
    answers = spark.createDataFrame([(0, "valid", 1, None), (0, "invalid", 2, "deviation"), (1, "what", 1, None), (2, "skip", 1, None), (9, "valid", 1, None)], "k int, answer string, at int, error string")
    rest, counts = judges.human_progress(sample, answers, "k", "answer", "at", "error")
    assert sorted(r.k for r in rest.collect()) == [1, 3, 4]
    c = counts.first()
    assert (c.total, c.valid, c.invalid, c["skip"], c.open, c.deviation, c.hallucination) == (5, 0, 1, 1, 3, 1, 0)


def test_nearest_neighbours_fill_alike_in_any_number_of_blocks(spark):
    rng = random.Random(8)
    rows = [(i, *(None if rng.random() < 0.25 else float(rng.randint(0, 4)) for _ in range(3))) for i in range(40)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double")

    def brute(i, j):
        me = next(r for r in rows if r[0] == i)
        near = []
        for r in rows:
            both = [(x, y) for x, y in zip(me[1:], r[1:]) if x is not None and y is not None]
            if r[0] != i and r[j] is not None and both:
                near.append((((sum((x - y) ** 2 for x, y in both)) * 3 / len(both)) ** 0.5, r[0], r[j]))
        near = sorted(near)[:5]
        if not near:
            known = [r[j] for r in rows if r[j] is not None]
            return sum(known) / len(known)
        same = [v for d, _, v in near if d == 0]
        return sum(same) / len(same) if same else sum(v / d for d, _, v in near) / sum(1 / d for d, _, v in near)

    for block in (1000, 7):
        got = {r.k: r for r in grouping.knn_fill(df, "k", ["a", "b", "c"], block_rows=block).collect()}
        assert len(got) == 41
        for r in rows:
            for j, c in enumerate("abc", 1):
                assert got[r[0]][c] == pytest.approx(r[j] if r[j] is not None else brute(r[0], j))


def test_cached_results_are_keyed_by_what_made_them(spark, tmp_path):
    made = []

    def build(n):
        made.append(n)
        return spark.range(n)

    first = runs.cached(spark, str(tmp_path), "r", lambda: build(3), {"n": 3})
    assert first.count() == 3 and runs.cached(spark, str(tmp_path), "r", lambda: build(3), {"n": 3}).count() == 3 and made == [3]
    assert runs.cached(spark, str(tmp_path), "r", lambda: build(4), {"n": 4}).count() == 4 and made == [3, 4]
