import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.functions import fuzzy
from tarnflow.operators import dedupe, evaluate, grouping, matching
from tarnflow.plans import extraction
from tarnflow.sources import runs
from tarnflow.streaming import ingest


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarity_agrees_with_a_plain_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert fuzzy.lcs_length(a, b) == slow_lcs(a, b)
    assert fuzzy.ratio("", "") == 100.0 and fuzzy.partial_ratio("pond", "the old pond") == 100.0
    assert fuzzy.token_set_ratio("a b c", "c b a") == 100.0 and fuzzy.token_set_ratio("", "a") == 0.0


def test_assignment_is_maximal():
    rng = random.Random(2)
    for _ in range(60):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        w = [[round(rng.random(), 3) if rng.random() > 0.4 else 0.0 for _ in range(m)] for _ in range(n)]
        got = matching.assignment(w)
        assert len({j for j in got if j >= 0}) == sum(j >= 0 for j in got)
        total = sum(w[i][j] for i, j in enumerate(got) if j >= 0)
        size = max(n, m)
        pad = [[w[i][j] if i < n and j < m else 0.0 for j in range(size)] for i in range(size)]
        assert total == pytest.approx(max(sum(pad[i][p[i]] for i in range(size)) for p in permutations(range(size))))


def test_strict_match_with_band_and_nulls(spark):
    left = spark.createDataFrame([(1, "A ", 1.0), (2, None, 2.0), (3, "b", None), (4, "a", 5.0)], "gt_idx int, k string, v double")
    right = spark.createDataFrame([(1, "a", 1.0009), (2, None, 2.0), (3, "B", None), (4, "a", 5.002)], "ex_idx int, k string, v double")
    assert sorted(map(tuple, matching.strict_match(left, right, ["k"], ("v", 1e-3)).collect())) == [(1, 1), (2, 2), (3, 3)]


def test_first_fit_keeps_the_order(spark):
    rows = [("e", i, v, u) for i, (v, u) in enumerate([("1.0", "m"), ("1.000001", "M "), ("2.0", "m"), ("1.0000095", "m"), ("1.00002", "m"), ("text", None), ("TEXT ", None), ("1.0", "cm")])]
    df = spark.createDataFrame(rows, "g string, i int, v string, u string")
    got = dedupe.first_fit(df, ["g"], "v", "u", ["i"], ["i"]).collect()
    assert sorted([x.i for x in r.provenance] for r in got) == [[0, 1, 3], [2], [4], [5, 6], [7]]


def test_wilson_reproduces_published_intervals(spark):
    k, n = round(0.358 * 3333), 3333
    lo, hi = spark.range(1).select(*evaluate.wilson(F.lit(float(k)), F.lit(float(n)))).first()
    assert (hi - lo) / 2 == pytest.approx(0.016, abs=5e-4) and lo < k / n < hi
    assert spark.range(1).select(*evaluate.wilson(F.lit(0.0), F.lit(0.0))).first() == (None, None)


def test_em_prior_finds_the_shift(spark):
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.8
    x = rng.normal(np.where(y, 1.0, -1.0))
    p = 1 / (1 + np.exp(-2 * x))  # under even priors
    df = spark.createDataFrame([(float(v),) for v in p], "p double")
    assert evaluate.em_prior(df, "p", 0.5) == pytest.approx(0.8, abs=0.02)


def test_bins_use_float_edges(spark):
    rows = spark.createDataFrame([(0.0,), (0.3,), (0.30000000000000004,), (1.0,), (1.1,), (None,)], "p double").select(evaluate.bin_of(F.col("p"), 10)).collect()
    assert [r[0] for r in rows] == [0, 2, 3, 9, None, None]


def test_dense_rows_agrees_with_dropping_one_by_one(spark):
    rng = random.Random(5)
    for seed in range(4):
        rows = [(i, *(None if rng.random() < 0.15 + 0.2 * seed else 1.0 for _ in range(4))) for i in range(40)]
        df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double")
        left = sorted(((sum(x is None for x in r[1:]), r[0]) for r in rows), key=lambda x: (-x[0], x[1]))
        while len(left) > 1 and sum(n for n, _ in left) > 0.2 * len(left) * 4:
            left.pop(0)
        assert sorted(r.k for r in grouping.dense_rows(df, list("abcd"), "k").collect()) == sorted(k for _, k in left)


def test_kfold_and_numbers_without_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "g string")
    assert sorted((r.g, r.fold) for r in grouping.kfold(df, "g", 2).collect()) == [("a", 0), ("b", 1), ("c", 1)]
    assert grouping.kfold(df.where("false"), "g", 2).count() == 0
    assert [r.n for r in grouping.group_number(spark.createDataFrame([(None,), ("b",), ("a",)], "g string"), ["g"], "n").orderBy("n").collect()] == [0, 1, 2]


def test_model_stage_asks_again(spark, tmp_path):
    state = str(tmp_path / "seen")

    def client(prompts):
        import os

        again = os.path.exists(state)
        open(state, "w").close()
        return ['{"a": 1}' if again or p == "p0" else "nothing" for p in prompts]

    df = spark.createDataFrame([("p0",), ("p1",)], "prompt string").coalesce(1)
    assert [(r.prompt, r.ok, r.parsed.a) for r in extraction.complete(df, "prompt", "a int", client, ["a"]).orderBy("prompt").collect()] == [("p0", True, 1), ("p1", True, 1)]
    never = extraction.complete(df, "prompt", "a int", lambda ps: ["{}"] * len(ps), ["a"]).collect()
    assert [r.ok for r in never] == [False, False]
    assert extraction.first_json('x {bad} [1, {"a": 2}] y') == '[1, {"a": 2}]' and extraction.first_json(None) is None


def test_sources(spark, tmp_path):
    for n in ("a", "b", "c"):
        (tmp_path / f"{n}.txt").write_text(f"text {n}\nline")
    got = runs.documents(spark, str(tmp_path), keep=["a", "b"], exclude=["b"]).collect()
    assert [(r.document_id, r.text) for r in got] == [("a", "text a\nline")]
    (tmp_path / "g.json").write_text('[{"x": NaN, "y": "k"}, {"x": 2.5, "y": null}]')
    rows = runs.nan_to_null(runs.ground_truth(spark, str(tmp_path / "g.json"), "x double, y string")).collect()
    assert [(r.x, r.y) for r in rows] == [(None, "k"), (2.5, None)]
    with pytest.raises(ValueError):
        runs.ground_truth(spark, "a.xml", "x int")
    first = runs.write_stage(spark.range(3).toDF("i"), str(tmp_path), "stage")
    assert first.count() == 3 and runs.write_stage(spark.range(9).toDF("i"), str(tmp_path), "stage").count() == 3
    assert runs.provenance_key("12|e") == (12, "e") and runs.provenance_key("W1|e|f") == ("W1", "e|f")


def test_streaming_goes_on_where_it_ended(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "item_id int, t string").withColumn("t", F.to_timestamp("t"))
    src, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    rows.coalesce(1).write.parquet(src)
    for _ in range(2):
        stream = ingest.read_new_files(spark, src, rows.schema)
        ingest.run_available(ingest.without_redeliveries(stream, "item_id", "t", "1 day"), out, at).awaitTermination()
    assert sorted(r.item_id for r in spark.read.parquet(out).collect()) == [1, 2]
