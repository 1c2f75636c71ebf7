"""Queries of table reading, judging, evaluation and curation on the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions import markup, measures
from tarnflow.operators import curate, evaluate, grouping, judges, pages, probe_data, probes, tables
from tarnflow.plans import extraction, judging
from tarnflow.queries.reference import _PROV_SQL, _SCORED_SQL, _SQL_PAGES, _SQL_ROWS, _SQL_TABLES, _prov, _scored, _tables, _wide
from tarnflow.runtime import ranked
from tarnflow.sources import runs
from tarnflow.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _r(*columns: str) -> list:
    """Columns rounded as both sides round them."""
    return [F.round(c, 6).alias(c) for c in columns]


# ---- pages and tables ---------------------------------------------------------------------------------------------------------

@query("q54_page_index", "WITH " + _SQL_PAGES + r"""SELECT doc_id, page_number AS page, md5(regexp_replace(arg_max(body, pos), '^\s+|\s+$', '', 'g')) AS text_md5, len(regexp_extract_all(arg_max(body, pos), '(?s)<table number="(\d+)">(.*?)</table>', 1))::INT AS n_tables FROM pages GROUP BY ALL""")
def q54(spark, d):
    """Pages with their texts and tables; of pages of one number the last."""
    index = table(spark, d, "documents").select("doc_id", F.explode(markup.page_index(F.col("text"))).alias("p"))
    return index.select("doc_id", "p.page", F.md5("p.text").alias("text_md5"), F.size("p.tables").alias("n_tables"))


@query("q55_tables_on_pages", "WITH " + _SQL_PAGES + r"""SELECT doc_id, page_number, unnest(regexp_extract_all(body, '(?s)<table number="(\d+)">(.*?)</table>', 1))::INT AS table_number FROM pages""")
def q55(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(markup.pages(F.col("text"))).alias("p"))
    return found.select("doc_id", F.col("p.number").alias("page_number"), F.explode(markup.tables_on_page(F.col("p.body"))).alias("table_number"))


@query("q56_front_matter", "SELECT doc_id, md5(text) AS text_md5, doc_id % 2 = 0 AS is_table FROM documents WHERE text IS NOT NULL AND NOT starts_with(text, '---')")
def q56(spark, d):
    rows = table(spark, d, "documents").where("text is not null and not startswith(text, '---')")
    said = F.concat(F.lit("---\nprimary_language: en\nis_table: "), (F.col("doc_id") % 2 == 0).cast("string"), F.lit("\n---\n"), F.col("text"))
    return rows.select("doc_id", F.md5(markup.without_front_matter(said)).alias("text_md5"), markup.says_table(said).alias("is_table"))


@query("q57_row_names", """SELECT p_partkey, '<table><tr><th>name</th></tr><tr><th>row 1</th><td>' || p_name || '</td></tr><tr><th>own</th><td>1</td></tr><tr><th>row 2</th><td>' || p_size || '</td></tr></table>' AS html FROM part""")
def q57(spark, d):
    html = F.concat(F.lit("<table><tr><th>name</th></tr><tr><td>"), "p_name", F.lit("</td></tr><tr><th>own</th><td>1</td></tr><tr><td>"), F.col("p_size").cast("string"), F.lit("</td></tr></table>"))
    return table(spark, d, "part").select("p_partkey", tables.with_row_names(html).alias("html"))


def _cells(spark, d) -> DataFrame:
    return tables.table_cells(_tables(spark, d), ["doc_id", "table_number"], "body")


@query("q58_cells_by_name", "WITH " + _SQL_ROWS + "SELECT doc_id, table_number, row_name, column_name, nullif(arg_min(cell, row_no), '') AS cell FROM y WHERE row_name IS NOT NULL AND column_name IS NOT NULL GROUP BY ALL")
def q58(spark, d):
    """Every cell looked up by its row and column; of several rows of a name the first."""
    cells = _cells(spark, d)
    wanted = cells.where("row_name is not null and column_name is not null").select("doc_id", "table_number", "row_name", "column_name").distinct()
    return tables.lookup(cells, wanted, ["doc_id", "table_number"])


@query("q59_unpivoted", "WITH " + _SQL_ROWS + r"""SELECT doc_id, table_number, row_name, column_name AS variable, string_split_regex(cell, '\s*(?:±|\+/-)\s*')[1] AS centre, string_split_regex(cell, '\s*(?:±|\+/-)\s*')[2] AS spread FROM y WHERE cell <> ''""")
def q59(spark, d):
    return tables.unpivoted(_cells(spark, d), ["doc_id", "table_number"])


_SQL_WANTED = r"""w AS (SELECT DISTINCT document_id, unnest(flatten(list_transform(regexp_extract_all(lower(extraction_location_details), '\btables?\s((?:[\s;,]*[0-9]+)+)', 1), lambda x: regexp_extract_all(x, '[0-9]+'))))::INT AS table_number FROM papers)"""


@query("q60_candidate_pages", "WITH " + _SQL_PAGES + ", " + _SQL_WANTED + r""", t AS (SELECT document_id, page_number, unnest(regexp_extract_all(body, '(?s)<table number="(\d+)">(.*?)</table>', 1))::INT AS table_number FROM (SELECT doc_id, page_number, arg_max(body, pos) AS body FROM pages GROUP BY ALL) JOIN documents USING (doc_id))
SELECT document_id, array_to_string(list_sort(list(DISTINCT page_number)), ',') AS pages FROM w JOIN t USING (document_id, table_number) GROUP BY document_id""")
def q60(spark, d):
    """The pages that hold the tables a paper's location names."""
    wanted = table(spark, d, "papers").select("document_id", F.explode(measures.table_numbers(F.col("extraction_location_details"))).alias("table_number")).distinct()
    return tables.candidate_pages(table(spark, d, "documents"), "document_id", "text", wanted).select("document_id", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@query("q61_numeric_cells", "WITH " + _SQL_TABLES + r""", c AS (SELECT doc_id, table_number, list_filter(list_transform(regexp_extract_all(body, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda x: try_cast(regexp_replace(x, '<[^>]+>|^\s+|\s+$', '', 'g') AS DOUBLE)), lambda x: x IS NOT NULL) AS n FROM tabs)
SELECT doc_id, table_number, len(n)::INT AS numbers, round(coalesce(list_sum(n), 0), 4) AS total FROM c""")
def q61(spark, d):
    n = tables.numeric_cells(F.col("body"))
    return _tables(spark, d).select("doc_id", "table_number", F.size(n).alias("numbers"), F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("q62_field_pages")
def q62(spark, d):
    """The scan pages on which records of probe_dataset stand, by name, place and value."""
    weights = {"name": 2.0, "location": 1.0, "value": 3.0}
    rows = table(spark, d, "probe_dataset").where("label = 'valid'").select("measurement_id", F.upper(F.trim("document_id")).alias("document_id"), "name", "location", "value", "page_number")
    found = pages.scan_pages(table(spark, d, "contexts"), "document_id", "page_number", "context")
    return pages.attribute_pages(rows, found, "document_id", "measurement_id", weights, "value", "page_number")


# ---- judges ------------------------------------------------------------------------------------------------------------------

_J_SQL = """x AS (SELECT DISTINCT o_orderkey AS id, o_orderstatus AS s FROM orders), a AS (SELECT id, s, id % 2 = 0 AS v FROM x WHERE id % 5 <> 0), b AS (SELECT id, s, CASE WHEN id % 7 <> 0 THEN id % 3 = 0 END AS v FROM x WHERE id % 4 <> 0), c AS (SELECT id, s, id % 11 < 6 AS v FROM x WHERE id % 3 <> 0)"""


def _three(spark, d) -> dict[str, DataFrame]:
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s")).distinct()
    i = F.col("id")
    return {"a": x.where(i % 5 != 0).withColumn("judgement", i % 2 == 0), "b": x.where(i % 4 != 0).withColumn("judgement", F.when(i % 7 != 0, i % 3 == 0)), "c": x.where(i % 3 != 0).withColumn("judgement", i % 11 < 6)}


@query("q63_judge_merge", "WITH " + _J_SQL + """, k AS (SELECT id FROM a UNION SELECT id FROM b UNION SELECT id FROM c)
SELECT k.id, coalesce(a.s, b.s, c.s) AS s, a.v AS judgement_a, b.v AS judgement_b, c.v AS judgement_c, (coalesce(a.v, false)::INT + coalesce(b.v, false)::INT + coalesce(c.v, false)::INT) >= 2 AS judgement_combined FROM k LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN c USING (id)""")
def q63(spark, d):
    """Three judges by a full outer join, and their combined vote."""
    return judges.combined_vote(judges.merge(_three(spark, d), "id", ["s"], ["judgement"]), ["a", "b", "c", "human"])


@query("q64_judge_runs", "SELECT judge, max(struct_pack(d := run_date, p := path)).d AS run_date, max(struct_pack(d := run_date, p := path)).p AS path FROM (SELECT o_orderpriority AS judge, strftime(o_orderdate, '%Y_%m_%d') AS run_date, CASE WHEN o_orderkey % 3 <> 0 THEN 'run-' || o_orderkey END AS path FROM orders) WHERE path IS NOT NULL AND judge <> '5-LOW' GROUP BY judge")
def q64(spark, d):
    judge = F.when(F.col("o_orderpriority") == "5-LOW", judges.COMBINED).otherwise(F.col("o_orderpriority"))
    rows = table(spark, d, "orders").select(judge.alias("judge"), F.date_format("o_orderdate", "yyyy_MM_dd").alias("run_date"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("run-"), F.col("o_orderkey").cast("string"))).alias("path"))
    return judges.discover(rows)


_REPLY = "CASE event_id % 4 WHEN 0 THEN 'It is True, not false' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'unsure' END"


@query("q65_reply_votes", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS vote, event_id % 4 = 0 AS token_vote FROM events")
def q65(spark, d):
    r = F.expr(_REPLY)
    return table(spark, d, "events").select("event_id", judges.reply_vote(r).alias("vote"), judges.token_vote(r).alias("token_vote"))


@query("q66_human_progress", """WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'valid' WHEN o_orderkey % 5 = 0 THEN 'skip' ELSE 'invalid' END AS a, CASE o_orderkey % 3 WHEN 0 THEN 'hallucination' WHEN 1 THEN 'disorientation' ELSE 'deviation' END AS e FROM orders WHERE o_orderkey % 4 <> 3)
SELECT (SELECT count(*) FROM orders) AS total, count(*) FILTER (a = 'valid') AS valid, count(*) FILTER (a = 'invalid') AS invalid, count(*) FILTER (a = 'skip') AS skip, (SELECT count(*) FROM orders) - count(*) AS open,
 count(*) FILTER (a = 'invalid' AND e = 'hallucination') AS hallucination, count(*) FILTER (a = 'invalid' AND e = 'disorientation') AS disorientation, count(*) FILTER (a = 'invalid' AND e = 'deviation') AS deviation FROM l""")
def q66(spark, d):
    """What a human judge has answered, an earlier answer of each row outdated."""
    sample = table(spark, d, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    said = sample.where(k % 4 != 3)
    answer = F.when(k % 2 == 0, "valid").when(k % 5 == 0, "skip").otherwise("invalid")
    error = F.when(k % 3 == 0, "hallucination").when(k % 3 == 1, "disorientation").otherwise("deviation")
    last = said.select("o_orderkey", F.lit(2).alias("at"), answer.alias("answer"), error.alias("error"))
    first = said.select("o_orderkey", F.lit(1).alias("at"), F.lit("invalid").alias("answer"), F.lit("deviation").alias("error"))
    return judges.human_progress(sample, first.unionByName(last), "o_orderkey", "answer", "at", "error")[1]


_DOCS_SQL = "t AS (SELECT document_id, min(text) AS text FROM documents WHERE document_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL)"


@query("q67_chat_contexts", "WITH " + _DOCS_SQL + r""", p AS (SELECT measurement_id, trim(upper(document_id)) AS document_id, coalesce(page_number, []) AS ps, attribute FROM probe_dataset),
k AS (SELECT p.measurement_id, p.ps, t.text, regexp_extract_all(t.text, '(?s)(<page number="\d+">.*?</page>)', 1) AS blocks FROM p JOIN t USING (document_id) WHERE attribute IN (SELECT attribute FROM attribute_catalogue)),
m AS (SELECT measurement_id, text, list_filter(blocks, lambda b: list_contains(ps, regexp_extract(b, '<page number="(\d+)">', 1)::INT)) AS b FROM k)
SELECT measurement_id, md5(CASE WHEN len(b) > 0 THEN array_to_string(b, chr(10) || chr(10)) ELSE text END) AS context_md5 FROM m""")
def q67(spark, d):
    """The text a judge is shown for each record: its pages, the whole document where it names none."""
    docs = table(spark, d, "documents").where("document_id is not null and text is not null").groupBy("document_id").agg(F.min("text").alias("text"))
    rows = table(spark, d, "probe_dataset").withColumn("document_id", F.trim(F.upper("document_id")))
    prompt = judging.judge_query(["name", "identifiers", "location", "ecosystem"], ["date", "additional_details"], "attribute", "value", "units")
    entries = judges.chat_entries(rows, docs, table(spark, d, "attribute_catalogue"), "document_id", "attribute", "text", "page_number", prompt, ["page_score"])
    return entries.select("measurement_id", F.md5("context").alias("context_md5"))


@query("q68_sections", """SELECT measurement_id, 16 AS instructions_begin, 16 + 13 AS instructions_end, 16 + 13 + 13 AS context_begin, 42 + length(coalesce(name, '')) AS context_end, 42 + length(coalesce(name, '')) + 11 AS query_begin, 42 + length(coalesce(name, '')) + 11 + length(attribute) AS query_end FROM probe_dataset""")
def q68(spark, d):
    s = judges.sections(F.lit("Answer truly."), F.col("name"), F.col("attribute"))
    rows = table(spark, d, "probe_dataset").select("measurement_id", s.alias("s"))
    return rows.select("measurement_id", *(F.col(f"s.{n}.{e}").alias(f"{n}_{e}") for n in ("instructions", "context", "query") for e in ("begin", "end")))


@query("q69_with_reference", "SELECT o.o_orderkey, m.v AS human FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS v FROM lineitem WHERE l_linenumber > 5 GROUP BY ALL) m ON m.l_orderkey = o.o_orderkey")
def q69(spark, d):
    other = table(spark, d, "lineitem").where("l_linenumber > 5").withColumnRenamed("l_orderkey", "o_orderkey")
    return judges.with_reference(table(spark, d, "orders").select("o_orderkey"), other, "o_orderkey", "l_quantity", "human")


@query("q70_back_mapping", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS custom_id, CASE WHEN event_id % 3 <> 0 THEN 'reply ' || event_id END AS reply FROM events")
def q70(spark, d):
    """Replies put back by the number a request was sent under; requests without a reply keep null."""
    sent = ranked(table(spark, d, "events").select("event_id"), [F.col("event_id")], "custom_id")
    replies = sent.where("event_id % 3 <> 0").select("custom_id", F.concat(F.lit("reply "), F.col("event_id").cast("string")).alias("reply"))
    return judges.with_reference(sent, replies, "custom_id", "reply", "reply")


# ---- metrics -----------------------------------------------------------------------------------------------------------------

_RATED = ["name", "identifiers", "location", "ecosystem"]


@query("q71_missing_rates", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct", round(avg(({c} IS NULL)::INT), 6) AS missing_rate FROM entities""" for c in _RATED))
def q71(spark, d):
    return evaluate.missing_rates(table(spark, d, "entities"), _RATED).select("column", "distinct", *_r("missing_rate"))


@query("q72_recovery_from_labels", "SELECT round(avg((o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)::INT), 6) AS recovery, count(*) AS recovery_n FROM orders")
def q72(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("gt_idx"), F.col("o_orderkey").alias("ex_idx"))
    predicted = keys.select("ex_idx", (F.col("ex_idx") % 2 == 0).alias("valid"))
    return evaluate.recovery_from_labels(keys.select("gt_idx"), keys.where("gt_idx % 3 = 0"), predicted, ("gt_idx", "ex_idx"), "valid").select(*_r("recovery"), "recovery_n")


@query("q73_validity_or_judged", "SELECT round(avg((o_orderkey % 3 = 0 OR o_orderkey % 5 = 1)::INT), 6) AS validity, count(*) AS validity_n FROM orders")
def q73(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("ex_idx"))
    judged = F.when(F.col("ex_idx") % 7 != 0, F.col("ex_idx") % 5 == 1)
    return evaluate.validity_or_judged(keys, keys.where("ex_idx % 3 = 0"), "ex_idx", F.coalesce(judged, F.col("ex_idx") % 5 == 1)).select(*_r("validity"), "validity_n")


@query("q74_validity_from_labels", "SELECT attribute, round(coalesce(sum((label = 'valid' AND page_score > 0.7)::INT) / nullif(sum((page_score > 0.7)::INT), 0), 0), 6) AS validity FROM probe_dataset WHERE page_score IS NOT NULL GROUP BY attribute")
def q74(spark, d):
    rows = table(spark, d, "probe_dataset").where("page_score is not null")
    return evaluate.validity_from_labels(rows, F.col("label") == "valid", F.col("page_score") > 0.7, ["attribute"]).select("attribute", *_r("validity"))


_METRICS_SQL = """c AS (SELECT {k}, p, sum(y) AS pos, sum(1 - y) AS neg FROM {s} GROUP BY ALL), r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {k} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
u AS (SELECT {k}, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc FROM r GROUP BY ALL), e AS (SELECT i, i * 0.1::DOUBLE AS lo, (i + 1) * 0.1::DOUBLE AS hi FROM range(10) t(i)),
b AS (SELECT {k}, e.i, count(*) AS n, avg(p) AS cf, avg(y) AS ac FROM {s} JOIN e ON p >= e.lo AND (p < e.hi OR (e.i = 9 AND p <= 1.0)) GROUP BY ALL), g AS (SELECT {k}, sum(n * abs(cf - ac)) / sum(n) AS ece FROM b GROUP BY ALL),
m AS (SELECT {k}, count(*) AS n, sum(y)::BIGINT AS n_pos, avg(((y = 1) = (p > 0.5))::INT) AS accuracy, sum((y = 1 AND p > 0.5)::INT) / nullif(sum((p > 0.5)::INT), 0) AS "precision", sum((y = 1 AND p > 0.5)::INT) / nullif(sum(y), 0) AS recall, 2 * sum((y = 1 AND p > 0.5)::INT) / nullif(sum(y) + sum((p > 0.5)::INT), 0) AS f1,
 avg((p - y) ** 2) AS brier, 1 - avg((p - y) ** 2) / nullif(avg(y) * (1 - avg(y)), 0) AS brier_skill FROM {s} GROUP BY ALL)
SELECT {k}, n, n_pos, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, round(auroc, 6) AS auroc, round(ece, 6) AS ece, round(brier, 6) AS brier, round(brier_skill, 6) AS brier_skill FROM m JOIN u USING ({k}) JOIN g USING ({k})"""
_SCORES = ("accuracy", "precision", "recall", "f1", "auroc", "ece", "brier", "brier_skill")


@query("q75_probe_metrics", "WITH " + _SCORED_SQL + ", " + _METRICS_SQL.format(k="attribute", s="s"))
def q75(spark, d):
    return evaluate.probe_metrics(_scored(spark, d), "p", "y", ["attribute"]).select("attribute", "n", "n_pos", *_r(*_SCORES))


@query("q76_settings", "WITH " + _SCORED_SQL + ", w AS (SELECT attribute, y, unnest(['NTP', 'Probe']) AS type, unnest([1 - p / 2, p]) AS p FROM s), " + _METRICS_SQL.format(k="attribute, type", s="w"))
def q76(spark, d):
    """All metrics of two kinds of prediction in every setting."""
    rows = _scored(spark, d).withColumn("ntp", 1 - F.col("p") / 2)
    return evaluate.settings_metrics(rows, ["attribute"], {"NTP": "ntp", "Probe": "p"}, "y").select("attribute", "type", "n", "n_pos", *_r(*_SCORES))


@query("q77_reliability_diagram", "WITH " + _SCORED_SQL + """, e AS (SELECT i::INT AS bin, i * 0.1::DOUBLE AS lo, (i + 1) * 0.1::DOUBLE AS hi, (i + 0.5) / 10 AS centre FROM range(10) t(i))
SELECT bin, round(centre, 6) AS centre, count(p) AS n, round(avg(p) + 1e-9, 6) AS confidence, round(avg(y) + 1e-9, 6) AS accuracy, round(sqrt(avg(y) * (1 - avg(y)) / nullif(count(p), 0)) + 1e-9, 6) AS sem FROM e LEFT JOIN s ON s.p >= e.lo AND (s.p < e.hi OR (e.bin = 9 AND s.p <= 1.0)) GROUP BY bin, centre""")
def q77(spark, d):
    found = evaluate.reliability_diagram(_scored(spark, d), "p", "y")
    return found.select("bin", *_r("centre"), "n", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("confidence", "accuracy", "sem")))  # off the ties of rounding


@query("q78_edge_sweep", """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS y, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey * 7919 % 997) / 1000 END AS w FROM orders), t AS (SELECT i::INT AS step, i / 100 AS th FROM range(101) x(i)),
m AS (SELECT step, th, count(*) AS n, sum(y::INT)::BIGINT AS n_pos, sum((coalesce(w > th, false) AND y)::INT) AS tp, sum(coalesce(w > th, false)::INT) AS said, sum((coalesce(w > th, false) = y)::INT) AS good FROM r, t GROUP BY ALL)
SELECT step, round(th, 6) AS threshold, n, n_pos, round(good / n, 6) AS accuracy, round(tp / nullif(said, 0), 6) AS "precision", round(tp / nullif(n_pos, 0), 6) AS recall, round(2 * tp / nullif(said + n_pos, 0), 6) AS f1 FROM m""")
def q78(spark, d):
    """Rows predicted true by their greatest edge weight, at 101 thresholds."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("ex_idx"))
    weight = (F.col("ex_idx") * 7919 % 997) / 1000
    edges = rows.where("ex_idx % 5 <> 0").select("ex_idx", weight.alias("weight")).unionByName(rows.where("ex_idx % 5 <> 0").select("ex_idx", (weight / 2).alias("weight")))
    found = evaluate.edge_sweep(rows, edges, "ex_idx", "weight", F.col("ex_idx") % 3 == 0)
    return found.select("step", *_r("threshold"), "n", "n_pos", *_r("accuracy", "precision", "recall", "f1"))


@query("q79_mean_deviation", "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, count(l_extendedprice) AS n FROM lineitem GROUP BY ALL")
def q79(spark, d):
    found = evaluate.mean_and_deviation(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return found.select("l_returnflag", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


@query("q80_row_product", "SELECT l_orderkey, round(coalesce(product(CASE WHEN l_linenumber % 2 = 0 THEN 1 - l_discount END), 1), 6) AS product FROM lineitem GROUP BY ALL")
def q80(spark, d):
    rows = table(spark, d, "lineitem").withColumn("v", F.when(F.col("l_linenumber") % 2 == 0, 1 - F.col("l_discount")))
    return evaluate.row_product(rows, "l_orderkey", "v").select("l_orderkey", *_r("product"))


@query("q81_rescaled", "WITH RECURSIVE " + _SCORED_SQL + ", e(i, pi) AS (SELECT 0, 0.4::DOUBLE UNION ALL SELECT i + 1, (SELECT avg(p * e.pi / 0.4 / (p * e.pi / 0.4 + (1 - p) * (1 - e.pi) / 0.6)) FROM s) FROM e WHERE i < 20), f AS (SELECT pi FROM e WHERE i = 20) SELECT measurement_id, round(p * pi / 0.4 / (p * pi / 0.4 + (1 - p) * (1 - pi) / 0.6), 6) AS rescaled FROM s, f")
def q81(spark, d):
    rows, _ = evaluate.rescaled_by_em(_scored(spark, d), "p", 0.4, rounds=20, tolerance=0.0)
    return rows.select("measurement_id", F.round("p_rescaled", 6).alias("rescaled"))


@query("q82_random_baseline")
def q82(spark, d):
    return evaluate.random_baseline(_scored(spark, d), "y", "measurement_id", 20, 0.05, 10).select("step", *_r("recovery", "validity"))


@query("q83_noise_levels")
def q83(spark, d):
    """Calibration error at 21 levels of label noise."""
    return evaluate.noise_sensitivity(_scored(spark, d), "p", "y", "measurement_id", [i / 20 for i in range(21)], 5).select("noise", *_r("mean", "std"), "n")


# ---- provenance --------------------------------------------------------------------------------------------------------------

@query("q84_any_shared_pages", "WITH " + _PROV_SQL + " SELECT DISTINCT e.document_id, e.entity_id, a.attribute, e.page_number FROM ep e JOIN ap a ON e.document_id = a.document_id AND e.page_number = a.page_number")
def q84(spark, d):
    return extraction.any_shared_pages(*_prov(spark, d))


@query("q85_unique_entities", "SELECT document_id, entity_id, min(struct_pack(a := row_id, b := name)).a AS row_id, min(struct_pack(a := row_id, b := name)).b AS name FROM entities GROUP BY ALL")
def q85(spark, d):
    return extraction.unique_entities(table(spark, d, "entities").select("document_id", "entity_id", "row_id", "name"), "row_id")


@query("q86_union_places", """WITH p AS (SELECT l_orderkey AS document_id, l_partkey AS entity_id, l_returnflag AS attribute, l_linenumber AS page_number, CASE WHEN l_suppkey % 3 = 0 THEN (l_suppkey % 7)::INT END AS table_number, CASE WHEN l_partkey % 2 = 0 THEN l_linestatus || l_partkey END AS terms FROM lineitem),
t AS (SELECT document_id, attribute, arg_max(terms, struct_pack(e := entity_id, t := terms)) AS terms FROM p WHERE terms IS NOT NULL GROUP BY ALL) SELECT DISTINCT p.document_id, p.attribute, p.page_number, p.table_number, t.terms FROM p LEFT JOIN t USING (document_id, attribute)""")
def q86(spark, d):
    rows = table(spark, d, "lineitem")
    terms = F.when(F.col("l_partkey") % 2 == 0, F.concat("l_linestatus", F.col("l_partkey").cast("string")))
    parts = rows.select(F.col("l_orderkey").alias("document_id"), F.struct("l_partkey", terms.alias("t")).alias("entity_id"), F.col("l_returnflag").alias("attribute"), F.col("l_linenumber").alias("page_number"), F.when(F.col("l_suppkey") % 3 == 0, (F.col("l_suppkey") % 7).cast("int")).alias("table_number"), terms.alias("terms"))
    return extraction.union_places(parts)


@query("q87_pair_keys", "SELECT DISTINCT l_orderkey AS document_id, l_partkey || '|' || l_returnflag AS entity_id, l_linenumber AS page_number FROM lineitem")
def q87(spark, d):
    places = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").cast("string").alias("entity_id"), F.col("l_returnflag").alias("attribute"), F.col("l_linenumber").alias("page_number"), F.lit(None).cast("int").alias("table_number"))
    return extraction.split_places(places)[0].drop("table_number")


@query("q88_document_metadata", "SELECT e.row_id, e.document_id, p.title, p.year FROM entities e JOIN papers p USING (document_id)")
def q88(spark, d):
    return table(spark, d, "entities").select("row_id", "document_id").join(table(spark, d, "papers").select("document_id", "title", "year"), "document_id")


@query("q89_index_remap", """WITH g AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS old_idx FROM orders), t AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS new_idx FROM orders WHERE o_orderkey % 3 = 0) SELECT g.old_idx, t.new_idx FROM g JOIN t USING (o_orderkey)""")
def q89(spark, d):
    """Positions in a whole table as positions in its test split."""
    rows = table(spark, d, "orders").select("o_orderkey")
    whole = ranked(rows, [F.col("o_orderkey")], "old_idx")
    test = ranked(rows.where("o_orderkey % 3 = 0"), [F.col("o_orderkey")], "new_idx")
    return whole.join(test, "o_orderkey").select("old_idx", "new_idx")


@query("q90_processed_extraction", "SELECT measurement_id, CASE attribute WHEN 'tn' THEN 'total nitrogen' WHEN 'tp' THEN 'total phosphorus' WHEN 'ph' THEN 'pH' END AS attribute, CASE WHEN attribute <> 'ph' THEN units END AS units, round(try_cast(CASE WHEN NOT regexp_matches(value, '[_dDfF]') THEN value END AS DOUBLE), 6) AS value FROM probe_dataset")
def q90(spark, d):
    """Extracted rows as the evaluation takes them: numbers, no units for pH, attributes by their full names, others null."""
    names = F.create_map(*(F.lit(x) for x in ("tn", "total nitrogen", "tp", "total phosphorus", "ph", "pH")))
    rows = table(spark, d, "probe_dataset")
    number = F.when(~F.col("value").rlike("[_dDfF]"), F.col("value")).try_cast("double")
    return rows.select("measurement_id", F.try_element_at(names, F.col("attribute")).alias("attribute"), F.when(F.col("attribute") != "ph", F.col("units")).alias("units"), F.round(number, 6).alias("value"))


# ---- ground truth and probe records ------------------------------------------------------------------------------------------

@query("q91_truth_records", "SELECT p.gt_row_index, p.measurement_id, p.value, CASE WHEN len(list_filter(p.page_number, lambda x: x IS NOT NULL)) > 0 THEN len(list_filter(p.page_number, lambda x: x IS NOT NULL)) END AS n_pages FROM probe_dataset p WHERE label = 'valid' AND value IS NOT NULL AND trim(upper(document_id)) IN (SELECT document_id FROM documents)")
def q91(spark, d):
    rows = table(spark, d, "probe_dataset").where("label = 'valid'").withColumn("document_id", F.trim(F.upper("document_id")))
    kept = probe_data.truth_records(rows, table(spark, d, "documents"), "document_id", "value", "page_number")
    return kept.select("gt_row_index", "measurement_id", "value", F.when(F.col("page_number").isNotNull(), F.size("page_number").cast("bigint")).alias("n_pages"))


_TRUTH_SQL = """r AS (SELECT p.measurement_id, q.title, p.attribute, try_cast(p.value AS DOUBLE) AS value FROM probe_dataset p JOIN papers q ON q.document_id = trim(upper(p.document_id)) WHERE p.label = 'valid' AND NOT regexp_matches(p.value, '[_dDfF]')),
t AS (SELECT lower(trim(title)) AS t, min(struct_pack(d := document_id, u := units)) AS p FROM papers GROUP BY ALL), c AS (SELECT attribute, min(unit) AS unit FROM attribute_catalogue WHERE is_common GROUP BY ALL)"""


@query("q92_ground_truth", "WITH " + _TRUTH_SQL + """, j AS (SELECT r.*, t.p.d AS document_id, c.unit AS common, coalesce(json_extract_string(t.p.u, '$.' || r.attribute), c.unit) AS units FROM r JOIN t ON t.t = lower(trim(r.title)) JOIN c USING (attribute) WHERE r.value IS NOT NULL)
SELECT j.measurement_id, j.document_id, j.units, round(CASE WHEN j.units <> j.common THEN (j.value - coalesce(w.shift, 0)) / coalesce(w.factor, 1) ELSE j.value END, 6) AS value FROM j LEFT JOIN attribute_catalogue w ON w.attribute = j.attribute AND w.unit = j.units""")
def q92(spark, d):
    """Survey rows as ground truth of their papers, in the papers' units."""
    papers = table(spark, d, "papers")
    rows = table(spark, d, "probe_dataset").where("label = 'valid' and not value rlike '[_dDfF]'").withColumn("document_id", F.trim(F.upper("document_id")))
    raw = rows.join(papers.select("document_id", "title"), "document_id").select("measurement_id", "title", "attribute", F.col("value").try_cast("double").alias("value"))
    return probe_data.ground_truth(raw, papers, table(spark, d, "attribute_catalogue")).select("measurement_id", "document_id", "units", *_r("value"))


@query("q93_review_table", """WITH p AS (SELECT measurement_id, document_id, (CASE page_confidence WHEN 'ambiguous' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END) * 10 + CASE WHEN len(page_number) > 1 THEN 1 ELSE 0 END AS priority FROM probe_dataset)
SELECT measurement_id, priority, min(priority) OVER (PARTITION BY document_id) AS document_priority, CASE WHEN measurement_id % 4 = 0 THEN 'p' || measurement_id END AS corrected_page FROM p""")
def q93(spark, d):
    rows = table(spark, d, "probe_dataset")
    old = rows.where("measurement_id % 4 = 0").select("measurement_id", F.concat(F.lit("p"), F.col("measurement_id").cast("string")).alias("corrected_page"))
    out = curate.review_table(rows, old, "measurement_id", "document_id", "page_confidence", "page_number", {"ambiguous": 0, "medium": 1, "high": 2}, ["corrected_page"])
    return out.select("measurement_id", "priority", "document_priority", "corrected_page")


def _valid(spark, d) -> DataFrame:
    rows = table(spark, d, "probe_dataset").where("label = 'valid'").withColumn("document_id", F.trim(F.upper("document_id")))
    return rows.groupBy("gt_row_index").agg(*(F.min(c).alias(c) for c in ("document_id", "name", "attribute", "value", "units", "page_number")))


def _numbers(spark, d) -> DataFrame:
    """Numbers of the scans as 'text', every third of them as if it stood in a table."""
    words = table(spark, d, "contexts").select(F.col("document_id"), F.col("page_number").alias("page"), F.explode(F.regexp_extract_all("context", F.lit(r"\b[0-9]+(?:\.[0-9]+)?\b"), F.lit(0))).alias("number"))
    return words.distinct().withColumn("source", F.when(F.pmod(F.xxhash64("number"), F.lit(3)) == 0, "table").otherwise("text"))


@query("q94_probe_output")
def q94(spark, d):
    """Valid records, and invalid ones by swaps, noise and table numbers, as one probe table."""
    valid = _valid(spark, d)
    units = table(spark, d, "attribute_catalogue").where("unit is not null").groupBy("attribute").agg(F.array_sort(F.collect_set("unit")).alias("u"))
    options = {r.attribute: r.u for r in units.collect()}  # the fixed catalogue
    swaps = probe_data.swapped(valid, "gt_row_index", "document_id", "page_number", ["value", "name"], options)
    noise = probe_data.noised(valid, "gt_row_index", "value", "name")
    found = probe_data.from_tables(valid, _numbers(spark, d), "document_id", "page_number", "value")
    return probe_data.probe_output(valid, swaps, noise, found, "gt_row_index").drop("page_number")


@query("q95_valid_sample")
def q95(spark, d):
    return probe_data.valid_sample(_valid(spark, d), "document_id").select("gt_row_index", "document_id")


# ---- probes and clustering ---------------------------------------------------------------------------------------------------

@query("q96_top_heads", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 10")
def q96(spark, d):
    """The ten best of a score, ties to the greater index."""
    return probes.top_heads(table(spark, d, "part").select("p_partkey", "p_size"), 10, "p_size", ["p_partkey"])


@query("q97_best_layer", "SELECT min(p_partkey) AS p_partkey, max(p_size) AS p_size FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
def q97(spark, d):
    return probes.best_layer(table(spark, d, "part"), "p_partkey", "p_size")


@query("q98_shared_heads", "SELECT p_partkey FROM (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 40) INTERSECT SELECT p_partkey FROM (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 40)")
def q98(spark, d):
    part = table(spark, d, "part")
    one = lambda c: part.select("p_partkey", F.col(c).cast("double").alias("s"))
    return probes.shared_heads({"a": one("p_size"), "b": one("p_retailprice")}, 40, "s", ["p_partkey"])


def _heads(spark, d) -> DataFrame:
    """Four heads of 16 numbers each from every embedding, with a label and a fold."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("y"), (F.col("vec_id") % 5).cast("int").alias("fold"))
    return rows.select("vec_id", "y", "fold", F.explode(F.array(*(F.struct(F.lit(i // 2).alias("layer"), F.lit(i % 2).alias("head"), F.slice("embedding", 16 * i + 1, 16).alias("x")) for i in range(4)))).alias("h")).select("vec_id", "y", "fold", "h.*")


@query("q99_head_scores")
def q99(spark, d):
    """F1 and calibration error of a probe for each layer and head."""
    return probes.head_scores(_heads(spark, d), ["layer", "head"], "x", "y", "fold", 5).select("layer", "head", *_r("f1", "ece"))


@query("q100_ensemble")
def q100(spark, d):
    """Calibrated mean of probes on the two best heads together."""
    heads = _heads(spark, d)
    best = probes.top_heads(probes.head_scores(heads, ["layer", "head"], "x", "y", "fold", 5), 2, "f1", ["layer", "head"])
    both = probes.joined_features(heads, best, "vec_id", ["layer", "head"], "x").join(heads.select("vec_id", "y", "fold").distinct(), "vec_id")
    return probes.calibrated_ensemble(both, both, "vec_id", "x", "y", "fold", 5).select("vec_id", *_r("p"))


@query("q101_cv_scores")
def q101(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("y"), (F.col("vec_id") % 5).cast("int").alias("fold"))
    return probes.cv_scores(rows, "embedding", "y", "fold", 5).select("fold", "n", *_r("f1", "ece", "auroc"))


@query("q102_best_columns")
def q102(spark, d):
    """Every combination of two to four measured columns with the rows it keeps."""
    return grouping.best_columns(_wide(spark, d), ["discount", "price", "quantity", "tax"], (2, 3, 4))


@query("q103_elbow")
def q103(spark, d):
    return grouping.elbow(table(spark, d, "embeddings"), "embedding", [1, 2, 3]).select("k", F.round("cost", 4).alias("cost"))


@query("q104_components")
def q104(spark, d):
    found = grouping.principal_components(table(spark, d, "embeddings"), "vec_id", "embedding")
    return found.select("vec_id", *(F.round(F.col("components")[i], 4).alias(f"pc{i + 1}") for i in range(2)))


@query("q105_gamma_sweep")
def q105(spark, d):
    rows = table(spark, d, "embeddings").select(F.slice("embedding", 1, 4).alias("x"), (F.lit(1.0) / (1 + F.col("label"))).alias("p"))
    return grouping.gamma_sweep(rows, "x", "p", np.eye(3, 4), [0.0, 0.5, 1.0], range(4), 3, 20).select("gamma", *_r("mean", "std"), "n")


@query("q106_label_share", "SELECT l_orderkey, round(coalesce(avg(v), 0), 6) AS label FROM (SELECT l_orderkey, unnest([max(l_linenumber % 2), CASE WHEN max(l_partkey) % 2 = 0 THEN 1 END, CASE WHEN min(l_suppkey) % 3 = 0 THEN 0 END]) AS v FROM lineitem GROUP BY l_orderkey) GROUP BY l_orderkey")
def q106(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_linenumber") % 2).alias("a"), F.max("l_partkey").alias("b"), F.min("l_suppkey").alias("c"))
    g = g.select("l_orderkey", "a", F.when(F.col("b") % 2 == 0, 1).alias("b"), F.when(F.col("c") % 3 == 0, 0).alias("c"))
    return grouping.label_share(g, "l_orderkey", ["a", "b", "c"]).select("l_orderkey", *_r("label"))


@query("q107_standardized", """SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) + 0.0 AS p_size, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) + 0.0 AS p_retailprice FROM part""")
def q107(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return grouping.standardized(rows, ["p_size", "p_retailprice"]).select("p_partkey", *((F.round(c, 6) + 0.0).alias(c) for c in ("p_size", "p_retailprice")))


@query("q108_pinned_run", "SELECT o_custkey, strftime(o_orderdate, '%Y_%m_%d') AS run_date, max('run-' || lpad(o_orderkey::VARCHAR, 9, '0')) AS path FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders) GROUP BY ALL")
def q108(spark, d):
    """Runs of one date, the pinned one."""
    rows = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy_MM_dd").alias("run_date"), F.concat(F.lit("run-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("path"), "o_orderdate")
    day = rows.agg(F.max("o_orderdate").alias("x")).select(F.date_format("x", "yyyy_MM_dd").alias("d")).first()[0]
    pinned = rows.withColumn("latest", F.max("o_orderdate").over(Window.partitionBy("run_date"))).where(F.col("o_orderdate") == F.col("latest"))
    return runs.resolved(pinned, ["o_custkey"], "run_date", "path", day)
