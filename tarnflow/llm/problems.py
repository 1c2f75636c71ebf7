"""Queries of the problems solved in this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import copies, leaks, linkage, packing, scans, sentences, splits
from tarnflow.operators import units
from tarnflow.sources.tables import table

PROPORTIONS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
TOKENIZERS = os.environ.get("TARNFLOW_TOKENIZERS", "/opt/tokenizers")
CAPACITY = 2048
ENTITY_FIELDS = {"name": "leaf", "identifiers": "list", "location": "list"}


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.probe_groups(table(spark, d, "probe_dataset"), table(spark, d, "papers"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.linked_pairs(p2_groups(spark, d)).select(F.col("a").alias("document_id_a"), F.col("b").alias("document_id_b"))


def p2_split(spark: SparkSession, d: str) -> DataFrame:
    """(measurement_id, component, split) of every row of probe_dataset."""
    papers = table(spark, d, "papers").where("document_id is not null").groupBy(splits.paper_number(F.col("document_id")).alias("number")).agg(F.min("document_id").alias("paper"))
    groups = p2_groups(spark, d)
    rows = table(spark, d, "probe_dataset").select("measurement_id", "label", splits.paper_number(F.col("document_id")).alias("number"), F.upper(F.trim("document_id")).alias("raw"))
    rows = rows.join(papers, "number", "left").withColumn("id", F.coalesce("paper", "raw")).join(groups, "id")
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("label") == "valid", 1).otherwise(0)).alias("positives"))
    return rows.join(splits.split_groups(sizes, PROPORTIONS), "component").select("measurement_id", "component", "split")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    classes = copies.copy_classes(table(spark, d, "entities"), "row_id", ENTITY_FIELDS)
    return classes.where("copies > 1 and row_id <> first").select(F.col("first").alias("row_id"), F.col("row_id").alias("copy_row_id"))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed(table(spark, d, "entities"), "row_id", ENTITY_FIELDS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(table(spark, d, "contexts"), table(spark, d, "papers"))[0]


def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(scans.repair(table(spark, d, "contexts"), table(spark, d, "papers"))[1])


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, entity_id, site_no, confidence)"""
    values = units.to_common_units(table(spark, d, "extraction_values"), table(spark, d, "papers"), table(spark, d, "attribute_catalogue"), ["entity_id"])
    return linkage.link(table(spark, d, "entities"), values.select("entity_id", "attribute_std", "value_common"), table(spark, d, "raw_pond"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_links(spark, d).select("entity_id", "site_no").distinct()


def p8_bins(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, piece, size, bin): documents in containers of CAPACITY tokens."""
    sizes = packing.token_sizes(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json")
    return packing.pack(sizes, "doc_id", "tokens", CAPACITY)


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id").distinct()


def p10_units(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents").select("doc_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents").select("doc_id", "text"), with_text=False).select("doc_id", "end_pos")


QUERIES = {"p2_found": p2_found, "p2_split": p2_split, "p5_found": p5_found, "p5_collapsed": p5_collapsed, "p6_found": p6_found, "p6_paragraphs": p6_paragraphs, "p7_found": p7_found, "p7_links": p7_links, "p8_bins": p8_bins, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_units": p10_units}


_BARE = r"regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')"
_PARTS = "list_sort(list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), '[,;/|\\n]'), lambda x: " + _BARE.format(c="x") + "), lambda x: x <> ''))"
_COPIES = f"n AS (SELECT row_id, {_BARE.format(c="coalesce(name, '')")} AS nm, {_PARTS.replace('{c}', 'identifiers')} AS ids, {_PARTS.replace('{c}', 'location')} AS loc FROM entities)"
_NUMBER = r"try_cast(regexp_extract({c}, '(?i)w[^0-9a-z]*0*([0-9]+)', 1) AS BIGINT)"
#: authors of the written styles: entries, then surname and first initial
_AUTHORS = r"""
en AS (SELECT document_id, trim(unnest(regexp_split_to_array(regexp_replace(author, ',?\s*\b[Ee]t\s+al\b\.?', ';', 'g'), '\s*(?:[;|&]|,?\s+and\s+)\s*'))) AS e FROM papers WHERE author IS NOT NULL),
au AS (SELECT document_id, CASE WHEN contains(e, ',') THEN regexp_extract(e, '^([^,]*)', 1) WHEN regexp_matches(e, '^(.*\p{L}{3}.*?)\s+((?:\p{Lu}\.?[\s-]?){1,4})$') THEN regexp_extract(e, '^(.*\p{L}{3}.*?)\s+((?:\p{Lu}\.?[\s-]?){1,4})$', 1) ELSE regexp_extract(e, '(\S+)\s*$', 1) END AS family,
 CASE WHEN contains(e, ',') THEN regexp_extract(e, ',(.*)$', 1) WHEN regexp_matches(e, '^(.*\p{L}{3}.*?)\s+((?:\p{Lu}\.?[\s-]?){1,4})$') THEN regexp_extract(e, '^(.*\p{L}{3}.*?)\s+((?:\p{Lu}\.?[\s-]?){1,4})$', 2) ELSE regexp_extract(e, '^(.*?)\S+\s*$', 1) END AS given FROM en
 WHERE e <> '' AND lower(regexp_replace(e, '[^\p{L}]+', '', 'g')) NOT IN ('anonymous', 'anon', 'noauthor', 'unknown', 'authorunknown', 'unknownauthor', 'notstated', 'na', 'none', 'null', ''))"""
SQL = {
    "p2_found": "WITH RECURSIVE k AS (SELECT document_id, " + _NUMBER.format(c="document_id") + " AS number FROM papers), r AS (SELECT k.document_id AS doc, label, gt_row_index, donor_gt_row_index FROM probe_dataset p JOIN k ON k.number = " + _NUMBER.format(c="p.document_id") + "), " + _AUTHORS + r""",
x AS (SELECT DISTINCT document_id AS doc, lower(family) AS family, lower(regexp_extract(given, '(\p{L})', 1)) AS initial FROM au WHERE document_id IN (SELECT doc FROM r)),
ed AS (SELECT DISTINCT a.doc AS u, b.doc AS v FROM x a JOIN x b ON a.family = b.family AND (a.initial = b.initial OR a.initial = '' OR b.initial = '') WHERE a.doc <> b.doc
 UNION SELECT a.doc, b.doc FROM r a JOIN r b ON a.donor_gt_row_index = b.gt_row_index WHERE a.label = 'invalid' AND b.label = 'valid' AND a.doc <> b.doc),
e2 AS (SELECT u, v FROM ed UNION SELECT v, u FROM ed), reach AS (SELECT DISTINCT u AS a, u AS b FROM e2 UNION SELECT reach.a, e2.v FROM reach JOIN e2 ON reach.b = e2.u)
SELECT a AS document_id_a, b AS document_id_b FROM reach WHERE a < b""",
    "p5_found": "WITH " + _COPIES + ", f AS (SELECT row_id AS copy_row_id, min(row_id) OVER (PARTITION BY nm, ids, loc) AS row_id FROM n) SELECT row_id, copy_row_id FROM f WHERE row_id <> copy_row_id",
    "p5_collapsed": "WITH " + _COPIES + ", f AS (SELECT row_id AS r, min(row_id) OVER (PARTITION BY nm, ids, loc) AS first, count(*) OVER (PARTITION BY nm, ids, loc) AS copies FROM n) SELECT e.*, f.copies FROM f JOIN entities e ON e.row_id = f.first WHERE f.r = f.first",
}
