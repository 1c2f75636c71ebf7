"""The extraction pipeline as joins: provenance, events, values; the model stage is pluggable."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions import markup
from tarnflow.operators import tables as table_operators
from tarnflow.runtime import cut, small

Client = Callable[[list[str]], list[str]]


def first_json(text: str | None) -> str | None:
    """The first complete JSON object or array in a text, null if there is none."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text or ""):
        try:
            value, _ = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        return json.dumps(value, ensure_ascii=False)
    return None


def complete(prompts: DataFrame, prompt: str, schema: str, client: Client, required: Sequence[str], retries: int = 2, batch: int = 32, keep_prompt: bool = True) -> DataFrame:
    """prompts (without the prompt itself unless keep_prompt) with raw, parsed (struct of schema) and ok; empty or invalid replies are asked for again up to retries times.

    A reply is valid if its first JSON value has the required fields. Keep the result by a checkpoint or a written stage: a model may
    answer otherwise when a lost task is computed again.
    """
    kept = [c for c in prompts.columns if keep_prompt or c != prompt]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.select(*kept).schema) + ", raw string, json string"

    def valid(reply: str) -> str | None:
        found = first_json(reply)
        try:
            value = json.loads(found) if found else None
        except ValueError:
            return None
        return found if isinstance(value, dict) and all(value.get(k) is not None for k in required) or isinstance(value, list) and not required else None

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (whole.iloc[i : i + 1000] for whole in frames for i in range(0, len(whole), 1000)):
            texts = f[prompt].tolist()
            raw, good = [""] * len(texts), [None] * len(texts)
            open_ = list(range(len(texts)))
            for _ in range(retries + 1):
                for i in range(0, len(open_), batch):
                    part = open_[i : i + batch]
                    for j, reply in zip(part, client([texts[x] for x in part])):
                        raw[j], good[j] = reply, valid(reply)
                open_ = [j for j in open_ if good[j] is None]
                if not open_:
                    break
            yield f[kept].assign(raw=raw, json=good)

    asked = prompts.mapInPandas(ask, columns)
    return asked.select(*kept, "raw", F.from_json("json", schema).alias("parsed"), F.col("json").isNotNull().alias("ok"))


def shared_pages(entity_prov: DataFrame, attribute_prov: DataFrame, tables: bool) -> DataFrame:
    """(document_id, entity_id, attribute, page, table): pages, or tables, on which both the entity and the attribute are reported.

    Without tables: prose pages, table null on both sides. With tables: equal tables, the page as the entity's provenance has it, the last by page.
    """
    if not tables:
        e = entity_prov.where("table_number is null").select("document_id", "entity_id", "page_number").distinct()
        a = attribute_prov.where("table_number is null").select("document_id", "attribute", "page_number").distinct()
        return e.join(a, ["document_id", "page_number"]).select("document_id", "entity_id", "attribute", "page_number", F.lit(None).cast("int").alias("table_number"))
    e = entity_prov.where("table_number is not null").groupBy("document_id", "entity_id", "table_number").agg(F.max("page_number").alias("page_number"))
    a = attribute_prov.where("table_number is not null").select("document_id", "attribute", "table_number").distinct()
    return e.join(a, ["document_id", "table_number"]).select("document_id", "entity_id", "attribute", "page_number", "table_number")


def with_events(pairs: DataFrame, events: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """pairs with one row per event; a pair without events gets one of nulls."""
    return pairs.join(events.select(*keys, *fields), list(keys), "left")


def paper_texts(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of each paper the pages (document_id, page_number, tables array, text), the tables (document_id, table_number, text) and the whole (document_id, text).

    A document without page marks is page 0. Pages, or tables, of one number in several documents of a paper are put together in the order of doc_id.
    """
    rows = documents.where("document_id is not null and text is not null")
    found = F.filter(markup.pages(F.col("text")), lambda p: p["number"].isNotNull())
    whole = F.array(F.struct(F.lit(0).alias("number"), F.col("text").alias("body")))

    def joined(parts: DataFrame, *keys: str) -> DataFrame:
        return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "pos", "text"))), lambda x: x["text"]), "\n\n").alias("text"))

    def parts(c: Column, name: str) -> DataFrame:
        return rows.select("document_id", "doc_id", F.posexplode(c).alias("pos", "p")).select("document_id", "doc_id", "pos", F.col("p.number").alias(name), F.col("p.body").alias("text"))

    pages = joined(parts(F.when(F.size(found) > 0, found).otherwise(whole), "page_number"), "document_id", "page_number")
    on_page = F.array_sort(F.array_distinct(F.filter(F.transform(markup.tables(F.col("text")), lambda t: t["number"]), lambda n: n.isNotNull())))
    tables = joined(parts(markup.tables(F.col("text")), "table_number").where("table_number is not null"), "document_id", "table_number")
    return pages.withColumn("tables", on_page), tables, joined(rows.select("document_id", "doc_id", F.lit(0).alias("pos"), "text"), "document_id")


#: what the model is asked for in each stage; a reply is one JSON value
INSTRUCTIONS = {
    "entities": "List the water bodies that measurements are reported for, each with its name, identifiers, location and ecosystem as they are written.",
    "provenance": "Say whether this page reports data of what is named (has_data), and whether they stand in a table (in_table).",
    "attributes": "Say of each attribute listed whether the paper reports measured values of it (detected).",
    "events": "List the dates and other details that tell the measurements of this attribute at this water body apart.",
    "values": "Give the value and the units reported for this water body, attribute and event (has_value, value, units).",
    "cells": "Name the row and the column of the table in which the value stands, and its units (has_value, row_index, column_index, units).",
    "standardise": "Give the central value as a plain number, and its units as one of those to choose from.",
    "clean": "Write the table again with an index column and one header row; leave every value as it is.",
    "triples": "List every measurement of the paper with its water body, attribute, event, value and units.",
    "pairs": "List the pairs of water body and attribute that the paper reports values of.",
    "places": "List the pages, and the tables on them, that report this attribute of this water body.",
}
EXPLAIN = "Explain the answer first in a field explanation."


@dataclass(frozen=True)
class Variant:
    """Which stages a run has and what they see: an ablation changes one thing of the usual run.

    context: 'page' or 'document', the text in prompts for events and values. table_values: 'lookup' asks for row and column and takes the cell,
    'direct' asks for the value. pairs: None finds entities, attributes and their places apart; 'pages' asks for pairs and looks for
    them on every page; 'document' asks for the places of every entity and attribute with the whole paper. triples: all in one question.
    own_attribute_only: a pair is read for its own attribute only.
    """

    context: str = "page"
    table_values: str = "direct"
    pairs: str | None = None
    triples: bool = False
    explain: bool = True
    own_attribute_only: bool = True


ABLATIONS = {
    "1": Variant(triples=True), "2": Variant(pairs="pages"), "3": Variant(pairs="document"), "4": Variant(context="document"), "5": Variant(table_values="direct"), "6": Variant(explain=False),
}
BASELINE = Variant(table_values="lookup")


def instructed(prompts: Client, explain: bool = True) -> Client:
    """A client that is sent each prompt behind the instructions of its task."""

    def ask(texts: list[str]) -> list[str]:
        told = []
        for t in texts:
            task = t.partition("\n")[0].removeprefix("Task: ")
            told.append("\n\n".join(x for x in (INSTRUCTIONS.get(task), EXPLAIN if explain else None, t) if x))
        return prompts(told)

    return ask


def extracted_entities(wholes: DataFrame, client: Client) -> DataFrame:
    """(document_id, entity_id, name, identifiers, location, ecosystem): the water bodies the model lists for each paper, numbered in its order; an
    invalid reply gives none."""
    rows = wholes.select("document_id", _prompt("entities", F.col("text")).alias("prompt"))
    fields = ", ".join(f"{c}:string" for c in _ENTITY)
    got = complete(rows, "prompt", f"struct<items:array<struct<{fields}>>>", client, ["items"], retries=4, keep_prompt=False).where("ok")
    listed = got.select("document_id", F.posexplode("parsed.items").alias("n", "i"))
    return listed.select("document_id", F.concat(F.lit("doc_"), "document_id", F.lit("_entity_"), F.col("n").cast("string")).alias("entity_id"), "i.*")


def cleaned_tables(pages: DataFrame, client: Client) -> DataFrame:
    """pages (document_id, page_number, text, more) whose pages with a table are written again by the model; a blank reply changes nothing."""
    asked = pages.where(F.col("text").rlike("(?i)<table[ >]")).select("document_id", "page_number", _prompt("clean", F.col("text")).alias("prompt"))
    got = complete(asked, "prompt", "struct<text:string>", client, ["text"], retries=4, keep_prompt=False).where("ok").select("document_id", "page_number", F.col("parsed.text").alias("__reply"))
    return table_operators.spliced(pages, got, ["document_id"], "page_number", "text", "__reply")


def direct_triples(wholes: DataFrame, client: Client) -> DataFrame:
    """(document_id, entity and event fields, attribute, value, units): every measurement of a paper in one question; those without a value are left out."""
    fields = ", ".join(f"{c}:string" for c in (*_ENTITY, *_EVENT, "attribute", "value", "units"))
    rows = wholes.select("document_id", _prompt("triples", F.col("text")).alias("prompt"))
    got = complete(rows, "prompt", f"struct<items:array<struct<{fields}>>>", client, ["items"], retries=4, keep_prompt=False).where("ok")
    return got.select("document_id", F.explode("parsed.items").alias("i")).select("document_id", "i.*").where("value is not null")


def extracted_pairs(wholes: DataFrame, attributes: DataFrame, client: Client) -> DataFrame:
    """(document_id, entity_id, entity fields, attribute): pairs the model lists for each paper; entities are numbered by their first pair, and attributes
    outside the catalogue are left out."""
    fields = ", ".join(f"{c}:string" for c in (*_ENTITY, "attribute"))
    listed = F.broadcast(attributes.agg(F.array_join(F.array_sort(F.collect_list("attribute")), ", ").alias("listed")))  # one row
    rows = wholes.crossJoin(listed).select("document_id", _prompt("pairs", F.col("text"), ("Attributes", F.col("listed"))).alias("prompt"))
    got = complete(rows, "prompt", f"struct<items:array<struct<{fields}>>>", client, ["items"], retries=4, keep_prompt=False).where("ok")
    pairs = got.select("document_id", F.posexplode("parsed.items").alias("n", "i")).select("document_id", "n", "i.*").join(small(attributes.select("attribute")), "attribute")
    first = pairs.groupBy("document_id", F.struct(*_ENTITY).alias("e")).agg(F.min("n").alias("first"))
    keyed = pairs.withColumn("e", F.struct(*_ENTITY)).join(first, ["document_id", "e"])
    return keyed.select("document_id", F.concat(F.lit("doc_"), "document_id", F.lit("_entity_"), F.col("first").cast("string")).alias("entity_id"), *_ENTITY, "attribute").distinct()


def pair_places(pairs: DataFrame, wholes: DataFrame, client: Client) -> DataFrame:
    """(document_id, entity_id, attribute, page_number, table_number) that the model names for each pair from the whole paper."""
    rows = pairs.join(wholes, "document_id").select("document_id", "entity_id", "attribute", _prompt("places", F.col("text"), ("Entity", _entity()), ("Attribute", F.col("attribute"))).alias("prompt"))
    got = complete(rows, "prompt", "struct<items:array<struct<page_number:int,table_number:int>>>", client, ["items"], retries=4, keep_prompt=False).where("ok")
    return got.select("document_id", "entity_id", "attribute", F.explode("parsed.items").alias("i")).select("document_id", "entity_id", "attribute", "i.*").where("page_number is not null").distinct()


def split_places(places: DataFrame, own_attribute_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Provenance of entities and of attributes from that of pairs. With own_attribute_only an entity is keyed with its attribute, so that it meets no other."""
    pair = F.concat_ws("|", "entity_id", "attribute") if own_attribute_only else F.col("entity_id")
    attribute = F.concat_ws("|", "entity_id", "attribute") if own_attribute_only else F.col("attribute")
    where = ["page_number", "table_number"]
    return places.select("document_id", pair.alias("entity_id"), *where).distinct(), places.select("document_id", attribute.alias("attribute"), *where).distinct()


def union_places(parts: DataFrame) -> DataFrame:
    """(document_id, attribute, page_number, table_number, terms) over the pairs of an attribute; of several lists of terms the last by entity stands."""
    terms = parts.where("terms is not null").groupBy("document_id", "attribute").agg(F.max_by("terms", "entity_id").alias("terms"))
    return parts.select("document_id", "attribute", "page_number", "table_number").distinct().join(terms, ["document_id", "attribute"], "left")


def unique_entities(rows: DataFrame, order: str) -> DataFrame:
    """Of each entity of a paper its first row by order."""
    first = rows.groupBy("document_id", "entity_id").agg(F.min(F.struct(order, *(c for c in rows.columns if c not in ("document_id", "entity_id", order)))).alias("r"))
    return first.select("document_id", "entity_id", "r.*")


def attribute_list(attributes: DataFrame) -> DataFrame:
    """One row: the attributes as numbered lines 'i. name: description', in their order; the catalogue is bounded."""
    rows = F.array_sort(F.collect_list(F.struct("attribute", F.coalesce("description", F.lit("")).alias("d"))))
    return attributes.agg(F.array_join(F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["attribute"], F.lit(": "), x["d"])), "\n").alias("listed"))


def any_shared_pages(entity_prov: DataFrame, attribute_prov: DataFrame) -> DataFrame:
    """(document_id, entity_id, attribute, page_number): pages on which both are reported, in a table or not."""
    e = entity_prov.select("document_id", "entity_id", "page_number").distinct()
    a = attribute_prov.select("document_id", "attribute", "page_number").distinct()
    return e.join(a, ["document_id", "page_number"]).select("document_id", "entity_id", "attribute", "page_number")


def run_variant(variant: Variant, entities: DataFrame | None, attributes: DataFrame, documents: DataFrame, client: Client) -> DataFrame:
    """A run of documents by variant, from nothing known but, where given, the entities; the result of direct_triples or of run()."""
    asked = instructed(client, variant.explain)
    _, _, wholes = paper_texts(documents)
    if variant.triples:
        return direct_triples(wholes, asked)
    spark = documents.sparkSession
    none = spark.createDataFrame([], "document_id string, entity_id string, attribute string, page_number int, table_number int, date string, additional_details string")
    if variant.pairs is None:
        named = entities if entities is not None else cut(extracted_entities(wholes, asked))
        return run(named, attributes, documents, none, none, none, asked, variant)
    if variant.pairs == "pages":
        pairs = cut(extracted_pairs(wholes, attributes, asked))
        pages, _, _ = paper_texts(documents)
        places = provenance(pairs, ["entity_id", "attribute"], [("Entity", _entity()), ("Attribute", F.col("attribute"))], pages, asked)
    else:
        named = entities if entities is not None else cut(extracted_entities(wholes, asked))
        pairs = named.select("document_id", "entity_id", *_ENTITY).join(detected_attributes(wholes, attributes, asked), "document_id")
        places = pair_places(pairs, wholes, asked)
    places = cut(places)
    e, a = split_places(places, own_attribute_only=False)
    known = pairs.select("document_id", "entity_id", *_ENTITY).distinct()
    got = run(known, attributes, documents, e, a, none, asked, variant, search=False)
    return got.join(places.select("document_id", "entity_id", "attribute").distinct(), ["document_id", "entity_id", "attribute"], "left_semi") if variant.own_attribute_only else got


def _prompt(task: str, text: Column, *about: tuple[str, Column]) -> Column:
    """Parts without a value are left out."""
    return F.concat_ws("\n\n", F.lit(f"Task: {task}"), *(F.concat(F.lit(f"{n}: "), F.nullif(c.cast("string"), F.lit(""))) for n, c in about), F.concat(F.lit("Context: "), text))


_ENTITY = ("name", "identifiers", "location", "ecosystem")
_EVENT = ("date", "additional_details")


def _entity() -> Column:
    return F.coalesce(F.nullif(F.concat_ws(", ", *_ENTITY), F.lit("")), F.lit("unnamed"))


def provenance(asked: DataFrame, keys: Sequence[str], about: Sequence[tuple[str, Column]], pages: DataFrame, client: Client) -> DataFrame:
    """(document_id, keys, page_number, table_number): the pages of its paper on which the model finds what a row of asked names.

    Found in a table, it is one row for each table of the page; else the table is null. An invalid reply gives no row.
    """
    rows = asked.join(pages, "document_id").withColumn("prompt", _prompt("provenance", F.col("text"), *about)).select("document_id", *keys, "page_number", "tables", "prompt")
    got = complete(rows, "prompt", "struct<has_data:boolean,in_table:boolean>", client, ["has_data", "in_table"], keep_prompt=False).where("ok and parsed.has_data")
    table = F.when(F.col("parsed.in_table"), F.col("tables")).otherwise(F.array(F.lit(None).cast("int")))
    return got.select("document_id", *keys, "page_number", F.explode(table).alias("table_number"))


def detected_attributes(wholes: DataFrame, attributes: DataFrame, client: Client) -> DataFrame:
    """(document_id, attribute) of the catalogue's attributes the model finds measured in a paper; names outside the catalogue are ignored."""
    listed = F.broadcast(attributes.agg(F.array_join(F.array_sort(F.collect_list(F.concat("attribute", F.lit(": "), "description"))), "\n").alias("listed")))  # one row
    rows = wholes.crossJoin(listed).select("document_id", _prompt("attributes", F.col("text"), ("Attributes", F.col("listed"))).alias("prompt"))
    got = complete(rows, "prompt", "struct<items:array<struct<attribute_name:string,detected:boolean>>>", client, ["items"], retries=4, keep_prompt=False).where("ok")
    items = got.select("document_id", F.explode("parsed.items").alias("i")).where("i.detected").select("document_id", F.col("i.attribute_name").alias("attribute"))
    return items.join(small(attributes.select("attribute")), "attribute").select("document_id", "attribute").distinct()


def run(entities: DataFrame, attributes: DataFrame, documents: DataFrame, entity_known: DataFrame, attribute_known: DataFrame, events_known: DataFrame, client: Client, variant: Variant = Variant(), search: bool = True) -> DataFrame:
    """Values read by the model for every entity, attribute and event that share a prose page or a table, standardised by the model.

    Provenance and events are those known and, with search, those the model finds on the pages of documents. Prompts hold the text of the page, or of the
    table; where the documents of a paper lack it, the whole paper, and no text where no document is there.
    """
    pages, tables, wholes = paper_texts(documents)
    named = entities.groupBy("document_id", "entity_id").agg(F.min(F.struct(*_ENTITY)).alias("e")).select("document_id", "entity_id", "e.*")
    keys = named.select("document_id", "entity_id").unionByName(entity_known.select("document_id", "entity_id")).distinct()
    named = keys.join(named, ["document_id", "entity_id"], "left")
    described = small(attributes)
    columns = ["page_number", "table_number"]
    e_prov, a_prov = entity_known.select("document_id", "entity_id", *columns), attribute_known.select("document_id", "attribute", *columns)
    if search:
        detected = detected_attributes(wholes, attributes, client).unionByName(attribute_known.select("document_id", "attribute")).distinct()
        e_prov = provenance(named, ["entity_id"], [("Entity", _entity())], pages, client).unionByName(e_prov)
        a_prov = provenance(detected.join(described, "attribute"), ["attribute"], [("Attribute", F.col("attribute")), ("Description", F.col("description"))], pages, client).unionByName(a_prov)
    e_prov, a_prov = cut(e_prov.distinct()), cut(a_prov.distinct())
    on_text, on_table = shared_pages(e_prov, a_prov, False).withColumn("source", F.lit("text")), shared_pages(e_prov, a_prov, True).withColumn("source", F.lit("table"))
    page_text, table_text, paper_text = pages.select("document_id", "page_number", F.col("text").alias("page_text")), tables.withColumnRenamed("text", "table_text"), wholes.withColumnRenamed("text", "paper_text")

    def read(rows: DataFrame) -> DataFrame:
        """rows with what the prompts tell of entity, attribute and text"""
        told = rows.join(named, ["document_id", "entity_id"], "left").join(described, "attribute")
        told = told.join(page_text, ["document_id", "page_number"], "left").join(table_text, ["document_id", "table_number"], "left").join(paper_text, "document_id", "left")
        own = F.when(F.col("source") == "table", F.coalesce("table_text", "page_text")).otherwise(F.col("page_text"))
        if variant.context == "document":
            own = F.col("paper_text")
        return told.withColumn("text", F.coalesce(own, "paper_text")).drop("page_text", "table_text", "paper_text")

    about = [("Entity", _entity()), ("Attribute", F.col("attribute")), ("Description", F.col("description"))]
    where = ["document_id", "entity_id", "attribute", "page_number"]
    event = ["date", "additional_details"]
    # events are asked once for each page, whatever the tables on it
    shared = on_text.unionByName(on_table).select(*where).distinct().withColumns({"table_number": F.lit(None).cast("int"), "source": F.lit("text")})
    found = complete(read(shared).select(*where, _prompt("events", F.col("text"), *about, ("Page", F.col("page_number"))).alias("prompt")), "prompt", "struct<items:array<struct<date:string,additional_details:string>>>", client, ["items"], keep_prompt=False)
    found = found.where("ok").select(*where, F.explode("parsed.items").alias("i")).select(*where, "i.date", "i.additional_details")
    events = found.unionByName(events_known.select(*where, *event)).distinct()
    asked = with_events(on_text.unionByName(on_table), events, where, event)
    kept = [*where, *event, "table_number", "source"]
    told = [*about, ("Event", F.concat_ws(", ", *event)), ("Page", F.col("page_number")), ("Table", F.col("table_number"))]
    by_lookup = F.col("source") == "table" if variant.table_values == "lookup" else F.lit(False)
    answered = complete(read(asked.where(~by_lookup)).select(*kept, _prompt("values", F.col("text"), *told).alias("prompt")), "prompt", "struct<has_value:boolean,value:string,units:string>", client, ["has_value"], keep_prompt=False)
    values = answered.where("ok and parsed.has_value and parsed.value is not null").select(*kept, F.col("parsed.value").alias("value"), F.col("parsed.units").alias("units"))
    if variant.table_values == "lookup":
        cells = table_operators.table_cells(tables, ["document_id", "table_number"], "text")
        placed = complete(read(asked.where(by_lookup)).select(*kept, _prompt("cells", F.col("text"), *told).alias("prompt")), "prompt", "struct<has_value:boolean,row_index:string,column_index:string,units:string>", client, ["has_value"], keep_prompt=False)
        placed = placed.where("ok and parsed.has_value").select(*kept, F.col("parsed.row_index").alias("row_name"), F.col("parsed.column_index").alias("column_name"), F.col("parsed.units").alias("units"))
        found_cells = table_operators.lookup(cells, placed, ["document_id", "table_number"]).where("cell is not null")
        values = values.unionByName(found_cells.select(*kept, F.col("cell").alias("value"), "units"))
    return standardised(read(values).select(*kept, "value", "units", _prompt("standardise", F.col("text"), *told, ("Units to choose from", F.col("unit_options")), ("Value", F.col("value")), ("Units", F.col("units"))).alias("prompt")), client)


def standardised(values: DataFrame, client: Client) -> DataFrame:
    """values with value and units as the model standardises them from prompt, which is dropped; as they were where the reply is invalid."""
    got = complete(values, "prompt", "struct<value:string,units:string>", client, ["value"], keep_prompt=False)
    return got.withColumns({c: F.when(F.col("ok"), F.col(f"parsed.{c}")).otherwise(F.col(c)) for c in ("value", "units")}).drop("raw", "parsed", "ok")
