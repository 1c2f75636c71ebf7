"""Page and table markup of documents as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markup of pages and tables, which is the format of the documents.
PAGE = r'(?s)<page number="(\d+)">(.*?)</page>'
TABLE = r'(?s)<table number="(\d+)">(.*?)</table>'
BLANK = r"^\s+|\s+$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def _found(c: Column, pattern: str) -> Column:
    """array of struct(number, body), in the order of the text; a null text has none"""
    numbers = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    return F.zip_with(numbers, bodies, lambda n, b: F.struct(n.try_cast("int").alias("number"), b.alias("body")))


def pages(c: Column) -> Column:
    return _found(c, PAGE)


def tables(c: Column) -> Column:
    return _found(c, TABLE)


def page_numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(PAGE), F.lit(1)), lambda n: n.try_cast("int"))


def cells(table_body: Column) -> Column:
    """Texts of a table's cells without tags and LaTeX delimited by \\(..\\) or \\[..\\], empty ones left out."""
    # a cell runs from its opening tag to the next closing one
    opened = F.filter(F.split(table_body, r"(?i)<t[dh](?![a-z])"), lambda x: x.rlike("(?is)^[^<>]*>.*</t[dh]>"))
    begun = F.transform(opened, lambda x: F.substring(x, F.instr(x, ">") + 1, F.length(x)))
    inner = F.transform(begun, lambda x: F.get(F.split(x, "(?i)</t[dh]>", 2), F.lit(0)))
    plain = F.transform(inner, lambda x: stripped(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", ""), r"(?s)\\\(.*?\\\)|\\\[.*?\\\]", "")))
    return F.filter(plain, lambda x: x != "")


def tables_on_page(page_body: Column) -> Column:
    """Numbers of the tables of a page, ascending."""
    return F.array_sort(F.transform(tables(page_body), lambda t: t["number"]))


def page_index(c: Column) -> Column:
    """array of struct(page, text, tables) of a document; of pages of one number the last stands, in the order of their first places."""
    every = pages(c)
    last = F.filter(every, lambda p, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda q: q["number"] == p["number"]))
    return F.transform(last, lambda p: F.struct(p["number"].alias("page"), stripped(p["body"]).alias("text"), tables_on_page(p["body"]).alias("tables")))


def without_front_matter(c: Column) -> Column:
    """The text behind a leading block between two lines of ---."""
    return F.regexp_replace(c, r"(?s)^---[ \t]*\n.*?\n---[ \t]*(?:\n|$)", "")


def says_table(c: Column) -> Column:
    """Whether the front matter says that the page is a table."""
    return F.coalesce(F.lower(F.regexp_extract(c, r"(?s)^---\s*\n.*?\bis_table:\s*(\w+).*?\n---", 1)) == "true", F.lit(False))


def pages_or_whole(text: Column, wanted: Column) -> Column:
    """The wanted pages' blocks with their tags, parted by blank lines; the whole text if none is wanted or none is there."""
    blocks = F.zip_with(F.regexp_extract_all(text, F.lit(r'(?s)(<page number="\d+">.*?</page>)'), F.lit(1)), page_numbers(text), lambda b, n: F.struct(b.alias("b"), n.alias("n")))
    kept = F.transform(F.filter(blocks, lambda x: F.array_contains(wanted, x["n"])), lambda x: x["b"])
    return F.when(F.size(F.coalesce(kept, F.array().cast("array<string>"))) > 0, F.array_join(kept, "\n\n")).otherwise(text)


def number_tables(c: Column) -> Column:
    """Literal <table> tags numbered from 1 in order."""
    parts = F.split(c, "<table>")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit('<table number="'), i.cast("string"), F.lit('">'), p))), "")


def assembled(numbers: Column, texts: Column) -> Column:
    """Page blocks around texts, tables numbered through the document."""
    return number_tables(F.array_join(F.zip_with(numbers, texts, lambda n, t: F.concat(F.lit('<page number="'), n.cast("string"), F.lit('">\n'), t, F.lit("\n</page>"))), "\n"))
