"""HTML tables of documents as rows: reading, lookup, normalisation, and putting cleaned tables back."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions import markup, measures


class _Reader(HTMLParser):
    """Rows of cells of the outermost table; spans repeat a cell, tags inside cells are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None
        self.span, self.down, self.held = 1, 1, {}

    def _close(self) -> None:
        if self.cell is not None and self.rows:
            text = " ".join("".join(self.cell).split())
            row = self.rows[-1]
            for _ in range(self.span):
                self._fill(row)
                if self.down > 1:
                    self.held[len(row)] = (self.down - 1, text)
                row.append(text)
        self.cell = None

    def _fill(self, row: list[str]) -> None:
        """Puts cells that reach down from rows above where the row has come to."""
        while len(row) in self.held and self.held[len(row)][0] > 0:
            left, text = self.held[len(row)]
            self.held[len(row)] = (left - 1, text)
            row.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._close()
            self.rows.append([])
        elif tag in ("td", "th"):
            self._close()
            found = dict(attrs)
            size = lambda k: min(1000, int(found[k])) if (found.get(k) or "").isdigit() and int(found[k]) > 0 else 1
            self.span, self.down, self.cell = size("colspan"), size("rowspan"), []
            if not self.rows:
                self.rows.append([])

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()
            if tag == "tr" and self.rows:
                self._fill(self.rows[-1])

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def read_rows(html: str | None) -> list[list[str]]:
    """Cell texts by row; broken markup gives what can be read, none gives no rows."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._close()
    return [r for r in reader.rows if r]


GRID = "row_no int, row_name string, column_name string, cell string"


def table_cells(tables: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """(keys, row_no, row_name, column_name, cell) of the body rows of HTML tables.

    The first row is the header. Row names are the cells under a header 'index', or where there is none the first cells. Rows that are
    shorter than the header end with nulls, cells beyond it have a null column name; a null or unreadable body gives no rows.
    """
    schema = ", ".join(f"`{k}` {tables.schema[k].dataType.simpleString()}" for k in keys) + ", " + GRID

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for *ids, html in zip(*(f[k] for k in keys), f[body]):
                rows = read_rows(html if isinstance(html, str) else None)
                if len(rows) < 2:
                    continue
                head = rows[0]
                at = next((i for i, h in enumerate(head) if h.strip().lower() == "index"), 0)
                for n, row in enumerate(rows[1:], 1):
                    padded = row + [None] * (len(head) - len(row))
                    out += [(*ids, n, padded[at] if at < len(padded) else None, head[i] if i < len(head) else None, c) for i, c in enumerate(padded) if i != at]
            yield pd.DataFrame(out, columns=[*keys, "row_no", "row_name", "column_name", "cell"]).astype(object)

    return tables.select(*keys, body).mapInPandas(scan, schema)


def lookup(cells: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """wanted (keys, row_name, column_name) with cell: the cell of that row and column, of several rows of a name the first; empty cells and
    cells that aren't there are null."""
    on = [*keys, "row_name", "column_name"]
    first = cells.where("row_name is not null and column_name is not null").groupBy(*on).agg(F.min_by(F.nullif("cell", F.lit("")), "row_no").alias("cell"))
    return wanted.join(first, on, "left")


def unpivoted(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, row_name, variable, centre, spread): one row per filled cell, 'a ± b' split into its parts, other cells whole with a null spread."""
    parts = F.split("cell", r"\s*(?:±|\+/-)\s*", 2)
    return cells.where("cell <> ''").select(*keys, "row_name", F.col("column_name").alias("variable"), F.get(parts, F.lit(0)).alias("centre"), F.get(parts, F.lit(1)).alias("spread"))


def with_row_names(html: Column) -> Column:
    """A table whose rows without a header cell begin with <th>row k</th>, k counted over such rows from 1."""
    rows = F.split(html, "(?i)(?=<tr[ >])")
    plain = lambda r: r.rlike("(?is)^<tr[ >].*<td") & ~r.rlike("(?is)<th[ >]")
    number = lambda i: F.size(F.filter(F.slice(rows, 1, i + 1), plain)).cast("string")
    named = F.transform(rows, lambda r, i: F.when(plain(r), F.regexp_replace(r, F.lit("(?i)^(<tr[^>]*>)"), F.concat(F.lit("$1<th>row "), number(i), F.lit("</th>")))).otherwise(r))
    return F.array_join(named, "")


def spliced(pages: DataFrame, cleaned: DataFrame, keys: Sequence[str], page: str, text: str, reply: str) -> DataFrame:
    """pages with text replaced by a cleaned reply of the same page; a blank reply, and one for a page without a table, changes nothing."""
    new = cleaned.where(F.length(F.trim(F.col(reply))) > 0).groupBy(*keys, page).agg(F.min(reply).alias("__new"))
    has = F.col(text).rlike("(?i)<table[ >]")
    return pages.join(new, [*keys, page], "left").withColumn(text, F.when(has & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col(text))).drop("__new")


def candidate_pages(documents: DataFrame, doc: str, text: str, wanted: DataFrame) -> DataFrame:
    """(doc, pages): the ascending pages that hold the tables of wanted (doc, table_number); tables that no page holds are left out."""
    placed = documents.select(doc, F.explode(markup.page_index(F.col(text))).alias("p")).select(doc, F.col("p.page").alias("page"), F.explode("p.tables").alias("table_number"))
    return wanted.join(placed, [doc, "table_number"]).groupBy(doc).agg(F.array_sort(F.collect_set("page")).alias("pages"))


def numeric_cells(table_body: Column) -> Column:
    """The cells of a table that are numbers, in order."""
    return F.filter(F.transform(markup.cells(table_body), measures.parse_numeric), lambda x: x.isNotNull())
