"""Attribute-value rows into wide tables: one row per entity, one typed column per attribute.

The standing row of each (entity, attribute) is chosen by a partial aggregation before the shuffle, so an entity with a third of
all rows sends few of them. Rows then go to their entity's partition, sorted by entity and column index, and are streamed through
Arrow: typed buffers with validity masks are filled slot by slot and given out in batches, so a partition is never held as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.runtime import shuffle_width

_ARROW = {"double": pa.float64(), "bigint": pa.int64(), "string": pa.string()}


class _Builder:
    """A column of one batch: a typed buffer and its validity mask."""

    def __init__(self, kind: str, rows: int):
        self.kind = kind
        self.data = [None] * rows if kind == "string" else np.zeros(rows, "f8" if kind == "double" else "i8")
        self.valid = np.zeros(rows, bool)

    def put(self, slots, values):
        if self.kind == "string":
            for s, v in zip(slots, values):
                self.data[s] = v
        else:
            self.data[slots] = values
        self.valid[slots] = True

    def take(self, rows: int) -> pa.Array:
        if self.kind == "string":
            return pa.array([v if ok else None for v, ok in zip(self.data[:rows], self.valid[:rows])], pa.string())
        return pa.array(self.data[:rows], _ARROW[self.kind], mask=~self.valid[:rows])


def _streamed(batches: Iterator[pa.RecordBatch], names: list[str], kinds: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Input sorted by (entity, slot): __entity, __slot, __num, __int, __text. A batch is closed only between two entities."""
    schema = pa.schema([("entity", pa.string()), *((n, _ARROW[k]) for n, k in zip(names, kinds))])

    def fresh():
        return [_Builder(k, rows) for k in kinds]

    def closed(entities, builders):
        return pa.RecordBatch.from_arrays([pa.array(entities, pa.string()), *(b.take(len(entities)) for b in builders)], schema=schema)

    entities: list[str] = []
    builders = fresh()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        slot = batch.column(1).to_numpy(zero_copy_only=False)
        columns = {"double": batch.column(2), "bigint": batch.column(3), "string": batch.column(4)}
        start = 0
        while start < len(ids):
            at = np.empty(len(ids) - start, np.int64)
            end = start
            while end < len(ids):
                if not entities or ids[end] != entities[-1]:
                    if len(entities) == rows:
                        break
                    entities.append(ids[end])
                at[end - start] = len(entities) - 1
                end += 1
            part = slot[start:end]
            for s in np.unique(part):
                picked = np.flatnonzero(part == s)
                kind = kinds[s]
                values = columns[kind].take(pa.array(picked + start))
                builders[s].put(at[picked], values.to_pylist() if kind == "string" else values.to_numpy(zero_copy_only=False))
            if end < len(ids):
                yield closed(entities, builders)
                entities, builders = [], fresh()
            start = end
    if entities:
        yield closed(entities, builders)


def widen(
    rows: DataFrame, entity: str, attribute: str, columns: Sequence[tuple[str, str, str]], order: Sequence[Column], batch_rows: int = 4096
) -> DataFrame:
    """One row per entity that has a filled cell; columns: (attribute value, source column, type) with type double, bigint or string.

    The result has entity and, for each of columns, '<source>__<attribute>'. Of several rows of one (entity, attribute) the greatest by
    order stands, the same row for all its columns; repeated rows count once. Rows with a null entity or an attribute not in columns are
    no cells; a null source value leaves the cell null. An empty table gives no rows. Further columns of rows, whatever their
    names, play no part.
    """
    sources = list(dict.fromkeys((s, k) for _, s, k in columns))
    wanted = sorted({a for a, _, _ in columns})
    packed = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), *(F.col(s).cast(k).alias(f"v{i}") for i, (s, k) in enumerate(sources)))
    standing = (
        rows.where(F.col(entity).isNotNull() & F.col(attribute).isin(wanted))
        .select(F.col(entity).cast("string").alias("__entity"), F.col(attribute).alias("__attribute"), packed.alias("__packed"))
        .groupBy("__entity", "__attribute")
        .agg(F.max("__packed").alias("__packed"))
    )
    slots = {(a, s, k): i for i, (a, s, k) in enumerate(columns)}

    def cell(i: int, s: str, k: str) -> Column:
        at = F.create_map(*(x for a in wanted for x in (F.lit(a), F.lit(slots.get((a, s, k), -1)))))
        v = F.col(f"__packed.v{i}")
        return F.struct(
            F.element_at(at, F.col("__attribute")).alias("slot"), *((v if k == kind else F.lit(None).cast(kind)).alias(n) for n, kind in (("num", "double"), ("int", "bigint"), ("text", "string"))), v.isNotNull().alias("has")
        )

    cells = standing.select("__entity", F.explode(F.array(*(cell(i, s, k) for i, (s, k) in enumerate(sources)))).alias("c")).where("c.slot >= 0")
    # sources are rows of one (entity, attribute), so the exchange moves no more than one row per filled slot
    ready = (
        cells.where("c.has").select("__entity", F.col("c.slot").alias("__slot"), F.col("c.num").alias("__num"), F.col("c.int").alias("__int"), F.col("c.text").alias("__text"))
        .repartition(shuffle_width(rows), "__entity")
        .sortWithinPartitions("__entity", "__slot")
    )
    names = [f"{s}__{a}" for a, s, _ in columns]
    kinds = [k for _, _, k in columns]
    schema = T.StructType([T.StructField(entity, T.StringType()), *(T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, kinds))])

    def stream(batches):
        for b in _streamed(batches, names, kinds, batch_rows):
            yield b.rename_columns([entity, *names])

    return ready.mapInArrow(stream, schema)


def filled_cells(wide: DataFrame, entity: str, columns: Sequence[tuple[str, str]], value: str) -> DataFrame:
    """(entity, attribute, value) of the filled cells of a wide table; columns: (attribute, wide column)."""
    pairs = F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(c).alias(value)) for a, c in columns))
    return wide.select(entity, F.explode(pairs).alias("c")).where(F.col(f"c.{value}").isNotNull()).select(entity, "c.attribute", f"c.{value}")
