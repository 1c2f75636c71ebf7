"""Quantities recorded in different units: conversions as a graph of affine functions.

Each unit of an attribute is a node, each known conversion an edge x -> factor * x + shift, usable both ways. The shortest
composition from every unit to the attribute's common unit is worked out once from the catalogue, a dimension whose size is
checked, and cycles are checked for consistency. Rows are then converted by one equi-join on (attribute, unit).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.spellings import Lexicon, read
from tarnflow.runtime import bounded_rows, shuffled

# Conversions between units of one dimension besides those of the catalogue: (attributes, from, to, factor, shift).
EXTRA_EDGES = [
    (("surface_area",), "ha", "km^2", 0.01, 0.0),
    (("surface_area",), "x10^-2 km^2", "km^2", 0.01, 0.0),
    (("max_depth", "secchi_depth"), "km", "m", 1000.0, 0.0),
    (("max_depth", "secchi_depth"), "ft", "cm", 30.48, 0.0),
    (("tn", "tp", "chla"), "mg/L", "µg/L", 1000.0, 0.0),
    (("tn", "tp"), "ppm", "mg/L", 1.0, 0.0),
    (("tn", "tp"), "ppb", "µg/L", 1.0, 0.0),
    (("water_temp",), "K", "deg C", 1.0, -273.15),
    (("conductivity",), "mS/cm", "mS/m", 100.0, 0.0),
]


@dataclass(frozen=True)
class Affine:
    factor: float
    shift: float

    def then(self, after: Affine) -> Affine:
        return Affine(after.factor * self.factor, after.factor * self.shift + after.shift)

    def inverse(self) -> Affine:
        return Affine(1 / self.factor, -self.shift / self.factor)

    def close_to(self, other: Affine, tolerance: float) -> bool:
        return abs(self.factor - other.factor) <= tolerance * abs(other.factor) and abs(self.shift - other.shift) <= tolerance * max(1.0, abs(other.shift))


class InconsistentUnits(ValueError):
    """Two ways round a cycle of conversions give different results."""


def compositions(edges: Iterable[tuple[str, str, str, Affine]], targets: dict[str, str], tolerance: float = 1e-4) -> list[tuple[str, str, float, float, int]]:
    """(attribute, unit, factor, shift, hops) of the shortest way from each reachable unit to its attribute's target.

    Every edge outside the shortest-path tree closes a cycle; its two ways must agree within tolerance, else InconsistentUnits.
    Zero factors can't be undone and are an error too.
    """
    graph: dict[tuple[str, str], list[tuple[str, Affine]]] = {}
    known = []
    for attribute, a, b, f in edges:
        if a is None or b is None:
            continue
        if f.factor == 0:
            raise InconsistentUnits(f"{attribute}: {a} -> {b} has factor 0")
        known.append((attribute, a, b, f))
        graph.setdefault((attribute, b), []).append((a, f))
        graph.setdefault((attribute, a), []).append((b, f.inverse()))
    out = []
    for attribute, target in sorted((a, t) for a, t in targets.items() if t is not None):
        found = {target: (Affine(1.0, 0.0), 0)}
        queue = deque([target])
        while queue:
            at = queue.popleft()
            for unit, f in graph.get((attribute, at), []):
                if unit not in found:
                    found[unit] = (f.then(found[at][0]), found[at][1] + 1)
                    queue.append(unit)
        for name, a, b, f in known:
            if name == attribute and a in found and not f.then(found[b][0]).close_to(found[a][0], tolerance):
                raise InconsistentUnits(f"{attribute}: {a} -> {b} -> {target} differs from {a} -> {target}")
        out += [(attribute, unit, f.factor, f.shift, hops) for unit, (f, hops) in sorted(found.items())]
    return out


def conversion_table(catalogue: DataFrame, max_rows: int = 100_000, extra=EXTRA_EDGES) -> DataFrame:
    """(attribute, unit, common_unit, factor, shift, hops); null units, as of pH, take no part. At most max_rows catalogue rows."""
    rows = bounded_rows(catalogue.select("attribute", "unit", "factor", "shift", "is_common").dropna(subset=["attribute"]), max_rows, "the unit catalogue")
    targets = {r.attribute: r.unit for r in rows if r.is_common}
    units = {(r.attribute, r.unit) for r in rows}
    edges = [(r.attribute, r.unit, targets[r.attribute], Affine(r.factor, r.shift)) for r in rows if not r.is_common and r.attribute in targets and None not in (r.factor, r.shift)]
    edges += [(a, x, y, Affine(f, s)) for names, x, y, f, s in extra for a in names if (a, x) in units and (a, y) in units]
    made = [(a, u, targets[a], f, s, h) for a, u, f, s, h in compositions(edges, targets)]
    return catalogue.sparkSession.createDataFrame(made, "attribute string, unit string, common_unit string, factor double, shift double, hops int")


def lexicon_of(catalogue: DataFrame, max_rows: int = 100_000) -> Lexicon:
    """The catalogue's attributes and units with their readings; at most max_rows rows."""
    has = "description" in catalogue.columns
    rows = bounded_rows(catalogue.select("attribute", *(["description"] if has else []), "unit", "is_common"), max_rows, "the unit catalogue")
    return Lexicon.of((r.attribute, r.description if has else None, r.unit, r.is_common) for r in rows)


def paper_units(papers: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(document_id, attribute, unit): units a paper states for all its values; unreadable JSON gives none, ties keep the least."""
    units = papers.select("document_id", F.explode(F.from_json("units", "map<string,string>")).alias("name", "said"))
    none = F.lit(None).cast("string")
    named = units.select("document_id", read(lexicon, F.col("name"), none, F.col("said"), none).alias("r")).select("document_id", F.col("r.attribute_std").alias("attribute"), F.col("r.row_unit").alias("unit"))
    return named.dropna().groupBy("document_id", "attribute").agg(F.min("unit").alias("unit"))


def latest_deliveries(items: DataFrame, columns: Iterable[str], key: str = "item_id", order: str = "loaded_at") -> DataFrame:
    """(key, columns): one row per key, the one delivered last; of rows delivered at one time the greatest by columns.

    Rows with a null key are left out: nothing tells which item they are. A key that is repeated without end costs one row per task.
    """
    packed = F.max(F.struct(F.col(order), *columns)).alias("__p")
    return items.where(F.col(key).isNotNull()).groupBy(key).agg(packed).select(key, *(f"__p.{c}" for c in columns))


MADE = ["attribute_std", "about", "num", "missing", "bound", "unit_stated", "unit_source", "common_unit", "value_common"]


def to_common_units(items: DataFrame, papers: DataFrame, catalogue: DataFrame, keep: Iterable[str] = ("item_id", "document_id")) -> DataFrame:
    """Every item with value_common in its attribute's common unit, and where the unit was found.

    Adds attribute_std, about, num, missing, bound, unit_stated, unit_source ('units', 'value', 'attribute', 'remark', 'paper', 'none', or
    'unknown'), common_unit, value_common. What the row states goes before its paper. A row that states a unit which the catalogue lacks for
    its attribute is 'unknown' and has a null value_common, whatever its paper states; so have items outside the catalogue or
    without a value. Items with no unit stated anywhere ('none') are taken to be in the common unit. Rows are never dropped or doubled; an
    empty input gives an empty result; columns of these names in items are replaced.
    """
    keep = [c for c in dict.fromkeys([*keep, "document_id"]) if c not in MADE]
    lexicon = lexicon_of(catalogue)
    staged = items.select(*keep, read(lexicon, F.col("attribute"), F.col("value"), F.col("units"), F.col("additional_details")).alias("__r"))
    rows = staged.select(*keep, "__r.*")
    said = paper_units(papers, lexicon).select(F.col("document_id").alias("__pd"), F.col("attribute").alias("__pa"), F.col("unit").alias("__pu"))
    rows = rows.join(shuffled(said), (F.col("document_id") == F.col("__pd")) & (F.col("attribute_std") == F.col("__pa")), "left")
    rows = rows.withColumn("unit_source", F.coalesce("row_unit_source", F.when(F.col("__pu").isNotNull(), "paper"), F.lit("none")))
    rows = rows.withColumn("unit_stated", F.when(F.col("row_unit_source").isNull(), F.col("__pu")).otherwise(F.col("row_unit")))
    # one row per catalogue unit, its number checked in conversion_table
    way = F.broadcast(conversion_table(catalogue).select(F.col("attribute").alias("__ta"), F.col("unit").alias("__tu"), F.col("factor").alias("__factor"), F.col("shift").alias("__shift")))
    used = F.coalesce("unit_stated", F.when(F.col("unit_source") == "none", F.col("common_unit")))
    rows = rows.join(way, (F.col("attribute_std") == F.col("__ta")) & (used == F.col("__tu")), "left")
    unitless = F.coalesce(F.col("attribute_std").isin(sorted(lexicon.unitless)), F.lit(False)) if lexicon.unitless else F.lit(False)
    value = F.when(unitless, F.col("num")).otherwise(F.col("num") * F.col("__factor") + F.col("__shift"))
    return rows.select(*keep, *(value.alias(c) if c == "value_common" else c for c in MADE))


def other_units(converted: DataFrame) -> DataFrame:
    """(item_id, unit): each item whose value was converted from a stated unit that isn't the common one, once."""
    other = F.col("value_common").isNotNull() & F.col("common_unit").isNotNull() & (F.col("unit_stated") != F.col("common_unit"))
    return converted.where(other).select("item_id", F.col("unit_stated").alias("unit")).distinct()
