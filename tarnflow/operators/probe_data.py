"""Ground truth and synthetic probe records: valid records, and invalid ones made by swapping, by noise, and from table cells.

Every random choice is a keyed hash, so it depends on the row and the seed only, not on partitions or the order of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators import curate
from tarnflow.runtime import ranked


def chance(seed: int, *keys: Column) -> Column:
    """A number from 0 to under 1 by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30)


def sampled(rows: DataFrame, key: str, n: int, order: Sequence[str], seed: int = 342) -> DataFrame:
    """n rows, all if there are fewer, chosen by hash of key and sorted by order; the sample is the feature."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n).orderBy(*order)


def noisy_text(value: Column, like: Column) -> Column:
    """A number written with as many decimals as the text like has; without a point as an integer."""
    decimals = F.when(F.instr(like, ".") > 0, F.length(F.regexp_extract(like, r"\.([0-9]*)", 1))).otherwise(0)
    whole = F.round(value, 0).cast("bigint").cast("string")
    # a fixed set of widths, as a format needs a constant
    widths = [F.when(decimals == d, F.format_string(f"%.{d}f", value)) for d in range(1, 13)]
    return F.coalesce(F.when(decimals == 0, whole), *widths, F.format_string("%.12f", value))


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal number by hash."""
    u, v = F.greatest(chance(seed, *keys), F.lit(1e-9)), chance(seed + 1, *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def truth_records(rows: DataFrame, documents: DataFrame, doc: str, value: str, pages: str) -> DataFrame:
    """Ground-truth rows whose paper has a text, their value as text and their pages without nulls; an empty list becomes null."""
    known = rows.join(documents.select(doc).distinct(), doc, "left_semi").where(F.col(value).isNotNull())
    kept = F.filter(F.col(pages), lambda p: p.isNotNull())
    return known.withColumns({value: F.col(value).cast("string"), pages: F.when(F.size(kept) > 0, kept)})


def valid_sample(rows: DataFrame, doc: str, share: float = 0.5, seed: int = 342) -> DataFrame:
    """rows of whole papers, taken in hashed order until they hold at least share of all rows.

    Papers are ordered by ranges of their hash and their sizes summed up by range, so no task orders all of them.
    """
    sizes = rows.groupBy(doc).agg(F.count(F.lit(1)).alias("__n")).withColumn("__h", F.xxhash64(F.lit(seed), doc)).withColumn("__r", F.shiftright("__h", 54))
    ranges = sizes.groupBy("__r").agg(F.sum("__n").alias("__m"))
    before = ranges.select("__r", F.coalesce(F.sum("__m").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__m").over(Window.partitionBy()).alias("__all"))  # 1024 ranges
    within = Window.partitionBy("__r").orderBy("__h", doc).rowsBetween(Window.unboundedPreceding, -1)
    run = sizes.withColumn("__in", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(F.broadcast(before), "__r")
    chosen = run.where(F.col("__before") + F.col("__in") < share * F.col("__all")).select(doc)
    return rows.join(chosen, doc, "left_semi")


def swapped(valid: DataFrame, key: str, doc: str, pages: str, fields: Sequence[str], unit_options: Mapping[str, Sequence[str]] | None = None, attribute: str = "attribute", seed: int = 342) -> DataFrame:
    """One invalid record for each valid one that some field can be changed in: (columns of valid, modification_type, donor_<key>).

    Of fields, one whose value another row can give is chosen by hash; the donor is of the same page, else of the same paper, else any row
    of another value. 'units' takes another unit of the attribute by unit_options. Rows that nothing can be changed in give none.
    """
    base = valid.withColumn("__page", F.get(F.col(pages), F.lit(0)))
    out, kinds = base, []
    for f in fields:
        donors = curate.pick_donor(base.select(key, doc, "__page", F.col(f).alias("__v")), key, [("page", [doc, "__page"]), ("paper", [doc]), ("any", [])], "__v", F.xxhash64(F.lit(seed), F.lit(f), key))
        out = out.join(donors.select(F.col(key).alias("__k"), F.col(f"donor_{key}").alias(f"__d_{f}"), F.col("donor___v").alias(f"__v_{f}")), F.col(key) == F.col("__k"), "left").drop("__k")
        kinds.append((f, F.col(f"__v_{f}").isNotNull()))
    if unit_options:
        options = F.create_map(*(x for a, us in unit_options.items() for x in (F.lit(a), F.array(*map(F.lit, us)))))
        others = F.filter(F.try_element_at(options, F.col(attribute)), lambda u: F.lower(u) != F.lower(F.coalesce(F.col("units"), F.lit(""))))
        out = out.withColumn("__v_units", F.get(others, F.floor(chance(seed + 2, F.col(key)) * F.size(others)).cast("int"))).withColumn("__d_units", F.lit(None).cast(valid.schema[key].dataType))
        kinds.append(("units", F.col("__v_units").isNotNull()))
    possible = F.filter(F.array(*(F.when(ok, F.lit(f)) for f, ok in kinds)), lambda x: x.isNotNull())
    out = out.withColumn("__kind", F.get(possible, F.floor(chance(seed + 3, F.col(key)) * F.size(possible)).cast("int"))).where("__kind is not null")
    donor = F.coalesce(*(F.when(F.col("__kind") == f, F.col(f"__d_{f}")) for f, _ in kinds))
    made = {f: F.when(F.col("__kind") == f, F.col(f"__v_{f}").cast(valid.schema[f].dataType)).otherwise(F.col(f)) for f, _ in kinds}
    return out.select(*(made.get(c, F.col(c)).alias(c) for c in valid.columns), F.concat(F.lit("change_"), F.col("__kind")).alias("modification_type"), donor.alias(f"donor_{key}"))


def noised(valid: DataFrame, key: str, value: str, name: str, seed: int = 342, share: float = 0.3, least: float = 0.1, tries: int = 100) -> DataFrame:
    """Records whose number is moved by a normal error (deviation share of it, at least least) so far that its text changes; a value that
    is no number gives a record with a made-up name instead. The first of tries draws that changes the text counts; where none does the name is made up too."""
    v = F.col(value).try_cast("double")
    draw = lambda i: noisy_text(v + F.greatest(F.abs(v) * share, F.lit(least)) * normal(seed, F.col(key), i), F.col(value).cast("string"))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), draw)
    new = F.get(F.filter(drawn, lambda x: x != F.col(value).cast("string")), F.lit(0))
    invented = F.concat(F.lit("Site "), F.upper(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key)), 256), 1, 6)))
    return valid.withColumn("__new", F.when(v.isNotNull(), new)).withColumns({
        value: F.coalesce(F.col("__new"), F.col(value).cast("string")), name: F.when(F.col("__new").isNull(), invented).otherwise(F.col(name)),
        "modification_type": F.when(F.col("__new").isNull(), "noise_name").otherwise("noise_value"),
    }).drop("__new")


def from_tables(valid: DataFrame, numbers: DataFrame, doc: str, pages: str, value: str, seed: int = 342) -> DataFrame:
    """Records whose value is another number of their page's tables, else of their page's text, else of the paper's tables, else of its text.

    numbers: doc, page, source ('table' or 'text'), number (text). The number is chosen by hash among those that differ from the value;
    rows of papers without another number give none. Of each group of numbers its two least by hash that differ are enough, so a paper
    with many numbers costs no more than another.
    """
    base = valid.withColumn("__page", F.get(F.col(pages), F.lit(0)))
    order = F.struct(F.xxhash64(F.lit(seed), "number").alias("h"), F.col("number").alias("n"))
    named = numbers.where(F.col("number").isNotNull()).withColumnRenamed("page", "__page")
    out, tiers = base, []
    for i, (source, keys) in enumerate((("table", [doc, "__page"]), ("text", [doc, "__page"]), ("table", [doc]), ("text", [doc]))):
        of = named.where(F.col("source") == source).select(*keys, order.alias("o"))
        first = of.groupBy(*keys).agg(F.min("o").alias("f"))
        second = of.join(first, keys).where("o.n <> f.n").groupBy(*keys).agg(F.min("o").alias("s"))
        pool = first.join(second, keys, "left").select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("f.n").alias("f"), F.col("s.n").alias("s"))
        out = out.join(pool, [F.col(k) == F.col(f"__k_{k}") for k in keys], "left").drop(*(f"__k_{k}" for k in keys))
        out = out.withColumn(f"__t{i}", F.when(F.col("f") != F.col(value).cast("string"), F.col("f")).otherwise(F.col("s"))).drop("f", "s")
        tiers.append(F.col(f"__t{i}"))
    tier = F.coalesce(*(F.when(t.isNotNull(), F.lit(n)) for t, n in zip(tiers, ("page table", "page text", "paper table", "paper text"))))
    out = out.withColumn("__new", F.coalesce(*tiers)).withColumn("modification_type", tier).where("__new is not null")
    return out.select(*(F.col("__new").alias(c) if c == value else F.col(c) for c in valid.columns), "modification_type")


def probe_output(valid: DataFrame, swaps: DataFrame, noise: DataFrame, tables: DataFrame, key: str, seed: int = 342) -> DataFrame:
    """The probe table: every valid row, its swapped row, and for one half of the rows by hash a noised row, for the other one from tables, or
    a noised one where there is none; with label, modification_type, gt_row_index, donor_gt_row_index and measurement_id from 0."""
    half = chance(seed + 7, F.col(key)) < 0.5
    columns = [c for c in valid.columns if c != "gt_row_index"]
    of = lambda df, kind, donor=None: df.select(*columns, F.lit("invalid").alias("label"), (F.col("modification_type") if kind is None else F.lit(kind)).alias("modification_type"), F.col(key).alias("gt_row_index"), (F.col(donor) if donor else F.lit(None).cast(valid.schema[key].dataType)).alias("donor_gt_row_index"))
    table_part = tables.where(~half)
    noise_part = noise.where(half).unionByName(noise.where(~half).join(table_part.select(key), key, "left_anti"))
    every = of(valid, "none").withColumn("label", F.lit("valid")).unionByName(of(swaps, None, f"donor_{key}")).unionByName(of(noise_part, None)).unionByName(of(table_part, None))
    return ranked(every, [F.col("gt_row_index"), F.col("label").desc(), F.col("modification_type")], "measurement_id")


def ground_truth(raw: DataFrame, papers: DataFrame, catalogue: DataFrame, title: str = "title", excluded: Sequence[str] = ()) -> DataFrame:
    """Survey rows as ground truth: (document_id, columns of raw, units, value in the paper's unit) of the rows whose title is a paper's.

    Rows of other attributes than the catalogue's, without a value, or of excluded papers are left out. A paper states units by attribute;
    without a statement the common unit stands, and the value, which is in the common unit, is converted only if the paper's differs. Units that
    the catalogue lacks keep the value as it is.
    """
    known = papers.where(~F.col("document_id").isin(list(excluded)) if excluded else F.lit(True)).groupBy(F.lower(F.trim("title")).alias("__t")).agg(F.min(F.struct("document_id", "units")).alias("p"))
    rows = raw.where(F.col("value").isNotNull() & ~F.isnan("value")).join(known, F.lower(F.trim(F.col(title))) == F.col("__t")).drop("__t")
    common = catalogue.where("is_common").groupBy("attribute").agg(F.first("unit").alias("__common"))
    rows = rows.join(common, "attribute").withColumn("__said", F.try_element_at(F.from_json("p.units", "map<string,string>"), F.col("attribute")))
    rows = rows.withColumn("units", F.coalesce("__said", "__common"))
    way = catalogue.select("attribute", F.col("unit").alias("units"), F.col("factor").alias("__factor"), F.col("shift").alias("__shift"))
    rows = rows.join(way, ["attribute", "units"], "left")
    moved = F.when(F.col("units") != F.col("__common"), (F.col("value") - F.coalesce("__shift", F.lit(0.0))) / F.coalesce("__factor", F.lit(1.0))).otherwise(F.col("value"))
    return rows.select(F.col("p.document_id").alias("document_id"), *(moved.alias(c) if c == "value" else F.col(c) for c in raw.columns), "units")
