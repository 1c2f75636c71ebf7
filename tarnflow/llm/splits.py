"""Train, validation and test splits that keep related records together.

Records are linked to the entities they share as star edges to a hub, never pair by pair. Components of these links are hashed, and
the hash is cut into ranges in the given proportions. The cuts are set within strata of like components (size and share of positive
labels), on a fixed number of hash buckets, so that proportions and label balance also hold for skewed component sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.values import squeezed
from tarnflow.llm.components import components

# What stands for an unknown author, without punctuation and in lower case.
NO_AUTHOR = ["", "anon", "anonymous", "no author", "noauthor", "author unknown", "unknown", "unknown author", "not stated", "not given", "na", "n a", "none", "null", "various", "various authors", "et al", "others"]
SURNAME_FIRST = r"^(.*\p{L}{3}.*?)\s+((?:\p{Lu}\.?[\s-]?){1,4})$"


def authors(c: Column) -> Column:
    """array of struct(surname, initial) of a free-text list of authors; initial is null where only a surname is given.

    Entries are parted by semicolon, &, 'and' or |. Each is 'Surname, Given', 'Surname G. H.', 'SURNAME GH', 'G. H. Surname' or
    'Given H. Surname'. Placeholders and 'et al.' are no authors.
    """
    text = F.regexp_replace(squeezed(F.coalesce(c, F.lit(""))), r"(?i),?\s*\b(?:et\s+al\b\.?|and others\b|and colleagues\b)", ";")
    entries = F.split(text, r"\s*(?:[;|&]|,?\s+(?i:and|und|et)\s+)\s*")

    def one(entry: Column) -> Column:
        comma = F.instr(entry, ",") > 0
        first = ~comma & entry.rlike(SURNAME_FIRST)
        family = F.when(comma, F.regexp_extract(entry, r"^([^,]*)", 1)).when(first, F.regexp_extract(entry, SURNAME_FIRST, 1)).otherwise(F.regexp_extract(entry, r"(\S+)\s*$", 1))
        given = F.when(comma, F.regexp_extract(entry, r",(.*)$", 1)).when(first, F.regexp_extract(entry, SURNAME_FIRST, 2)).otherwise(F.regexp_extract(entry, r"^(.*?)\S+\s*$", 1))
        key = F.regexp_replace(F.lower(F.regexp_extract(family, r"(\S+)\s*$", 1)), r"[^\p{L}\p{M}]", "")
        whole = F.trim(F.regexp_replace(F.lower(entry), r"[^\p{L}\p{M}]+", " "))
        return F.struct(
            F.when(~whole.isin(NO_AUTHOR), F.nullif(key, F.lit(""))).alias("surname"),
            F.nullif(F.lower(F.regexp_extract(given, r"(\p{L})", 1)), F.lit("")).alias("initial"),
        )

    return F.array_distinct(F.filter(F.transform(entries, one), lambda a: a["surname"].isNotNull()))


def paper_number(c: Column) -> Column:
    """The number in a written document_id ('w 00000001', 'W_1', '(W00000001)', 'W00000001.pdf'), null where there is none."""
    return F.regexp_extract(c, r"(?i)w[^0-9a-z]*0*([0-9]+)", 1).try_cast("bigint")


def author_links(papers: DataFrame, key: str = "document_id") -> DataFrame:
    """(u, v): star edges from papers to hubs; two papers share a hub if and only if a shared author joins them, through other papers or not.

    The hub is surname and first initial. A paper that gives a surname alone agrees with every initial, and so joins all papers
    of that surname: there the hub is the surname.
    """
    said = papers.select(F.col(key).alias("u"), F.explode(authors(F.col("author"))).alias("a")).select("u", "a.surname", "a.initial").where("u is not null")
    alone = said.where("initial is null").select("surname").distinct().withColumn("__alone", F.lit(True))
    hub = F.concat(F.lit("~"), F.col("surname"), F.lit(" "), F.when(F.col("__alone"), F.lit("")).otherwise(F.col("initial")))
    return said.join(alone, "surname", "left").select("u", hub.alias("v")).distinct()


def probe_groups(probe: DataFrame, papers: DataFrame) -> DataFrame:
    """(id, component) of the papers that occur in probe, ids as papers.document_id.

    Papers are linked by a shared author, or by an invalid row whose donor_gt_row_index is the gt_row_index of a valid row of the
    other. Ids that name no paper of papers stand for themselves in upper case. Nulls in any column link nothing.
    """
    known = papers.where("document_id is not null").groupBy(paper_number(F.col("document_id")).alias("number")).agg(F.min("document_id").alias("paper"), F.collect_set("author").alias("written")).where("number is not null")
    rows = probe.where("document_id is not null").select(paper_number(F.col("document_id")).alias("number"), F.upper(F.trim("document_id")).alias("raw"), "label", "gt_row_index", "donor_gt_row_index")
    rows = rows.join(known.select("number", "paper"), "number", "left").withColumn("id", F.coalesce("paper", "raw"))
    present = rows.select("id").distinct()
    written = known.join(present.select(F.col("id").alias("paper")), "paper", "left_semi").select(F.col("paper").alias("document_id"), F.explode("written").alias("author"))
    owners = rows.where("label = 'valid' and gt_row_index is not null").select(F.col("gt_row_index").alias("row"), F.col("id").alias("v")).distinct()
    takers = rows.where("label = 'invalid' and donor_gt_row_index is not null").select(F.col("donor_gt_row_index").alias("row"), F.col("id").alias("u")).distinct()
    donated = takers.join(owners, "row").select("u", "v")
    found = components(author_links(written).unionByName(donated), present)
    return found.join(present, "id", "left_semi")  # without the hubs


def linked_pairs(groups: DataFrame) -> DataFrame:
    """(a, b): every pair a < b of one component; as many rows as the result is defined to have."""
    return groups.select("component", F.col("id").alias("a")).join(groups.select("component", F.col("id").alias("b")), "component").where("a < b").select("a", "b")


def split_groups(
    sizes: DataFrame, proportions: Sequence[tuple[str, float]], buckets: int = 1024, seed: int = 0
) -> DataFrame:
    """(component, split) from sizes (component, n rows, positives); proportions sum to 1, in the order of the ranges.

    Within a stratum (components of like size and label share), the hashed identifier falls into one of a fixed number of buckets; the
    buckets' row counts, at most strata x buckets rows, set where one range ends and the next begins. A bucket takes the split in which
    the middle of its rows lies, so all records of a component share a split whatever its size.
    """
    if abs(sum(p for _, p in proportions) - 1) > 1e-9:
        raise ValueError("proportions must sum to 1")
    share = F.col("positives") / F.greatest(F.col("n"), F.lit(1))
    placed = sizes.withColumns({"__size": F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)))), "__share": F.round(share * 4), "__bucket": F.pmod(F.xxhash64(F.lit(seed), F.col("component").cast("string")), F.lit(buckets))})
    keys = ["__size", "__share"]
    mass = placed.groupBy(*keys, "__bucket").agg(F.sum("n").alias("__n"))
    ordered = Window.partitionBy(*keys).orderBy("__bucket")
    total = mass.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    at = (F.sum("__n").over(ordered) - F.col("__n") / 2) / F.col("__total")
    split, end = None, 0.0
    for name, p in proportions:
        end += p
        split = F.when(F.col("__at") < end, name) if split is None else split.when(F.col("__at") < end, name)
    cuts = mass.join(F.broadcast(total), keys).withColumn("__at", at).withColumn("split", split.otherwise(proportions[-1][0]))
    return placed.join(F.broadcast(cuts.select(*keys, "__bucket", "split")), [*keys, "__bucket"]).select("component", "split")
