"""Matching extracted rows to the ground truth: strict keys, a numeric band, fuzzy weights, one-to-one assignment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.fuzzy import similarity
from tarnflow.runtime import cut


def normal(c: Column) -> Column:
    return F.lower(F.trim(c))


def strict_match(left: DataFrame, right: DataFrame, keys: Sequence[str], band: tuple[str, float] | None = None, ids: tuple[str, str] = ("gt_idx", "ex_idx")) -> DataFrame:
    """Pairs of ids whose keys are equal without case and outer white space, null equal to null, and whose band column differs by at most band.

    The band is an equi-join too: values fall into buckets 16 bands wide, and a left row goes to those its band touches, seldom more than one,
    so a group with many values is not compared in full.
    """
    l, r = left.select(ids[0], *(normal(F.col(k)).alias(f"__l{i}") for i, k in enumerate(keys)), *([F.col(band[0]).alias("__lv")] if band else [])), right.select(ids[1], *(normal(F.col(k)).alias(f"__r{i}") for i, k in enumerate(keys)), *([F.col(band[0]).alias("__rv")] if band else []))
    on = [F.col(f"__l{i}").eqNullSafe(F.col(f"__r{i}")) for i in range(len(keys))]
    if not band:
        return l.join(r, on).select(*ids)
    width = band[1]
    bucket = lambda c: F.floor(c / (16 * width)).cast("bigint")
    # a little more than the band, for the rounding of the ends; the exact check follows
    near = F.when(F.col("__lv").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.array_distinct(F.array(bucket(F.col("__lv") - 1.001 * width), bucket(F.col("__lv") + 1.001 * width))))
    l = l.withColumn("__lb", F.explode(near))
    r = r.withColumn("__rb", bucket(F.col("__rv")))
    exact = (F.col("__lv").isNull() & F.col("__rv").isNull()) | (F.abs(F.col("__lv") - F.col("__rv")) <= width)
    return l.join(r, [*on, F.col("__lb").eqNullSafe(F.col("__rb"))]).where(exact).select(*ids)


def band_hits(sides: DataFrame, keys: Sequence[str], value: str, band: float, name: str = "hit") -> DataFrame:
    """sides, whose column right tells which of two sides a row belongs to, with name: whether a row of the other side has equal keys and a
    value that differs by at most band. Null values and nan hit nothing.

    Of each group the nearest value of the other side is looked up below and above, in order of the values: neither pairs nor ids are made, and
    a group with many values costs its sorting. What sides is already partitioned by, if among the keys, is enough.
    """
    seen = lambda right, value: F.when(F.col("right") == right, F.col(value))
    up = Window.partitionBy(*keys).orderBy(F.col(value).asc())
    down = Window.partitionBy(*keys).orderBy(F.col(value).desc())
    out = sides.withColumns({"__b0": F.max(seen(True, value)).over(up), "__b1": F.max(seen(False, value)).over(up)})
    out = out.withColumn("__b", F.when(F.col("right"), F.col("__b1")).otherwise(F.col("__b0"))).drop("__b0", "__b1")
    out = out.withColumns({"__a0": F.min(seen(True, value)).over(down), "__a1": F.min(seen(False, value)).over(down)})
    out = out.withColumn("__a", F.when(F.col("right"), F.col("__a1")).otherwise(F.col("__a0"))).drop("__a0", "__a1")
    close = lambda c: F.coalesce(F.abs(F.col(value) - F.col(c)) <= band, F.lit(False))
    return out.withColumn(name, close("__b") | close("__a")).drop("__b", "__a")


def relative_match(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, number: str, rtol: float = 1e-4) -> DataFrame:
    """left joined to the rows of right with equal keys whose number is within rtol of value; a value of 0 needs a number under 1e-12.

    An equi-join on buckets of the logarithm, 16 tolerances wide, to which the exact check is added: a value falls into the one or two its
    tolerance touches. Numbers under 1e-12 are also in a bucket of their own, for 0. Null, infinite and nan find nothing.
    """
    bucket = lambda c: F.floor(F.log(F.abs(c)) / (16 * rtol)).cast("bigint")
    zero = F.struct(F.lit(0).alias("sign"), F.lit(0).cast("bigint").alias("b"))
    at = lambda c, x: F.struct(F.signum(c).cast("int").alias("sign"), bucket(x).alias("b"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    v, n = F.col(value), F.col(number)
    # a little more than the tolerance, for the rounding of the ends; the exact check follows
    l = left.where(finite(v)).withColumn("__at", F.explode(F.when(v == 0, F.array(zero)).otherwise(F.array_distinct(F.array(at(v, v * (1 - 1.001 * rtol)), at(v, v * (1 + 1.001 * rtol)))))))
    r = right.where(finite(n)).withColumn("__at", F.explode(F.when(n == 0, F.array(zero)).when(F.abs(n) < 1e-12, F.array(zero, at(n, n))).otherwise(F.array(at(n, n)))))
    exact = F.when(v == 0, F.abs(n) < 1e-12).otherwise(F.abs(n - v) / F.abs(v) <= rtol)
    return l.join(r, [*keys, "__at"]).where(exact).drop("__at")


def fuzzy_weight(pairs: DataFrame, fields: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """pairs with weight, the mean similarity (0 to 1) over the fields that both sides have; without such a field, or under threshold, no edge."""
    scores = [similarity(normal(F.col(a)), normal(F.col(b))) / 100 for a, b in fields]
    named = pairs.select("*", *(s.alias(f"__w{i}") for i, s in enumerate(scores)))
    present = [F.col(f"__w{i}").isNotNull().cast("int") for i in range(len(fields))]
    total = reduce(lambda x, y: x + y, [F.coalesce(F.col(f"__w{i}"), F.lit(0.0)) for i in range(len(fields))])
    weight = F.try_divide(total, reduce(lambda x, y: x + y, present))
    return named.withColumn("weight", weight).where(F.col("weight") >= threshold).drop(*(f"__w{i}" for i in range(len(fields))))


def assignment(weights: list[list[float]]) -> list[int]:
    """Hungarian method for maximum total weight; weights[i][j] > 0 is an edge. The column of each row, -1 where none."""
    n = max(len(weights), len(weights[0]) if weights else 0)
    cost = [[-(weights[i][j] if i < len(weights) and j < len(weights[i]) else 0.0) for j in range(n)] for i in range(n)]
    inf = float("inf")
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, way, used = [inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while match[at]:
            used[at] = True
            row, delta, nxt = match[at], inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    now = cost[row - 1][j - 1] - u[row] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, at
                    if least[j] < delta:
                        delta, nxt = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            at = nxt
        while at:
            match[at] = match[way[at]]
            at = way[at]
    out = [-1] * len(weights)
    for j in range(1, n + 1):
        i = match[j] - 1
        if i < len(weights) and j - 1 < len(weights[i]) and weights[i][j - 1] > 0:
            out[i] = j - 1
    return out


def best_matching(edges: DataFrame, group: Sequence[str], rounds: int = 100) -> DataFrame:
    """(group, gt_idx, ex_idx, weight): the one-to-one edges of greatest total weight within each group.

    A group falls into components that share no end, and only a component meets in a task, where it is solved exactly. Components are found by
    passing the least end along the edges until nothing changes. Of repeated edges the heaviest counts; null ends and weights that aren't over 0 are no edges.
    """
    keys = list(group)
    usable = edges.where(F.col("gt_idx").isNotNull() & F.col("ex_idx").isNotNull() & (F.col("weight") > 0)).groupBy(*keys, "gt_idx", "ex_idx").agg(F.max("weight").alias("weight"))
    rows = cut(usable.withColumn("__c", F.xxhash64(*keys, "gt_idx")))
    last = None
    for _ in range(rounds):
        rows = rows.withColumn("__c", F.min("__c").over(Window.partitionBy(*keys, "ex_idx")))
        rows = cut(rows.withColumn("__c", F.min("__c").over(Window.partitionBy(*keys, "gt_idx"))))
        state = rows.agg(F.sum(F.col("__c").cast("decimal(38,0)"))).first()[0]
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components not found after {rounds} rounds")
    kind = {c: edges.schema[c].dataType.simpleString() for c in ("gt_idx", "ex_idx")}
    schema = ", ".join(f"`{g}` {edges.schema[g].dataType.simpleString()}" for g in keys) + f", gt_idx {kind['gt_idx']}, ex_idx {kind['ex_idx']}, weight double"
    # most components are a single edge, which needs no solving
    sizes = rows.groupBy(*keys, "__c").agg(F.count(F.lit(1)).alias("__n"))
    sized = rows.join(sizes, [*keys, "__c"])
    alone = sized.where("__n = 1").select(*keys, "gt_idx", "ex_idx", F.col("weight").cast("double").alias("weight"))
    packed = sized.where("__n > 1").groupBy(*keys, "__c").agg(F.sort_array(F.collect_list(F.struct("gt_idx", "ex_idx", "weight"))).alias("__edges"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for *ids, found in zip(*(f[g] for g in keys), f["__edges"]):
                triples = [(e["gt_idx"], e["ex_idx"], e["weight"]) for e in found]
                left, right = list(dict.fromkeys(a for a, _, _ in triples)), sorted({b for _, b, _ in triples})
                at_l, at_r = {x: i for i, x in enumerate(left)}, {x: i for i, x in enumerate(right)}
                w = [[0.0] * len(right) for _ in left]
                for a, b, x in triples:
                    w[at_l[a]][at_r[b]] = x
                out += [(*ids, left[i], right[j], w[i][j]) for i, j in enumerate(assignment(w)) if j >= 0]
            yield pd.DataFrame(out, columns=[*keys, "gt_idx", "ex_idx", "weight"])

    return alone.unionByName(packed.mapInPandas(solve, schema))
