"""Filling fixed-capacity containers: best-fit decreasing over distributed stages.

Items are cut where they alone exceed the capacity. Whole bins of the pieces that fill one are set aside; the rest is packed, size classes
descending, by best fit: a segment tree over remaining capacities finds the tightest open bin that still holds an item, in logarithmic
time. Tasks pack shares of the items that a hash deals out evenly, so that no source or size class meets in one task; the bins a task
leaves under-filled give their items to the next round, over far fewer items. A task holds one share at a time.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.runtime import cut


class OpenBins:
    """Open bins by remaining capacity; a segment tree over the capacities finds the least that suffices."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = defaultdict(list)

    def add(self, left: int, number: int) -> None:
        self.bins[left].append(number)
        i = left + self.size
        while i:
            self.count[i] += 1
            i //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """(remaining capacity, bin) of the tightest bin with at least need left, taken out; None if there is none."""
        i = need + self.size
        if i >= 2 * self.size:
            return None
        if not self.count[i]:
            while True:
                if i == 1:
                    return None
                if not i & 1 and self.count[i + 1]:
                    i += 1
                    break
                i //= 2
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        left = i - self.size
        number = self.bins[left].pop()
        while i:
            self.count[i] -= 1
            i //= 2
        return left, number


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin of each item, remaining capacity of each bin); items of size 0 go to the fullest open bin."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins, where, left = OpenBins(capacity), [0] * len(sizes), []
    for i in order:
        if sizes[i] > capacity:
            raise ValueError(f"an item of {sizes[i]} exceeds the capacity {capacity}")
        got = bins.take(sizes[i])
        if got is None:
            where[i] = len(left)
            left.append(capacity - sizes[i])
        else:
            where[i] = got[1]
            left[got[1]] = got[0] - sizes[i]
        bins.add(left[where[i]], where[i])
    return where, left


PACKED = "id {kind}, piece int, size bigint, bin string, kept boolean"


def _pack_shares(pieces: DataFrame, kind: str, capacity: int, shares: int, tag: str, full: float | None) -> DataFrame:
    """Best-fit decreasing within each of shares; bins filled under full are not kept. A task holds one share at a time."""

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        share = int(g["share"].iloc[0])
        g = g.sort_values(["size", "order", "piece"], ascending=[False, True, True])
        where, left = best_fit_decreasing(g["size"].tolist(), capacity)
        kept = [full is None or capacity - left[b] >= full * capacity for b in where]
        return pd.DataFrame({"id": g["id"].array, "piece": g["piece"].array, "size": g["size"].array, "bin": [f"{tag}-{share}-{b}" for b in where], "kept": kept})

    # the share is a hash of the piece, so shares are even and a retried task packs the same items in the same order
    placed = pieces.withColumn("order", F.xxhash64("id", "piece")).withColumn("share", F.pmod("order", F.lit(shares)))
    return placed.groupBy("share").applyInPandas(pack, PACKED.format(kind=kind))


def pack(items: DataFrame, item_id: str, size: str, capacity: int, share_rows: int = 20_000, full: float = 0.99) -> DataFrame:
    """(item_id, piece, size, bin): every item in a bin of at most capacity; only items over the capacity are split.

    An item over the capacity gives pieces of the whole capacity and a rest. Null ids are left out; null and negative sizes count as 0, and an item of
    size 0 takes a place in a bin without using it. Repeated ids are items of their own. An empty table gives no bins. share_rows is the number
    of pieces a task packs at a time, at every size of the table; the bins a share leaves under-filled are opened again and packed in
    the next round, with as many shares as their pieces need, until one share holds them or a round frees little.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    kind = items.schema[item_id].dataType.simpleString()
    sized = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("id"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    pieces = sized.select("id", F.explode(F.sequence(F.lit(1), count)).alias("piece"), "n")
    pieces = pieces.select("id", "piece", F.least(F.lit(capacity), F.col("n") - (F.col("piece") - 1) * capacity).cast("bigint").alias("size"))
    pieces = cut(pieces)
    whole = pieces.where(F.col("size") == capacity).select("id", "piece", "size", F.concat(F.lit("w-"), F.monotonically_increasing_id().cast("string")).alias("bin"))
    rest = pieces.where(F.col("size") < capacity)
    total = rest.count()
    done, tag = [whole], 0
    while True:
        shares = max(1, -(-total // share_rows))
        last = shares == 1
        packed = cut(_pack_shares(rest, kind, capacity, shares, str(tag), None if last else full))
        done.append(packed.where("kept").select("id", "piece", "size", "bin"))
        if last:
            break
        rest = packed.where("not kept").select("id", "piece", "size")
        left = rest.count()
        # a round that frees little is the last: its leftovers are packed share by share for good
        if left > 0.7 * total:
            shares = max(1, -(-left // share_rows))
            done.append(_pack_shares(rest, kind, capacity, shares, f"{tag}r", None).select("id", "piece", "size", "bin"))
            break
        total, tag = left, tag + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("id").alias(item_id), "piece", "size", "bin")


def token_sizes(documents: DataFrame, doc_id: str, text: str, tokenizer: str) -> DataFrame:
    """(doc_id, tokens): the tokens of each whole text under a public tokenizer's file (JSON of the tokenizers library); null texts have 0."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for f in frames:
            texts = [x if isinstance(x, str) else "" for x in f["__text"]]
            sizes = []
            for i in range(0, len(texts), 64):  # few texts at a time: their encodings are large
                sizes += [len(e.ids) for e in t.encode_batch(texts[i : i + 64], add_special_tokens=False)]
            yield pd.DataFrame({doc_id: f["__doc"].array, "tokens": sizes})

    return documents.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text")).mapInPandas(count, f"{doc_id} {kind}, tokens bigint")
