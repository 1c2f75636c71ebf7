"""Evaluation texts leaking into training text: winnowing, a join of fingerprints, then extension of the hits.

Of the hashes of all k-grams of the normalised text (letters and digits only, compatibility forms folded, lower case, without markup),
each window of w consecutive ones gives its least, so every shared span of k + w - 1 characters yields a common fingerprint. Fingerprints
of both sides are joined. Hits are extended to maximal equal spans, and spans are chained over small differences: what the item
has between two spans may not be a name or a number. Before that, pairs are left out whose hits cannot add up to a run of the wanted
length however far each of them extends: a bound, so no run is lost by it.

Fingerprints of documents that no item has are dropped where they arise, by a bitmap of fixed size. As long as the items are within a
checked size, the join is a broadcast join inside the scan of the documents; beyond it, it is a shuffle join on the hash. Both
decide by the same function of one document and one item, so other items never matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.runtime import cut

MARKUP = re.compile(r"<table\b.*?</table\s*>|</?[a-zA-Z][^<>]*>", re.S)
NOT_TEXT = re.compile(r"[\W_]+")
WORD = re.compile(r"\w+(?:[.,’']\w+)*|[^\w\s]")
BITS = 1 << 25


@dataclass(frozen=True)
class Settings:
    k: int = 10
    w: int = 8
    share: float = 0.5  # of the item's characters, that its run must hold
    gap: int = 24  # normalised characters that may differ between two spans
    changed: float = 0.25  # of a run that may lie in such gaps
    drift: int = 48  # how far the spans of a run may be displaced against each other
    small_word: int = 4  # letters of a word that may begin a sentence with a capital and is no name
    broadcast_chars: int = 2_000_000  # normalised characters of all items up to which their index is broadcast


def normalised(text: str) -> str:
    return NOT_TEXT.sub("", unicodedata.normalize("NFKC", MARKUP.sub(" ", text)).casefold())


def _rolling(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each window of w values, in log w steps."""
    size, out = 1, x
    while size < w:
        step = min(size, w - size)
        out = best(out[:-step], out[step:])
        size += step
    return out


def fingerprints(text: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that winnowing keeps: every hash that is the least of a window of w. Texts of under k characters have none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x100000001B3) + codes[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    if n <= w:
        at = np.flatnonzero(h == h.min())
    else:
        least = _rolling(h, w, np.minimum)
        # a hash is kept if it is as small as the greatest of the minima of its windows
        edge = np.zeros(w - 1, np.uint64)
        at = np.flatnonzero(h == _rolling(np.concatenate([edge, least, edge]), w, np.maximum))
    return h[at], at


class Item:
    """An item's normalised text, where each of its characters stood, which of them belong to names and numbers, and its fingerprints."""

    def __init__(self, item_id, text: str, s: Settings):
        self.id, self.s = item_id, s
        clean = MARKUP.sub(" ", text)
        chars, where, hard, opens = [], [], [], True
        for m in WORD.finditer(clean):
            token = m.group()
            if not NOT_TEXT.sub("", token):
                opens = opens or token in ".!?。！？…:;“„«‹「『(¿¡\"‘"
                continue
            name = token[0].isupper() and not (opens and len(token) <= s.small_word)
            is_hard = name or any(c.isdigit() for c in token)
            opens = False
            for i, c in enumerate(token):
                for n in NOT_TEXT.sub("", unicodedata.normalize("NFKC", c).casefold()):
                    chars.append(n)
                    where.append(m.start() + i)
                    hard.append(is_hard)
        self.text, self.where, self.hard = "".join(chars), np.array(where or [0]), np.array(hard or [False])
        self.length = max(1, len(clean.strip()))
        self.hard_before = np.concatenate([[0], np.cumsum(self.hard)])
        self.hashes, self.at = fingerprints(self.text, s.k, s.w)
        # the least number of normalised characters of a run that covers the share
        far = np.searchsorted(self.where, self.where + s.share * self.length - 1, "left")
        long_enough = far < len(self.where)
        self.least = int((far - np.arange(len(self.where)) + 1)[long_enough].min()) if long_enough.any() and self.text else 1
        after = np.append(self.at[1:], len(self.text)) if len(self.at) else self.at
        self.step = after - self.at

    def leak(self, doc: str, number: np.ndarray, dpos: np.ndarray) -> tuple[int, float] | None:
        """(start in the item, share) of the longest run of the item in a normalised document, None if it is under the share."""
        run = self._run(doc, self.at[number], dpos)
        return run if run and run[1] >= self.s.share else None

    def _run(self, doc: str, ipos: np.ndarray, dpos: np.ndarray) -> tuple[int, float] | None:
        """Start and share of the longest run: maximal equal spans, chained over small gaps that hold no name or number."""
        spans, seen, text = [], {}, self.text
        for i, d in sorted(zip(ipos.tolist(), dpos.tolist())):
            if seen.get(d - i, -1) >= i:
                continue
            a, b = i, d
            while a and b and text[a - 1] == doc[b - 1]:
                a, b = a - 1, b - 1
            e, f = i, d
            while e < len(text) and f < len(doc) and text[e] == doc[f]:
                e, f = e + 1, f + 1
            seen[d - i] = e
            spans.append((a, e, b, f))
        spans.sort(key=lambda x: (x[2], x[0]))
        s = self.s
        reach = len(text) + s.gap  # a predecessor lies within an item's length in the document
        best: list[tuple[int, int]] = []  # of each span: the start of its chain and the characters in gaps
        top = None
        for n, (a, e, b, f) in enumerate(spans):
            chain = (a, 0)
            for m in range(n - 1, -1, -1):
                _, pe, pb, pf = spans[m]
                if pb < b - reach:
                    break
                overlap = max(0, pe - a, pf - b)
                if e - overlap <= pe or f - overlap <= pf or overlap > s.gap:
                    continue
                gi, gd = max(0, a + overlap - pe), max(0, b + overlap - pf)
                # characters that both spans claim may belong to either; they count as changed
                back = max(pe - overlap, 0) if overlap else pe
                if gi > s.gap or gd > s.gap or self.hard_before[a + overlap] - self.hard_before[min(back, a + overlap)]:
                    continue
                start, gaps = best[m]
                if (start, gaps + max(gi, gd)) < chain:
                    chain = (start, gaps + max(gi, gd))
            best.append(chain)
            start, gaps = self._behind_name(chain[0], e), chain[1]
            if start < e and gaps <= s.changed * (e - start):
                end = self._before_name(e)
                share = (self.where[end - 1] - self.where[start] + 1) / self.length if end > start else 0.0
                if top is None or share > top[1]:
                    top = (int(self.where[start]), float(share))
        return top

    def _behind_name(self, start: int, end: int) -> int:
        """A run that begins inside a name or number begins behind it."""
        while 0 < start < end and self.hard[start] and self.hard[start - 1] and self.where[start] - self.where[start - 1] <= 1:
            start += 1
        return start

    def _before_name(self, end: int) -> int:
        """A run that ends inside a name or number ends before it."""
        while 0 < end < len(self.text) and self.hard[end - 1] and self.hard[end] and self.where[end] - self.where[end - 1] <= 1:
            end -= 1
        return end


def possible(item: np.ndarray, number: np.ndarray, diagonal: np.ndarray, step: np.ndarray, least: np.ndarray, s: Settings) -> np.ndarray:
    """Which hits lie where a run may be long enough: of each hit the item, its fingerprint's number, diagonal and distance to the next
    fingerprint; of each item the least length of a run.

    An equal span whose fingerprints are i to j reaches from behind fingerprint i - 1 to before the end of fingerprint j + 1, so at most
    at[j + 1] - at[i] + w + k - 2 characters, and all spans of a run lie in two neighbouring bands of s.drift diagonals.
    """
    band = diagonal // s.drift
    low = int(band.min()) - 1
    across = int(band.max()) - low + 2
    key = item * across + (band - low)  # the window of this band and the next; a hit belongs to its own and to the one before
    both = np.concatenate([key, key - 1])
    many = int(number.max()) + 2
    merged, first = np.unique(both * many + np.concatenate([number, number]), return_index=True)
    window = merged // many
    opens = np.diff(window, prepend=-1) != 0
    spans = opens | (np.diff(merged, prepend=-2) != 1)
    starts = np.flatnonzero(opens)
    reach = np.add.reduceat(step[first % len(step)], starts) + np.add.reduceat(spans.astype(np.int64), starts) * (s.w + s.k - 2)
    window = window[starts]
    good = window[reach >= (1 - s.changed) * least[window // across]]
    return np.isin(key, good) | np.isin(key - 1, good)


class Index:
    """Fingerprints of items, for a join inside a task."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.s = items[0].s if items else Settings()
        hashes = np.concatenate([x.hashes for x in items] or [np.empty(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.item = np.repeat(np.arange(len(items)), [len(x.hashes) for x in items])[order]
        self.number = np.concatenate([np.arange(len(x.hashes)) for x in items] or [np.empty(0, np.int64)])[order]
        self.hashes = hashes[order]
        flat = lambda c: np.concatenate([getattr(x, c) for x in items] or [np.empty(0, np.int64)])[order]
        self.at, self.step, self.least = flat("at"), flat("step"), np.array([x.least for x in items], np.int64)

    def leaks(self, doc: str, h: np.ndarray, at: np.ndarray) -> list[tuple[object, int, float]]:
        """(item id, start in the item, share of the item) of the items that a normalised document with fingerprints h at at holds."""
        if not len(h) or not len(self.hashes):
            return []
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        many = high - low
        if not many.any():
            return []
        reps = np.repeat(np.arange(len(h)), many)
        posting = np.arange(len(reps)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        item, number, dpos = self.item[posting], self.number[posting], at[reps]
        mine = possible(item, number, dpos - self.at[posting], self.step[posting], self.least, self.s)
        item, number, dpos = item[mine], number[mine], dpos[mine]
        order = np.argsort(item, kind="stable")
        item, number, dpos = item[order], number[order], dpos[order]
        edges = np.flatnonzero(np.diff(item, prepend=-1)).tolist()
        found = []
        for a, b in zip(edges, [*edges[1:], len(item)]):
            x = self.items[item[a]]
            if run := x.leak(doc, number[a:b], dpos[a:b]):
                found.append((x.id, *run))
        return found


def bitmap(fingerprinted: DataFrame) -> np.ndarray:
    """A boolean array over BITS buckets of the hashes in column h; its size doesn't depend on the data."""
    bit = F.pmod("h", F.lit(BITS)) + 1
    rows = fingerprinted.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).collect()
    out = np.zeros(BITS, bool)
    for r in rows:  # at most BITS / 32768 rows of 4096 bytes
        bits = np.unpackbits(np.frombuffer(bytes(r.m), np.uint8), bitorder="little")
        at = (r.b - 1) * 32768
        out[at : at + 32768] = bits[: BITS - at]
    return out


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BITS - 1)).astype(np.int64)


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, item_start, share): each document that holds an item's text, or one run of at least settings.share of it.

    One row per document row and item; a document row that occurs twice gives its rows twice. Null or empty texts hold and leak nothing;
    repeated item ids count as one item per text; an item of under k letters and digits has no fingerprint and is never found. The
    whole of every text is read, and documents are read once whatever the number of items. Other columns, whatever their names,
    play no part. settings.broadcast_chars decides where the join takes place and never what it gives.
    """
    s = settings
    asked = items.where(F.col(item_id).isNotNull() & (F.length(F.trim(F.col(item_text))) > 0)).select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).distinct()
    asked = cut(asked.withColumn("key", F.concat(F.col("i").cast("string"), F.lit(" "), F.sha2("t", 256))))

    def prints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [(k, Item(None, t, s)) for k, t in zip(f["key"], f["t"])]
            parts = [pd.DataFrame({"key": k, "h": x.hashes.view(np.int64), "number": np.arange(len(x.hashes)), "at": x.at, "step": x.step, "least": x.least, "chars": len(x.text)}) for k, x in made]
            yield pd.concat(parts) if parts else pd.DataFrame(columns=["key", "h", "number", "at", "step", "least", "chars"])

    index = cut(asked.mapInPandas(prints, "key string, h bigint, number int, at int, step int, least int, chars int"))
    chars = index.select("key", "chars").distinct().agg(F.sum("chars")).first()[0] or 0
    kinds = f"{doc_id} {documents.schema[doc_id].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}, item_start int, share double"
    docs = documents.where(F.col(doc_id).isNotNull() & (F.length(F.col(text)) > 0)).select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text"))
    known = documents.sparkSession.sparkContext.broadcast(np.packbits(bitmap(index)))

    def of_document(t: str, bits: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
        doc = normalised(t)
        h, at = fingerprints(doc, s.k, s.w)
        maybe = bits[_bucket(h)]
        return doc, h[maybe], at[maybe]

    if chars <= s.broadcast_chars:
        # at most broadcast_chars characters, and at most one fingerprint for each
        texts = documents.sparkSession.sparkContext.broadcast([(r.i, r.t) for r in asked.select("i", "t").collect()])

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bits, local = np.unpackbits(known.value).astype(bool), Index([Item(i, t, s) for i, t in texts.value])
            for frame in frames:
                hits = [(d, *hit) for d, t in zip(frame["__doc"], frame["__text"]) for hit in local.leaks(*of_document(t, bits))]
                yield pd.DataFrame(hits, columns=[doc_id, item_id, "item_start", "share"])

        return docs.mapInPandas(scan, kinds)
    return _by_shuffle(docs, asked, index, known, of_document, s, kinds, doc_id, item_id)


def _by_shuffle(docs: DataFrame, asked: DataFrame, index: DataFrame, known, of_document, s: Settings, kinds: str, doc_id: str, item_id: str) -> DataFrame:
    """The join for items of any number: fingerprints meet by hash, pairs that the bound keeps get their texts back and are decided."""
    kind = docs.schema["__doc"].dataType.simpleString()
    docs = docs.withColumn("__sha", F.sha2("__text", 256))

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(known.value).astype(bool)
        for f in frames:
            for d, sha, t in zip(f["__doc"], f["__sha"], f["__text"]):
                _, h, at = of_document(t, bits)
                yield pd.DataFrame({"__doc": [d] * len(h), "__sha": sha, "h": h.view(np.int64), "dpos": at})

    placed = docs.mapInPandas(emit, f"__doc {kind}, __sha string, h bigint, dpos int")
    hits = placed.join(index, "h").groupBy("__doc", "__sha", "key", "least").agg(F.collect_set(F.struct("number", "at", "step", "dpos")).alias("hits"))

    def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for least, found in zip(f["least"], f["hits"]):
                number, at, step, dpos = (np.array([r[c] for r in found], np.int64) for c in ("number", "at", "step", "dpos"))
                keep.append(bool(possible(np.zeros(len(number), np.int64), number, dpos - at, step, np.array([least]), s).any()))
            yield f.loc[keep, ["__doc", "__sha", "key"]]

    pairs = hits.mapInPandas(bound, f"__doc {kind}, __sha string, key string")
    full = docs.join(pairs, ["__doc", "__sha"]).join(asked, "key")

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(known.value).astype(bool)
        for f in frames:
            rows = [(d, *hit) for d, text, i, t in zip(f["__doc"], f["__text"], f["i"], f["t"]) for hit in Index([Item(i, t, s)]).leaks(*of_document(text, bits))]
            yield pd.DataFrame(rows, columns=[doc_id, item_id, "item_start", "share"])

    return full.mapInPandas(decide, kinds)
