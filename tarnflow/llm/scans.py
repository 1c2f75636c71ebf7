"""Noise in text from scanned pages: running lines, page numbers, words broken across lines, misread characters.

Lines are compared through keys in which characters that scanners confuse fall together, and keys that differ by few letters are taken
for one. A running header or footer is a line that comes back at page edges, within its paper or throughout the corpus, or whose shape does:
the line without the words that few papers have. Page numbers are the numbers at page edges that run on with the pages of their paper.
Broken words are joined, and misread words put right, by the vocabulary of the whole corpus (a noisy channel over the usual confusions);
words that occur too rarely for that are judged by a character model of the corpus. All counts are aggregated over all scans.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.leaks import BITS, bitmap
from tarnflow.runtime import bounded_rows, cut

# What scanners write for what was printed.
CONFUSIONS = [
    ("c", "e"), ("0", "o"), ("1", "l"), ("cl", "d"), ("l", "i"), ("5", "s"), ("li", "h"), ("q", "g"), ("ii", "u"), ("rn", "m"), ("vv", "w"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("h", "li"), ("d", "cl"), ("m", "rn"), ("8", "B"), ("6", "b"),
]
PAGE_NO = re.compile(r"^\s*(?:[-–—\[(|]\s*)?(?:(?:page|pag|pg|p)\b\.?\s*)?([0-9lOI]{1,5}|[ivxlc]{1,7})(?:\s*[-–—\])|])?\s*$", re.I)
ROMAN = re.compile(r"^(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
TRIM = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def line_key(text: str) -> str:
    """Letters only, confusable characters falling together: e/c, i/l/1, o/0, s/5, g/q, and the pairs for h, u, d, m, w."""
    k = re.sub(r"[^\w]|_", "", re.sub(r"(?<![^\W\d_])[\dlO]*\d[\dlO]*(?![^\W\d_])", "", text)).lower()
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("0", "o"), ("5", "s"), ("q", "g"), ("c", "e"), ("i", "l"), ("1", "l"), ("el", "d"), ("rn", "m"), ("vv", "w"), ("u", "ll"), ("h", "ll")):
        k = k.replace(a, b)
    return re.sub(r"\d", "", k)


def _number(text: str) -> tuple[int | None, bool, bool]:
    """(the number of a page-number line, whether it is decorated, whether it is roman)"""
    m = PAGE_NO.match(text)
    if not m:
        return None, False, False
    got = m.group(1)
    if ROMAN.match(got.lower()) and not re.search(r"[0-9O]", got) and got.lower() != "l":
        values = [_ROMAN[c] for c in got.lower()]
        return sum(-v if v < n else v for v, n in zip(values, [*values[1:], 0])), got != text.strip(), True
    if not re.search(r"[0-9]", got) and got.strip("lO"):
        return None, False, False
    digits = got.translate(str.maketrans("lIOo", "1100"))
    return (int(digits), got != text.strip(), False) if digits.isdigit() else (None, False, False)


def page_offsets(text: str, page: int | None) -> list[int]:
    """Differences of the numbers that stand alone on a line at an edge of the page, or beside a blank line, to the page."""
    if page is None:
        return []
    lines = text.split("\n")
    solid = [i for i, x in enumerate(lines) if x.strip()]
    out = []
    for i in solid:
        if len(lines[i]) < 40 and (i in (solid[0], solid[-1]) or not lines[i - 1].strip() or i + 1 < len(lines) and not lines[i + 1].strip()):
            n, _, roman = _number(lines[i])
            if n is not None and not roman:
                out.append(n - page)
    return out


def page_lines(text: str, page: int | None, offset: int = 0) -> list[tuple[int, str, str, str, bool, bool]]:
    """(line_no, text, kind, key, edge, alone) of every line; kind is 'blank', 'page_no' or 'text'.

    offset is what the printed numbers of the paper are ahead of its pages; two pages on each side count, as a scan may hold a page break.
    edge: first or last of the page but for page numbers and blank lines, or next to such a line inside (a page break within the scan).
    alone: nothing but a blank line, a page number or the page's edge before it.
    """
    raw = text.split("\n")
    kinds = []
    for line in raw:
        if not line.strip():
            kinds.append("blank")
            continue
        n, decorated, roman = _number(line)
        near = n is not None and page is not None and -2 <= n - page - offset <= 2
        kinds.append("page_no" if n is not None and (near or roman or page is None and decorated) else "text")
    solid = [i for i, k in enumerate(kinds) if k != "blank"]
    # a bare number far from any edge that fits no page is text; roman numerals must stand at an edge or by a blank line
    for i in solid:
        if kinds[i] == "page_no" and _number(raw[i])[2] and not (i in (solid[0], solid[-1]) or i + 1 < len(raw) and kinds[i + 1] == "blank" or kinds[i - 1] == "blank"):
            kinds[i] = "text"
    edge = set()
    for step in (1, -1):
        order = solid[::step]
        for j, i in enumerate(order):
            if kinds[i] == "text" and (j == 0 or all(kinds[x] == "page_no" for x in order[:j])):
                edge.add(i)
        for j, i in enumerate(order[:-1]):
            if kinds[i] == "page_no" and 0 < j and kinds[order[j + 1]] == "text":
                edge.add(order[j + 1])
    out = []
    for i, line in enumerate(raw):
        before = next((kinds[j] for j in range(i - 1, -1, -1)), "blank")
        out.append((i + 1, line, kinds[i], line_key(line) if kinds[i] == "text" else "", i in edge, before != "text"))
    return out


LINES = "context_id bigint, document_id string, line_no int, line string, kind string, key string, edge boolean, alone boolean"


def _offsets(pages: DataFrame, least: int = 2) -> DataFrame:
    """(document_id, offset): of each paper the most frequent difference of printed numbers and pages; ties go to the least.

    A difference of up to two needs no support, any other that of least scans; papers without such a difference aren't listed.
    """
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, o) for d, p, t in zip(f["document_id"], f["page_number"], f["context"]) for o in set(page_offsets(t, None if pd.isna(p) else int(p)))]
            yield pd.DataFrame(rows, columns=["document_id", "offset"])

    counted = pages.mapInPandas(scan, "document_id string, offset int").where("document_id is not null").groupBy("document_id", "offset").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.where((F.abs("offset") <= 2) | (F.col("n") >= least))
    best = F.max(F.struct("n", (-F.abs("offset")).alias("a"), "offset"))["offset"]
    return counted.groupBy("document_id").agg(best.alias("offset"))


def _lines(contexts: DataFrame) -> DataFrame:
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(c, d, *x) for c, d, p, t, o in zip(f["context_id"], f["document_id"], f["page_number"], f["context"], f["offset"]) for x in page_lines(t, None if pd.isna(p) else int(p), 0 if pd.isna(o) or abs(o) <= 2 else int(o))]
            yield pd.DataFrame(rows, columns=["context_id", "document_id", "line_no", "line", "kind", "key", "edge", "alone"])

    usable = contexts.where("context_id is not null and context is not null").select(F.col("context_id").cast("bigint").alias("context_id"), F.col("document_id").cast("string").alias("document_id"), F.col("page_number").cast("double").alias("page_number"), "context")
    return usable.join(_offsets(usable), "document_id", "left").mapInPandas(scan, LINES)


def _words(line: Column) -> Column:
    """The words of a line without surrounding punctuation, in order, empty ones left out."""
    return F.filter(F.transform(F.split(F.trim(line), r"\s+"), lambda w: F.regexp_replace(w, TRIM, "")), lambda w: w != "")


def _folded(c: str) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: line_key(x) if isinstance(x, str) else ""), "string")(c)


def alike_keys(counted: DataFrame, share: float = 0.2, hot: int = 1_000_000) -> DataFrame:
    """(key, like) from (key, n): each key and the most frequent of the more frequent keys that differ from it by at most share of its letters
    and have two of its three parts, or itself.

    Of the keys that have two parts alike the most frequent one is tried first: a key that it is near to needs no other of them. Those that it
    isn't near to are compared with all others that are more frequent. Where these are more than hot pairs they are compared in cells of about that
    many; the result doesn't depend on hot.
    """
    third = F.ceil(F.length("key") / 3).cast("int")
    parts = [F.substring("key", F.lit(1), third), F.substring("key", third + 1, third), F.substring("key", 2 * third + 1, third)]
    # of a key that lost or gained letters the outer parts are read from both ends
    back = [F.substring("key", F.length("key") - third + 1, third)]
    signs = F.array(F.concat_ws("1", parts[0], parts[1]), F.concat_ws("2", parts[0], parts[2]), F.concat_ws("3", parts[1], parts[2]), F.concat_ws("4", parts[0], back[0]))
    signed = counted.where(F.length("key") >= 6).select("key", "n", F.explode(F.array_distinct(signs)).alias("sign"))
    top = signed.groupBy("sign").agg(F.max(F.struct("n", "key")).alias("b"), F.min("n").alias("least")).where("b.n > least")
    blocks = cut(signed.join(top, "sign").drop("least"))

    def near(b: str) -> Column:
        return F.call_function("levenshtein", F.col("key"), F.col(b), F.greatest(F.lit(1), (F.length("key") * share).cast("int"))) >= 0

    tried = blocks.where("b.n > n").withColumn("near", near("b.key"))
    left = tried.where(~F.col("near")).select("sign", "key", "n")
    others = blocks.where("b.key <> key and n > 1").select("sign", F.struct("n", "key").alias("b"))
    sizes = left.groupBy("sign").agg(F.count(F.lit(1)).alias("nl")).join(others.groupBy("sign").agg(F.count(F.lit(1)).alias("no")), "sign")
    cells = lambda n: F.when(F.col("nl") * F.col("no") > hot, F.ceil(F.col(n) / F.sqrt(F.lit(hot)))).otherwise(1).cast("int")
    sizes = sizes.select("sign", cells("nl").alias("x"), cells("no").alias("y"))
    place = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(sizes, "sign").select("sign", "key", "n", place("key", "x").alias("i"), every("y").alias("j"))
    others = others.join(sizes, "sign").select("sign", "b", place("b.key", "y").alias("j"), every("x").alias("i"))
    further = left.join(others, ["sign", "i", "j"]).where((F.col("b.n") > F.col("n")) & near("b.key"))
    chosen = tried.where("near").select("key", "b").unionByName(further.select("key", "b")).groupBy("key").agg(F.max("b")["key"].alias("like"))
    return counted.select("key").join(chosen, "key", "left").select("key", F.coalesce("like", "key").alias("like"))


def mark_running_lines(lines: DataFrame, papers: DataFrame | None = None, papers_share: float = 0.6, least_papers: int = 5) -> DataFrame:
    """lines with kind 'header' where a line is a running header or footer.

    A line's key, fuzzily (see alike_keys), and its shape (the line with # for words that few papers have) are counted over all lines of
    the corpus and of the paper. It is a running line if it stands at a page's edge or alone, and its key or shape comes back in at least
    least_papers papers, mostly at edges; or its key comes back in the paper, mostly at edges, and is no line that stands inside pages
    elsewhere; or it is the title of the paper.
    """
    # a running line begins with a capital or a number and doesn't end as a sentence does
    opens = F.col("line").rlike(r"^\W*[\p{Lu}\p{N}]")
    closed = F.col("line").rlike(r"[,;:?!=(–-]\s*$") | F.col("line").rlike(r"(?<!\b\p{L}{1,3})\.\s*$")
    short = lines.where((F.col("kind") == "text") & (F.col("key") != "") & opens & ~closed).select("context_id", "line_no", "document_id", "line", "key", "edge", "alone")
    like = alike_keys(cut(short.groupBy("key").agg(F.count(F.lit(1)).alias("n"))))
    short = cut(short.withColumn("shape", _shape(short, least_papers)).drop("line").join(like, "key"))
    by_key = short.groupBy("like").agg(F.avg(F.col("edge").cast("double")).alias("k_edge"), F.approx_count_distinct("document_id").alias("k_papers"))
    by_paper = short.groupBy("document_id", "like").agg(F.count(F.lit(1)).alias("p_n"), F.avg(F.col("edge").cast("double")).alias("p_edge"))
    # few lines of a shape may all stand at edges by chance: the lower bound of the share counts
    p, n = F.avg(F.col("edge").cast("double")), F.count(F.lit(1))
    lower = (p + 2 / n - 2 * F.sqrt(p * (1 - p) / n + 1 / (n * n))) / (1 + 4 / n)
    by_shape = short.where("shape is not null").groupBy("shape").agg(lower.alias("s_edge"), F.approx_count_distinct("document_id").alias("s_papers"))
    # only lines at edges or alone may be running lines
    joined = short.where("edge or alone").join(by_key, "like", "left").join(by_shape, "shape", "left").join(by_paper, ["document_id", "like"], "left")
    if papers is not None:
        titles = papers.where("document_id is not null and title is not null").select("document_id", _folded("title").alias("key"), F.lit(True).alias("titled")).where("key <> ''").distinct()
        joined = joined.join(titles, ["document_id", "key"], "left")
    else:
        joined = joined.withColumn("titled", F.lit(None).cast("boolean"))
    inside = (F.col("k_papers") >= least_papers) & (F.col("k_edge") < papers_share)
    header = (F.col("edge") | F.col("alone")) & (
        ((F.col("k_papers") >= least_papers) & (F.col("k_edge") >= papers_share))
        | F.coalesce((F.col("s_papers") >= least_papers) & (F.col("s_edge") >= papers_share), F.lit(False))
        | ((F.col("p_n") >= 2) & (F.col("p_edge") >= 0.5) & ~inside)
        | F.coalesce(F.col("titled"), F.lit(False))
    )
    marked = joined.where(header).select("context_id", "line_no", F.lit(True).alias("running")).distinct()
    return lines.join(marked, ["context_id", "line_no"], "left").withColumn("kind", F.when(F.col("running"), "header").otherwise(F.col("kind"))).drop("running")


def _shape(short: DataFrame, least_papers: int) -> Column:
    """A line's shape: the line in small letters with # for words that under least_papers papers have in such lines, runs of # as one; null
    where it has no such word, or no other.

    Which words are known is kept in a bitmap of fixed size, by their hash.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower("line"), r"[^\p{L}]+", " ")), " ")
    said = short.select("document_id", F.explode(F.array_distinct(words)).alias("w")).where("w <> ''")
    known = said.groupBy("w").agg(F.approx_count_distinct("document_id").alias("papers")).where(F.col("papers") >= least_papers)
    bits = short.sparkSession.sparkContext.broadcast(np.packbits(bitmap(known.select(F.crc32("w").alias("h")))))
    unpacked: list[np.ndarray] = []

    def shaped(s: pd.Series) -> pd.Series:
        if not unpacked:
            unpacked.append(np.unpackbits(bits.value).astype(bool))
        out = []
        for line in s:
            found = re.findall(r"[^\W\d_]+", line.lower())
            kept = [w if unpacked[0][zlib.crc32(w.encode()) % BITS] else "#" for w in found]
            text = re.sub("#(?: #)+", "#", " ".join(kept))
            out.append(text if "#" in kept and any(w != "#" for w in kept) else None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(shaped, "string")("line")


def _broken(line: Column) -> Column:
    return F.regexp_extract(line, r"([\p{L}\p{N}'’-]*[\p{L}])[-\x{00AC}\x{00AD}\x{2010}]\s*$", 1)


def _candidates(word: str) -> list[str]:
    """Words that one confusion may have turned into word; digits and ligatures among letters are all put back at once."""
    letters = re.search(r"[^\W\d_]", word) is not None
    found = set()
    if letters and re.search(r"[0156ﬁﬂﬀ]", word):
        base = word
        for a, b in (("0", "o"), ("1", "l"), ("5", "s"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
            base = base.replace(a, b)
        found.add(base)
    for a, b in CONFUSIONS:
        for m in re.finditer(re.escape(a), word):
            found.add(word[: m.start()] + b + word[m.end() :])
    return sorted(found - {word})


NUMBER = re.compile(r"^[0-9lO]+(?:[.,:/–-][0-9lO]+)*$")


def _number_fix(word: str) -> str | None:
    """A number with l or O for 1 or 0, put right; null for all else."""
    if re.search(r"[lO]", word) and NUMBER.match(word):
        return word.translate(str.maketrans("lO", "10"))
    return None


#: letters up to which all changed forms of a word are tried one by one
LONG = 64


class CharModel:
    """Interpolated trigrams of characters over the corpus's words."""

    def __init__(self, counts: dict[str, int]):
        self.three = counts
        self.two: dict[str, int] = {}
        self.one: dict[str, int] = {}
        for g, n in counts.items():
            self.two[g[:2]] = self.two.get(g[:2], 0) + n
            self.one[g[2]] = self.one.get(g[2], 0) + n
        self.mid: dict[str, int] = {}
        for g, n in counts.items():
            self.mid[g[1:]] = self.mid.get(g[1:], 0) + n
        self.left: dict[str, int] = {}
        for g, n in self.mid.items():
            self.left[g[0]] = self.left.get(g[0], 0) + n
        self.all = sum(counts.values()) or 1

    def log(self, word: str) -> float:
        w, total = f"^^{word}$", 0.0
        for i in range(2, len(w)):
            a, b, c = w[i - 2 : i], w[i - 1 : i], w[i]
            p1 = (self.one.get(c, 0) + 0.5) / (self.all + 100)
            p2 = (self.mid.get(b + c, 0) + 5 * p1) / (self.left.get(b, 0) + 5)
            p3 = (self.three.get(a + c, 0) + 5 * p2) / (self.two.get(a, 0) + 5)
            total += math.log(p3)
        return total


def corrections(counted: DataFrame, ratio: float = 8.0, least: int = 3, gain: float = 7.0, rare: int = 3) -> DataFrame:
    """(word, right) from (word, n): words that are likely misread forms of others.

    right is a word of the corpus that one confusion turns into word, at least ratio times as frequent and with least occurrences, the most
    frequent such. A rare word without one is put right if digits or ligatures stand among its letters, or where a character model of the
    corpus prefers a candidate by gain nats. Numbers with l or O are put right in any case.
    """
    grams = (
        counted.where(F.col("word").rlike(r"^[\p{L}'’-]+$") & (F.length("word") >= 3))
        .select(F.concat(F.lit("^^"), F.lower("word"), F.lit("$")).alias("w"), F.lit(1).alias("n"))
        .select(F.explode(F.expr("transform(sequence(1, length(w) - 2), i -> substring(w, i, 3))")).alias("g"), "n")
        .groupBy("g").agg(F.sum("n").alias("n"))
    )
    model = counted.sparkSession.sparkContext.broadcast(CharModel({r.g: r.n for r in bounded_rows(grams.where("n > 1"), 2_000_000, "the table of character trigrams")}))

    def propose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for w, n in zip(f["word"], f["n"]):
                fixed = _number_fix(w)
                if fixed:
                    rows.append((w, n, fixed, True, 99.0))
                    continue
                if not re.search(r"[^\W\d_]", w) or len(w) > LONG or re.match(r"^(?:[^\W\d_]|[A-Z]{2}|[^\W\d_]{1,3}[-–])\d+$", w):
                    continue
                had = model.value.log(w.lower())
                for v in _candidates(w):
                    direct = bool(re.search(r"[^\W\d_][015][^\W\d_]|^[05][^\W\d_]{2}|[^\W\d_]{3}[015]$|[ﬁﬂﬀ]", w)) and not re.search(r"[0-9ﬁﬂﬀ]", v)
                    rows.append((w, n, v, direct, model.value.log(v.lower()) - had))
            yield pd.DataFrame(rows, columns=["word", "n", "right", "direct", "gain"])

    # a word is only looked at once however often it occurs
    proposed = counted.mapInPandas(propose, "word string, n bigint, right string, direct boolean, gain double")
    # of very long words the changed forms would be as many as their letters squared; they meet by the key in which confused characters are one
    long = counted.where(F.length("word") > LONG).withColumn("k", _folded("word"))
    others = long.select("k", F.col("word").alias("right"), F.col("n").alias("__n"))
    best = others.groupBy("k").agg(F.max(F.struct("__n", "right"))["right"].alias("right"))
    proposed = proposed.unionByName(long.join(best, "k").where("right <> word").select("word", "n", "right", F.lit(False).alias("direct"), F.lit(0.0).alias("gain")))
    known = counted.select(F.col("word").alias("right"), F.col("n").alias("n_right"))
    rated = proposed.join(known, "right", "left").withColumn("n_right", F.coalesce("n_right", F.lit(0)))
    by_corpus = (F.col("n_right") >= least) & (F.col("n_right") >= ratio * F.col("n"))
    by_shape = (F.col("n") <= rare) & (F.col("direct") | ((F.col("gain") >= gain) & (F.length("word") >= 5)))
    score = F.struct(by_corpus.alias("corpus"), F.col("direct").alias("direct"), F.when(by_corpus, F.col("n_right")).otherwise(0).alias("n"), "gain", "right")
    return rated.where(by_corpus | by_shape | (F.col("gain") == 99.0)).groupBy("word").agg(F.max(score)["right"].alias("right"))


def repair(contexts: DataFrame, papers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cases, lines): the noise found, and the lines with what they should read.

    cases: context_id, line_no, kind ('header', 'page_no', 'hyphen', 'misread'), word; one row per distinct case. lines: context_id, line_no,
    kind, line, fixed (the line with its words put right, a broken word whole and only in its first line; null for lines that go).
    Null contexts have no lines; a blank one has blank lines only; repeated context ids are read as one page each and their equal cases fall
    together; an empty table gives empty results; null pages or papers only weaken what is known of page numbers and headers.
    """
    lines = cut(mark_running_lines(cut(_lines(contexts)), papers).select("context_id", "line_no", "line", "kind"))
    texts = lines.where("kind = 'text'")
    order = Window.partitionBy("context_id").orderBy("line_no")  # the lines of one page
    texts = texts.withColumn("words", _words(F.col("line"))).withColumn("stem", F.nullif(_broken(F.col("line")), F.lit("")))
    texts = texts.withColumn("next", F.lead("line").over(order)).withColumn("after", F.lag("stem").over(order))
    rest = F.regexp_extract("next", r"^\s*([\p{L}\p{N}'’-]*[\p{L}\p{N}])", 1)
    texts = texts.withColumn("rest", F.when(F.col("stem").isNotNull() & (rest != "") & rest.rlike(r"^[\p{Ll}\p{N}]"), rest))
    texts = texts.withColumn("after", F.when(F.col("after").isNotNull() & F.col("line").rlike(r"^\s*[\p{Ll}\p{N}]"), True))
    size = F.size("words") - F.when(F.col("after"), 1).otherwise(0) - F.when(F.col("rest").isNotNull(), 1).otherwise(0)
    whole = F.when(size > 0, F.slice("words", F.when(F.col("after"), 2).otherwise(1), size)).otherwise(F.array().cast("array<string>"))
    texts = cut(texts.select("context_id", "line_no", "line", "stem", "rest", "after", whole.alias("whole")))
    counted = cut(texts.select(F.explode("whole").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    right = cut(corrections(counted))
    said = texts.select("context_id", "line_no", F.explode("whole").alias("word")).join(right, "word")
    misread = said.select("context_id", "line_no", F.lit("misread").alias("kind"), F.col("right").alias("word"))
    split = texts.where("rest is not null").select("context_id", "line_no", "stem", "rest", F.concat("stem", "rest").alias("joined"), F.concat("stem", F.lit("-"), "rest").alias("dashed"), F.col("line").rlike(r"-\s*$").alias("plain"))
    hyphen = join_broken(split, counted, right).select("context_id", "line_no", F.lit("hyphen").alias("kind"), "word")
    gone = lines.where("kind in ('header', 'page_no')").select("context_id", "line_no", "kind", F.lit("").alias("word"))
    cases = gone.unionByName(misread).unionByName(hyphen).distinct()
    return cases, _fixed(lines, texts, misread=said, hyphen=hyphen)


def join_broken(split: DataFrame, counted: DataFrame, right: DataFrame) -> DataFrame:
    """split with word: the parts as one word or with a hyphen, whichever the corpus knows better, put right where misread.

    Unknown both ways, a plain hyphen between two words of the corpus stays, and all other parts are joined.
    """
    def times(of: str, name: str) -> DataFrame:
        return counted.select(F.col("word").alias(of), F.col("n").alias(name))

    def fix(of: str, name: str) -> DataFrame:
        return right.select(F.col("word").alias(of), F.col("right").alias(name))

    pairs = split.select("joined", "dashed", "stem", "rest", "plain").distinct()
    # a broken word may be misread too: what its parts together may be is proposed for words the corpus lacks
    unknown = pairs.select(F.col("joined").alias("word")).distinct().join(counted, "word", "left_anti").withColumn("n", F.lit(1).cast("bigint"))

    def propose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(w, v) for w in f["word"] for v in _candidates(w)]
            yield pd.DataFrame(rows, columns=["joined", "word"])

    mended = unknown.mapInPandas(propose, "joined string, word string").join(counted, "word").groupBy("joined").agg(F.max(F.struct("n", "word"))["word"].alias("mended"))
    rated = pairs.join(times("joined", "nj"), "joined", "left").join(times("dashed", "nd"), "dashed", "left").join(times("stem", "ns"), "stem", "left").join(times("rest", "nr"), "rest", "left")
    rated = rated.join(mended, "joined", "left").join(fix("joined", "fj"), "joined", "left").join(fix("dashed", "fd"), "dashed", "left")
    keeps = (F.coalesce("nd", F.lit(0)) > F.coalesce("nj", F.lit(0))) | (F.col("plain") & F.col("nj").isNull() & F.col("mended").isNull() & (F.col("ns") >= 3) & (F.col("nr") >= 3) & (F.length("stem") > 2) & (F.length("rest") > 3))
    word = F.when(keeps, F.coalesce("fd", "dashed")).otherwise(F.coalesce("fj", "mended", "joined"))
    chosen = rated.select("joined", "dashed", "plain", word.alias("word")).groupBy("joined", "dashed", "plain").agg(F.max("word").alias("word"))
    return split.join(chosen, ["joined", "dashed", "plain"])


def _fixed(lines: DataFrame, texts: DataFrame, misread: DataFrame, hyphen: DataFrame) -> DataFrame:
    swaps = misread.groupBy("context_id", "line_no").agg(F.map_from_entries(F.collect_set(F.struct("word", "right"))).alias("swaps"))
    wholes = hyphen.groupBy("context_id", "line_no").agg(F.max("word").alias("joined"))
    rows = texts.select("context_id", "line_no", "line", "after").join(swaps, ["context_id", "line_no"], "left").join(wholes, ["context_id", "line_no"], "left")

    def core(w: Column) -> Column:
        return F.regexp_replace(w, TRIM, "")

    none = F.create_map().cast("map<string,string>")
    put = F.transform(
        F.split(F.trim("line"), r"\s+"),
        lambda w: F.when(F.try_element_at(F.coalesce("swaps", none), core(w)).isNotNull(), F.concat(F.regexp_extract(w, r"^([^\p{L}\p{N}]*)", 1), F.try_element_at(F.coalesce("swaps", none), core(w)), F.regexp_extract(w, r"([^\p{L}\p{N}]*)$", 1))).otherwise(w),
    )
    put = F.when(F.col("joined").isNotNull(), F.concat(F.slice(put, 1, F.size(put) - 1), F.array(F.concat(F.regexp_extract(F.element_at(put, -1), r"^([^\p{L}\p{N}]*)", 1), F.col("joined"))))).otherwise(put)
    # what stood before the next blank of the following line has moved up; its punctuation follows it
    fixed = rows.select("context_id", "line_no", "after", F.array_join(put, " ").alias("fixed"), F.col("joined").isNotNull().alias("open"))
    order = Window.partitionBy("context_id").orderBy("line_no")
    fixed = fixed.withColumn("moved", F.lag("open").over(order))
    tail = F.regexp_extract(F.lead("fixed").over(order), r"^[\p{L}\p{N}'’-]*([^\p{L}\p{N}\s]*)", 1)
    fixed = fixed.withColumn("fixed", F.when(F.col("open"), F.concat("fixed", F.coalesce(tail, F.lit("")))).otherwise(F.col("fixed")))
    fixed = fixed.withColumn("fixed", F.when(F.col("moved"), F.regexp_replace("fixed", r"^\S+\s*", "")).otherwise(F.col("fixed")))
    return lines.select("context_id", "line_no", "kind", "line").join(fixed.select("context_id", "line_no", "fixed"), ["context_id", "line_no"], "left")


def paragraphs(lines: DataFrame) -> DataFrame:
    """(context_id, paragraph_no, text) from the lines of repair(): continuous paragraphs, parted by blank lines.

    A blank line parts none where a page break was taken out and the text runs on: no closing mark before, a small letter behind.
    """
    order = Window.partitionBy("context_id").orderBy("line_no")
    rows = lines.where("kind = 'text' and fixed <> ''").withColumn("gap", F.col("line_no") - F.lag("line_no").over(order) > 1)
    runs_on = ~F.coalesce(F.lag("fixed").over(order).rlike(r"[.!?:)”\"]\s*$"), F.lit(False)) & F.col("fixed").rlike(r"^[\p{Ll}\p{N}(=><–]")
    rows = rows.withColumn("starts", F.col("gap").isNull() | (F.col("gap") & ~runs_on)).withColumn("paragraph_no", F.sum(F.col("starts").cast("int")).over(order))
    grouped = rows.groupBy("context_id", "paragraph_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "fixed"))).alias("l"))
    return grouped.select("context_id", F.col("paragraph_no").cast("int").alias("paragraph_no"), F.array_join(F.col("l.fixed"), " ").alias("text"))
