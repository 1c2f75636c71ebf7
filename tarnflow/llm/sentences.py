"""Sentence boundaries across languages and scripts by a hidden-event n-gram language model.

A text is laid out into blocks: markup and tables belong to none, headings and list entries are units. Inside a block the hidden event,
boundary or none, may stand at sites: behind closing punctuation outside of matched quotation marks and brackets; in scripts that part
sentences by blanks, at white space; and in a block without any mark, between all of its words. The model is an n-gram model over
words and events: an event depends on the two words before it, or on one word and the event before that; a word depends on the
event before it, or if there is none on the word before. Longer histories are smoothed by shorter ones and by the shape of the word.

Counts are kept in tables of a fixed number of buckets, by hash of the n-gram, so the model has one size whatever the corpus. It is
trained on the corpus itself: ends and starts of blocks are observed boundaries, the events at all other sites are hidden and
re-estimated by expectation-maximisation, each round one aggregation over all sites. Texts are laid out once, for training and for
splitting. Posteriors of the events are found by the forward-backward algorithm over the sites of each block.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.runtime import cut

TABLE = r"<table\b.*?</table\s*>"
SEAM = re.compile(rf"(?:\s*(?:{TABLE}|</?[A-Za-z][^<>\n]*>)\s*)+|[^\S\n]*\n(?:[^\S\n]*\n)+\s*", re.S)
BULLET = re.compile(r"\s*(?:[-*•‣◦–—·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\([ivx]+\))[^\S\n]+\S")
TERMINATORS = ".!?…。！？।॥؟۔;．｡።"
FULL_STOPS = "。！？｡．"
OPENERS, CLOSERS = "([{“„«‹「『（【〈《‘", ")]}”“»›」』）】〉》’"
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "【": "】", "〈": "〉", "《": "》"}
SITE = re.compile(r"[" + re.escape(TERMINATORS) + r"]+")
SCRIPTS = [
    ("Thai", 0x0E00, 0x0E7F), ("Laoo", 0x0E80, 0x0EFF), ("Mymr", 0x1000, 0x109F), ("Khmr", 0x1780, 0x17FF), ("Deva", 0x0900, 0x0DFF), ("Arab", 0x0600, 0x06FF), ("Arab", 0x0750, 0x077F), ("Grek", 0x0370, 0x03FF),
    ("Grek", 0x1F00, 0x1FFF), ("Cyrl", 0x0400, 0x052F), ("Hani", 0x3040, 0x30FF), ("Hani", 0x3400, 0x9FFF), ("Hani", 0xF900, 0xFAFF), ("Hani", 0x20000, 0x3FFFF), ("Hang", 0xAC00, 0xD7AF),
]
_STARTS = sorted((a, b, s) for s, a, b in SCRIPTS)
_LOWS = [a for a, _, _ in _STARTS]
#: scripts that part sentences by blanks, not by marks
UNMARKED = {"Thai", "Laoo", "Mymr", "Khmr"}


def script_of(c: str) -> str:
    o = ord(c)
    if o < 0x0370:
        return "Latn"
    i = bisect_right(_LOWS, o) - 1
    return _STARTS[i][2] if i >= 0 and o <= _STARTS[i][1] else "Latn"


def blocks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of 'text', 'heading' and 'entry' blocks, without outer white space."""
    out, at = [], 0
    for m in [*SEAM.finditer(text), None]:
        end = m.start() if m else len(text)
        body = text[at:end]
        a, b = at + len(body) - len(body.lstrip()), at + len(body.rstrip())
        at = m.end() if m else end
        if a < b:
            out += _entries(text, a, b)
    return out


def _entries(text: str, a: int, b: int) -> list[tuple[int, int, str]]:
    lines, at = [], a
    for line in text[a:b].split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    first = BULLET.match(lines[0][1])
    kind = lines[0][1].lstrip()[:1] if first else ""
    if first and not kind.isalnum() and kind != "(":
        starts = [at for at, line in lines if BULLET.match(line) and line.lstrip()[:1] == kind]
    elif first and len(lines) > 1 and sum(bool(BULLET.match(line)) for _, line in lines) == len(lines):
        starts = [at for at, _ in lines]
    else:
        heading = len(lines) == 1 and b - a <= 80 and text[b - 1] not in TERMINATORS + CLOSERS + "\"':," and not any(script_of(c) in UNMARKED for c in text[a:b])
        return [(a, b, "heading" if heading else "text")]
    ends = [*starts[1:], b + 1]
    return [(s + len(text[s:e]) - len(text[s:e].lstrip()), s + len(text[s : min(e, b)].rstrip()), "entry") for s, e in zip(starts, ends)]


_MARKS = re.compile("[" + re.escape("".join(PAIRS) + "".join(PAIRS.values()) + '"') + "]")


def _inside(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Spans within matched quotation marks and brackets, outermost only, and the places of all closing marks; marks without a partner
    count for nothing."""
    stack: list[tuple[str, int]] = []
    spans = []
    for m in _MARKS.finditer(text, a, b):
        c, i = m.group(), m.start()
        if c == '"' and not any(o == '"' for o, _ in stack):
            stack.append((c, i))
        elif c == '"' or any(c in PAIRS.get(o, "") for o, _ in stack):
            while stack[-1][0] != '"' if c == '"' else c not in PAIRS.get(stack[-1][0], ""):
                stack.pop()
            spans.append((stack.pop()[1], i))
        elif c in PAIRS:
            stack.append((c, i))
    outer: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if not outer or s > outer[-1][1]:
            outer.append((s, e))
    return outer, {e for _, e in spans}


def _closed(text: str, end: int, b: int, closes: set[int]) -> int:
    """The end of a mark together with the quotation marks and brackets that close behind it."""
    while end < b:
        c = text[end]
        if end in closes or c in ")]}”」』）】〉》’'":
            end += 1
        elif c in " \u00a0\u202f" and end + 1 in closes and text[end + 1] in "»›":
            end += 2
        else:
            break
    return end


_UNMARKED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")
_GREEK = re.compile("[\u0370-\u03ff\u1f00-\u1fff]")
_HAN = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_BLANKS = re.compile(r"\s+")
_OPENERS = OPENERS + '"'
RIGHT_WORD = re.compile(r"\s*([" + re.escape(OPENERS) + r"\"¿¡—–-]*)\s*([^\W_]+(?:[.'’-][^\W_]+)*\.?|\S)")


def _ending(text: str, a: int, b: int) -> str:
    """What stands between the last blank or opening mark of text[a:b] and its end."""
    part = text[a:b]
    if not part or part[-1].isspace():
        return ""
    word = part.split()[-1] if len(part) < 40 else part[-40:].split()[-1]
    if len(word) >= 40:  # the blank lies further back
        word = part.split()[-1]
    at = max(word.rfind(c) for c in _OPENERS)
    return word[at + 1 :]


def _shape(word: str) -> str:
    if word.isdigit():
        return f"<{min(len(word), 5)}d>"
    if word[:1].isdigit():
        return "<num>"
    first = next((c for c in word if c.isalpha()), None)
    if first is None:
        return "<mark>"
    s = script_of(first)
    if first.isupper() and (len(word) == 1 or sum(c.isalpha() for c in word) == 1):
        return f"<{s} initial>"
    return f"<{s} {'Upper' if first.isupper() else 'lower'}>"


_ENDS = "".join(sorted(set(TERMINATORS + CLOSERS + "\"'"))) + " "
_PIECE = re.compile(r"[^\W_]*(?:[.'’-][^\W_]+)*$")


def _left(word: str, script: str) -> tuple[str, str]:
    """(form, shape) of the word that ends before a site."""
    core = word.rstrip(_ENDS)
    tail = "".join(word[len(core) :].split())
    if script in ("Hani", *UNMARKED):
        letter = core[-1:]
        if script == "Hani" or not letter:
            return f"*{tail}", f"<any>{tail}"
        if script_of(letter) in UNMARKED:
            return core[-6:] + tail, f"<{script}>{tail}"
        piece = re.search(r"[^\W_]*(?:\.\d+)?$", core).group() or core[-1:]
        return _shape(piece) + tail, _shape(piece) + tail
    piece = core if core.isalpha() else _PIECE.search(core).group()
    if not piece:
        return f"<mark>{tail}", f"<mark>{tail}"
    shape = _shape(piece) + tail
    return (shape, shape) if piece[0].isdigit() or "initial" in shape and len(piece) == 1 else (piece.lower() + tail, shape)


def _right(text: str, at: int, end: int) -> tuple[str, str]:
    """(form, shape) of what begins at a site, with the marks that open it."""
    m = RIGHT_WORD.match(text, at, end)
    if not m:
        return "<none>", "<none>"
    lead, word = m.group(1), m.group(2)
    s = script_of(word[0])
    if s in ("Hani", *UNMARKED):
        piece = re.match(r"[^\W\d_a-zA-Z]{1,2}" if s == "Hani" else r"[^\s\da-zA-Z]{1,6}", word)
        return lead + (piece.group() if piece else word[0]), f"{lead}<{s}>"
    if word[0].isdigit():
        return lead + _shape(re.match(r"\w+", word).group()), lead + _shape(re.match(r"\w+", word).group())
    inner = re.match(r"[a-zA-Z]+", word)
    if inner and inner.end() < len(word) and script_of(word[inner.end()]) == "Hani":
        word = inner.group()
    shape = lead + _shape(word)
    return (shape if "initial" in shape else lead + word), shape


@dataclass
class Site:
    end: int
    before: str  # the word before the left one, '' where there is none
    left: tuple[str, str]
    right: tuple[str, str]
    first: int  # 2: only one word since the block's start, 1: only one word since the site before, else 0


def sites(text: str, a: int, b: int) -> list[Site]:
    """The sites of a block that has marks, or blanks in a script that parts sentences by them."""
    unmarked = _is_unmarked(text, a, b)
    greek = _GREEK.search(text, a, b) is not None
    held, closes = _inside(text, a, b)
    begins = [s for s, _ in held]
    found: list[Site] = []
    spots = [(m.start(), _closed(text, m.end(), b, closes)) for m in SITE.finditer(text, a, b)]
    if unmarked:
        spots += [(m.start(), m.start()) for m in _BLANKS.finditer(text, a, b)]
        spots = sorted({e: (s, e) for s, e in sorted(spots, reverse=True)}.values())
    before = a
    for start, end in spots:
        if end >= b or start <= a and end == start:
            continue
        i = bisect_right(begins, start) - 1
        if i >= 0 and start <= held[i][1] and not held[i][1] < end:
            continue
        i = bisect_right(begins, end - 1) - 1
        if i >= 0 and held[i][0] < end <= held[i][1]:
            continue
        mark, after = text[start:end], text[end]
        if mark and not after.isspace():
            if not (any(c in FULL_STOPS for c in mark) or script_of(after) == "Hani" and mark[0] in "…!?." or mark[0] == "…" and script_of(text[start - 1 : start] or "a") == "Hani"):
                continue
        if mark and set(mark) <= {";"} and not greek:
            continue
        word = _ending(text, max(before, start - 200), start)
        script = "Thai" if unmarked else ("Hani" if any(c in FULL_STOPS for c in mark) or script_of(after) == "Hani" else "Latn")
        alone = not re.search(r"\S\s+\S", text[before:start].strip() + "x") if start - before < 40 else False
        if _one_case(text, max(a, end - 60), min(b, end + 60)) or end + 150 <= b and _one_case(text, end, end + 150):  # read as if written in the usual one
            left, right = _left(word.capitalize() + mark, script), _right(_capital(text[end : min(b, end + 60)]), 0, min(b - end, 60))
        else:
            left, right = _left(word + mark, script), _right(text, end, b)
        found.append(Site(end, "" if alone else _word_before(text, before, start - len(word)), left, right, (2 if before == a else 1) if alone else 0))
        before = end
    return found


def _one_case(text: str, a: int, b: int) -> bool:
    part = text[a:b]
    return part.islower() or part.isupper()


def _capital(text: str) -> str:
    """Lower case but for the first letter; as long as text."""
    low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    i = next((i for i, c in enumerate(low) if c.isalpha()), 0)
    return low[:i] + (low[i].upper() if len(low[i : i + 1].upper()) == 1 else low[i : i + 1]) + low[i + 1 :]


def _is_unmarked(text: str, a: int, b: int) -> bool:
    """True where over three tenths of a block's characters belong to scripts that part sentences by blanks."""
    if not _UNMARKED.search(text, a, b):
        return False
    return sum(1 for _ in _UNMARKED.finditer(text, a, b)) > 0.3 * (b - a)


_SPACED_OPENER = re.compile(r"([" + re.escape(OPENERS) + r"\"¿¡—–-]+)\s+")
_HAN_PLACE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff](?=([^\W\d_a-zA-Z]{1,2}|[a-zA-Z]+))")


def _words_of(token: str) -> list[tuple[str, str]]:
    """(form, shape) of what begins with a word between blanks, and of what begins inside it in scripts without blanks."""
    out = [_right(token, 0, len(token))]
    if _HAN.search(token):
        for m in _HAN_PLACE.finditer(token):
            g = m.group(1)
            if g[0].isascii():
                out.append((_shape(g), _shape(g)))
            elif _HAN.match(g):
                out.append((g, "<Hani>"))
    return out


def _word_before(text: str, a: int, at: int) -> str:
    """The word that ends before at, in lower case; '' if none begins behind a."""
    near = text[max(a, at - 60) : at].rstrip()
    return _ending(near, 0, len(near))[-20:].lower()


_TOKEN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[^\s\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")


def _tokens(text: str, a: int, b: int) -> list[tuple[int, int, str]]:
    """(start, end, what begins there) of the words of a block: without marks and in lower case; of scripts without blanks every character
    is a word, and what begins there are two characters."""
    out = []
    for m in _TOKEN.finditer(text, a, b):
        if _HAN.match(m.group()):
            two = text[m.start() : min(b, m.start() + 2)]
            out.append((m.start(), m.end(), two if _HAN.match(two[-1]) else two[0]))
        elif word := _bare(m.group()):
            out.append((m.start(), m.end(), word))
    return out


def _first_word(text: str, at: int, b: int) -> str:
    for m in _TOKEN.finditer(text, at, min(b, at + 60)):
        if _HAN.match(m.group()):
            two = text[m.start() : min(b, m.start() + 2)]
            return two if _HAN.match(two[-1]) else two[0]
        if word := _bare(m.group()):
            return word
    return ""


def _open_sites(text: str, a: int, b: int) -> list[tuple[int, int, str, str]]:
    """(end, begin of the next word, word before, word behind) of the places between all words of a block without marks."""
    tokens = _tokens(text, a, b)
    return [(e0, s1, _last_word(text, a, e0), right) for (_, e0, _), (s1, _, right) in zip(tokens, tokens[1:])]


_STRIPPED = "".join(sorted(set(TERMINATORS + OPENERS + CLOSERS + "\"',"))) + "¿¡—–-"
_MARKED = "".join(sorted(set(TERMINATORS + CLOSERS + "\"',"))) + " \n\t\u00a0\u202f"


def _bare(word: str) -> str:
    return word.strip(_STRIPPED).lower()


#: buckets of the tables: words and shapes, n-grams of two
ONE, TWO, SHAPES = 1 << 18, 1 << 19, 1 << 14
WIDTH = 12  # numbers kept of a site
END, NEXT, LEFT, LEFT_SHAPE, PAIR, RIGHT, RIGHT_SHAPE, BIGRAM, BIGRAM_SHAPE, WORD, FOLDED, FIRST = range(WIDTH)
#: the tables and their sizes; a site adds to all, by its columns
SIZES = {LEFT: ONE, LEFT_SHAPE: SHAPES, PAIR: TWO, RIGHT: ONE, RIGHT_SHAPE: SHAPES, BIGRAM: TWO, BIGRAM_SHAPE: TWO, WORD: ONE, FOLDED: ONE}
TEXT, HEADING, ENTRY, OPEN = range(4)
SITE_COUNT, START, STOP, SEEN, EVENT = range(5)


def _hash(*parts: str) -> int:
    """A hash of 32 bits, as a signed number: its rest by the size of a table is the bucket, the quotient tells n-grams of a bucket apart."""
    h = zlib.crc32("\u0001".join(parts).encode("utf-8", "surrogatepass"))
    return h - (1 << 32) if h >= 1 << 31 else h


def layout(text: str, tally: dict[tuple[int, int, int], int], words: Counter) -> np.ndarray:
    """Blocks and sites of a text as numbers: for each block its start, end, kind and number of sites, and WIDTH numbers for each site.

    tally takes what is counted beside the sites: (column, hash, START or STOP); words takes all words between blanks as they are written.
    """
    out: list[int] = []
    for a, b, kind in blocks(text):
        if kind != "text":
            out += (a, b, HEADING if kind == "heading" else ENTRY, 0)
            continue
        if not SITE.search(text, a, b) and not _is_unmarked(text, a, b):
            places = _open_sites(text, a, b)
            out += (a, b, OPEN, len(places))
            for end, begin, left, right in places:
                out += (end, begin, 0, 0, 0, 0, 0, 0, 0, _hash(left), _hash(right), 0)
            continue
        found = sites(text, a, b)
        out += (a, b, TEXT, len(found))
        for s in found:
            begin = s.end + len(text[s.end : b]) - len(text[s.end : b].lstrip())
            left, right = s.left[0], s.right[0]
            word = _last_word(text, a, s.end)
            out += (
                s.end, begin, _hash(left), _hash(s.left[1]), _hash("<s>" if s.first == 2 else s.before, left), _hash(right), _hash(s.right[1]),
                _hash(left, right), _hash(left, s.right[1]), _hash(word), _hash(_first_word(text, begin, b)), s.first,
            )
        form, shape = _right(text, a, b)
        for key in ((RIGHT, _hash(form)), (RIGHT_SHAPE, _hash(shape)), (FOLDED, _hash(_first_word(text, a, b)))):
            tally[(*key, START)] += 1
        form, shape = _block_end(text, a, b)
        for key in ((LEFT, _hash(form)), (LEFT_SHAPE, _hash(shape)), (WORD, _hash(_last_word(text, a, b)))):
            tally[(*key, STOP)] += 1
        tokens = _SPACED_OPENER.sub(r"\1", text[a:b]).split()
        words.update(tokens[1:])
        for _, _, word in _tokens(tokens[0], 0, len(tokens[0])):
            tally[FOLDED, _cached(word), SEEN] += 1
    return np.array(out, np.int32)


def count_words(words: Counter, tally: dict[tuple[int, int, int], int]) -> None:
    """Adds words, each form looked at once, to tally, and empties them."""
    for token, n in words.items():
        for form, shape in _words_of(token):
            tally[RIGHT, _cached(form), SEEN] += n
            tally[RIGHT_SHAPE, _cached(shape), SEEN] += n
        for _, _, word in _tokens(token, 0, len(token)):
            tally[FOLDED, _cached(word), SEEN] += n
    words.clear()


_hashes: dict[str, int] = {}


def _cached(form: str) -> int:
    got = _hashes.get(form)
    if got is None:
        if len(_hashes) > 500_000:
            _hashes.clear()
        got = _hashes[form] = _hash(form)
    return got


def _last_word(text: str, a: int, end: int) -> str:
    """The word before end without its marks, in lower case; of scripts without blanks the last two characters."""
    near = text[max(a, end - 60) : end].rstrip(_MARKED)
    if near and _HAN.match(near[-1]):
        return near[-2:] if len(near) > 1 and _HAN.match(near[-2]) else near[-1]
    tail = re.split(r"[\s\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]", near)[-1]
    return _bare(tail)


def _block_end(text: str, a: int, b: int) -> tuple[str, str]:
    """(form, shape) of the word at the end of a block, as of the one before a site."""
    tail = text[max(a, b - 4) : b]
    script = "Thai" if _is_unmarked(text, a, b) else "Hani" if any(c in FULL_STOPS for c in tail) or _HAN.search(tail) else "Latn"
    if re.search(r"[^\S\n][»›]$", text[max(a, b - 2) : b]):
        return _left(_ending(text, max(a, b - 200), b - 2) + text[b - 1], script)
    return _left(_ending(text, max(a, b - 200), b), script)


def read_layout(numbers: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(start, end, kind, sites) of each block of a layout."""
    at = 0
    while at < len(numbers):
        a, b, kind, n = numbers[at : at + 4].tolist()
        yield a, b, kind, numbers[at + 4 : at + 4 + n * WIDTH].reshape(n, WIDTH)
        at += 4 + n * WIDTH


def _bucket(c: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, what tells its n-grams apart, from 1) of hashes."""
    h = hashes.astype(np.int64) & 0xFFFFFFFF
    return h % SIZES[c], (h // SIZES[c] + 1).astype(np.int32)


class Counts:
    """Dense tables of counts: at sites, at starts and ends of blocks, of all words, and the events expected at sites.

    A bucket belongs to its most frequent n-gram, and only that is counted; the others of the bucket count as unknown and are judged by
    shorter histories and by their shape.
    """

    def __init__(self):
        wide = {START: (RIGHT, RIGHT_SHAPE, FOLDED), SEEN: (RIGHT, RIGHT_SHAPE, FOLDED), STOP: (LEFT, LEFT_SHAPE, WORD), SITE_COUNT: tuple(SIZES), EVENT: tuple(SIZES)}
        self.tables = {(c, kind): np.zeros(SIZES[c], np.float32) for kind, cs in wide.items() for c in cs}
        self.owner = {c: np.zeros(n, np.int32) for c, n in SIZES.items()}
        self.shape_of = np.zeros(ONE, np.int32)  # of each left word's bucket, the bucket of its shape

    def put(self, rows: pd.DataFrame) -> None:
        """rows: c, h of the bucket's n-gram, shape and a column for each kind of count."""
        for c, g in rows.groupby("c"):
            at, mark = _bucket(c, g["h"].to_numpy())
            self.owner[c][at] = mark
            for kind in (SITE_COUNT, START, STOP, SEEN):
                if (c, kind) in self.tables:
                    self.tables[c, kind][at] = g[f"n{kind}"].to_numpy()
            if c == LEFT:
                self.shape_of[at] = _bucket(LEFT_SHAPE, g["shape"].fillna(0).to_numpy())[0]

    def put_events(self, rows: pd.DataFrame) -> None:
        for c in SIZES:
            self.tables[c, EVENT][:] = 0
        for c, g in rows.groupby("c"):
            self.tables[c, EVENT][g["slot"].to_numpy()] = g["n"].to_numpy()


class Model:
    """Probabilities of events and words from counts; arrays by slot."""

    def __init__(self, counts: Counts, anchor: float = 3.0, known: float = 2.0, pair: float = 20.0):
        t, self.owner = counts.tables, counts.owner
        small = np.float32(1e-6)

        n, e, got = t[LEFT, SITE_COUNT], t[LEFT, STOP], t[LEFT, EVENT]
        self.has_events = bool(got.any())
        ends = float(e.sum())
        share = ends / ((ends + float(n[e > 0.1 * n].sum())) or 1.0)  # of the boundaries, those that end a block

        def chance(n: np.ndarray, e: np.ndarray, got: np.ndarray, prior) -> np.ndarray:
            """P(event | word) from sites, block ends and expected events, held near what the ends of blocks show."""
            hidden = np.minimum(e * (1 - share) / max(share, 1e-3), n)
            k = known * known / (known + n)  # what is expected of the shape fades with the word's own sites
            first = (hidden + k * prior) / (n + k)
            now = (got + k * prior) / (n + k) if self.has_events else first
            odds, held = now / np.maximum(1 - now, small), first / np.maximum(1 - first, small)
            odds = np.clip(odds, held / anchor, held * anchor)
            return (odds / (1 + odds)).astype(np.float32)

        # a word that is rare is judged by the rare words of its shape, and by all of the shape, each counted once
        often = np.flatnonzero((n + e >= 5) & (n > 0))
        of = lambda at, w=None: np.bincount(counts.shape_of[at], weights=None if w is None else w[at], minlength=SHAPES)
        n_rare, e_rare, got_rare = (np.maximum(t[LEFT_SHAPE, kind] - of(often, x), 0) for kind, x in ((SITE_COUNT, n), (STOP, e), (EVENT, got)))
        by_rare = chance(n_rare, e_rare, got_rare, 0.3)
        kinds = of(often)
        means = of(often, chance(n, e, got, 0.3)) / np.maximum(kinds, 1)
        weight = 50.0 * (kinds > 0)
        self.by_shape = ((n_rare * by_rare + weight * means + 0.15) / (n_rare + weight + 0.5)).astype(np.float32)
        self.left = chance(n, e, got, self.by_shape[counts.shape_of])
        self.left_n = n
        self.pair_n, self.pair_s, self.pair = t[PAIR, SITE_COUNT], t[PAIR, EVENT], pair

        def ratio(c: int, prior) -> tuple[np.ndarray, float]:
            """P(word | event) / P(word | none) by the odds of beginning a sentence."""
            started, found = t[c, START], t[c, EVENT]
            event = started + np.minimum(found, (anchor - 1) * started)
            none = np.maximum(t[c, SEEN] - found, 0)
            rho = (event + known * prior) / (event + none + known)
            base = float(none.sum() / max(event.sum(), 1.0))
            return (rho / np.maximum(1 - rho, small) * base).astype(np.float32), float(event.sum() / max(event.sum() + none.sum(), 1.0))

        start = t[RIGHT, START].sum() / max(t[RIGHT, SEEN].sum() + t[RIGHT, START].sum(), 1.0)
        self.right_shape, _ = ratio(RIGHT_SHAPE, start)
        self.event_r = t[RIGHT, START] + np.minimum(t[RIGHT, EVENT], (anchor - 1) * t[RIGHT, START])
        self.none_r = np.maximum(t[RIGHT, SEEN] - t[RIGHT, EVENT], 0)
        self.base = float(self.none_r.sum() / max(self.event_r.sum(), 1.0))
        self.known = known
        self.none_all = max(float(self.none_r.sum()), 1.0)
        self.none_shape = np.maximum(t[RIGHT_SHAPE, SEEN] - t[RIGHT_SHAPE, EVENT], 0)
        self.none_b = np.maximum(t[BIGRAM, SITE_COUNT] - t[BIGRAM, EVENT], 0)
        self.none_bs = np.maximum(t[BIGRAM_SHAPE, SITE_COUNT] - t[BIGRAM_SHAPE, EVENT], 0)
        self.none_l = np.maximum(n - t[LEFT, EVENT], 0)
        # blocks without marks: the words that end and begin sentences once marks are left out
        words = t[FOLDED, SEEN] + t[FOLDED, START]
        ended = t[WORD, EVENT] + t[WORD, STOP]
        self.rate = rate = float(ended.sum() / max(words.sum(), 1.0)) or 1e-3
        self.ending = ((ended + known * rate) / (np.maximum(words, ended) + known)).astype(np.float32)
        began = t[FOLDED, START] + t[FOLDED, EVENT]
        rho = (began + known * rate) / (np.maximum(words, began) + known)
        self.beginning = (rho / np.maximum(1 - rho, small) * (1 - rate) / rate).astype(np.float32)
        self.single = 0.02  # of the sentences, those of one word

    def at(self, x: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, 1.0 where it belongs to the n-gram) in column c of sites x."""
        slot, mark = _bucket(c, x[:, c])
        return slot, (self.owner[c][slot] == mark).astype(np.float32)

    def steps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(event) after no event, P(event) after an event, P(right | event) / P(right | none, left)) of the sites x of marked blocks."""
        (left, own_l), (shape, _), (pair, own_p), (right, own_r), (right_shape, _) = (self.at(x, c) for c in (LEFT, LEFT_SHAPE, PAIR, RIGHT, RIGHT_SHAPE))
        n = self.left_n[left] * own_l
        k = self.known * self.known / (self.known + n)
        one = (n * self.left[left] + k * self.by_shape[shape]) / (n + k)
        two = (self.pair_s[pair] * own_p + self.pair * one) / (self.pair_n[pair] * own_p + self.pair) if self.has_events else one
        odds, alone = two / np.maximum(1 - two, 1e-6), one / np.maximum(1 - one, 1e-6)
        odds = np.clip(odds, alone / 10, alone * 10)  # the longer history moves the shorter one, within a factor
        two = odds / (1 + odds)
        # a word's own place is one of its places
        e, none = self.event_r[right] * own_r, np.maximum(self.none_r[right] * own_r - 1, 0)
        shaped = self.right_shape[right_shape] / self.base
        prior = shaped / (1 + shaped)
        rho = (e + self.known * prior) / (e + none + self.known)
        weight = rho / np.maximum(1 - rho, 1e-6) * self.base
        # P(right | none, left) / P(right | none): the pair itself and the pair with the shape of the right word
        (bigram, own_b), (shaped_pair, own_s) = self.at(x, BIGRAM), self.at(x, BIGRAM_SHAPE)
        calm = self.none_l[left] * own_l
        p = (none + 0.5) / self.none_all
        ps = np.maximum((self.none_shape[right_shape] + 0.5) / self.none_all, p)
        shape_given = (self.none_bs[shaped_pair] * own_s + 20 * ps) / (calm + 20)
        word_given = 0.3 * self.none_b[bigram] * own_b / np.maximum(calm, 1) + 0.7 * shape_given * p / ps
        trust = calm / (calm + 20) if self.has_events else 0.0
        weight = weight / np.clip(1 - trust + trust * word_given / p, 0.5, 4.0)
        opened = np.where(x[:, FIRST] == 2, two, np.minimum(two, one))
        return two, opened, weight

    def open_steps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same between the words of a block without marks."""
        (word, own_w), (folded, own_f) = self.at(x, WORD), self.at(x, FOLDED)
        p = np.where(own_w > 0, self.ending[word], self.rate)
        return p, p * self.single, np.where(own_f > 0, self.beginning[folded], 1.0)

    def transitions(self, x: np.ndarray, kind: int) -> tuple[list[float], list[float], list[float]]:
        """(P(event) after no event, after an event, weight of an event) at each of the sites x, which may be those of many blocks."""
        zero, one, weight = self.open_steps(x) if kind == OPEN else self.steps(x)
        # the event before reaches into the history of two only where a single word lies between
        return zero.tolist(), (one if kind == OPEN else np.where(x[:, FIRST] > 0, one, zero)).tolist(), weight.tolist()

    def posteriors(self, x: np.ndarray, kind: int) -> list[float]:
        return forward_backward(*self.transitions(x, kind)) if len(x) else []


def forward_backward(zero: list[float], one: list[float], weight: list[float]) -> list[float]:
    """P(boundary at each site | block); the state is the event at the site."""
    forward, now = [], None
    for p0, p1, w in zip(zero, one, weight):
        n0, n1 = (1 - p0, p0) if now is None else (now[0] * (1 - p0) + now[1] * (1 - p1), now[0] * p0 + now[1] * p1)
        n1 *= w
        total = n0 + n1 or 1.0
        now = (n0 / total, n1 / total)
        forward.append(now)
    back, out = (1.0, 1.0), [0.0] * len(zero)
    for i in range(len(zero) - 1, -1, -1):
        a, b = forward[i][0] * back[0], forward[i][1] * back[1]
        out[i] = b / (a + b) if a + b else 0.0
        p0, p1, w = zero[i], one[i], weight[i]
        back = ((1 - p0) * back[0] + p0 * w * back[1], (1 - p1) * back[0] + p1 * w * back[1])
        total = back[0] + back[1] or 1.0
        back = (back[0] / total, back[1] / total)
    return out


def lay_out(documents: DataFrame, doc_id: str, text: str, keep_text: bool) -> DataFrame:
    """One row per document with its layout, and rows of counts; materialised, as training and splitting read it."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: dict[tuple[int, int, int], int] = defaultdict(int)
        words: Counter = Counter()
        for f in frames:
            made = []
            for t in f["__text"]:
                made.append(layout(t, tally, words).tobytes())
                if len(words) > 200_000:
                    count_words(words, tally)
            yield pd.DataFrame({"doc": f["__doc"], "text": f["__text"].astype(object) if keep_text else None, "layout": pd.Series(made, dtype=object), "c": -1, "h": -1, "kind": -1, "n": 0})
            if len(tally) > 1_000_000:
                yield _counted(tally)
                tally.clear()
        count_words(words, tally)
        if tally:
            yield _counted(tally)

    usable = documents.where(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text"))
    return cut(usable.mapInPandas(scan, f"doc {kind}, text string, layout binary, c int, h int, kind int, n bigint"))


def _counted(tally: dict[tuple[int, int, int], int]) -> pd.DataFrame:
    c, h, kind = (np.array([k[i] for k in tally], np.int32) for i in range(3))
    return pd.DataFrame({"doc": None, "text": None, "layout": None, "c": c, "h": h, "kind": kind, "n": np.fromiter(tally.values(), np.int64, len(tally))})


def train(laid: DataFrame, rounds: int = 5, least: int = 2) -> Model:
    """A model from laid-out documents. What reaches the driver are sums by bucket, whose number doesn't depend on the documents.

    n-grams that occur less than least times in all documents are left to shorter histories and shapes.
    """
    spark = laid.sparkSession
    texts, counted = laid.where("layout is not null").select("layout"), laid.where("layout is null")

    def marked(frame: pd.DataFrame) -> np.ndarray:
        parts = [x for raw in frame["layout"] for _, _, kind, x in read_layout(np.frombuffer(raw, np.int32)) if kind == TEXT and len(x)]
        return np.concatenate(parts) if parts else np.empty((0, WIDTH), np.int32)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = marked(f)
            for c in SIZES if len(x) else ():
                h, first, n = np.unique(x[:, c], return_index=True, return_counts=True)
                yield pd.DataFrame({"c": c, "h": h, "kind": SITE_COUNT, "n": n, "shape": x[first, LEFT_SHAPE] if c == LEFT else 0})

    kinds = (SITE_COUNT, START, STOP, SEEN)
    sums = texts.mapInPandas(count, "c int, h int, kind int, n bigint, shape int").unionByName(counted.select("c", "h", "kind", "n", F.lit(None).cast("int").alias("shape")))
    rare = F.col("total") < F.when(F.col("c").isin(LEFT_SHAPE, RIGHT_SHAPE), 0).otherwise(least)
    each = sums.groupBy("c", "h").agg(F.max("shape").alias("shape"), F.sum("n").alias("total"), *(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in kinds)).where(~rare)
    size = F.element_at(F.create_map(*(F.lit(x) for pair in SIZES.items() for x in pair)), F.col("c"))
    slot = F.pmod(F.col("h").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)), size)
    owners = each.groupBy("c", slot.alias("slot")).agg(F.max(F.struct("total", "h", "shape", *(f"n{k}" for k in kinds))).alias("o")).select("c", "o.*")
    counts = Counts()
    counts.put(owners.toArrow().to_pandas())  # at most as many rows as the tables have buckets
    for _ in range(rounds):
        known = spark.sparkContext.broadcast(Model(counts))

        def expect(frames: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            model = known.value
            for f in frames:
                x = marked(f)
                if not len(x):
                    continue
                p, _, w = model.steps(x)
                g = p * w / (p * w + 1 - p)
                for c in SIZES:
                    at, own = model.at(x, c)
                    slots, back = np.unique(at, return_inverse=True)
                    yield pd.DataFrame({"c": c, "slot": slots, "n": np.bincount(back, weights=g * own)})

        counts.put_events(texts.mapInPandas(expect, "c int, slot int, n double").groupBy("c", "slot").agg(F.sum("n").alias("n")).toArrow().to_pandas())
        known.destroy()
    return Model(counts)


def units_of(layouts: list[np.ndarray], model: Model, threshold: float = 0.5) -> Iterator[list[tuple[int, int]]]:
    """(start, end) of each unit of each laid-out text, in order; every character of a block that isn't white space lies in exactly one.

    The model is applied to the sites of all texts at once, and then block by block.
    """
    read = [list(read_layout(numbers)) for numbers in layouts]
    ready = {}
    for kind in (TEXT, OPEN):
        parts = [x for blocks in read for _, _, k, x in blocks if k == kind and len(x)]
        if parts:
            x = np.concatenate(parts)
            ready[kind] = (*model.transitions(x, kind), x[:, END].tolist(), x[:, NEXT].tolist())
    done = {TEXT: 0, OPEN: 0}
    for blocks in read:
        out = []
        for a, b, kind, x in blocks:
            at = a
            if len(x):
                start = done[kind]
                done[kind] = stop = start + len(x)
                zero, one, weight, ends, begins = (v[start:stop] for v in ready[kind])
                for end, begin, p in zip(ends, begins, forward_backward(zero, one, weight)):
                    if p > threshold:
                        out.append((at, end))
                        at = begin
            if at < b:
                out.append((at, b))
        yield out


def units(text: str, model: Model, threshold: float = 0.5) -> list[tuple[int, int]]:
    """units_of a text."""
    return next(units_of([layout(text, defaultdict(int), Counter())], model, threshold))


def split_sentences(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None, with_text: bool = True) -> DataFrame:
    """(doc_id, unit_no, start_pos, end_pos, sentence): one row per unit, positions in code points, end_pos behind the last character.

    Null, empty and blank texts have no units; a text without any mark is split where the model finds boundaries between its words.
    Each document row is split by itself, so repeated rows give repeated units. Whole texts are read, however long. An empty table trains
    an empty model and gives no rows. Other columns play no part. Without a model, one is trained on the documents. with_text=False leaves
    the column sentence out.
    """
    laid = lay_out(documents, doc_id, text, with_text)
    known = documents.sparkSession.sparkContext.broadcast(model or train(laid))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for f in (whole.iloc[i : i + 500] for i in range(0, len(whole), 500)):  # texts may be long
                found = list(units_of([np.frombuffer(raw, np.int32) for raw in f["layout"]], known.value))
                rows = [(d, n, a, b) for d, spans in zip(f["doc"], found) for n, (a, b) in enumerate(spans)]
                out = pd.DataFrame(rows, columns=[doc_id, "unit_no", "start_pos", "end_pos"])
                if with_text:
                    out["sentence"] = pd.Series([t[a:b] for t, spans in zip(f["text"], found) for a, b in spans], dtype=object)
                yield out

    kind = documents.schema[doc_id].dataType.simpleString()
    columns = f"{doc_id} {kind}, unit_no int, start_pos bigint, end_pos bigint" + (", sentence string" if with_text else "")
    return laid.where("layout is not null").select("doc", "text", "layout").mapInPandas(scan, columns)
