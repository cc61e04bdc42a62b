"""Garbled text from wrong character encodings: find it and restore it.

A wrongly decoded text is a substitution cipher: each character (or short run of them) stands for a letter. Which cipher it is,
is hidden, and so are the letters; expectation-maximization learns both for each source against the bigrams of the corpus:

1. One pass over all texts, whole, counts the character bigrams of the corpus. 2. A second one scores every token that holds
characters of single-byte pages, if its bigrams surprise: by every pair of the code pages that Python has (``PAGES``, by rule)
and by UTF-8 read in each of them. The pages are only where the ciphers start. Documents in which any start gains, with all the
starts that do, or which hold surprising tokens that none explains, go on. 3. E-step: a document belongs to a cipher by its gain and the cipher's weight
in its source; within a cipher the letter of each character has a posterior from the cipher's table and from its neighbours.
M-step: the weights, and each table of byte-to-letter probabilities, are the expected counts over the token types of the source,
smoothed by the start. A letter that comes out likelier than the start's replaces it in the next E-step. Beside the ciphers
that start from pages each source has one that starts from nothing (``FREE``), learnt from what no page explains.
4. A document is a case if gain plus log weight of its best cipher is enough, under the learnt tables; a cipher that a source
hardly knows must so gain more. Ciphers of equal gain in it count together. 5. The best cipher is undone by ``translate`` with the learnt table, then every other one that
gains in what is left.

Japanese read in multi-byte pages (and its shift codes in single-byte ones) is no substitution of letters: whole runs are
decoded again (``CJK``). A replacement character is a cipher character too, whose letter can't be one for all: a loss is likely
where any letter fits its neighbours better than a character that no language has; standing alone it shows nothing, except between numbers. One or
two of them get the letters that their neighbours make likely, others stay.

Scale: bigram counts are bounded by the alphabet classes and combined per task before they are shuffled; only documents with
surprising tokens (a few per cent) go on. Weights stay a table, joined by source and cipher; of the letter tables only what
differs from the start is collected, at most ``TABLE_ROWS`` entries with the most evidence (others keep the start).

Defined results: null and empty texts are no cases; a repeated id counts once; a mention in quotation marks (the neighbours
would have been garbled too) is no case; a null source is a source of its own.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from encodings.aliases import aliases
from functools import lru_cache
from itertools import compress
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetweave.session import checkpointed

CJK = [("cp932", "cp1252"), ("euc_jp", "cp1252"), ("utf-8", "cp932"), ("euc_jp", "cp932"), ("utf-8", "euc_jp"), ("cp932", "euc_jp"), ("cp932", "cp437"), ("euc_jp", "cp437"), ("cp932", "mac_roman"), ("euc_jp", "mac_roman")]
LOST, FREE = "lost", "free"
#: Gain that counts as evidence; score (gain and log weight) of a case; gain and letters that a cipher without a page needs, and the contexts that show a letter of it.
LEAST_GAIN, LEAST_SCORE, FREE_GAIN, FREE_LETTERS, FREE_TYPES = 3.0, 0.0, 8.0, 3, 1.5
#: Distinct tokens and runs whose gains a task keeps, and characters of a string whose score it keeps.
CACHE, SHORT = 20_000, 64
#: Characters of texts that are looked through in one go.
CHARS = 1_000_000
#: A token surprises whose transitions around characters beyond ASCII cost more than this on average (nats); what only a cipher
#: without a page may explain surprises so much.
SURPRISE, FREE_SURPRISE = 3.0, 4.5
#: Share of a start's letter in its table, and how many observations the start counts for.
START_SHARE, START_COUNT = 0.9, 5.0
TABLE_ROWS = 100_000
#: Log weight of a cipher that no document has gone through.
UNKNOWN = -8.0


@lru_cache(1)
def pages() -> dict[str, tuple[str, ...]]:
    """Every single-byte page that keeps ASCII: its upper half; undefined bytes were read as controls. Pages that many texts come in stand first."""
    first = ["cp1252", "mac_roman", "cp1251", "cp437", "cp850", "koi8_r", "cp866"]
    out: dict[str, tuple[str, ...]] = {}
    for name in dict.fromkeys([*first, *sorted(set(aliases.values()))]):
        try:
            if bytes(range(128)).decode(name) != "".join(map(chr, range(128))):
                continue
            upper = [bytes([b]).decode(name, "replace") for b in range(128, 256)]
            if bytes([0xC4, 0xC5]).decode(name, "replace") != upper[0x44] + upper[0x45]:
                continue  # bytes that join
        except (LookupError, UnicodeError):
            continue
        if all(len(c) == 1 for c in upper) and sum(c == "\ufffd" for c in upper) < 100 and not {"ｱ", ""} & set(upper):
            t = tuple(chr(b) if c == "\ufffd" else c for b, c in enumerate(upper, 128))
            if t not in out.values():
                out[name] = t
    return out


_SIGNS = set("°±µ×–—’‘“”„«»¿¡…§·№\xa0²³½¼€†•™®©")
#: Letters and signs that an undone swap may give.
_KNOWN = re.compile(r"[\x20-ɏΑ-ωЁА-яё‐-⁄€℃№™←-⋿■-◿　-ヿ一-鿿！-￦\n\r\t\x80-\x9f]*\Z")
_SEQ = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_QUOTES = set("“”„«»‘’'\"「」『』‚‹›")
_MENTION = _QUOTES | set("()[]{}<>")

# ---- bigrams over classes of characters ----
_BLOCKS = [(0x00, 0x180), (0x391, 0x3CA), (0x400, 0x460), (0x2010, 0x2045), (0x2500, 0x25A0), (0x3000, 0x3100), (0xFF00, 0xFFF0)]


@lru_cache(1)
def class_table() -> tuple[np.ndarray, int]:
    """Code point -> class: characters of the alphabets each, digits and large sets together."""
    lut, n = np.zeros(0x110000, dtype=np.int32), 1
    for lo, hi in _BLOCKS:
        lut[lo:hi] = np.arange(n, n + hi - lo)
        n += hi - lo
    lut[0x30:0x3A] = lut[0x30]
    for lo, hi in ((0x4E00, 0xA000), (0xE000, 0xF900), (0x2200, 0x2300), (0x2100, 0x2200)):
        lut[lo:hi] = n
        n += 1
    for c in "縺繧繝縲□°":
        lut[ord(c)] = n
        n += 1
    lut[0xFFFD] = n
    return lut, n + 1


class Bigrams:
    """Log probabilities of neighbouring classes, and what has been scored with them so far."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.lut, self.k = class_table()
        self.tokens: dict[tuple[str, int, int, int, bool], Token] = {}
        self.seen: list[dict[str, Token]] = [{} for _ in range(12)]  # the same by the text as it stands, for each kind of token
        self.scores: dict[str, float] = {}
        self.runs: dict[tuple[str, str, str], list[tuple[int, float]]] = {}
        self.parts: dict[tuple[str, int, int], list[tuple[int, float]]] = {}  # runs of a token by the text as it stands
        m = np.zeros(self.k * self.k)
        if counts:
            m[np.fromiter(counts.keys(), dtype=np.int64)] = np.fromiter(counts.values(), dtype=np.float64)
        m = m.reshape(self.k, self.k)
        uni = m.sum(0)
        back = (uni + 0.5) / (uni.sum() + 0.5 * self.k)
        self.logp = np.log((m + 4.0 * back[None, :]) / (m.sum(1, keepdims=True) + 4.0)).astype(np.float32)
        # letters and signs beyond ASCII, the candidates of hidden letters; a class of several characters can't be written
        cs = [c for lo, hi in _BLOCKS for c in map(chr, range(max(lo, 0xA1), hi)) if c.isalpha() or c in _SIGNS]
        self.letters = np.array(cs)
        self.letter_ids = self.lut[[ord(c) for c in cs]]
        n = uni[self.letter_ids] + 0.01
        self.base = n / n.sum()
        self.alpha = np.array([c.isalpha() for c in cs])
        lost = self.lut[0xFFFD]
        self.never = float(np.log(0.5 / (uni.sum() + 0.5 * self.k)))  # of a character that no language has
        self.filled = np.append(self.letter_ids, [self.lut[0x4E00]])
        self.lost_id = lost

    def ids(self, s: str) -> np.ndarray:
        return self.lut[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]

    def score(self, s: str) -> float:
        hit = self.scores.get(s)
        if hit is None:
            i = self.ids(s)
            hit = float(self.logp[i[:-1], i[1:]].sum()) if len(i) > 1 else 0.0
            if len(s) <= SHORT:
                if len(self.scores) > 10 * CACHE:
                    self.scores.clear()
                self.scores[s] = hit
        return hit

    def posterior(self, a: str, b: str, prior: np.ndarray) -> np.ndarray:
        """Of each candidate letter between two neighbours."""
        p = np.log(prior + 1e-12)
        if a:
            p = p + self.logp[self.lut[ord(a)], self.letter_ids]
        if b:
            p = p + self.logp[self.letter_ids, self.lut[ord(b)]]
        e = np.exp(p - p.max())
        return e / e.sum()


# ---- ciphers of code pages ----
@lru_cache(None)
def to_bytes(wrong: str) -> dict[int, str]:
    """Garbled character -> its byte, written as the character of that number."""
    t = {b: "\uffff" for b in range(0x80, 0x100)} | {ord(c): chr(b) for b, c in enumerate(pages()[wrong], 128)}
    if wrong == "cp1252":
        t |= {b: chr(b) for b in range(0x80, 0xA0)}
    undefined = [b for b in range(0x80, 0x100) if bytes([b]).decode(wrong, "replace") == "\ufffd"]
    if len(undefined) == 1:
        t[0xFFFD] = chr(undefined[0])  # the only byte that the page loses
    return t


def _is_letter(c: str) -> bool:
    return c.isalpha() or c in _SIGNS


@lru_cache(None)
def letters(true: str, wrong: str) -> dict[int, str]:
    """Single-byte start: garbled character -> letter, where they differ."""
    upper = pages()[true]
    t = {c: upper[ord(b) - 128] for c, b in to_bytes(wrong).items() if b != "\uffff" and c != 0xFFFD}
    return {c: x for c, x in t.items() if x != chr(c) and _is_letter(x)}


@lru_cache(None)
def stuck(true: str, wrong: str) -> frozenset[str]:
    """Letters of the wrong page whose bytes are no letters or signs in the true one: no word holds them that went through the swap."""
    upper = pages()[true]
    same = {c for c, b in to_bytes(wrong).items() if b != "\uffff" and upper[ord(b) - 128] == chr(c)}
    return frozenset(chr(c) for c, b in to_bytes(wrong).items() if b != "\uffff" and chr(c).isalpha() and c not in same and c not in letters(true, wrong))


class _Page(dict):
    """Translation table of a code page: ASCII stays, what the page doesn't have becomes a non-character."""

    def __init__(self, wrong: str) -> None:
        super().__init__({c: chr(c) for c in range(0x80)} | to_bytes(wrong))

    def __missing__(self, c: int) -> str:
        self[c] = "\uffff"
        return "\uffff"


@lru_cache(None)
def _page(wrong: str) -> _Page:
    return _Page(wrong)


def _as_bytes(text: str, wrong: str) -> str:
    return text.translate(_page(wrong))


@lru_cache(1)
def _images() -> str:
    """Characters that bytes from 0x80 on become in any page."""
    return "".join(map(chr, sorted({c for w in pages() for c, b in to_bytes(w).items() if b != "\uffff"})))


@lru_cache(1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """Runs of such characters, and the tokens around them (cut at Japanese)."""
    rest = f"[^{_BREAK}]"
    return re.compile(f"[{re.escape(_images())}]+"), re.compile(rf"{rest}*(?![\x00-\x7f]){rest}+")


#: White space (no-break spaces are images of bytes, so they don't part tokens) and Japanese.
_BREAK = r"\x00\t-\r\x1c-\x20\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000-\u30ff\u4e00-\u9fff\uff00-\uffef"


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Code point -> 0 between tokens, 1 ASCII letters and digits, 2 beyond ASCII, 3 other ASCII."""
    kind = np.full(0x110000, 2, dtype=np.uint8)
    kind[:0x80] = [1 if chr(c).isalnum() else 3 for c in range(0x80)]
    for m in re.finditer(f"[{_BREAK}]+", "".join(map(chr, range(0x10000)))):
        kind[m.start() : m.end()] = 0
    return kind


@lru_cache(None)
def _look(c: str) -> int:
    """One number for characters that are compatible, as the two spellings of micro."""
    return ord(unicodedata.normalize("NFKC", c)[0]) if c != "\xa0" else 0xA0


class Starts:
    """All pairs of pages as arrays, to score a token by each of them at once."""

    def __init__(self, lm: Bigrams) -> None:
        names = list(pages())
        self.index = {c: i for i, c in enumerate(_images())}
        self.byte = np.zeros((len(names), len(self.index)), dtype=np.int16)
        self.clas = np.full((len(names), 256), -1, dtype=np.int32)
        self.letter = np.zeros((len(names), 256), dtype=bool)
        self.look = np.full((len(names), 256), -1, dtype=np.int32)
        for k, w in enumerate(names):
            for c, b in to_bytes(w).items():
                if b != "\uffff" and c != 0xFFFD:
                    self.byte[k, self.index[chr(c)]] = ord(b)
            for b, c in enumerate(pages()[w], 128):
                if _is_letter(c):
                    self.clas[k, b], self.letter[k, b], self.look[k, b] = lm.lut[ord(c)], c.isalpha(), _look(c)
        self.clas, self.letter, self.look = (np.ascontiguousarray(x.T) for x in (self.clas, self.letter, self.look))  # byte, page
        self.space = lm.lut[0xA0]
        own = [set(pages()[t]) for t in names]
        self.has = np.array([[c in x for x in own] for c in self.index])  # character, true page that has it
        n = len(names)
        self.pages = names
        self.names = [f"{t}>{w}" for t in names for w in names]
        rank = np.add.outer(np.arange(n), np.arange(n)).ravel()
        self.order = np.lexsort((np.arange(n * n), rank))
        self.rank = np.empty(n * n, dtype=np.int64)
        self.rank[self.order] = np.arange(n * n)
        self.n = n


_DIGITS = re.compile("[0-9]")
#: Gain of a token that can't have gone through a cipher: it ends a stretch.
NEVER = -1e4


class Token:
    """The gains of a token under all pairs of pages: a row per true page, a column per group of wrong pages with the same bytes."""

    __slots__ = ("gain", "group", "top")

    def __init__(self, gain: np.ndarray, group: np.ndarray) -> None:
        self.gain, self.group = gain, group
        self.top = max(0.0, float(gain.max()))

    def of(self, pairs: np.ndarray, n: int) -> np.ndarray:
        return self.gain[pairs // n, self.group[pairs % n]]


Span = tuple[int, int, float, int, int, int]


class Spans(NamedTuple):
    """The tokens of a text with characters beyond ASCII: all of them, those that surprise, and those with two such characters together."""

    all: list[Span]
    odd: list[Span]
    joined: list[Span]


@lru_cache(1)
def _digits_and_spaces() -> np.ndarray:
    """Code point -> 1 white space, 2 digit (neither is beyond the first two planes)."""
    kind = np.zeros(0x110000, dtype=np.uint8)
    kind[:0x20000] = [2 if chr(c).isdigit() else chr(c).isspace() for c in range(0x20000)]
    return kind


def _numbers(cp: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether the two characters from a place on, as far as they lie in their text, are digits but for white space around them."""
    x, y = (np.where((i >= lo) & (i < hi), _digits_and_spaces()[cp[np.clip(i, 0, len(cp) - 1)]], 1) for i in (at, at + 1))
    return (x > 0) & (y > 0) & (x + y > 2)


def tokens_of(texts: list[str], lm: Bigrams) -> list[Spans | None]:
    """Of each text the tokens with characters beyond ASCII, if any of them surprises or has two together, all in one go.

    Start, end, surprise (what the transitions around such characters cost on average), the range from the neighbour before the
    first such character to the one after the last, and the kind: the number of ASCII letters and digits (2 for more), plus 3 if
    it has none and stands between numbers, plus 6 if there is a neighbour before.
    """
    cp = np.frombuffer(("\x00" + "\x00".join(texts) + "\x00").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _kinds()[cp]
    special, inside = kind == 2, kind > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    place = np.flatnonzero(special)
    owner = np.searchsorted(starts, place, "right") - 1
    at = np.flatnonzero(np.diff(owner, prepend=-1))
    own = owner[at]  # tokens with such characters; their columns from here on
    size = np.diff(at, append=len(place))
    nth = np.repeat(np.arange(len(own)), size)
    # transitions into and out of such characters, those between two of them once
    ids = lm.lut[cp[place]]
    last = np.append(place[1:] != place[:-1] + 1, True) if len(place) else np.zeros(0, dtype=bool)
    cost = -lm.logp[lm.lut[cp[place - 1]], ids]
    out_of = place[last]
    n = len(own)
    total = np.bincount(nth, cost, n) + np.bincount(nth[last], -lm.logp[ids[last], lm.lut[cp[out_of + 1]]], n)
    mean = total / (size + np.bincount(nth[last], minlength=n))
    alnum = np.cumsum(kind == 1, dtype=np.int32)
    s, e, head, tail = starts[own], ends[own], place[at], place[at + size - 1]
    limits = np.cumsum([1] + [len(t) + 1 for t in texts])
    edges = np.searchsorted(s, limits)
    off, end = (np.repeat(x, np.diff(edges)) for x in (limits[:-1], limits[1:] - 1))
    lo = head > off
    known = np.minimum(alnum[e - 1] - alnum[s - 1], 2)
    alone = np.flatnonzero(known == 0)
    number = np.zeros(n, dtype=np.int64)
    number[alone] = _numbers(cp, s[alone] - 2, off[alone], end[alone]) & _numbers(cp, e[alone], off[alone], end[alone])
    joined = np.zeros(n, dtype=bool)
    joined[nth[~last]] = True
    spans: list[Span] = list(zip(*(c.tolist() for c in (s - off, e - off, mean, head - lo - off, tail + 2 - off, known + 3 * number + 6 * lo))))
    edges = edges.tolist()
    odd, two = (mean > SURPRISE).tolist(), joined.tolist()
    out: list[Spans | None] = []
    for lo, hi in zip(edges, edges[1:]):
        own = spans[lo:hi]
        x = Spans(own, list(compress(own, odd[lo:hi])), list(compress(own, two[lo:hi])))
        out.append(x if x.odd or x.joined else None)
    return out


def token_gains(ring: str, lo: int, hi: int, known: int, number: bool, lm: Bigrams, st: Starts) -> Token:
    """What each pair of pages gains in a token; a loss where it makes it less likely.

    ``ring[lo:hi]`` is the token from its first to its last character beyond ASCII, with its neighbours; ``known`` says how many ASCII
    letters and digits it has (2 for more), ``number`` whether it stands between numbers.
    """
    special = [i for i in range(lo, hi) if ring[i] > "\x7f" and ring[i] != "\ufffd"]
    if not special:
        return Token(np.zeros((st.n, 1), dtype=np.float32), np.zeros(st.n, dtype=np.int64))  # losses say nothing about a page
    at = [st.index.get(ring[i], -1) for i in special]
    if min(at) < 0:
        return Token(np.where(st.has[[x for x in at if x >= 0]].any(0), NEVER, 0.0).astype(np.float32)[:, None], np.zeros(st.n, dtype=np.int64))
    where: dict[bytes, int] = {}
    cols = st.byte[:, at]
    raw, step = cols.tobytes(), cols.itemsize * len(at)
    group = np.array([where.setdefault(raw[i : i + step], len(where)) for i in range(0, len(raw), step)])
    b = np.frombuffer(b"".join(where), dtype=cols.dtype).reshape(-1, len(at)).T
    ids = lm.ids(ring)
    place = {i: j for j, i in enumerate(special)}
    new = st.clas[b]  # special character, group, true page
    was = ids[special][:, None, None]
    inner = [place[i] for i in special if 0 < i < len(ring) - 1 and ring[i - 1].isalnum() and ring[i + 1].isalnum()]
    # what the true page doesn't have can't have gone through it and may stand as it is
    image = (b > 0)[:, :, None] & (new >= 0)
    stays = ~image & ~st.has[at][:, None, :]
    ok = (image | stays).all(0)
    if inner:
        ok &= (new[inner] != st.space).all(0)
    same = (st.look[b] == np.array([_look(ring[i]) for i in special])[:, None, None]) | stays
    new = np.where(stays, was, np.maximum(new, 0))
    d = np.zeros(new.shape[1:], dtype=np.float32)
    for i in sorted({k for x in special for k in (x - 1, x) if 0 <= k < len(ring) - 1}):
        x, y = ids[i], ids[i + 1]
        if i not in place:
            to = lm.logp[x].take(new[place[i + 1]])
        elif i + 1 not in place:
            to = lm.logp[:, y].take(new[place[i]])
        else:
            to = lm.logp.ravel().take(new[place[i]] * lm.k + new[place[i + 1]])
        d += to - lm.logp[x, y]
    letter = st.letter[b]
    idle = same.all(0)
    if known < 2:
        alone = known + letter.sum(0) < 2  # stands alone and shows nothing, except a sign between numbers
        idle |= alone & ((letter & ~same).any(0) | ((known == 0) & (not number)))
    if all(ring[i].isspace() for i in special):
        idle[:] = True
    return Token(np.where(ok, np.where(idle, np.minimum(d, 0.0), d), NEVER).T.astype(np.float32, order="C"), group)


def undo_utf8(text: str, wrong: str, lm: Bigrams) -> tuple[str, float, list[tuple[str, str, str, str]]]:
    """Every self-checking byte sequence put back; gain and (before, garbled, letter, after)."""
    raw = _as_bytes(text, wrong)
    out, last, gain, units = [], 0, 0.0, []
    groups: list[list[tuple[int, int]]] = []
    for m in _SEQ.finditer(raw):
        s = m.span()
        if groups and groups[-1][-1][1] == s[0]:
            groups[-1].append(s)
        else:
            groups.append([s])
    for g in groups:
        a, b = g[0][0], g[-1][1]
        if a and b < len(text) and text[a - 1] in _QUOTES and text[b] in _QUOTES and not text[a - 1].isascii() and not text[b].isascii():
            continue  # a mention: the quotation marks would have been garbled too
        try:
            good = raw[a:b].encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        if not _KNOWN.match(good):
            continue
        lo, hi = max(0, a - 1), min(len(text), b + 1)
        d = lm.score(text[lo:a] + good + text[b:hi]) - lm.score(text[lo:hi])
        if d <= 0:
            continue
        gain += d
        ring = text[lo:a] + good + text[b:hi]
        units += [(ring[i + (a > lo) - 1] if i + (a > lo) else "", text[s:e], good[i], ring[i + (a > lo) + 1 : i + (a > lo) + 2]) for i, (s, e) in enumerate(g)]
        out += [text[last:a], good]
        last = b
    return "".join(out) + text[last:], gain, units


def run_gains(before: str, run: str, after: str, lm: Bigrams, st: Starts) -> list[tuple[int, float]]:
    """Pages (by number) in which a run is UTF-8 that was read wrongly, with the gain.

    A run that went through the page is UTF-8 but for losses: at most a quarter of its letters is left over.
    """
    b = st.byte[:, [st.index[c] for c in run]]
    follows = (b >= 0x80) & (b < 0xC0)
    leads = (b >= 0xC2) & (b < 0xF5)
    leads[:, :-1] &= follows[:, 1:]
    leads[:, -1] = False
    seen: dict[str, float] = {}  # pages with the same bytes gain the same
    out = []
    for k in np.flatnonzero(leads.any(1) & (4 * (leads | follows).sum(1) >= 3 * len(run))).tolist():
        w = st.pages[k]
        raw = _as_bytes(run, w)
        if raw not in seen:
            rest = _SEQ.sub(lambda m: "\uffff" * len(m.group()), raw)
            whole = 4 * sum(c.isalpha() and x != "\uffff" for c, x in zip(run, rest)) <= len(run)
            seen[raw] = undo(before + run + after, f"utf-8>{w}", lm)[1] if whole else 0.0
        if seen[raw] > 0:
            out.append((k, seen[raw]))
    return out


def part_gains(ring: str, lo: int, hi: int, lm: Bigrams, st: Starts) -> list[tuple[int, float]]:
    """The same of all runs of a token: ``ring[lo:hi]`` from its first to its last character beyond ASCII, with its neighbours."""
    out = []
    for m in _patterns()[0].finditer(ring, lo, hi):
        i, j = m.span()
        if j - i > 1:
            key = _DIGITS.sub("0", ring[i - 1 : i] if i else ""), m.group(), _DIGITS.sub("0", ring[j : j + 1])
            got = lm.runs.get(key)
            if got is None:
                if len(lm.runs) > 10 * CACHE:
                    lm.runs.clear()
                got = lm.runs[key] = run_gains(*key, lm, st)
            out += got
    return out


def undo_single(text: str, table: dict[int, str], held: frozenset[str], lm: Bigrams) -> tuple[str, float, list[tuple[str, str, str, str]]]:
    """Tokens with characters of a cipher, translated where that makes them likelier: text, gain and (before, garbled, letter, after)."""
    found: list[tuple[int, int, str, float]] = []
    keys = table.keys()
    for m in _patterns()[1].finditer(text):
        w = m.group()
        a, b = m.span()
        new, d = w, 0.0
        if held.isdisjoint(w) and not keys.isdisjoint(map(ord, w)):
            new = w.translate(table)
            numbers = text[max(0, a - 2) : a].strip().isdigit() + text[b : b + 2].strip().isdigit()
            known = sum(c.isalnum() for c in new)
            if known < 2 and any(n.isalpha() for c, n in zip(w, new) if c != n) or known == 0 and numbers < 1 + any(c.isalnum() for c in w):
                new = w  # what stands alone shows nothing, except a sign beside numbers
            else:
                d = lm.score(text[max(0, a - 1) : a] + new + text[b : b + 1]) - lm.score(text[max(0, a - 1) : b + 1])
        found.append((a, b, new, d))
    out, last, gain, units = [], 0, 0.0, []
    for i, (a, b, new, d) in enumerate(found):
        w = text[a:b]
        if d <= 1.0:
            # a word that shows nothing by itself goes with its neighbours
            if 0 < i < len(found) - 1 and found[i - 1][3] > 1.0 and found[i + 1][3] > 1.0 and not keys.isdisjoint(map(ord, w)) and not _SIGNS.issuperset(w):
                out += [text[last:a], w.translate(table)]
                last = b
            continue
        gain += d
        ring = text[a - 1 : a] + new + text[b : b + 1]
        at = len(text[a - 1 : a])
        units += [(ring[j + at - 1] if j + at else "", c, n, ring[j + at + 1 : j + at + 2]) for j, (c, n) in enumerate(zip(w, new)) if c != n]
        out += [text[last:a], new]
        last = b
    if all(c.isspace() for _, c, _, _ in units):
        return text, 0.0, []  # no-break spaces alone show nothing
    return "".join(out) + text[last:], gain, units


# ---- Japanese ----
_JA = re.compile("[ぁ-んァ-ヶー一-鿿、。【】（）]")
_KANA = re.compile("[ぁ-んァ-ヶー、。（）]")
_HALF = re.compile("[･-ﾟ]")
_BADK = re.compile("[縺繧繝縲･-ﾟ\ue000-\uf8ff\ufffd\x80-\x9f]")
_HIGH = re.compile("[^\x00-\x7f]+")
#: What Japanese bytes look like in a page of Japanese.
_WIDE = re.compile("[縺繧繝縲･-ﾟ\ue000-\uf8ff\ufffd\x80-\x9f]")


def undo_cjk(text: str, true: str, wrong: str, lm: Bigrams) -> tuple[str, float]:
    """Runs that are whole byte sequences of the true encoding, and lines that read as Japanese in it, losses apart."""
    gain = 0.0

    def run(m: re.Match) -> str:
        nonlocal gain
        w = m.group()
        try:
            new = w.encode(wrong).decode(true)
        except UnicodeError:
            return w
        d = lm.score(text[m.start() - 1 : m.start()] + new + text[m.end() : m.end() + 1]) - lm.score(text[m.start() - 1 : m.start()] + w + text[m.end() : m.end() + 1])
        if len(new) < len(w) and d > 2.0 and _KNOWN.match(new) and not _BADK.search(new):
            gain += d
            return new
        return w

    if wrong in ("cp932", "euc_jp"):
        text = _HIGH.sub(run, text)
    out = []
    for line in text.splitlines(keepends=True):
        if not line.isascii():
            if wrong in ("cp932", "euc_jp"):
                raw = line.encode(wrong, "replace")
            else:
                raw = _as_bytes(line, wrong).replace("\uffff", "?").encode("latin-1", "replace")
            new = raw.decode(true, "replace")
            n, bad = len(_KANA.findall(new)), new.count("\ufffd") + len(_HALF.findall(new))
            if n >= 2 and bad * 4 <= len(_JA.findall(new)) and len(_BADK.findall(new)) * 3 < max(1, len(new)):
                d = lm.score(new) - lm.score(line)
                if d > 3.0:
                    gain += d
                    line = new
        out.append(line)
    return "".join(out), gain


@lru_cache(None)
def _torn(true: str, wrong: str) -> re.Pattern:
    """Two characters of a single-byte page whose bytes are a kana or a mark of punctuation."""
    image = {ord(b): chr(c) for c, b in to_bytes(wrong).items() if b != "\uffff"} | {b: chr(b) for b in range(0x80)}
    kana = [c for lo, hi in ((0x3041, 0x3094), (0x30A1, 0x30F7)) for c in map(chr, range(lo, hi))] + list("、。「」・ー（）")
    second: dict[str, str] = {}
    for c in kana:
        x, y = c.encode(true)
        second[image[x]] = second.get(image[x], "") + image[y]
    return re.compile("|".join(f"{re.escape(x)}[{re.escape(y)}]" for x, y in second.items()))


@lru_cache(None)
def _leads(true: str, wrong: str) -> str:
    """What the first bytes of kana look like."""
    image = {ord(b): chr(c) for c, b in to_bytes(wrong).items() if b != "\uffff"}
    return "".join(sorted({image[c.encode(true)[0]] for c in "あんアン、"}))


def _cjk_possible(text: str, true: str, wrong: str) -> bool:
    if wrong in ("cp932", "euc_jp"):
        return bool(_WIDE.search(text))
    for c in _leads(true, wrong):
        if c in text:
            break
    else:
        return False
    found = _torn(true, wrong).finditer(text)
    return next(found, None) is not None and next(found, None) is not None


# ---- losses ----
_MARKS = "°±µ×–—’“”«»"
_LOST_IN = {"latin": "äöüßéèêàçùâîôûáíóúñ¿¡ÄÖÜÉ" + _MARKS, "cyrillic": "".join(map(chr, range(0x410, 0x450))) + "ёЁ№" + _MARKS}
_LOSSES = re.compile("\ufffd+")
_BETWEEN_NUMBERS = re.compile(r"[0-9]\s?\ufffd\s?[0-9]")


def loss_gain(text: str, lm: Bigrams) -> float:
    """How much likelier the best letter makes each loss than a character that no language has."""
    gain = 0.0
    for m in _LOSSES.finditer(text):
        i, j = m.span()
        a, b = text[i - 1 : i], text[j : j + 1]
        alone = (not a or a.isspace() or a in _MENTION) and (not b or b.isspace() or b in _MENTION)
        if alone and not _BETWEEN_NUMBERS.match(text[max(0, i - 2) : j + 2].lstrip()):
            continue
        p = lm.logp[lm.lut[ord(a or " ")], lm.filled] + lm.logp[lm.filled, lm.lut[ord(b or " ")]]
        gain += max(0.0, float(p.max()) - lm.never - float(np.log(1 / lm.k)))
    return gain


def _script(around: str) -> str | None:
    """Script of the letters around a loss; none if it is mixed with Japanese or there are no letters."""
    n = Counter("latin" if c < "ɐ" else "cyrillic" if "Ѐ" <= c < "Ѡ" else "other" for c in around if c.isalpha())
    return None if not n or n["other"] else n.most_common(1)[0][0]


def fill_lost(text: str, lm: Bigrams) -> str:
    """One or two replacement characters by letters of the script around them, where these are likelier by their neighbours than all others together; else they stay."""
    out, last = [], 0
    for m in _LOSSES.finditer(text):
        i, j = m.span()
        script = _script(text[max(0, i - 12) : i] + text[j : j + 12])
        if j - i > 2 or script is None:
            continue
        cand = _LOST_IN[script]
        ids = lm.ids(cand)
        a, b = lm.ids(text[i - 1] if i else " ")[0], lm.ids(text[j] if j < len(text) else " ")[0]
        p = lm.logp[a, ids] + lm.logp[ids, b] if j - i == 1 else lm.logp[a, ids][:, None] + lm.logp[np.ix_(ids, ids)] + lm.logp[ids, b][None, :]
        e = np.exp(p - p.max())
        if e.max() > 0.5 * e.sum():
            k = np.unravel_index(int(e.argmax()), e.shape)
            out += [text[last:i], "".join(cand[x] for x in k)]
            last = j
    return "".join(out) + text[last:]


# ---- one text ----
Tables = dict[tuple[str | None, str], dict[str, str]]
#: A start, its gain in a text, and its place among the starts.
Candidate = tuple[str, float, int]


def undo(text: str, swap: str, lm: Bigrams, learnt: dict[str, str] | None = None) -> tuple[str, float, list[tuple[str, str, str, str]]]:
    """One cipher undone under its start and what was learnt beyond it; UTF-8 as often as it applies."""
    learnt = learnt or {}
    if swap == LOST:
        return fill_lost(text, lm), loss_gain(text, lm), []
    if swap == FREE:
        return undo_single(text, {ord(c): x for c, x in learnt.items() if len(c) == 1}, frozenset(), lm)
    true, wrong = swap.split(">")
    if (true, wrong) in CJK:
        return *undo_cjk(text, true, wrong, lm), []
    if true == "utf-8":
        for u, x in learnt.items():
            text = text.replace(u, x)
        new, gain, units = undo_utf8(text, wrong, lm)
        for _ in range(2):
            if new == text:
                break
            again, more, _ = undo_utf8(new, wrong, lm)
            if more <= 0:
                break
            new, gain = again, gain + more
        return new, gain, units
    own = {ord(c): x for c, x in learnt.items() if len(c) == 1}
    return undo_single(text, letters(true, wrong) | own if own else letters(true, wrong), stuck(true, wrong), lm)


def _token(text: str, span: Span, lm: Bigrams, st: Starts) -> Token:
    _, _, _, x, y, kind = span
    ring = text[x:y]
    hit = lm.seen[kind].get(ring)
    if hit is None:
        lo = kind // 6
        key = _DIGITS.sub("0", ring), lo, y - x - 1, kind % 3, kind % 6 == 3
        hit = lm.tokens.get(key)
        if hit is None:
            if len(lm.tokens) > CACHE:
                lm.tokens.clear()
                for seen in lm.seen:
                    seen.clear()
            hit = lm.tokens[key] = token_gains(*key, lm, st)
        if len(lm.seen[kind]) > CACHE:
            lm.seen[kind].clear()
        lm.seen[kind][ring] = hit
    return hit


def stretches(text: str, spans: Spans, lm: Bigrams, st: Starts) -> list[Candidate]:
    """All pairs of pages that gain enough in a stretch of tokens, with what they gain in their best one.

    Nothing has gone through a cipher in a text without a surprising token. What all tokens that a pair makes likelier gain together
    is the most that a stretch can gain, so that only pairs with enough of it are held against the tokens one by one.
    """
    if not spans.odd:
        return []
    seen = lm.seen
    tokens = [seen[x[5]].get(text[x[3] : x[4]]) or _token(text, x, lm, st) for x in spans.all]
    enough = LEAST_GAIN - 0.01  # sums are rounded
    if sum([t.top for t in tokens]) < enough:
        return []
    total = np.zeros((st.n, st.n), dtype=np.float32)
    for t, n in Counter(tokens).items():
        if t.top:
            total += n * np.maximum(t.gain, 0.0)[:, t.group]
    pairs = np.flatnonzero(total.ravel() >= enough)
    if not len(pairs):
        return []
    best, now = np.zeros(len(pairs), dtype=np.float32), np.zeros(len(pairs), dtype=np.float32)
    gains: dict[Token, np.ndarray] = {}
    for t in tokens:
        gain = gains.get(t)
        if gain is None:
            gain = gains[t] = t.of(pairs, st.n)
        np.maximum(now, 0.0, out=now)
        now += gain
        np.maximum(best, now, out=best)
    good = best >= LEAST_GAIN
    pairs, gain = pairs[good], np.round(best[good].astype(np.float64), 3)
    return list(zip([st.names[p] for p in pairs.tolist()], gain.tolist(), st.rank[pairs].tolist()))


def candidates(text: str, spans: Spans | None, lm: Bigrams, st: Starts) -> tuple[list[Candidate], list[tuple[str, str, str]]]:
    """Starts that gain in the text; and the tokens that surprise strongly."""
    out: list[Candidate] = []
    if spans:
        byte_pairs: dict[int, float] = {}
        for _, _, _, a, b, kind in spans.joined:
            raw = text[a:b], kind // 6, b - a - 1
            got = lm.parts.get(raw)
            if got is None:
                if len(lm.parts) > 10 * CACHE:
                    lm.parts.clear()
                got = lm.parts[raw] = part_gains(*raw, lm, st)
            for k, d in got:
                byte_pairs[k] = byte_pairs.get(k, 0.0) + d
        out = stretches(text, spans, lm, st)
        out += [(f"utf-8>{st.pages[k]}", d, k) for k, d in byte_pairs.items() if d >= LEAST_GAIN]
    wide = _WIDE.search(text)
    for k, (true, wrong) in enumerate(CJK):
        if (wide or wrong not in ("cp932", "euc_jp")) and _cjk_possible(text, true, wrong) and (d := undo_cjk(text, true, wrong, lm)[1]) >= LEAST_GAIN:
            out.append((f"{true}>{wrong}", d, k))
    if not out and "\ufffd" in text and (d := loss_gain(text, lm)) >= LEAST_GAIN:
        out.append((LOST, d, 0))  # losses never stand against a cipher
    if not spans or max((d for _, d, _ in out), default=0.0) >= -UNKNOWN:
        return out, []
    # a cipher without a page may explain more
    return out, [(text[max(0, a - 1) : a], text[a:b], text[b : b + 1]) for a, b, x, *_ in spans.odd if x > FREE_SURPRISE and any(c.isascii() and c.isalpha() for c in text[a:b])]


def restore(text: str, swaps: list[tuple[str, float]], lm: Bigrams, learnt: dict[str, dict[str, str]]) -> str:
    """The best cipher of the text undone, then every other one of it that gains enough in what is left; losses last."""

    def strange(t: str) -> Counter:
        return Counter(c for c in t if c > "\x7f" and lm.logp[:, lm.lut[ord(c)]].max() < -4)

    for n, (swap, weight) in enumerate(x for x in swaps if x[0] != LOST):
        new, gain, _ = undo(text, swap, lm, learnt.get(swap))
        if n == 0 or gain >= LEAST_GAIN and gain + weight >= LEAST_SCORE and strange(new) <= strange(text):  # no strange character out of others
            text = new
    return fill_lost(text, lm)


# ---- Spark ----
_KEPT: list[tuple[Broadcast, Bigrams, Starts]] = []


def model(counts: Broadcast) -> tuple[Bigrams, Starts]:
    """Bigrams and starts of a corpus, kept by a worker for its next tasks with all that they have scored."""
    if not _KEPT or _KEPT[0][0] is not counts:
        lm = Bigrams(counts.value)
        _KEPT[:] = [(counts, lm, Starts(lm))]
    return _KEPT[0][1:]


def scan(docs: DataFrame, text_col: str) -> DataFrame:
    """One pass: bigram counts (``gram``, ``n``) per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lut, k = class_table()
        total = np.zeros(k * k, dtype=np.int64)
        for b in batches:
            texts = b["text"].tolist()
            for j in range(0, len(texts), 1000):  # joined by a class of their own, so no pair crosses texts
                ids = lut[np.frombuffer("\x00".join(texts[j : j + 1000]).encode("utf-32-le", "replace"), dtype=np.uint32)]
                total += np.bincount(ids[:-1] * k + ids[1:], minlength=k * k)
        g = np.flatnonzero(total)
        yield pd.DataFrame({"gram": g.astype(np.int64), "n": total[g]})

    return docs.select(F.col(text_col).alias("text")).filter(F.length("text") > 0).mapInPandas(run, "gram long, n long")


def doubted(docs: DataFrame, counts: Broadcast, id_col: str, text_col: str, source_col: str | None) -> DataFrame:
    """(id, src, text, cand, odd) of the documents that some start explains in part, or that hold enough surprising tokens."""
    kind = dict(docs.dtypes)[id_col]
    src = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm, st = model(counts)
        for b in batches:
            rows = []
            some = b[[not t.isascii() for t in b["text"]]]
            part = some["text"].str.len().cumsum() // CHARS
            for _, p in some.groupby(part):
                for i, s, t, spans in zip(p["id"], p["src"], p["text"], tokens_of(p["text"].tolist(), lm)):
                    if spans is None and not _WIDE.search(t):
                        continue
                    cand, odd = candidates(t, spans, lm, st)
                    if cand or len({c for _, w, _ in odd for c in w if c > "\x7f"}) >= FREE_LETTERS:
                        rows.append((i, s, t, cand, odd))
            yield pd.DataFrame(rows, columns=["id", "src", "text", "cand", "odd"])

    # a null source is one of its own
    named = F.when(src.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), src))
    plain = docs.select(F.col(id_col).alias("id"), named.alias("src"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    return plain.mapInPandas(run, f"id {kind}, src string, text string, cand array<struct<swap: string, gain: double, place: int>>, odd array<struct<b: string, w: string, a: string>>")


class Garbled:
    """The ciphers of a corpus: their weights and tables by source."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", rounds: int = 2) -> None:
        grams = scan(docs, text_col).groupBy("gram").agg(F.sum("n")).collect()  # at most classes squared
        self.spark = docs.sparkSession
        self.counts = self.spark.sparkContext.broadcast({g: n for g, n in grams})
        self.suspects = checkpointed(doubted(docs, self.counts, id_col, text_col, source_col).dropDuplicates(["id"]))
        self.kind = dict(self.suspects.dtypes)["id"]
        self.tables: Broadcast = self.spark.sparkContext.broadcast({})
        known = self.suspects.select("id", "src", F.inline("cand"))
        self.weights = self._weights(known)
        learnt: Tables = {}
        for _ in range(rounds):
            before, learnt = learnt, self._learn(self._best(known))
            if learnt == before:
                break  # the tables stay as they are
            self.tables = self.spark.sparkContext.broadcast(learnt)
        if learnt:
            known = checkpointed(self._rescored())
            self.weights = self._weights(known)
        self.best = self._best(known)

    # weights of the ciphers
    def _weights(self, known: DataFrame, rounds: int = 3) -> DataFrame:
        """(src, swap, lw): log share of each cipher in the garbled documents of a source, smoothed by its share in all of them."""
        n = len(pages()) ** 2
        first = known.select("src", "swap").distinct().withColumn("lw", F.lit(UNKNOWN))
        for _ in range(rounds):
            per = self._scored(known, first).groupBy("src", "swap").agg(F.sum("r").alias("m"))
            w, everywhere = W.partitionBy("src"), W.partitionBy("swap")
            per = per.withColumn("all", F.sum("m").over(w)).withColumn("pool", F.sum("m").over(everywhere))
            total = per.agg(F.sum("m").alias("sum"))
            pi = (F.col("pool") + 1.0 / n) / (F.col("sum") + 1.0)
            first = checkpointed(per.join(F.broadcast(total)).select("src", "swap", F.log((F.col("m") + 2.0 * pi) / (F.col("all") + 2.0)).alias("lw")))
        return first

    def _scored(self, known: DataFrame, weights: DataFrame) -> DataFrame:
        """Score of each cipher of each document (gain plus log weight), and its responsibility."""
        w = W.partitionBy("id")
        df = known.join(weights, ["src", "swap"]).withColumn("score", F.col("gain") + F.col("lw"))
        df = df.withColumn("_e", F.exp(F.col("score") - F.max("score").over(w)))
        return df.withColumn("r", F.col("_e") / F.sum("_e").over(w)).drop("_e")

    def _best(self, known: DataFrame) -> DataFrame:
        """(id, swap, gain, swaps) of the cases: the best cipher, and all that score enough with their log weights.

        Ciphers of equal gain do the same to a text, so their weights count together; the one that its source has most of stands
        for them, of equal ones the first start.
        """
        first = F.struct(F.round("lw", 6), -F.col("place"))
        alike = known.join(self.weights, ["src", "swap"]).groupBy("id", "gain").agg(F.max_by("swap", first).alias("swap"), F.log(F.sum(F.exp("lw"))).alias("lw"))
        ok = alike.withColumn("score", F.col("gain") + F.col("lw")).filter(F.col("score") >= LEAST_SCORE)
        own = ok.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "swap", "gain", "lw"))).alias("c"))  # at most the starts
        return own.select("id", F.col("c.swap")[0].alias("swap"), F.col("c.gain")[0].alias("gain"), F.transform("c", lambda x: F.struct(x["swap"], x["lw"])).alias("swaps"))

    # their tables
    def _learn(self, best: DataFrame) -> Tables:
        """One E-step over the token types of each cipher, one M-step: the letters that differ from the start."""
        counts, tables = self.counts, self.tables

        def types(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lm, _ = model(counts)
            for b in batches:
                seen = set()
                for s, swap, t, odd in zip(b["src"], b["swap"], b["text"], b["odd"]):
                    if swap is not None and swap != LOST:
                        seen |= {(s, swap, a, u, x, z) for a, u, x, z in undo(t, swap, lm, tables.value.get((s, swap)))[2]}
                    elif swap is None:
                        for o in odd:
                            ring = o["b"] + o["w"] + o["a"]
                            at = len(o["b"])
                            seen |= {(s, FREE, ring[i - 1 : i] if i else "", c, "", ring[i + 1 : i + 2]) for i, c in enumerate(ring) if c > "\x7f" and at <= i < at + len(o["w"])}
                yield pd.DataFrame(list(seen), columns=["src", "swap", "a", "u", "x", "z"])

        def letters_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lm, _ = model(counts)
            place = {c: i for i, c in enumerate(lm.letters)}
            only = lm.base * lm.alpha
            for b in batches:
                rows = []
                for s, swap, a, u, x, z in zip(b["src"], b["swap"], b["a"], b["u"], b["x"], b["z"]):
                    if swap == FREE:
                        x = tables.value.get((s, swap), {}).get(u, "")
                        if not (a[-1:].isalpha() or z[:1].isalpha()):
                            continue
                    prior = (1 - START_SHARE) * lm.base if x in place else only / only.sum()
                    if x in place:
                        prior = prior.copy()
                        prior[place[x]] += START_SHARE
                    elif swap != FREE:
                        continue  # a letter beyond the alphabets of the candidates stays what the start says
                    q = lm.posterior(a[-1:], z[:1], prior)
                    rows += [(s, swap, u, str(lm.letters[i]), float(q[i])) for i in np.flatnonzero(q > 0.02)]
                yield pd.DataFrame(rows, columns=["src", "swap", "u", "x", "n"])

        told = self.suspects.join(best.select("id", "swap"), "id", "left").select("src", "swap", "text", "odd")
        kinds = told.mapInPandas(types, "src string, swap string, a string, u string, x string, z string").distinct()
        per = kinds.mapInPandas(letters_of, "src string, swap string, u string, x string, n double").groupBy("src", "swap", "u", "x").agg(F.sum("n").alias("n"))
        top = per.groupBy("src", "swap", "u").agg(F.max_by("x", "n").alias("x"), F.max("n").alias("n"), F.sum("n").alias("all"))
        # what differs from the start: only free ciphers and letters that the data contradict
        top = top.filter((F.col("n") * 2 > F.col("all")) & ((F.col("swap") != FREE) & (F.col("n") > START_COUNT) | (F.col("n") >= FREE_TYPES)))
        out: Tables = {}
        taken: set[tuple[str, str, str]] = set()
        for r in top.orderBy(F.desc("n"), "src", "swap", "u").limit(TABLE_ROWS).collect():
            if r.swap == FREE:
                if (r.src, r.swap, r.x) in taken or r.x == r.u:
                    continue  # no two characters stand for one letter
                taken.add((r.src, r.swap, r.x))
            elif r.x == _start(r.swap, r.u):
                continue
            out.setdefault((r.src, r.swap), {})[r.u] = r.x
        return {k: v for k, v in out.items() if k[1] != FREE or len(v) >= FREE_LETTERS}

    def _rescored(self) -> DataFrame:
        """(id, src, swap, gain, place) under the learnt tables, free ciphers included."""
        counts, tables = self.counts, self.tables

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            (lm, _), own = model(counts), tables.value
            for b in batches:
                rows = []
                for i, s, t, cand in zip(b["id"], b["src"], b["text"], b["cand"]):
                    rows += [(i, s, c["swap"], undo(t, c["swap"], lm, own[s, c["swap"]])[1] if (s, c["swap"]) in own else c["gain"], c["place"]) for c in cand]
                    if (s, FREE) in own:
                        _, gain, units = undo(t, FREE, lm, own[s, FREE])
                        if gain >= FREE_GAIN and len({u for _, u, _, _ in units}) >= FREE_LETTERS:
                            rows.append((i, s, FREE, gain, 0))
                yield pd.DataFrame(rows, columns=["id", "src", "swap", "gain", "place"])

        return self.suspects.select("id", "src", "text", "cand").mapInPandas(run, f"id {self.kind}, src string, swap string, gain double, place int").filter(F.col("gain") >= LEAST_GAIN)

    def found(self) -> DataFrame:
        """Ids of garbled documents with their cipher and gain."""
        return self.best.drop("swaps")

    def restored(self) -> DataFrame:
        """(id, swap, gain, original): the text with its ciphers undone (``swap`` is the one undone first) and likely letters for losses."""
        counts, tables = self.counts, self.tables

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lm, _ = model(counts)
            by: dict[str, dict[str, dict[str, str]]] = {}
            for (s, swap), t in tables.value.items():
                by.setdefault(s, {})[swap] = t
            for b in batches:
                yield pd.DataFrame({"id": b["id"], "swap": b["swap"], "gain": b["gain"], "original": [restore(t, [(x["swap"], x["lw"]) for x in h], lm, by.get(s, {})) for s, t, h in zip(b["src"], b["text"], b["swaps"])]})

        return self.suspects.select("id", "src", "text").join(self.best, "id").mapInPandas(run, f"id {self.kind}, swap string, gain double, original string")


def _start(swap: str, unit: str) -> str | None:
    """The letter that a start has for a unit."""
    true, wrong = swap.split(">")
    if true == "utf-8":
        try:
            return _as_bytes(unit, wrong).encode("latin-1").decode("utf-8")
        except UnicodeError:
            return None
    return letters(true, wrong).get(ord(unit)) if len(unit) == 1 and (true, wrong) not in CJK else None
