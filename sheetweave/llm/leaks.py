"""Evaluation texts that leaked into a corpus.

1. Every corpus text is read once, whole: case, punctuation and white space are dropped, and an automaton over all word
   five-grams of the test items (twelve-character grams for Japanese) lists the grams it holds. Only texts with a hit go on,
   with the stretch around their hits. 2. The grams' document counts over the whole corpus are aggregated, and in each window
   of an item that would count as a leak the rarest gram becomes its seed, so no leak can be missed, while stock phrases that
   many texts share stop joining texts to items. 3. Texts and items that share a seed are aligned by Smith-Waterman over words
   (characters for Japanese), which scores edited and partial copies; the longest exact run is measured beside it.

Scale: the test items (a bounded set, processed in blocks of ``block_items``) are broadcast, never the corpus; the shuffle
carries gram ids of the few texts with hits; there is no pair of corpus texts anywhere, so hot families cost nothing extra.

Defined results: null and empty texts hold nothing; items shorter than the least run can't leak; repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.session import checkpointed

WORDS, CHARS = 15, 40  # least runs that count as a leak
GRAM_WORDS, GRAM_CHARS = 5, 12
MATCH, MISMATCH, GAP = 2, -1, 1
#: Score of a passage over that of the least run unchanged; score over the item's own that counts as an edited copy of it.
GATE, EDITED = 0.5, 0.6
_ASCII = bytes(b for b in range(128) if not chr(b).isalnum())
_REST = re.compile(r"[\W_]+")
_RUN = re.compile(r"[^\W_]+")


def squash(text: str) -> str:
    """Letters and digits only, lower case."""
    return _REST.sub("", text.lower().encode("utf-8", "surrogatepass").translate(None, _ASCII).decode("utf-8", "surrogatepass"))


def units(text: str, lang: str | None) -> list[str]:
    """What runs are counted in: words between white space, or characters for Japanese."""
    return list(squash(text)) if lang == "ja" else [w for w in map(squash, text.split()) if w]


class Item:
    """A test item with its units, grams and windows."""

    def __init__(self, item_id: int, lang: str | None, text: str) -> None:
        self.id, self.ja = item_id, lang == "ja"
        self.units = units(text, lang)
        self.least = CHARS if self.ja else WORDS
        n = GRAM_CHARS if self.ja else GRAM_WORDS
        self.grams = ["".join(self.units[k : k + n]) for k in range(len(self.units) - n + 1)] if len(self.units) >= self.least else []
        self.per_window = self.least - n + 1

    def seeds(self, count: dict[str, int]) -> set[str]:
        """The rarest gram of every window of the least run that any text holds; ties go to the first.

        A text with the whole window holds all its grams, so none is missed; windows that stand nowhere whole still seed edited copies.
        """
        g = self.grams
        windows = ([x for x in g[k : k + self.per_window] if count.get(x)] for k in range(len(g) - self.per_window + 1))
        return {min(w, key=count.__getitem__) for w in windows if w}


def align(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """Smith-Waterman: best local score, and where in ``b`` it ends and, about, starts. Linear gaps, a row at a time."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(a))}
    bb = np.array([ids.get(w, -1) for w in b])
    j = np.arange(len(b) + 1) * GAP
    row, best, end = np.zeros(len(b) + 1, dtype=np.int64), 0, 0
    for w in a:
        t = np.maximum(row - GAP, 0)
        t[1:] = np.maximum(t[1:], row[:-1] + np.where(bb == ids[w], MATCH, MISMATCH))
        row = np.maximum.accumulate(t + j) - j
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end, max(0, end - len(a))


def longest_run(item: Item, passage: str) -> int:
    """The most consecutive units of the item that stand in the passage; word runs begin and end at word limits."""
    runs = [squash(w) for w in _RUN.findall(passage)]
    text = "".join(runs)
    u = item.units
    if not item.ja:
        limits, at = {0}, 0
        for w in runs:
            at += len(w)
            limits.add(at)

    def holds(s: str) -> bool:
        p = text.find(s)
        while p >= 0:
            if item.ja or p in limits and p + len(s) in limits:
                return True
            p = text.find(s, p + 1)
        return False

    best = 0
    for k in range(len(u)):
        while k + best < len(u) and holds("".join(u[k : k + best + 1])):
            best += 1
    return best


def _automaton(grams: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, g in enumerate(grams):
        a.add_word(g, i)
    a.make_automaton()
    return a


def _gram_hits(docs: DataFrame, grams: list[str], margin: int, id_col: str, text_col: str) -> DataFrame:
    """(id, gram numbers, passage) of the texts that hold any gram."""
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = _automaton(shared.value)
        for b in batches:
            rows = []
            for i, text in zip(b[id_col], b[text_col]):
                if not text:
                    continue
                hits = list(auto.iter(squash(text)))
                if hits:
                    lo, hi = hits[0][0] - margin, hits[-1][0] + margin
                    at, start, stop = 0, len(text), len(text)
                    for m in _RUN.finditer(text):
                        at += len(squash(m.group()))
                        if at > lo and start == len(text):
                            start = m.start()
                        if at >= hi:
                            stop = m.end()
                            break
                    rows.append((i, sorted({g for _, g in hits}), text[start:stop]))
            yield pd.DataFrame(rows, columns=["id", "grams", "passage"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).filter(F.length(text_col) > 0).mapInPandas(run, f"id {kind}, grams array<int>, passage string")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id, score, share, run, kind, leaked) for every text that shares a seed with an item.

    ``score`` is the Smith-Waterman score, ``share`` that score over the item's own, ``run`` the longest exact run in the
    item's units (0 where the alignment is too weak to hold one), ``kind`` ``exact``, ``edited`` or ``weak``, ``leaked`` whether
    it is exact.
    """
    own = sorted({(r[0], r[1], r[2]) for r in items.select("item_id", "lang", "item_text").collect() if r[2]}, key=lambda r: (r[0], r[2]))
    out = None
    for k in range(0, max(1, len(own)), block_items):
        part = _leaks(docs, [Item(*r) for r in own[k : k + block_items]], id_col, text_col)
        out = part if out is None else out.unionAll(part)
    return out


def _leaks(docs: DataFrame, items: list[Item], id_col: str, text_col: str) -> DataFrame:
    grams = sorted({g for i in items for g in i.grams})
    margin = max([0, *(sum(map(len, i.units)) for i in items)])
    hits = checkpointed(_gram_hits(docs, grams, margin, id_col, text_col))
    count = {grams[g]: n for g, n in hits.select("id", F.explode("grams").alias("g")).groupBy("g").count().collect()}  # at most the items' own grams
    number = {g: n for n, g in enumerate(grams)}
    seeded: dict[int, list[int]] = {}
    for n, i in enumerate(items):
        for g in i.seeds(count):
            seeded.setdefault(number[g], []).append(n)
    shared = docs.sparkSession.sparkContext.broadcast((items, seeded))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        its, seeds = shared.value
        for b in batches:
            rows = []
            for doc, gs, passage in zip(b["id"], b["grams"], b["passage"]):
                words = None
                for n in sorted({n for g in gs for n in seeds.get(g, ())}):
                    it = its[n]
                    if words is None:
                        words = [squash(w) for w in passage.split()]
                        words, chars = [w for w in words if w], list("".join(words))
                    score, _, _ = align(it.units, chars if it.ja else words)
                    best = longest_run(it, passage) if score >= GATE * MATCH * it.least else 0
                    share = score / (MATCH * len(it.units))
                    kind = "exact" if best >= it.least else "edited" if share >= EDITED else "weak"
                    rows.append((doc, it.id, score, share, best, kind, kind == "exact"))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "share", "run", "kind", "leaked"])

    kind = dict(docs.dtypes)[id_col]
    return hits.mapInPandas(run, f"doc_id {kind}, item_id long, score int, share double, run int, kind string, leaked boolean").dropDuplicates(["doc_id", "item_id"])
