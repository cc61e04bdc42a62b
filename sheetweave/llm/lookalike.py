"""Visually identical text with different characters: one consistent spelling for every string.

1. Compatibility normalisation, restricted to what looks the same (width forms, radicals, ligatures, spaces, hyphens);
   raised digits, fractions, circled and styled letters are kept, since they are real differences. 2. Ignorable characters
   are deleted, white space at the ends is cut. 3. Each character becomes its look-alike class; the alternatives of the
   classes form a lattice, in which Viterbi finds the spelling with the best script-consistent character bigram score. 4. NFC.

The lattice depends on the classes alone, never on which alternative stood there, so two strings of the same look always get
the same spelling. The bigram model counts all distinct strings of the corpus, in Spark; only pairs that touch a look-alike
class are kept, so the model is bounded by the alphabets (about 150 look-alikes times the characters beside them), not by the
data. Only distinct strings that are not plainly unambiguous go through Python.

Defined results: null stays null, a string of ignorables and spaces becomes the empty string, repeated rows give repeated rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters of the same shape, one class each; within a class no two of one script.
CLASSES = (
    "AАΑ BВΒ CСϹ EЕΕ HНΗ IІΙӀ JЈͿ KКΚ MМΜ NΝ OОΟ PРΡ SЅ TТΤ XХΧ YΥҮ ZΖ GԌ QԚ WԜ ГΓ ПΠ ФΦ "
    "aаɑ cсϲ eе hһ iі jјϳ oоο pрρ sѕ xх yу dԁ qԛ wԝ vνѵ lӏ gɡ "
    "ロ口 タ夕 ト卜 エ工 カ力 ニ二 ハ八 ヘへ ー一"
).split()
# Marks of the same shape, and the one that stands for them.
MARKS = {"‐": "-", "‑": "-", "−": "-", "﹣": "-", "゛": "゙", "゜": "゚", "µ": "μ", "∙": "·", "Ω": "Ω"}
# Ligatures drawn as their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
# Characters without a look of their own outside the format category.
IGNORABLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ"
#: Cost of a change of script at a word's start and inside a word; score of a pair never seen.
SWITCH, SWITCH_IN_WORD, FLOOR = 3.0, 8.0, -14.0

CLASS_OF = {c: g for g in CLASSES for c in g}


def script(c: str) -> str:
    """Coarse script of a letter; the empty string for everything else (and for marks)."""
    o = ord(c)
    if o < 0x250:
        return "L" if c.isalpha() and c != "µ" else ""
    if 0x250 <= o < 0x2B0:
        return "L"
    if 0x370 <= o < 0x400:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    if 0x3041 <= o <= 0x3096:
        return "H"
    if 0x30A1 <= o <= 0x30FA or o == 0x30FC:
        return "K"
    if 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF:
        return "Z"
    return "O" if c.isalpha() else ""


def plain(text: str) -> str:
    """Steps 1 and 2, decomposed: same look, no invisible characters, one kind of space, no spaces at the ends."""
    out = []
    for c in text:
        if c < "\x7f":
            out.append(" " if c in "\t\r\n\v\f" else c)
            continue
        cat = unicodedata.category(c)
        if cat == "Cf" or c in IGNORABLE or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF:
            continue
        if cat in ("Zs", "Zl", "Zp") or c == "\x85":
            out.append(" ")
            continue
        if c in MARKS:
            out.append(MARKS[c])
            continue
        if c in LIGATURES:
            out.append(LIGATURES[c])
            continue
        d = unicodedata.decomposition(c)
        if d.startswith(("<wide>", "<narrow>")) or (d.startswith("<compat>") and (0x2E80 <= ord(c) <= 0x2FDF)):
            c = unicodedata.normalize("NFKC", c)
        out.append(c)
    text = unicodedata.normalize("NFD", "".join(out))
    return "".join(MARKS.get(c, c) for c in text).strip(" \t\r\n\v\f\x1c\x1d\x1e\x1f")


def classes(text: str) -> str:
    """The look of a string: each character's class, by its first member."""
    return "".join(CLASS_OF[c][0] if c in CLASS_OF else c for c in plain(text))


def viterbi(text: str, score: dict[str, float]) -> str:
    """The best spelling of a decomposed string. ``score``: log probability of a pair of neighbours."""
    beams: dict[tuple[str, str], tuple[float, str]] = {("^", ""): (0.0, "")}
    fresh = True  # no letter of this word yet
    for c in text:
        alts = CLASS_OF.get(c)
        if alts is None and not script(c):
            # common characters keep the script; marks stay with their letter
            fresh = fresh if unicodedata.combining(c) else True
            nxt: dict[tuple[str, str], tuple[float, str]] = {}
            for (p, s), (w, path) in beams.items():
                k = (p if unicodedata.combining(c) else c, s)
                v = (w, path + c)
                if k not in nxt or (-v[0], v[1]) < (-nxt[k][0], nxt[k][1]):
                    nxt[k] = v
            beams = nxt
            continue
        nxt = {}
        for a in alts or c:
            sa = script(a)
            fam = "J" if sa in "HKZ" else sa  # Japanese scripts mix freely
            for (p, s), (w, path) in beams.items():
                step = score.get(p + a, FLOOR) - (0 if s in ("", fam) else SWITCH if fresh else SWITCH_IN_WORD)
                v = (w + step, path + a)
                k = (a, fam)
                if k not in nxt or (-v[0], v[1]) < (-nxt[k][0], nxt[k][1]):
                    nxt[k] = v
        beams, fresh = nxt, False
    return min(((-w, path) for w, path in beams.values()))[1]


def canonical(text: str, score: dict[str, float]) -> str:
    """The one spelling of everything that looks like ``text``."""
    return unicodedata.normalize("NFC", viterbi(classes(text), score))


def bigram_model(strings: DataFrame, col: str) -> dict[str, float]:
    """Log probabilities of neighbouring characters in script-consistent words, over all distinct strings of the column.

    Words that mix Latin, Greek and Cyrillic are left out: they are what is to be repaired. Bounded by the alphabets.
    """

    @F.pandas_udf("array<string>")
    def pairs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, list[str]] = {}

        def of(word: str) -> list[str]:
            if word not in seen:
                if len(seen) > 50_000:
                    seen.clear()
                t = plain(word)
                fams = {"J" if s in "HKZ" else s for s in map(script, t)} - {""}
                letters = "^" + "".join(c for c in t if not unicodedata.combining(c))
                seen[word] = [] if len(fams & set("LGC")) > 1 else [a + b for a, b in zip(letters, letters[1:]) if b in CLASS_OF or a in CLASS_OF and script(b)]
            return seen[word]

        for s in batches:
            yield s.map(lambda v: [x for word in (v or "").split() for x in of(word)])

    counts = strings.select(F.explode(pairs(F.col(col))).alias("g")).groupBy("g").count()
    rows = counts.collect()  # at most |look-alikes| x |alphabet|
    total: dict[str, int] = {}
    for g, n in rows:
        total[g[0]] = total.get(g[0], 0) + n
    return {g: math.log((n + 0.1) / (total[g[0]] + 40)) for g, n in rows}


def canonical_strings(strings: DataFrame, col: str, score: dict[str, float], out: str = "canonical") -> DataFrame:
    """Add the consistent spelling. Run it on distinct strings and join back, as ``canonical_column`` does."""

    @F.pandas_udf("string")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else canonical(v, score))

    return strings.withColumn(out, spell(F.col(col)))


def canonical_pairs(values: DataFrame, terms: DataFrame, value_col: str = "value", term_col: str = "term") -> tuple[DataFrame, DataFrame]:
    """Distinct values and distinct terms, each with its spelling under one model learnt from both."""
    distinct = values.select(F.col(value_col).alias("text")).filter("text is not null").distinct()
    of_terms = terms.select(F.col(term_col).alias("text")).filter("text is not null").distinct()
    score = bigram_model(distinct.unionAll(of_terms), "text")
    return canonical_strings(distinct, "text", score), canonical_strings(of_terms, "text", score)


def normalised(values: DataFrame, terms: DataFrame, value_col: str = "value", term_col: str = "term") -> DataFrame:
    """Every row with ``canonical``; clashing columns keep their names, the new one gets a ``_`` if ``canonical`` is taken."""
    name = "canonical" if "canonical" not in values.columns else "canonical_"
    spelt, _ = canonical_pairs(values, terms, value_col, term_col)
    return values.join(spelt.select(F.col("text").alias(value_col), F.col("canonical").alias(name)), value_col, "left").select(*values.columns, name)


def meets(values: DataFrame, terms: DataFrame, id_col: str = "cell_id", value_col: str = "value", term_id: str = "term_id", term_col: str = "term") -> DataFrame:
    """(id, term id) of rows that look like a term but aren't the same character sequence, each pair once."""
    spelt, term_spelt = canonical_pairs(values, terms, value_col, term_col)
    want = term_spelt.join(terms.select(F.col(term_id), F.col(term_col).alias("text")), "text").select("canonical", term_id, F.col("text").alias("_t"))
    hits = spelt.join(want, "canonical").filter("text <> _t").select(F.col("text").alias(value_col), term_id)
    return values.select(id_col, value_col).join(hits, value_col).select(id_col, term_id).distinct()
