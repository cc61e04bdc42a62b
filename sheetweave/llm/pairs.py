"""Broken prompt and response pairs: each defective pair with its type of defect.

A multi-label linear classifier (one logistic unit per defect over hashed word and character n-grams and features of the pair; one
of these is what a linear language model over the same n-grams gives to other languages than the one asked for) is trained on defects made from the corpus' own sound pairs: responses cut
off, copied from the question, swapped with those of another language, refused, or emptied. Thresholds are calibrated on
held-out examples. The corpus' own defects among the training pairs are left out by cross-fitting (each half is cleared by
the model of the other), and unstructured answers to tables serve as further refusals. Exact checks follow where a defect is exact (empty, copy); the first defect in the order of
``DEFECTS`` is reported.

Scale: questions meet answers by key; only the latest writing of a key counts, found by an aggregate with map-side combine.
Training takes a sample of at most ``SAMPLE`` pairs of each source, a documented bound; every pair is scored, in Arrow batches.

Defined results: a pair whose question is unknown has no table and no language asked for, so it can only be empty, refused or
truncated; null answers are empty ones, but no defect where the question's table has no rows; repeats count once.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.llm.leaks import squash
from sheetweave.session import latest

DEFECTS = ("empty", "refusal", "copy", "language", "truncated")
SAMPLE = 1200
DIM = 1 << 16

# Languages by their names, and common words by language.
NAMES = {
    "en": ("English", "英語", "Englisch", "anglais", "inglés"),
    "ja": ("Japanese", "日本語", "Japanisch", "japonais", "japonés"),
    "de": ("German", "ドイツ語", "Deutsch", "allemand", "alemán"),
    "fr": ("French", "フランス語", "Französisch", "français", "francés"),
    "es": ("Spanish", "スペイン語", "Spanisch", "espagnol", "español"),
}
WORDS = {
    "en": "the this and of what is which as with a it in its into up then that to does show list read turn describe".split(),
    "de": "das dieses die und der was zeigt ein mit als im nenne wichtige den fasse sie zusammen um gib zurück kurz lies beschreibe".split(),
    "fr": "le la les cette ce et que l'image un avec en des montre cite ses lis rends décris peu de mots".split(),
    "es": "la el los las esta este y qué un con en del sus lee muestra menciona las describe añade siguiente".split(),
}
#: What stands for no answer.
NOTHING = {"", "-", "...", "…", "n/a", "null", "none", "nil", "[画像概要]", "--", "—", "undefined", "nan"}
#: What may stand before a copied question.
PREFIXES = ("", "q", "question", "data", "datahtml", "html", "error", "prompt", "質問")
#: Ways to decline, in five languages.
REFUSALS = {
    "en": ("I'm sorry, but I can't help with that.", "I cannot assist with this request.", "I am unable to process this file.", "As an AI model I am not able to do that.", "Unfortunately I am not allowed to handle this content.", "This request was declined.", "I won't be able to extract that."),
    "ja": ("申し訳ありませんが、お応えできません。", "この内容は処理できません。", "ご要望には対応いたしかねます。", "恐れ入りますが、お断りいたします。", "この解析は許可されていません。"),
    "de": ("Es tut mir leid, dabei kann ich nicht helfen.", "Diese Anfrage kann ich nicht bearbeiten.", "Ich muss das leider ablehnen.", "Solche Inhalte darf ich nicht verarbeiten."),
    "fr": ("Je suis désolé, je ne peux pas vous aider.", "Il m'est impossible de traiter cette demande.", "Je dois décliner cette requête.", "Je préfère ne pas répondre."),
    "es": ("Lo siento, no puedo ayudar con esto.", "No me es posible procesar la petición.", "Debo rechazar esta solicitud.", "No tengo permitido tratar este contenido."),
}
TAIL = {"en": "Please send another one.", "ja": "別のものをお送りください。", "de": "Bitte senden Sie etwas anderes.", "fr": "Veuillez en envoyer une autre.", "es": "Envíe otra cosa, por favor."}

_FENCE = re.compile(r"```[a-zA-Z]*")
_BLOCK = re.compile(r"^[ \t]*(\{|\[(?=\s*[\[{\"\d\]]|null|true|false))", re.M)
_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_JAPAN = re.compile(r"[ぁ-ヿ一-鿿々]+")
_FIXED = {"data", "summary", "error", "null", "json", "yaml", "html", "table", "tr", "td", "coord", "b", "req", "n", "x", "y"}


def language(prompt: str | None) -> str:
    """The language a prompt asks for, or else is written in; empty if neither shows."""
    if not prompt:
        return ""
    for lang, names in NAMES.items():
        if any(n in prompt if n > "\u3000" else re.search(rf"\b{n}\b", prompt) for n in names):
            return lang
    if re.search("[ぁ-んァ-ヶ]", prompt):
        return "ja"
    words = [w.lower() for w in re.findall(r"[\w'’]+", prompt)]
    votes = {lang: sum(w in own for w in words) for lang, own in WORDS.items()}
    best = max(votes, key=votes.get)
    return best if votes[best] else ""


def table_rows(question: str | None) -> int:
    """Rows of the question's table without its head; -1 if it has none."""
    if not question or "<tr" not in question:
        return -1
    return sum("<b>" not in r for r in question.split("<tr")[1:])


def open_ended(text: str) -> tuple[int, bool]:
    """Brackets left open and whether a JSON string is."""
    depth, inside, skip = 0, False, False
    for c in text:
        if skip:
            skip = False
        elif inside:
            if c == "\\":
                skip = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
    return depth, inside


class Pair:
    """What the features need of a question and its answer."""

    def __init__(self, prompt: str | None, question: str | None, answer: str | None) -> None:
        self.prompt, self.question, self.answer = prompt or "", question or "", answer or ""
        self.lang, self.rows = language(prompt), table_rows(question)
        t = self.answer
        self.fences = t.count("```")
        self.body = _FENCE.sub("", t).strip()
        m = _BLOCK.search(self.body)
        at = m.start(1) if m else -1
        self.json = self.yaml = None
        self.leaves: list[str] = []
        self.depth, self.inside, self.got = 0, False, 0
        self.prose = self.body
        if at >= 0:
            self.prose, block = self.body[:at].strip(), self.body[at:]
            self.depth, self.inside = open_ended(block)
            try:
                self.json = json.JSONDecoder().raw_decode(block)[0]
            except ValueError:
                self.json = False
            if self.json is not False:
                self._walk(self.json, True)
                data = self.json.get("data") if isinstance(self.json, dict) else self.json
                self.got = len(data) if isinstance(data, list) else 0
            else:
                self.leaves = re.findall(r'"((?:[^"\\]|\\.)*)"?', block)
                self.got = len(re.findall(r"\{[^{}]*\}", block))
        elif re.match(r"(data|summary|error)\s*:", self.body) or "\ndata:" in self.body:
            cut = 0 if not "\ndata:" in self.body or self.body.startswith("data:") else self.body.index("\ndata:")
            self.prose, self.yaml = self.body[:cut].strip(), self.body[cut:].strip()
            self.got = len(re.findall(r"^\s*- ", self.yaml, re.M))
            self.leaves = [re.sub(r"^\s*-?\s*", "", ln) for ln in self.yaml.splitlines()]
            m = re.search(r"^summary:\s*(.*)\Z", self.yaml, re.M | re.S)
            s = m.group(1).strip() if m else ""
            self.inside = s.startswith('"') and not (len(s) > 1 and s.endswith('"'))
            self.depth = 0
            self.has_summary = bool(m)
        self.structured = self.json not in (None, False) or self.yaml is not None or self.json is False
        self.text = "\n".join([self.prose, *self.leaves])
        self._copied: bool | None = None

    def _walk(self, x: object, top: bool = False) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                if k.lower() not in _FIXED:
                    self.leaves.append(k)
                self._walk(v)
        elif isinstance(x, list):
            for v in x:
                self._walk(v)
        elif isinstance(x, str):
            self.leaves.append(x)

    # exact checks
    def empty(self) -> bool:
        if self.rows == 0:
            return False
        if self.got or self.depth > 0 or self.inside:
            return False
        if self.prose.strip().lower() not in NOTHING:
            return False
        if self.yaml is not None:
            return not any(re.sub(r"^(data|summary|error)\s*:\s*", "", x).strip('"[]{} ').lower() not in NOTHING for x in self.leaves)
        return all(x.strip().lower() in NOTHING for x in self.leaves)

    def copied(self) -> bool:
        if self._copied is None:
            self._copied = self._is_copy()
        return self._copied

    def _is_copy(self) -> bool:
        texts = (self.prompt, self.question, self.prompt + self.question, self.question + self.prompt)
        own = {squash(x) for t in texts for x in (_TAG.sub(" ", t), t)} - {""}
        if not own or not self.answer:
            return False
        heads = tuple({x[:6] for x in own})
        for raw in (self.answer, self.prose + " " + " ".join(self.leaves if self.structured else [])):
            raw = _FENCE.sub(" ", raw.replace("[画像概要]", " "))
            for t in (_TAG.sub(" ", raw), raw) if "<" in raw else (raw,):
                t = squash(t)
                for pre in PREFIXES:
                    u = t[len(pre) :]
                    if not t.startswith(pre) or not u.startswith(heads):
                        continue
                    if u in own or any(len(u) > len(x) and len(u) % len(x) == 0 and u == x * (len(u) // len(x)) for x in own):
                        return True
        return False

    def dense(self) -> dict[str, float]:
        """Features of the pair."""
        tail = self.prose.rstrip("*_ \n") or ""
        prose_last = self.body.rstrip("*_` \n")
        unstructured = not self.structured
        closed = bool(prose_last) and prose_last[-1] in ".。!?！？|”」』»\")）:"
        yaml_short = self.yaml is not None and self.rows > 0 and self.got < self.rows
        last_value = self.yaml.splitlines()[-1].split(":", 1)[-1].strip().strip('"') if self.yaml else ""
        seen = last_value and (self.yaml.count(": " + last_value) + self.yaml.count(': "' + last_value) > 1 or f">{last_value}<" in self.question)
        # a last row with fewer members than the first
        ragged = False
        if self.yaml and self.got > 1 and not getattr(self, "has_summary", False):
            per = [len(r.strip().splitlines()) for r in re.split(r"^\s*- ", self.yaml, flags=re.M)[1:]]
            ragged = per[-1] < per[0]
        f = {
            "none": self.empty(),
            "copied": self.copied(),
            "unstructured": unstructured and self.rows > 0,
            "prose_only": unstructured and self.rows < 0,
            "norows": self.rows > 0 and self.got == 0,
            "open": self.depth > 0,
            "inside": self.inside,
            "odd_fence": self.fences % 2 == 1,
            "mid": unstructured and not closed,
            "dots": self.body.endswith(("...", "…")),
            "yaml_short": yaml_short,
            "yaml_ragged": ragged,
            "yaml_last_new": self.yaml is not None and not getattr(self, "has_summary", False) and not seen,
            "prose_open": bool(tail) and self.structured and tail[-1].isalnum(),
            "json_bad": self.json is False,
            "whole": self.json not in (None, False) and self.fences % 2 == 0 or self.yaml is not None and getattr(self, "has_summary", False) and not self.inside,
        }
        return {k: float(v) for k, v in f.items()}

    def grams(self) -> list[str]:
        """Words and pairs of words, characters for Japanese, of the whole answer."""
        text = self.text if not _TAG.search(self.text) else _TAG.sub(" ", self.text)
        words = [w.lower() for w in _WORD.findall(text)]
        out = []
        for w in words:
            if _JAPAN.fullmatch(w):
                out += [w[i : i + 2] for i in range(max(1, len(w) - 1))] + [w[i : i + 4] for i in range(len(w) - 3)]
        lat = [w for w in words if w not in _FIXED and not _JAPAN.match(w)]
        out += lat + [a + " " + b for a, b in zip(lat, lat[1:])]
        return list(dict.fromkeys(out))


LANGS = tuple(NAMES)
DENSE = [*Pair("", "", "").dense(), "other_language"]
BIAS = DIM + len(DENSE)


def features(p: Pair, ids: dict[str, int]) -> tuple[list[int], list[float]]:
    """Indices and values: hashed grams of unit length together, the pair features, the bias."""
    g = p.grams()
    idx = []
    for t in g:
        i = ids.get(t)
        if i is None:
            if len(ids) > 300_000:
                ids.clear()
            i = ids[t] = zlib.crc32(t.encode()) & (DIM - 1)
        idx.append(i)
    v = [3.0 / max(1.0, len(idx)) ** 0.5] * len(idx)
    d = p.dense()
    on = [(DIM + k, 2.0) for k, n in enumerate(DENSE[:-1]) if d[n]]
    return idx + [k for k, _ in on] + [BIAS], v + [x for _, x in on] + [1.0]


class Model:
    """One-vs-rest logistic regression on sparse rows, by AdaGrad over mini-batches."""

    def __init__(self, labels: tuple[str, ...] = DEFECTS) -> None:
        self.w = np.zeros((BIAS + 1, len(labels)), dtype=np.float32)
        self.cut = np.full(len(labels), 0.5)

    def fit(self, rows: list[tuple[list[int], list[float]]], y: np.ndarray, epochs: int = 10, seed: int = 7) -> None:
        rnd = np.random.default_rng(seed)
        h = np.full(self.w.shape, 1e-6, dtype=np.float32)
        for e in range(epochs):
            order = rnd.permutation(len(rows))
            for k in range(0, len(order), 32):
                part = order[k : k + 32]
                idx = np.concatenate([rows[i][0] for i in part]).astype(np.int64)
                val = np.concatenate([rows[i][1] for i in part]).astype(np.float32)
                n = np.array([len(rows[i][0]) for i in part])
                start = np.concatenate([[0], np.cumsum(n)[:-1]])
                z = np.add.reduceat(self.w[idx] * val[:, None], start, axis=0)
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
                g = val[:, None] * np.repeat(err, n, axis=0)
                u, inv = np.unique(idx, return_inverse=True)
                by = np.argsort(inv, kind="stable")
                gu = np.add.reduceat(g[by], np.searchsorted(inv[by], np.arange(len(u))), axis=0)
                gu += 1e-5 * self.w[u]
                h[u] += gu * gu
                self.w[u] -= 0.3 * gu / np.sqrt(h[u])

    def margins(self, row: tuple[list[int], list[float]]) -> np.ndarray:
        return (self.w[np.array(row[0])] * np.array(row[1], dtype=np.float32)[:, None]).sum(0)

    def scores(self, row: tuple[list[int], list[float]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(row), -30, 30)))

    def calibrate(self, rows: list[tuple[list[int], list[float]]], y: np.ndarray) -> None:
        """The threshold of each defect with the best F1 on held-out examples, in the lower part of the best stretch."""
        s = np.array([self.scores(r) for r in rows])
        grid = np.linspace(0.05, 0.95, 37)
        for j in range(len(DEFECTS)):
            f = []
            for c in grid:
                hit = s[:, j] >= c
                tp = (hit & (y[:, j] > 0)).sum()
                f.append(2 * tp / max(1, hit.sum() + (y[:, j] > 0).sum()))
            best = np.flatnonzero(np.array(f) >= max(f) - 1e-9)
            self.cut[j] = grid[best[len(best) // 4]]


class Judge:
    """The language model and the defect model together."""

    def __init__(self) -> None:
        self.lang, self.model, self.ids = Model(LANGS), Model(), {}

    def row(self, p: Pair) -> tuple[list[int], list[float]]:
        """All features of a pair."""
        idx, val = features(p, self.ids)
        n = sum(i < DIM for i in idx)
        if p.lang and n:
            z = self.lang.margins((idx[:n] + [BIAS], val[:n] + [1.0]))
            gap = max(x for x, name in zip(z, LANGS) if name != p.lang) - z[LANGS.index(p.lang)]
            if gap > 0:
                idx, val = idx[:-1] + [BIAS - 1, BIAS], val[:-1] + [2.0 * min(1.0, gap / 2), 1.0]
        return idx, val

    def learn_languages(self, pairs: list[Pair]) -> None:
        """From the answers, named by the language asked for: a few are in another one, which averages out."""
        rows, y = [], []
        for p in pairs:
            idx, val = features(p, self.ids)
            n = sum(i < DIM for i in idx)
            if p.lang and n > 2:
                rows.append((idx[:n] + [BIAS], val[:n] + [1.0]))
                y.append(LANGS.index(p.lang))
        # each half is cleared of answers in another language by the model of the other half
        fold = np.arange(len(rows)) % 2
        keep = np.zeros(len(rows), dtype=bool)
        for f in (0, 1):
            part = Model(LANGS)
            if (fold != f).any():
                part.fit([r for r, k in zip(rows, fold) if k != f], np.eye(len(LANGS), dtype=np.float32)[[x for x, k in zip(y, fold) if k != f]], epochs=4)
            for i in np.flatnonzero(fold == f):
                keep[i] = int(part.margins(rows[i]).argmax()) == y[i]
        self.lang = Model(LANGS)
        if keep.any():
            self.lang.fit([r for r, k in zip(rows, keep) if k], np.eye(len(LANGS), dtype=np.float32)[[x for x, k in zip(y, keep) if k]], epochs=4)

    def label(self, p: Pair) -> str | None:
        """The first defect that holds; exact ones are checked."""
        s = self.model.scores(self.row(p)) >= self.model.cut
        for j, d in enumerate(DEFECTS):
            if s[j] and (d == "empty" and p.empty() or d == "copy" and p.copied() or d == "language" and p.lang or d in ("refusal", "truncated")):
                return d
        return None


def _cut(rnd: random.Random, t: str) -> str:
    body = t.rstrip("`\n *")
    n = max(1, int(len(body) * rnd.uniform(0.25, 0.97)))
    while n > 1 and body[n - 1] in ".。!?|\n ":
        n -= 1
    x = body[:n]
    if t.startswith("```") or "\n```" in x:
        return x + rnd.choice(["", "", "\n```", "..."])
    return x + rnd.choice(["", "", "", "...", "**" if t.startswith("**") else ""])


def _wrapped(rnd: random.Random, t: str) -> str:
    return rnd.choice([t, t, f"```\n{t}\n```", f"**{t}**", f"> {t}", f"Q: {t}", t + "\n\n[画像概要]", t.lower(), t.upper(), f"{t} {t}", json.dumps({"data": t}, ensure_ascii=False), t + "\n"])


def _refused(rnd: random.Random, lang: str, mined: list[str]) -> str:
    lang = lang if rnd.random() < 0.7 and lang in REFUSALS else rnd.choice(list(REFUSALS))
    if mined and rnd.random() < 0.75:
        return rnd.choice(mined)
    t = rnd.choice(REFUSALS[lang]) + (" " + TAIL[lang] if rnd.random() < 0.4 else "")
    return rnd.choice([t, t, f"```\n{t}\n```", json.dumps({"error": t}, ensure_ascii=False)])


def synthetic(sound: list[tuple[str, str, str]], mined: list[str], seed: int = 11) -> tuple[list[Pair], np.ndarray]:
    """Sound pairs and, for each, made defects."""
    rnd, out, y = random.Random(seed), [], []
    by: dict[tuple[str, bool], list[str]] = {}
    for p, q, a in sound:
        by.setdefault((language(p), table_rows(q) < 0), []).append(a)

    def add(p: str, q: str, a: str, *defects: str) -> None:
        out.append(Pair(p, q, a))
        y.append([float(d in defects) for d in DEFECTS])

    for p, q, a in sound:
        lang, vision = language(p), table_rows(q) < 0
        add(p, q, a)
        add(p, q, _cut(rnd, a), "truncated")
        if rnd.random() < 0.9:
            add(p, q, _refused(rnd, lang, mined), "refusal")
        if rnd.random() < 0.5:
            x = rnd.choice([p, p] if vision else [p, q, q, p + "\n" + q, _TAG.sub(" | ", q), re.sub(r' data-\w+="[^"]*"', "", q)])
            add(p, q, _wrapped(rnd, x), "copy")
        other = [k for k in by if k[0] != lang and k[1] == vision and k[0]]
        if lang and other and rnd.random() < 0.7:
            add(p, q, rnd.choice(by[rnd.choice(other)]), "language")
        if rnd.random() < 0.3 and table_rows(q) != 0:
            x = rnd.choice(["", " ", "\n\n", "N/A", "-", "...", "[画像概要]", "null", "[]", "{}", '{"data": []}', "```json\n\n```", "```yaml\n```", '{"data": null, "summary": ""}'])
            add(p, q, x, "empty")
    return out, np.array(y, dtype=np.float32)


def _opening(answer: str) -> str:
    """Letters of the first sentence."""
    text = re.sub(r'^\W*(error\W+)?', "", _FENCE.sub("", answer))
    return re.sub(r"[\W\d_]+", "", re.split(r"[.。!?](?:\s|$)|。", text, maxsplit=1)[0].lower())


def _fitted(judge: Judge, sound: list[tuple[tuple[str, str, str], Pair]], mined: list[str]) -> Model:
    """A defect model from sound pairs, calibrated on a fifth of the examples."""
    made, y = synthetic([r for r, _ in sound], mined)
    rows, model = [judge.row(p) for p in made], Model()
    held = np.arange(len(rows)) % 5 == 4
    if len(rows) > 5:
        model.fit([r for r, h in zip(rows, held) if not h], y[~held])
        model.calibrate([r for r, h in zip(rows, held) if h], y[held])
    return model


def train(sample: list[tuple[str, str, str]]) -> Judge:
    """A model from a sample of (prompt, question, answer)."""
    judge = Judge()
    pairs = [(r, Pair(*r)) for r in sample]

    def clear(p: Pair) -> bool:
        d = p.dense()
        return not (d["none"] or d["copied"] or d["open"] or d["inside"] or d["odd_fence"] or d["unstructured"] or d["mid"] or d["dots"]) and (p.rows != 0 or p.structured)

    sound = [(r, p) for r, p in pairs if clear(p)]
    mined = sorted({r[2] for r, p in pairs if p.rows > 0 and p.got == 0 and not p.empty() and not p.copied() and (not p.structured and not p.inside or isinstance(p.json, dict) and set(p.json) == {"error"})})
    told = {_opening(a) for a in mined} | {_opening(a) for own in REFUSALS.values() for a in own}
    mined += sorted({r[2] for r, _ in sound if _opening(r[2]) in told})
    sound = [(r, p) for r, p in sound if _opening(r[2]) not in told]
    judge.learn_languages([p for _, p in sound])
    # the sample has defects of its own: each half is cleared of them by the model of the other half
    halves = [_fitted(judge, sound[f::2], mined) for f in (0, 1)]
    sound = [(r, p) for i, (r, p) in enumerate(sound) if halves[1 - i % 2].scores(judge.row(p)).max() < 0.25]
    judge.model = _fitted(judge, sound, mined)
    return judge


# ---- Spark ----
def pair_table(llm_cache: DataFrame, vlm_cache: DataFrame, results: DataFrame, requests: DataFrame) -> DataFrame:
    """All pairs: src, pair_key, prompt, question, answer."""
    asked = requests.select("request_id", "cache_key", "system_prompt", "input_text")
    by_key = asked.groupBy("cache_key").agg(F.min(F.struct("system_prompt", "input_text")).alias("q"))
    by_id = asked.groupBy("request_id").agg(F.min(F.struct("system_prompt", "input_text")).alias("q"))
    llm = latest(llm_cache, ["cache_key"], ["ts", "loaded_at"], ["content"]).join(by_key, "cache_key", "left")
    llm = llm.select(F.lit("llm_cache").alias("src"), F.col("cache_key").alias("pair_key"), F.col("q.system_prompt").alias("prompt"), F.col("q.input_text").alias("question"), F.col("content").alias("answer"))
    vlm = latest(vlm_cache, ["cache_key"], ["ts", "loaded_at"], ["content"])
    prompt = F.regexp_extract("cache_key", r"(?s)^[^:]*:(.*):[^:]*$", 1)
    vlm = vlm.select(F.lit("vlm_cache").alias("src"), F.col("cache_key").alias("pair_key"), prompt.alias("prompt"), F.lit("").alias("question"), F.col("content").alias("answer"))
    res = latest(results.filter("not coalesce(is_simple, false)"), ["result_id"], ["loaded_at"], ["request_id", "_raw_data"]).join(by_id, "request_id", "left")
    res = res.select(F.lit("extraction_results").alias("src"), F.col("result_id").cast("string").alias("pair_key"), F.col("q.system_prompt").alias("prompt"), F.col("q.input_text").alias("question"), F.col("_raw_data").alias("answer"))
    return llm.unionAll(vlm).unionAll(res).filter("pair_key is not null")


def sample_pairs(llm_cache: DataFrame, vlm_cache: DataFrame, results: DataFrame, requests: DataFrame, size: int = SAMPLE) -> list[tuple[str, str, str]]:
    """About ``size`` pairs of each source, by hash of the key, never more than twice that."""

    def some(df: DataFrame, key: str) -> DataFrame:
        share = min(1.0, size / max(1, df.count()))
        return df.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000))

    df = pair_table(some(llm_cache, "cache_key"), some(vlm_cache, "cache_key"), some(results, "result_id"), requests)
    rows = df.limit(6 * size).collect()
    return [(r.prompt or "", r.question or "", r.answer or "") for r in sorted(rows, key=lambda r: (r.src, r.pair_key))]


def defects(llm_cache: DataFrame, vlm_cache: DataFrame, results: DataFrame, requests: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(src, pair_key, defect) of every defective pair."""
    judge = train(sample_pairs(llm_cache, vlm_cache, results, requests, sample))
    judge.ids = {}
    shared = llm_cache.sparkSession.sparkContext.broadcast((judge.lang.w, judge.model.w, judge.model.cut))
    pairs = pair_table(llm_cache, vlm_cache, results, requests)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        j = Judge()
        j.lang.w, j.model.w, j.model.cut = shared.value
        for b in batches:
            rows = []
            for s, k, p, q, a in zip(b["src"], b["pair_key"], b["prompt"], b["question"], b["answer"]):
                d = j.label(Pair(p, q, a))
                if d:
                    rows.append((s, k, d))
            yield pd.DataFrame(rows, columns=["src", "pair_key", "defect"])

    return pairs.mapInPandas(run, "src string, pair_key string, defect string")
