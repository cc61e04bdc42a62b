"""Training-text operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import json
import random
import re
import unicodedata
from collections import Counter
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetweave.llm import leaks, lookalike, mojibake, packing, pairs, split, tokens

# ---- look-alikes ----
TERMS = [(1, "Peak flow rate"), (2, "ロータ長さ"), (3, "KK-338E"), (4, "Расход за рейс"), (5, "Volume m3"), (6, "Kühlhöhe"), (7, None), (8, "Peak flow rate")]
LOOKS = {
    "Peаk flоw rаte": 1, "Ｐｅａｋ　ｆｌｏｗ　ｒａｔｅ": 1, " Peak​ flow rate\n": 1, "ﾛｰﾀ長さ": 2, "口ー夕長さ": 2, "ロータ⾧さ": 2, "КΚ‑ЗЗ8E": None, "ΚК－338Ε": 3,
    "Pacxoд зa peйc": 4, "Расход за рейс": None, unicodedata.normalize("NFD", "Расход за рейс"): 4, "Volume m³": None, "volume m3": None, "Kuhlhohe": None,
    unicodedata.normalize("NFD", "Kühlhöhe"): 6, "Kühlhöhe": None, "": None, "\u200b": None,
}


def test_lookalikes(spark):
    rows = [(i, v) for i, v in enumerate([*LOOKS, None, *LOOKS])]
    cells = spark.createDataFrame(rows, "cell_id long, value string").withColumn("canonical", F.lit("clash"))
    terms = spark.createDataFrame(TERMS, "term_id long, term string")
    got = {(r.cell_id, r.term_id) for r in lookalike.meets(cells, terms).collect()}
    assert got == {(i, t) for i, v in rows if v is not None and LOOKS[v] for t in ([1, 8] if LOOKS[v] == 1 else [LOOKS[v]])}
    spelt = lookalike.normalised(cells, terms)
    assert spelt.count() == len(rows) and spelt.columns == ["cell_id", "value", "canonical", "canonical_"]
    by = {r.cell_id: r.canonical_ for r in spelt.collect()}
    assert by[0] == by[1] == by[2] == "Peak flow rate" and by[rows.index((len(LOOKS), None))] is None


def test_lookalikes_of_nothing(spark):
    none = spark.createDataFrame([], "cell_id long, value string")
    assert lookalike.meets(none, spark.createDataFrame(TERMS, "term_id long, term string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="Aаaο0 -口ロ卜゙​Ａé́", max_size=12), st.randoms())
def test_same_look_same_spelling(text, rnd):
    other = "".join(rnd.choice(lookalike.CLASS_OF.get(c, c)) for c in text)
    if lookalike.classes(text) == lookalike.classes(other):
        assert lookalike.canonical(text, {}) == lookalike.canonical(other, {})
    assert lookalike.canonical(lookalike.canonical(text, {}), {}) == lookalike.canonical(text, {})


# ---- splitting ----
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n\r 。́😀‍#|", max_size=90), st.integers(1, 15), st.integers(0, 4))
def test_pieces(text, limit, overlap):
    ps = split.pieces(text, limit, overlap)
    assert "".join(text[p:e] for _, e, p, _ in ps) == text
    assert all(e - s <= limit and (e > p or not text) and s <= p for s, e, p, _ in ps)
    assert all(b[2] == a[1] for a, b in zip(ps, ps[1:]))
    for (s, e, _, _), (s2, _, p2, _) in zip(ps, ps[1:]):
        own = split.LINE.split(text[s:e])
        ends = [s, *(s + m.end() for m in split.LINE.finditer(text[s:e])), e]
        starts = sorted({x for x in ends if s < x < e})
        want = starts[-overlap:] if overlap else []
        if len(want) == overlap and overlap and e - want[0] < limit and not (e < len(text) and text[e - 1 : e + 1] == "\r\n"):
            assert s2 == want[0] and split.shared_lines(text, s2, p2) == overlap, (own, want)


def test_pieces_cut_at_the_coarsest_limit():
    text = "# One\nline a\nline b\n\npara two. Next sentence here.\n# Two\nlast"
    ps = [text[s:e] for s, e, _, _ in split.pieces(text, 56, 0)]
    assert ps == ["# One\nline a\nline b\n\npara two. Next sentence here.\n", "# Two\nlast"]
    assert split.pieces("one two three", 8, 0)[0][:2] == (0, 8)
    shared = [text[s:p] for s, _, p, _ in split.pieces("\n".join(f"row {i}" for i in range(20)), 30, 2)]
    assert len(shared) > 3


def test_split_items(spark):
    opts = spark.createDataFrame([(1, 10, 1), (2, None, None)], "option_id int, max_chunk_chars int, chunk_overlap_lines int")
    items = spark.createDataFrame([(1, 1, "a b c d e f g h"), (2, 1, "short"), (3, 2, "x" * 1001), (4, 9, "y" * 1000), (5, 1, None), (6, 1, ""), (1, 1, "a b c d e f g h"), (7, None, "😀" * 1001)], "item_no long, option_id int, content string").withColumn("piece", F.lit(0))
    assert sorted(r.item_no for r in split.oversized(items, opts).collect()) == [1, 3, 7]
    got = split.split_items(items, opts).collect()
    assert {(r.item_no, r.piece) for r in got if r.item_no in (2, 5, 6)} == {(2, "short"), (5, None), (6, "")}
    assert split.split_items(items.limit(0), opts).count() == 0


# ---- pairs ----
SHEET = '<table><tr><td><b>part</b></td><td><b>n</b></td></tr><tr><td>bolt</td><td>1</td></tr><tr><td>nut</td><td>2</td></tr></table>'
GOOD = '```json\n{"data": [{"part": "bolt", "n": 1}, {"part": "nut", "n": 2}], "summary": "Two parts."}\n```'


def test_pair_checks():
    p = lambda a, q=SHEET, pr="List the rows of the sheet.": pairs.Pair(pr, q, a)
    assert all(p(a).empty() for a in (None, "", " \n", "N/A", "{}", '{"data": []}', "```yaml\n```", '{"data": null, "summary": ""}'))
    assert not any(p(a).empty() for a in (GOOD, "no", '{"data": [', '{"error": "x"}'))
    assert not p(None, SHEET.split("</tr>")[0] + "</tr></table>").empty()
    assert all(p(a).copied() for a in ("> list the rows of the sheet.", SHEET, "```html\n" + SHEET + "\n```", "part n bolt 1 nut 2", '{"data": "List the rows of the sheet."}', "List the rows of the sheet. List the rows of the sheet."))
    assert p("Why? Why?", "", "Why?").copied() and p("Why?", "", "Why?").copied() and not p("Why not", "", "Why?").copied()
    assert p("part n", '<table data-x="' + "y" * 500 + '"><tr><td>part</td><td>n</td></tr></table>').copied()
    assert pairs.language("Describe the Germany-wide results of the sheet.") == "en" and pairs.language("Answer in German.") == "de"
    assert not any(p(a).copied() for a in (GOOD, "List the rows of the sheet.\n" + GOOD, "part", None))
    assert pairs.language("この表を英語で答えること。") == "en" and pairs.language("Was zeigt das?") == "de" and pairs.language(None) == ""
    assert pairs.table_rows(SHEET) == 2 and pairs.table_rows("") == -1


def test_pairs_end_to_end(spark):
    """Made pairs with known defects; the whole way through Spark."""
    rnd = random.Random(5)
    say = {
        "en": ("List the rows of the sheet and sum up.", "The sheet holds {} parts in hall {}."), "de": ("Lies das Blatt und fasse die Zeilen zusammen.", "Das Blatt enthält {} Teile in Halle {}."),
        "es": ("Lee esta hoja y muestra las filas.", "La hoja contiene {} piezas en la nave {}."),
    }
    q, llm, truth = [], [], {}
    for i in range(420):
        lang = rnd.choice(list(say))
        rows = [(f"part{rnd.randrange(9)}", rnd.randrange(100)) for _ in range(3)]
        html = f'<table data-req="{i}"><tr><td><b>part</b></td><td><b>n</b></td></tr>' + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in rows) + "</table>"
        made = lambda x: json.dumps({"data": [{"part": a, "n": b} for a, b in rows], "summary": " ".join(say[x][1].format(rnd.randrange(99), rnd.randrange(9)) for _ in range(2))}, ensure_ascii=False)  # noqa: E731,B023
        answer, kind = made(lang), rnd.random()
        if kind < 0.06:
            answer, truth[str(i)] = rnd.choice(["", None, "{}"]), "empty"
        elif kind < 0.12:
            answer, truth[str(i)] = pairs.REFUSALS[lang][rnd.randrange(3)], "refusal"
        elif kind < 0.18:
            answer, truth[str(i)] = say[lang][0], "copy"
        elif kind < 0.24:
            answer, truth[str(i)] = made(rnd.choice([x for x in say if x != lang])), "language"
        elif kind < 0.30:
            answer, truth[str(i)] = answer[: len(answer) // 2], "truncated"
        q.append((i, str(i), say[lang][0], html))
        llm.append((str(i), answer, datetime(2024, 1, 2), datetime(2024, 1, 2)))
        if i % 50 == 0:
            llm.append((str(i), "older, not counted", datetime(2024, 1, 1), datetime(2024, 1, 3)))
    req = spark.createDataFrame(q, "request_id long, cache_key string, system_prompt string, input_text string")
    cache = spark.createDataFrame(llm, "cache_key string, content string, ts timestamp, loaded_at timestamp").withColumn("defect", F.lit("clash"))
    vlm = cache.limit(0)
    res = spark.createDataFrame([(1, 3, True, None, datetime(2024, 1, 1)), (2, 4, False, None, datetime(2024, 1, 1)), (3, None, False, '{"data": [', datetime(2024, 1, 1))], "result_id long, request_id long, is_simple boolean, _raw_data string, loaded_at timestamp")
    got = {(r.src, r.pair_key): r.defect for r in pairs.defects(cache, vlm, res, req).collect()}
    hit = sum(got.get(("llm_cache", k)) == d for k, d in truth.items())
    wrong = [k for s, k in got if s == "llm_cache" and k not in truth]
    assert hit >= 0.95 * len(truth) and len(wrong) <= 0.02 * len(q)
    assert got[("extraction_results", "2")] == "empty" and ("extraction_results", "1") not in got


# ---- packing ----
@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b ", " ", "\n", "\r\n", "'s", "1", ".", "é", " x", "日本語" * 20, "\t", "\xa0", "word"]), max_size=14))
def test_counts_are_the_tokenizers(counter, parts):
    text = "".join(parts)
    assert counter(text) == counter(text) == len(counter.enc.encode_ordinary(text))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(0, 3))
def test_pack(sizes, sep):
    sizes = sorted(sizes, reverse=True)
    where, place, used = packing.pack(sizes, 100, sep)
    held = {}
    for s, k, p in zip(sizes, where, place):
        held.setdefault(k, []).append((p, s))
    assert len(held) == used and all(sum(s for _, s in h) + sep * (len(h) - 1) <= 100 for h in held.values())
    assert all(sorted(p for p, _ in h) == list(range(1, len(h) + 1)) for h in held.values())


def test_the_cost_decides():
    rnd = random.Random(1)
    sizes = sorted((rnd.randrange(1, 1000) for _ in range(400)), reverse=True)
    by_cost, by_size = packing.balanced(sizes, 1000, 1), packing.balanced(sizes, 1000, 1, lambda t: t)
    assert by_cost != by_size
    for held in (by_cost, by_size):
        assert sum(sizes) / (1000 * len(held)) > 0.95
    # brute force: the cheapest with room at each step
    held, total = [], []
    for i, s in enumerate(sizes):
        some = [k for k, h in enumerate(held) if sum(sizes[j] for j in h) + len(h) + s <= 1000]
        k = min(some, key=lambda k: (total[k], k)) if some else len(held)
        if not some:
            held.append([])
            total.append(0.0)
        held[k].append(i)
        total[k] += packing.cost(s)
    assert held == by_cost


def test_packed(spark, counter):
    docs = spark.createDataFrame([(i, "word " * n) for i, n in enumerate([0, 5, 9, 30, 31, 100, 3, 3, 3])] + [(99, None), (5, "word " * 100)], "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([(1, 32, 1), (2, 1000, 0)], "target_id int, capacity_tokens int, separator_tokens int")
    got = packing.packed(docs, targets, docs_per_shard=4).collect()
    for t, cap, sep in ((1, 32, 1), (2, 1000, 0)):
        mine = [r for r in got if r.target_id == t]
        assert {r.doc_id for r in mine} == {*range(9), 99}
        for d, text in ((i, "word " * n) for i, n in enumerate([0, 5, 9, 30, 31, 100, 3, 3, 3])):
            ps = sorted((r.token_start, r.token_end) for r in mine if r.doc_id == d)
            assert ps[0][0] == 0 and ps[-1][1] == counter(text) and all(a[1] == b[0] for a, b in zip(ps, ps[1:]))
            assert len(ps) == max(1, -(-counter(text) // cap))
        full = {}
        for r in mine:
            if r.container_no is not None:
                full.setdefault(r.container_no, []).append(r.token_end - r.token_start)
        assert all(sum(v) + sep * (len(v) - 1) <= cap for v in full.values())
        assert {r.doc_id for r in mine if r.container_no is None} == {0, 99}
    assert packing.packed(docs.limit(0), targets).count() == 0


# ---- leaks ----
def test_leaks(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    stock = "it is known that the".split()
    items = [(i, "en", " ".join(stock + [rnd.choice(vocab) for _ in range(30)] + stock)) for i in range(20)] + [(90, "en", "too short to leak"), (91, "ja", "".join(rnd.choice("日月火水木金土山川田") for _ in range(80))), (92, None, None)]
    docs, truth = [], set()
    for d in range(120):
        words = [rnd.choice(vocab) for _ in range(60)] + stock
        if d % 4 == 0:
            i, n = rnd.randrange(20), rnd.choice([13, 14, 15, 16, 30])
            w = items[i][2].split()
            at = rnd.randrange(len(w) - n + 1)
            words[20:20] = [x.upper() + rnd.choice(["", ",", " –", "\n"]) for x in w[at : at + n]]
        docs.append((d, " ".join(words)))
    ja = items[21][2]
    docs += [(200, "前文。" + ja[:20] + "、\n" + ja[20:41] + "後"), (201, ja[:39]), (202, None), (203, ""), (0, docs[0][1])]
    for d, text in docs:
        for i, lang, it in items:
            u = leaks.units(it, lang) if it else []
            n = leaks.CHARS if lang == "ja" else leaks.WORDS
            t = leaks.squash(text or "") if lang == "ja" else " " + " ".join(leaks.units(text or "", "en")) + " "
            if any((("".join(u[k : k + n])) if lang == "ja" else f" {' '.join(u[k : k + n])} ") in t for k in range(len(u) - n + 1)):
                truth.add((d, i))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = leaks.leaks(df, spark.createDataFrame(items, "item_id long, lang string, item_text string")).filter("leaked")
    assert {(r.doc_id, r.item_id) for r in got.collect()} == truth and len(truth) > 8
    blocks = leaks.leaks(df, spark.createDataFrame(items, "item_id long, lang string, item_text string"), block_items=7).filter("leaked")
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == truth


def test_edited_copies_are_reported(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(50)]
    text = words.copy()
    text[9::10] = ["edited"] * 5
    docs = spark.createDataFrame([(1, "before " + " ".join(text) + " after"), (2, " ".join(rnd.sample(words, 50)))], "doc_id long, text string")
    got = {r.doc_id: r for r in leaks.leaks(docs, spark.createDataFrame([(7, "en", " ".join(words))], "item_id long, lang string, item_text string")).collect()}
    # no window of 15 words stands there, but seeds do
    assert got[1].kind == "edited" and not got[1].leaked and got[1].share > 0.8 and 2 not in got


def test_alignment():
    a = "a b c d e f".split()
    assert leaks.align(a, "x a b c x e f y".split())[0] == 2 * 5 - 1
    assert leaks.align(a, ["q"])[0] == 0 and leaks.align(a, [])[0] == 0


# ---- garbled encodings ----
PLAIN = {
    "en": "A second “control board” 23 may be added – it doesn’t exceed 50 ± 3 µm at 20 °C. ", "de": "Der Kühlkörper drückt über die Fläche, Maß höchstens 5 µm. ",
    "fr": "Procédé de réglage où l’élément est prévu à côté. ", "ru": "Устройство содержит корпус насоса и радиатор. ", "ja": "放熱体は外縁に沿って接着されている。請求項1に記載の装置。",
}
SWAPS = [("en", "utf-8", "cp1252"), ("de", "utf-8", "cp437"), ("de", "utf-8", "mac_roman"), ("ru", "utf-8", "cp1251"), ("ru", "cp1251", "cp866"), ("ru", "koi8_r", "cp1251"), ("de", "cp1252", "cp850"), ("fr", "utf-8", "latin-1"), ("ja", "euc_jp", "latin-1")]


def test_garbled(spark):
    docs, want = [], {}
    for i in range(200):
        lang = list(PLAIN)[i % 5]
        docs.append((i, PLAIN[lang] * 3 + f"Teil {i}", "a"))
    for k, (lang, true, wrong) in enumerate(SWAPS):
        text = PLAIN[lang].replace("’", "'") if true != "utf-8" else PLAIN[lang]
        want[1000 + k] = text * 2
        docs.append((1000 + k, (text * 2).encode(true).decode(wrong, "strict" if wrong != "cp1252" else "replace") if wrong != "cp1252" else "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in (text * 2).encode(true)), "b"))
    docs += [(2000, PLAIN["de"].encode("cp1252").decode("utf-8", "replace"), None), (2001, None, "a"), (2002, "", "a"), (2003, "It shows “Ã¤” where “ä” was meant. " + PLAIN["en"], "a"), (2004, "SÃO TOMÁS – AÇÃO Nº 21. Keys Ø, Æ, Å, ß, Ÿ and ¿.", "a"), (2005, "┌──┬──┐ │22│83│ └──┴──┘", "a"), (1000, docs[200][1], "b")]
    g = mojibake.Garbled(spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("id", F.lit("clash")))
    assert {r.id for r in g.found().collect()} == {*want, 2000}
    back = {r.id: r.original for r in g.restored().collect()}
    exact = sum(back[k] == v for k, v in want.items())
    assert exact >= len(want) - 1 and back[2000].startswith("Der Kühlkörper")


def test_plain_looking_images_are_found(spark):
    """Images of letters and signs that are proper characters elsewhere, as in documents 281, 5426, 5109, 4470 and 5027 of sf0.1."""
    docs = [(i, PLAIN[lang] * 3 + f"Teil {i}, Диск муфты", "a") for i, lang in enumerate(list(PLAIN) * 40)]
    docs += [(500 + i, f"Below 48{i} µm and 13{i} °C the clutch disengages. " * 3, "a") for i in range(40)]
    bad = {900: "a depth of 288 Вµm after", 901: "(493) at 593 Вµm.", 902: "(910) at 869 В°C.", 903: "Below 486 ¡C the clutch", 904: "(745) at 133 ¡C."}
    fine = {950: "the map\xa0drawer and the\xa0other; near\xa0the\xa0bridge", 951: "Диск муфты. Диск муфты. Диск муфты."}
    docs += [(i, t, "b") for i, t in (bad | fine).items()]
    assert {r.id for r in mojibake.Garbled(spark.createDataFrame(docs, "doc_id long, text string, source string")).found().collect()} == set(bad)


def test_images_of_kana_may_be_japanese():
    for true, wrong in mojibake.CJK:
        if true != "utf-8" and wrong not in ("cp932", "euc_jp"):
            page = mojibake.pages()[wrong]
            show = lambda raw: "".join(chr(b) if b < 128 else page[b - 128] for b in raw)  # noqa: E731,B023
            assert all(mojibake._cjk_possible(show((c * 2).encode(true)), true, wrong) for c in "あいのをんアイノヲンー、。")


def _wrongly(text, table):
    return text.translate({ord(a): b for a, b in table.items()})


def test_pages_beyond_the_common_ones(spark):
    """Swaps that no list names: two pages of Python's, and a page that exists nowhere, learnt letter by letter."""
    rnd = random.Random(2)
    cs = {"cs": "Šroub příčného nosníku drží žlab při běžném zatížení, což není měřeno. ", **PLAIN}
    cs["de"] = "Kühler Tür für über grün müde Brücke Stück öffnen schön Größe Höhe Löcher mögen hören Wärme Länge Fläche später wählen Bär Käse Straße groß Fuß heiß weiß Maß außen das Teil und die Welle mit dem Rad ist nicht an der Wand"
    parts = {k: v.split() for k, v in cs.items()}
    say = lambda k: " ".join(rnd.choice(parts[k]) for _ in range(40))
    docs = [(i, say(list(cs)[i % 6]), "a") for i in range(3000)]
    made = {"ü": "ǁ", "ö": "ɷ", "ä": "ʘ", "ß": "ɞ"}  # in no page
    want = {}
    for k in range(8):
        for base, lang, spell in ((10000, "cs", lambda t: t.encode("iso8859_2", "ignore").decode("cp1252", "replace")), (20000, "de", lambda t: t.encode("cp1252").decode("cp1251", "replace")), (30000, "de", lambda t: _wrongly(t, made))):
            text = say(lang).replace("µ", "u")
            want[base + k] = text
            docs.append((base + k, spell(text), f"source {base}"))
    g = mojibake.Garbled(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    back = {r.id: r.original for r in g.restored().collect()}
    for base in (10000, 20000, 30000):
        mine = [i for i in want if i // 10000 == base // 10000]
        assert sum(i in back for i in mine) >= (0.5 if base == 30000 else 0.9) * len(mine), base
        was = {i: x for i, x, _ in docs}
        changed = [(a, b) for i in mine if i in back for a, b, c in zip(want[i], back[i], was[i]) if b != c]
        assert sum(a == b for a, b in changed) >= 0.7 * len(changed) > 0, base
    assert not {i for i in back if i < 3000}
    assert any(k[1] == mojibake.FREE or v for k, v in g.tables.value.items())


def test_losses_and_mentions(spark):
    docs = [(i, PLAIN[lang] * 3 + f"Teil {i}", "a") for i, lang in enumerate(list(PLAIN) * 20)]
    docs += [(500, "The mark “\ufffd” stands for what was lost (\ufffd).", "b"), (501, "A gap of 70 \ufffd 4 mm remains.", "b"), (502, "Der K\ufffdhlk\ufffdrper dr\ufffdckt.", None), (503, "U+FFFD is written \ufffd in this text.", "b")]
    assert {r.id for r in mojibake.Garbled(spark.createDataFrame(docs, "doc_id long, text string, source string")).found().collect()} == {501, 502}


def test_every_swap_of_a_text_is_undone(spark):
    docs = [(i, PLAIN[lang] * 3 + f"Teil {i}", "a") for i, lang in enumerate(list(PLAIN) * 40)]
    docs += [(500 + i, "Испытания. Описание. " * 3, "a") for i in range(40)]
    de = PLAIN["de"]
    two = de.encode().decode("cp1252", "replace") + "\n" + de + "\n" + de.encode("cp1252").decode("cp850")
    docs += [(900, two, "b"), (901, de.encode().decode("mac_roman") + "\n" + "Fl\ufffdche. " + de, "b"), (902, PLAIN["ja"] + "\ufffd\ufffd\ufffd" + PLAIN["ja"] + "\ufffd。", "b"), (903, (PLAIN["ru"] + "Испытания. ").encode().decode("cp1251", "replace"), "b")]
    back = {r.id: r for r in mojibake.Garbled(spark.createDataFrame(docs, "doc_id long, text string, source string")).restored().collect()}
    assert back[900].original == de + "\n" + de + "\n" + de
    assert back[901].swap == "utf-8>mac_roman" and back[901].original.startswith(de)
    assert back[902].original == docs[-2][1]
    assert back[903].original == PLAIN["ru"] + "Испытания. "


def _bigrams(texts):
    lut, k = mojibake.class_table()
    ids = [lut[[ord(c) for c in t]] for t in texts]
    return mojibake.Bigrams(Counter(int(a) * k + int(b) for i in ids for a, b in zip(i, i[1:])))


def test_every_start_that_gains_is_a_candidate():
    """However many there are, and of equal ones all."""
    lm = _bigrams([PLAIN[lang] * 3 for lang in list(PLAIN) * 40])
    starts = mojibake.Starts(lm)
    few = " ".join(["”стройство"] * 4)  # tokens that hardly surprise gain together
    for text, gains, pairs in ((PLAIN["ru"].encode("koi8_r").decode("cp1252"), 9, 9), (PLAIN["de"].encode("cp1252").decode("cp850"), 2, 9), (few, 1, 4)):
        (spans,) = mojibake.tokens_of([text], lm)
        got = {c[0]: c[1] for c in mojibake.candidates(text, spans, lm, starts)[0]}
        want = {}
        for true in starts.pages:
            for wrong in starts.pages:
                best = now = 0.0
                for m in re.finditer(r"[^\x00-\x20]*[^\x00-\x7f][^\x00-\x20]*", text):
                    at = [i for i, c in enumerate(text) if m.start() <= i < m.end() and c > "\x7f"]
                    ring = text[max(0, at[0] - 1) : at[-1] + 2]
                    lo = min(1, at[0])
                    t = mojibake.token_gains(ring, lo, at[-1] + 1 - at[0] + lo, min(2, sum(c.isascii() and c.isalnum() for c in m.group())), False, lm, starts)
                    now = max(now, 0.0) + float(t.gain[starts.pages.index(true), t.group[starts.pages.index(wrong)]])
                    best = max(best, now)
                if best >= mojibake.LEAST_GAIN + 0.001:
                    want[f"{true}>{wrong}"] = best
        assert len({round(d, 3) for d in want.values()}) >= gains and len(want) >= pairs
        assert {s: round(want[s], 2) for s in want} == {s: pytest.approx(got.get(s, 0.0), abs=0.02) for s in want}


def test_a_source_decides_between_starts_of_equal_gain(spark):
    """A short text that several pages explain alike counts for the one that its source goes through, and isn't lost to the first of them."""
    docs = [(i, PLAIN[lang] * 3 + f"Teil {i}", "a") for i, lang in enumerate(list(PLAIN) * 80)]
    docs += [(500 + i, (PLAIN["de"] + f"Teil {i}").encode("cp1252").decode("cp850"), "b") for i in range(20)]
    docs += [(600, "A gap of 50 ± 3 mm.".encode("cp1252").decode("cp850"), "b")]
    back = {r.id: r for r in mojibake.Garbled(spark.createDataFrame(docs, "doc_id long, text string, source string")).restored().collect()}
    assert {i: r.swap for i, r in back.items()} == dict.fromkeys([*range(500, 520), 600], "cp1252>cp850")
    assert back[600].original == "A gap of 50 ± 3 mm."


def test_utf8_gains_in_every_page_that_has_its_bytes():
    lm = _bigrams([PLAIN[lang] * 3 for lang in list(PLAIN) * 40] + ["Größe 5 ğ für Çok büyük şey"] * 20)
    starts = mojibake.Starts(lm)
    text = "Der Kühlkörper drückt, doğru".encode().decode("cp1254")
    (spans,) = mojibake.tokens_of([text], lm)
    got = {c[0]: c[1] for c in mojibake.candidates(text, spans, lm, starts)[0]}
    assert got["utf-8>cp1254"] >= got["utf-8>cp1252"] >= mojibake.LEAST_GAIN


def test_a_token_is_held_against_the_pairs_once(monkeypatch):
    """However often a text repeats it."""
    lm = _bigrams([PLAIN[lang] * 3 for lang in list(PLAIN) * 40])
    starts = mojibake.Starts(lm)
    text = " " + PLAIN["ru"].encode("koi8_r").decode("cp1252") * 50
    (spans,) = mojibake.tokens_of([text], lm)
    first = mojibake.candidates(text, spans, lm, starts)
    calls, of = [], mojibake.Token.of
    monkeypatch.setattr(mojibake.Token, "of", lambda self, *args: calls.append(1) or of(self, *args))
    assert mojibake.candidates(text, spans, lm, starts) == first and first[0]
    assert len(calls) <= len(set(text.split()))


@given(st.lists(st.text("aZ5 ６.\n\xa0éüÃ¤µ°дЖ縺の、ｱ\ufffd\u2003", max_size=30), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_tokens_of_many_texts(texts):
    lm = _bigrams(list(PLAIN.values()))
    between = re.compile(f"[{mojibake._BREAK}]")
    for text, got in zip(texts, mojibake.tokens_of(texts, lm), strict=True):
        want, joined = [], []
        for m in re.finditer(f"[^{mojibake._BREAK}]+", text):
            a, b = m.span()
            at = [i for i in range(a, b) if text[i] > "\x7f"]
            if not at:
                continue
            assert not between.search(m.group())
            around = f"\x00{text}\x00"
            links = sorted({i for x in at for i in (x, x + 1)})
            cost = -sum(float(lm.logp[lm.lut[ord(around[i])], lm.lut[ord(around[i + 1])]]) for i in links) / len(links)
            known = sum(c.isascii() and c.isalnum() for c in m.group())
            number = not known and text[max(0, a - 2) : a].strip().isdigit() and text[b : b + 2].strip().isdigit()
            lo = at[0] > 0
            want.append((a, b, pytest.approx(cost, abs=1e-4), at[0] - lo, at[-1] + 2, min(known, 2) + 3 * number + 6 * lo))
            if any(x + 1 in at for x in at):
                joined.append(want[-1])
        odd = [x for x in want if x[2].expected > mojibake.SURPRISE]
        assert got is None if not odd and not joined else (got.all, got.odd, got.joined) == (want, odd, joined)


def test_a_short_stretch_of_japanese_is_undone_beside_a_long_one_of_another_swap(spark):
    docs = [(i, PLAIN[lang] * 3 + f"Teil {i}", "a") for i, lang in enumerate(list(PLAIN) * 40)]
    docs += [(900 + i, (PLAIN["ru"] * 8).encode().decode("cp1251", "replace") + "\n" + PLAIN["ja"].encode("euc_jp").decode("latin-1"), "b") for i in range(2)]
    back = {r.id: r for r in mojibake.Garbled(spark.createDataFrame(docs, "doc_id long, text string, source string")).restored().collect()}
    assert set(back) == {900, 901}
    for r in back.values():
        assert r.swap == "utf-8>cp1251" and r.original.endswith("\n" + PLAIN["ja"])


def test_a_word_is_scored_once(monkeypatch):
    lm = _bigrams(list(PLAIN.values()))
    text = PLAIN["de"].encode().decode("cp1252", "replace") * 50
    first = mojibake.undo(text, "utf-8>cp1252", lm)
    calls, ids = [], mojibake.Bigrams.ids
    monkeypatch.setattr(mojibake.Bigrams, "ids", lambda self, s: calls.append(s) or ids(self, s))
    assert mojibake.undo(text, "utf-8>cp1252", lm) == first and first[1] > 0
    assert not calls


def test_garbled_of_nothing(spark):
    assert mojibake.Garbled(spark.createDataFrame([], "doc_id long, text string, source string")).found().count() == 0


def test_nfc_of_restored():
    assert unicodedata.is_normalized("NFC", PLAIN["fr"])
