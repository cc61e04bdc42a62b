"""Grid, media, matching, chunks, Markdown, documents, caches and responses on small fixtures."""

import io
import zipfile
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetweave.operators import cache, chunks, documents, grid, markdown, match, media, model

CELL = "file_id string, sheet_idx int, sheet_name string, coord string, row_idx int, col_idx int, value string, formula string, unit string, style struct<borders: array<struct<side: string, line: string>>, bold: boolean>, colspan int, rowspan int"


def cells(spark, *rows):
    full = [("F", 0, "S", *r, None, None, None)[: 7] + (r[4] if len(r) > 4 else None, r[5] if len(r) > 5 else None, None, r[6] if len(r) > 6 else None, r[7] if len(r) > 7 else None) for r in rows]
    return spark.createDataFrame(full, CELL)


def test_merges_and_html(spark):
    c = cells(spark, ("A1", 1, 1, "head", None, None, 2, 1), ("A2", 2, 1, "1"), ("B2", 2, 2, None, "=SUM(A2)", "JPY"))
    box = grid.bounding_box(c, grid.ranges_of(c)).first()
    assert (box.max_row, box.max_col) == (2, 2)
    assert {(r.row_idx, r.col_idx, r.is_anchor) for r in grid.merged_cells(grid.ranges_of(c)).collect()} == {(1, 1, True), (1, 2, False)}
    html = grid.html_tables(c).first().html
    assert html.splitlines()[1:] == ['  <tr><td data-coord="A1" colspan="2">head</td></tr>', '  <tr><td data-coord="A2">1</td><td data-coord="B2" data-formula="=SUM(A2)" data-unit="JPY"></td></tr>', "</table>"]


def test_simple_tables(spark):
    c = cells(spark, ("A1", 1, 1, "id"), ("B1", 1, 2, "0"), ("C1", 1, 3, "id"), ("A2", 2, 1, "1"), ("B2", 2, 2, "x"), ("C2", 2, 3, "9"))
    c = c.withColumn("value_type", F.when(F.col("value").rlike("^[0-9]+$"), "n").otherwise("s"))
    assert grid.simple_sheets(c).first().is_simple
    assert {(r.header, r.value) for r in grid.simple_rows(c).collect()} == {("id", "9"), ("Column2", "x")}
    assert {(r.header, r.json) for r in grid.simple_rows(c.withColumn("value_type", F.lit("s"))).collect()} == {("id", '"9"'), ("0", '"x"')}
    assert not grid.simple_sheets(cells(spark, ("A1", 1, 1, "only"))).first().is_simple


MEDIA = "media_id long, file_id string, sheet_idx int, sheet_name string, idx int, coord string, filename string, visual_summary string, visual_data string, image_hash string"


def test_media(spark):
    m = spark.createDataFrame([(1, "F", 0, "S", 0, "A1", "s_img_0.png", None, "<x>", None), (2, "F", 0, "S", 1, "A1", "s_img_0.png", None, None, None), (3, "F", 0, "S", 2, None, None, None, None, None)], MEDIA)
    assert {(r.coord, tuple(r.filenames)) for r in media.media_map(m).collect()} == {("A1", ("s_img_0.png", "s_img_0.png")), ("unknown", (None,))}
    assert [r.media_id for r in media.unique_media(m).collect()] == [1]
    res = spark.createDataFrame([("F", "s_img_0.png", "seen", "")], "file_id string, filename string, visual_summary string, visual_data string")
    got = {r.media_id: (r.visual_summary, r.visual_data) for r in media.with_results(m, res).collect()}
    assert got == {1: ("seen", "<x>"), 2: ("seen", None), 3: (None, None)}
    html = spark.createDataFrame([("F", 0, '<td data-coord="A1">v</td>')], "file_id string, sheet_idx int, html string")
    assert media.with_insights(html, m).first().html == "<td data-coord=\"A1\"<div class='visual-insight'>[図表データ(A1)]: &lt;x&gt;</div>>v</td>"


def test_matches(spark):
    c = cells(spark, ("A1", 1, 1, "売上"), ("B2", 2, 2, " Total ", "=SUM(A1)", "JPY"), ("C3", 3, 3, "7"), ("D4", 4, 4, None), ("E5", 5, 5, "absent"))
    s = spark.createDataFrame([("F", "S", 0, "売上 and TOTAL 7"), ("F", "T", 1, "売上")], "file_id string, sheet_name string, section_no int, body string")
    hits = match.value_matches(s, c)
    assert {(r.section_no, r.coord) for r in hits.collect()} == {(0, "A1"), (0, "B2")}
    f = match.section_facts(hits).first()
    assert (f.coordinates, f.has_formulas, f.annotations) == ("A1:B2", True, "> ℹ️ セル B2 は計算式 `=SUM(A1)`（単位: JPY） から導出された集計値です。")
    m = spark.createDataFrame([(1, "F", 0, "S", 0, "B1", "x.png", None, None, None), (2, "F", 0, "S", 1, "Z9", "y.png", None, None, None)], MEDIA)
    assert [r.section_no for r in match.media_flags(s, match.section_facts(hits), m).collect()] == [0]


def test_associate_rules(spark):
    rows = spark.createDataFrame([("F", 1, "a1", None, None), ("F", 2, "C9", "B1", "C3"), ("F", 3, "H2", None, None), ("F", 4, "Q50", None, None), ("F", 5, None, None, None)], "file_id string, row_no int, coordinate string, area_start string, area_end string")
    m = spark.createDataFrame([("F", 0, "H6", "near"), ("F", 1, "A1", "exact"), ("F", 2, "B2", "area")], "file_id string, idx int, coord string, filename string")
    assert {r.row_no: (r.rule, r.filename) for r in match.associate(rows, m).collect()} == {1: (1, "exact"), 2: (2, "area"), 3: (3, "near")}


def fold(text, limit, overlap):
    """The fold in plain Python."""
    done, cur, n = [], [], 0
    for line in text.splitlines():
        if n + len(line) + 1 > limit and cur:
            done.append("\n".join(cur))
            cur = cur[-overlap:] if overlap > 0 and len(cur) >= overlap else []
            n = sum(len(x) + 1 for x in cur)
        cur, n = [*cur, line], n + len(line) + 1
    return done + (["\n".join(cur)] if cur else [])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\r漢|# ", max_size=60), min_size=1, max_size=8), st.integers(1, 30), st.integers(0, 4))
def test_chunks_fold(spark, texts, limit, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", chunks.fold_chunks(F.col("t"), limit, overlap).alias("c")).collect()}
    assert got == {i: fold(t, limit, overlap) for i, t in enumerate(texts)}


def test_sections_and_numbers(spark):
    df = spark.createDataFrame([("F", "pre\n# One\nx\n## sub\n# Two\n" + "y\n" * 5), ("G", None), ("H", "")], "file_id string, md string")
    s = chunks.with_sections(df, "md")
    assert [(r.section, r.body.splitlines()[0]) for r in s.orderBy("section_no").collect()] == [("全般", "pre"), ("One", "# One"), ("Two", "# Two")]
    c = chunks.chunked(s, ["file_id"], limit=9, overlap=1).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in c] == list(range(1, len(c) + 1)) and {r.total_chunks for r in c} == {len(c)}


def test_front_matter(spark):
    df = spark.createDataFrame([("a: b", "", None, False, 2)], "section string, coordinates string, sheet_name string, has_media boolean, chunk_index int")
    got = df.select(chunks.front_matter(F.struct(*df.columns))).first()[0]
    assert got == "---\nchunk_index: 2\nhas_media: false\nsection: 'a: b'\n---\n\n"


def test_markdown():
    kv, tb = markdown.Writer("kv"), markdown.Writer("table")
    assert kv.render({"sheets": {"S": {"P": [{"ID": 1, "N": "A"}]}, "E": None}}) == "# S\n\n## P\n- ID: 1, N: A"
    assert tb.render([{"a": 1, "b": "x|y"}, {"b": None, "a": True}]) == "| a | b |\n| --- | --- |\n| 1 | x\\|y |\n| True | None |"
    assert tb.render([{"a": 1}, {"b": 2}]) == "- - **a**: 1\n- - **b**: 2"
    assert tb.render({"_x": 1, "y": None, "z": [], "k": 2.5}) == "- **k**: 2.5"
    assert tb.render({"media": [{"filename": "p/x.png", "visual_summary": "[画像概要] s"}]}) == "## 関連メディア\n\n![画像](media/x.png)\n\n**[画像概要]**: s"
    assert tb.render(None) == "None" and tb.render([]) == ""


def test_html_and_images():
    assert documents.image_at("a ![x](p(1).png) b") == (2, 16, "x", "p(1).png")
    assert documents.image_at("![x] (p)") is None and documents.image_at("![x](p") is None
    got = documents.markdown_html("# T\n\n| a | b |\n|---|---|\n| <1> | **2** |\n- x\n-Item\n![i](p)")
    assert got == '<h1>T</h1>\n<table><tr><th>a</th><th>b</th></tr><tr><td>&lt;1&gt;</td><td><b>2</b></td></tr></table>\n<ul><li>x</li></ul>\n<p>-Item</p>\n<div class="image"><img src="p" alt="i"></div>'


def test_docx(spark):
    c = cells(spark, ("A1", 1, 1, "h", None, None, 2, 1), ("A2", 2, 1, "<v>"))
    data = documents.docx_files(c).first().docx
    xml = zipfile.ZipFile(io.BytesIO(bytes(data))).read("word/document.xml").decode()
    assert "[A2] &lt;v&gt;" in xml and '<w:gridSpan w:val="2"/>' in xml


def test_cache(spark):
    t = datetime
    old = spark.createDataFrame([("k", "a", t(2024, 1, 1), t(2024, 1, 9)), ("k", "b", t(2024, 1, 2), t(2024, 1, 2)), ("n", None, t(2024, 1, 1), t(2024, 1, 1))], "cache_key string, content string, ts timestamp, loaded_at timestamp")
    new = spark.createDataFrame([("k", "c", t(2024, 1, 3))], "cache_key string, content string, ts timestamp")
    both = cache.upsert(old, new)
    assert {(r.cache_key, r.content) for r in cache.current(both).collect()} == {("k", "c"), ("n", None)}
    asked = spark.createDataFrame([("k",), ("z",), (None,)], "cache_key string")
    assert {r.cache_key for r in cache.misses(asked, old).collect()} == {"z", None} and cache.cleared(old).count() == 0


RESPONSES = ['```json\n{"data": [1]}\n```', '{"data": {"a": 1}}', "```json\n[1, 2]\n```", "```yaml\ndata:\n  - a: 1\n```", '```json\n{"data": 5}\n```', "plain text", '{"rows": 1}', "```yaml\na: [\n```", None]


def test_responses(spark):
    df = spark.createDataFrame(list(enumerate(RESPONSES)), "i int, content string")
    got = {r.i: (r.data, r.error and r.error.split(":")[0]) for r in model.parsed(df).collect()}
    assert got == {0: ("[1]", None), 1: ('{"a":1}', None), 2: ("[1, 2]", None), 3: ('[{"a": 1}]', None), 4: (None, "Validation failed"), 5: (None, "Validation failed"), 6: ('{"rows": 1}', None), 7: (None, "Parse failed"), 8: (None, None)}


def test_extraction_with_a_fake(spark):
    s = spark.createDataFrame([("F", "A", "<table/>", False, None), ("F", "B", "<t2/>", False, None), ("F", "C", "", True, "[]")], "file_id string, sheet_name string, html string, is_simple boolean, simple_json string")
    first = model.extracted(s, model.FakeClient(), "m", "p").collect()
    assert {(r.sheet_name, r.error, r.data is None) for r in first} == {("A", None, False), ("B", None, False), ("C", None, False)}
    stored = spark.createDataFrame([(r.cache_key, '{"data": ["kept"]}', datetime(2024, 1, 1), datetime(2024, 1, 1)) for r in first if r.sheet_name == "A"], "cache_key string, content string, ts timestamp, loaded_at timestamp")
    again = {r.sheet_name: r.data for r in model.extracted(s, model.FakeClient(), "m", "p", stored).collect()}
    assert again["A"] == '["kept"]' and "chars" in again["B"]


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise model.ModelError("busy", 429)
        return "ok"

    assert model.with_retries(call, waits.append) == "ok" and waits == [2.0, 4.0]


def test_structured_report():
    cell = lambda coord, value, formula=None: {"coord": coord, "value": value, "formula": formula, "unit": "JPY"}
    data = {"summary": "s", "photos": [{"photo_no": "No.1", "title": "pump", "coordinate": "B2"}, {"title": "seal", "coordinate": "Z9"}], "total": "12", "more": {"who": "Ann", "list": ["x"]}}
    media_items = [{"coord": "B4", "filename": "p.png", "visual_summary": "seen", "bytes": b"1"}, {"coord": None, "filename": "q.png", "visual_summary": None, "bytes": None}]
    got = documents.structured_blocks(data, [cell("C1", " 12 ", "=SUM(A1)"), cell("D4", "by Ann")], media_items)
    assert got == [
        ("table", [["photo_no", "title", "coordinate", "ビジュアルインサイト"], ["[B2] No.1", "pump", "B2", "seen"], ["[Z9] ", "seal", "Z9", "なし"]]),
        ("p", "[C1] total: 12"), ("h3", "more"), ("p", "[D4] who: Ann"), ("h3", "list"), ("p", "x"), ("image", (b"1", "png")),
        ("p", "【図：No.1 pump (表中座標: B2 / 画像座標: B4)】"), ("p", "【図：q.png (画像座標: A1)】"), ("quote", "ℹ️ セル C1 は計算式 `=SUM(A1)`（単位: JPY） から導出された集計値です。"),
    ]
    with zipfile.ZipFile(io.BytesIO(documents.docx_bytes(got))) as z:
        assert z.read("word/media/image1.png") == b"1" and b"rImg1" in z.read("word/document.xml")
    assert documents.find_table({"data": [{"a": 1}]}) == ("data", [{"a": 1}]) and documents.find_table({"x": [1]}) == (None, [])
