"""Workbooks written with the standard library, read through Spark, streamed, and taken through the engine."""

import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from sheetweave import engine
from sheetweave.operators.model import FakeClient
from sheetweave.sources import xlsx
from sheetweave.streaming import folder

M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR"
STYLES = f'<styleSheet {M}><numFmts><numFmt numFmtId="164" formatCode="&quot;¥&quot;#,##0"/></numFmts><fonts><font/><font><b/></font></fonts><fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFCCE5FF"/></patternFill></fill></fills><borders><border/><border><left/><right/><top style="thick"/><bottom style="thin"/></border></borders><cellXfs><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/><xf numFmtId="164" fontId="1" fillId="1" borderId="1"/><xf numFmtId="14" fontId="0" fillId="0" borderId="0"/></cellXfs></styleSheet>'
SHEET1 = f"""<worksheet {M}><sheetData><row r="1"><c r="A1" t="s" s="1"><v>0</v></c><c r="B1"/></row>
<row r="2"><c r="A2" s="1"><v>1500</v></c><c r="B2" s="1"><f>SUM(A2,A3)</f><v>1500.5</v></c><c r="C2" s="2"><v>45292</v></c></row>
<row r="3"><c r="A3" t="b"><v>1</v></c><c r="B3" t="e"><v>#REF!</v></c><c r="C3" t="inlineStr"><is><t>in &lt;line&gt;</t></is></c><c r="D3"><f>UNKNOWN_REF</f></c></row></sheetData>
<mergeCells><mergeCell ref="A1:C1"/></mergeCells><drawing r:id="rId1"/></worksheet>"""
SHEET2 = f'<worksheet {M}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>name</t></is></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>bolt</t></is></c><c r="B2"><v>7</v></c></row></sheetData></worksheet>'


def write(path, extra=""):
    parts = {
        "xl/workbook.xml": f'{extra}<workbook {M}><sheets><sheet name="報告" sheetId="1" r:id="rId1"/><sheet name="Plain" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {REL}><Relationship Id="rId1" Type="t/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="t/worksheet" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {M}><si><r><t>テスト</t></r><r><t>データ</t></r><rPh><t>ふりがな</t></rPh></si></sst>",
        "xl/styles.xml": STYLES,
        "xl/worksheets/sheet1.xml": SHEET1,
        "xl/worksheets/sheet2.xml": SHEET2,
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships {REL}><Relationship Id="rId1" Type="t/drawing" Target="../drawings/drawing1.xml"/></Relationships>',
        "xl/drawings/drawing1.xml": '<d:wsDr xmlns:d="d" xmlns:a="a" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><d:oneCellAnchor><d:from><d:col>2</d:col><d:row>4</d:row></d:from><d:pic><a:blip r:embed="rId1"/></d:pic></d:oneCellAnchor><d:oneCellAnchor><d:from><d:col>0</d:col><d:row>0</d:row></d:from><d:pic><a:blip r:embed="rId2"/></d:pic></d:oneCellAnchor></d:wsDr>',
        "xl/drawings/_rels/drawing1.xml.rels": f'<Relationships {REL}><Relationship Id="rId1" Type="t/image" Target="../media/image1.png"/><Relationship Id="rId2" Type="t/image" Target="../media/image2.bin"/></Relationships>',
    }
    with zipfile.ZipFile(path, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
        z.writestr("xl/media/image1.png", PNG)
        z.writestr("xl/media/image2.bin", b"????")


@pytest.fixture(scope="module")
def books(tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    write(d / "good.xlsx")
    write(d / "hostile.xlsx", '<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]>')
    (d / "broken.xlsx").write_bytes(b"no zip")
    return str(d)


def test_cells(spark, books):
    got = {(r.sheet_name, r.coord): r for r in xlsx.read_cells(xlsx.files(spark, books)).collect() if r.error is None}
    a1 = got[("報告", "A1")]
    assert (a1.value, a1.colspan, a1.rowspan, a1.bold, a1.fill) == ("テストデータ", 3, 1, True, "FFCCE5FF")
    assert [(b.side, b.line) for b in a1.borders] == [("top", "thick"), ("bottom", "thin")]
    b2 = got[("報告", "B2")]
    assert (b2.value, b2.formula, b2.number_format) == ("1500.5", "=SUM(A2,A3)", '"¥"#,##0')
    values = {k[1]: (r.value, r.value_type) for k, r in got.items() if k[0] == "報告"}
    assert values["C2"] == ("2024-01-01T00:00:00", "d") and values["A3"] == ("True", "b") and values["B3"] == ("#REF!", "e") and values["C3"] == ("in <line>", "s") and values["D3"] == (None, "null")
    assert got[("Plain", "B2")].value == "7"


def test_bad_files_are_rows(spark, books):
    bad = {r.source_file: r.error.split(":")[0] for r in xlsx.read_cells(xlsx.files(spark, books)).filter("error is not null").collect()}
    assert bad == {"hostile.xlsx": "RefusedXml", "broken.xlsx": "BadZipFile"}


def test_media_and_size_guard(spark, books):
    got = {r.idx: (r.coord, r.filename, r.error) for r in xlsx.read_media(xlsx.files(spark, books)).filter("source_file = 'good.xlsx'").collect()}
    assert got == {0: ("C5", "報告_img_0.png", None), 1: ("A1", None, "unidentified_format")}
    assert xlsx.files(spark, books, max_mb=0).count() == 0 and xlsx.oversized(spark, books, max_mb=0).count() == 3


def test_stream_reads_each_file_once(spark, books, tmp_path):
    for _ in range(2):
        folder.run(spark, books, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    df = spark.read.parquet(str(tmp_path / "out"))
    assert df.select("batch").distinct().count() == 1 and df.filter("coord = 'A1' and sheet_name = 'Plain'").count() == 1


def test_engine(spark, books, tmp_path):
    e = engine.Engine(spark, FakeClient(), cache_path=str(tmp_path / "cache"))
    for _ in range(2):  # the second time from the cache
        got = {r.sheet_name: json.loads(r.data) for r in e.extract_structured_data(books).collect()}
        assert got["Plain"] == {"data": [{"name": "bolt", "n": 7}]} and got["報告"][0]["model"] == "gemini-1.5-flash"
    c = e.extract_rag_chunks(books, engine.ExtractionOptions(include_logic=True), extraction_date="2024-01-01").collect()
    assert {r.metadata.sheet_name for r in c} == {"Plain", "報告"} and all(r.metadata.total_chunks >= 1 for r in c)
    assert bytes(e.extract_docx(books).first().docx).startswith(b"PK")


def test_command_line(spark, books, tmp_path):
    assert engine.main([books, "--rag", "--rag-format", "jsonl", "--no-vision", "--output-dir", str(tmp_path / "no model")], spark) == 1
    assert engine.main([books, "--rag", "--rag-format", "jsonl", "--output-dir", str(tmp_path)], spark, FakeClient()) == 0
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "chunks")).collect()]
    assert lines and {"content", "metadata"} == set(lines[0])
    assert engine.main([books, "--rag", "--rag-format", "yaml_frontmatter", "--output-dir", str(tmp_path)], spark, FakeClient()) == 0
    got = {x.name for x in (tmp_path / "good_rag").iterdir()}
    assert {"Plain_chunk_1.md"} <= got and not [x for x in got if x.endswith(".part")]
    assert (tmp_path / "good_rag" / "Plain_chunk_1.md").read_text().startswith("---\n")
    assert json.loads((tmp_path / "good_rag.json").read_text())["Plain"]["chunks"] == 1
    assert engine.main([books, "--output-dir", str(tmp_path)], spark, FakeClient()) == 0
    assert json.loads((tmp_path / "good_result.json").read_text())["sheets"]["Plain"] == {"data": [{"name": "bolt", "n": 7}]}
    assert engine.main([str(tmp_path / "absent")], spark) == 1


def test_formulas_times_and_formats():
    assert xlsx.shifted("SUM(A1:$B$2)+C$3*'A1 B2'!$D4&\"A1\"+LOG10(A1)", 2, 1) == "SUM(B3:$B$2)+D$3*'A1 B2'!$D6&\"A1\"+LOG10(B3)"
    assert xlsx.shifted("A1", -1, 0) == "#REF!"
    b = xlsx.Book.__new__(xlsx.Book)
    b.epoch = xlsx.datetime(1899, 12, 30)
    assert b._date("0.5", "h:mm") == "12:00:00" and b._date("1.5", "[h]:mm") == "1 day, 12:00:00" and b._date("45292", "yyyy-mm-dd") == "2024-01-01T00:00:00"
    assert b._is_date("[h]:mm") and not b._is_date('[Red]#,##0 "days"') and xlsx.FORMATS[44].count("$") == 3


class EchoClient:
    """Shows in its answer whether chart data and notes reached the model."""

    def complete(self, model, prompt, text, images):
        if images:
            return "[図表データ] 1 < 2" if "グラフ" in prompt else "[画像概要] a plan"
        return json.dumps({"data": [{"chart": "visual-insight" in text, "notes": engine.LOGIC_NOTES in text}]})


def test_images_reach_model_and_outputs(spark, books):
    e = engine.Engine(spark, EchoClient())
    opt = engine.ExtractionOptions(include_visual_summaries=True, include_logic=True)
    m = {r.idx: (r.visual_summary, r.visual_data) for r in e.analysed_media(books, opt).filter("source_file = 'good.xlsx' and error is null").collect()}
    assert m == {0: ("[画像概要] a plan", "[図表データ] 1 < 2")}
    got = {r.sheet_name: json.loads(r.data) for r in e.extract_structured_data(books, opt).filter("data is not null").collect()}
    assert got["報告"] == [{"chart": True, "notes": True}]
    off = {r.sheet_name: json.loads(r.data) for r in e.extract_structured_data(books).filter("data is not null").collect()}
    assert off["報告"] == [{"chart": False, "notes": False}]
