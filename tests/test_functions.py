"""Scalar functions against pairs of input and output."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetweave.functions import cells, coords, names, text


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("v"))).collect())]


def python_clean(t):
    t = t.replace("　", " ")
    c = "[一-龯぀-ゟ゠-ヿ]"
    return re.sub(rf"({c})\s{{1,3}}(?={c})", r"\1", t).strip()


def test_clean_cjk(spark):
    cases = ["担　当　者", "東　京　支　店", "東 京", "A B", "東 A", "東    京", "東\t京", " 東\n京 ", "", "\x85東\x1c", "ア イ　ウ"]
    assert column(spark, text.clean_cjk, cases) == [python_clean(c) for c in cases]
    assert column(spark, text.clean_cjk, [None]) == [None]


def test_escapes(spark):
    assert column(spark, text.html_text, ["<a href=\"x\">'&\n", None]) == ["&lt;a href=&quot;x&quot;&gt;&#x27;&amp;<br>", None]
    assert column(spark, text.md_escape, ["a|b\nc"]) == ["a\\|b<br>c"]


def test_lines_are_pythons(spark):
    cases = ["", "a", "a\n", "a\r\nb", "\n\n", "a\x0bb\x0cc\x1cd\x85e f", "a\rb\n\nc"]
    assert column(spark, text.lines, cases) == [c.splitlines() for c in cases]


def test_units(spark):
    cases = ["General", "", None, '"¥"#,##0', "[$JPY] 0", "$0.00", "0.00%", "yyyy/m/d", "dd.MM", "[$-411]yyyy", "0.00"]
    assert column(spark, cells.unit_of, cases) == [None, None, None, "JPY", "JPY", "USD", "PERCENT", "DATE", "DATE", "USD", "0.00"]


def test_coordinates(spark):
    n = [1, 26, 27, 52, 702, 703, 16384]
    assert column(spark, coords.col_letters, n, "int") == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "XFD"]
    assert column(spark, coords.col_of, ["A1", "xfd7", "AA", "", None, "7"]) == [1, 16384, None, None, None, None]
    assert column(spark, coords.row_of, ["A1", "xfd7", "AA", "", None, "A99999999999"]) == [1, 7, None, None, None, None]


def test_formula_class(spark):
    assert column(spark, cells.is_aggregate, ["=SUM(A1)", "=sum(A1)", "=A1+SUM(B1)", "=SUMIF(A1)", None]) == [True, True, False, False, False]


def test_td(spark):
    df = spark.createDataFrame([("B2", "<x>\n", 2, 1, "", "=SUM(A1)", "JPY")], "c string, v string, cs int, rs int, s string, f string, u string")
    got = df.select(cells.td(*[F.col(x) for x in ("c", "v", "cs", "rs", "s", "f", "u")])).first()[0]
    assert got == '<td data-coord="B2" colspan="2" data-formula="=SUM(A1)" data-unit="JPY">&lt;x&gt;<br></td>'


def test_css(spark):
    df = spark.createDataFrame([("FFCCE5FF", [("bottom", "hair"), ("left", "thick")], True, False), ("00000000", [], False, None), (None, None, None, None)], "f string, b array<struct<side: string, line: string>>, bold boolean, it boolean")
    got = [r[0] for r in df.select(cells.css(*[F.col(x) for x in ("f", "b", "bold", "it")])).collect()]
    assert got == ["background-color: #CCE5FF; border-left: 3px solid black; border-bottom: 1px solid black; font-weight: bold", "", ""]


NAMES = {"data...json": "data.json", "../../../etc/passwd": "etc_passwd", "": "unnamed", None: "unnamed", "a b": "a_b", "スペース": "スヘ_ース", "Übersicht": "U_bersicht", "___": "unnamed"}


def test_safe_names(spark):
    assert column(spark, names.safe_name_column, list(NAMES)) == list(NAMES.values())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=126), max_size=20))
def test_safe_name_is_safe(t):
    assert re.fullmatch(r"[\w.\-]+", names.safe_name(t)) and ".." not in names.safe_name(t)


@pytest.mark.parametrize(("given_name", "env", "want"), [("x", {}, "x"), (None, {"LLM_MODEL": "y"}, "y"), (None, {"GEMINI_MODEL": "z"}, "z"), (None, {}, "gemini-1.5-flash")])
def test_model_name(monkeypatch, given_name, env, want):
    for k in ("LLM_MODEL", "GEMINI_MODEL"):
        monkeypatch.delenv(k, raising=False)
    for k, v in env.items():
        monkeypatch.setenv(k, v)
    assert names.model_name(given_name) == want
