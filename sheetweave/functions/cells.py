"""Cell properties and their HTML, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetweave.functions.text import html_escape, html_text

# Sides in the order CSS gives them, widths by line, functions whose results count as derived.
SIDES = ("left", "right", "top", "bottom")
LINES = {"thin": "1px solid", "medium": "2px solid", "thick": "3px solid", "dashed": "1px dashed", "dotted": "1px dotted"}
AGGREGATES = "SUM|AVERAGE|AVG|COUNT|MAX|MIN|SUBTOTAL|VLOOKUP|IF|ROUND"


def unit_of(number_format: Column) -> Column:
    """Unit a number format stands for; the format itself if it is none of the known, null for none."""
    low = F.lower(number_format)
    return (
        F.when(number_format.isNull() | number_format.isin("", "General"), None)
        .when(number_format.contains("¥") | low.contains("jpy"), "JPY")
        .when(number_format.contains("$"), "USD")
        .when(number_format.contains("%"), "PERCENT")
        .when(low.contains("yy") | low.contains("mm") | low.contains("dd"), "DATE")
        .otherwise(number_format)
    )


def border_css(borders: Column) -> Column:
    """CSS of an array of (side, line), sides in their fixed order."""
    style = F.create_map(*[F.lit(x) for kv in LINES.items() for x in kv])
    parts = []
    of = lambda side: lambda b: (b["side"] == side) & b["line"].isNotNull()
    for s in SIDES:
        one = F.filter(borders, of(s))
        parts.append(F.when(F.size(one) > 0, F.concat(F.lit(f"border-{s}: "), F.coalesce(style[one[0]["line"]], F.lit("1px solid")), F.lit(" black"))))
    return F.concat_ws("; ", *parts)


def css(fill: Column, borders: Column, bold: Column, italic: Column) -> Column:
    """Style string: background (unless none; ARGB loses its alpha), borders, weight, slant."""
    rgb = F.when(F.length(fill) == 8, F.substring(fill, 3, 6)).otherwise(fill)
    back = F.when(fill.isNotNull() & ~fill.isin("00000000", "0") & rgb.rlike("^[0-9A-Fa-f]+$"), F.concat(F.lit("background-color: #"), rgb))
    edge = border_css(borders)
    return F.concat_ws("; ", back, F.when(edge != "", edge), F.when(bold, F.lit("font-weight: bold")), F.when(italic, F.lit("font-style: italic")))


def is_formula(formula: Column) -> Column:
    return F.coalesce(formula.startswith("="), F.lit(False))


def is_aggregate(formula: Column) -> Column:
    """Whether a formula begins with one of the aggregate functions."""
    return F.coalesce(formula.rlike(rf"(?i)=({AGGREGATES})\b"), F.lit(False))


def td(coord: Column, value: Column, colspan: Column, rowspan: Column, style: Column, formula: Column, unit: Column) -> Column:
    """A table cell: attributes in their fixed order, escaped text."""
    attr = lambda name, c: F.concat(F.lit(f' {name}="'), html_escape(c), F.lit('"'))
    return F.concat(
        F.lit("<td"),
        attr("data-coord", coord),
        F.when(colspan > 1, attr("colspan", colspan.cast("string"))).otherwise(""),
        F.when(rowspan > 1, attr("rowspan", rowspan.cast("string"))).otherwise(""),
        F.when(F.coalesce(style, F.lit("")) != "", attr("style", style)).otherwise(""),
        F.when(is_formula(formula), attr("data-formula", formula)).otherwise(""),
        F.when(F.coalesce(unit, F.lit("")) != "", attr("data-unit", unit)).otherwise(""),
        F.lit(">"),
        html_text(F.coalesce(value, F.lit(""))),
        F.lit("</td>"),
    )


def logic_note(coord: Column, formula: Column, unit: Column, quote: bool = True) -> Column:
    """Annotation of a derived value."""
    u = F.when(F.coalesce(unit, F.lit("")) != "", F.concat(F.lit("（単位: "), unit, F.lit("）"))).otherwise("")
    return F.concat(F.lit(("> " if quote else "") + "ℹ️ セル "), coord, F.lit(" は計算式 `"), formula, F.lit("`"), u, F.lit(" から導出された集計値です。"))


def header_name(value: Column, kind: Column, col: Column) -> Column:
    """Header text; an empty one, the number zero and the boolean false become ``ColumnN``, a text "0" or "False" stays."""
    nothing = value.isNull() | (value == "") | ((kind == "n") & (value.try_cast("double") == 0)) | ((kind == "b") & (F.lower(value) == "false"))
    return F.when(F.coalesce(nothing, F.lit(False)), F.concat(F.lit("Column"), col.cast("string"))).otherwise(value)


def json_value(value: Column, kind: Column) -> Column:
    """A cell's value as JSON of its type."""
    text = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    number = (kind == "n") & value.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")
    return F.when(number, value).when((kind == "b") & F.lower(value).isin("true", "false"), F.lower(value)).otherwise(text)
