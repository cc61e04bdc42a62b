"""Scalar text functions as column expressions; all stay in the JVM unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.strip and \s see it, and the characters between which spaces are dropped.
SPACE = r"[\s\u001c-\u001f\u0085\p{Z}]"
CJK = r"[一-龯぀-ゟ゠-ヿ]"
#: Line ends as str.splitlines sees them.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def clean_cjk(c: Column) -> Column:
    """Ideographic spaces become spaces, one to three spaces between two CJK characters go, ends are stripped."""
    spaced = F.translate(c, "　", " ")
    return strip(F.regexp_replace(spaced, f"({CJK}){SPACE}{{1,3}}(?={CJK})", "$1"))


def html_escape(c: Column) -> Column:
    """``& < > " '`` as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_text(c: Column) -> Column:
    """Escaped text with line breaks."""
    return F.replace(html_escape(c), F.lit("\n"), F.lit("<br>"))


def md_escape(c: Column) -> Column:
    """Text for a Markdown table cell."""
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def lines(c: Column) -> Column:
    """Array of lines without their ends; no empty item after a last line end."""
    a = F.split(c, LINE_END)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.when(F.element_at(a, -1) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a))


def styled(c: Column) -> Column:
    """Bold marks as ``<b>``; a text with an image summary in a box of its own. The input is escaped already."""
    bold = F.regexp_replace(c, r"\*\*(.*?)\*\*", "<b>$1</b>")
    return F.when(bold.contains("[画像概要]"), F.concat(F.lit('<div class="summary">'), bold, F.lit("</div>"))).otherwise(bold)


def media_summary(c: Column) -> Column:
    """Summary line of an image in Markdown; null for none."""
    mark = F.lit("[画像概要]")
    return F.when(F.coalesce(c, F.lit("")) == "", None).when(c.startswith("[画像概要]"), F.replace(c, mark, F.lit("**[画像概要]**:"))).otherwise(F.concat(F.lit("**[画像概要]**: "), c))


def data_url(content: Column, mime: str = "image/png") -> Column:
    """Bytes as a data URL on one line."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))


def llm_key(model: Column, prompt: Column, text: Column) -> Column:
    return F.concat_ws(":", model, F.sha2(prompt, 256), F.sha2(text, 256))


def vlm_key(model: Column, prompt: Column, image_hash: Column) -> Column:
    return F.concat_ws(":", model, prompt, image_hash)


def raw_key(content_hash: Column, logic: bool) -> Column:
    return F.concat(content_hash, F.lit(f":logic={logic}"))


def iso_time(c: Column) -> Column:
    """ISO 8601 with ``T``; the fraction only where there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
