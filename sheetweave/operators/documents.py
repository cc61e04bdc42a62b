"""Documents from Markdown and from sheets: HTML by line class, and DOCX from an ordered block table."""

from __future__ import annotations

import io
import json
import re
import zipfile
from html import escape
from xml.sax.saxutils import escape as xml_escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetweave.functions.text import lines

# ---- Markdown lines ----
IMAGE = re.compile(r"!\[([^\]]*)\]\(")


def line_class(line: Column) -> Column:
    """blank, table, header, list, image or text."""
    t = F.trim(line)
    return F.when(t == "", "blank").when(t.startswith("|"), "table").when(t.startswith("#"), "header").when(t.rlike(r"^[-*](\s+|$)"), "list").when(t.startswith("!["), "image").otherwise("text")


def line_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row per line: key, line_no (from 0), line, kind, block_no (runs of table or list lines share one)."""
    ls = df.select(key, F.posexplode(lines(F.col(text))).alias("line_no", "line")).withColumn("kind", line_class(F.col("line")))
    w = W.partitionBy(key).orderBy("line_no")
    starts = ~F.col("kind").isin("table", "list") | (F.col("kind") != F.coalesce(F.lag("kind").over(w), F.lit("")))
    return ls.withColumn("block_no", F.sum(starts.cast("int")).over(w))


def image_at(text: str, at: int = 0) -> tuple[int, int, str, str] | None:
    """The first image reference from ``at``: start, end, alternative text, path. Parentheses in the path may nest; unbalanced ones are passed over."""
    for m in IMAGE.finditer(text, at):
        depth = 1
        for p in re.compile(r"[()]").finditer(text, m.end()):
            depth += 1 if p.group() == "(" else -1
            if depth == 0:
                return m.start(), p.end(), m.group(1), text[m.end() : p.start()]
    return None


def inline_html(text: str) -> str:
    """Escaped text with bold marks, summaries and images."""
    out, at = [], 0
    while hit := image_at(text, at):
        out += [_styled(text[at : hit[0]]), f'<img src="{escape(hit[3])}" alt="{escape(hit[2])}">']
        at = hit[1]
    return "".join([*out, _styled(text[at:])])


def _styled(text: str) -> str:
    t = re.sub(r"\*\*(.*?)\*\*", r"<b>\1</b>", escape(text))
    return f'<div class="summary">{t}</div>' if "[画像概要]" in t else t


def markdown_html(text: str) -> str:
    """The body of a document."""
    out: list[str] = []
    kind, run = "", []

    def flush() -> None:
        nonlocal kind, run
        if kind == "table":
            rows = [[c for c in r.strip().strip("|").split("|") if c] for r in run]
            rows = [r for n, r in enumerate(rows) if not (n == 1 and r and re.fullmatch(r":?-{2,}:?", r[0]))]
            out.append("<table>" + "".join("<tr>" + "".join(f"<{'th' if n == 0 else 'td'}>{inline_html(c.strip())}</{'th' if n == 0 else 'td'}>" for c in r) + "</tr>" for n, r in enumerate(rows)) + "</table>")
        elif kind == "list":
            out.append("<ul>" + "".join(f"<li>{inline_html(r.strip()[1:].strip())}</li>" for r in run) + "</ul>")
        kind, run = "", []

    for line in text.splitlines():
        t = line.strip()
        now = "table" if t.startswith("|") else "list" if re.match(r"[-*](\s+|$)", t) else ""
        if now != kind:
            flush()
        if now:
            kind, run = now, [*run, line]
        elif t.startswith("#"):
            n = len(t) - len(t.lstrip("#"))
            out.append(f"<h{min(n, 6)}>{inline_html(t[n:].strip())}</h{min(n, 6)}>")
        elif t.startswith("![") and (hit := image_at(t)) and hit[:2] == (0, len(t)):
            out.append(f'<div class="image">{inline_html(t)}</div>')
        elif t:
            out.append(f"<p>{inline_html(t)}</p>")
    flush()
    return "\n".join(out)


STYLE = "table{border-collapse:collapse}td,th{border:1px solid;padding:2px 6px}.summary{background:#eef}"


def html_documents(c: Column) -> Column:
    """Markdown column as HTML documents."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f'<html><head><meta charset="utf-8"><style>{STYLE}</style></head><body>\n{markdown_html(t)}\n</body></html>')

    return run(c)


def image_refs(c: Column) -> Column:
    """All image references of a Markdown column, nested parentheses included."""

    @F.pandas_udf("array<struct<alt: string, path: string>>")
    def run(texts: pd.Series) -> pd.Series:
        def of(t: str | None) -> list[tuple[str, str]]:
            out, at = [], 0
            while t and (hit := image_at(t, at)):
                out.append((hit[2], hit[3]))
                at = hit[1]
            return out

        return texts.map(of)

    return run(c)


# ---- DOCX ----
def caption(no: Column, title: Column, cell: Column, media: Column) -> Column:
    """Caption of an image below a table."""
    plain = F.regexp_replace(no, "^(No|NO)\\.", "")
    return F.concat(F.lit("【図：No."), plain, F.lit(" "), F.coalesce(title, F.lit("画像データ")), F.lit(" (表中座標: "), F.coalesce(cell, F.lit("A1")), F.lit(" / 画像座標: "), F.coalesce(media, F.lit("A1")), F.lit(")】"))


def overview(data: Column) -> Column:
    """The first of the overview members of a JSON object."""
    return F.coalesce(*[F.get_json_object(data, f"$.{k}") for k in ("summary", "description", "overview", "analysis")])


_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"'
_EMU = 3_600_000  # side of a picture's frame (10 cm)


def _picture(n: int) -> str:
    ext = f'<a:ext cx="{_EMU}" cy="{_EMU}"/>'
    pic = f'<pic:pic><pic:nvPicPr><pic:cNvPr id="{n}" name="image{n}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="rImg{n}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/>{ext}</a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic>'
    return f'<w:p><w:r><w:drawing><wp:inline><wp:extent cx="{_EMU}" cy="{_EMU}"/><wp:docPr id="{n}" name="image{n}"/><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture">{pic}</a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p>'


def docx_bytes(blocks: list[tuple[str, object]]) -> bytes:
    """A DOCX file from blocks: (``h1``…``h3`` | ``p`` | ``quote``, text), (``table``, rows) with the first row bold, (``image``, (bytes, extension)), (``break``, None).

    A table cell is a text or (text, colspan, rowspan).
    """
    run = lambda t, bold=False: f'<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{xml_escape(str(t))}</w:t></w:r>'
    body, images = [], []
    for kind, x in blocks:
        if kind == "image":
            images.append(x)
            body.append(_picture(len(images)))
        elif kind == "table":
            down: dict[int, tuple[int, int]] = {}  # column -> rows still covered, width
            rows = []
            for n, r in enumerate(x):
                cells, col = [], 0
                todo = list(r)
                while todo or col in down:
                    if col in down:
                        left, width = down.pop(col)
                        cells.append(f'<w:tc><w:tcPr><w:gridSpan w:val="{width}"/><w:vMerge/></w:tcPr><w:p/></w:tc>')
                        if left > 1:
                            down[col] = (left - 1, width)
                        col += width
                        if not todo and not any(k >= col for k in down):
                            break
                        continue
                    t, width, height = (*todo.pop(0), 1, 1)[:3] if isinstance(todo[0], tuple) else (todo.pop(0), 1, 1)
                    pr = f'<w:gridSpan w:val="{width}"/>' + ('<w:vMerge w:val="restart"/>' if height > 1 else "")
                    if height > 1:
                        down[col] = (height - 1, width)
                    cells.append(f"<w:tc><w:tcPr>{pr}</w:tcPr><w:p>{run(t if t is not None else '', n == 0)}</w:p></w:tc>")
                    col += width
                    if height > 1 and not todo:
                        break
                rows.append(f"<w:tr>{''.join(cells)}</w:tr>")
            body.append(f"<w:tbl><w:tblPr/>{''.join(rows)}</w:tbl><w:p/>")
        elif kind == "break":
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        else:
            style = {"h1": "Heading1", "h2": "Heading2", "h3": "Heading3", "quote": "Quote"}.get(kind)
            body.append(f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}{run(x)}</w:p>')
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/><Default Extension="jpg" ContentType="image/jpeg"/><Default Extension="gif" ContentType="image/gif"/><Default Extension="bmp" ContentType="image/bmp"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rImg{n}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/image" Target="media/image{n}.{ext}"/>' for n, (_, ext) in enumerate(images, 1)) + "</Relationships>",
        "word/document.xml": f"<w:document {_NS}><w:body>{''.join(body)}</w:body></w:document>",
    }
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        for n, (data, ext) in enumerate(images, 1):
            z.writestr(f"word/media/image{n}.{ext}", bytes(data))
    return buf.getvalue()


# Members that aren't a table of their own, headers that already hold an insight, and the default texts.
RESERVED = {"summary", "description", "overview", "analysis", "media", "error", "data"}
INSIGHT, NO_INSIGHT = "ビジュアルインサイト", "なし"
INSIGHT_HEADS = ("インサイト", "insight", "visual", "画像概要")
LOGIC = re.compile(r"=(SUM|AVERAGE|AVG|COUNT|MAX|MIN|SUBTOTAL|VLOOKUP|IF|ROUND)\b", re.I)


def _rc(coord: str | None) -> tuple[int, int] | None:
    m = re.fullmatch(r"([A-Z]+)([0-9]+)", (coord or "").upper())
    if not m:
        return None
    col = 0
    for c in m.group(1):
        col = col * 26 + ord(c) - 64
    return int(m.group(2)), col


def find_table(data: object) -> tuple[str | None, list[dict]]:
    """The member that holds a list of objects, reserved ones last; its name and rows."""
    if isinstance(data, list):
        return None, [r for r in data if isinstance(r, dict)]
    if isinstance(data, dict):
        for k in [*(k for k in data if k not in RESERVED and not k.startswith("_")), "data"]:
            v = data.get(k)
            if isinstance(v, list) and v and all(isinstance(r, dict) for r in v):
                return k, v
    return None, []


def media_of_row(row: dict, media: list[dict], band: int = 5) -> dict | None:
    """The media item at the row's coordinate, else in its photo area, else in its row or column nearby."""
    coord = next((str(row[k]) for k in ("coordinate_image", "coordinate", "coord", "coordinate_title") if row.get(k)), None)
    if hit := next((m for m in media if coord and (m["coord"] or "").upper() == coord.upper()), None):
        return hit
    area = row.get("photo_area")
    if isinstance(area, dict) and (a := _rc(area.get("start"))) and (b := _rc(area.get("end"))):
        if hit := next((m for m in media if (p := _rc(m["coord"])) and a[0] <= p[0] <= b[0] and a[1] <= p[1] <= b[1]), None):
            return hit
    if here := _rc(coord):
        return next((m for m in media if (p := _rc(m["coord"])) and (p[1] == here[1] and abs(p[0] - here[0]) <= band or p[0] == here[0] and abs(p[1] - here[1]) <= band)), None)
    return None


def coord_of_value(key: str, value: str, cells: list[dict]) -> str | None:
    """The first cell equal to the value, else one that contains it, else one that contains the key."""
    v = value.strip()
    texts = [((c["value"] or "").strip(), c["coord"]) for c in cells]
    for test in (lambda t: t == v, lambda t: v in t, lambda t: key in t):
        if hit := next((c for t, c in texts if t and v and test(t)), None):
            return hit
    return None


def structured_blocks(data: object, cells: list[dict], media: list[dict]) -> list[tuple[str, object]]:
    """Blocks of a structured result: its table with insights, the other members as headings, texts and located values, then images, annotations and what is left."""
    blocks: list[tuple[str, object]] = []
    name, rows = find_table(data)
    used: list[dict] = []
    captions = []
    if rows:
        heads = list(rows[0])
        extra = not any(x in h.lower() for h in heads for x in INSIGHT_HEADS)
        table = [[*heads, *([INSIGHT] if extra else [])]]
        for n, r in enumerate(rows, 1):
            m = media_of_row(r, media)
            at = next((str(r[k]) for k in ("coordinate_title", "coordinate", "coord") if r.get(k)), None)
            line = [str(r.get(h, "")) for h in heads]
            if at and line:
                line[0] = f"[{at}] {line[0]}"
            if extra:
                line.append(str((m or {}).get("visual_summary") or r.get("image_details") or NO_INSIGHT))
            table.append(line)
            if m and m not in used:
                used.append(m)
                no = re.sub(r"^(No|NO)\.", "", str(r.get("photo_no") or n))
                captions.append((m, f"【図：No.{no} {r.get('title') or '画像データ'} (表中座標: {at or 'A1'} / 画像座標: {m['coord'] or 'A1'})】"))
        blocks.append(("table", table))

    def members(x: object, skip: str | None) -> None:
        for k, v in x.items() if isinstance(x, dict) else ():
            if k == skip or k in ("media", "summary", "description", "overview", "analysis") or k.startswith("_"):
                continue
            if isinstance(v, dict):
                blocks.append(("h3", k))
                members(v, None)
            elif isinstance(v, list):
                blocks.append(("h3", k))
                for e in v:
                    members(e, None) if isinstance(e, dict) else blocks.append(("p", str(e)))
            elif v is not None and str(v):
                at = coord_of_value(k, str(v), cells)
                blocks.append(("p", f"{f'[{at}] ' if at else ''}{k}: {v}"))

    members(data, name)
    for m, text in captions + [(m, f"【図：{m['filename'] or '画像データ'} (画像座標: {m['coord'] or 'A1'})】") for m in media if m not in used and m["filename"]]:
        if m.get("bytes"):
            blocks.append(("image", (m["bytes"], (m["filename"] or "x.png").rsplit(".", 1)[-1])))
        blocks.append(("p", text))
    for c in cells:
        if c["formula"] and LOGIC.search(c["formula"]):
            unit = f"（単位: {c['unit']}）" if c["unit"] else ""
            blocks.append(("quote", f"ℹ️ セル {c['coord']} は計算式 `{c['formula']}`{unit} から導出された集計値です。"))
    return blocks


def _raw_rows(cells: list[dict]) -> list[list]:
    """The cells of a sheet at their places, blanks between them included, those under a merged range left out."""
    at = {(c["row_idx"], c["col_idx"]): c for c in cells}
    under = {(r, k) for (r0, k0), c in at.items() for r in range(r0, r0 + int(c["rowspan"])) for k in range(k0, k0 + int(c["colspan"]))} - at.keys()
    width = max((k for _, k in [*at, *under]), default=0)

    def one(r: int, k: int) -> tuple[str, int, int]:
        c = at.get((r, k))
        return ("", 1, 1) if c is None else (f"[{c['coord']}] {c['value'] or ''}", int(c["colspan"]), int(c["rowspan"]))

    return [[one(r, k) for k in range(1, width + 1) if (r, k) not in under] for r in sorted({r for r, _ in at})]


def docx_reports(results: DataFrame, cells: DataFrame, media: DataFrame) -> DataFrame:
    """A DOCX per file from structured results (file_id, sheet_name, data), with the raw table where a sheet has none.

    cells: file_id, sheet_name, row_idx, col_idx, coord, value, formula, unit, colspan, rowspan; media: file_id, sheet_name, idx,
    coord, filename, visual_summary and, if there, bytes.
    """
    keys = ["file_id", "sheet_name"]
    if "bytes" not in media.columns:
        media = media.withColumn("bytes", F.lit(None).cast("binary"))
    c = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row_idx", "col_idx", "coord", "value", "formula", "unit", F.coalesce("colspan", F.lit(1)).alias("colspan"), F.coalesce("rowspan", F.lit(1)).alias("rowspan")))).alias("cells"))
    m = media.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "coord", "filename", "visual_summary", "bytes"))).alias("media"))
    sheets = c.join(results.select(*keys, "data", overview(F.col("data")).alias("overview")), keys, "left").join(m, keys, "left")
    files = sheets.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("sheet_name", "data", "overview", "cells", "media"))).alias("sheets"))

    @F.pandas_udf("binary")
    def write(ids: pd.Series, books: pd.Series) -> pd.Series:
        out = []
        for i, sheets in zip(ids, books):
            blocks: list[tuple[str, object]] = [("h1", i)]
            for s in sheets:
                own = [dict(x) for x in (s["cells"] if s["cells"] is not None else [])]
                pics = [dict(x) for x in (s["media"] if s["media"] is not None else [])]
                blocks.append(("h1", s["sheet_name"]))
                if s["overview"]:
                    blocks += [("h2", "解析サマリー"), ("p", s["overview"])]
                try:
                    data = json.loads(s["data"]) if s["data"] else None
                except ValueError:
                    data = None
                if not find_table(data)[1]:
                    blocks.append(("table", _raw_rows(own)))
                blocks += [*structured_blocks(data, own, pics), ("break", None)]
            out.append(docx_bytes(blocks))
        return pd.Series(out)

    return files.select("file_id", write("file_id", "sheets").alias("docx"))


def sheet_blocks(cells: DataFrame) -> DataFrame:
    """Each row of a sheet's raw table as texts ``[coord] value`` with spans, in order: file_id, sheet_name, row_idx, cells."""
    text = F.concat(F.lit("["), F.col("coord"), F.lit("] "), F.coalesce("value", F.lit("")))
    one = F.struct("col_idx", text.alias("text"), F.coalesce("colspan", F.lit(1)).alias("colspan"), F.coalesce("rowspan", F.lit(1)).alias("rowspan"))
    g = cells.groupBy("file_id", "sheet_name", "row_idx").agg(F.array_sort(F.collect_list(one)).alias("cells"))
    return g.select("file_id", "sheet_name", "row_idx", F.transform("cells", lambda c: F.struct(c["text"], c["colspan"], c["rowspan"])).alias("cells"))


def docx_files(cells: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """A DOCX per file: file_id, docx. ``heads``: file_id, sheet_name, overview.

    Sheets come one after the other with heading, overview, raw table and a page break; a file is assembled in one place, and
    the size guard of the source bounds it.
    """
    rows = sheet_blocks(cells)
    sheets = rows.groupBy("file_id", "sheet_name").agg(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))).alias("rows"))
    if heads is not None:
        sheets = sheets.join(heads.select("file_id", "sheet_name", "overview"), ["file_id", "sheet_name"], "left")
    else:
        sheets = sheets.withColumn("overview", F.lit(None).cast("string"))
    files = sheets.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("sheet_name", "overview", "rows"))).alias("sheets"))

    @F.pandas_udf("binary")
    def write(ids: pd.Series, all_sheets: pd.Series) -> pd.Series:
        out = []
        for i, sheets in zip(ids, all_sheets):
            blocks: list[tuple[str, object]] = [("h1", i)]
            for s in sheets:
                blocks.append(("h1", s["sheet_name"]))
                if s["overview"]:
                    blocks += [("h2", "解析サマリー"), ("p", s["overview"])]
                blocks.append(("table", [[(c["text"], int(c["colspan"]), int(c["rowspan"])) for c in r["cells"]] for r in s["rows"]]))
                blocks.append(("break", None))
            out.append(docx_bytes(blocks))
        return pd.Series(out)

    return files.select("file_id", write("file_id", "sheets").alias("docx"))


def pdf_documents(*_: object) -> None:
    """PDF needs an external office program; convert the HTML documents with one."""
    raise NotImplementedError("PDF rendering needs an external office program")
