"""Workbooks as tables: cells, merged ranges, media and sheets, read with the standard library only.

One task reads one file; the size guard drops larger ones before they are opened. XML with a document type is refused. Values
are those stored in the file, formulas are kept as text and never evaluated.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.functions.names import safe_name

MAX_MB = 50
MAX_IMAGE_BYTES = 20_971_520
# Number formats that workbooks refer to by number only.
FORMATS = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 5: '"$"#,##0_);("$"#,##0)', 6: '"$"#,##0_);[Red]("$"#,##0)', 7: '"$"#,##0.00_);("$"#,##0.00)', 8: '"$"#,##0.00_);[Red]("$"#,##0.00)',
    9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)", 41: '_(* #,##0_);_(* (#,##0);_(* "-"_);_(@_)', 42: '_("$"* #,##0_);_("$"* (#,##0);_("$"* "-"_);_(@_)',
    43: '_(* #,##0.00_);_(* (#,##0.00);_(* "-"??_);_(@_)', 44: '_("$"* #,##0.00_);_("$"* (#,##0.00);_("$"* "-"??_);_(@_)', 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
CELLS = "file_id string, source_file string, sheet_idx int, sheet_name string, coord string, row_idx int, col_idx int, value string, value_type string, formula string, number_format string, fill string, bold boolean, italic boolean, borders array<struct<side: string, line: string>>, colspan int, rowspan int, error string"
MEDIA = "file_id string, source_file string, sheet_idx int, sheet_name string, idx int, coord string, row_idx int, col_idx int, filename string, media_type string, bytes binary, error string"


class RefusedXml(ValueError):
    """XML that declares a document type, and so could define entities."""


def parse_xml(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data or b"<\x00!\x00D" in data or b"\x00<\x00!\x00D" in data:
        raise RefusedXml("document types are not allowed in workbook parts")
    return ElementTree.fromstring(data)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _kids(e: ElementTree.Element | None, name: str) -> list[ElementTree.Element]:
    return [k for k in e if _local(k) == name] if e is not None else []


def _kid(e: ElementTree.Element | None, name: str) -> ElementTree.Element | None:
    return next(iter(_kids(e, name)), None)


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def position(coord: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Z]+)([0-9]+)", coord.upper())
    if not m:
        return 0, 0
    col = 0
    for c in m.group(1):
        col = col * 26 + ord(c) - 64
    return int(m.group(2)), col


_REF = re.compile(r"""("[^"]*"|'[^']*')|(?<![\w.$])(\$?)([A-Z]{1,3})(\$?)([0-9]+)(?![\w(.])""")


def shifted(formula: str, rows: int, cols: int) -> str:
    """A formula as it reads so many rows further down and columns further right: relative references move, texts and sheet names stay."""

    def move(m: re.Match) -> str:
        if m.group(1):
            return m.group()
        r, c = position(m.group(3) + m.group(5))
        r, c = r if m.group(4) else r + rows, c if m.group(2) else c + cols
        return f"{m.group(2)}{letters(c)}{m.group(4)}{r}" if r > 0 and c > 0 else "#REF!"

    return _REF.sub(move, formula)


class Book:
    """An opened workbook."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())
        book = self._xml("xl/workbook.xml")
        rels = self._rels("xl/workbook.xml")
        pr = _kid(book, "workbookPr")
        self.epoch = datetime(1904, 1, 1) if pr is not None and pr.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        self.sheets = [(s.get("name"), rels.get(s.get(f"{_R}id"), "")) for s in _kids(_kid(book, "sheets"), "sheet")]
        self.strings = ["".join(t.text or "" for t in si.iter() if _local(t) == "t" and not self._phonetic(si, t)) for si in self._xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in self.names else []
        self._styles()

    @staticmethod
    def _phonetic(si: ElementTree.Element, t: ElementTree.Element) -> bool:
        return any(t in list(p.iter()) for p in _kids(si, "rPh"))

    def _xml(self, name: str) -> ElementTree.Element:
        return parse_xml(self.zip.read(name))

    def _rels(self, part: str) -> dict[str, str]:
        name = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
        if name not in self.names:
            return {}
        base = posixpath.dirname(part)
        return {r.get("Id"): posixpath.normpath(posixpath.join(base, r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in self._xml(name)}

    def _styles(self) -> None:
        self.formats: list[str | None] = []
        self.looks: list[tuple[str | None, bool, bool, list[tuple[str, str]]]] = []
        if "xl/styles.xml" not in self.names:
            return
        s = self._xml("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode") for f in _kids(_kid(s, "numFmts"), "numFmt")}
        fonts = [(_kid(f, "b") is not None, _kid(f, "i") is not None) for f in _kids(_kid(s, "fonts"), "font")]
        fills = []
        for f in _kids(_kid(s, "fills"), "fill"):
            p = _kid(f, "patternFill")
            fg = _kid(p, "fgColor")
            fills.append(fg.get("rgb") if fg is not None and p.get("patternType") not in (None, "none") else None)
        borders = [[(side, b.get("style")) for side in ("left", "right", "top", "bottom") if (b := _kid(e, side)) is not None and b.get("style")] for e in _kids(_kid(s, "borders"), "border")]
        at = lambda xs, i, d: xs[int(i)] if i and int(i) < len(xs) else d
        for x in _kids(_kid(s, "cellXfs"), "xf"):
            n = int(x.get("numFmtId") or 0)
            self.formats.append(own.get(n) or FORMATS.get(n))
            bold, italic = at(fonts, x.get("fontId"), (False, False))
            self.looks.append((at(fills, x.get("fillId"), None), bold, italic, at(borders, x.get("borderId"), [])))

    def _date(self, v: str, fmt: str | None) -> str:
        """A point in time in ISO form; a time of day or a duration as it reads."""
        x = float(v)
        if re.search(r"\[(h+|m+|s+)\]", fmt or "", re.I):
            return str(timedelta(seconds=round(x * 86400)))
        if 0 <= x < 1:
            return str((datetime.min + timedelta(seconds=round(x * 86400))).time())
        d = self.epoch + timedelta(days=x)
        d = (d + timedelta(microseconds=500)).replace(microsecond=0) if d.microsecond else d
        return d.isoformat()

    @staticmethod
    def _is_date(fmt: str | None) -> bool:
        bare = re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", fmt or "", flags=re.I)
        return bool(re.search("[ymdhs]", bare, re.I)) and "General" not in (fmt or "")

    def cells(self, idx: int) -> Iterator[dict]:
        """Cells with a value, a formula or a look of their own, and the anchors of merged ranges."""
        root = self._xml(self.sheets[idx][1])
        spans = {}
        for m in _kids(_kid(root, "mergeCells"), "mergeCell"):
            a, _, b = m.get("ref").partition(":")
            (r1, c1), (r2, c2) = position(a), position(b or a)
            spans[(r1, c1)] = (c2 - c1 + 1, r2 - r1 + 1)
        shared: dict[str, tuple[str, int, int]] = {}
        row = 0
        for re_ in _kids(_kid(root, "sheetData"), "row"):
            row, col = int(re_.get("r") or row + 1), 0
            for c in _kids(re_, "c"):
                r, col = position(c.get("r")) if c.get("r") else (row, col + 1)
                kind, v, f = c.get("t") or "n", _kid(c, "v"), _kid(c, "f")
                raw = v.text if v is not None else None
                style = int(c.get("s") or 0)
                fmt = self.formats[style] if style < len(self.formats) else None
                look = self.looks[style] if style < len(self.looks) else (None, False, False, [])
                value, vtype = raw, "null" if raw is None else "n"
                if kind == "s" and raw is not None:
                    value, vtype = self.strings[int(raw)], "s"
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _local(t) == "t")
                    vtype = "s"
                elif kind == "str":
                    vtype = "s" if raw is not None else "null"
                elif kind == "b" and raw is not None:
                    value, vtype = "True" if raw == "1" else "False", "b"
                elif kind == "e":
                    vtype = "e"
                elif kind == "d" and raw is not None:
                    vtype = "d"
                elif raw is not None and self._is_date(fmt):
                    value, vtype = self._date(raw, fmt), "d"
                elif raw is not None:
                    x = float(raw)
                    value = str(int(x)) if x.is_integer() and abs(x) < 1e15 and "." not in raw and "E" not in raw.upper() else repr(x) if not x.is_integer() else str(int(x))
                formula = None
                if f is not None:
                    text = f.text
                    if f.get("t") == "shared":
                        if f.text:
                            shared[f.get("si")] = (f.text, r, col)
                        elif f.get("si") in shared:
                            first, r0, c0 = shared[f.get("si")]
                            text = shifted(first, r - r0, col - c0)
                    formula = "=" + text if text else None
                span = spans.get((r, col))
                if value is None and formula is None and span is None and not any(look):
                    continue
                yield {"coord": f"{letters(col)}{r}", "row_idx": r, "col_idx": col, "value": value, "value_type": vtype, "formula": formula, "number_format": fmt, "fill": look[0], "bold": look[1], "italic": look[2], "borders": look[3], "colspan": span[0] if span else None, "rowspan": span[1] if span else None}

    def media(self, idx: int) -> Iterator[dict]:
        """Embedded images with their anchors, in drawing order."""
        part = self.sheets[idx][1]
        n = 0
        for target in self._rels(part).values():
            if "drawing" not in target or not target.endswith(".xml") or target not in self.names:
                continue
            images = self._rels(target)
            for anchor in self._xml(target):
                blip = next((e for e in anchor.iter() if _local(e) == "blip"), None)
                if blip is None:
                    continue
                start = _kid(anchor, "from")
                r = int(_kid(start, "row").text) + 1 if start is not None else None
                c = int(_kid(start, "col").text) + 1 if start is not None else None
                name = images.get(blip.get(f"{_R}embed"), "")
                info = self.zip.getinfo(name) if name in self.names else None
                big = info is not None and info.file_size > MAX_IMAGE_BYTES
                data = self.zip.read(name) if info is not None and not big else None
                kind = sniff(data) if data else None
                error = "too_large" if big else None if kind else "unidentified_format"
                yield {"idx": n, "coord": f"{letters(c)}{r}" if r else None, "row_idx": r, "col_idx": c, "filename": f"{safe_name(self.sheets[idx][0])}_img_{n}.{kind}" if kind else None, "media_type": "image", "bytes": data if kind else None, "error": error}
                n += 1


def sniff(data: bytes) -> str | None:
    """Image format by its first bytes."""
    for head, kind in ((b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpg"), (b"GIF8", "gif"), (b"BM", "bmp")):
        if data.startswith(head):
            return kind
    return None


def files(spark: SparkSession, path: str, max_mb: int = MAX_MB) -> DataFrame:
    """Workbook files within the size limit: source_file, size_bytes, file_id (SHA-256 of the content), content.

    Of copies with the same content the first path counts, found by their hashes so that no content is shuffled.
    """
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    df = df.filter(F.col("length") <= max_mb * 1024 * 1024).withColumn("file_id", F.sha2("content", 256))
    first = df.groupBy("file_id").agg(F.min("path").alias("path"))
    df = df.join(first.select("path"), "path", "left_semi")
    return df.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.col("length").alias("size_bytes"), "file_id", "content")


def oversized(spark: SparkSession, path: str, max_mb: int = MAX_MB) -> DataFrame:
    """Files beyond the limit, without reading them."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return df.filter(F.col("length") > max_mb * 1024 * 1024).select("path", "length")


def _read(books: DataFrame, kind: str, schema: str) -> DataFrame:
    cols = [c.strip().split(" ")[0] for c in re.sub(r"<[^>]*>+", "", schema).split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, name, data in zip(b["file_id"], b["source_file"], b["content"]):
                try:
                    book = Book(data)
                    rows = [{"sheet_idx": k, "sheet_name": s, **r} for k, (s, _) in enumerate(book.sheets) for r in getattr(book, kind)(k)]
                except (RefusedXml, zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                if rows:
                    out = pd.DataFrame(rows).assign(file_id=i, source_file=name).reindex(columns=cols).astype(object)
                    yield out.where(out.notna(), None)

    return books.select("file_id", "source_file", "content").mapInPandas(run, schema)


def read_cells(books: DataFrame) -> DataFrame:
    """Cells of all sheets; a file that can't be read gives one row with ``error``."""
    return _read(books, "cells", CELLS)


def read_media(books: DataFrame) -> DataFrame:
    """Embedded images; too large or unknown ones without bytes but with ``error``."""
    return _read(books, "media", MEDIA)
