"""Oversized items cut into ordered pieces under a character limit, at natural boundaries, with line overlap.

A hierarchy of boundaries (section, paragraph, line, sentence, word, character) is searched from coarse to fine: each piece ends
at the last boundary of the coarsest kind that lies within the room left, so units that fit are packed greedily and only a
unit that doesn't fit is cut at the next finer kind. The next piece starts with the trailing lines of the piece before.

Guarantees: every piece has at most ``limit`` code points (line ends included); pieces cover the text in order; without their
overlap they join to exactly the text; a cut never parts CR from LF nor, if the limit allows, a mark or joiner from its character. The overlap has the asked-for trailing lines wherever they fit
and leave room for the next piece to move on, else as many of them as do; what stands behind the last line end counts as a line.
Where even one line is too long, its last sentence or words (at most a quarter of the limit) are shared instead, and a line
without any such boundary (one unbroken word) has no overlap.

Defined results: null content gives one piece with null text, empty content one empty piece; a null or unknown option stands
for the defaults (1000 characters, 2 lines); a limit below 1 counts as 1; repeated items count once.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, DEFAULT_OVERLAP = 1000, 2
EOL = r"(?:\r\n|[\n\r\v\f\x1c-\x1e\x85  ])"
KINDS = ("section", "paragraph", "line", "sentence", "word", "character")
#: Ends of units, from coarse to fine; the boundary is the end of the match.
BOUNDS = [
    re.compile(rf"{EOL}(?=#{{1,6}}[ \t])"),
    re.compile(rf"{EOL}[ \t]*{EOL}(?:[ \t]*{EOL})*"),
    re.compile(EOL),
    re.compile(r"[.!?][\"'”’»)\]]*[ \t 　]+|[。！？][」』”’）]*[ \t　]*"),
    re.compile(r"[ \t  - 　]+|[、，,;](?=[^\s\d])"),
]
LINE = re.compile(EOL)


def _glued(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part characters that belong together."""
    a, b = text[at - 1], text[at]
    return a == "\r" and b == "\n" or a == "‍" or b == "‍" or "︀" <= b <= "️" or unicodedata.combining(b) > 0


def pieces(text: str, limit: int, overlap_lines: int) -> list[tuple[int, int, int, str]]:
    """(start, end, end of the part shared with the piece before, kind of the cut) of each piece."""
    limit, n = max(1, limit), len(text)
    if n <= limit:
        return [(0, n, 0, "end")]
    ends = [[m.end() for m in r.finditer(text)] for r in BOUNDS]
    lines = ends[2]
    out, start, pos = [], 0, 0
    while True:
        room = limit - (pos - start)
        if n - pos <= room:
            return [*out, (start, n, pos, "end")]
        stop = pos + room
        for kind, e in zip(KINDS, ends):
            k = bisect_right(e, stop)
            if k and e[k - 1] > pos:
                end = e[k - 1]
                break
        else:
            kind, end = "character", stop
            while end > pos + 1 and _glued(text, end):
                end -= 1
            if end == pos + 1 and _glued(text, end):
                end = stop - (stop - 1 > pos and text[stop - 1 : stop + 1] == "\r\n")
        out.append((start, end, pos, kind))
        # the trailing lines of [start, end) that leave room to move on
        nxt, k = end, bisect_right(lines, end - 1)
        for _ in range(overlap_lines):
            s = max(lines[k - 1] if k else 0, start)
            if s >= nxt or s == start or end - s >= limit:
                break
            nxt, k = s, k - 1
        if nxt == end and overlap_lines > 0:  # a line too long to repeat: its last sentence or words
            for e in ends[3:]:
                k = bisect_right(e, end - 1 - limit // 4)
                if k < len(e) and start < e[k] < end:
                    nxt = e[k]
                    break
        start, pos = nxt, end


def shared_lines(text: str, start: int, pos: int) -> int:
    """Whole lines in the part that a piece shares with the one before."""
    if start == pos or start and start not in [m.end() for m in LINE.finditer(text, max(0, start - 2), start)]:
        return 0
    ends = [m.end() for m in LINE.finditer(text, start, pos)]
    return len(ends) + (not ends or ends[-1] < pos)


def split_items(items: DataFrame, options: DataFrame, id_col: str = "item_no", text_col: str = "content") -> DataFrame:
    """Ordered pieces: id, piece_no (from 1), n_pieces, start_char, end_char, overlap_chars, overlap_lines (whole ones shared), cut, piece.

    Items within their limit never leave the JVM.
    """
    lim = options.select("option_id", "max_chunk_chars", "chunk_overlap_lines")
    own = items.select(F.col(id_col).alias("_id"), "option_id", F.col(text_col).alias("_text")).dropDuplicates(["_id"])
    df = own.join(lim, "option_id", "left").select("_id", "_text", F.greatest(F.coalesce("max_chunk_chars", F.lit(DEFAULT_LIMIT)), F.lit(1)).alias("_limit"), F.coalesce("chunk_overlap_lines", F.lit(DEFAULT_OVERLAP)).alias("_lines"))
    over = F.coalesce(F.length("_text") > F.col("_limit"), F.lit(False))
    whole = df.filter(~over).select(F.col("_id").alias(id_col), F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_char"), F.length("_text").alias("end_char"), F.lit(0).alias("overlap_chars"), F.lit(0).alias("overlap_lines"), F.lit("end").alias("cut"), F.col("_text").alias("piece"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text, limit, k in zip(b["_id"], b["_text"], b["_limit"], b["_lines"]):
                ps = pieces(text, int(limit), int(k))
                rows += [(i, j, len(ps), s, e, p - s, shared_lines(text, s, p), cut, text[s:e]) for j, (s, e, p, cut) in enumerate(ps, 1)]
            yield pd.DataFrame(rows, columns=[id_col, "piece_no", "n_pieces", "start_char", "end_char", "overlap_chars", "overlap_lines", "cut", "piece"])

    kind = dict(items.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, piece_no int, n_pieces int, start_char int, end_char int, overlap_chars int, overlap_lines int, cut string, piece string"
    return whole.unionByName(df.filter(over).mapInPandas(run, schema))


def oversized(items: DataFrame, options: DataFrame) -> DataFrame:
    """Ids of the items that had to be cut, each once: those whose text has more than one piece."""
    return split_items(items, options).filter("n_pieces > 1 and piece_no = 1").select("item_no")
