"""Nested sheet records as flat tables with parent links.

Each file holds one JSON object (sheet name -> sheet). A sheet is parsed once into a ``variant``; nested ``transform`` calls attach
the path of every enclosing object to each record while it is still inside its array, ``flatten`` joins arrays of the same kind,
and one ``inline`` per target table emits the rows. Everything stays in the JVM; no record is parsed in Python or twice.

Defined results: null, empty or unparsable JSON gives no rows; a null member is an absent one; a lone object where a list
belongs is element 0; JSON spelled inside a string counts as what it spells; a list element that is no object is skipped but
keeps its position; of a member written twice the last one counts; repeated deliveries of a file count once (the latest
``loaded_at``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.session import latest

NODE = "array<struct<path: string, parent: string, pos: int, body: variant>>"
KINDS = ("sections", "entries", "media", "rows", "lots")
_NONE = "cast(null as variant)"


def let(x: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``x``, which is so evaluated once."""
    return f"transform(array({x}), {name} -> {body})[0]"


def as_list(x: str) -> str:
    return f"try_variant_get({x}, '$', 'array<variant>')"


def as_map(x: str) -> str:
    return f"try_variant_get({x}, '$', 'map<string,variant>')"


def member(x: str, name: str) -> str:
    return f"try_variant_get({x}, '$.{name}', 'variant')"


def unspelled(x: str) -> str:
    """SQL: a variant; one that is a string spelling an object or a list is what it spells."""
    text = let("try_variant_get(u, '$', 'string')", "s", "if(substr(ltrim(s), 1, 1) in ('{', '[', '\"'), coalesce(try_parse_json(s), u), u)")
    once = lambda v: let(v, "u", f"if(u is null or {as_list('u')} is not null or {as_map('u')} is not null, u, {text})")
    return once(x)


def listed(x: str) -> str:
    """SQL: the elements of a list; a lone object is one element; anything else has none."""
    return let(unspelled(x), "l", f"coalesce({as_list('l')}, if({as_map('l')} is not null, array(l), cast(array() as array<variant>)))")


def nodes(x: str, path: str, parent: str) -> str:
    """SQL: the objects of list ``x`` with their paths under ``path``."""
    one = f"named_struct('path', concat({path}, '/', i), 'parent', {parent}, 'pos', i, 'body', {unspelled('e')})"
    return f"filter(transform({listed(x)}, (e, i) -> {one}), n -> {as_map('n.body')} is not null)"


def _flat(of: str, f: str) -> str:
    return f"flatten(transform({of}, {f}))"


def _sections(x: str, turns: str) -> str:
    """Sections of any depth: a fold goes down one level a turn; how often ``children`` is written bounds the depth."""
    empty = f"cast(array() as {NODE})"
    down = _flat("acc.front", "s -> " + nodes(member("s.body", "children"), "concat(s.path, '/children')", "s.path"))
    start = f"named_struct('done', {empty}, 'front', cast({nodes(x, chr(39) + '/sections' + chr(39), chr(39) * 2)} as {NODE}))"
    step = f"if(size(acc.front) = 0, acc, named_struct('done', concat(acc.done, acc.front), 'front', cast({down} as {NODE})))"
    return f"aggregate(sequence(0, {turns}), {start}, (acc, t) -> {step}, acc -> concat(acc.done, acc.front))"


def with_nodes(files: DataFrame, json_col: str = "sheets", keep: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """One row per sheet: ``keep``, ``sheet_name`` and an array of nodes for each kind in ``KINDS``."""
    files.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    df = files.select(*keep, F.explode(F.from_json(json_col, "map<string,string>")).alias("sheet_name", "_text"))
    df = df.select(*keep, "sheet_name", F.expr(unspelled("try_parse_json(_text)")).alias("_v"), F.expr("size(split(_text, 'children'))").alias("_turns"))
    df = df.filter(F.expr(f"{as_map('_v')} is not null"))
    df = df.withColumn("sections", F.expr(_sections(member("_v", "sections"), "_turns")))
    df = df.withColumn("entries", F.expr(_flat("sections", "s -> " + nodes(member("s.body", "entries"), "concat(s.path, '/entries')", "s.path"))))
    media = _flat(f"map_entries(coalesce({let(unspelled(member('_v', 'media_map')), 'm', as_map('m'))}, map()))", "m -> " + nodes("m.value", "concat('/media_map/', m.key)", "''"))
    df = df.withColumn("media", F.expr(media))
    # data: a list, or an object whose only member is that list; another lone object is row 0
    inner = let(unspelled("map_values(m)[0]"), "w", f"{as_list('w')} is not null or {as_map('w')} is not null")
    data = let(unspelled(member("_v", "data")), "d", f"named_struct('d', d, 'm', {as_map('d')})")
    df = df.withColumn("_d", F.expr(data)).withColumn("_wrap", F.expr(let("_d.m", "m", f"if(size(m) = 1 and {inner}, map_keys(m)[0], cast(null as string))")))
    df = df.withColumn("rows", F.expr(nodes("if(_wrap is null, _d.d, map_values(_d.m)[0])", "concat('/data', coalesce(concat('/', _wrap), ''))", "''")))
    df = df.withColumn("lots", F.expr(_flat("rows", "r -> " + nodes(member("r.body", "lots"), "concat(r.path, '/lots')", "r.path"))))
    return df.select(*keep, "sheet_name", *KINDS)


def one_delivery(files: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Each file once, as last delivered."""
    return latest(files, ["file_id"], ["loaded_at"], ["sheets", *extra])


def flat_table(files: DataFrame, kind: str, fields: dict[str, str]) -> DataFrame:
    """One target table: links (file, sheet, node and parent path, position) and the named members as typed columns.

    ``fields`` maps a member to its Spark type; a member that is missing or can't be read as the type is null. Members whose
    names clash with a link column get the suffix ``_``.
    """
    links = ["file_id", "sheet_name", "node_path", "parent_path", "pos"]
    df = with_nodes(one_delivery(files)).select("file_id", "sheet_name", F.expr(f"inline({kind})"))
    cols: list[Column] = [F.expr(f"try_variant_get(body, '$.{c}', '{t}')").alias(c + "_" if c in links else c) for c, t in fields.items()]
    return df.select("file_id", "sheet_name", F.col("path").alias("node_path"), F.col("parent").alias("parent_path"), "pos", *cols)


def all_nodes(files: DataFrame) -> DataFrame:
    """Every record of every kind with its parent link: file_id, sheet_name, node_path, parent_path."""
    together = F.concat(*[F.transform(F.col(k), lambda n: F.struct(n["path"].alias("node_path"), n["parent"].alias("parent_path"))) for k in KINDS])
    return with_nodes(one_delivery(files)).select("file_id", "sheet_name", F.inline(together))


def row_table(files: DataFrame) -> DataFrame:
    """The rows of ``data``: their links and the record as JSON (members sorted), since its fields differ from file to file."""
    df = with_nodes(one_delivery(files)).select("file_id", "sheet_name", F.expr("inline(rows)"))
    return df.select("file_id", "sheet_name", F.col("path").alias("node_path"), F.col("parent").alias("parent_path"), "pos", F.to_json("body").alias("record"))
