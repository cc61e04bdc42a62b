"""Nested records and schema drift against brute force on fixtures and the smallest tables."""

import json
from datetime import date, datetime

from pyspark.sql import functions as F

from sheetweave.operators import drift, nested
from tests.conftest import SMALL

SCHEMA = "file_id string, template_id string, period date, sheets string, loaded_at timestamp"


def files(spark, *rows):
    return spark.createDataFrame([(f"F{i}" if fid is None else fid, "T", date(2024, m, 1), s if isinstance(s, str) or s is None else json.dumps(s, ensure_ascii=False), datetime(2024, 1, 1)) for i, (fid, m, s) in enumerate(rows)], SCHEMA)


def unspelled(x):
    if isinstance(x, str):
        try:
            y = json.loads(x)
        except ValueError:
            return x
        return unspelled(y) if isinstance(y, (str, dict, list)) else x
    return x


def listed(x):
    x = unspelled(x)
    return x if isinstance(x, list) else [x] if isinstance(x, dict) else []


def brute(fid, sheets):
    out = set()
    for name, s in (sheets or {}).items():
        s = unspelled(s)
        if not isinstance(s, dict):
            continue

        def add(x, path, parent, then=None):
            for i, e in enumerate(listed(x)):
                e = unspelled(e)
                if isinstance(e, dict):
                    out.add((fid, name, f"{path}/{i}", parent))
                    if then:
                        then(e, f"{path}/{i}")

        def section(e, p):
            add(e.get("entries"), p + "/entries", p)
            add(e.get("children"), p + "/children", p, section)

        add(s.get("sections"), "/sections", "", section)
        mm = unspelled(s.get("media_map"))
        for k, v in (mm if isinstance(mm, dict) else {}).items():
            add(v, f"/media_map/{k}", "")
        d, path = unspelled(s.get("data")), "/data"
        if isinstance(d, dict) and len(d) == 1 and isinstance(unspelled(next(iter(d.values()))), (list, dict)):
            path, d = f"/data/{next(iter(d))}", next(iter(d.values()))
        add(d, path, "", lambda e, p: add(e.get("lots"), p + "/lots", p))
    return out


def deep(n):
    return {"title": f"d{n}", "children": [deep(n - 1), 7, None] if n else []}


def test_nodes_of_odd_shapes(spark):
    shapes = [
        {"S": {"sections": {"title": "lone", "entries": {"label": "x"}}, "media_map": {"B3": {"coord": "B3"}, "unknown": [{"a": 1}, "no", None]}, "data": {"rows": [{"id": 1, "lots": [{"lot": "L"}]}, 5, {"id": 2, "lots": {"lot": "M"}}]}}},
        {"S": {"sections": json.dumps([{"children": json.dumps([{"entries": "[]"}])}]), "media_map": "not json", "data": json.dumps({"表1": [{"id": 1}]}, ensure_ascii=False)}, "T": json.dumps({"data": [{"id": "{}"}]})},
        {"S": {"sections": [deep(9)], "data": None}, "U": None, "V": 3, "W": []},
        {"S": {"data": {"id": 1, "name": "a lone row"}}, "X": {"data": [json.dumps({"id": 1, "lots": "[{\"lot\": 1}]"})]}},
    ]
    df = files(spark, *[(None, 1, s) for s in shapes], (None, 1, None), (None, 1, ""), (None, 1, "[1"), (None, 1, "{}"), ("F0", 1, shapes[0]))
    got = [tuple(r) for r in nested.all_nodes(df.withColumn("pos", F.lit(1)).withColumn("rows", F.lit("clash"))).collect()]
    want = set().union(*(brute(f"F{i}", s) for i, s in enumerate(shapes)))
    assert len(got) == len(set(got)) and set(got) == want


def test_nodes_of_the_table(spark):
    df = spark.read.parquet(f"{SMALL}/full_extractions.parquet")
    want = set().union(*(brute(r.file_id, json.loads(r.sheets)) for r in df.dropDuplicates(["file_id"]).collect()))
    assert {tuple(r) for r in nested.all_nodes(df).collect()} == want


def test_flat_tables_keep_links(spark):
    df = files(spark, (None, 1, {"S": {"data": [{"id": 1, "lots": [{"lot": "A", "pcs": 3}, {"lot": "B", "pcs": "x"}]}]}}))
    got = [tuple(r) for r in nested.flat_table(df, "lots", {"lot": "string", "pcs": "long", "pos": "int"}).orderBy("node_path").collect()]
    assert got == [("F0", "S", "/data/0/lots/0", "/data/0", 0, "A", 3, None), ("F0", "S", "/data/0/lots/1", "/data/0", 1, "B", None, None)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nested.all_nodes(empty).count() == 0 and drift.changes(empty).count() == 0 and drift.unified(empty).count() == 0


def rows(*rs, **more):
    return {"S": {"data": list(rs)}} | more


def test_changes(spark):
    df = files(
        spark,
        (None, 3, rows({"id": 1, "masse": 5, "ort": "x", "n": "7"}, {"id": 3, "masse": 6, "ort": "z", "n": None}, B={"data": []})),
        (None, 1, rows({"id": 1, "mass": 5, "place": "x", "n": 7}, {"id": 2, "mass": None, "place": "y", "n": 8})),
        (None, 2, rows()),
        (None, 4, rows({"id": 3, "masse": 6, "n": None, "new": True})),
        (None, 4, None),
    )
    got = {tuple(r)[1:] for r in drift.changes(df).collect()}
    assert got == {
        ("F0", "S", "renamed", "mass", "masse"), ("F0", "S", "renamed", "place", "ort"), ("F0", "S", "type_changed", "n", "n"), ("F0", "B", "sheet_added", "", ""),
        ("F3", "B", "sheet_removed", "", ""), ("F3", "S", "removed", "ort", ""), ("F3", "S", "added", "", "new"), ("F4", "S", "sheet_removed", "", ""),
    }


def test_no_rename_without_equal_rows(spark):
    df = files(spark, (None, 1, rows({"id": 1, "a": 1})), (None, 2, rows({"id": 1, "b": 2})), (None, 3, rows({"id": 9, "c": 2})))
    got = {(r.file_id, r.change, r.old_field, r.new_field) for r in drift.changes(df).collect()}
    assert got == {("F1", "removed", "a", ""), ("F1", "added", "", "b"), ("F2", "removed", "b", ""), ("F2", "added", "", "c")}


def test_unified_table(spark):
    df = files(spark, (None, 1, rows({"id": 1, "mass": 5}, {"id": 2, "mass": 6})), (None, 2, rows({"id": 1, "masse": 5}, {"id": 2, "masse": 6}, {"id": 3, "masse": "about 7"})))
    got = {(r.file_id, r.row_key): (r.field, r.source_field, r.field_type, r.text_value, r.number_value, r.cast_failed) for r in drift.unified(df).collect()}
    assert got[("F0", 1)] == ("masse", "mass", "number", "5", 5.0, False)
    assert got[("F1", 3)] == ("masse", "masse", "number", "about 7", None, True)
