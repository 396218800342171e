import json

import pandas as pd

from tradeloom.functions.payload import schema_paths, value_paths
from tradeloom.operators.drift import changes_of, consistent_tables, schema_changes
from tradeloom.operators.nested import array_elements, flat_tables


def brute(rows):
    out = set()

    def walk(v, path, idx, key):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, [*path, k], idx, key)
        elif isinstance(v, list):
            for n, x in enumerate(v):
                if not isinstance(x, list):
                    out.add((key, ".".join(path), ".".join(map(str, [*idx, n]))))
                walk(x, path, [*idx, n], key)

    for key, raw in rows:
        try:
            v = json.loads(raw)
            v = json.loads(v) if isinstance(v, str) else v
        except (TypeError, ValueError):
            continue
        walk(v, [], [], key)
    return out


ROWS = [
    (1, json.dumps({"a": [{"b": [1, "x", None]}, {"b": []}, {"c": 2}], "@g": [{"it em": [{"z": [0.5]}]}]})),
    (2, json.dumps(json.dumps({"a": ["s"], "n": {"m": [[1, 2], [3, {"q": [4]}], 5]}}))),
    (3, '{"a": [1, 2'),
    (4, '{"a": [1]} trailing'),
    (5, None),
    (6, ""),
    (7, "[1, {\"k\": [2]}]"),
    (8, '{"it\'s": [1], "quo\\"te": {"x": [2]}}'),
    (9, '{"a": "not a list"}'),
    (10, '{"a": null}'),
]


def test_elements_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "raw_id bigint, raw_json string")
    got = {(r.raw_id, r.array_path, r.idx) for r in array_elements(df, "raw_id", "raw_json").collect()}
    assert got == brute(ROWS)
    assert array_elements(df.limit(0), "raw_id", "raw_json").count() == 0


def test_flat_tables_keep_parents(spark):
    t = flat_tables(spark.createDataFrame(ROWS[:1], "raw_id bigint, raw_json string"), "raw_id", "raw_json")
    parents = {r.idx for r in t["a"].collect()}
    assert {r.parent_idx for r in t["a.b"].collect()} <= parents and t["a.b"].count() == 3


def test_schema_text_and_values_agree():
    v = {"a": [{"b c": 1}], "d": {"e": "x"}}
    paths, whole = schema_paths("OBJECT<a: ARRAY<OBJECT<`b c`: BIGINT>>, d: OBJECT<e: STRING>>")
    assert whole and paths == value_paths(v)


def _months():
    rows = []
    for m in range(1, 7):
        for i in range(30):
            p = {"name": f"firm {i}", "tel" if m < 3 else "phone": f"+86 {i:03d} 555", "size": i if m < 4 else str(i)}
            if m >= 5:
                p["extra"] = {"deep": i}
            if m < 6:
                p["fax"] = f"{i}-77"
            rows.append((m * 100 + i, "s", f"2026-{m:02d}", json.dumps(p)))
    rows += [(1, "s", "2026-01", None), (2, "s", "2026-02", "{"), (3, None, "2026-02", "{}"), (4, "s", None, '{"odd": 1}')]
    return rows


def test_changes(spark):
    df = spark.createDataFrame(_months(), "raw_id bigint, source string, month string, raw_json string")
    got = {tuple(r) for r in schema_changes(df, "source", "month", "raw_json").collect()}
    assert got == {("s", "2026-03", "renamed", "tel", "phone"), ("s", "2026-04", "retyped", "size", "size"), ("s", "2026-05", "added", "", "extra"), ("s", "2026-06", "removed", "fax", "")}
    assert schema_changes(df.limit(0), "source", "month", "raw_json").count() == 0
    assert changes_of(pd.DataFrame({"file": [], "path": [], "type": [], "shape_bin": [], "word_bin": [], "n": []})) == []


def test_consistent_table_reports_failed_casts(spark):
    rows = [(i, "s", f"2026-0{1 + i // 10}", json.dumps({"v": "bad" if i == 3 else str(i)} if i < 10 else {"v": i})) for i in range(20)]
    tables, failed = consistent_tables(spark.createDataFrame(rows, "raw_id bigint, source string, month string, raw_json string"), "source", "month", "raw_json", "raw_id")
    assert tables["s"].where("`f.v` IS NOT NULL").count() == 19
    assert [(r.field, r.from_type, r.to_type, r.n) for r in failed.collect()] == [("v", "string", "double", 1)]
