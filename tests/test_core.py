import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tradeloom.functions.text import extract_domain, normalise_company_name, parse_date, parse_number, valid_code
from tradeloom.operators import contacts, history, resolve
from tradeloom.operators.components import connected_components

SMALL = "/root/testdata/sf0.001"


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
@settings(max_examples=150, deadline=None)
def test_common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    assert resolve.common_length(a, b) == row[-1]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (5, 5), (None, 7)] + [(k, k + 1) for k in range(100, 160)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert [got[k] for k in (1, 2, 3, 4, 10, 11, 5, 160)] == [1, 1, 1, 1, 10, 10, 5, 100] and 7 not in got
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(normalise_company_name(F.lit("Guangzhou ABC Electronics (Nansha) Co., Ltd."))) == "abc electronics"
    assert one(normalise_company_name(F.lit("Shanghai"))) == "shanghai" and one(normalise_company_name(F.lit(None).cast("string"))) == ""
    assert one(extract_domain(F.lit("https://www.Acme.example:443/x?y"))) == "acme.example"
    assert one(valid_code(F.lit("91350100M000100Y43"))) is True and one(valid_code(F.lit("91350100M000100Y44"))) is False and one(valid_code(F.lit(None).cast("string"))) is False
    assert str(one(parse_date(F.lit("5/3/2026")))) == "2026-03-05" and one(parse_number(F.lit("1,200 kg"))) == 1200.0 and one(parse_number(F.lit("3万"))) == 30000.0
    assert one(contacts.emails(F.lit("a [at] b (dot) com, A@b.com, logo@2x.png"))) == ["a@b.com"]


def test_history(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 3, None), ("b", 1, "y"), (None, 9, "z")], "k string, t int, v string")
    assert {tuple(r) for r in history.change_log(rows, "k", ["t"], ["v"]).collect()} == {("a", 2, "v", "x", None)}
    kept = history.insert_or_ignore(rows.where("k = 'b'"), rows, ["k"], "t")
    assert {(r.k, r.t) for r in kept.collect()} == {("b", 1), ("a", 1)}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_queries_equal_sql(spark):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    show = lambda v: round(v, 4) if isinstance(v, float) else None if v is None else str(v) if not isinstance(v, (int, bool)) else v
    known = entry.queries()
    for name, sql in entry.oracle_sql().items():
        df = known[name](spark, SMALL)
        cols = sorted(df.columns)
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        theirs = sorted((tuple(show(v) for _, v in sorted(zip(names, row))) for row in cur.fetchall()), key=str)
        ours = sorted((tuple(show(r[c]) for c in cols) for r in df.collect()), key=str)
        assert cols == sorted(names) and ours == theirs, name
    assert entry.entry(spark).columns
