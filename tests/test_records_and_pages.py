import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradeloom.functions import web
from tradeloom.operators import contacts, records, search, taxonomy
from tradeloom.sinks import exports
from tradeloom.sources.pages import page_fields, read_page, url_candidates
from tradeloom.sources.readers import JsonLines, StaticList, header_map, linked_items, read_all, repeated_rows
from tradeloom.streaming import incremental

PAGE = """<html><head><title>Mirvan &amp; Co</title><style>p {}</style></head><body><h1>Axles</h1><p>We make <b>axles</b>.</p>
<a href="/contact">Contact</a><a href="https://other.example/">x</a><a href="mailto:Sales@mirvan.example?subject=a">mail</a><a href="tel:+49 (221) 55">call</a><a href="https://www.linkedin.com/company/m">in</a><a href="/c.pdf">pdf</a>
<img src="/logo.png"><img src="/hall.jpg"><form><textarea></textarea></form><footer>Mirvanstr. 6<br>Köln</footer><script>var a = "<p>no</p>";</script></body></html>"""


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE, "https://www.mirvan.example/"), (2, None, None), (3, "<p>open <b", "x"), (4, "", "")], "id int, html string, url string")
    got = {r.id: r.p for r in df.select("id", page_fields("html", "url").alias("p")).collect()}
    p = got[1]
    assert (p.title, p.footer_text, p.has_contact_form) == ("Mirvan & Co", "Mirvanstr. 6\nKöln", True) and p.text.startswith("Axles\nWe make axles.") and "no" not in p.text.split("\n")
    assert (p.links, p.image_urls, p.mailto_emails, p.tel_phones) == (["https://www.mirvan.example/contact"], ["https://www.mirvan.example/hall.jpg"], ["Sales@mirvan.example"], ["+4922155"])
    assert p.social_links == ["https://www.linkedin.com/company/m"] and p.downloads == ["https://www.mirvan.example/c.pdf"] and got[2].text == "" and got[4].links == []
    assert read_page("<a href='http://[bad'>x</a>", "https://a.example")["links"] == []
    assert value(spark, url_candidates(F.lit("http://www.a.example/x"))) == ["http://www.a.example/x", "https://www.a.example/x", "https://a.example/x", "http://a.example/x"]
    assert value(spark, url_candidates(F.lit(None).cast("string"))) == []


def test_phones_and_mails(spark):
    text = "Tel +49 221 5551 234 / WhatsApp: +90 555 123 45 67\nFax. +49 221 5551 235. Again +49 221 5551 234, 微信 +86 138 0013 8000"
    got = [(r.number, r.kind) for r in value(spark, contacts.typed_phones(F.lit(text)))]
    assert got[0] == ("+492215551234", "other") and ("+492215551235", "fax") in got and ("+905551234567", "whatsapp") in got
    assert value(spark, contacts.typed_phones(F.lit(None).cast("string"))) == []
    mails = value(spark, contacts.emails(F.lit("Info[at]a.example (dot) x b@logo.png noreply@a.example sales (at) mirvan [dot] de, sales@mirvan.de")))
    assert "sales@mirvan.de" in mails and not {"b@logo.png", "noreply@a.example"} & set(mails)
    assert value(spark, contacts.mailto_emails(F.lit(None).cast("array<string>"))) == []


def test_taxonomy_veto(spark):
    keys = lambda t: value(spark, taxonomy.categories_of(F.lit(t)))
    assert keys("air spring") == [] and keys("air spring, leaf spring") == ["suspension"] and "suspension" in keys("air suspension")  # a plain word inside a veto counts
    assert keys("fifth wheel") == [] and keys(None) == [] and len(taxonomy.CATEGORIES) == 28


def test_records(spark):
    gold = spark.createDataFrame([(1, "", ["a"]), (2, "x", None)], "id int, city string, tags array<string>")
    up = spark.createDataFrame([(1, "y", ["b", "a"]), (2, "z", ["c"]), (9, "q", [])], "id int, city string, tags array<string>")
    assert {tuple(map(str, r)) for r in records.merged(gold, up, "id", ("city",), ("tags",)).collect()} == {("1", "y", "['a', 'b']"), ("2", "x", "['c']")}
    assert records.merged(gold, up.limit(0), "id", ("city",)).count() == 2
    assert {r.id for r in records.upserted(gold.select("id", "city"), up.select("id", "city"), ["id"]).collect()} == {1, 2, 9}
    assert {r.id for r in records.without(gold, "id", up.where("id = 2").select("id")).collect()} == {1}
    t = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 5.0), ("b", 1, None)], "g string, k int, w double")
    assert {(r.g, r.k) for r in records.until_total(t, "g", [F.col("k")], "w", 8).collect()} == {("a", 1), ("a", 2), ("b", 1)}


def test_search_conditions(spark):
    rows = spark.createDataFrame([(1, "Axle Ltd", ["Torsion Axle"], None, True, 50, "India", None), (2, "Axle AG", ["Hinge"], ["axles"], None, None, "Germany", True), (3, None, None, None, None, 10, None, False)], "id int, canonical_name string, product_keywords array<string>, primary_categories array<string>, is_manufacturer boolean, composite_score int, country string, flagged boolean")
    ids = lambda **kw: [r.id for r in search.search(rows, **kw).collect()]
    assert ids() == [1, 3] and ids(product="AXLE") == [1] and ids(required=["torsion axle"]) == [1] and ids(required=["no"]) == [] and ids(country="india", least_score=60) == []
    assert search.list_suppliers(rows, ids=[]).count() == 0 and [r.id for r in search.list_suppliers(rows, limit=1, offset=1).collect()] == [3]
    assert [r.id for r in search.needing(rows, "primary_categories", ("canonical_name",)).collect()] == [1]
    with pytest.raises(ValueError):
        search.by_certificate(rows, "id")


def test_text_functions(spark):
    v = lambda c: value(spark, c)
    assert v(web.title_names(F.lit("A - B | C"))) == ["A - B | C", "A", "B", "C"] and v(web.title_names(F.lit(None).cast("string"))) == []
    assert v(web.slug(F.lit("--"))) == "page" and v(web.redact(F.lit("a?token=x&b=1"))) == "a?token=***&b=1" and v(web.quoted(F.lit("a b/c"))) == "a%20b/c"
    assert v(web.e_mark(F.lit("E4 37R-0123"))) and not v(web.e_mark(F.lit(None).cast("string"))) and v(web.role_of_title(F.lit("Founder & Buyer"))) == "ceo"
    assert v(web.three_years_on(F.lit(dt.date(2024, 2, 29)))) == dt.date(2027, 2, 28)


def test_sources(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"a": 1}\n{"a": \n')
    got = read_all(spark, [JsonLines("j", str(tmp_path / "p.jsonl")), StaticList("s", ({"name": "Ü"},))])
    assert sorted((r.source, r.processing_status) for r in got.collect()) == [("j", "failed"), ("j", "pending"), ("s", "pending")] and read_all(spark, []).count() == 0
    assert header_map(["Business Name ", "COMPANY WEBSITE"]) == {"company_name": "Business Name ", "website": "COMPANY WEBSITE"}
    rows = spark.createDataFrame([(0, "A", "a.example"), (1, " A ", "a.example"), (2, None, None), (3, "", ""), (4, "A", None)], "i int, company_name string, website string")
    assert [tuple(r) for r in repeated_rows(rows, "i").collect()] == [(1, 0)]
    pages = spark.createDataFrame([(1, '<script type="application/ld+json">{"itemListElement": [{"item": {"name": "A"}}, {"name": "B"}]}</script>'), (2, '<h3 class="company-name"><a>C</a></h3>'), (3, None)], "id int, html string")
    assert sorted((r.id, r.pos, r.item) for r in linked_items(pages, "id", "html").collect()) == [(1, 0, '{"name":"A"}'), (1, 1, '{"name":"B"}'), (2, 0, '{"name":"C"}')]


def test_exports(spark, tmp_path):
    text = spark.createDataFrame([('a "q"\nb', "x; y")], "a string, b string")
    exports.write_csv(text, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert [tuple(r) for r in back.collect()] == [('a "q"\nb', "x; y")]
    lines = exports.markdown_lines(text, F.col("b"), {"A": F.lit("1"), "B": F.lit("")}, [F.col("a")]).collect()
    assert lines[0].no == 1 and lines[0].line == "### 1. x; y\n**A:** 1"
    assert len(exports.SUPPLIER_COLUMNS) == 31


def test_upsert_stream(spark, tmp_path):
    d, cols = str(tmp_path), "k string, at int, v string"
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], cols).coalesce(1).write.parquet(d + "/in")
    for more in ((), (("a", 2, "z"), ("b", 0, "old"))):
        if more:
            spark.createDataFrame(more, cols).coalesce(1).write.mode("append").parquet(d + "/in")
        stream = incremental.arrivals(spark, d + "/in", spark.read.parquet(d + "/in").schema)
        incremental.upsert_stream(stream, d + "/out", ["k"], "at", d + "/cp")
    assert {tuple(r) for r in incremental.current(spark, d + "/out").collect()} == {("a", 2, "z"), ("b", 1, "y")}
