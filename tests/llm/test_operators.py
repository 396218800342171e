import datetime as dt
import json
import random
import re

import pytest

from tradeloom.llm import address_parts, boilerplate, company_names, contamination
from tradeloom.llm.addresses import NEIGHBOURS, locations, same_location
from tradeloom.llm.boilerplate import aligned_nodes, body_lines
from tradeloom.llm.contamination import WINDOW, Patterns, leaks, words
from tradeloom.llm.entity_match import match_entities
from tradeloom.llm.mixing import STEPS, mixture, schedule
from tradeloom.llm.residue import clean_documents, residue_documents
from tradeloom.llm.survivors import fieldwise, survivors, with_facts


# p1
def test_tree_matching_against_brute_force():
    def longest(a, b):
        return 0 if not a or not b else max(longest(a[1:], b), longest(a, b[1:]), 1 + longest(a[1:], b[1:]) if a[0] == b[0] else 0)

    rng = random.Random(3)
    for _ in range(200):
        a, b = [rng.randrange(5) for _ in range(rng.randrange(7))], [rng.randrange(5) for _ in range(rng.randrange(7))]
        got = aligned_nodes(a, b)
        pairs = [(i, j) for i, j in enumerate(got) if j >= 0]
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == longest(a, b)
        assert all(p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_order_matters():
    assert aligned_nodes([1, 2, 3], [3, 1, 2]) == [1, 2, -1]  # a line that moved is not constant


def test_wrapper_of_the_host_comes_first(spark):
    """A teaser that reads the same on every page of a host is furniture, though it reads like content."""
    words = "amber birch cedar delta ember frost grove heron".split()
    pages = [(k, f"https://www.one.example/p{k}", "\n".join(["Menu", f"Headline about {w}", f"The {w} hall was built in {1950 + k} by {w} masters.", "Mirvan Tools keeps about 731 sets in stock.", "Imprint"])) for k, w in enumerate(words[:4])]
    got = {(r.page_id, r.line_no) for r in body_lines(spark.createDataFrame(pages, "page_id bigint, url string, text string")).collect()}
    assert got == {(k, n) for k in range(4) for n in (2, 3)}


def test_bodies(spark):
    pages = []
    for h in range(6):
        for p in range(4):
            w = ["red", "blue", "green", "grey"][p]  # the four pages of a host say different things
            body = [f"Offer for {h * 7 + p} sets of {w} hooks", f"The {w} order of {p + 3} pieces left hall {h} after a test of {p} hours.", f"Colour {w}"]
            pages.append((h * 10 + p, f"https://www.firm{h}.example/p{p}", "\n".join(["Home | Products", "Accept all", "", *body, f"© 20{h}0 Firm{h}. All rights reserved.", "Back to top"])))
    pages += [(900, "https://www.firm0.example/p0", pages[0][2]), (901, None, None), (902, "https://x.example/", ""), (903, None, "Accept all\nA lone page tells one long sentence here.")]
    got = {}
    for r in body_lines(spark.createDataFrame(pages, "page_id bigint, url string, text string")).collect():
        got.setdefault(r.page_id, []).append(r.line_no)
    assert all(sorted(got[k]) == [4, 5, 6] for k, _, _ in pages[:25]) and 901 not in got and 902 not in got and got[903] == [2]
    assert body_lines(spark.createDataFrame([], "page_id bigint, url string, text string")).count() == 0
    assert boilerplate.REFERENCES >= 2


# p2
def test_survivors(spark):
    t = lambda d: dt.datetime(2026, 1, d)
    full = json.dumps({"companyName": "A", "country": "DE", "mainProducts": ["x"]})
    rows = [(1, 1, "alibaba", full, t(3)), (2, 1, "hktdc", json.dumps({"company_name": "A", "country": "n/a"}), t(2)), (3, 2, "hktdc", full, t(1)), (4, 2, "hktdc", full, t(1)), (5, None, "hktdc", full, t(1)), (6, 3, None, None, None), (7, 4, "none", "{", t(1))]
    df = spark.createDataFrame(rows, "raw_id bigint, golden_record_id bigint, source string, raw_json string, scraped_at timestamp")
    trust = spark.createDataFrame([("alibaba", 70), ("hktdc", 60)], "source string, trust int")
    facts = with_facts(df, trust)
    got = {r.golden_record_id: r for r in survivors(facts).collect()}
    assert got[1].raw_id == 1 and got[1].agreed and got[1].members == 2 and got[1].completeness == 3
    assert got[2].raw_id == 4 and got[2].members == 2 and got[3].raw_id == 6 and got[4].completeness == 0
    assert {r.golden_record_id for r in fieldwise(facts).collect()} == {1, 2, 3, 4} and survivors(facts.limit(0)).count() == 0


# p5
def test_entities(spark):
    s = [(1, "Gavole Rubber GmbH", "gavolerubber.example", "0221 5551 2345", "Köln", "Germany"), (2, "Gavole Rubber Pvt Ltd", None, "+91 281 5550 0001", "Rajkot", "India"), (3, None, None, None, None, None), (4, "Other Hinge Ltd", None, "0221 5551 2345", "Köln", "Germany"), (5, "Koln Filler AG", None, None, "Köln", "Germany"), (6, "Rajkot Filler", None, None, "Rajkot", "India")]
    u = [(1, "gavolerubber", None, None, "Koeln", "Germany"), (2, "Rubber Gavole Works", "https://www.gavolerubber.example/x", None, None, None), (3, "Gavloe Rubber", None, "0049 221 5551 2345", None, "Germany"), (4, "", None, None, None, None), (5, "Gavole Rubber", None, None, "Rajkot", "India")]
    cols = "{} bigint, {} string, {} string, {} string, city string, country string"
    left, right = spark.createDataFrame(s, cols.format("id", "canonical_name", "domain", "primary_phone")), spark.createDataFrame(u, cols.format("row_id", "company_name", "website", "phone"))
    got = match_entities(left, right).collect()
    assert {(r.supplier_id, r.row_id) for r in got} >= {(1, 1), (1, 2), (2, 5)} and all(0 <= r.confidence <= 1 for r in got)
    assert not {(r.supplier_id, r.row_id) for r in got} & {(2, 1), (4, 3), (1, 5), (2, 3)}
    assert match_entities(left.limit(0), right.limit(0)).count() == 0
    assert company_names.own_domain("https://s123.market.example/x") == "" and company_names.phone("+86 512 5523 2179 ext. 7") == "55232179"


# p7
def test_addresses(spark):
    rows = [
        (1, "Köln", "Mirvanstraße 600, 50733 Köln, Germany", "50733 KOELN / Mirvanstr. 600"), (2, "Koeln", "Mirvnastr. Nr. 600 - Cologne", "N/A"), (3, "Köln", "Mirvanstraße 601, 50733 Köln", None),
        (4, "Qingdao", "Unit 3, No. 12 Ganemu Street, Qingdao, Shandong, 266137, China", "12 ganemu st, tsingtao"), (5, "Qingdao", "No. 12 Ganemu Street, 266137", " "), (6, "Suzhou", "No. 12 Ganemu Street, Suzhou, 215166", "-"), (7, "Suzhou", "nowhere", None), (8, "Suzhou", "nowhere", None), (9, "Qingdao", "No. 7 Other Road, Qingdao, 266100", None),
    ]
    df = spark.createDataFrame(rows, "id bigint, city string, address string, factory_location string")
    got = {tuple(r) for r in same_location(df).collect()}
    a, f = "address", "factory_location"
    assert got == {(1, a, 1, f), (1, a, 2, a), (1, f, 2, a), (4, a, 4, f), (4, a, 5, a), (4, f, 5, a)}
    assert locations(df).count() == 11 and same_location(df.limit(0)).count() == 0


def test_units_are_checked_on_demand(spark):
    rows = [(1, "Pune", "Unit 3, No. 12 Ganemu Road, Pune", "Unit 4, 12 Ganemu Rd, Pune"), (2, "Pune", "Unit 3, 12 Ganmeu Road, Pune", None)]
    df = spark.createDataFrame(rows, "id bigint, city string, address string, factory_location string")
    for strict, places in ((False, 1), (True, 2)):
        got = {(r.id, r.field): r.location for r in locations(df, strict).collect()}
        assert len(set(got.values())) == places and got[1, "address"] == got[2, "address"]


def test_blocks_longer_than_the_window(spark):
    """A block of 300 streets with one house number: every pair within the slips is linked, by brute force."""
    rng = random.Random(8)
    base = ["".join(rng.choice("bdgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(100)]
    streets = sorted({t for b in base for t in (b, b[:2] + b[3] + b[2] + b[4:], "q" + b[1:])})
    df = spark.createDataFrame([(k, "Pune", f"No. 12 {t} Road, Pune", None) for k, t in enumerate(streets)], "id bigint, city string, address string, factory_location string")
    got = {r.id: r.location for r in locations(df).collect()}
    group = list(range(len(streets)))
    for i, x in enumerate(streets):
        for j in range(i):
            if address_parts.slips(x, streets[j]) <= 1:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    assert len(streets) > NEIGHBOURS + 1
    assert all((got[i] == got[j]) == (group[i] == group[j]) for i in got for j in range(0, i, 3))


def test_slips():
    for a, b, n in (("abc", "abc", 0), ("abc", "acb", 1), ("abc", "ab", 1), ("abcd", "badc", 2), ("", "xy", 2), ("kitten", "sitting", 3)):
        assert address_parts.slips(a, b) == address_parts.slips(b, a) == n


# p8
def test_leaks_against_plain_search(spark):
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=30))) for i in range(8)]
    p = Patterns(items)
    for _ in range(100):
        doc = rng.choices(vocab, k=60)
        i = rng.randrange(8)
        doc[20:40] = words(items[i][1])[5:25]
        plain = {j for j, t in items for x in range(len(doc) - WINDOW + 1) for y in range(26) if doc[x : x + WINDOW] == words(t)[y : y + WINDOW]}
        assert set(p.occurrences(doc)) == plain and i in p.leaked(" ".join(doc))
    text = items[0][1]
    docs = [(1, text.upper().replace(" ", " \n> ")), (2, " ".join(text.split()[:8])), (3, None), (4, ""), (5, "x " * 100_000 + text), (6, re.sub(r"w(\d)", r"**w\1**", text, count=3)), (6, text)]
    got = {tuple(r) for r in leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*items, (99, None)], "item_id bigint, text string")).collect()}
    assert got == {(1, 0), (5, 0), (6, 0)}


def test_more_items_than_one_set_of_tables(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(f"v{rng.randrange(500)}" for _ in range(12))) for i in range(30)]
    docs = spark.createDataFrame([(i, "before " + t + " after") for i, t in items] + [(99, None)], "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(tuple(r) for r in leaks(docs, table).collect())
    monkeypatch.setattr(contamination, "MAX_ITEM_CHARS", 300)
    assert sorted(tuple(r) for r in leaks(docs, table).collect()) == whole == [(i, i) for i, _ in items]


# p9
def test_mixture(spark):
    docs = [(i, "abc"[i % 3], f"text number {i} with some more words") for i in range(90)] + [(900, "a", None), (901, "a", ""), (902, None, "x"), (903, "z", "untargeted")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 1), ("none", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    corpus, report = mixture(df, targets)
    rows, rep = corpus.collect(), {r.source: r for r in report.collect()}
    assert {r.source for r in rows} == {"a", "b"} and max(r["copy"] for r in rows) <= 1 and all(-1e-9 <= r.position < 1 for r in rows)
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert rep["none"].tokens == 0 and rep["a"].tokens >= rep["a"].demand and rep["a"].copies == sum(r.source == "a" for r in rows)
    assert mixture(df.limit(0), targets)[0].count() == 0
    with pytest.raises(ValueError):
        mixture(df.withColumnRenamed("doc_id", "copy"), targets)


def test_weights_sum_to_one_and_shares_stay():
    shares = {"a": 0.6, "b": 0.3, "c": 0.1, "d": 0.0}
    w = schedule(shares, {"a": [(0, 2.0), (1, 0.2)], "c": [(0, 0.1), (0.5, 3.0), (1, 0.1)]})
    assert set(w) == {"a", "b", "c"} and w["a"][0] > w["a"][-1] and schedule({}) == {}
    assert all(abs(sum(x[k] for x in w.values()) - 1) < 1e-9 for k in range(STEPS))
    assert all(abs(x.mean() - shares[s]) < 1e-6 for s, x in w.items())


def test_positions_follow_the_schedule(spark):
    docs = [(i, "ab"[i % 2], f"text {i} has these words") for i in range(2000)] + [(7, "b", "text 7 has these words")] * 2
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    corpus, _ = mixture(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), targets, shapes={"a": [(0, 3.0), (1, 1.0)]})
    rows = corpus.collect()
    assert sum(r.doc_id == 7 and r["copy"] == 0 for r in rows) == 3  # repeated rows are texts of their own
    w = schedule({"a": 0.5, "b": 0.5}, {"a": [(0, 3.0), (1, 1.0)]})
    for low in range(0, STEPS, 16):
        part = [r for r in rows if low / STEPS <= r.position < (low + 16) / STEPS]
        share = sum(r.n_tokens for r in part if r.source == "a") / sum(r.n_tokens for r in part)
        assert abs(share - w["a"][low : low + 16].mean()) < 0.03


# p10
def test_residue(spark):
    bad = ["Dear {{name}}, thank you.", "404 - Page not found", "You need to enable JavaScript to run this app.", "Good text here.\nLorem ipsum dolor sit amet consectetur adipiscing elit.", "Contact: undefined, phone on request.", "TBD TBD TBD.", "页面不存在或已被删除，5秒后返回首页。"]
    good = ["Fault code 404 means that the sensor is open.", "The portal asks for JavaScript, but the unit works without it.", "The words lorem ipsum mark the field that we fill.", "Undefined edges are broken to 0.5 mm.", "The key [A] opens the lock.", "The order key is {series}{bore}{length}.", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*bad, *good, bad[1]])], "doc_id bigint, text string")
    got = {r.doc_id for r in residue_documents(df).collect()}
    assert got == {*range(len(bad)), len(bad) + len(good)}
    assert clean_documents(df).count() == len(good) and residue_documents(df.limit(0)).count() == 0
