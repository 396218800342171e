import random

import numpy as np
from tradeloom.functions.text import normalise_company_name
from tradeloom.operators import resolve
from pyspark.sql import functions as F


def _rows(rng, n, first):
    stems = ["mirvan", "gavole", "pedene", "kosezu", "belumo", "dageni", "lopagi", "sisatan", "rapnuran"]
    out = []
    for k in range(n):
        w = [rng.choice(stems), rng.choice(["rubber", "hinge", "brake", "axle", ""])]
        if rng.random() < 0.5:
            i = rng.randrange(len(w[0]))
            w[0] = w[0][:i] + rng.choice("aeiou") + w[0][i + rng.randrange(2) :]
        out.append((first + k, " ".join(w).strip() + rng.choice([" Ltd", "", " Co., Ltd"]), rng.choice([None, "+91 20 5555 000" + str(k % 4)]), rng.choice([None, "Pune", "Koln"]), rng.choice([None, "India", "Germany", ""]), None))
    return out


def _plain(candidates, golden):
    """The rule as a loop over all pairs."""
    digits = lambda p: "".join(ch for ch in p or "" if ch.isdigit())[-10:]
    low = lambda t: (t or "").strip().lower()
    best = {}
    for r, n, p, city, country, _ in candidates:
        for s, m, q, town, land, _ in golden:
            if n and m and (not low(country) or low(country) == low(land)):
                score = min(1.0, resolve.indel_ratio(n, m) + (0.15 if digits(p) and digits(p) == digits(q) else 0))
                score = round(min(1.0, score + (0.10 if low(city) and low(city) == low(town) else 0)), 9)
                if score >= resolve.REVIEW:
                    best[r] = max(best.get(r, (0, 0)), (score, -s))
    return {r: (-s, score) for r, (score, s) in best.items()}


def test_no_match_is_missed(spark):
    rng = random.Random(12)
    cols = "{} bigint, {} string, {} string, city string, country string, {} string"
    c, g = _rows(rng, 120, 1000), _rows(rng, 90, 1)
    cand, gold = spark.createDataFrame(c, cols.format("row_id", "company_name", "phone", "website")), spark.createDataFrame(g, cols.format("id", "canonical_name", "primary_phone", "domain"))
    named = lambda df, k, n: {r[0]: r[1] for r in df.select(k, normalise_company_name(F.col(n))).collect()}
    cn, gn = named(cand, "row_id", "company_name"), named(gold, "id", "canonical_name")
    want = _plain([(r[0], cn[r[0]], *r[2:]) for r in c], [(r[0], gn[r[0]], *r[2:]) for r in g])
    got = {r.row_id: (r.supplier_id, r.score) for r in resolve.fuzzy_matches(cand, gold).collect()}
    assert got == want and len(want) > 60


def test_levels_in_order(spark):
    gold = spark.createDataFrame([(1, "Mirvan Rubber", None, None, "India", None, "A" * 18), (2, "Gavole Axle", None, None, "India", "gavole.example", None), (3, "Pedene Hinge", None, None, "India", None, None)], "id bigint, canonical_name string, primary_phone string, city string, country string, domain string, uscc string")
    cand = spark.createDataFrame([(1, "Pedene Hinge", "https://www.gavole.example/x", None, None, "India", "A" * 18), (2, "Pedene Hinge", "gavole.example", None, None, "India", None), (3, "Pedene Hinge", None, None, None, None, "short"), (4, "Other", None, None, None, "India", None), (5, None, None, None, None, None, None)], "row_id bigint, company_name string, website string, phone string, city string, country string, uscc string")
    got = {r.row_id: (r.supplier_id, r.level, r.decision) for r in resolve.resolve(cand, gold, "uscc").collect()}
    assert got == {1: (1, 1, "merge"), 2: (2, 2, "merge"), 3: (3, 3, "merge"), 4: (None, None, "new"), 5: (None, None, "new")}
    assert resolve.resolve(cand.limit(0), gold).count() == 0


def test_common_lengths_of_many_pairs():
    rng = random.Random(3)
    a, b = (["".join(rng.choice("abcé ") for _ in range(rng.choice([0, 1, 5, 12, 64, 70]))) for _ in range(500)] for _ in range(2))
    assert list(resolve.common_lengths(a, b)) == [resolve.common_length(x, y) for x, y in zip(a, b)]


def test_blocks_miss_no_pair(spark, monkeypatch):
    rng = random.Random(8)
    a, b = (list(dict.fromkeys("".join(rng.choice("abcé \U00020000") for _ in range(rng.choice([1, 5, 9, 12, 64, 70]))) for _ in range(150))) for _ in range(2))
    masks = lambda t: np.array([r[0] for r in spark.createDataFrame([(x,) for x in t], "n string").select(resolve._mask("n")).collect()])
    ma, mb = masks(a), masks(b)
    for share in (0.5, 0.65, 0.75):
        i, j, r = resolve.near_pairs(a, ma, b, mb, share)
        want = {(k, n): resolve.indel_ratio(x, y) for k, x in enumerate(a) for n, y in enumerate(b)}
        assert dict(zip(zip(i, j), r)) == {k: v for k, v in want.items() if v >= share - 1e-9}
    monkeypatch.setattr(resolve, "BLOCK", 16)
    test_no_match_is_missed(spark)


def test_names_are_compared_in_blocks_not_by_letter(spark, monkeypatch):
    """The join by single letters made more rows than there are pairs of names, which ended by time at 0.1 GB."""
    rng = random.Random(4)
    cols = "{} bigint, {} string, {} string, city string, country string, {} string"
    c, g = ([(k, "".join(rng.choice("abcdefgh") for _ in range(12)), None, None, "India", None) for k in range(n)] for n in (300, 400))
    plans, cut = [], resolve.cut

    def seen(df):
        done = cut(df)
        plans.append(df._jdf.queryExecution())
        return done

    monkeypatch.setattr(resolve, "cut", seen)
    resolve.fuzzy_matches(spark.createDataFrame(c, cols.format("row_id", "company_name", "phone", "website")), spark.createDataFrame(g, cols.format("id", "canonical_name", "primary_phone", "domain"))).collect()

    def joined(plan):
        rows = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
        below = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else [plan.children().apply(k) for k in range(plan.children().size())]
        return rows + sum(map(joined, below))

    assert 0 < sum(joined(q.executedPlan()) for q in plans) < len(c) * len(g) / 10
