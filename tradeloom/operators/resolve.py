"""Resolution of candidates against golden records, and merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tradeloom.functions.text import extract_domain, normalise_company_name
from tradeloom.runtime import cut

#: Scores from which a pair is merged or reviewed, and the least that is looked at; boosts for phone and city.
MERGE, REVIEW, FLOOR, PHONE_BOOST, CITY_BOOST = 0.92, 0.75, 0.50, 0.15, 0.10
#: Names of a block, pairs of blocks in a task, and pairs of names compared at once; they change memory, not results.
BLOCK, BATCH, PAIRS = 2048, 32, 65536


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        u = row & masks.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Normalised insert/delete similarity in [0, 1]; two empty texts are equal."""
    return 1.0 if not a and not b else 2 * common_length(a, b) / (len(a) + len(b))


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """``common_length`` of every pair, bit-parallel over all pairs at once; texts over 64 letters one by one."""
    count = len(a)
    if not count:
        return np.zeros(0, dtype=np.int64)
    codes = [np.array(t, dtype="U64").view(np.uint32).reshape(count, 64) for t in (a, b)]
    seen = np.zeros(int(max(codes[0].max(), codes[1].max())) + 1, dtype=bool)
    for some in (0, *codes):
        seen[some] = True
    x, y = ((np.cumsum(seen) - 1)[c] for c in codes)
    lane, one = np.arange(count), np.uint64(1)
    masks = np.zeros((count, int(seen.sum())), dtype=np.uint64)
    width = np.fromiter(map(len, a), dtype=np.int64, count=count)
    for i in range(int(min(width.max(), 64))):
        live = i < width
        masks[lane[live], x[live, i]] |= one << np.uint64(i)
    masks[:, 0] = 0  # behind the ends
    row = np.full(count, ~np.uint64(0))
    for j in range(int(min(max(map(len, b)), 64))):
        u = row & masks[lane, y[:, j]]
        row = (row + u) | (row - u)
    out = np.bitwise_count(~row).astype(np.int64)
    for k in range(count):
        if width[k] > 64 or len(b[k]) > 64:
            out[k] = common_length(a[k], b[k])
    return out


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = a.fillna("").tolist(), b.fillna("").tolist()
    size = np.fromiter((len(s) + len(t) for s, t in zip(x, y)), dtype=np.int64, count=len(x))
    return pd.Series(np.where(size == 0, 1.0, 2 * common_lengths(x, y) / np.maximum(size, 1)))


def _mask(name: str) -> Column:
    """64 bits of a name's counted letters; two masks never differ in more bits than the names in letters."""
    chars = f"filter(split({name}, ''), ch -> ch <> '')"
    marks = f"transform({chars}, (ch, i) -> concat(ch, size(filter(slice({chars}, 1, i + 1), o -> o = ch))))"
    return F.expr(f"aggregate({marks}, 0L, (a, t) -> a | shiftleft(1L, cast(pmod(xxhash64(t), 64) AS int)))")


def _common_of(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``common_length`` of ``a[i]`` and ``b[j]`` of every pair; each text's letters are laid out once however many pairs it is in."""
    x, y = (np.array(t, dtype="U64").view(np.uint32).reshape(len(t), 64) for t in (a, b))
    seen = np.zeros(int(max(x.max(), y.max())) + 1, dtype=bool)
    for some in (0, x, y):
        seen[some] = True
    code = np.cumsum(seen) - 1
    x, y, lane = code[x], np.ascontiguousarray(code[y].T), np.arange(len(a))
    masks = np.zeros((len(a), int(code[-1]) + 1), dtype=np.uint64)
    for t in range(64):
        masks[lane, x[:, t]] |= np.uint64(1) << np.uint64(t)
    masks[:, 0] = 0  # behind the ends
    la, lb = (np.fromiter(map(len, t), dtype=np.int64, count=len(t)) for t in (a, b))
    out, flat = np.empty(len(i), dtype=np.int64), masks.ravel()
    for at in range(0, len(i), PAIRS):
        p, q = i[at : at + PAIRS], j[at : at + PAIRS]
        row, base = np.full(len(p), ~np.uint64(0)), p * masks.shape[1]
        for t in range(int(min(lb[q].max(), 64))):
            u = row & flat[base + y[t, q]]
            row = (row + u) | (row - u)
        out[at : at + PAIRS] = np.bitwise_count(~row)
    for k in np.flatnonzero((la[i] > 64) | (lb[j] > 64)):
        out[k] = common_length(a[i[k]], b[j[k]])
    return out


def near_pairs(a: list[str], mask: np.ndarray, b: list[str], mask2: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, r) of all pairs of ``a[i]`` and ``b[j]`` whose ratio r reaches ``share``.

    Every pair is looked at: lengths and masks rule out what cannot reach ``share``, the rest is compared.
    """
    la, lb = (np.fromiter(map(len, t), dtype=np.int64, count=len(t)) for t in (a, b))
    order = np.argsort(lb, kind="stable")
    size, bits = lb[order], mask2.view(np.uint64)[order]
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(la):
        at = np.flatnonzero(2 * np.minimum(n, size) >= share * (n + size) - 1e-9)
        if at.size:
            near = slice(at[0], at[-1] + 1)
            most = np.minimum(np.floor((1 - share) * (n + size[near]) + 1e-9), 64).astype(np.uint8)
            rows = np.flatnonzero(la == n)
            for k in range(0, len(rows), 64):
                some = rows[k : k + 64]
                x, y = np.nonzero(np.bitwise_count(mask.view(np.uint64)[some][:, None] ^ bits[near]) <= most)
                first.append(some[x])
                second.append(order[at[0] + y])
    i, j = np.concatenate(first), np.concatenate(second)
    r = 2 * _common_of(a, b, i, j) / (la[i] + lb[j]) if len(i) else np.zeros(0)
    good = r >= share - 1e-9
    return i[good], j[good], r[good]


#: Routes that compare all names within equal keys: the country's, and the city's where the boost for it counts; with the ratio that is left to reach.
_ROUTES = (REVIEW, REVIEW - CITY_BOOST)
_KEYS = ["route", "place", "town"]


def _blocks(keyed: DataFrame, name: str, block: str, mask: str) -> DataFrame:
    """(route, place, town, block, names, masks): distinct names within equal keys, in blocks of about BLOCK."""
    some = keyed.select(F.explode("keys").alias("k"), "n", "mask").select("k.*", "n", "mask").distinct()
    sizes = some.groupBy(*_KEYS).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("_of"))
    placed = some.join(sizes, _KEYS).withColumn(block, F.expr("pmod(xxhash64(n), _of)"))
    packed = placed.groupBy(*_KEYS, block).agg(F.array_sort(F.collect_list(F.struct("n", "mask"))).alias("x"))
    return cut(packed.select(*_KEYS, block, F.col("x.n").alias(name), F.col("x.mask").alias(mask)))


def _near_names(c: DataFrame, g: DataFrame) -> DataFrame:
    """(n, m, r) of all distinct names within the keys of a route whose ratio reaches what the route asks for."""
    key = lambda route, place, town: F.struct(F.lit(route).alias("route"), place.alias("place"), town.alias("town"))
    none, country, city = F.lit(""), F.col("country"), F.col("city")
    within = lambda *places: F.concat(F.array(*[key(0, p, none) for p in places]), F.when(city != "", F.array(*[key(1, p, city) for p in places])).otherwise(F.array().cast("array<struct<route:int,place:string,town:string>>")))
    left = _blocks(c.withColumn("keys", within(country)), "names", "_i", "masks")
    right = _blocks(g.withColumn("keys", within(country, none)), "names2", "_j", "masks2")
    count = left.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("x")).join(right.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("y")), _KEYS).agg(F.sum(F.expr("x * y"))).first()[0] or 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for route, a, mask, b, mask2 in batch.itertuples(index=False):
                a, b = np.array(a, dtype=object), np.array(b, dtype=object)
                i, j, r = near_pairs(a.tolist(), np.array(mask), b.tolist(), np.array(mask2), _ROUTES[route])
                for at in range(0, len(i), PAIRS):
                    p, q = i[at : at + PAIRS], j[at : at + PAIRS]
                    yield pd.DataFrame({"n": a[p].astype(object), "m": b[q].astype(object), "r": r[at : at + PAIRS]})

    both = left.join(right.hint("merge"), _KEYS).repartition(max(1, -(-count // BATCH)), *_KEYS, "_i", "_j")
    return both.select("route", "names", "masks", "names2", "masks2").mapInPandas(run, "n string, m string, r double")


def _same_phone(c: DataFrame, g: DataFrame) -> DataFrame:
    """(n, m, r) of names whose rows have one phone, in one country or without one, if the boosts can bring them to REVIEW."""
    left = c.where("phone <> ''").select("phone", "country", "city", "n", "mask").distinct()
    right = g.where("phone <> ''").select("phone", F.col("country").alias("country2"), F.col("city").alias("city2"), F.col("n").alias("m"), F.col("mask").alias("mask2")).distinct()
    share = REVIEW - PHONE_BOOST - F.when((F.col("city") != "") & (F.col("city") == F.col("city2")), CITY_BOOST).otherwise(0.0)
    both, short = F.length("n") + F.length("m"), F.least(F.length("n"), F.length("m"))
    alike = (2 * short >= share * both - 1e-9) & (F.bit_count(F.col("mask").bitwiseXOR(F.col("mask2"))) <= (1 - share) * both + 1e-9)
    near = left.join(right.hint("merge"), "phone").where((F.col("country") == "") | (F.col("country") == F.col("country2"))).where(alike).select("n", "m").distinct()
    return near.withColumn("r", ratio("n", "m")).where(F.col("r") >= REVIEW - PHONE_BOOST - CITY_BOOST - 1e-9)


def _side(df: DataFrame, name: str, key: str, phone: str) -> DataFrame:
    clean = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    digits = F.regexp_replace(F.coalesce(F.col(phone), F.lit("")), r"\D", "")
    return df.select(F.col(key), normalise_company_name(F.col(name)).alias("n"), clean("country").alias("country"), clean("city").alias("city"), F.substring(digits, -10, 10).alias("phone"))


def fuzzy_matches(candidates: DataFrame, golden: DataFrame) -> DataFrame:
    """(row_id, supplier_id, score): the best golden record of each candidate whose score reaches REVIEW.

    The score is the names' ratio, plus PHONE_BOOST where the last ten digits of the phones agree
    and CITY_BOOST where the cities do, at most 1.  A candidate is compared with its country's
    records, with all if it has none.  Names are compared once however many rows bear them, and
    no pair that reaches REVIEW is missed: each boost has a route of its own, with the ratio that
    the boost leaves to reach.  All names of a country, or of one of its cities, are compared in
    blocks; names that share a phone are joined by it.  Ties go to the smallest id; names that normalise to nothing have
    no match.
    """
    c = cut(_side(candidates, "company_name", "row_id", "phone").where("n <> ''").withColumn("mask", _mask("n")))
    g = cut(_side(golden, "canonical_name", "id", "primary_phone").where("n <> ''").withColumnRenamed("id", "supplier_id").withColumn("mask", _mask("n")))
    scored = cut(_near_names(c, g).union(_same_phone(c, g)).distinct())
    other = g.select(F.col("n").alias("m"), "supplier_id", F.col("country").alias("country2"), F.col("city").alias("city2"), F.col("phone").alias("phone2"))
    pairs = c.join(scored.hint("merge"), "n").join(other.hint("merge"), "m").where("country = '' OR country = country2")
    boosted = F.least(F.lit(1.0), F.col("r") + F.when((F.col("phone") != "") & (F.col("phone") == F.col("phone2")), PHONE_BOOST).otherwise(0.0))
    score = F.round(F.least(F.lit(1.0), boosted + F.when((F.col("city") != "") & (F.col("city") == F.col("city2")), CITY_BOOST).otherwise(0.0)), 9)
    best = pairs.withColumn("score", score).where(F.col("score") >= REVIEW)
    top = best.groupBy("row_id").agg(F.max(F.struct("score", (-F.col("supplier_id")).alias("_i"))).alias("x"))
    return top.select("row_id", (-F.col("x._i")).alias("supplier_id"), F.col("x.score").alias("score"))


def resolve(candidates: DataFrame, golden: DataFrame, code: str | None = None) -> DataFrame:
    """(row_id, supplier_id, score, level, decision) of every candidate: by credit code, then web address, then name.

    ``code`` is the candidates' column of credit codes, if they have one; codes of 18 letters match
    with 1.0, web addresses with 0.95.  The first level that matches counts.  Candidates without
    a match that reaches REVIEW are new, with no supplier.
    """
    levels = []
    if code:
        own = candidates.select("row_id", F.trim(code).alias("uscc")).where("length(uscc) = 18")
        known = golden.select(F.col("id").alias("supplier_id"), "uscc").where("uscc IS NOT NULL").groupBy("uscc").agg(F.min("supplier_id").alias("supplier_id"))
        levels.append(own.join(known, "uscc").select("row_id", "supplier_id", F.lit(1.0).alias("score"), F.lit(1).alias("level")))
    levels.append(exact_matches(candidates, golden).groupBy("row_id").agg(F.min("supplier_id").alias("supplier_id")).select("row_id", "supplier_id", F.lit(0.95).alias("score"), F.lit(2).alias("level")))
    levels.append(fuzzy_matches(candidates, golden).select("row_id", "supplier_id", "score", F.lit(3).alias("level")))
    found = levels[0]
    for x in levels[1:]:
        found = found.union(x)
    first = found.groupBy("row_id").agg(F.min_by(F.struct("supplier_id", "score", "level"), "level").alias("x")).select("row_id", "x.*")
    return candidates.select("row_id").join(first, "row_id", "left").withColumn("decision", decision(F.coalesce("score", F.lit(0.0))))


def decision(score: Column) -> Column:
    return F.when(score >= MERGE, "merge").when(score >= REVIEW, "review").otherwise("new")


def exact_matches(candidates: DataFrame, golden: DataFrame) -> DataFrame:
    """(row_id, supplier_id): candidates whose web address is a golden record's domain."""
    d = extract_domain(F.col("website"))
    return candidates.select("row_id", d.alias("domain")).where("domain IS NOT NULL").join(golden.select(F.col("id").alias("supplier_id"), F.lower("domain").alias("domain")).where("domain IS NOT NULL"), "domain").select("row_id", "supplier_id")


def merged_array(old: Column, new: Column) -> Column:
    """``old`` and then what ``new`` adds, in order; repeats inside ``new`` stay."""
    o, n = (F.coalesce(x, F.array().cast("array<string>")) for x in (old, new))
    return F.concat(o, F.filter(n, lambda x: ~F.array_contains(o, x)))


def first_filled(rows: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """One row per group with, for each column, the first non-empty value in ``order``; counts partial on the map side."""
    return rows.groupBy(group).agg(*[F.min_by(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(c)), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order))).alias(c) for c in columns], F.count(F.lit(1)).alias("n_rows"))
