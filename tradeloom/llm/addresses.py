"""Address records that denote one location, by multi-pass sorted neighbourhoods.

Distinct parsed addresses are sorted in several component orders; in each, an address is compared
with the neighbours in a window.  Where a block is longer than the window, two more orders and an
exact index of street names with letters left out find the rest.  Street names may differ by a
transposition or another single slip; house numbers must be equal, and so must cities; postcodes
may be missing but not differ where the names do; units can be checked strictly.  Linked addresses
are closed to locations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tradeloom.functions.values import says_something
from tradeloom.llm.address_parts import city_key, parse, slips
from tradeloom.operators.components import connected_components
from tradeloom.runtime import cut, small_side

#: Neighbours that an address is compared with in each order.
NEIGHBOURS = 10
#: Slips between two writings of a street name: alone, and where the postcodes agree.
SLIPS, SLIPS_SAME_POSTCODE = 1, 2
#: Cities are bounded by geography; more than this is an error, not a broadcast.
MAX_PLACES = 200_000

_PARTS = StructType([StructField(n, StringType()) for n in ("number", "street", "kind", "city", "postcode", "unit")])


@F.pandas_udf(IntegerType())
def _slips(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((slips(x, y) for x, y in zip(a, b)), dtype=np.int32, count=len(a)))


@F.pandas_udf(StringType())
def _city(text: pd.Series) -> pd.Series:
    return text.map(lambda t: city_key(t) if t else None)


def _area(code: Column) -> Column:
    """The leading part of a postcode that stands for a town."""
    return F.when(code.rlike(r"^\d{6}$"), F.substring(code, 1, 3)).when(code.rlike("^[a-z]"), F.regexp_extract(code, "^([a-z]+)", 1)).otherwise(F.substring(code, 1, 2))


def address_records(suppliers: DataFrame) -> DataFrame:
    """(id, field, text): addresses and factory locations that say something."""
    return suppliers.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("address", "factory_location")])).alias("r")).select("id", "r.*").where(says_something(F.col("text")))


def parsed_records(suppliers: DataFrame) -> DataFrame:
    """(id, field, number, street, kind, city, postcode, unit); a missing city follows from the postcode's area."""
    names = suppliers.where("city IS NOT NULL").groupBy("city").count().select(_city("city").alias("k"), "count").groupBy("k").agg(F.sum("count").alias("n")).where("n >= 2 AND length(k) >= 3")
    known = [r.k for r in names.limit(MAX_PLACES + 1).collect()]
    if len(known) > MAX_PLACES:
        raise ValueError(f"more than {MAX_PLACES} cities")
    cities = suppliers.sparkSession.sparkContext.broadcast(frozenset(known))

    @F.pandas_udf(_PARTS)
    def parts(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t, cities.value) for t in text], columns=_PARTS.names)

    rows = cut(address_records(suppliers).select("id", "field", parts("text").alias("p")).select("id", "field", "p.*"))
    votes = rows.where("city <> '' AND postcode <> ''").groupBy(_area(F.col("postcode")).alias("area"), F.col("city").alias("town")).count()
    best = votes.groupBy("area").agg(F.max_by("town", F.struct("count", "town")).alias("town"), F.max("count").alias("n")).where("n >= 2").select("area", "town")
    filled = rows.withColumn("area", _area(F.col("postcode"))).join(small_side(cut(best)), "area", "left")
    return filled.select("id", "field", "number", "street", "kind", F.when(F.col("city") != "", F.col("city")).otherwise(F.coalesce("town", F.lit(""))).alias("city"), "postcode", "unit")


_KEY = ("k", "street", "kind", "postcode", "unit")


def neighbours(keys: DataFrame, block: list[str], order: list[Column]) -> DataFrame:
    """The columns _KEY of each address, and with 2 of the NEIGHBOURS before it in one order.

    A block holds addresses that could be equal at all; its sort spills, and only a window of it
    is in memory.
    """
    w = Window.partitionBy(*block).orderBy(*order).rowsBetween(-NEIGHBOURS, -1)
    near = keys.withColumn("near", F.collect_list(F.struct(*[F.col(c).alias(c + "2") for c in _KEY])).over(w))
    return near.select(*_KEY, F.inline("near")).where("(kind = kind2 OR kind = '' OR kind2 = '') AND abs(length(street) - length(street2)) <= 2 AND levenshtein(street, street2, 4) >= 0")


def left_out(street: str, most: int) -> list[str]:
    """A street name with up to ``most`` letters left out; names that far apart share one of these."""
    seen = last = {street}
    for _ in range(most):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        seen = seen | last
    return sorted(seen)


def exact_neighbours(keys: DataFrame) -> DataFrame:
    """Like ``neighbours`` over blocks of city and number, but all pairs that the slips allow, at any block length."""

    @F.pandas_udf("array<string>")
    def variants(street: pd.Series) -> pd.Series:
        return street.map(lambda t: left_out(t, SLIPS_SAME_POSTCODE))

    rows = keys.select("city", "number", *_KEY, F.explode(variants("street")).alias("variant"))
    other = rows.select("city", "number", "variant", *[F.col(c).alias(c + "2") for c in _KEY])
    return rows.join(other, ["city", "number", "variant"]).where("k < k2 AND (kind = kind2 OR kind = '' OR kind2 = '')").select(*_KEY, *[c + "2" for c in _KEY])


def locations(suppliers: DataFrame, strict_units: bool = False) -> DataFrame:
    """(id, field, location): the location of every address record.

    Records without house number, street or city stand for themselves: nothing tells them
    apart from others with certainty.  Nulls, blanks and placeholders are no records.  Street
    names are compared by their last word.  With ``strict_units``, addresses that name two
    different units are not linked (through one that names none they may still meet).
    """
    full = (F.col("number") != "") & (F.col("street") != "") & (F.col("city") != "")
    unit = F.col("unit") if strict_units else F.lit("")
    rows = parsed_records(suppliers).withColumn("unit", unit)
    rows = cut(rows.withColumn("k", F.when(full, F.xxhash64("city", "number", "street", "kind", "unit")).otherwise(F.xxhash64(F.lit("own"), "id", "field"))))
    keys = rows.where(full).groupBy("k", "city", "number", "street", "kind", "unit").agg(F.max(F.when(F.col("postcode") != "", F.col("postcode"))).alias("postcode"))
    keys = cut(keys.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("city", "number"))))
    letters = F.array_join(F.array_sort(F.split("street", "")), "")
    longer = keys.where(F.col("members") > NEIGHBOURS + 1)  # in other blocks the first window holds all
    passes = [
        neighbours(keys.where("members > 1"), ["city", "number"], [F.col("street"), F.col("k")]),
        neighbours(longer, ["city", "number"], [F.reverse("street"), F.col("k")]),
        neighbours(longer, ["city", "number"], [letters, F.col("k")]),
        exact_neighbours(longer),
        neighbours(keys.where("postcode IS NOT NULL"), ["postcode", "number"], [F.col("city"), F.col("street"), F.col("k")]),
    ]
    seen = passes[0]
    for p in passes[1:]:
        seen = seen.unionByName(p)
    seen = seen.withColumns({"a": F.least("k", "k2"), "b": F.greatest("k", "k2")}).dropDuplicates(["a", "b"])
    agree, miss = F.col("postcode") == F.col("postcode2"), F.col("postcode").isNull() | F.col("postcode2").isNull()
    units = (F.col("unit") == F.col("unit2")) | (F.col("unit") == "") | (F.col("unit2") == "")
    scored = seen.where(units).withColumn("slips", _slips("street", "street2"))
    same = F.when(agree, F.col("slips") <= SLIPS_SAME_POSTCODE).when(miss, F.col("slips") <= SLIPS).otherwise(F.col("slips") == 0)
    linked = connected_components(scored.where(same & (F.least(F.length("street"), F.length("street2")) >= 4)).select("a", "b"))
    return rows.join(linked.select(F.col("node").alias("k"), "component"), "k", "left").select("id", "field", F.coalesce("component", "k").alias("location"))


def same_location(suppliers: DataFrame) -> DataFrame:
    """(id_a, field_a, id_b, field_b): every pair of records of one location, the smaller (id, field) first."""
    rows = cut(locations(suppliers))
    shared = rows.groupBy("location").count().where("count > 1").select("location")
    some = rows.join(shared, "location", "left_semi")
    left, right = some.select("location", F.col("id").alias("id_a"), F.col("field").alias("field_a")), some.select("location", F.col("id").alias("id_b"), F.col("field").alias("field_b"))
    return left.join(right, "location").where("id_a < id_b OR (id_a = id_b AND field_a < field_b)").drop("location").distinct()
