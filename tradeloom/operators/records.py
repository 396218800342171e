"""Writes as DataFrame transforms: merge, upsert, gap-fill, cascades and set operations on arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def merged(golden: DataFrame, updates: DataFrame, key: str, scalars: tuple[str, ...], arrays: tuple[str, ...] = ()) -> DataFrame:
    """``golden`` with empty scalars filled from ``updates`` (one row per key) and array elements added in order.

    What a golden record says is never overwritten; updates for unknown keys do nothing.
    """
    new = updates.select(key, *[F.col(c).alias("_u_" + c) for c in (*scalars, *arrays)])
    full = golden.join(new, key, "left")
    none = F.array().cast("array<string>")
    fills = {c: F.when(_empty(F.col(c)), F.col("_u_" + c)).otherwise(F.col(c)) for c in scalars}
    unions = {c: F.array_union(F.coalesce(c, none), F.coalesce("_u_" + c, none)) for c in arrays}
    return full.withColumns({**fills, **unions}).select(*golden.columns)


def upserted(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` and the rows of ``existing`` that it does not replace."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def without(rows: DataFrame, column: str, deleted: DataFrame) -> DataFrame:
    """``rows`` less those that refer to a deleted id (a cascade's part for one table); nulls refer to nothing."""
    return rows.join(deleted.select(F.col(deleted.columns[0]).alias(column)), column, "left_anti")


def gap_filled(rows: DataFrame, primary: str, found: Column, secondary: str) -> DataFrame:
    """The first of ``found`` as ``primary`` where that is empty, the rest in ``secondary``; a primary that stands is not repeated."""
    first = F.when(_empty(F.col(primary)), F.get(found, F.lit(0))).otherwise(F.col(primary))
    return rows.withColumn("_first", first).withColumn(secondary, F.filter(found, lambda x: ~x.eqNullSafe(F.col("_first")))).withColumn(primary, F.col("_first")).drop("_first")


def column_universe(rows: DataFrame, maps: str, order: str) -> DataFrame:
    """(name, first_seen) of every key of a map column, by where it is first seen."""
    return rows.select(F.col(order), F.explode(F.map_keys(maps)).alias("name")).groupBy("name").agg(F.min(order).alias("first_seen"))


def until_total(rows: DataFrame, group: str, order: list[Column], size: str, ceiling: float) -> DataFrame:
    """Rows of each group in order while the sum of those before is below ``ceiling``."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("_before") < ceiling).drop("_before")
