"""Idempotent ingest, change logs, latest rows, and selection of pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``; ranks are limited before the shuffle."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """``existing`` plus the first arrival of every new key that is not there; rows with a null key are skipped."""
    fresh = latest(new.dropna(subset=keys), keys, F.col(arrival)).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def change_log(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """(key, order columns, field, old_value, new_value) wherever a column differs from the key's row before."""
    w = Window.partitionBy(key).orderBy(*order)
    before = rows.withColumns({f"_old_{c}": F.lag(F.col(c).cast("string")).over(w) for c in columns}).withColumn("_n", F.row_number().over(w))
    long = before.where("_n > 1").select(key, *order, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_old_{c}").alias("old_value"), F.col(c).cast("string").alias("new_value")) for c in columns])).alias("x"))
    return long.select(key, *order, "x.*").where("NOT (old_value <=> new_value)")


def pending(rows: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Rows whose key has no entry in ``done``; all of them with ``force``."""
    return rows if force else rows.join(done.select(key), key, "left_anti")


def rekey(rows: DataFrame, column: str, remap: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by ``remap`` (remove_id, keep_id); other values stay."""
    m = remap.select(F.col("remove_id").alias(column), "keep_id")
    return rows.join(m, column, "left").withColumn(column, F.coalesce("keep_id", column)).drop("keep_id")
