"""Queries of the general training-data operators (problems 3, 4 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.operators.drift import failed_casts, schema_changes, typed_records
from tradeloom.operators.nested import array_elements, flat_records
from tradeloom.operators.packed_values import split_packed
from tradeloom.runtime import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "directory_listings").select("listing_id", "products")
    return split_packed(rows, "products", "product", "pos").select("listing_id", F.col("pos").cast("int").alias("pos"), "product")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return array_elements(table(spark, d, "raw_source_data"), "raw_id", "raw_json").select("raw_id", "array_path", "idx")


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every row of every flat table: its place, its parent's, and its fields as JSON text."""
    rows, _ = flat_records(table(spark, d, "raw_source_data"), "raw_id", "raw_json")
    return rows.select("raw_id", "array_path", "parent_idx", "idx", "value", F.to_json("fields").alias("fields"))


def _by_month(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_source_data").where("processing_status IS NULL OR processing_status <> 'failed'")
    return rows.withColumn("seen_month", F.date_format("scraped_at", "yyyy-MM"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(_by_month(spark, d), "source", "seen_month", "raw_json")


def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every source's consistent table, under its latest name and in its column's type."""
    return typed_records(_by_month(spark, d), "source", "seen_month", "raw_json", "raw_id")[0]


def p6_failed_casts(spark: SparkSession, d: str) -> DataFrame:
    return failed_casts(p6_tables(spark, d), "source")


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_tables": p4_tables, "p6_found": p6_found, "p6_tables": p6_tables, "p6_failed_casts": p6_failed_casts}
SQL: dict[str, str] = {}
