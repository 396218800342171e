"""Exports as DataFrames of text columns, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions.web import excel_text

#: Columns of the supplier export, in order.
SUPPLIER_COLUMNS = (
    "id", "canonical_name", "domain", "country", "province_state", "city", "address", "factory_location", "primary_email", "primary_phone", "whatsapp", "contact_name", "uscc", "uscc_verified", "is_manufacturer",
    "manufacturer_confidence", "iso_9001", "iso_9001_expiry", "iatf_16949", "e_mark_certified", "product_keywords", "primary_categories", "exports_to_uk", "exports_to_eu", "exports_to_us", "alibaba_years", "alibaba_rating", "year_established", "employee_count", "composite_score", "source_count",
)


def as_text(rows: DataFrame, column: str) -> Column:
    """A value as the exports write it: lists joined by ``; ``, null as ''."""
    kind = dict(rows.dtypes)[column]
    c = F.array_join(column, "; ") if kind.startswith("array") else F.col(column).cast("string")
    return F.coalesce(c, F.lit(""))


def supplier_export(suppliers: DataFrame, excel_safe_phone: bool = True) -> DataFrame:
    """The 31 export columns as text; phones so that spreadsheets keep them."""
    out = suppliers.select(*[as_text(suppliers, c).alias(c) for c in SUPPLIER_COLUMNS])
    phone = F.col("primary_phone")
    return out.withColumn("primary_phone", F.when(phone != "", excel_text(phone)).otherwise("")) if excel_safe_phone else out


def batch_results(uploads: DataFrame, resolved: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Uploaded rows as they came, in their order, with what was found beside them."""
    found = suppliers.select(F.col("id").alias("supplier_id"), F.col("canonical_name").alias("found_name"), F.col("domain").alias("found_domain"), F.col("primary_email").alias("found_email"))
    return uploads.join(resolved, "row_id", "left").join(found, "supplier_id", "left").select(*uploads.columns, "found_name", "found_domain", "found_email")


def role_pivot(contacts: DataFrame, key: str, role: str, value: str, order: str, roles: tuple[str, ...]) -> DataFrame:
    """One row per key with the first value of each role in ``order``."""
    return contacts.groupBy(key).agg(*[F.min_by(F.when(F.col(role) == r, F.col(value)), F.when(F.col(role) == r, F.col(order))).alias(r) for r in roles])


def evidence_bundle(suppliers: DataFrame, pages: DataFrame, shipments: DataFrame) -> DataFrame:
    """(id, bundle): a supplier, its pages' addresses and the number of its shipments as one JSON text."""
    urls = pages.where("supplier_id IS NOT NULL").groupBy("supplier_id").agg(F.array_sort(F.collect_set("url")).alias("pages"))
    ships = shipments.where("supplier_id IS NOT NULL").groupBy("supplier_id").agg(F.count(F.lit(1)).alias("shipments"))
    full = suppliers.join(urls, suppliers.id == urls.supplier_id, "left").drop("supplier_id").join(ships, suppliers.id == ships.supplier_id, "left")
    return full.select("id", F.to_json(F.struct("id", "canonical_name", "country", F.coalesce("pages", F.array().cast("array<string>")).alias("pages"), F.coalesce("shipments", F.lit(0)).alias("shipments"))).alias("bundle"))


def markdown_lines(rows: DataFrame, title: Column, facts: dict[str, Column], order: list[Column]) -> DataFrame:
    """(no, line): one Markdown paragraph per row, numbered in order; facts that are empty are left out.

    Numbering needs one order over all rows: it is meant for reports, not for whole corpora.
    """
    said = F.concat_ws(" · ", *[F.concat(F.lit(f"**{k}:** "), F.nullif(v.cast("string"), F.lit(""))) for k, v in facts.items()])
    numbered = rows.withColumn("no", F.row_number().over(Window.orderBy(*order)))
    return numbered.select("no", F.concat(F.lit("### "), F.col("no").cast("string"), F.lit(". "), title, F.lit("\n"), said).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    """One folder of CSV files with headers, quoted so that line breaks survive."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """One folder of JSON lines, by partition."""
    out = rows.write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).json(path)
