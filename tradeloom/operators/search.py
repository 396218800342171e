"""Supplier search, listing and selection with optional conditions."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Flags that ``by_certificate`` may be asked for.
CERTIFICATES = ("iso_9001", "iatf_16949", "e_mark_certified", "uscc_verified")


def _all(conditions: Iterable[Column | None]) -> Column:
    return functools.reduce(Column.__and__, [c for c in conditions if c is not None], F.lit(True))


def list_suppliers(suppliers: DataFrame, country: str | None = None, least_score: int | None = None, ids: list[int] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of suppliers by score, then name and id; conditions that are None do not count, an empty ``ids`` gives none."""
    wanted = _all([F.col("country") == country if country is not None else None, F.col("composite_score") >= least_score if least_score is not None else None, F.col("id").isin(ids) if ids is not None else None])
    return suppliers.where(wanted).orderBy(F.col("composite_score").desc_nulls_last(), F.col("canonical_name").asc_nulls_last(), "id").offset(offset).limit(limit)


def terms(suppliers: DataFrame) -> DataFrame:
    """(id, term): the distinct lower-case product words of each supplier."""
    return suppliers.select("id", F.explode("product_keywords").alias("k")).select("id", F.lower(F.trim("k")).alias("term")).where("term <> ''").distinct()


def search(suppliers: DataFrame, product: str | None = None, required: Iterable[str] = (), manufacturers_only: bool = False, least_score: int | None = None, country: str | None = None, limit: int = 50) -> DataFrame:
    """Unflagged suppliers that meet every condition given, best score first, with their terms as ``evidence``.

    ``product`` must stand in the name or a product word; all ``required`` terms must be there.
    A part of the table is read once; terms are joined only to suppliers that are left.
    """
    words = F.lower(F.concat_ws(" || ", "canonical_name", "product_keywords", "primary_categories"))
    base = suppliers.where(~F.coalesce("flagged", F.lit(False)) & _all([
        words.contains(product.lower()) if product else None,
        F.coalesce("is_manufacturer", F.lit(False)) if manufacturers_only else None,
        F.col("composite_score") >= least_score if least_score is not None else None,
        F.lower("country") == country.lower() if country else None,
    ]))
    need = sorted({r.strip().lower() for r in required})
    own = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("product_keywords", F.array().cast("array<string>")), lambda k: F.lower(F.trim(k))), lambda k: k != "")))
    found = base.withColumn("_t", own).where(F.size(F.array_except(F.array(*map(F.lit, need)).cast("array<string>"), "_t")) == 0)
    return found.select("id", "canonical_name", "country", "composite_score", F.array_join("_t", "; ").alias("evidence")).orderBy(F.col("composite_score").desc_nulls_last(), "id").limit(limit)


def by_element(suppliers: DataFrame, column: str, value: str) -> DataFrame:
    """Suppliers one of whose array elements is ``value``, whatever its case."""
    return suppliers.where(F.exists(column, lambda x: F.lower(x) == value.lower()))


def by_certificate(suppliers: DataFrame, flag: str, value: bool = True) -> DataFrame:
    """Suppliers with a certificate flag; other columns are refused."""
    if flag not in CERTIFICATES:
        raise ValueError(f"{flag!r} is no certificate flag")
    return suppliers.where(F.coalesce(flag, F.lit(False)) == value)


def needing(rows: DataFrame, missing: str, given: tuple[str, ...] = (), force: bool = False) -> DataFrame:
    """Rows whose ``missing`` column says nothing while all ``given`` columns do; with ``force``, whatever ``missing`` says."""
    kinds = dict(rows.dtypes)
    empty = lambda c: F.coalesce(F.size(c) == 0, F.lit(True)) if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    return rows.where(_all([None if force else empty(missing), *[~empty(c) for c in given]]))


def stale(rows: DataFrame, checked: str, today: str, days: int) -> DataFrame:
    """Rows never checked, then those last checked more than ``days`` before ``today``, oldest first."""
    return rows.where(F.col(checked).isNull() | (F.col(checked) < F.date_sub(F.lit(today).cast("date"), days))).orderBy(F.col(checked).asc_nulls_first(), "id")


def up_to(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group; ranks are limited before the shuffle."""
    from pyspark.sql import Window

    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_k") <= most).drop("_k")
