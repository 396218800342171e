"""Scores and verdicts as pure expressions over supplier columns; every dated rule takes ``as_of``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.operators.taxonomy import categories_of, haystack

#: Weight of the best source by name; others get DEFAULT_SOURCE.
SOURCE_WEIGHTS = {"trade": 90, "automechanika_2026": 65, "shanghai_expo": 60, "hktdc": 55, "europages_eastern_europe": 50, "global_directory": 45, "alibaba": 35, "china_1688": 35, "indiamart": 35, "google": 25, "llm-discovery": 20}
DEFAULT_SOURCE = 30
#: Shares of the composite score, signed weights of the manufacturer and the confidence checks.
COMPOSITE = {"product_fit_score": 0.25, "provenance_score": 0.25, "verification_score": 0.25, "export_score": 0.15, "contact_score": 0.10}
MANUFACTURER = (("tenure", 15), ("certifications", 25))
CONFIDENCE = (("manufacturer_assessment", 25), ("facility_address", 25), ("certification_consistency", 15), ("oem_readiness_evidence", 15), ("export_shipment_evidence", 10), ("contact_verification", 5), ("own_site_name_match", 5), ("linkedin_presence", 5))
TENURE_GAP = 2

def _true(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def _points(*terms: tuple[Column, int]) -> Column:
    return F.least(F.lit(100), sum((F.when(c, F.lit(p)).otherwise(0) for c, p in terms), F.lit(0)))


def keyword_text() -> Column:
    return haystack("product_keywords", "primary_categories", "canonical_name")


def product_fit() -> Column:
    """0, 55, 75, 90 or 100 for none, one, two, three or more matched categories."""
    n = F.size(categories_of(keyword_text()))
    return F.when(n == 0, 0).when(n == 1, 55).when(n == 2, 75).when(n == 3, 90).otherwise(100)


def verification() -> Column:
    return _points((_true("is_manufacturer"), 40), (_true("iso_9001"), 25), (_true("e_mark_certified"), 20), (_true("iatf_16949"), 15))


def contact() -> Column:
    return _points((_filled("contact_name"), 30), (_filled("primary_email"), 25), (_filled("whatsapp"), 25), (_filled("primary_phone"), 20))


def platform() -> Column:
    years, rating = F.coalesce("alibaba_years", F.lit(0)), F.coalesce("alibaba_rating", F.lit(0.0))
    return F.when(years >= 5, 40).when(years >= 3, 25).when(years >= 1, 10).otherwise(0) + F.when(rating >= 4.5, 20).when(rating >= 4.0, 10).otherwise(0)


def export(as_of: str) -> Column:
    """Confirmed shipments by market count most, claims less; a shipment in the 180 days before ``as_of`` adds ten."""
    n = {m: F.coalesce(F.col(f"shipments_{m}"), F.lit(0)) for m in ("uk", "eu", "us")}
    uk = F.when(n["uk"] > 10, 60).when(n["uk"] > 0, 40).when(_true("exports_to_uk"), 15).otherwise(0)
    eu = F.when(n["eu"] > 0, 20).when(_true("exports_to_eu"), 8).otherwise(0)
    us = F.when(n["us"] > 0, 10).when(_true("exports_to_us"), 5).otherwise(0)
    since = dt.date.fromisoformat(as_of) - dt.timedelta(days=180)
    return F.least(F.lit(100), uk + eu + us + F.when(F.col("last_shipment") > F.lit(since), 10).otherwise(0))


def provenance() -> Column:
    """Best source by weight, number of distinct sources, own domain, address."""
    base = F.bround(F.coalesce("best_source", F.lit(0)) * 0.4, 0).cast("int")
    many = F.when(F.col("n_sources") >= 3, 30).when(F.col("n_sources") == 2, 18).otherwise(0)
    return F.least(F.lit(100), base + many + F.when(_filled("domain"), 20).otherwise(0) + F.when(_filled("address"), 10).otherwise(0))


def composite() -> Column:
    weighted = sum((F.col(c) * w for c, w in COMPOSITE.items()), F.lit(0.0))
    bonus = F.when(_true("uscc_verified"), 5).otherwise(0) + F.bround(F.col("platform_score") * 0.05, 0).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(weighted, 0).cast("int") + bonus))


def coverage() -> Column:
    """Share of seven kinds of evidence that are known at all, in per cent."""
    known = [_filled("domain"), _filled("address"), _filled("primary_email") | _filled("primary_phone"), F.col("is_manufacturer").isNotNull(), F.coalesce(F.size("product_keywords") > 0, F.lit(False)), _filled("uscc"), F.col("last_shipment").isNotNull()]
    return F.bround(100.0 * sum((k.cast("int") for k in known), F.lit(0)) / 7, 0).cast("int")


def recommendation() -> Column:
    avoid = _true("flagged") | ((F.col("is_manufacturer") == F.lit(False)) & (F.coalesce("manufacturer_confidence", F.lit(0)) > 80))
    score = F.col("composite_new")
    return F.when(F.coalesce(avoid, F.lit(False)), "avoid").when(F.col("evidence_coverage") < 30, "unscored").when(score >= 70, "strong").when(score >= 40, "review").otherwise("weak")


def shipment_summary(shipments: DataFrame, markets: dict[str, tuple[str, ...]]) -> DataFrame:
    """(supplier_id, shipments_<market>..., last_shipment); repeated records under a new id count once."""
    land = F.lower(F.trim("consignee_country"))
    once = shipments.where("supplier_id IS NOT NULL").dropDuplicates(["supplier_id", "source", "consignee_name", "consignee_country", "shipment_date", "hs_code", "weight_kg", "value_usd"])
    return once.groupBy("supplier_id").agg(*[F.count_if(land.isin(*names)).alias(f"shipments_{m}") for m, names in markets.items()], F.max("shipment_date").alias("last_shipment"))


def source_summary(raw: DataFrame) -> DataFrame:
    """(supplier_id, n_sources, best_source) from the raw rows of each golden record."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv])[F.col("source")], F.lit(DEFAULT_SOURCE))
    one = raw.where("golden_record_id IS NOT NULL AND source IS NOT NULL").groupBy("golden_record_id", "source").agg(F.max(weight).alias("w"))
    return one.groupBy(F.col("golden_record_id").alias("supplier_id")).agg(F.count(F.lit(1)).alias("n_sources"), F.max("w").alias("best_source"))


def scored(suppliers: DataFrame, shipments: DataFrame, raw: DataFrame, markets: dict[str, tuple[str, ...]], as_of: str) -> DataFrame:
    """All scores of every supplier, with coverage and recommendation."""
    s = suppliers.join(shipment_summary(shipments, markets), suppliers.id == F.col("supplier_id"), "left").drop("supplier_id")
    s = s.join(source_summary(raw), s.id == F.col("supplier_id"), "left").drop("supplier_id")
    s = s.withColumns({"product_fit_score": product_fit(), "provenance_score": provenance(), "verification_score": verification(), "export_score": export(as_of), "platform_score": platform(), "contact_score": contact()})
    s = s.withColumns({"composite_new": composite(), "evidence_coverage": coverage()})
    return s.withColumn("recommendation", recommendation())


def manufacturer_assessment(as_of_year: int) -> tuple[Column, Column]:
    """(confidence, verdict): 50 moved by signed checks; the verdict is null where no check applies or none prevails."""
    tenure = F.when((F.coalesce("alibaba_years", F.lit(0)) > 0) & (F.coalesce("year_established", F.lit(0)) > 0), F.abs(F.lit(as_of_year) - F.col("alibaba_years") - F.col("year_established")) <= TENURE_GAP)
    certs = F.when(_true("iso_9001") | _true("iatf_16949") | _true("e_mark_certified"), True)
    checks = {"tenure": tenure, "certifications": certs}
    score = sum((F.when(checks[n], w).when(~checks[n], -w).otherwise(0) for n, w in MANUFACTURER), F.lit(50))
    score = F.greatest(F.lit(0), F.least(F.lit(100), score))
    return score, F.when(tenure.isNotNull() | certs.isNotNull(), F.when(score >= 70, True).when(score <= 30, False))


def confidence(checks: dict[str, Column]) -> Column:
    """50 moved by each check's weight, up for true and down for false; nulls say nothing."""
    score = sum((F.when(checks[n], w).when(~checks[n], -w).otherwise(0) for n, w in CONFIDENCE if n in checks), F.lit(50))
    return F.greatest(F.lit(0), F.least(F.lit(100), score))
