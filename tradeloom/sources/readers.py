"""Readers of uploaded lists, recorded payloads and embedded page data."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.operators.resolve import indel_ratio

#: Headers under which uploads name companies and their web addresses.
NAME_HEADERS = ("company name", "company", "business name", "supplier", "supplier name", "organisation", "organization", "org name", "vendor", "vendor name")
WEBSITE_HEADERS = ("website", "website url", "url", "site", "web site", "domain", "company website", "web address", "homepage", "link")
#: Headers of the other columns that are looked for.
HEADERS = {
    "company_name": NAME_HEADERS,
    "website": WEBSITE_HEADERS,
    "phone": ("phone", "telephone", "tel", "mobile", "phone number"),
    "email": ("email", "e-mail", "mail", "contact email"),
    "country": ("country", "nation", "location country"),
    "city": ("city", "town"),
}
#: Fixed value: least likeness of a header to a known one.
LEAST_LIKENESS = 0.70


class Source(Protocol):
    """What a source of raw records must offer: a name, and its records as bronze rows."""

    name: str

    def read(self, spark: SparkSession) -> DataFrame:
        """(source, raw_json, processing_status, error_message) of every record."""
        ...


@dataclass(frozen=True)
class JsonLines:
    """Recorded payloads of one source, a JSON document per line."""

    name: str
    path: str

    def read(self, spark: SparkSession) -> DataFrame:
        return read_payloads(spark, self.path, self.name)


@dataclass(frozen=True)
class StaticList:
    """Records that are at hand already, as dicts."""

    name: str
    records: tuple[dict, ...]

    def read(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, json.dumps(r, ensure_ascii=False, default=str), "pending", None) for r in self.records]
        return spark.createDataFrame(rows, "source string, raw_json string, processing_status string, error_message string")


def read_all(spark: SparkSession, sources: Iterable[Source]) -> DataFrame:
    """The bronze rows of several sources; none give no rows."""
    out = spark.createDataFrame([], "source string, raw_json string, processing_status string, error_message string")
    for s in sources:
        out = out.unionByName(s.read(spark).select(*out.columns))
    return out


def header_map(headers: list[str]) -> dict[str, str]:
    """Our column → the upload's header, each header once, best likeness first; exact names win."""
    norm = {h: re.sub(r"[^a-z0-9]+", " ", h.lower()).strip() for h in headers}
    scored = sorted(((max(indel_ratio(n, a) for a in names), ours, h) for h, n in norm.items() for ours, names in HEADERS.items()), key=lambda x: (-x[0], headers.index(x[2]), x[1]))
    out: dict[str, str] = {}
    for s, ours, h in scored:
        if s >= LEAST_LIKENESS and ours not in out and h not in out.values():
            out[ours] = h
    return out


def repeated_rows(rows: DataFrame, order: str) -> DataFrame:
    """(order, first): rows whose company name and website stood in an earlier row, and the first such; rows with neither are no repeats."""
    name, web = (F.trim(F.coalesce(c, F.lit(""))) for c in ("company_name", "website"))
    keyed = rows.select(F.col(order), name.alias("n"), web.alias("w")).where("n <> '' OR w <> ''")
    firsts = keyed.groupBy("n", "w").agg(F.min(order).alias("first"))
    return keyed.join(firsts, ["n", "w"]).where(F.col(order) > F.col("first")).select(order, "first")


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded CSV: our columns by fuzzy header, and every column as it came in ``original_columns``; nothing is inferred."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    found = header_map(raw.columns)
    ours = [F.trim(F.col(f"`{found[c]}`")).alias(c) if c in found else F.lit(None).cast("string").alias(c) for c in HEADERS]
    return raw.select(*ours, F.create_map(*[x for c in raw.columns for x in (F.lit(c), F.col(f"`{c}`"))]).alias("original_columns"))


def read_payloads(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Recorded payloads, one JSON document per line, as bronze rows; broken lines stay with an error."""
    text = spark.read.text(path)
    ok = F.try_parse_json("value").isNotNull()
    return text.select(F.lit(source).alias("source"), F.col("value").alias("raw_json"), F.when(ok, "pending").otherwise("failed").alias("processing_status"), F.when(~ok, "not JSON").alias("error_message"))


def linked_data(html: Column) -> Column:
    """The ``ld+json`` blocks of a page as an array of VARIANT; broken blocks are left out."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    return F.filter(F.transform(blocks, lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())


def linked_items(rows: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, item): the companies of a page's ``ld+json`` lists, else the page's cards by their heading.

    ``item`` is JSON text: a list's item, or ``{"name": ...}`` of a card.
    """
    lists = F.flatten(F.transform(linked_data(F.col(html)), lambda v: F.coalesce(F.try_variant_get(v, "$.itemListElement", "array<variant>"), F.array().cast("array<variant>"))))
    items = F.transform(lists, lambda v: F.to_json(F.coalesce(F.try_variant_get(v, "$.item", "variant"), v)))
    cards = F.transform(F.regexp_extract_all(F.col(html), F.lit(r'(?is)<h[2-4][^>]*class="[^"]*(?:company|card|exhibitor)[^"]*"[^>]*>(.*?)</h[2-4]>'), F.lit(1)), lambda t: F.to_json(F.struct(F.trim(F.regexp_replace(t, "<[^>]*>", "")).alias("name"))))
    return rows.select(F.col(key), F.posexplode(F.when(F.size(items) > 0, items).otherwise(cards)).alias("pos", "item"))


def retrying(fetch, times: int = 3, wait: float = 1.0):  # noqa: ANN001, ANN201
    """``fetch`` with exponential waits; the last error is raised."""
    import time

    def run(*args, **kw):  # noqa: ANN002, ANN003, ANN202
        for k in range(times):
            try:
                return fetch(*args, **kw)
            except Exception:  # noqa: BLE001
                if k == times - 1:
                    raise
                time.sleep(wait * 2**k)
        return None

    return run
