"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.addresses import locations, same_location
from tradeloom.llm.boilerplate import body_lines
from tradeloom.llm.contamination import leaks
from tradeloom.llm.entity_match import match_entities
from tradeloom.llm.mixing import mixture
from tradeloom.llm.residue import residue_documents
from tradeloom.llm.survivors import fieldwise, survivors, with_facts
from tradeloom.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return body_lines(table(spark, d, "collected_pages").select("page_id", "url", "text")).select("page_id", "line_no")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return with_facts(table(spark, d, "raw_source_data"), table(spark, d, "source_trust"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors(_facts(spark, d)).where("agreed AND members > 1").select("golden_record_id", "raw_id")


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors(_facts(spark, d)).drop("source")


def p2_fieldwise(spark: SparkSession, d: str) -> DataFrame:
    return fieldwise(_facts(spark, d))


_SUPPLIER = ("id", "canonical_name", "domain", "primary_phone", "city", "country")
_UPLOAD = ("row_id", "company_name", "website", "phone", "city", "country")


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    return match_entities(table(spark, d, "suppliers").select(*_SUPPLIER), table(spark, d, "batch_upload_rows").select(*_UPLOAD))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_matches(spark, d).select("supplier_id", "row_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return same_location(table(spark, d, "suppliers").select("id", "city", "address", "factory_location"))


def p7_locations(spark: SparkSession, d: str) -> DataFrame:
    return locations(table(spark, d, "suppliers").select("id", "city", "address", "factory_location"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items"))


#: Curriculum of the p9 queries: relative weights over training time, a parameter and no default of the library.
CURRICULUM = {"own_website": ((0.0, 1.5), (1.0, 0.5)), "alibaba": ((0.0, 1.5), (1.0, 0.5)), "trade_press": ((0.0, 0.5), (0.6, 1.0), (1.0, 1.5)), "inspection_report": ((0.0, 0.5), (1.0, 1.5))}


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return mixture(docs, table(spark, d, "mix_targets"), shapes=CURRICULUM)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    report = mixture(docs, table(spark, d, "mix_targets"), shapes=CURRICULUM)[1]
    return report.withColumn("share_reached", F.round("share_reached", 6)).withColumn("demand", F.round("demand", 3))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue_documents(table(spark, d, "documents").select("doc_id", "text"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_survivors": p2_survivors,
    "p2_fieldwise": p2_fieldwise,
    "p5_found": p5_found,
    "p5_matches": p5_matches,
    "p7_found": p7_found,
    "p7_locations": p7_locations,
    "p8_found": p8_found,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}
SQL: dict[str, str] = {}
