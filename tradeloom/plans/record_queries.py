"""Selections, normalisers, writes, set operations and exports over whole tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeloom.functions.payload import payload
from tradeloom.functions.text import extract_domain
from tradeloom.operators import contacts, history, normalise, records, search
from tradeloom.plans.supplier_queries import _DOMAIN, _in
from tradeloom.runtime import table
from tradeloom.sinks import exports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "suppliers")


# --- search and selection ---------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT *, lower(concat_ws(' || ', canonical_name, array_to_string(product_keywords, ' || '), array_to_string(primary_categories, ' || '))) AS words,
list_sort(list_distinct(list_filter(list_transform(coalesce(product_keywords, []), lambda k: lower(trim(k))), lambda k: k <> ''))) AS t FROM suppliers)
SELECT id, canonical_name, country, composite_score, array_to_string(t, '; ') AS evidence FROM x WHERE NOT coalesce(flagged, false) AND contains(words, 'spring') AND coalesce(is_manufacturer, false) AND composite_score >= 10 AND lower(country) = 'china' AND list_contains(t, 'ramp spring')
ORDER BY composite_score DESC NULLS LAST, id LIMIT 50""")
def full_search(spark: SparkSession, d: str) -> DataFrame:
    """Product text, required term, makers only, least score and country together; the limit is the feature."""
    return search.search(_suppliers(spark, d), product="spring", required=["Ramp Spring"], manufacturers_only=True, least_score=10, country="China")


@query("SELECT id, canonical_name, composite_score FROM suppliers WHERE country = 'Germany' ORDER BY composite_score DESC NULLS LAST, canonical_name NULLS LAST, id LIMIT 40 OFFSET 20")
def supplier_page(spark: SparkSession, d: str) -> DataFrame:
    return search.list_suppliers(_suppliers(spark, d), country="Germany", limit=40, offset=20).select("id", "canonical_name", "composite_score")


@query("SELECT id FROM suppliers WHERE len(list_filter(product_keywords, lambda k: lower(k) = 'king pin')) > 0")
def element_match(spark: SparkSession, d: str) -> DataFrame:
    return search.by_element(_suppliers(spark, d), "product_keywords", "King pin").select("id")


@query("SELECT id FROM suppliers WHERE coalesce(iso_9001, false)")
def certificate_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.by_certificate(_suppliers(spark, d), "iso_9001").select("id")


@query("SELECT id FROM suppliers WHERE coalesce(composite_score, 0) = 0")
def unscored(spark: SparkSession, d: str) -> DataFrame:
    return _suppliers(spark, d).where("coalesce(composite_score, 0) = 0").select("id")


_NEEDS = {"needing_manufacturer": ("is_manufacturer", ("domain",)), "needing_catalogue": ("product_keywords", ("domain",)), "needing_facility": ("factory_location", ("address",)), "needing_website": ("domain", ()), "needing_contacts": ("primary_email", ("domain",)), "needing_registry": ("uscc", ("canonical_name", "country")), "needing_categories": ("primary_categories", ())}


def _need(name: str, missing: str, given: tuple[str, ...]) -> None:
    arrays = ("product_keywords", "primary_categories")
    empty = lambda c: f"coalesce(len({c}) = 0, true)" if c in arrays else f"coalesce(CAST({c} AS VARCHAR), '') = ''"

    def run(spark: SparkSession, d: str) -> DataFrame:
        return search.needing(_suppliers(spark, d), missing, given).select("id")

    QUERIES[name] = run
    SQL[name] = "SELECT id FROM suppliers WHERE " + " AND ".join([empty(missing), *[f"NOT ({empty(c)})" for c in given]])


for _name, (_missing, _given) in _NEEDS.items():
    _need(_name, _missing, _given)


@query("SELECT s.id FROM suppliers s WHERE NOT EXISTS (SELECT 1 FROM shipment_records r WHERE r.supplier_id = s.id)")
def needing_shipments(spark: SparkSession, d: str) -> DataFrame:
    return history.pending(_suppliers(spark, d).select("id"), table(spark, d, "shipment_records").select(F.col("supplier_id").alias("id")), "id")


@query("SELECT id FROM suppliers WHERE updated_at IS NULL OR updated_at < DATE '2026-06-30' - 120")
def stale_records(spark: SparkSession, d: str) -> DataFrame:
    return search.stale(_suppliers(spark, d), "updated_at", "2026-06-30", 120).select("id")


@query("WITH r AS (SELECT source, strftime(scraped_at, '%Y-%m') AS run, max(scraped_at) AS run_at, count(*) AS n FROM raw_source_data WHERE scraped_at IS NOT NULL GROUP BY 1, 2) SELECT source, run, n FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY run_at DESC, run DESC) <= 3")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The three latest runs of each source, a run being a month of it."""
    runs = table(spark, d, "raw_source_data").where("scraped_at IS NOT NULL").groupBy("source", F.date_format("scraped_at", "yyyy-MM").alias("run")).agg(F.max("scraped_at").alias("run_at"), F.count(F.lit(1)).alias("n"))
    return search.up_to(runs, "source", [F.col("run_at").desc(), F.col("run").desc()], 3).select("source", "run", "n")


# --- normalisers ------------------------------------------------------------------------------------------------------


@query(f"""SELECT listing_id, coalesce(trim(company_name), '') AS canonical_name, {_DOMAIN.format('website')} AS domain, nullif(trim(country), '') AS country, array_to_string(list_filter(list_transform(string_split(coalesce(products, ''), ','), lambda p: trim(p)), lambda p: p <> ''), '¦') AS product_keywords,
CASE WHEN coalesce(trim(directory_name), '') <> '' THEN 'Listed in ' || trim(directory_name) ELSE nullif(concat_ws('; ', 'Exhibitor at ' || nullif(trim(exhibition_name), ''), 'booth ' || nullif(trim(booth_number), '')), '') END AS notes FROM directory_listings""")
def listing_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = normalise.listing_suppliers(table(spark, d, "directory_listings"))
    return rows.withColumn("product_keywords", F.coalesce(F.array_join("product_keywords", "¦"), F.lit("")))


_BUYER = "CASE WHEN coalesce(trim(consignee_country), '') <> '' THEN trim(consignee_country) WHEN source = 'importyeti' THEN 'United States' ELSE '' END"


@query(f"""SELECT id, coalesce(trim(shipper_name), '') AS canonical_name, nullif(trim(consignee_name), '') AS known_buyer, CASE WHEN lower({_BUYER}) IN {_in(normalise.UK)} THEN 1 END AS confirmed_shipments_uk, CASE WHEN lower({_BUYER}) IN {_in(normalise.US)} THEN 1 END AS confirmed_shipments_us,
CASE WHEN lower({_BUYER}) IN {_in(normalise.EU)} THEN 1 END AS confirmed_shipments_eu, shipment_date AS last_shipment_date FROM shipment_records""")
def trade_suppliers(spark: SparkSession, d: str) -> DataFrame:
    return normalise.shipper_suppliers(table(spark, d, "shipment_records"))


@query(f"""SELECT id, supplier_id, source, nullif(trim(shipper_name), '') AS shipper_name, nullif(trim(consignee_name), '') AS consignee_name, nullif(trim(hs_code), '') AS hs_code, nullif(trim(product_desc), '') AS product_desc, nullif(trim(quantity), '') AS quantity, nullif(trim(origin_port), '') AS origin_port,
nullif(trim(destination_port), '') AS destination_port, nullif({_BUYER}, '') AS consignee_country, shipment_date FROM shipment_records""")
def trade_facts(spark: SparkSession, d: str) -> DataFrame:
    return normalise.shipment_facts(table(spark, d, "shipment_records")).drop("weight_kg", "value_usd")


_MARKETS = {m: " OR ".join(f"contains(t, '{w}')" for w in ws) for m, ws in normalise.MARKET_WORDS.items()}


@query(f"WITH x AS (SELECT supplier_id, lower(array_to_string(list_sort(list(DISTINCT consignee_country)), ' ')) AS t FROM shipment_records WHERE supplier_id IS NOT NULL AND consignee_country IS NOT NULL GROUP BY 1) SELECT supplier_id, {', '.join(f'CASE WHEN {c} THEN true END AS exports_to_{m}' for m, c in _MARKETS.items())} FROM x")
def market_flags(spark: SparkSession, d: str) -> DataFrame:
    lands = table(spark, d, "shipment_records").where("supplier_id IS NOT NULL AND consignee_country IS NOT NULL").groupBy("supplier_id").agg(F.array_sort(F.collect_set("consignee_country")).alias("m"))
    return lands.select("supplier_id", *[c.alias(n) for n, c in normalise.export_flags(F.col("m")).items()])


@query("SELECT row_id, lower(coalesce(trim(status), '')) IN ('true', 'yes', '1', 'y') AS flag, coalesce(CAST(trunc(TRY_CAST(nullif(trim(regexp_extract(phone, '[0-9]+')), '') AS DOUBLE)) AS BIGINT), 0) AS whole, TRY_CAST(nullif(trim(country), '') AS DOUBLE) AS real FROM batch_upload_rows")
def base_coercions(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "batch_upload_rows")
    return b.select("row_id", normalise.to_bool(F.col("status")).alias("flag"), normalise.to_int(F.regexp_extract("phone", "[0-9]+", 0)).alias("whole"), normalise.to_float(F.col("country")).alias("real"))


_ALIASES = ("companyName", "company_name", "name", "exhibitor", "shipper_name")


@query(f"""WITH x AS (SELECT raw_id, CASE WHEN json_valid(raw_json) THEN CASE WHEN json_type(raw_json) = 'VARCHAR' THEN raw_json ->> '$' ELSE raw_json END END AS j FROM raw_source_data), y AS (SELECT raw_id, CASE WHEN json_valid(j) THEN j END AS j FROM x)
SELECT raw_id, coalesce({', '.join(f"nullif(CASE WHEN json_type(j, '$.{a}') = 'VARCHAR' THEN j ->> '$.{a}' END, '')" for a in _ALIASES)}, CASE WHEN json_type(j, '$.supplier.name') = 'VARCHAR' THEN nullif(j ->> '$.supplier.name', '') END) AS name FROM y WHERE j IS NOT NULL""")
def alias_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """The name of a payload, flat or nested under a supplier object."""
    rows = table(spark, d, "raw_source_data").select("raw_id", payload("raw_json").alias("_v")).where("_v IS NOT NULL")
    text = lambda p: F.expr(f"CASE WHEN schema_of_variant(try_variant_get(_v, '{p}', 'variant')) = 'STRING' THEN try_variant_get(_v, '{p}', 'string') END")
    return rows.select("raw_id", normalise.first_present(*[text(f"$.{a}") for a in _ALIASES], text("$.supplier.name")).alias("name"))


# --- joins and aggregates ---------------------------------------------------------------------------------------------


@query("SELECT golden_record_id AS supplier_id, string_agg(DISTINCT source, ' | ' ORDER BY source) AS sources, count(*) AS n FROM raw_source_data WHERE golden_record_id IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def source_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_source_data").where("golden_record_id IS NOT NULL AND source IS NOT NULL")
    return rows.groupBy(F.col("golden_record_id").alias("supplier_id")).agg(F.array_join(F.array_sort(F.collect_set("source")), " | ").alias("sources"), F.count(F.lit(1)).alias("n"))


@query("SELECT s.id, coalesce(p.pages, 0) AS pages, coalesce(r.shipments, 0) AS shipments, coalesce(w.raw_rows, 0) AS raw_rows FROM suppliers s LEFT JOIN (SELECT supplier_id, count(*) AS pages FROM collected_pages GROUP BY 1) p ON p.supplier_id = s.id LEFT JOIN (SELECT supplier_id, count(*) AS shipments FROM shipment_records GROUP BY 1) r ON r.supplier_id = s.id LEFT JOIN (SELECT golden_record_id, count(*) AS raw_rows FROM raw_source_data GROUP BY 1) w ON w.golden_record_id = s.id")
def supplier_detail(spark: SparkSession, d: str) -> DataFrame:
    """What hangs on each supplier, fetched by one join per table instead of one lookup per supplier."""
    out = _suppliers(spark, d).select("id")
    for name, key, n in (("collected_pages", "supplier_id", "pages"), ("shipment_records", "supplier_id", "shipments"), ("raw_source_data", "golden_record_id", "raw_rows")):
        out = out.join(table(spark, d, name).where(f"{key} IS NOT NULL").groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias(n)), "id", "left")
    return out.fillna(0)


@query(f"SELECT DISTINCT domain FROM (SELECT {_DOMAIN.format('website')} AS domain FROM directory_listings) WHERE domain IS NOT NULL AND domain NOT IN (SELECT lower(domain) FROM suppliers WHERE domain IS NOT NULL)")
def unseen_domains(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "directory_listings").select(extract_domain(F.col("website")).alias("domain")).where("domain IS NOT NULL").distinct()
    return history.pending(new, _suppliers(spark, d).where("domain IS NOT NULL").select(F.lower("domain").alias("domain")), "domain")


@query("WITH m AS (SELECT lower(trim(canonical_name)) AS n, country, min(id) AS keep_id FROM suppliers WHERE canonical_name IS NOT NULL AND country IS NOT NULL GROUP BY 1, 2), r AS (SELECT s.id AS remove_id, m.keep_id FROM suppliers s JOIN m ON m.n = lower(trim(s.canonical_name)) AND m.country = s.country WHERE s.id <> m.keep_id) SELECT r2.id, coalesce(r.keep_id, r2.supplier_id) AS supplier_id FROM shipment_records r2 LEFT JOIN r ON r.remove_id = r2.supplier_id")
def rekey_shipments(spark: SparkSession, d: str) -> DataFrame:
    s = _suppliers(spark, d).where("canonical_name IS NOT NULL AND country IS NOT NULL").select("id", F.lower(F.trim("canonical_name")).alias("n"), "country")
    remap = s.join(s.groupBy("n", "country").agg(F.min("id").alias("keep_id")), ["n", "country"]).where("id <> keep_id").select(F.col("id").alias("remove_id"), "keep_id")
    return history.rekey(table(spark, d, "shipment_records").select("id", "supplier_id"), "supplier_id", remap)


@query("SELECT batch_job_id, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (website <> '') AS with_website, count(*) FILTER (phone <> '') AS with_phone, count(DISTINCT country) AS countries FROM batch_upload_rows GROUP BY 1")
def batch_counters(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "batch_upload_rows")
    return b.groupBy("batch_job_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("website") != "").alias("with_website"), F.count_if(F.col("phone") != "").alias("with_phone"), F.countDistinct("country").alias("countries"))


@query("SELECT supplier_id, CASE WHEN bool_or(len(image_urls) > 0) THEN 'some' ELSE 'none' END AS photos, CAST(coalesce(sum(len(image_urls)), 0) AS BIGINT) AS n FROM collected_pages WHERE supplier_id IS NOT NULL GROUP BY 1")
def photo_rollup(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("image_urls").isNotNull(), F.size("image_urls")).otherwise(0)
    return table(spark, d, "collected_pages").where("supplier_id IS NOT NULL").groupBy("supplier_id").agg(F.when(F.max(size) > 0, "some").otherwise("none").alias("photos"), F.sum(size).alias("n"))


# --- windows, sorts and limits ----------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (PARTITION BY country ORDER BY composite_score DESC NULLS LAST, id) AS no, id, country FROM suppliers")
def numbered_suppliers(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("country").orderBy(F.col("composite_score").desc_nulls_last(), "id")
    return _suppliers(spark, d).select(F.row_number().over(w).alias("no"), "id", "country")


@query("WITH x AS (SELECT id, shipper_name, shipment_date, coalesce(sum(1) OVER (PARTITION BY shipper_name ORDER BY shipment_date NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM shipment_records WHERE shipper_name IS NOT NULL) SELECT id, shipper_name FROM x WHERE b < 5")
def until_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """Shipments of a shipper in order until five are reached."""
    rows = table(spark, d, "shipment_records").where("shipper_name IS NOT NULL").select("id", "shipper_name", "shipment_date", F.lit(1).alias("one"))
    return records.until_total(rows, "shipper_name", [F.col("shipment_date").asc_nulls_first(), F.col("id")], "one", 5).select("id", "shipper_name")


@query("SELECT source, listing_id FROM directory_listings QUALIFY row_number() OVER (PARTITION BY source ORDER BY scraped_at DESC NULLS LAST, listing_id) <= 25")
def source_cap(spark: SparkSession, d: str) -> DataFrame:
    """The newest 25 listings of each source; the cap is the feature."""
    return search.up_to(table(spark, d, "directory_listings").select("source", "listing_id", "scraped_at"), "source", [F.col("scraped_at").desc_nulls_last(), F.col("listing_id")], 25).drop("scraped_at")


@query("SELECT page_id, array_to_string(image_urls[1:5], ' ') AS images FROM collected_pages WHERE image_urls IS NOT NULL")
def image_budget(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collected_pages").where("image_urls IS NOT NULL").select("page_id", F.array_join(F.slice("image_urls", 1, 5), " ").alias("images"))


@query("SELECT page_id, supplier_id FROM collected_pages WHERE supplier_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY supplier_id ORDER BY CASE WHEN lower(url) LIKE '%contact%' OR lower(url) LIKE '%about%' THEN 0 ELSE 1 END, page_id) <= 6")
def page_budget(spark: SparkSession, d: str) -> DataFrame:
    """Six pages of a supplier, those of priority first; the budget is the feature."""
    first = F.when(F.lower("url").contains("contact") | F.lower("url").contains("about"), 0).otherwise(1)
    return search.up_to(table(spark, d, "collected_pages").where("supplier_id IS NOT NULL").select("page_id", "supplier_id", "url"), "supplier_id", [first, F.col("page_id")], 6).drop("url")


# --- sets -------------------------------------------------------------------------------------------------------------

_ARR = "coalesce({0}, [])"


@query(f"""WITH x AS (SELECT id, list_distinct(list_filter({_ARR.format('product_keywords')}, lambda k: k IS NOT NULL)) AS a, list_distinct(list_filter({_ARR.format('primary_categories')}, lambda k: k IS NOT NULL)) AS b FROM suppliers)
SELECT id, CAST(len(list_distinct(list_concat(a, b))) AS INT) AS united, CAST(len(list_intersect(a, b)) AS INT) AS common, list_has_all(a, ['ramp spring']) AS has_required, CAST(len(list_filter(b, lambda k: NOT list_contains(a, k))) AS INT) AS unconfirmed, list_has_any(a, ['king pin', 'ramp spring']) AS overlaps FROM x""")
def array_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union in order, intersection, required within found, claimed less found, and overlap."""
    none = F.array().cast("array<string>")
    x = _suppliers(spark, d).select("id", F.array_distinct(F.array_compact(F.coalesce("product_keywords", none))).alias("a"), F.array_distinct(F.array_compact(F.coalesce("primary_categories", none))).alias("b"))
    return x.select("id", F.size(F.array_union("a", "b")).alias("united"), F.size(F.array_intersect("a", "b")).alias("common"), (F.size(F.array_except(F.array(F.lit("ramp spring")), "a")) == 0).alias("has_required"), F.size(F.array_except("b", "a")).alias("unconfirmed"), F.arrays_overlap("a", F.array(F.lit("king pin"), F.lit("ramp spring"))).alias("overlaps"))


@query("""WITH x AS (SELECT raw_id, CASE WHEN json_valid(raw_json) AND json_type(raw_json) = 'OBJECT' THEN json_keys(raw_json) END AS k FROM raw_source_data) SELECT name, min(raw_id) AS first_seen FROM (SELECT raw_id, unnest(k) AS name FROM x) GROUP BY 1""")
def column_universe(spark: SparkSession, d: str) -> DataFrame:
    """Every key of the plain objects among the payloads, by where it is first seen."""
    rows = table(spark, d, "raw_source_data").where(~F.ltrim("raw_json").startswith('"')).select("raw_id", payload("raw_json").alias("_v")).where("_v IS NOT NULL")
    return records.column_universe(rows.select("raw_id", F.expr("try_variant_get(_v, '$', 'map<string,variant>')").alias("m")), "m", "raw_id")


@query("SELECT 'upload' AS bucket, company_name AS name, country FROM batch_upload_rows UNION ALL SELECT source AS bucket, company_name AS name, country FROM directory_listings")
def sheets_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "batch_upload_rows").select(F.lit("upload").alias("bucket"), F.col("company_name").alias("name"), "country")
    return a.unionByName(table(spark, d, "directory_listings").select(F.col("source").alias("bucket"), F.col("company_name").alias("name"), "country"))


@query("SELECT CASE WHEN coalesce(flagged, false) THEN 'removed' ELSE 'confirmed' END AS part, count(*) AS n FROM suppliers GROUP BY 1")
def partition_by_flag(spark: SparkSession, d: str) -> DataFrame:
    return _suppliers(spark, d).groupBy(F.when(F.coalesce("flagged", F.lit(False)), "removed").otherwise("confirmed").alias("part")).agg(F.count(F.lit(1)).alias("n"))


# --- writes -----------------------------------------------------------------------------------------------------------

_FOUND = "SELECT b.city, b.phone, s.id FROM (SELECT website, min_by(city, row_id) FILTER (city <> '') AS city, min_by(phone, row_id) FILTER (phone <> '') AS phone FROM (SELECT {0} AS website, city, phone, row_id FROM batch_upload_rows) WHERE website IS NOT NULL GROUP BY 1) b JOIN suppliers s ON lower(s.domain) = b.website".replace("{0}", _DOMAIN.format("website"))


@query(f"WITH u AS ({_FOUND}) SELECT s.id, CASE WHEN coalesce(s.city, '') = '' THEN u.city ELSE s.city END AS city, CASE WHEN coalesce(s.primary_phone, '') = '' THEN u.phone ELSE s.primary_phone END AS primary_phone FROM suppliers s LEFT JOIN u USING (id)")
def merge_into_golden(spark: SparkSession, d: str) -> DataFrame:
    """City and phone of uploads with a supplier's web address, where the supplier has none."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    up = table(spark, d, "batch_upload_rows").select(extract_domain(F.col("website")).alias("w"), "city", "phone", "row_id").where("w IS NOT NULL")
    up = up.groupBy("w").agg(*[F.min_by(filled(c), F.when(filled(c).isNotNull(), F.col("row_id"))).alias(c) for c in ("city", "phone")])
    s = _suppliers(spark, d).select("id", "domain", "city", "primary_phone")
    updates = s.select("id", F.lower("domain").alias("w")).join(up, "w").select("id", "city", F.col("phone").alias("primary_phone"))
    return records.merged(s, updates, "id", ("city", "primary_phone")).drop("domain")


@query("WITH n AS (SELECT listing_id, company_name, country FROM directory_listings WHERE scraped_at >= TIMESTAMP '2026-01-01'), o AS (SELECT listing_id, company_name, country FROM directory_listings WHERE scraped_at < TIMESTAMP '2026-03-01') SELECT * FROM n UNION ALL SELECT * FROM o WHERE listing_id NOT IN (SELECT listing_id FROM n)")
def upsert_listings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "directory_listings").select("listing_id", "company_name", "country", "scraped_at")
    return records.upserted(rows.where("scraped_at < '2026-03-01'").drop("scraped_at"), rows.where("scraped_at >= '2026-01-01'").drop("scraped_at"), ["listing_id"])


@query("SELECT id FROM shipment_records WHERE supplier_id IS NULL OR supplier_id NOT IN (SELECT id FROM suppliers WHERE coalesce(flagged, false))")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The shipments that stay when flagged suppliers are deleted."""
    return records.without(table(spark, d, "shipment_records").select("id", "supplier_id"), "supplier_id", _suppliers(spark, d).where("flagged").select("id")).select("id")


@query(f"""WITH m AS (SELECT supplier_id, lower(trim(mail)) AS mail, min(page_id) AS p FROM (SELECT supplier_id, page_id, unnest(mailto_emails) AS mail FROM collected_pages WHERE supplier_id IS NOT NULL) GROUP BY 1, 2), k AS (SELECT * FROM m WHERE regexp_full_match(mail, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}') AND split_part(mail, '.', -1) NOT IN {_in(contacts.IMAGE_ENDINGS)} AND split_part(mail, '@', 1) NOT IN {_in(contacts.JUNK_LOCAL)} AND split_part(mail, '@', -1) NOT IN {_in(contacts.JUNK_DOMAINS)}),
f AS (SELECT supplier_id, list(mail ORDER BY p, mail) AS found FROM k GROUP BY 1), x AS (SELECT s.id, CASE WHEN coalesce(s.primary_email, '') = '' THEN f.found[1] ELSE s.primary_email END AS primary_email, f.found FROM suppliers s JOIN f ON f.supplier_id = s.id)
SELECT id, primary_email, array_to_string(list_filter(found, lambda y: y IS DISTINCT FROM primary_email), '; ') AS secondary_emails FROM x""")
def gap_fill_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Mails of a supplier's pages: the first where it has none, the rest as secondary."""
    pages = table(spark, d, "collected_pages").where("supplier_id IS NOT NULL").select("supplier_id", "page_id", F.explode(contacts.mailto_emails(F.col("mailto_emails"))).alias("mail"))
    first = pages.groupBy("supplier_id", "mail").agg(F.min("page_id").alias("p"))
    found = first.groupBy("supplier_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "mail"))), lambda x: x["mail"]).alias("found"))
    rows = _suppliers(spark, d).select("id", "primary_email").join(found, F.col("id") == F.col("supplier_id"))
    return records.gap_filled(rows, "primary_email", F.col("found"), "secondary").select("id", "primary_email", F.array_join("secondary", "; ").alias("secondary_emails"))


# --- exports ----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(id AS VARCHAR) AS id, coalesce(canonical_name, '') AS canonical_name, CASE WHEN coalesce(primary_phone, '') <> '' THEN '=\"' || primary_phone || '\"' ELSE '' END AS primary_phone, coalesce(array_to_string(product_keywords, '; '), '') AS product_keywords, coalesce(CAST(iso_9001_expiry AS VARCHAR), '') AS iso_9001_expiry, coalesce(CAST(is_manufacturer AS VARCHAR), '') AS is_manufacturer FROM suppliers")
def supplier_export(spark: SparkSession, d: str) -> DataFrame:
    """Six of the 31 export columns, for the check; the export writes all."""
    return exports.supplier_export(_suppliers(spark, d)).select("id", "canonical_name", "primary_phone", "product_keywords", "iso_9001_expiry", "is_manufacturer")


@query(f"WITH r AS (SELECT b.row_id, min(s.id) AS supplier_id FROM (SELECT row_id, {_DOMAIN.format('website')} AS w FROM batch_upload_rows) b JOIN suppliers s ON lower(s.domain) = b.w GROUP BY 1) SELECT b.row_id, b.batch_job_id, b.row_index, b.company_name, s.canonical_name AS found_name, s.domain AS found_domain, s.primary_email AS found_email FROM batch_upload_rows b LEFT JOIN r USING (row_id) LEFT JOIN suppliers s ON s.id = r.supplier_id")
def batch_results(spark: SparkSession, d: str) -> DataFrame:
    from tradeloom.operators.resolve import exact_matches

    uploads, suppliers = table(spark, d, "batch_upload_rows"), _suppliers(spark, d)
    known = exact_matches(uploads, suppliers).groupBy("row_id").agg(F.min("supplier_id").alias("supplier_id"))
    return exports.batch_results(uploads.select("row_id", "batch_job_id", "row_index", "company_name"), known, suppliers)


@query("WITH c AS (SELECT supplier_id, CASE WHEN lower(url) LIKE '%contact%' THEN 'contact' WHEN lower(url) LIKE '%about%' THEN 'about' ELSE 'other' END AS role, url, page_id FROM collected_pages WHERE supplier_id IS NOT NULL AND url IS NOT NULL) SELECT supplier_id, min_by(url, page_id) FILTER (role = 'contact') AS contact, min_by(url, page_id) FILTER (role = 'about') AS about, min_by(url, page_id) FILTER (role = 'other') AS other FROM c GROUP BY 1")
def role_pivot(spark: SparkSession, d: str) -> DataFrame:
    u = F.lower("url")
    rows = table(spark, d, "collected_pages").where("supplier_id IS NOT NULL AND url IS NOT NULL").select("supplier_id", "url", "page_id", F.when(u.contains("contact"), "contact").when(u.contains("about"), "about").otherwise("other").alias("role"))
    return exports.role_pivot(rows, "supplier_id", "role", "url", "page_id", ("contact", "about", "other"))


@query()
def evidence_bundles(spark: SparkSession, d: str) -> DataFrame:
    return exports.evidence_bundle(_suppliers(spark, d).select("id", "canonical_name", "country"), table(spark, d, "collected_pages").select("supplier_id", "url"), table(spark, d, "shipment_records").select("supplier_id"))
