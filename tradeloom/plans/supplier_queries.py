"""Supplier search, scoring, resolution, history and reports, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeloom.functions.text import CODE_ALPHABET, CODE_WEIGHTS, NAME_ENDINGS, PLACES, extract_domain, normalise_company_name, parse_date, parse_number, valid_code
from tradeloom.operators import contacts, history, resolve, scoring, taxonomy
from tradeloom.runtime import table

AS_OF = "2026-06-30"
MARKETS = {"uk": ("united kingdom", "uk", "gb", "great britain", "england"), "eu": ("germany", "de", "france", "fr", "italy", "it", "poland", "pl", "spain", "es", "netherlands", "nl"), "us": ("united states", "usa", "us", "u.s.a.")}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _likes(col: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"{col} LIKE '%{w}%'" for w in words) + ")"


def _shows(col: str, c: taxonomy.Category) -> str:
    """The category rule in SQL: a vetoing word leaves only words that do not hold one."""
    return f"CASE WHEN {_likes(col, c.exclude)} THEN {_likes(col, c.strong)} ELSE {_likes(col, c.include)} END" if c.exclude else _likes(col, c.include)


def _case(col: str) -> str:
    return "(" + " + ".join(f"CAST({_shows(col, c)} AS INT)" for c in taxonomy.CATEGORIES) + ")"


_KEYWORDS = "lower(concat_ws(' || ', nullif(array_to_string(product_keywords, ' || '), ''), nullif(array_to_string(primary_categories, ' || '), ''), canonical_name))"
_CAPS = "caps AS (SELECT DISTINCT id AS supplier_id, lower(trim(k)) AS term FROM suppliers, UNNEST(product_keywords) AS u(k) WHERE k IS NOT NULL)"


def _caps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "suppliers").select(F.col("id").alias("supplier_id"), F.explode("product_keywords").alias("k")).where("k IS NOT NULL").select("supplier_id", F.lower(F.trim("k")).alias("term")).distinct()


# --- search -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {_CAPS}, hit AS (SELECT supplier_id FROM caps WHERE term IN ('ramp spring', 'roof vent') GROUP BY 1 HAVING count(DISTINCT term) = 2),
ev AS (SELECT supplier_id, string_agg(term, '; ' ORDER BY term) AS evidence FROM caps GROUP BY 1)
SELECT s.id, s.canonical_name, s.country, s.composite_score, e.evidence FROM suppliers s JOIN hit h ON h.supplier_id = s.id LEFT JOIN ev e ON e.supplier_id = s.id
WHERE coalesce(s.flagged, false) = false AND s.composite_score >= 20 ORDER BY s.composite_score DESC, s.id LIMIT 50""")
def procurement_search(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with all required terms, not flagged, by score; evidence attached. The limit is the feature."""
    caps = _caps(spark, d)
    required = ["ramp spring", "roof vent"]
    hit = caps.where(F.col("term").isin(required)).groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(set(required)))
    s = table(spark, d, "suppliers").where("coalesce(flagged, false) = false AND composite_score >= 20").select("id", "canonical_name", "country", "composite_score")
    top = s.join(hit, s.id == hit.supplier_id, "left_semi").orderBy(F.col("composite_score").desc(), "id").limit(50)
    ev = caps.join(F.broadcast(top.select(F.col("id").alias("supplier_id"))), "supplier_id", "left_semi").groupBy("supplier_id").agg(F.array_join(F.array_sort(F.collect_list("term")), "; ").alias("evidence"))
    return top.join(ev, top.id == ev.supplier_id, "left").drop("supplier_id")


@query(f"WITH {_CAPS} SELECT supplier_id FROM caps WHERE term IN ('ramp spring', 'king pin') GROUP BY 1 HAVING count(DISTINCT term) = 2")
def capability_division(spark: SparkSession, d: str) -> DataFrame:
    return _caps(spark, d).where(F.col("term").isin("ramp spring", "king pin")).groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("supplier_id")


@query(f"WITH {_CAPS} SELECT id, canonical_name FROM suppliers WHERE id IN (SELECT supplier_id FROM caps WHERE term = 'gas strut')")
def find_by_capability(spark: SparkSession, d: str) -> DataFrame:
    hit = _caps(spark, d).where("term = 'gas strut'")
    s = table(spark, d, "suppliers").select("id", "canonical_name")
    return s.join(hit, s.id == hit.supplier_id, "left_semi")


@query("""SELECT id, canonical_name FROM suppliers WHERE coalesce(flagged, false) = false AND (canonical_name ILIKE '%axle%' OR city ILIKE '%axle%'
OR len(list_filter(product_keywords, lambda x: x ILIKE '%axle%')) > 0 OR len(list_filter(primary_categories, lambda x: x ILIKE '%axle%')) > 0)""")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    like = lambda c: F.exists(c, lambda x: F.coalesce(x.ilike("%axle%"), F.lit(False)))
    hit = [F.coalesce(F.col("canonical_name").ilike("%axle%"), F.lit(False)), F.coalesce(F.col("city").ilike("%axle%"), F.lit(False)), F.coalesce(like("product_keywords"), F.lit(False)), F.coalesce(like("primary_categories"), F.lit(False))]
    return table(spark, d, "suppliers").where("coalesce(flagged, false) = false").where(hit[0] | hit[1] | hit[2] | hit[3]).select("id", "canonical_name")


@query("SELECT id, canonical_name, composite_score FROM suppliers WHERE country = 'China' AND composite_score >= 30 ORDER BY composite_score DESC, canonical_name, id LIMIT 25 OFFSET 10")
def list_page(spark: SparkSession, d: str) -> DataFrame:
    """One page of a filtered list; the limit is the feature."""
    return table(spark, d, "suppliers").where("country = 'China' AND composite_score >= 30").select("id", "canonical_name", "composite_score").orderBy(F.col("composite_score").desc(), "canonical_name", "id").offset(10).limit(25)


@query("SELECT id, uscc FROM suppliers WHERE country = 'China' AND coalesce(uscc, '') <> '' AND coalesce(uscc_verified, false) = false")
def unverified_chinese(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "suppliers").where("country = 'China' AND coalesce(uscc, '') <> '' AND coalesce(uscc_verified, false) = false").select("id", "uscc")


_DOMAIN = "nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), ':[0-9]+$', ''), '^www\\.', ''), '')"


@query(f"SELECT id, domain FROM suppliers WHERE lower(domain) IN (SELECT {_DOMAIN.format('website')} FROM batch_upload_rows WHERE website IS NOT NULL)")
def domain_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Equality lookup of the web addresses of all uploaded rows."""
    wanted = table(spark, d, "batch_upload_rows").select(extract_domain(F.col("website")).alias("w"))
    s = table(spark, d, "suppliers").select("id", "domain")
    return s.join(wanted, F.lower(s.domain) == wanted.w, "left_semi")


@query("SELECT id, iso_9001_expiry FROM suppliers WHERE iso_9001 AND iso_9001_expiry < DATE '2026-06-30' + INTERVAL 90 DAY")
def certificate_recheck(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "suppliers").where("iso_9001 AND iso_9001_expiry < date_add(DATE'2026-06-30', 90)").select("id", "iso_9001_expiry")


# --- scores -----------------------------------------------------------------------------------------------------------


@query(f"""SELECT id, CASE {_case(_KEYWORDS)} WHEN 0 THEN 0 WHEN 1 THEN 55 WHEN 2 THEN 75 WHEN 3 THEN 90 ELSE 100 END AS product_fit_score,
least(100, CASE WHEN is_manufacturer THEN 40 ELSE 0 END + CASE WHEN iso_9001 THEN 25 ELSE 0 END + CASE WHEN e_mark_certified THEN 20 ELSE 0 END + CASE WHEN iatf_16949 THEN 15 ELSE 0 END) AS verification_score,
least(100, CASE WHEN contact_name <> '' THEN 30 ELSE 0 END + CASE WHEN primary_email <> '' THEN 25 ELSE 0 END + CASE WHEN whatsapp <> '' THEN 25 ELSE 0 END + CASE WHEN primary_phone <> '' THEN 20 ELSE 0 END) AS contact_score,
CASE WHEN alibaba_years >= 5 THEN 40 WHEN alibaba_years >= 3 THEN 25 WHEN alibaba_years >= 1 THEN 10 ELSE 0 END + CASE WHEN alibaba_rating >= 4.5 THEN 20 WHEN alibaba_rating >= 4.0 THEN 10 ELSE 0 END AS platform_score FROM suppliers""")
def score_attributes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "suppliers").select("id", scoring.product_fit().alias("product_fit_score"), scoring.verification().alias("verification_score"), scoring.contact().alias("contact_score"), scoring.platform().alias("platform_score"))


_ONCE = "once AS (SELECT DISTINCT supplier_id, source, consignee_name, consignee_country, shipment_date, hs_code, weight_kg, value_usd FROM shipment_records WHERE supplier_id IS NOT NULL)"
_SHIP = f"{_ONCE}, ship AS (SELECT supplier_id, " + ", ".join(f"count(*) FILTER (lower(trim(consignee_country)) IN {_in(n)}) AS shipments_{m}" for m, n in MARKETS.items()) + ", max(shipment_date) AS last_shipment FROM once GROUP BY 1)"
_EXPORT = """least(100, CASE WHEN shipments_uk > 10 THEN 60 WHEN shipments_uk > 0 THEN 40 WHEN exports_to_uk THEN 15 ELSE 0 END + CASE WHEN shipments_eu > 0 THEN 20 WHEN exports_to_eu THEN 8 ELSE 0 END
+ CASE WHEN shipments_us > 0 THEN 10 WHEN exports_to_us THEN 5 ELSE 0 END + CASE WHEN last_shipment > DATE '2026-01-01' THEN 10 ELSE 0 END)"""


@query(f"WITH {_SHIP} SELECT id, {_EXPORT} AS export_score FROM suppliers s LEFT JOIN ship ON ship.supplier_id = s.id")
def score_export(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "suppliers").select("id", "exports_to_uk", "exports_to_eu", "exports_to_us")
    ship = scoring.shipment_summary(table(spark, d, "shipment_records"), MARKETS)
    return s.join(ship, s.id == ship.supplier_id, "left").select("id", scoring.export(AS_OF).alias("export_score"))


_WEIGHT = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.SOURCE_WEIGHTS.items()) + f" ELSE {scoring.DEFAULT_SOURCE} END"
_SRC = f"src AS (SELECT golden_record_id AS supplier_id, count(DISTINCT source) AS n_sources, max({_WEIGHT}) AS best_source FROM raw_source_data WHERE golden_record_id IS NOT NULL AND source IS NOT NULL GROUP BY 1)"
_PROV = "least(100, CAST(round_even(coalesce(best_source, 0) * 0.4, 0) AS INT) + CASE WHEN n_sources >= 3 THEN 30 WHEN n_sources = 2 THEN 18 ELSE 0 END + CASE WHEN domain <> '' THEN 20 ELSE 0 END + CASE WHEN address <> '' THEN 10 ELSE 0 END)"


@query(f"WITH {_SRC} SELECT id, {_PROV} AS provenance_score FROM suppliers s LEFT JOIN src ON src.supplier_id = s.id")
def score_provenance(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "suppliers").select("id", "domain", "address")
    src = scoring.source_summary(table(spark, d, "raw_source_data"))
    return s.join(src, s.id == src.supplier_id, "left").select("id", scoring.provenance().alias("provenance_score"))


@query(f"""WITH {_SHIP}, {_SRC}, x AS (SELECT s.*, CAST(CASE {_case(_KEYWORDS)} WHEN 0 THEN 0 WHEN 1 THEN 55 WHEN 2 THEN 75 WHEN 3 THEN 90 ELSE 100 END AS DOUBLE) AS f, CAST({_PROV} AS DOUBLE) AS p,
CAST(least(100, CASE WHEN is_manufacturer THEN 40 ELSE 0 END + CASE WHEN iso_9001 THEN 25 ELSE 0 END + CASE WHEN e_mark_certified THEN 20 ELSE 0 END + CASE WHEN iatf_16949 THEN 15 ELSE 0 END) AS DOUBLE) AS v, CAST({_EXPORT} AS DOUBLE) AS e,
CAST(least(100, CASE WHEN contact_name <> '' THEN 30 ELSE 0 END + CASE WHEN primary_email <> '' THEN 25 ELSE 0 END + CASE WHEN whatsapp <> '' THEN 25 ELSE 0 END + CASE WHEN primary_phone <> '' THEN 20 ELSE 0 END) AS DOUBLE) AS c,
CAST(CASE WHEN alibaba_years >= 5 THEN 40 WHEN alibaba_years >= 3 THEN 25 WHEN alibaba_years >= 1 THEN 10 ELSE 0 END + CASE WHEN alibaba_rating >= 4.5 THEN 20 WHEN alibaba_rating >= 4.0 THEN 10 ELSE 0 END AS DOUBLE) AS pl, last_shipment
FROM suppliers s LEFT JOIN ship ON ship.supplier_id = s.id LEFT JOIN src ON src.supplier_id = s.id), y AS (SELECT *, greatest(0, least(100, CAST(round_even(f * CAST(0.25 AS DOUBLE) + p * CAST(0.25 AS DOUBLE) + v * CAST(0.25 AS DOUBLE) + e * CAST(0.15 AS DOUBLE) + c * CAST(0.10 AS DOUBLE), 0) AS INT)
+ CASE WHEN uscc_verified THEN 5 ELSE 0 END + CAST(round_even(pl * CAST(0.05 AS DOUBLE), 0) AS INT))) AS composite_new,
CAST(round_even(CAST(100.0 AS DOUBLE) * (CASE WHEN domain <> '' THEN 1 ELSE 0 END + CASE WHEN address <> '' THEN 1 ELSE 0 END + CASE WHEN primary_email <> '' OR primary_phone <> '' THEN 1 ELSE 0 END + CASE WHEN is_manufacturer IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN len(product_keywords) > 0 THEN 1 ELSE 0 END + CASE WHEN uscc <> '' THEN 1 ELSE 0 END + CASE WHEN last_shipment IS NOT NULL THEN 1 ELSE 0 END) / 7, 0) AS INT) AS evidence_coverage FROM x)
SELECT id, composite_new, evidence_coverage, CASE WHEN coalesce(flagged, false) OR (is_manufacturer = false AND coalesce(manufacturer_confidence, 0) > 80) THEN 'avoid' WHEN evidence_coverage < 30 THEN 'unscored' WHEN composite_new >= 70 THEN 'strong' WHEN composite_new >= 40 THEN 'review' ELSE 'weak' END AS recommendation FROM y""")
def score_composite(spark: SparkSession, d: str) -> DataFrame:
    return scoring.scored(table(spark, d, "suppliers"), table(spark, d, "shipment_records"), table(spark, d, "raw_source_data"), MARKETS, AS_OF).select("id", "composite_new", "evidence_coverage", "recommendation")


@query("""WITH x AS (SELECT id, CASE WHEN coalesce(alibaba_years, 0) > 0 AND coalesce(year_established, 0) > 0 THEN abs(2026 - alibaba_years - year_established) <= 2 END AS t, CASE WHEN iso_9001 OR iatf_16949 OR e_mark_certified THEN true END AS c FROM suppliers),
y AS (SELECT *, 50 + CASE WHEN t THEN 15 WHEN NOT t THEN -15 ELSE 0 END + CASE WHEN c THEN 25 ELSE 0 END AS s FROM x)
SELECT id, greatest(0, least(100, s)) AS confidence, CASE WHEN t IS NOT NULL OR c IS NOT NULL THEN CASE WHEN s >= 70 THEN true WHEN s <= 30 THEN false END END AS verdict FROM y""")
def manufacturer_assess(spark: SparkSession, d: str) -> DataFrame:
    score, verdict = scoring.manufacturer_assessment(2026)
    return table(spark, d, "suppliers").select("id", score.alias("confidence"), verdict.alias("verdict"))


@query("""SELECT id, greatest(0, least(100, 50 + CASE WHEN is_manufacturer THEN 25 WHEN is_manufacturer = false THEN -25 ELSE 0 END + CASE WHEN factory_location IS NOT NULL AND address IS NOT NULL THEN CASE WHEN lower(factory_location) = lower(address) THEN 25 ELSE -25 END ELSE 0 END
+ CASE WHEN iso_9001 THEN 15 ELSE 0 END + CASE WHEN primary_email <> '' OR primary_phone <> '' THEN 5 ELSE 0 END)) AS ai_confidence FROM suppliers""")
def confidence_checks(spark: SparkSession, d: str) -> DataFrame:
    checks = {"manufacturer_assessment": F.col("is_manufacturer"), "facility_address": F.when(F.col("factory_location").isNotNull() & F.col("address").isNotNull(), F.lower("factory_location") == F.lower("address")), "certification_consistency": F.when(F.col("iso_9001"), True), "contact_verification": F.when((F.coalesce("primary_email", F.lit("")) != "") | (F.coalesce("primary_phone", F.lit("")) != ""), True)}
    return table(spark, d, "suppliers").select("id", scoring.confidence(checks).alias("ai_confidence"))


# --- coverage ---------------------------------------------------------------------------------------------------------

_CATS = " UNION ALL ".join(f"SELECT id, domain, primary_email, country, '{c.key}' AS category FROM t WHERE {_shows('kw', c)}" for c in taxonomy.CATEGORIES)
_COV = f"t AS (SELECT id, domain, primary_email, country, {_KEYWORDS} AS kw FROM suppliers), c AS ({_CATS})"


def _by_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "suppliers").select("id", "domain", "primary_email", "country", F.explode(taxonomy.categories_of(scoring.keyword_text())).alias("category"))


_TARGETS = ", ".join(f"('{c.key}', {c.target})" for c in taxonomy.CATEGORIES)


@query(f"""WITH {_COV}, k(category, target) AS (VALUES {_TARGETS}), n AS (SELECT k.category, any_value(k.target) AS target, count(c.id) AS total, count(c.id) FILTER (c.domain <> '') AS with_domain, count(c.id) FILTER (c.primary_email <> '') AS with_email FROM k LEFT JOIN c USING (category) GROUP BY 1)
SELECT category, target, total, with_domain, with_email, greatest(0, target - total) AS gap, CASE WHEN total = 0 THEN 'EMPTY' WHEN total >= target THEN 'OK' WHEN total >= target * 0.5 THEN 'THIN' ELSE 'CRITICAL' END AS status FROM n""")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    cats = spark.createDataFrame([(c.key, c.target) for c in taxonomy.CATEGORIES], "category string, target int")
    found = _by_category(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("domain") != "").alias("with_domain"), F.count_if(F.col("primary_email") != "").alias("with_email"))
    full = cats.join(found, "category", "left").fillna(0, ["total", "with_domain", "with_email"])
    return full.withColumn("gap", F.greatest(F.lit(0).cast("bigint"), F.col("target") - F.col("total"))).withColumn("status", taxonomy.status(F.col("total"), F.col("target")))


@query(f"WITH {_COV} SELECT id FROM t WHERE id NOT IN (SELECT id FROM c)")
def coverage_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "suppliers").where(F.size(taxonomy.categories_of(scoring.keyword_text())) == 0).select("id")


@query(f"WITH {_COV}, n AS (SELECT category, country, count(*) AS suppliers FROM c WHERE country IS NOT NULL GROUP BY 1, 2) SELECT category, country, suppliers FROM n QUALIFY row_number() OVER (PARTITION BY category ORDER BY suppliers DESC, country) <= 3")
def coverage_top_countries(spark: SparkSession, d: str) -> DataFrame:
    n = _by_category(spark, d).where("country IS NOT NULL").groupBy("category", "country").agg(F.count(F.lit(1)).alias("suppliers"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy(F.col("suppliers").desc(), "country"))).where("k <= 3").drop("k")


# --- resolution and merging -------------------------------------------------------------------------------------------

@query(f"SELECT row_id, {_DOMAIN.format('website')} AS domain FROM batch_upload_rows")
def domain_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "batch_upload_rows").select("row_id", extract_domain(F.col("website")).alias("domain"))


@query(f"SELECT b.row_id, s.id AS supplier_id FROM (SELECT row_id, {_DOMAIN.format('website')} AS dm FROM batch_upload_rows) b JOIN suppliers s ON lower(s.domain) = b.dm")
def exact_key_match(spark: SparkSession, d: str) -> DataFrame:
    return resolve.exact_matches(table(spark, d, "batch_upload_rows"), table(spark, d, "suppliers"))


@query()
def fuzzy_resolution(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(table(spark, d, "batch_upload_rows"), table(spark, d, "suppliers"))


def _name(col: str) -> str:
    """The rule of normalised names in SQL."""
    t = f"trim(lower(replace({col}, 'İ', 'i\u0307')))"
    for e in NAME_ENDINGS:
        t = f"trim(regexp_replace({t}, '{e}', ''))"
    t = f"list_filter(regexp_split_to_array(regexp_replace(regexp_replace({t}, '\\([^)]*\\)', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
    return f"coalesce(array_to_string(CASE WHEN len(list_filter({t}, lambda w: w NOT IN {_in(PLACES)})) > 0 THEN list_filter({t}, lambda w: w NOT IN {_in(PLACES)}) ELSE {t} END, ' '), '')"


@query(f"SELECT id, {_name('canonical_name')} AS name FROM suppliers")
def name_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "suppliers").select("id", normalise_company_name(F.col("canonical_name")).alias("name"))


@query("""SELECT company_name, min_by(website, scraped_at) FILTER (website <> '') AS website, min_by(country, scraped_at) FILTER (country <> '') AS country, count(*) AS n_rows
FROM (SELECT DISTINCT ON (company_name, scraped_at) * FROM directory_listings ORDER BY company_name, scraped_at, listing_id) WHERE company_name IS NOT NULL GROUP BY 1""")
def merge_first_filled(spark: SparkSession, d: str) -> DataFrame:
    rows = history.latest(table(spark, d, "directory_listings").where("company_name IS NOT NULL"), ["company_name", "scraped_at"], F.col("listing_id"))
    return resolve.first_filled(rows, "company_name", "scraped_at", ["website", "country"])


@query("SELECT r.raw_id, coalesce(m.keep_id, r.golden_record_id) AS golden_record_id FROM raw_source_data r LEFT JOIN (SELECT max(id) AS remove_id, min(id) AS keep_id FROM suppliers WHERE primary_phone IS NOT NULL GROUP BY primary_phone HAVING count(*) = 2) m ON m.remove_id = r.golden_record_id")
def rekey_on_merge(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "suppliers").where("primary_phone IS NOT NULL").groupBy("primary_phone").agg(F.max("id").alias("remove_id"), F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n = 2")
    return history.rekey(table(spark, d, "raw_source_data").select("raw_id", "golden_record_id"), "golden_record_id", pairs)


# --- history, increments, sets ----------------------------------------------------------------------------------------


@query("SELECT source, golden_record_id, raw_id, scraped_at FROM raw_source_data WHERE golden_record_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, golden_record_id ORDER BY scraped_at DESC, raw_id DESC) = 1")
def latest_per_source(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_source_data").where("golden_record_id IS NOT NULL").select("source", "golden_record_id", "raw_id", "scraped_at")
    return history.latest(rows, ["source", "golden_record_id"], F.col("scraped_at").desc(), F.col("raw_id").desc())


@query("""WITH x AS (SELECT company_name, listing_id, website, country, row_number() OVER w AS n, lag(website) OVER w AS ow, lag(country) OVER w AS oc FROM directory_listings WHERE company_name IS NOT NULL WINDOW w AS (PARTITION BY company_name ORDER BY listing_id))
SELECT company_name, listing_id, 'website' AS field, ow AS old_value, website AS new_value FROM x WHERE n > 1 AND ow IS DISTINCT FROM website UNION ALL SELECT company_name, listing_id, 'country', oc, country FROM x WHERE n > 1 AND oc IS DISTINCT FROM country""")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    return history.change_log(table(spark, d, "directory_listings").where("company_name IS NOT NULL"), "company_name", ["listing_id"], ["website", "country"])


@query("""WITH old AS (SELECT source, source_id, raw_id FROM raw_source_data WHERE scraped_at < TIMESTAMP '2026-01-01'), new AS (SELECT source, source_id, min(raw_id) AS raw_id FROM raw_source_data WHERE scraped_at >= TIMESTAMP '2026-01-01' AND source IS NOT NULL AND source_id IS NOT NULL GROUP BY 1, 2)
SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.source = n.source AND o.source_id = n.source_id)""")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    """What came from 2026 on, inserted into what was there before unless its key is."""
    rows = table(spark, d, "raw_source_data").select("source", "source_id", "raw_id", "scraped_at")
    old = rows.where("scraped_at < '2026-01-01'").drop("scraped_at")
    return history.insert_or_ignore(old, rows.where("scraped_at >= '2026-01-01'").drop("scraped_at"), ["source", "source_id"], "raw_id")


@query("SELECT s.id FROM suppliers s WHERE NOT EXISTS (SELECT 1 FROM collected_pages p WHERE p.supplier_id = s.id) AND s.domain IS NOT NULL")
def pending_collection(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "collected_pages").where("supplier_id IS NOT NULL").select(F.col("supplier_id").alias("id")).distinct()
    return history.pending(table(spark, d, "suppliers").where("domain IS NOT NULL").select("id"), done, "id")


@query("SELECT source, date_diff('day', CAST(max(scraped_at) AS DATE), DATE '2026-06-30') < 7 AS recent FROM raw_source_data GROUP BY 1")
def recently_scraped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_source_data").groupBy("source").agg((F.date_diff(F.lit(AS_OF).cast("date"), F.max("scraped_at").cast("date")) < 7).alias("recent"))


@query("SELECT processing_status AS status, source, count(*) AS n FROM raw_source_data GROUP BY 1, 2")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_source_data").groupBy(F.col("processing_status").alias("status"), "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'suppliers' AS t, count(*) AS n FROM suppliers UNION ALL SELECT 'raw_source_data', count(*) FROM raw_source_data UNION ALL SELECT 'shipment_records', count(*) FROM shipment_records UNION ALL SELECT 'collected_pages', count(*) FROM collected_pages UNION ALL SELECT 'directory_listings', count(*) FROM directory_listings UNION ALL SELECT 'batch_upload_rows', count(*) FROM batch_upload_rows")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    names = ["suppliers", "raw_source_data", "shipment_records", "collected_pages", "directory_listings", "batch_upload_rows"]
    out = None
    for n in names:
        one = table(spark, d, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("t"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT b.row_id, CASE WHEN s.id IS NULL THEN 'missing' WHEN s.country IS DISTINCT FROM b.country THEN 'drifted' ELSE 'confirmed' END AS status FROM (SELECT *, " + _DOMAIN.format("website") + " AS dm FROM batch_upload_rows) b LEFT JOIN suppliers s ON lower(s.domain) = b.dm")
def roster_drift(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "batch_upload_rows").select("row_id", F.col("country").alias("c"), extract_domain(F.col("website")).alias("dm"))
    s = table(spark, d, "suppliers").where("domain IS NOT NULL").select("id", "country", F.lower("domain").alias("dm"))
    return b.join(s, "dm", "left").select("row_id", F.when(F.col("id").isNull(), "missing").when(~F.col("country").eqNullSafe(F.col("c")), "drifted").otherwise("confirmed").alias("status"))


@query("SELECT source, sum(CASE WHEN processing_status = 'processed' THEN 1 ELSE 0 END)::BIGINT AS processed, sum(CASE WHEN processing_status = 'pending' THEN 1 ELSE 0 END)::BIGINT AS pending, sum(CASE WHEN processing_status = 'failed' THEN 1 ELSE 0 END)::BIGINT AS failed, sum(CASE WHEN processing_status = 'duplicate' THEN 1 ELSE 0 END)::BIGINT AS duplicate FROM raw_source_data GROUP BY 1")
def tracker_pivot(spark: SparkSession, d: str) -> DataFrame:
    states = ["processed", "pending", "failed", "duplicate"]
    return table(spark, d, "raw_source_data").groupBy("source").pivot("processing_status", states).agg(F.count(F.lit(1))).fillna(0, states)


# --- shipments and trade ----------------------------------------------------------------------------------------------


@query(f"WITH {_SHIP} SELECT supplier_id, shipments_uk, shipments_eu, shipments_us, last_shipment FROM ship")
def shipment_markets(spark: SparkSession, d: str) -> DataFrame:
    return scoring.shipment_summary(table(spark, d, "shipment_records"), MARKETS)


@query("SELECT substr(hs_code, 1, 4) AS heading, count(*) AS n, count(DISTINCT shipper_name) AS shippers, CAST(round(sum(weight_kg), 2) AS DOUBLE) AS weight_kg FROM shipment_records WHERE hs_code IS NOT NULL GROUP BY 1")
def shipments_by_heading(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shipment_records").where("hs_code IS NOT NULL").groupBy(F.substring("hs_code", 1, 4).alias("heading")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shipper_name").alias("shippers"), F.round(F.sum("weight_kg"), 2).alias("weight_kg"))


@query(f"WITH {_SHIP} SELECT supplier_id, (shipments_uk > 0)::INT + (shipments_eu > 0)::INT + (shipments_us > 0)::INT AS markets FROM ship")
def export_maturity(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.shipment_summary(table(spark, d, "shipment_records"), MARKETS)
    return s.select("supplier_id", sum(((F.col(f"shipments_{m}") > 0).cast("int") for m in MARKETS), F.lit(0)).alias("markets"))


@query("SELECT shipper_name, min(shipment_date) AS first_date, max(shipment_date) AS last_date, count(*) AS n FROM shipment_records GROUP BY 1")
def shipper_activity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shipment_records").groupBy("shipper_name").agg(F.min("shipment_date").alias("first_date"), F.max("shipment_date").alias("last_date"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SHIP}, top AS (SELECT id, canonical_name, composite_score FROM suppliers WHERE coalesce(flagged, false) = false ORDER BY composite_score DESC NULLS LAST, canonical_name, id LIMIT 100)
SELECT id, canonical_name, composite_score, coalesce((shipments_uk > 0)::INT + (shipments_eu > 0)::INT + (shipments_us > 0)::INT, -1) AS markets FROM top LEFT JOIN ship ON ship.supplier_id = top.id ORDER BY markets DESC, composite_score DESC NULLS LAST, canonical_name, id LIMIT 20""")
def buyer_profile_rank(spark: SparkSession, d: str) -> DataFrame:
    """Two-stage ranking: the best 100 by score, re-ranked by confirmed markets; both limits are the feature."""
    order = [F.col("composite_score").desc_nulls_last(), "canonical_name", "id"]
    top = table(spark, d, "suppliers").where("coalesce(flagged, false) = false").select("id", "canonical_name", "composite_score").orderBy(*order).limit(100)
    markets = export_maturity(spark, d)
    joined = top.join(markets, top.id == markets.supplier_id, "left").select("id", "canonical_name", "composite_score", F.coalesce("markets", F.lit(-1)).alias("markets"))
    return joined.orderBy(F.col("markets").desc(), *order).limit(20)


# --- text and values --------------------------------------------------------------------------------------------------


_MAIL_SQL = "regexp_extract_all({0}, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}')"
_UNHIDDEN = "regexp_replace(regexp_replace(text, '(?i)\\s*(\\[\\s*at\\s*\\]|\\(\\s*at\\s*\\))\\s*', '@', 'g'), '(?i)\\s*(\\[\\s*dot\\s*\\]|\\(\\s*dot\\s*\\))\\s*', '.', 'g')"


@query(f"""WITH x AS (SELECT page_id, unnest(list_distinct(list_transform(list_concat({_MAIL_SQL.format('text')}, {_MAIL_SQL.format(_UNHIDDEN)}), lambda m: lower(rtrim(m, '.'))))) AS mail FROM collected_pages),
y AS (SELECT page_id, string_agg(mail, '; ' ORDER BY mail) AS emails FROM x WHERE split_part(mail, '.', -1) NOT IN {_in(contacts.IMAGE_ENDINGS)} AND split_part(mail, '@', 1) NOT IN {_in(contacts.JUNK_LOCAL)} AND split_part(mail, '@', -1) NOT IN {_in(contacts.JUNK_DOMAINS)} GROUP BY 1)
SELECT p.page_id, coalesce(y.emails, '') AS emails FROM collected_pages p LEFT JOIN y USING (page_id)""")
def email_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collected_pages").select("page_id", F.array_join(F.array_sort(contacts.emails(F.col("text"))), "; ").alias("emails"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{s}') THEN '{s}'" for s in contacts.PARKED) + " END AS reason FROM documents")
def parking_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", contacts.parked(F.col("text")).alias("reason"))


@query(f"""SELECT id, regexp_full_match(c, '[{CODE_ALPHABET}]{{18}}') AND substr('{CODE_ALPHABET}', CAST((31 - list_sum(list_transform(range(1, 18), lambda i: (instr('{CODE_ALPHABET}', substr(c, i, 1)) - 1) * ({list(CODE_WEIGHTS)})[i])) % 31) % 31 + 1 AS INT), 1) = substr(c, 18, 1) AS valid
FROM (SELECT id, upper(trim(uscc)) AS c FROM suppliers WHERE uscc IS NOT NULL)""")
def code_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "suppliers").where("uscc IS NOT NULL").select("id", valid_code(F.col("uscc")).alias("valid"))


_FORMATS = ("%Y-%m-%d", "%d %b %Y", "%b %d, %Y", "%B %d, %Y", "%d/%m/%Y", "%m/%d/%Y")
_WRITTEN = " ".join(f"WHEN {k} THEN strftime(shipment_date, '{f}')" for k, f in enumerate(_FORMATS))


@query(f"""WITH t AS (SELECT id, quantity, CASE (id % 6) {_WRITTEN} END AS written FROM shipment_records)
SELECT id, TRY_CAST(nullif(regexp_replace(quantity, '[^0-9.]', '', 'g'), '') AS DOUBLE) * CASE WHEN contains(quantity, '万') THEN 10000 ELSE 1 END AS quantity_value, CAST(try_strptime(written, {list(_FORMATS)}) AS DATE) AS parsed_date FROM t""")
def quantity_parse(spark: SparkSession, d: str) -> DataFrame:
    """Quantities, and dates that are first written in all six formats, by turns."""
    patterns = ("yyyy-MM-dd", "dd MMM yyyy", "MMM dd, yyyy", "MMMM dd, yyyy", "dd/MM/yyyy", "MM/dd/yyyy")
    written = F.coalesce(*[F.when(F.col("id") % 6 == k, F.date_format("shipment_date", p)) for k, p in enumerate(patterns)])
    return table(spark, d, "shipment_records").select("id", parse_number(F.col("quantity")).alias("quantity_value"), parse_date(written).alias("parsed_date"))


@query("SELECT DISTINCT id AS supplier_id, lower(trim(k)) AS term FROM suppliers, UNNEST(product_keywords) AS u(k) WHERE k IS NOT NULL")
def capability_terms(spark: SparkSession, d: str) -> DataFrame:
    return _caps(spark, d)


@query("SELECT regexp_extract(lower(url), '//([^/]+)', 1) AS host, min(page_id) AS first_page, count(*) AS pages FROM collected_pages GROUP BY 1")
def first_seen_host(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collected_pages").groupBy(F.regexp_extract(F.lower("url"), "//([^/]+)", 1).alias("host")).agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("pages"))


@query("SELECT supplier_id, bool_or(has_contact_form) AS any_form, count(*) AS pages, CAST(max(coalesce(len(image_urls), 0)) AS INT) AS most_images FROM collected_pages WHERE supplier_id IS NOT NULL GROUP BY 1")
def page_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collected_pages").where("supplier_id IS NOT NULL").groupBy("supplier_id").agg(F.bool_or("has_contact_form").alias("any_form"), F.count(F.lit(1)).alias("pages"), F.max(F.coalesce(F.array_size("image_urls"), F.lit(0))).alias("most_images"))


@query("SELECT id, CASE WHEN primary_email <> '' THEN 'email' WHEN primary_phone <> '' THEN 'phone' WHEN whatsapp <> '' THEN 'whatsapp' ELSE 'none' END AS method FROM suppliers")
def best_contact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "suppliers").select("id", F.when(F.col("primary_email") != "", "email").when(F.col("primary_phone") != "", "phone").when(F.col("whatsapp") != "", "whatsapp").otherwise("none").alias("method"))


@query("SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2")
def event_activity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, count(*) AS n FROM lineitem GROUP BY 1, 2")
def lineitem_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.count(F.lit(1)).alias("n"))
