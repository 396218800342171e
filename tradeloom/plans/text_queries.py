"""Text, contact and validation functions over whole tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.functions import web
from tradeloom.operators import contacts, taxonomy
from tradeloom.plans.supplier_queries import _DOMAIN, _in
from tradeloom.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2026-06-30"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TITLE = "trim(split_part(text, chr(10), 1))"


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collected_pages").select("page_id", F.trim(F.substring_index("text", "\n", 1)).alias("title"), "text")


@query(f"SELECT page_id, coalesce(host LIKE '%.alibaba.com' OR {' OR '.join(f'host = {_text(p)} OR host LIKE {_text(chr(37) + chr(46) + p)}' for p in web.PLATFORMS)}, false) AS platform FROM (SELECT page_id, {_DOMAIN.format('url')} AS host FROM collected_pages)")
def platform_hosts(spark: SparkSession, d: str) -> DataFrame:
    from tradeloom.functions.text import extract_domain

    return table(spark, d, "collected_pages").select("page_id", web.is_platform(extract_domain(F.col("url"))).alias("platform"))


@query("SELECT row_id, coalesce(trim(company_name) <> '' AND NOT contains(trim(company_name), ' ') AND contains(company_name, '.'), false) AS name_is_url, coalesce(trim(website) <> '' AND NOT contains(trim(website), ' ') AND contains(trim(website), '.'), false) AS website_is_url FROM batch_upload_rows")
def url_shapes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "batch_upload_rows").select("row_id", web.looks_like_url(F.col("company_name")).alias("name_is_url"), web.looks_like_url(F.col("website")).alias("website_is_url"))


@query(f"SELECT p.page_id, coalesce({_DOMAIN.format('p.url')} = {_DOMAIN.format('s.domain')}, false) AS own_site FROM collected_pages p LEFT JOIN suppliers s ON s.id = p.supplier_id")
def website_note(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page was crawled on the domain that is stored for its supplier."""
    s = table(spark, d, "suppliers").select(F.col("id").alias("supplier_id"), "domain")
    return table(spark, d, "collected_pages").select("page_id", "supplier_id", "url").join(s, "supplier_id", "left").select("page_id", web.domains_match(F.col("url"), F.col("domain")).alias("own_site"))


@query("""WITH x AS (SELECT id, domain, trim(replace(replace(split_part(domain, '.', 1), '-', ' '), '_', ' ')) AS t FROM suppliers WHERE domain IS NOT NULL)
SELECT id, CASE WHEN t <> '' THEN array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE domain END AS name FROM x""")
def names_from_domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "suppliers").where("domain IS NOT NULL").select("id", web.name_from_domain(F.col("domain")).alias("name"))


_TERM = "trim(regexp_replace(translate(lower({0}), '-.,/()', '      '), '\\s+', ' ', 'g'))"


@query(f"SELECT DISTINCT {_TERM.format('k')} AS term FROM suppliers, UNNEST(product_keywords) AS u(k) WHERE k IS NOT NULL")
def term_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "suppliers").select(F.explode("product_keywords").alias("k")).where("k IS NOT NULL").select(web.normalise_term(F.col("k")).alias("term")).distinct()


_ALIASES = ", ".join(f"({_text(t)}, {_text(c.key)})" for c in taxonomy.CATEGORIES for t in c.include)


@query(f"""WITH v(surface, category) AS (VALUES {_ALIASES}), a AS (SELECT {_TERM.format('surface')} AS term, min(category) AS category FROM v GROUP BY 1), t AS (SELECT DISTINCT id, {_TERM.format('k')} AS term FROM suppliers, UNNEST(product_keywords) AS u(k) WHERE k IS NOT NULL)
SELECT t.id, t.term, a.category FROM t LEFT JOIN a USING (term)""")
def term_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Product words by exact alias; words without one stay, unmapped."""
    known = spark.createDataFrame([(t, c.key) for c in taxonomy.CATEGORIES for t in c.include], "surface string, category string")
    known = known.groupBy(web.normalise_term(F.col("surface")).alias("term")).agg(F.min("category").alias("category"))
    own = table(spark, d, "suppliers").select("id", F.explode("product_keywords").alias("k")).where("k IS NOT NULL").select("id", web.normalise_term(F.col("k")).alias("term")).distinct()
    return own.join(F.broadcast(known), "term", "left")  # one row per alias of the fixed taxonomy


@query("SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), {_text(p)}) THEN {_text(p)}" for p in web.TRADER_PHRASES) + " END AS phrase FROM documents")
def trader_declarations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", web.trader_phrase(F.col("text")).alias("phrase"))


@query(f"""WITH x AS (SELECT page_id, {_TITLE} AS t FROM collected_pages WHERE text IS NOT NULL)
SELECT page_id, CASE WHEN t = '' THEN '' ELSE array_to_string(list_transform(list_filter(list_concat([t], list_filter(regexp_split_to_array(t, '\\s*[|\\-–—:]\\s*'), lambda p: p <> t)), lambda p: trim(p) <> ''), lambda p: trim(p)), '¦') END AS names FROM x""")
def title_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d).where("text IS NOT NULL").select("page_id", F.array_join(web.title_names(F.col("title")), "¦").alias("names"))


@query("SELECT row_id, trim(regexp_replace(company_name, '(?i)[\\s,]+(ltd|limited|plc|llp)\\.?\\s*$', '')) AS name FROM batch_upload_rows")
def suffix_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "batch_upload_rows").select("row_id", web.strip_company_suffix(F.col("company_name")).alias("name"))


@query("SELECT id, 'https://www.google.com/maps/search/' || replace(url_encode(canonical_name), '%2F', '/') AS map_link FROM suppliers WHERE canonical_name IS NOT NULL")
def search_links(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "suppliers").where("canonical_name IS NOT NULL")
    return s.select("id", F.concat(F.lit("https://www.google.com/maps/search/"), web.quoted(F.col("canonical_name"))).alias("map_link"))


@query("SELECT id, '=\"' || primary_phone || '\"' AS phone FROM suppliers")
def excel_phones(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "suppliers").select("id", web.excel_text(F.col("primary_phone")).alias("phone"))


@query("SELECT page_id, substr(coalesce(nullif(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'page'), 1, 40) AS slug FROM collected_pages WHERE url IS NOT NULL")
def page_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collected_pages").where("url IS NOT NULL").select("page_id", web.slug(F.col("url")).alias("slug"))


@query("SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{r}'" for r, ws in web.ROLES) + " ELSE 'other' END AS role FROM documents")
def title_roles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", web.role_of_title(F.col("text")).alias("role"))


@query("SELECT raw_id, regexp_replace('GET /x?api_key=' || source_id || '&token=' || coalesce(source, ''), '(?i)(api_key|key|token)=[^\\s&]+', '\\1=***', 'g') AS line FROM raw_source_data WHERE source_id IS NOT NULL")
def log_redaction(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("GET /x?api_key="), "source_id", F.lit("&token="), F.coalesce("source", F.lit("")))
    return table(spark, d, "raw_source_data").where("source_id IS NOT NULL").select("raw_id", web.redact(line).alias("line"))


@query(f"""WITH m AS (SELECT page_id, unnest(mailto_emails) AS raw FROM collected_pages), x AS (SELECT DISTINCT page_id, lower(trim(raw)) AS mail FROM m WHERE regexp_full_match(lower(trim(raw)), '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}')),
y AS (SELECT page_id, string_agg(mail, '; ' ORDER BY mail) AS emails FROM x WHERE split_part(mail, '.', -1) NOT IN {_in(contacts.IMAGE_ENDINGS)} AND split_part(mail, '@', 1) NOT IN {_in(contacts.JUNK_LOCAL)} AND split_part(mail, '@', -1) NOT IN {_in(contacts.JUNK_DOMAINS)} GROUP BY 1)
SELECT p.page_id, coalesce(y.emails, '') AS emails FROM collected_pages p LEFT JOIN y USING (page_id)""")
def mailto_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collected_pages").select("page_id", F.array_join(F.array_sort(contacts.mailto_emails(F.col("mailto_emails"))), "; ").alias("emails"))


@query()
def typed_phones(spark: SparkSession, d: str) -> DataFrame:
    """International numbers with their kind; the numbering plan behind local ones is not at hand."""
    return table(spark, d, "collected_pages").select("page_id", F.inline(contacts.typed_phones(F.col("text"))))


@query("SELECT page_id, length(regexp_replace(coalesce(text, ''), '[\\s\\x{00A0}\\x{3000}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{1680}\\x{0085}\\x{2028}\\x{2029}\\x0B]', '', 'g')) < 60 AS too_short FROM collected_pages")
def length_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collected_pages").select("page_id", web.too_short(F.col("text")).alias("too_short"))


_TIER = "CASE WHEN lower(url) LIKE '%contact%' THEN 1 WHEN coalesce(footer_text, '') <> '' THEN 2 WHEN lower(url) LIKE '%impressum%' THEN 3 WHEN lower(url) LIKE '%about%' THEN 4 END"


@query(f"SELECT supplier_id, CAST({_TIER} AS INT) AS tier, min(page_id) AS page_id FROM collected_pages WHERE supplier_id IS NOT NULL AND {_TIER} IS NOT NULL GROUP BY 1, 2")
def address_sources(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each kind that may hold a supplier's address: contact, footer, imprint, about."""
    url = F.lower("url")
    tier = F.when(url.contains("contact"), 1).when(F.coalesce("footer_text", F.lit("")) != "", 2).when(url.contains("impressum"), 3).when(url.contains("about"), 4)
    return table(spark, d, "collected_pages").where("supplier_id IS NOT NULL").select("supplier_id", tier.alias("tier"), "page_id").where("tier IS NOT NULL").groupBy("supplier_id", "tier").agg(F.min("page_id").alias("page_id"))


@query("SELECT doc_id, coalesce(regexp_matches(lower(text), '\\bforging\\b|\\bpress shop\\b|\\bgalvan'), false) AS marked FROM documents")
def marker_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", web.has_marker(F.col("text"), ("forging", "press shop"), ("galvan",)).alias("marked"))


@query("SELECT listing_id, coalesce(regexp_full_match(trim(booth_number), '[eE]\\s?\\d{1,3}([\\s\\-\\*]?\\d{1,3}([Rr][\\s\\-\\*]?\\d{1,6})?[\\s\\-\\*]?\\d{0,8})?'), false) AS e_mark FROM directory_listings")
def e_mark_shape(spark: SparkSession, d: str) -> DataFrame:
    """The shape test on the column of the tables that holds such codes."""
    return table(spark, d, "directory_listings").select("listing_id", web.e_mark(F.col("booth_number")).alias("e_mark"))


@query(f"""SELECT id, CASE WHEN NOT coalesce(iso_9001, false) THEN 'not_certified' WHEN iso_9001_expiry IS NULL THEN 'unknown' WHEN iso_9001_expiry < DATE '{AS_OF}' THEN 'expired' WHEN iso_9001_expiry <= DATE '{AS_OF}' + 90 THEN 'expiring_soon' ELSE 'valid' END AS status,
CAST(iso_9001_expiry + INTERVAL 36 MONTH AS DATE) AS renewed_until FROM suppliers""")
def certificate_states(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "suppliers").select("id", web.certificate_status(F.col("iso_9001"), F.col("iso_9001_expiry"), AS_OF).alias("status"), web.three_years_on(F.col("iso_9001_expiry")).alias("renewed_until"))
