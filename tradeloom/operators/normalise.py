"""Raw records of the sources as supplier records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.text import extract_domain, parse_date, parse_number

#: Names of countries by market.
UK = ("united kingdom", "uk", "gb", "great britain", "england", "wales", "scotland", "northern ireland")
US = ("united states", "usa", "us", "united states of america")
EU = (
    "germany", "france", "italy", "spain", "netherlands", "belgium", "poland", "sweden", "austria", "ireland", "denmark", "finland", "portugal", "greece",
    "czech republic", "romania", "hungary", "bulgaria", "slovakia", "croatia", "lithuania", "slovenia", "latvia", "estonia", "cyprus", "luxembourg", "malta",
)
#: Country of the buyers where a source says none.
DEFAULT_BUYERS = {"importyeti": "United States"}
#: Words that claim a market.
MARKET_WORDS = {"uk": ("united kingdom", "uk", "britain", "england"), "eu": ("europe", "eu ", "european union"), "us": ("north america", "united states", "usa", "u.s.")}


def clean(c: Column) -> Column:
    """Trimmed text; '' for null."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def filled(c: Column) -> Column:
    """Trimmed text; null for null and blank."""
    return F.nullif(clean(c), F.lit(""))


def to_bool(c: Column) -> Column:
    """True for true, yes, 1 and y in any case; False for all else and null."""
    return F.lower(clean(c)).isin("true", "yes", "1", "y")


def to_int(c: Column, default: int = 0) -> Column:
    """The whole part of a number; ``default`` if it is none."""
    return F.coalesce(clean(c).try_cast("double").cast("bigint"), F.lit(default).cast("bigint"))


def to_float(c: Column, default: float | None = None) -> Column:
    return F.coalesce(clean(c).try_cast("double"), F.lit(default).cast("double"))


def first_present(*columns: Column) -> Column:
    """The first value that is neither null nor '' nor an empty list."""
    return F.coalesce(*[F.when(~c.isin("", "[]"), c) for c in columns])


def export_flags(markets: Column) -> dict[str, Column]:
    """exports_to_uk, _eu and _us as an array of claimed markets suggests them; null where it does not."""
    text = F.lower(F.array_join(markets, " "))
    found = {m: F.greatest(*[text.contains(w).cast("int") for w in ws]) == 1 for m, ws in MARKET_WORDS.items()}
    return {f"exports_to_{m}": F.when(c, True) for m, c in found.items()}


def listing_suppliers(rows: DataFrame) -> DataFrame:
    """(listing_id, canonical_name, domain, country, product_keywords, notes) of fair and directory records.

    ``products`` is one text, parted at commas.  Fairs note exhibition and booth, directories
    their own name; what is missing is null, a missing name is ''.
    """
    products = F.filter(F.transform(F.split(F.coalesce("products", F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    fair = F.concat_ws("; ", F.concat(F.lit("Exhibitor at "), filled(F.col("exhibition_name"))), F.concat(F.lit("booth "), filled(F.col("booth_number"))))
    listed = F.concat(F.lit("Listed in "), filled(F.col("directory_name")))
    notes = F.when(filled(F.col("directory_name")).isNotNull(), listed).otherwise(F.nullif(fair, F.lit("")))
    return rows.select("listing_id", clean(F.col("company_name")).alias("canonical_name"), extract_domain(F.col("website")).alias("domain"), filled(F.col("country")).alias("country"), F.when(F.size(products) > 0, products).alias("product_keywords"), notes.alias("notes"))


def buyers_country(source: Column, country: Column) -> Column:
    usual = F.coalesce(*[F.when(source == s, F.lit(c)) for s, c in DEFAULT_BUYERS.items()], F.lit(""))
    return F.when(clean(country) != "", clean(country)).otherwise(usual)


def shipper_suppliers(rows: DataFrame) -> DataFrame:
    """One supplier view per shipment record: the shipper, its buyer, and the markets that the shipment proves."""
    land = F.lower(buyers_country(F.col("source"), F.col("consignee_country")))
    proofs = [F.when(land.isin(*names), 1).alias(f"confirmed_shipments_{m}") for m, names in (("uk", UK), ("us", US), ("eu", EU))]
    return rows.select("id", clean(F.col("shipper_name")).alias("canonical_name"), filled(F.col("consignee_name")).alias("known_buyer"), *proofs, parse_date(F.col("shipment_date").cast("string")).alias("last_shipment_date"))


def shipment_facts(rows: DataFrame) -> DataFrame:
    """Shipment records with trimmed texts, parsed dates and numbers, and the buyers' usual country filled in."""
    texts = [filled(F.col(c)).alias(c) for c in ("shipper_name", "consignee_name", "hs_code", "product_desc", "quantity", "origin_port", "destination_port")]
    number = lambda c: parse_number(F.col(c).cast("string")).alias(c)
    return rows.select("id", "supplier_id", "source", *texts, F.nullif(buyers_country(F.col("source"), F.col("consignee_country")), F.lit("")).alias("consignee_country"), parse_date(F.col("shipment_date").cast("string")).alias("shipment_date"), number("weight_kg"), number("value_usd"))
