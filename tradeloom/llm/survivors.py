"""Best representative of each duplicate group.

Records are ranked by completeness, trust and recency with window ordering and a deterministic
tie-break.  Ranking runs in two steps: first inside small slices of each group, where only the
leaders survive, then among the leaders of all slices, so no group is ever gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions.payload import payload
from tradeloom.functions.values import PLACEHOLDERS

#: Slices of a group in the first step.
SLICES = 32

#: Where each fact stands in the payloads; the first place with something to say counts.
FACTS: dict[str, tuple[str, ...]] = {
    "name": ("companyName", "company_name", "name", "exhibitor", "shipper_name", "supplier.name", "@item.name"),
    "website": ("companyUrl", "website", "homepage", "supplier.profileUrl", "@item.url"),
    "country": ("country", "shipper_country", "supplier.country", "@item.address.addressCountry"),
    "city": ("city", "shipper_city", "supplier.city", "@item.address.addressLocality"),
    "phone": ("phone", "tel", "contact.phone", "supplier.profile.phone", "@item.telephone"),
    "email": ("email", "contact.email", "supplier.profile.email", "@item.email"),
    "products": ("products", "mainProducts", "product_desc", "supplier.mainProducts", "@item.makesOffer"),
}

_WORDS = ", ".join("'" + w.replace("'", "\\'") + "'" for w in PLACEHOLDERS)


def _text(path: str, variant: str) -> str:
    root = '["@graph"][0]["itemListElement"][0]["item"]' if path.startswith("@item") else ""
    keys = path.split(".")[1:] if root else path.split(".")
    return f"try_variant_get({variant}, '${root}" + "".join(f'["{k}"]' for k in keys) + "', 'string')"


def facts(variant: str = "_v") -> dict[str, Column]:
    """Text of each fact, or null: blanks, empty lists and placeholder words say nothing.

    A list says something if one of its strings, or of its objects' names, does.
    """
    out = {}
    for fact, paths in FACTS.items():
        texts = []
        for p in paths:
            t = _text(p, variant)
            if fact == "products":
                # lists come as JSON text: their words, keys and punctuation aside
                words = f"regexp_extract_all(regexp_replace({t}, '\"(@?[A-Za-z_]+)\":(\"Offer\",?)?', ''), '\"((?:[^\"\\\\\\\\]|\\\\\\\\.)*)\"', 1)"
                t = f"CASE WHEN {t} LIKE '[%' THEN (CASE WHEN exists({words}, w -> lower(trim(w)) NOT IN ({_WORDS})) THEN {t} END) ELSE {t} END"
            texts.append(F.expr(f"CASE WHEN lower(trim({t})) NOT IN ({_WORDS}, '[]', '{{}}') THEN {t} END"))
        out[fact] = F.coalesce(*texts)
    return out


def with_facts(raw_rows: DataFrame, trust: DataFrame) -> DataFrame:
    """(golden_record_id, raw_id, scraped_at, trust, completeness, one column per fact) of every row with a golden_record_id.

    Sources without a trust get the lowest.  Unparsable payloads have no facts.  ``trust`` has one
    row per source; Spark decides by its size whether to broadcast it.
    """
    rows = raw_rows.where("golden_record_id IS NOT NULL").select("golden_record_id", "raw_id", "scraped_at", "source", payload("raw_json").alias("_v"))
    named = facts()
    rows = rows.select("golden_record_id", "raw_id", "scraped_at", "source", *[c.alias(n) for n, c in named.items()])
    scored = rows.withColumn("completeness", sum((F.col(n).isNotNull().cast("int") for n in named), F.lit(0)))
    rank = trust.groupBy("source").agg(F.max("trust").alias("trust"))
    return scored.join(rank, "source", "left").withColumn("trust", F.coalesce("trust", F.lit(-(2**31))))


def best_by(rows: DataFrame, group: str, orders: dict[str, list[Column]], key: str) -> DataFrame:
    """The leaders of each group: rows with ``<name>_rank`` = 1 under at least one of the ``orders``.

    Adds ``<name>_rank`` for each order and ``members``, the number of rows of the group.  Rows
    whose group is null are left out.  ``key`` breaks ties, larger first, so the result does
    not depend on how rows are spread.
    """
    rows = rows.where(F.col(group).isNotNull()).withColumn("_slice", F.pmod(F.xxhash64(F.col(key)), F.lit(SLICES)))
    near, far = [group, "_slice"], [group]
    names = list(orders)

    def ranked(df: DataFrame, by: list[str]) -> DataFrame:
        return df.withColumns({f"{n}_rank": F.row_number().over(Window.partitionBy(*by).orderBy(*orders[n], F.col(key).desc())) for n in names})

    leads = F.greatest(*[(F.col(f"{n}_rank") == 1).cast("int") for n in names], F.lit(0)) == 1
    part = ranked(rows, near).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*near))).where(leads)
    # every leader of a slice carries the slice's count; only the slice's first adds it
    part = part.withColumn("_n", F.when(F.col(f"{names[0]}_rank") == 1, F.col("_n")).otherwise(0)).drop(*[f"{n}_rank" for n in names])
    return ranked(part, far).withColumn("members", F.sum("_n").over(Window.partitionBy(*far))).where(leads).drop("_slice", "_n")


def _orders() -> dict[str, list[Column]]:
    full, trusted, recent = F.col("completeness").desc(), F.col("trust").desc(), F.col("scraped_at").desc_nulls_last()
    return {"survivor": [full, trusted, recent], "trusted": [trusted, full, recent], "recent": [recent, full, trusted]}


def survivors(rows: DataFrame) -> DataFrame:
    """One surviving record per golden_record_id, with all its facts: most complete, then most trusted, then latest.

    ``agreed`` tells whether the row also leads by trust and by recency; ``members`` counts the
    group.  Ties end with the larger raw_id; repeated rows count as members.  Groups of one
    survive as they are; null groups give no row.
    """
    led = best_by(rows, "golden_record_id", _orders(), "raw_id")
    return led.where("survivor_rank = 1").withColumn("agreed", (F.col("trusted_rank") == 1) & (F.col("recent_rank") == 1)).drop("survivor_rank", "trusted_rank", "recent_rank")


def fieldwise(rows: DataFrame) -> DataFrame:
    """One built record per golden_record_id: each fact from the most trusted, then latest row that gives it.

    Facts are chosen by aggregation, so partial winners are taken before the shuffle.
    """
    rank = F.struct("trust", "scraped_at", "raw_id")
    return rows.groupBy("golden_record_id").agg(*[F.max(F.when(F.col(n).isNotNull(), F.struct(rank.alias("r"), F.col(n).alias("v"))))["v"].alias(n) for n in FACTS], F.count(F.lit(1)).alias("members"))
