"""Web addresses, titles and labels as Column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradeloom.functions.text import extract_domain

#: Marketplaces under whose names many companies live.
PLATFORMS = ("alibaba.com", "indiamart.com", "hktdc.com", "made-in-china.com", "globalsources.com", "goldsupplier.com", "tradeindia.com")
#: What traders say of themselves, in the order they are tried.
TRADER_PHRASES = ("we are a trading company", "we are a professional trading company", "we are a distributor", "we are a reseller", "we are an import and export company", "we are a sourcing agent", "we are a buying agent", "trading company specializing in", "we do not manufacture", "we don't manufacture")
#: Roles by the words of a job title, in the order they are tried.
ROLES = (("ceo", ("ceo", "chief executive", "president", "managing director", "founder", "owner")), ("procurement", ("procurement", "purchasing", "sourcing", "buyer")), ("sales", ("sales", "business development", "account manager", "export manager")))
#: Letters of a slug at most, and letters of a page below which its text proves nothing.
SLUG, LEAST_TEXT = 40, 60
_E_MARK = r"^[eE]\s?\d{1,3}([\s\-\*]?\d{1,3}([Rr][\s\-\*]?\d{1,6})?[\s\-\*]?\d{0,8})?$"


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return functools.reduce(Column.__or__, [text.contains(w) for w in words])


def is_platform(domain: Column) -> Column:
    """Whether a domain is a marketplace's or below one; null gives False."""
    d = F.lower(domain)
    return F.coalesce(functools.reduce(Column.__or__, [(d == p) | d.endswith("." + p) for p in PLATFORMS]), F.lit(False))


def looks_like_url(text: Column) -> Column:
    """Whether a text has a point and no blank inside; null gives False."""
    t = F.trim(text)
    return F.coalesce((t != "") & ~t.contains(" ") & t.contains("."), F.lit(False))


def domains_match(a: Column, b: Column) -> Column:
    """Whether two web addresses have one domain; missing ones never match."""
    return F.coalesce(extract_domain(a) == extract_domain(b), F.lit(False))


def name_from_domain(domain: Column) -> Column:
    """A readable stand-in for a name: the domain's first label, capitalised; the domain itself if nothing is left."""
    t = F.trim(F.translate(F.substring_index(domain, ".", 1), "-_", "  "))
    return F.when(t != "", F.initcap(t)).otherwise(domain)


def normalise_term(text: Column) -> Column:
    """Lower case with ``- . , / ( )`` as blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "-.,/()", "      "), r"\s+", " "))


def trader_phrase(text: Column) -> Column:
    """The first phrase by which a page calls itself a trader, or null."""
    t = F.lower(text)
    return F.coalesce(*[F.when(t.contains(p), F.lit(p)) for p in TRADER_PHRASES])


def title_names(title: Column) -> Column:
    """The whole title, then its parts between bars, dashes and colons, repeats dropped; none for null or blank."""
    t = F.trim(title)
    parts = F.filter(F.transform(F.split(t, r"\s*[|\-–—:]\s*"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(t != "", F.array_distinct(F.concat(F.array(t), parts))).otherwise(F.array().cast("array<string>"))


def strip_company_suffix(name: Column) -> Column:
    """A name without a last ltd, limited, plc or llp."""
    return F.trim(F.regexp_replace(name, r"(?i)[\s,]+(ltd|limited|plc|llp)\.?\s*$", ""))


def quoted(text: Column) -> Column:
    """Percent-encoded but for letters, digits, ``_.-~`` and slashes."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def excel_text(value: Column) -> Column:
    """A number that spreadsheets keep as text."""
    return F.concat(F.lit('="'), value, F.lit('"'))


def slug(text: Column) -> Column:
    """Lower-case letters and digits with single dashes between, cut to SLUG; ``page`` if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(F.when(t != "", t).otherwise("page"), 1, SLUG)


def role_of_title(title: Column) -> Column:
    """ceo, procurement, sales or other, by the first role whose words a title has."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return functools.reduce(lambda c, r: c.when(_contains_any(t, r[1]), F.lit(r[0])), ROLES, F.when(F.lit(False), F.lit(""))).otherwise("other")


def redact(text: Column) -> Column:
    """A log line without the values of keys and tokens."""
    return F.regexp_replace(text, r"(?i)(api_key|key|token)=[^\s&]+", "$1=***")


def too_short(text: Column) -> Column:
    """Whether a page has too few letters to prove anything; null counts as none."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", "")) < LEAST_TEXT


def has_marker(text: Column, words: tuple[str, ...], beginnings: tuple[str, ...] = ()) -> Column:
    """Whether a text has one of the words as a word of its own, or a word with one of the beginnings."""
    terms = [rf"\b{w}\b" for w in words] + [rf"\b{w}" for w in beginnings]
    return F.coalesce(F.lower(text).rlike("|".join(terms)), F.lit(False))


def e_mark(number: Column) -> Column:
    """Whether a number has the shape of an E-mark; null gives False."""
    return F.coalesce(F.trim(number).rlike(_E_MARK), F.lit(False))


def certificate_status(certified: Column, expiry: Column, today: str, ahead: int = 90) -> Column:
    """not_certified, unknown, expired, expiring_soon or valid."""
    day = F.lit(today).cast("date")
    return F.when(~F.coalesce(certified, F.lit(False)), "not_certified").when(expiry.isNull(), "unknown").when(expiry < day, "expired").when(expiry <= F.date_add(day, ahead), "expiring_soon").otherwise("valid")


def three_years_on(day: Column) -> Column:
    """The usual end of a certificate: three years on, 28 February for a 29th."""
    return F.add_months(day, 36)
