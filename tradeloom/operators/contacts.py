"""E-mails, phones and page gates from text, as Column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
#: Endings of file names that look like addresses; local parts and domains of no use.
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "bmp", "avif")
JUNK_LOCAL = ("noreply", "no-reply", "donotreply", "do-not-reply", "postmaster", "webmaster")
JUNK_DOMAINS = ("example.com", "example.org", "example.net", "yourdomain.com", "domain.com", "email.com", "test.com", "sentry.io", "wixpress.com", "godaddy.com", "yourcompany.com")
#: Texts of parked and default pages, in the order they are tried.
PARKED = (
    "the nginx web server is successfully installed", "apache2 ubuntu default page", "apache2 debian default page", "this is the default welcome page",
    "the web server software is running but no content has been added", "this domain is parked", "domain is parked", "buy this domain", "this domain is for sale",
    "godaddy.com", "namecheap parking", "further configuration is required",
)
#: Words left of a number that tell its use, in the order they are tried.
PHONE_LABELS = (("fax", ("fax", "传真")), ("whatsapp", ("whatsapp",)), ("wechat", ("wechat", "weixin", "微信")))
#: Letters left of a number in which a label may stand.
LABEL_WINDOW = 40
#: An international number; numbers without a country code need a numbering plan and are not read.
PHONE = r"\+\d[\d\s()./-]{6,20}\d"


def useful(address: Column) -> Column:
    """Whether a lower-case address is no image name, automatic sender or example."""
    return ~F.substring_index(address, ".", -1).isin(*IMAGE_ENDINGS) & ~F.substring_index(address, "@", 1).isin(*JUNK_LOCAL) & ~F.substring_index(address, "@", -1).isin(*JUNK_DOMAINS)


def emails(text: Column) -> Column:
    """Distinct useful lower-case addresses: those written plainly, then those behind ``[at]`` and ``(dot)``; null text gives none."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?i)\s*(?:\[\s*at\s*\]|\(\s*at\s*\))\s*", "@"), r"(?i)\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\))\s*", ".")
    found = F.concat(*[F.regexp_extract_all(t, F.lit(f"({EMAIL})"), F.lit(1)) for t in (text, plain)])
    ok = F.filter(F.transform(found, lambda x: F.lower(F.rtrim(x, F.lit(".")))), useful)
    return F.array_distinct(F.coalesce(ok, F.array().cast("array<string>")))


def mailto_emails(hrefs: Column) -> Column:
    """Distinct useful addresses of an array of mailto targets that are addresses as a whole."""
    whole = F.filter(F.transform(hrefs, lambda x: F.lower(F.trim(x))), lambda x: x.rlike(f"^{EMAIL}$") & useful(x))
    return F.array_distinct(F.coalesce(whole, F.array().cast("array<string>")))


def parked(text: Column) -> Column:
    """The first parking signature of a text, or null."""
    t = F.lower(text)
    return F.coalesce(*[F.when(t.contains(s), F.lit(s)) for s in PARKED])


def typed_phones(text: Column) -> Column:
    """Array of (number, kind) of the international numbers of a text, first seen first, repeats dropped.

    ``number`` is + and digits; ``kind`` is fax, whatsapp or wechat after a label among the
    LABEL_WINDOW letters before it, else ``other``.  Null text gives an empty array.
    """
    before = F.regexp_extract_all(text, F.lit(rf"(?s)(.{{0,{LABEL_WINDOW}}}?)(?<![\d+]){PHONE}"), F.lit(1))
    number = F.regexp_extract_all(text, F.lit(rf"(?s).{{0,{LABEL_WINDOW}}}?(?<![\d+])({PHONE})"), F.lit(1))
    kind = lambda left: functools.reduce(lambda c, k: c.when(functools.reduce(Column.__or__, [F.lower(left).contains(w) for w in k[1]]), F.lit(k[0])), PHONE_LABELS, F.when(F.lit(False), F.lit(""))).otherwise("other")
    rows = F.zip_with(before, number, lambda left, n: F.struct(F.concat(F.lit("+"), F.regexp_replace(n, r"\D", "")).alias("number"), kind(left).alias("kind")))
    return F.array_distinct(F.coalesce(F.filter(rows, lambda r: F.length(r["number"]).between(8, 16)), F.array().cast("array<struct<number:string,kind:string>>")))
