"""What a page's HTML says: text, footer, links, pictures, forms and contacts, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

#: Pictures kept per page, and words in a picture's address that make it furniture.
IMAGES, NO_IMAGE = 5, ("logo", "icon", "sprite", "favicon", "banner", "avatar")
#: Hosts of company profiles, and endings of files for download.
SOCIAL = ("linkedin.com", "facebook.com", "instagram.com", "youtube.com", "twitter.com", "x.com")
DOWNLOADS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip")
_SKIPPED = {"script", "style", "noscript", "template", "svg"}
_BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "table", "ul", "ol"}
_TEXTS = ("title", "text", "footer_text")
_LISTS = ("links", "image_urls", "mailto_emails", "tel_phones", "social_links", "downloads")
PAGE = StructType([*[StructField(n, StringType()) for n in _TEXTS], *[StructField(n, ArrayType(StringType())) for n in _LISTS], StructField("has_contact_form", BooleanType())])


class _Page(HTMLParser):
    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.host = base, urlsplit(base).netloc.removeprefix("www.")
        self.text, self.footer, self.title = [], [], []
        self.found: dict[str, dict[str, None]] = {n: {} for n in _LISTS}
        self.skip = self.depth = 0
        self.in_title = self.in_form = self.form = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in _SKIPPED:
            self.skip += 1
        elif tag == "footer":
            self.depth += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "form":
            self.in_form = True
        elif self.in_form and (tag == "textarea" or a.get("type", "").lower() == "email"):
            self.form = True
        if tag == "a" and a.get("href"):
            self._link(a["href"].strip())
        elif tag == "img" and a.get("src") and not any(w in a["src"].lower() for w in NO_IMAGE) and len(self.found["image_urls"]) < IMAGES:
            self.found["image_urls"][urljoin(self.base, a["src"])] = None
        if tag in _BLOCKS:
            self._add("\n")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in _SKIPPED or tag == "footer":
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "footer":
            self.depth = max(0, self.depth - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "form":
            self.in_form = False
        if tag in _BLOCKS:
            self._add("\n")

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.in_title:
            self.title.append(data)
        else:
            self._add(data)

    def _add(self, data: str) -> None:
        self.text.append(data)
        if self.depth:
            self.footer.append(data)

    def _link(self, href: str) -> None:
        scheme, _, rest = href.partition(":")
        if scheme.lower() == "mailto":
            self.found["mailto_emails"][unquote(rest.split("?")[0]).strip()] = None
        elif scheme.lower() == "tel":
            self.found["tel_phones"][re.sub(r"[^\d+]", "", unquote(rest))] = None
        elif scheme.lower() not in ("javascript", "data") and not href.startswith("#"):
            try:
                url = urljoin(self.base, href)
                host = urlsplit(url).netloc.lower().removeprefix("www.")
            except ValueError:
                return
            if any(host == s or host.endswith("." + s) for s in SOCIAL):
                self.found["social_links"][url] = None
            elif urlsplit(url).path.lower().endswith(DOWNLOADS):
                self.found["downloads"][url] = None
            elif host == self.host.lower():
                self.found["links"][url] = None


def _tidy(parts: list[str]) -> str:
    lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line)


def read_page(html: str | None, base: str | None) -> dict:
    """The fields of PAGE from one page; empty ones for null or broken HTML, never an error."""
    page = _Page(base or "")
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError):
        pass
    return {"title": _tidy(page.title), "text": _tidy(page.text), "footer_text": _tidy(page.footer), **{n: list(v) for n, v in page.found.items()}, "has_contact_form": page.form}


@F.pandas_udf(PAGE)
def page_fields(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    """A page's HTML as text, footer, links of its own host, pictures, contacts, profiles, downloads and whether it has a contact form."""
    return pd.DataFrame([read_page(h, b) for h, b in zip(html, base)], columns=PAGE.names)


def url_candidates(url: Column) -> Column:
    """Addresses to try in turn: as given, then https://www., https:// and http:// of its host; none for null or blank."""
    given = F.trim(url)
    bare = F.regexp_replace(F.regexp_replace(given, r"(?i)^https?://", ""), r"(?i)^www\.", "")
    tries = F.array(F.when(given.rlike("(?i)^https?://"), given), F.concat(F.lit("https://www."), bare), F.concat(F.lit("https://"), bare), F.concat(F.lit("http://"), bare))
    return F.when(F.coalesce(given, F.lit("")) != "", F.array_distinct(F.array_compact(tries))).otherwise(F.array().cast("array<string>"))
