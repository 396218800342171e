"""Parts of a postal address in any order, notation and separator."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

#: Words for kinds of streets and the kind they stand for.
AFTER = {  # behind the name
    "road": ("road", "rd", "lu"), "street": ("street", "st", "jie"), "avenue": ("avenue", "ave", "av", "dadao"), "lane": ("lane", "ln"), "way": ("way", "wy"), "drive": ("drive", "dr"), "close": ("close",), "nagar": ("nagar", "ngr"),
    "area": ("trading estate", "trading est", "industrial area", "indl area", "ind area", "industrial estate", "indl estate", "ind estate", "ind est", "indl est", "industrial est"), "cadde": ("caddesi", "cadde", "cad", "cd"), "sokak": ("sokagi", "sokak", "sok", "sk"), "bulvar": ("bulvari", "bulvar", "bulv", "blv", "bul"),
}
BEFORE = {"via": ("via", "v"), "viale": ("viale", "v.le", "vle"), "piazza": ("piazza", "pza"), "corso": ("corso", "cso"), "ulica": ("ulica", "ul"), "aleja": ("aleja", "aleje", "al"), "pho": ("pho", "p"), "duong": ("duong", "d"), "rue": ("rue",), "calle": ("calle", "c/")}
JOINED = {"strasse": ("strasse", "strase", "str"), "weg": ("weg", "wg"), "allee": ("allee", "all"), "platz": ("platz", "pl"), "gasse": ("gasse",), "ring": ("ring",), "damm": ("damm",)}
#: Other names of cities.
EXONYMS = {
    "amoy": "xiamen", "tsingtao": "qingdao", "canton": "guangzhou", "peking": "beijing", "nanking": "nanjing", "swatow": "shantou", "munich": "munchen", "cologne": "koln", "nuremberg": "nurnberg", "hanover": "hannover", "brunswick": "braunschweig", "poona": "pune", "kovai": "coimbatore", "bombay": "mumbai", "madras": "chennai", "calcutta": "kolkata", "bangalore": "bengaluru", "ludhyana": "ludhiana", "cawnpore": "kanpur", "baroda": "vadodara",
    "smyrna": "izmir", "izmit": "kocaeli", "constantinople": "istanbul", "angora": "ankara", "brusa": "bursa", "padua": "padova", "milan": "milano", "turin": "torino", "florence": "firenze", "venice": "venezia", "naples": "napoli", "genoa": "genova", "rome": "roma", "posen": "poznan", "lodsch": "lodz", "breslau": "wroclaw", "cracow": "krakow", "warsaw": "warszawa", "danzig": "gdansk", "saigon": "hochiminhcity",
}
#: Names and codes of countries.
COUNTRIES = "china|pr china|p r china|india|germany|deutschland|italy|italia|poland|polska|turkey|turkiye|united kingdom|great britain|england|vietnam|viet nam|france|spain|czechia|romania|hungary|netherlands|austria|usa"
CODES = "cn|in|de|it|pl|tr|uk|gb|vn|fr|es|cz|ro|hu|nl|at|us"

_AFTER = {w: k for k, ws in AFTER.items() for w in ws}
_BEFORE = {w: k for k, ws in BEFORE.items() for w in ws}
_JOINED = {w: k for k, ws in JOINED.items() for w in ws}


def _words(table: dict[str, str]) -> str:
    return "|".join(re.escape(w) for w in sorted(table, key=len, reverse=True))


_SEP = re.compile(r"\s*[,;/\n\r|]\s*|\s+[-–]\s+|\s*\.\s*,\s*")
_UK = re.compile(r"\b([a-z]{1,2}\d[a-z\d]?) ?(\d[a-z]{2})\b")
_POST = re.compile(r"(?<![\d#:.-])(\d{2}-\d{3}|\d{6}|\d{5})(?![\d-])")
_UNIT = re.compile(r"\b(?:unit|room|rm|flat|suite|ste|bldg|building|block|apt|u|hall)\.? ?(\d+[a-z]?)\b")
_NUMBER = re.compile(r"(?:\b(?:no|nr|n|num|number|hausnr)\b ?[.:]? ?|\b(?:no|nr|n)[.:] ?|# ?)(\d+[a-z]?)\b")
_DIGITS = re.compile(r"(?<![\w.])(\d{1,5}[a-z]?)(?![\w])")
_DISTRICT = re.compile(r"\b[a-z]+ (?:district|dist\b\.?|qu\b|phase [ivx]+\b|mahallesi|mah\b\.?|ward\b)")
_COUNTRY = re.compile(rf"\b(?:{COUNTRIES})\b")
_CODE = re.compile(rf"^(?:{CODES})$")
_S_AFTER = re.compile(rf"\b([a-z][a-z']+)[ .-]+({_words(_AFTER)})\b\.?")
_S_BEFORE = re.compile(rf"(?:^|(?<=[ ,]))({_words(_BEFORE)})(?:\.\s*|\s+)([a-z][a-z']+)")
_S_JOINED = re.compile(rf"\b([a-z]{{3,}}?)[- ]?({_words(_JOINED)})(?:\b\.?|(?=\d))")


class Parts(NamedTuple):
    number: str
    street: str
    kind: str
    city: str
    postcode: str
    unit: str = ""


def fold(text: str) -> str:
    """Lower case without accents; letters that do not decompose are replaced."""
    t = unicodedata.normalize("NFKD", text.casefold().replace("ß", "ss"))
    return "".join(c for c in t if not unicodedata.combining(c)).translate(str.maketrans({"ł": "l", "đ": "d", "ı": "i", "ø": "o", "’": "'"}))


def city_key(text: str) -> str:
    """One key for the writings of a city's name: no spaces, no additions, exonyms replaced."""
    t = re.sub(r"\(.*?\)", " ", fold(text)).split(",")[0]
    t = re.sub(r"\b(?:city|merkez|municipality|mitte|shi)\b|[^a-z一-鿿]+", "", re.sub(r"[-–]", " ", t))
    t = EXONYMS.get(t, t)
    return re.sub(r"(?<=[aou])e(?=[^aeiou])", "", t) if re.search(r"koeln|muenchen|nuernberg|duesseldorf|goettingen|saarbruecken", t) else t


def parse(text: str, cities: set[str]) -> Parts:
    """The parts that tell locations apart; '' where one is missing.

    ``cities`` are the known city keys.  Districts, provinces and countries are read over; the
    unit stands apart, for those who want it checked.
    """
    t = re.sub(r"\(.*?\)", " ", fold(text))
    t = _SEP.sub(" , ", re.sub(r"p\. ?r\. ?china", "china", t))
    post = ""
    if m := _UK.search(t):
        post = m[1] + m[2]
        t = t[: m.start()] + " , " + t[m.end() :]
    unit = (_UNIT.search(t) or ("", ""))[1]
    t = _UNIT.sub(" , ", t)
    number = ""
    if m := _NUMBER.search(t):
        number = m[1]
        t = t[: m.start()] + " ¤ " + t[m.end() :]
    if not post and (m := _POST.search(t)):
        post = m[1]
        t = t[: m.start()] + " , " + t[m.end() :]
    if not number and (m := _DIGITS.search(t)):
        number = m[1]
        t = t[: m.start()] + " ¤ " + t[m.end() :]
    t = _COUNTRY.sub(" , ", t)
    chunks = [re.sub(r"[^a-z.'/ ¤一-鿿-]+", " ", c).strip() for c in t.split(",")]
    chunks = [c for c in chunks if c and not _CODE.match(c.strip(". "))]
    city, rest = "", []
    for c in chunks:
        key = city_key(c)
        if key in cities:
            city = city or key
            continue
        rest.append(c)
    if not city:  # written between other words, as one or two of them
        for i, c in enumerate(rest):
            w = [x for x in c.split(" ") if x]
            for n in (2, 1):
                for k in range(len(w) - n, -1, -1):
                    if not city and city_key("".join(w[k : k + n])) in cities and len("".join(w[k : k + n])) > 2:
                        city = city_key("".join(w[k : k + n]))
                        rest[i] = " ".join([*w[:k], ",", *w[k + n :]])
    body = _DISTRICT.sub(" , ", " , ".join(rest).replace("¤", " "))
    body = re.sub(r"\s+", " ", re.sub(r"\b(ind|indl|industrial)\. ?(?=area|est)", r"\1 ", body)).strip(" ,")
    street = kind = ""
    if m := _S_AFTER.search(body):
        street, kind = m[1], _AFTER[m[2]]
    elif m := _S_BEFORE.search(body):
        street, kind = m[2], _BEFORE[m[1]]
    elif m := _S_JOINED.search(body):
        street, kind = m[1], _JOINED[m[2]]
    else:
        street = next((c.strip() for c in body.split(",") if c.strip()), "")
    return Parts(number.lstrip("0"), re.sub(r"[^a-z一-鿿]", "", street), kind, city, post, unit.lstrip("0"))


def slips(a: str, b: str) -> int:
    """Edit distance with swaps of neighbouring letters as one edit (optimal string alignment)."""
    if a == b:
        return 0
    same = 0
    shorter = min(len(a), len(b))
    while same < shorter and a[same] == b[same]:
        same += 1
    a, b = a[same:], b[same:]
    same, shorter = 0, shorter - same
    while same < shorter and a[-1 - same] == b[-1 - same]:
        same += 1
    if same:
        a, b = a[:-same], b[:-same]
    if not a or not b:
        return len(a) + len(b)
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]
