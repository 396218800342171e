"""Names, web addresses, codes, dates and numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal and trading endings, removed once each in this order.
NAME_ENDINGS = (r"\bco\.?,?\s*ltd\.?$", r"\bltd\.?$", r"\bllc\.?$", r"\binc\.?$", r"\bcorp(oration)?\.?$", r"\bcompany$", r"\btrading$", r"\bmanufacturing$", r"\bmanufacturer$", r"\bfactory$", r"\bgroup$", r"\binternational$", r"\bimp\s*(and|&)?\s*exp$", r"\bimport\s*(and|&)?\s*export$", r"\bco$")
#: Chinese places that tell nothing about which company it is.
PLACES = ("guangzhou", "shenzhen", "dongguan", "foshan", "zhongshan", "huizhou", "shanghai", "beijing", "tianjin", "chongqing", "ningbo", "hangzhou", "wenzhou", "yiwu", "jinhua", "taizhou", "suzhou", "wuxi", "nanjing", "changzhou", "xuzhou", "qingdao", "jinan", "yantai", "weifang", "xiamen", "fuzhou", "quanzhou", "wuhan", "changsha", "zhengzhou", "chengdu", "xian", "shenyang", "dalian", "harbin", "kunming", "nanning", "hefei", "nanchang", "guangdong", "zhejiang", "jiangsu", "shandong", "fujian", "sichuan", "hebei", "henan", "hubei", "hunan", "anhui", "jiangxi", "liaoning")
#: Alphabet and position weights of the unified social credit code.
CODE_ALPHABET, CODE_WEIGHTS = "0123456789ABCDEFGHJKLMNPQRTUWXY", (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)
#: Date patterns in the order they are tried.
DATE_PATTERNS = ("yyyy-M-d", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d/M/yyyy", "M/d/yyyy")


def normalise_company_name(c: Column) -> Column:
    """Lower case without legal endings, brackets, punctuation and Chinese places (unless nothing else is left)."""
    t = F.trim(F.lower(c))
    for e in NAME_ENDINGS:
        t = F.trim(F.regexp_replace(t, e, ""))
    t = F.regexp_replace(F.regexp_replace(t, r"\([^)]*\)", " "), r"(?U)[^\p{L}\p{N}_\s]", " ")
    words = F.filter(F.split(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), " "), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(*PLACES))
    return F.coalesce(F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " "), F.lit(""))


def extract_domain(c: Column) -> Column:
    """Host of a web address in lower case, without scheme, ``www.``, port and path; null if nothing is left."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"^[a-z][a-z0-9+.-]*://", "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[/?#].*$", ""), r":\d+$", ""), r"^www\.", "")
    return F.when(t != "", t)


def valid_code(c: Column) -> Column:
    """Whether a unified social credit code has the right shape and check character; null gives False."""
    code = F.upper(F.trim(c))
    total = sum(((F.instr(F.lit(CODE_ALPHABET), F.substring(code, i + 1, 1)) - 1) * w for i, w in enumerate(CODE_WEIGHTS)), F.lit(0))
    digit = F.substring(F.lit(CODE_ALPHABET), F.pmod(F.lit(31) - F.pmod(total, F.lit(31)), F.lit(31)) + 1, F.lit(1))
    return F.coalesce(code.rlike(f"^[{CODE_ALPHABET}]{{18}}$") & (digit == F.substring(code, 18, 1)), F.lit(False))


def parse_date(c: Column) -> Column:
    """The first of DATE_PATTERNS that fits; null if none does."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(c), F.lit(p))) for p in DATE_PATTERNS])


def parse_number(c: Column) -> Column:
    """A number from the digits and points of a text, times 10,000 with 万; null if there are none."""
    n = F.regexp_replace(c, r"[^0-9.]", "").try_cast("double")
    return F.when(c.contains("万"), n * 10000).otherwise(n)
