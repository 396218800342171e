"""What counts as a value at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that sources write where nothing is known (compared lower-case, trimmed).
PLACEHOLDERS = (
    "", "-", "--", "---", ".", "?", "n/a", "n.a.", "na", "nil", "none", "null", "nan", "tbc", "tbd", "t.b.d.", "unknown", "undefined",
    "not provided", "not available", "not known", "not specified", "see website", "see our website", "to be confirmed", "to be advised", "/", "n.n.", "xxx", "no data", "k.a.", "待定", "无", "暂无",
)


def says_something(c: Column) -> Column:
    """False for null, blank and placeholder words."""
    return F.coalesce(~F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))).isin(*PLACEHOLDERS), F.lit(False))
