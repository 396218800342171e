"""Several values packed in one field, one row per value with its position.

Every text is cut into tokens: runs of ordinary characters, white space, numbering, and single
marks.  Masking the ordinary runs gives the text's *delimiter skeleton*.  Splitting rules are
resolved once for each distinct skeleton, joined back (by broadcast when their measured size
allows it), and applied by token position, so no row is parsed in Python.

A comma between digits and a slash without spaces around it are ordinary characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.values import says_something
from tradeloom.runtime import cut, small_side, sql_text

#: Marks with a meaning of their own.
SEPARATORS = ",;|·•‧、，；\n\t"
QUOTES = {'"': '"', "“": "”", "”": "”", "„": "“”", "‟": "”", "«": "»", "'": "'", "‘": "’", "`": "`"}
BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】"}
MARKS = ",;|·•‧、，；/\"“”„‟«»'‘’`()[]{}（）【】\\"
BULLETS = "-*–—▪◦‣●○■"

_M = "".join("\\" + c if c in "\\[]" else c for c in MARKS)
_ORDINARY = rf"(?:[^\s{_M}]|(?<=\d),(?=\d)|(?<=\S)/(?=\S)|(?<=[\p{{L}}\d])['’](?=\p{{L}}))"
_NUMBERING = rf"(?:\(?\d{{1,3}}[.)]|[{BULLETS}])"
#: Tokens, in this order: numbering or bullet, line ends, tab, other white space, ordinary run, any mark.
TOKEN = rf"(?s)((?<!\S){_NUMBERING}(?=\s)|[\r\n]+|\t|[^\S\r\n\t]+|{_ORDINARY}+(?: {_ORDINARY}+)*|.)"


def resolve(skeleton: str) -> list[tuple[int, int, int]]:
    """The spans of a skeleton's values: first token (from 1), number of tokens, and quoting (0 none, 1 quotes, 2 JSON).

    Values are cut at separators outside quotes and brackets.  A quotation mark opens only at
    the start of a value and closes only before a separator or the end, so an inch mark inside a
    name stays; a bracket without its partner is an ordinary mark.  Empty values are skipped.
    """
    n = len(skeleton)

    def blank(i: int, to: int) -> int:
        while i < to and skeleton[i] in " \n\t":
            i += 1
        return i

    lo, hi = blank(0, n), n
    while hi > lo and skeleton[hi - 1] in " \n\t":
        hi -= 1
    as_json = False
    if hi - lo >= 2 and skeleton[lo] == "[" and skeleton[hi - 1] == "]":
        inner = blank(lo + 1, hi)
        if skeleton[inner] in '"]' and (inner == hi - 1 or skeleton[hi - 2] in '" \n\t'):
            lo, hi, as_json = lo + 1, hi - 1, True

    def ends(i: int) -> bool:
        while i < hi and skeleton[i] == " ":
            i += 1
        return i >= hi or skeleton[i] in SEPARATORS or (skeleton[i] == "/" and i + 1 < hi and skeleton[i + 1] == " ")

    def closing(i: int) -> int:
        """Where the quotation that opens at i closes; -1 if it doesn't."""
        shut, j = QUOTES[skeleton[i]], i + 1
        while j < hi:
            if skeleton[j] == "\\":
                j += 2
            elif skeleton[j] in shut:
                if j + 1 < hi and skeleton[j + 1] == skeleton[j] and j > i + 1:
                    j += 2
                elif ends(j + 1):
                    return j
                else:
                    j += 1
            else:
                j += 1
        return -1

    out: list[tuple[int, int, int]] = []

    def add(a: int, b: int, quoted: int = 0) -> None:
        while a < b and skeleton[a] in " \n\t":
            a += 1
        while a < b and skeleton[b - 1] in " \n\t":
            b -= 1
        if a < b:
            out.append((a + 1, b - a, quoted))

    i = start = lo
    fresh = True  # nothing of the value yet
    while i < hi:
        c = skeleton[i]
        if c in SEPARATORS or (c == "/" and 0 < i < hi - 1 and skeleton[i - 1] == " " and skeleton[i + 1] == " "):
            add(start, i)
            i += 1
            start, fresh = i, True
        elif c in " ":
            i += 1
        elif c == "#" and fresh:
            i += 1
            start = i
        elif c in QUOTES and fresh and (j := closing(i)) > 0:
            add(i + 1, j, 2 if as_json else 1)
            i = start = j + 1
            fresh = False
        elif c in BRACKETS:
            depth, j = 0, i
            while j < hi:
                depth += (skeleton[j] == c) - (skeleton[j] == BRACKETS[c])
                if depth == 0:
                    break
                j += 1
            i = j + 1 if j < hi else i + 1
            fresh = False
        else:
            i += 1
            fresh = False
    add(start, hi)
    return out


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"skeleton": b["skeleton"], "spans": [[{"at": a, "n": n, "q": q} for a, n, q in resolve(s)] for s in b["skeleton"]]})


def split_packed(df: DataFrame, column: str, value: str = "value", pos: str = "pos") -> DataFrame:
    """``df`` with one row per value packed in ``column``: its place ``pos`` from 1, and ``value``.

    All columns of ``df`` are kept.  Values are trimmed and lose quotes, bullets and numbering
    around them; doubled and escaped quotes are undone.  Null, blank and placeholder fields give
    no rows, nor does an empty table; repeated values stay.  Names that clash with the two new
    columns raise ValueError.
    """
    if {value, pos} & set(df.columns):
        raise ValueError(f"{value} or {pos} is a column already")
    t = "t"
    kind = (
        f"CASE WHEN {t} RLIKE '^[\\r\\n]' THEN '\\n' WHEN {t} = '\\t' THEN {t} WHEN {t} RLIKE '^\\\\s' THEN ' ' "
        f"WHEN {t} RLIKE {sql_text('^' + _NUMBERING + '$')} THEN '#' "
        f"WHEN length({t}) = 1 AND instr({sql_text(MARKS)}, {t}) > 0 THEN {t} ELSE 'a' END"
    )
    rows = df.where(says_something(F.col(f"`{column}`"))).withColumn("_tokens", F.expr(f"regexp_extract_all(`{column}`, {sql_text(TOKEN)}, 1)")).withColumn("_skeleton", F.expr(f"array_join(transform(_tokens, t -> {kind}), '')"))
    rules = cut(rows.select(F.col("_skeleton").alias("skeleton")).distinct().mapInPandas(_rules, "skeleton string, spans array<struct<at:int,n:int,q:int>>"))
    cut_out = "array_join(slice(_tokens, s.at, s.n), '')"
    plain = f"regexp_replace(regexp_replace({cut_out}, '([\"“”„\\'])\\\\1', '$1'), {sql_text(chr(92) * 2 + '([^\\p{L}\\d\\s])')}, '$1')"
    js = f"coalesce(get(from_json(concat('[\"', {cut_out}, '\"]'), 'array<string>'), 0), {plain})"
    text = F.expr(f"transform(spans, s -> trim(CASE s.q WHEN 0 THEN {cut_out} WHEN 1 THEN {plain} ELSE {js} END))")
    joined = rows.join(small_side(rules), F.col("_skeleton") == F.col("skeleton")).withColumn("_values", F.filter(text, lambda x: x != ""))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.posexplode("_values").alias("_at", value)).withColumn(pos, F.col("_at") + 1).drop("_at")
