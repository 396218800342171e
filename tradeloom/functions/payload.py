"""JSON payloads as VARIANT, and the schema paths that occur in them.

A payload may be JSON text inside a JSON string; it then counts as what it decodes to.  Text
after the first JSON value makes a payload unparsable, as does anything but JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In a path, the step from an array to its elements.
EACH = "[]"
#: More schema paths than this are no schema; the caller is told instead of being flooded.
MAX_PATHS = 100_000


def payload(raw: str | Column) -> Column:
    """VARIANT of a JSON text; null if it cannot be parsed.  The value stands alone in brackets while parsed, so trailing text is an error."""
    raw = F.col(raw) if isinstance(raw, str) else raw

    def one(text: Column) -> Column:
        parsed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
        return F.when(F.size(parsed) == 1, parsed[0])

    # A payload that starts with a quotation mark is a JSON string: decode, then parse what it holds.
    inner = F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(F.ltrim(raw).startswith('"'), one(inner)).otherwise(one(raw))


def _split_top(body: str) -> list[str]:
    out, depth, start, tick = [], 0, 0, False
    for i, ch in enumerate(body):
        if ch == "`":
            tick = not tick
        elif tick:
            continue
        elif ch in "<(":
            depth += 1
        elif ch in ">)":
            depth -= 1
        elif ch == "," and depth == 0:
            out.append(body[start:i])
            start = i + 1
    if body[start:].strip():
        out.append(body[start:])
    return [x.strip() for x in out]


def schema_paths(ddl: str) -> tuple[set[tuple[tuple[str, ...], str]], bool]:
    """Paths and kinds in the text of one VARIANT schema, and whether they are all.

    A kind is ``array``, ``object`` or ``scalar``.  Where values of several kinds were merged
    into VARIANT below an array, the schema hides paths; the flag is then False.
    """
    found: set[tuple[tuple[str, ...], str]] = set()
    whole = True

    def walk(text: str, path: tuple[str, ...]) -> None:
        nonlocal whole
        if text.startswith("ARRAY<"):
            found.add((path, "array"))
            walk(text[6:-1], (*path, EACH))
        elif text.startswith("OBJECT<"):
            found.add((path, "object"))
            for field in _split_top(text[7:-1]):
                if field.startswith("`"):
                    end = 1
                    while field[end] != "`" or field[end + 1 : end + 2] == "`":
                        end += 2 if field[end] == "`" else 1
                    name, rest = field[1:end].replace("``", "`"), field[end + 1 :]
                else:
                    name, _, rest = field.partition(":")
                    rest = ":" + rest
                walk(rest.lstrip(": "), (*path, name.strip() if not field.startswith("`") else name))
        elif text == "VARIANT":
            whole = False
        elif text != "VOID":
            found.add((path, "scalar"))

    walk(ddl, ())
    return found, whole


def value_paths(value: object) -> set[tuple[tuple[str, ...], str]]:
    """The same of a decoded value."""
    found: set[tuple[tuple[str, ...], str]] = set()

    def walk(v: object, path: tuple[str, ...]) -> None:
        if isinstance(v, dict):
            found.add((path, "object"))
            for k, x in v.items():
                walk(x, (*path, k))
        elif isinstance(v, list):
            found.add((path, "array"))
            for x in v:
                walk(x, (*path, EACH))
        elif v is not None:
            found.add((path, "scalar"))

    walk(value, ())
    return found


def discover(df: DataFrame, variant: str, by: str | None = None) -> list[tuple[str | None, tuple[str, ...], str]]:
    """Every (group, path, kind) that occurs in ``variant``, read from all rows.

    Schemas are made distinct where the rows are; only distinct schema texts leave the JVM, and
    only schema paths, whose number does not follow the rows, come to the driver (an error
    beyond ``MAX_PATHS``).  Rows whose schema hides paths are walked value by value.
    """
    group = F.col(by).cast("string") if by else F.lit(None).cast("string")
    distinct = df.select(group.alias("g"), F.expr(f"schema_of_variant({variant})").alias("ddl"), F.when(F.expr(f"schema_of_variant({variant})").contains("VARIANT"), F.to_json(F.col(variant))).alias("js")).where("ddl IS NOT NULL").groupBy("g", "ddl", "js").count()

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple] = set()
        for b in batches:
            new = set()
            for g, ddl, js in zip(b["g"], b["ddl"], b["js"]):
                for path, kind in value_paths(json.loads(js)) if js is not None else schema_paths(ddl)[0]:
                    new.add((g, json.dumps(path), kind))
            new -= seen
            seen |= new
            yield pd.DataFrame(sorted(new, key=str), columns=["g", "path", "kind"])

    rows = distinct.mapInPandas(paths, "g string, path string, kind string").distinct().limit(MAX_PATHS + 1).collect()
    if len(rows) > MAX_PATHS:
        raise ValueError(f"more than {MAX_PATHS} schema paths: object keys seem to hold data")
    return sorted(((r.g, tuple(json.loads(r.path)), r.kind) for r in rows), key=str)


def step(parent: str, keys: tuple[str, ...], to: str) -> str:
    """SQL that goes from the VARIANT ``parent`` through object ``keys`` and casts to ``to`` (null if it can't)."""
    from tradeloom.runtime import sql_text

    plain = ""
    for k in keys:
        if '"' in k or "\\" in k or "'" in k:  # not expressible in a path: go through a map
            parent = f"element_at(try_variant_get({parent}, {sql_text('$' + plain)}, 'map<string,variant>'), {sql_text(k)})"
            plain = ""
        else:
            plain += f'["{k}"]'
    return f"try_variant_get({parent}, {sql_text('$' + plain)}, '{to}')"
