"""Deeply nested records as related flat tables.

The array paths of all payloads are discovered first (schema texts only).  Each path then becomes
one higher-order projection: nested ``transform`` calls carry the positions of the ancestors
along, ``flatten`` joins the inner arrays, and one ``inline`` per target table emits the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.payload import EACH, discover, payload, step
from tradeloom.runtime import cut, sql_text


def array_paths(df: DataFrame, variant: str) -> list[tuple[str, ...]]:
    """Every array path of the column; ``EACH`` stands for the step from an array to its elements."""
    return sorted({path for _, path, kind in discover(df, variant) if kind == "array"})


def dotted(path: tuple[str, ...]) -> str:
    """Object keys from the root joined by ``.``, without positions."""
    return ".".join(k for k in path if k != EACH)


def elements_sql(variant: str, path: tuple[str, ...], paths: set[tuple[str, ...]], value: bool) -> str:
    """SQL for the array of (array_path, parent_idx, idx[, value]) of one array path.

    Elements that are arrays themselves are no rows of their own; their elements are, under the
    same array_path with one more position.
    """
    hops: list[list[str]] = [[]]
    for k in path:
        if k == EACH:
            hops.append([])
        else:
            hops[-1].append(k)

    def build(parent: str, idx: str | None, level: int) -> str:
        arr = step(parent, tuple(hops[level]), "array<variant>")
        here = f"cast(i{level} AS string)" if idx is None else f"concat({idx}, '.', i{level})"
        if level == len(hops) - 1:
            up = f"coalesce({idx}, '')" if idx else "''"
            row = f"named_struct('array_path', {sql_text(dotted(path))}, 'parent_idx', {up}, 'idx', {here}" + (f", 'value', x{level})" if value else ")")
            rows = f"transform({arr}, (x{level}, i{level}) -> {row})"
            if (*path, EACH) in paths:  # some elements are arrays
                arr = f"transform({arr}, (x{level}, i{level}) -> named_struct('x', x{level}, 'row', {row}))"
                rows = f"transform(filter({arr}, e -> NOT coalesce(schema_of_variant(e.x), '') LIKE 'ARRAY<%'), e -> e.row)"
            return rows
        return f"flatten(filter(transform({arr}, (x{level}, i{level}) -> {build(f'x{level}', here, level + 1)}), y{level} -> y{level} IS NOT NULL))"

    return build(variant, None, 0)


def array_elements(df: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, array_path, parent_idx, idx): one row for each element of each array at any depth of the JSON text ``raw``.

    ``parent_idx`` is the idx of the element that holds the array ('' for arrays outside any).
    Texts that cannot be parsed, nulls, and payloads without arrays give no rows.
    """
    parsed = df.select(F.col(f"`{key}`").alias(key), payload(F.col(f"`{raw}`")).alias("_v"))
    paths = array_paths(parsed, "_v")
    if not paths:
        return df.sparkSession.createDataFrame([], f"`{key}` {dict(df.dtypes)[key]}, array_path string, parent_idx string, idx string")
    each = ", ".join(elements_sql("_v", p, set(paths), False) for p in paths)
    rows = F.expr(f"flatten(filter(array({each}), a -> a IS NOT NULL))")
    # a plain inline would infer a filter that makes the rows again
    return parsed.where("_v IS NOT NULL").select(F.col(key), F.inline_outer(rows)).where("array_path IS NOT NULL")


def flat_records(df: DataFrame, key: str, raw: str) -> tuple[DataFrame, dict[str, tuple[list[str], bool]]]:
    """Every row of every flat table in one pass, and for each table its fields and whether it has scalar elements.

    (key, array_path, parent_idx, idx, value, fields): the root objects have array_path, parent_idx
    and idx ''; ``fields`` maps the scalar fields of an object (nested object keys joined by ``.``)
    to their text, ``value`` is the text of a scalar element.  Payloads are parsed once for the
    paths and once for the rows.
    """
    parsed = df.select(F.col(f"`{key}`").alias(key), payload(F.col(f"`{raw}`")).alias("_v")).where("_v IS NOT NULL")
    known = [(p, kind) for _, p, kind in discover(parsed, "_v")]
    paths = {p for p, kind in known if kind == "array"}
    fields: dict[str, dict[tuple[str, ...], None]] = {"": {}}
    scalars: dict[str, bool] = {"": False}
    for prefix in [(), *[(*p, EACH) for p in sorted(paths)]]:
        n, name = len(prefix), dotted(prefix)
        own = fields.setdefault(name, {})
        scalars[name] = scalars.get(name, False) or (n > 0 and (prefix, "scalar") in known)
        for p, kind in known:
            if kind == "scalar" and p[:n] == prefix and EACH not in p[n:] and len(p) > n:
                own[p[n:]] = None
    each = ["array(named_struct('array_path', '', 'parent_idx', '', 'idx', '', 'value', _v))", *[elements_sql("_v", p, paths, True) for p in sorted(paths)]]
    rows = parsed.select(F.col(key), F.expr(f"inline_outer(flatten(filter(array({', '.join(each)}), a -> a IS NOT NULL)))"))

    def filled(name: str) -> str:
        pairs = ", ".join(f"{sql_text('.'.join(f))}, {step('value', f, 'string')}" for f in sorted(fields[name]))
        return f"map_filter(map({pairs}), (k, v) -> v IS NOT NULL)" if pairs else "cast(map() AS map<string,string>)"

    cases = "".join(f" WHEN {sql_text(name)} THEN {filled(name)}" for name in sorted(fields))
    out = rows.select(F.col(key), "array_path", "parent_idx", "idx", F.expr("CASE WHEN idx <> '' THEN try_variant_get(value, '$', 'string') END").alias("value"), F.expr(f"CASE array_path{cases} END").alias("fields"))
    out = out.withColumn("value", F.expr("CASE WHEN cardinality(fields) = 0 THEN value END"))
    return out, {name: ([".".join(f) for f in sorted(fields[name])], scalars[name]) for name in fields}


def flat_tables(df: DataFrame, key: str, raw: str) -> dict[str, DataFrame]:
    """One DataFrame per array path, and ``''`` for the root objects.

    Each has the raw row's key, ``parent_idx``, ``idx``, and one string column for each scalar
    field of the elements (nested object keys joined by ``.``), or ``value`` for scalar elements.
    The parent of a row is the row of the enclosing path whose idx is this row's parent_idx.
    Key columns named like a field are kept apart by the prefix ``f.`` of fields.  All tables
    are read from one written pass over the payloads.
    """
    rows, layout = flat_records(df, key, raw)
    rows = cut(rows)
    out = {}
    for name, (fields, scalar) in layout.items():
        place = [] if name == "" else ["parent_idx", "idx", *(["value"] if scalar else [])]
        out[name] = rows.where(F.col("array_path") == name).select(F.col(key), *place, *[F.try_element_at("fields", F.lit(f)).alias("f." + f) for f in fields])
    return out
