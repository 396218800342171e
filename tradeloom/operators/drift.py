"""Schemas that drift between files: one consistent table per source, and every change.

Rows are loaded as path-value maps with raw JSON types.  Path and type statistics, with a small
histogram of what the values look like, are aggregated by file (here a source and a month); the
changes are read off those statistics, whose number follows the schema and not the rows.  Then
typed columns are projected, and values that do not cast are reported.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.payload import EACH, MAX_PATHS, discover, payload, step
from tradeloom.runtime import cut, small_side, sql_text

#: Bins of the two histograms kept for each field of a file: of the values' shapes, and of their first words or rough sizes.
SHAPE_BINS, WORD_BINS = 64, 16
#: Least likeness of contents for a removed and an added field to be one renamed field; shapes count for SHAPE_SHARE of it.
LIKENESS, SHAPE_SHARE = 0.65, 0.6
#: JSON type of each VARIANT schema head.
KINDS = {"STRING": "string", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array", "VOID": "null"}


def path_value_maps(df: DataFrame, group: str, raw: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, ``group`` and ``entries``: an array of (path, type, value) per row.

    Paths are object keys from the root joined by ``.``; fields inside arrays are left out.  JSON
    nulls and absent fields make no entry.  Unparsable payloads and such that are no objects
    give rows without entries.
    """
    parsed = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*keep, group))], payload(F.col(f"`{raw}`")).alias("_v"))
    by_group: dict[str, list[tuple[str, ...]]] = defaultdict(list)
    for g, path, _ in discover(parsed, "_v", group):
        if path and EACH not in path and path not in by_group[g]:
            by_group[g].append(path)
    kind = (
        "CASE WHEN head IN ('BIGINT','DOUBLE','FLOAT') OR head LIKE 'DECIMAL%' THEN 'number' "
        + " ".join(f"WHEN head LIKE '{k}%' THEN '{v}'" for k, v in KINDS.items())
        + " ELSE 'string' END"
    )
    empty = "cast(array() AS array<struct<path:string,type:string,value:variant>>)"

    def entries(paths: list[tuple[str, ...]]) -> str:
        fields = ", ".join(f"named_struct('path', {sql_text('.'.join(p))}, 'head', schema_of_variant({step('_v', p, 'variant')}), 'value', {step('_v', p, 'variant')})" for p in sorted(paths))
        typed = f"transform(filter(array({fields}), e -> e.head IS NOT NULL AND e.head <> 'VOID'), e -> named_struct('path', e.path, 'type', {kind.replace('head', 'e.head')}, 'value', e.value))"
        return typed

    cases = "".join(f" WHEN `{group}` {'= ' + sql_text(g) if g is not None else 'IS NULL'} THEN {entries(p)}" for g, p in sorted(by_group.items(), key=str))
    return parsed.withColumn("entries", F.expr(f"CASE{cases} ELSE {empty} END" if cases else empty)).drop("_v")


def file_statistics(df: DataFrame, group: str, file: str, raw: str) -> DataFrame:
    """(group, file, path, type, shape_bin, word_bin, n) over all rows; partial sums are made before the shuffle."""
    rows = path_value_maps(df, group, raw, (file,)).select(F.col(group).cast("string").alias("grp"), F.col(file).cast("string").alias("file"), F.explode_outer("entries").alias("e"))
    scalar = F.expr("CASE WHEN e.type IN ('string','number','boolean') THEN try_variant_get(e.value, '$', 'string') ELSE '' END")
    shape = F.regexp_replace(F.regexp_replace(F.lower(scalar), r"\p{L}+", "a"), r"\d+", "9")
    number = F.expr("CASE WHEN e.type = 'number' THEN cast(floor(log2(1 + abs(try_variant_get(e.value, '$', 'double')))) AS string) END")
    word = F.coalesce(number, F.regexp_extract(F.lower(scalar), r"(?U)^\W*(\w+)", 1))
    return rows.groupBy("grp", "file", F.col("e.path").alias("path"), F.col("e.type").alias("type"), F.pmod(F.xxhash64(shape), F.lit(SHAPE_BINS)).cast("int").alias("shape_bin"), F.pmod(F.xxhash64(word), F.lit(WORD_BINS)).cast("int").alias("word_bin")).agg(F.count(F.lit(1)).alias("n"))


def _cosine(a: dict, b: dict) -> float:
    dot = sum(v * b.get(k, 0) for k, v in a.items())
    return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) if a and b else 0.0


def changes_of(stats: pd.DataFrame) -> list[tuple[str, str, str, str]]:
    """(file, change_kind, field_before, field_after) of one group's statistics; files are ordered by name."""
    files = sorted(stats["file"].dropna().unique())
    if not files:
        return []
    rank = {f: i for i, f in enumerate(files)}
    seen: dict[str, dict[int, dict[str, int]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
    shapes: dict[str, dict] = defaultdict(lambda: defaultdict(int))
    words: dict[str, dict] = defaultdict(lambda: defaultdict(int))
    kinds: dict[str, dict] = defaultdict(lambda: defaultdict(int))
    for file, path, kind, s, w, n in stats[["file", "path", "type", "shape_bin", "word_bin", "n"]].itertuples(index=False):
        if isinstance(path, str) and isinstance(file, str):
            seen[path][rank[file]][kind] += n
            kinds[path][kind] += n
            shapes[path][s] += n
            words[path][w] += n
    last = len(files) - 1
    added, removed, out = {}, {}, []
    for path, months in seen.items():
        first, final = min(months), max(months)
        if first > 0:
            added[path] = first
        if final < last:
            removed[path] = final + 1

    # Renamed: gone in the file where the other begins, of the same type under the same parent, and alike in content.
    pairs = []
    for old, at in removed.items():
        for new, begins in added.items():
            if at == begins and set(seen[old][max(seen[old])]) & set(seen[new][begins]) and old.rpartition(".")[0] == new.rpartition(".")[0]:
                likeness = SHAPE_SHARE * _cosine(shapes[old], shapes[new]) + (1 - SHAPE_SHARE) * _cosine(words[old], words[new])
                if "object" in kinds[old]:
                    inner = [{p[len(x) + 1 :] for p in seen if p.startswith(x + ".")} for x in (old, new)]
                    likeness = len(inner[0] & inner[1]) / max(1, len(inner[0] | inner[1]))
                elif "array" in kinds[old]:
                    rate = [sum(kinds[x].values()) / max(1, len(seen[x])) for x in (old, new)]
                    likeness = min(rate) / max(rate)
                if likeness >= LIKENESS:
                    pairs.append((-likeness, old, new))
    taken: set[str] = set()
    for _, old, new in sorted(pairs):
        if old not in taken and new not in taken:
            taken |= {old, new}
            out.append((files[added[new]], "renamed", old, new, added[new]))
    out += [(files[i], "added", "", p, i) for p, i in added.items() if p not in taken]
    out += [(files[i], "removed", p, "", i) for p, i in removed.items() if p not in taken]

    # Retyped: another set of types, which the next file that has the field shows as well.
    for path, months in seen.items():
        order = sorted(months)
        state = set(months[order[0]])
        for k, i in enumerate(order[1:], 1):
            now = set(months[i])
            if now != state and (k + 1 == len(order) or set(months[order[k + 1]]) == now):
                out.append((files[i], "retyped", path, path, i))
                state = now

    # What stands under a changed field is not listed on its own.
    changed: dict[int, set[str]] = defaultdict(set)
    for _, _, a, b, i in out:
        changed[i] |= {a, b} - {""}

    def under(path: str, i: int) -> bool:
        parts = path.split(".")
        return any(".".join(parts[:k]) in changed[i] for k in range(1, len(parts)))

    return sorted((f, kind, a, b) for f, kind, a, b, i in out if not under(a or b, i) and not under(b or a, i))


def schema_changes(df: DataFrame, group: str, file: str, raw: str) -> DataFrame:
    """(group, file, change_kind, field_before, field_after): every lasting change of each group's fields.

    ``file`` orders the files of a group by its text.  A field exists in the files where some row
    gives it a value; null says nothing.  A field gone for good is removed in the next file,
    one that begins later is added there, and a pair of both in one file that is alike in type,
    parent and content is renamed.  Unparsable rows and groups without files give no rows.
    """
    stats = file_statistics(df, group, file, raw)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pdf["grp"].iloc[0], *r) for r in changes_of(pdf)]
        return pd.DataFrame(rows, columns=[group, file, "change_kind", "field_before", "field_after"])

    return stats.groupBy("grp").applyInPandas(run, f"`{group}` string, `{file}` string, change_kind string, field_before string, field_after string")


#: Column type that holds each set of JSON types.
COLUMN_TYPES = {frozenset({"number"}): "double", frozenset({"boolean"}): "boolean"}


def table_plan(df: DataFrame, group: str, file: str, raw: str) -> dict[str, dict[str, tuple[str, str]]]:
    """For each group, the latest name and the column type of every path it ever had.

    Plans are made group by group where the statistics are; only they come to the driver, and
    their number follows the schema (an error beyond MAX_PATHS).
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        renamed = {a: b for _, kind, a, b in changes_of(part) if kind == "renamed"}
        rows = []
        some = part.dropna(subset=["path"])
        newest = {p: set(x.loc[x["file"] == x["file"].max(), "type"]) for p, x in some.groupby("path")}
        for path in newest:
            name = path
            while name in renamed:
                name = renamed[name]
            rows.append((part["grp"].iloc[0], path, name, COLUMN_TYPES.get(frozenset(newest.get(name, ())), "string")))
        return pd.DataFrame(rows, columns=["grp", "path", "name", "to"])

    rows = file_statistics(df, group, file, raw).where("grp IS NOT NULL").groupBy("grp").applyInPandas(run, "grp string, path string, name string, to string").limit(MAX_PATHS + 1).collect()
    if len(rows) > MAX_PATHS:
        raise ValueError(f"more than {MAX_PATHS} fields")
    plan: dict[str, dict[str, tuple[str, str]]] = defaultdict(dict)
    for r in rows:
        plan[r.grp][r.path] = (r.name, r.to)
    return dict(plan)


def typed_records(df: DataFrame, group: str, file: str, raw: str, key: str) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """(group, key, file, field, to_type, from_type, value, failed): every value under its field's latest name, and each group's columns.

    ``value`` is the text of the value in the column's type, null if the cast failed.  Where a row
    has a field under two names, the latest counts.  Rows are made in one pass, without a shuffle.
    """
    plan = table_plan(df, group, file, raw)
    looked_up = []
    for g, paths in sorted(plan.items()):
        order = sorted(paths, key=lambda p: (p != paths[p][0], p))
        for k, p in enumerate(order):
            looked_up.append((g, p, *paths[p], [o for o in order[:k] if paths[o][0] == paths[p][0]]))
    plans = df.sparkSession.createDataFrame(looked_up, "_g string, _path string, field string, to_type string, _better array<string>")
    rows = path_value_maps(df, group, raw, (key, file)).withColumn("_names", F.transform("entries", lambda e: e["path"]))
    one = rows.select(F.col(f"`{group}`"), F.col(f"`{key}`"), F.col(f"`{file}`"), "_names", F.explode_outer("entries").alias("e"))  # a plain explode would infer a filter that makes the entries again
    one = one.join(small_side(plans), (F.col(f"`{group}`").cast("string") == F.col("_g")) & (F.col("e.path") == F.col("_path"))).where(~F.arrays_overlap("_names", "_better"))
    text = "CASE WHEN e.type IN ('object','array') THEN to_json(e.value) ELSE try_variant_get(e.value, '$', 'string') END"
    cast = f"CASE to_type WHEN 'double' THEN cast(try_cast(try_variant_get(e.value, '$', 'string') AS double) AS string) WHEN 'boolean' THEN cast(try_cast(try_variant_get(e.value, '$', 'string') AS boolean) AS string) ELSE {text} END"
    out = one.select(F.col(f"`{group}`"), F.col(f"`{key}`"), F.col(f"`{file}`"), "field", "to_type", F.col("e.type").alias("from_type"), F.expr(cast).alias("value"))
    return out.withColumn("failed", F.col("value").isNull()), {g: dict(p.values()) for g, p in plan.items()}


def failed_casts(records: DataFrame, group: str) -> DataFrame:
    """(group, field, from_type, to_type, n): values that could not be cast to their field's column type and stand as null."""
    return records.where("failed").groupBy(F.col(f"`{group}`").cast("string").alias(group), "field", "from_type", "to_type").agg(F.count(F.lit(1)).alias("n"))


def consistent_tables(df: DataFrame, group: str, file: str, raw: str, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """One table per group, with each field under its latest name and in its latest type, and the failed casts.

    Objects and arrays are columns of JSON text.  Rows without a single field stand with nulls.
    The second frame is that of ``failed_casts``.  All tables are read from one written pass.
    """
    records, columns = typed_records(df, group, file, raw, key)
    records = cut(records)
    tables = {}
    for g, fields in columns.items():
        rows = df.where(F.col(f"`{group}`").cast("string") == g).select(F.col(f"`{key}`"), F.col(f"`{file}`"))
        own = records.where(F.col(f"`{group}`").cast("string") == g).groupBy(F.col(f"`{key}`"), F.col(f"`{file}`")).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_m"))
        full = rows.join(own, [key, file], "left")
        tables[g] = full.select(F.col(f"`{key}`"), F.col(f"`{file}`"), *[F.try_element_at("_m", F.lit(n)).cast(t).alias("f." + n) for n, t in sorted(fields.items())])
    return tables, failed_casts(records, group)
