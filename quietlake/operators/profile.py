"""What is known of relations: schemas, descriptions, row and distinct counts; search and policy drafts."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.globs import Globs
from ..plans.policy import Policy

#: Types that can be counted distinct.
_COUNTABLE = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def profile(df: DataFrame, most_columns: int = 60) -> DataFrame:
    """``column, row_count, distinct_count`` of the first columns in alphabetic order.

    One aggregate over one scan. Exact counts of several columns expand each row once a column before
    the first shuffle; map-side aggregation then leaves one row for each value and task.
    """
    names = [f.name for f in sorted(df.schema.fields, key=lambda f: f.name) if not isinstance(f.dataType, T.MapType)][:most_columns]
    cols = [F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(names)]
    one = df.agg(F.count(F.lit(1)).alias("row_count"), *cols)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct_count")) for i, c in enumerate(names)])
    return one.select("row_count", F.explode(pairs).alias("p")).select("p.column", "row_count", "p.distinct_count")


def describe(df: DataFrame) -> dict[str, dict]:
    """Columns with type and comment."""
    return {f.name.lower(): {"type": f.dataType.simpleString(), "description": (f.metadata or {}).get("comment", "")} for f in df.schema.fields}


def relations_of(spark: SparkSession, catalogs: Iterable[str]) -> tuple[list[str], dict[str, str]]:
    """Dotted names of all relations of catalogs, and those catalogs that couldn't be read, with the reason's condition."""
    names, skipped = [], {}
    for c in catalogs:
        try:
            found = []
            for (schema, *_) in spark.sql(f"SHOW NAMESPACES IN `{c}`").collect():
                found += [f"{c}.{schema}.{t['tableName']}" for t in spark.sql(f"SHOW TABLES IN `{c}`.`{schema}`").collect() if not t["isTemporary"]]
            names += found
        except PySparkException as e:
            skipped[c] = e.getCondition() or type(e).__name__
    return names, skipped


def snapshot(spark: SparkSession, relations: Iterable[str] | None = None, stats: bool = False, most_columns: int = 60) -> dict:
    """The index of the given relations (else of the current database): live schemas, counts with ``stats``. A relation that can't be read is left out."""
    names = list(relations) if relations is not None else [t.name for t in spark.catalog.listTables()]
    index = {}
    for name in names:
        try:
            df = spark.table(name)
            df.schema  # noqa: B018  read now, so that what can't be is left out
        except PySparkException:
            continue
        entry: dict = {"kind": "table", "columns": describe(df)}
        if stats:
            for r in profile(df, most_columns).collect():
                entry["row_count"] = r["row_count"]
                entry["columns"][r["column"].lower()]["distinct_count"] = r["distinct_count"]
        index[name.lower()] = entry
    return index


def from_manifest(document: dict) -> dict:
    """The index of a build tool's manifest: models, seeds, snapshots and sources."""
    index = {}
    for node in [*document.get("nodes", {}).values(), *document.get("sources", {}).values()]:
        if node.get("resource_type") not in ("model", "seed", "snapshot", "source"):
            continue
        table = node.get("alias") or node.get("identifier") or node.get("name")
        key = ".".join(str(x) for x in (node.get("database"), node.get("schema"), table) if x).lower()
        index[key] = {
            "kind": node["resource_type"], "dbt_name": node.get("name"), "unique_id": node.get("unique_id"), "description": node.get("description", ""),
            "depends_on": list(node.get("depends_on", {}).get("nodes", []))[:40], "defined_in": node.get("original_file_path"),
            "columns": {c.lower(): {"type": d.get("data_type") or "", "description": d.get("description", "")} for c, d in node.get("columns", {}).items()},
        }
    return index


def discover(root: str | Path, most_depth: int = 4) -> list[Path]:
    """Manifests ``target/manifest.json`` of projects at or below ``root``, in order of their paths."""
    top = Path(root)
    found = {p for d in range(most_depth + 1) for p in top.glob("/".join(["*"] * d + ["target", "manifest.json"]))}
    return sorted(found)


def from_manifests(paths: Iterable[str | Path]) -> tuple[dict, list[str]]:
    """The index of several manifests, later ones winning, and the files that can't be read."""
    index, broken = {}, []
    for p in paths:
        try:
            index |= from_manifest(json.loads(Path(p).read_text()))
        except (OSError, ValueError, AttributeError):
            broken.append(str(p))
    return index, broken


def merged(written: dict, live: dict) -> dict:
    """Two indexes as one: live types and counts win, written descriptions win."""
    out = {}
    for key in sorted(set(written) | set(live)):
        a, b = written.get(key, {}), live.get(key, {})
        columns = {}
        for c in {**a.get("columns", {}), **b.get("columns", {})}:
            x, y = a.get("columns", {}).get(c, {}), b.get("columns", {}).get(c, {})
            columns[c] = {**x, **y, "type": y.get("type") or x.get("type", ""), "description": x.get("description") or y.get("description", "")}
        out[key] = {**b, **a, **{k: b[k] for k in ("row_count",) if k in b}, "columns": columns}
    return out


def save(index: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(index, indent=1, sort_keys=True))


def load(path: str | Path) -> dict:
    p = Path(path)
    return json.loads(p.read_text()) if p.exists() else {}


def columns_frame(spark: SparkSession, index: dict) -> DataFrame:
    """The index as rows: relation, column, type, description, distinct_count, row_count."""
    rows = [(r, c, d.get("type"), d.get("description"), d.get("distinct_count"), e.get("row_count")) for r, e in index.items() for c, d in e.get("columns", {}).items()]
    return spark.createDataFrame(rows, "relation string, column string, type string, description string, distinct_count long, row_count long")


def search(relations: DataFrame, pattern: str, name: str = "relation") -> DataFrame:
    """Rows whose relation matches: a pattern without wildcards may be any part; tried on the whole name, its last two parts and its last."""
    p = pattern.lower() if set(pattern) & set("*?[") else f"*{pattern.lower()}*"
    g, full = Globs([p]), F.lower(F.col(name))
    parts = F.split(full, r"\.")
    last2 = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), ".")
    return relations.filter(g.matches(full) | g.matches(last2) | g.matches(F.element_at(parts, -1)))


def person_keys(columns: DataFrame, policy: Policy, ratio: float = 0.5) -> DataFrame:
    """Columns whose distinct count is at least ``ratio`` of the rows and that aren't allow-listed."""
    return columns.filter((F.col("row_count") > 0) & (F.col("distinct_count") >= ratio * F.col("row_count")) & ~policy.allow_columns.matches(F.col("column")))


def classified(relations: DataFrame, policy: Policy, name: str = "relation") -> DataFrame:
    """``relations`` with ``level``, by column expressions over the distinct forms of each name."""
    full = F.lower(F.col(name))
    parts = F.filter(F.split(full, r"\."), lambda x: x != "")
    n = F.size(parts)
    get = lambda i: F.when(n >= i, F.element_at(parts, -i)).otherwise(F.lit(""))
    table, schema, catalog = get(1), get(2), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), n - 2)), ".")
    dev = r"(?i)^dev_[a-z0-9]+(?:__(.+))?$"
    is_dev, real = schema.rlike(dev), F.regexp_extract(schema, dev, 1)
    dev_catalog = catalog.endswith("_dev")
    dotted = lambda *xs: F.concat_ws(".", *[F.when(x != "", x) for x in xs])
    other_schema, other_catalog = F.when(is_dev, real).otherwise(schema), F.when(dev_catalog, F.substring(catalog, F.lit(1), F.length(catalog) - 4)).otherwise(catalog)
    forms = [dotted(c, s, table) for c in (catalog, other_catalog) for s in (schema, other_schema)] + [dotted(schema, table), dotted(other_schema, table), table]
    hit = lambda g: _any(g.matches(f) for f in forms)
    level = F.when(hit(policy.red), "RED").when(hit(policy.green), F.when(is_dev | dev_catalog, "AMBER").otherwise("GREEN")).when(hit(policy.amber), "AMBER").otherwise("RED")
    return relations.withColumn("level", level)


def _any(tests):
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def draft(relations: DataFrame, policy: Policy, name: str = "relation") -> DataFrame:
    """A policy's review sheet: ``level, relations, names``."""
    return classified(relations, policy, name).groupBy("level").agg(F.count(F.lit(1)).alias("relations"), F.array_sort(F.collect_list(name)).alias("names"))


def render(index: dict, relation: str | None = None) -> str:
    """A padded listing of relations and columns."""
    lines = []
    for r in sorted(index):
        if relation and r != relation:
            continue
        e = index[r]
        lines.append(f"{r}  [{e.get('kind', '')}]  {str(e.get('description', ''))[:160]}".rstrip())
        width = max((len(c) for c in e.get("columns", {})), default=0)
        lines += [f"  {c:<{width}}  {d.get('type', ''):<12}  {str(d.get('description', ''))[:100]}".rstrip() for c, d in sorted(e.get("columns", {}).items())]
    return "\n".join(lines)
