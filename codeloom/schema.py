"""The property graph as two DataFrames: normalising projections over node and edge tables of any completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edge types in their canonical spelling.
EDGE_TYPES = ["Calls", "Imports", "ImportsFrom", "References", "Uses", "Invokes", "Instantiates", "Extends", "Implements", "Contains", "RuntimeCalls"]
#: Columns of a normalised node and their types; absent ones are filled with null.
NODE_COLUMNS = {
    "node_id": "bigint", "project": "string", "file_id": "bigint", "node_type": "string", "name": "string", "path": "string", "language": "string",
    "line_start": "int", "line_end": "int", "col_start": "int", "col_end": "int", "signature": "string", "doc": "string", "visibility": "string",
    "is_public": "boolean", "is_async": "boolean", "is_static": "boolean", "is_const": "boolean", "is_test": "boolean", "is_cli": "boolean", "deprecated": "boolean",
    "return_type": "string", "param_count": "int", "attributes": "array<string>", "route": "string", "http_method": "string",
    "unresolved_calls": "array<string>", "complexity": "int", "complexity_branches": "int", "complexity_loops": "int", "complexity_logical_ops": "int",
    "complexity_nesting": "int", "complexity_exceptions": "int", "complexity_early_returns": "int",
}
#: Other names under which indexers store a property, tried in order.
_ALIASES = {"doc": ["doc", "docstring"], "line_start": ["line_start", "start_line"], "line_end": ["line_end", "end_line"], "col_start": ["col_start", "start_col"], "col_end": ["col_end", "end_col"]}
#: What accessors give for a missing position.
_DEFAULTS = {"line_start": 0, "line_end": 0, "col_start": 0, "col_end": 10_000}


def _string_list(df: DataFrame, name: str) -> Column:
    """A string list may be stored as one comma-separated string."""
    return F.split(name, ",") if dict(df.dtypes)[name] == "string" else F.col(name)


def _pick(df: DataFrame, name: str, kind: str) -> Column:
    found = [_string_list(df, a) if kind.startswith("array") else F.col(a).cast(kind) for a in _ALIASES.get(name, [name]) if a in df.columns]
    default = [F.lit(_DEFAULTS[name])] if name in _DEFAULTS else []
    return (F.coalesce(*found, *default) if found or default else F.lit(None).cast(kind)).alias(name)


def nodes_of(raw: DataFrame) -> DataFrame:
    """Nodes with the columns of NODE_COLUMNS, one row per node_id: the last indexed, then the first by name and line.

    Rows without node_id are dropped. is_public falls back to ``exported``, then to a visibility of public or pub; a node without
    any visibility information is public. Other columns are dropped.
    """
    if "indexed_at" in raw.columns:
        w = Window.partitionBy("node_id").orderBy(F.desc_nulls_last("indexed_at"), F.asc_nulls_first("name"), F.asc_nulls_first("line_start"))
        raw = raw.withColumn("_version", F.row_number().over(w)).where("_version = 1")
    else:
        raw = raw.dropDuplicates(["node_id"])
    out = raw.where("node_id IS NOT NULL").select(*[_pick(raw, n, k) for n, k in NODE_COLUMNS.items()], *([F.col("exported").alias("_exported")] if "exported" in raw.columns else []))
    public = [F.col("is_public")] + ([F.col("_exported")] if "_exported" in out.columns else []) + [F.coalesce("visibility", F.lit("public")).isin("public", "pub")]
    return out.withColumn("is_public", F.coalesce(*public)).drop("_exported")


def edges_of(raw: DataFrame) -> DataFrame:
    """(edge_id, project, src, dst, edge_type, resolved_by): one row per edge_id, the last seen; rows without an end are dropped, and types
    get their canonical spelling whatever their case."""
    canonical = F.create_map(*[F.lit(x) for t in EDGE_TYPES for x in (t.lower(), t)])
    kind = F.coalesce(F.try_element_at(canonical, F.lower("edge_type")), F.col("edge_type"))
    extra = [c if c in raw.columns else F.lit(None).cast("string").alias(c) for c in ("project", "resolved_by")]
    rows = raw.where("src IS NOT NULL AND dst IS NOT NULL")
    if "seen_at" in raw.columns:
        w = Window.partitionBy("edge_id").orderBy(F.desc_nulls_last("seen_at"), "src", "dst")
        rows = rows.withColumn("_version", F.row_number().over(w)).where("_version = 1")
    return rows.select("edge_id", extra[0], "src", "dst", kind.alias("edge_type"), extra[1])


#: The same projections as SQL, for oracles: common table expressions n and e.
SQL_GRAPH = """
n AS (
    SELECT * REPLACE (coalesce(is_public, coalesce(visibility, 'public') IN ('public', 'pub')) AS is_public, coalesce(line_start, 0) AS line_start, coalesce(line_end, 0) AS line_end)
    FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY indexed_at DESC NULLS LAST, name NULLS FIRST, line_start NULLS FIRST) AS _version FROM nodes WHERE node_id IS NOT NULL)
    WHERE _version = 1
),
e AS (
    SELECT edge_id, project, src, dst, CASE lower(edge_type) WHEN 'calls' THEN 'Calls' WHEN 'imports' THEN 'Imports' WHEN 'references' THEN 'References' WHEN 'contains' THEN 'Contains' ELSE edge_type END AS edge_type, resolved_by
    FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY seen_at DESC NULLS LAST, src, dst) AS _version FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL)
    WHERE _version = 1
)
"""
