"""Sources and sinks: source trees, the graph store, project registry, exports and incremental replacement."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.rules import LANGUAGES, SKIPPED_DIRECTORIES, language_of_path, project_slug
from codeloom.sources.parsers import SCHEMA, parse_frames

#: Limits of a scan.
MAX_DEPTH, MAX_FILES, MAX_KILOBYTES = 20, 5_000, 1_024


def scan_files(paths: DataFrame, root: str = "", exclude: list[str] | None = None, max_files: int | None = MAX_FILES, max_kb: int | None = MAX_KILOBYTES) -> DataFrame:
    """Rows of ``paths`` (path, size_bytes, ...) that an indexer reads: of a known language, not hidden, not in a skipped or excluded directory, not too deep or
    large; the first ``max_files`` by path. Excluded are names and globs over whole paths."""
    rel = F.regexp_replace("path", "^" + re.escape(root), "")
    parts = F.split(F.regexp_replace(rel, "^/+", ""), "/")
    names = [e for e in exclude or [] if not re.search(r"[*?/]", e)]
    globs = ["^" + re.escape(e).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$" for e in exclude or [] if re.search(r"[*?/]", e)]
    good = language_of_path(F.col("path")).isNotNull() & ~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in SKIPPED_DIRECTORIES + names])) & ~F.exists(parts, lambda p: p.startswith(".")) & (F.size(parts) - 1 <= MAX_DEPTH)
    for g in globs:
        good = good & ~rel.rlike(g) & ~F.exists(parts, lambda p, g=g: p.rlike(g))
    if max_kb is not None and "size_bytes" in paths.columns:
        good = good & (F.coalesce("size_bytes", F.lit(0)) <= max_kb * 1024)
    found = paths.where(good)
    return found.orderBy("path").limit(max_files) if max_files else found


def read_tree(spark: SparkSession, root: str, exclude: list[str] | None = None, max_files: int | None = MAX_FILES) -> DataFrame:
    """(path, size_bytes, code, modified_at) of the source files below a folder; skipped files are pruned before their content is read."""
    pattern = "*.{" + ",".join(e for exts in LANGUAGES.values() for e in exts.split()) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    flat = found.select(F.regexp_replace("path", "^file:(?://)?", "").alias("path"), F.col("length").alias("size_bytes"), F.col("content"), F.col("modificationTime").alias("modified_at"))
    return scan_files(flat, root.rstrip("/"), exclude, max_files).withColumn("code", F.decode("content", "utf-8")).drop("content")


# Extraction -------------------------------------------------------------------------------------------------------


def parse_files(files: DataFrame, parser=parse_frames) -> DataFrame:
    """Symbols of (path, code) with what ``parsers.SCHEMA`` lists and a node_id; a CodeFile for every file of a known language, with its imports.

    ``parser`` is any function over batches of (path, language, code) with the same output; one for a language of its own may be plugged in.
    """
    known = files.select("path", language_of_path(F.col("path")).alias("language"), "code").where("language IS NOT NULL AND path IS NOT NULL")
    return known.mapInPandas(parser, SCHEMA).withColumn("node_id", F.xxhash64("path", "node_type", "name", "line_start"))


def contains_edges(symbols: DataFrame) -> DataFrame:
    """(src, dst, edge_type): files and what they hold, classes and their members."""
    files = symbols.where("node_type = 'CodeFile'").select(F.col("node_id").alias("src"), "path")
    in_file = symbols.where("node_type NOT IN ('CodeFile', 'Module') OR line_start > 0").where("node_type <> 'CodeFile'").select(F.col("node_id").alias("dst"), "path").join(files, "path").select("src", "dst")
    in_class = symbols.where("holder IS NOT NULL").select(F.xxhash64("path", "holder.node_type", "holder.name", "holder.line_start").alias("src"), F.col("node_id").alias("dst"))
    return in_file.unionByName(in_class).distinct().withColumn("edge_type", F.lit("Contains"))


#: Files that stand for their folder.
_FOLDER_FILES = ["index", "__init__", "mod"]
#: Languages whose modules are paths with dots.
_DOTTED = ["python", "java", "kotlin", "ruby"]


def import_edges(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_id, name) of the imported modules, and (src, dst, edge_type) from files to them and to the files they mean.

    A relative import means the file at its path, of any extension; a dotted one a file whose path ends with it, the first by path.
    """
    files = symbols.where("node_type = 'CodeFile'")
    asked = files.select(F.col("node_id").alias("src"), "language", F.explode("imports").alias("i")).select("src", "language", "i.module", "i.target").where("module <> ''").distinct()
    module_id = F.xxhash64(F.lit("Module"), "module")
    modules = asked.select(module_id.alias("node_id"), F.col("module").alias("name")).distinct()
    to_modules = asked.select("src", module_id.alias("dst"))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    base = F.regexp_extract("stem", r"([^/]*)$", 1)
    folder = F.regexp_replace("stem", r"/?[^/]*$", "")
    named = files.select(F.col("node_id").alias("dst"), F.col("language").alias("of"), "path", stem.alias("stem"))
    named = named.unionByName(named.where(base.isin(_FOLDER_FILES)).withColumn("stem", folder))
    relative = asked.where("target IS NOT NULL").join(named, F.col("target") == F.col("stem")).select("src", "module", "dst", "path")
    dotted = asked.where(F.col("target").isNull() & F.col("language").isin(_DOTTED)).withColumn("place", F.regexp_replace("module", r"[.]", "/")).withColumn("tail", F.regexp_extract("place", r"([^/]*)$", 1))
    ends = (F.col("stem") == F.col("place")) | F.col("stem").endswith(F.concat(F.lit("/"), F.col("place")))
    far = dotted.join(named.withColumn("tail", base), "tail").where(ends & (F.col("language") == F.col("of"))).select("src", "module", "dst", "path")
    to_files = relative.unionByName(far).groupBy("src", "module").agg(F.min_by("dst", "path").alias("dst")).select("src", "dst").where("src <> dst")
    return modules, to_modules.unionByName(to_files).distinct().withColumn("edge_type", F.lit("Imports"))


def graph_of(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, in normal form, of parsed files: what they contain and import, and what names in one file mean in another: imported
    symbols, calls, type references and ancestors."""
    from codeloom.operators.search import resolve
    from codeloom.schema import edges_of, nodes_of

    modules, imported = import_edges(symbols)
    outside = modules.withColumns({"node_type": F.lit("Module"), "line_start": F.lit(0)})
    nodes = nodes_of(symbols.unionByName(outside, allowMissingColumns=True))

    def numbered(edges: DataFrame) -> DataFrame:
        return edges_of(edges.withColumn("edge_id", F.xxhash64("src", "dst", "edge_type")))

    edges = numbered(contains_edges(symbols).unionByName(imported))
    return nodes, edges.unionByName(numbered(resolve(nodes, edges, wanted_names(symbols))))


def wanted_names(symbols: DataFrame) -> DataFrame:
    """(node_id, name, edge_type): what files and symbols name without saying where it is."""
    at = F.col("node_id")
    parts = [
        symbols.where("node_type = 'CodeFile'").select(at, F.explode(F.flatten("imports.names")).alias("name"), F.lit("Imports").alias("edge_type")),
        symbols.where("node_type = 'Function'").select(at, F.explode("unresolved_calls").alias("name"), F.lit("Calls").alias("edge_type")),
        symbols.select(at, F.explode("unresolved_type_refs").alias("name"), F.lit("References").alias("edge_type")),
        symbols.select(at, F.explode("extends").alias("name"), F.lit("Extends").alias("edge_type")),
        symbols.select(at, F.explode("implements").alias("name"), F.lit("Implements").alias("edge_type")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def parse_results(symbols: DataFrame) -> DataFrame:
    """(language, ok, entities, relations, ms) by file, for ``parser_metrics``."""
    own = F.col("node_type") == "CodeFile"
    return symbols.groupBy("path", "language").agg(F.bool_and("ok").alias("ok"), F.count_if(~own).alias("entities"), F.sum(F.coalesce(F.size("unresolved_calls"), F.lit(0)) + F.coalesce(F.size("imports"), F.lit(0))).alias("relations"), F.sum("ms").alias("ms")).drop("path")


# Store --------------------------------------------------------------------------------------------------------------


def replace_files(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the files of ``changed`` (path) were indexed anew: their old nodes and all edges of these go."""
    paths = changed.select("path").distinct()
    gone = nodes.join(paths, "path", "left_semi").select("node_id").distinct()
    kept = nodes.join(paths, "path", "left_anti").unionByName(new_nodes, allowMissingColumns=True)
    left = edges.join(gone.withColumnRenamed("node_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return kept, left


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): A, D or M between two snapshots (path, hash)."""
    both = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("path", F.when(F.col("a").isNull(), "A").when(F.col("b").isNull(), "D").otherwise("M").alias("status"))


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str, project: str, workspace: str) -> None:
    """Writes a project's partition of the store and its row of the registry; other projects' partitions stay."""
    spark = nodes.sparkSession
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumn("project", F.lit(project)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(f"{folder}/{name}")
    row = spark.read.parquet(f"{folder}/nodes").where(F.col("project") == project).agg(F.count("*").alias("node_count"))
    edge_row = spark.read.parquet(f"{folder}/edges").where(F.col("project") == project).agg(F.count("*").alias("edge_count"))
    full = row.crossJoin(edge_row).select(F.lit(project).alias("slug"), F.lit(workspace).alias("workspace"), "node_count", "edge_count", F.current_timestamp().alias("last_indexed"))
    full.write.mode("append").parquet(f"{folder}/projects")


def load_graph(spark: SparkSession, folder: str, project: str) -> tuple[DataFrame, DataFrame]:
    """A project's nodes and edges; only its partition is read."""
    return tuple(spark.read.parquet(f"{folder}/{name}").where(F.col("project") == project) for name in ("nodes", "edges"))


def list_projects(spark: SparkSession, folder: str) -> DataFrame:
    """The last registry row of each project."""
    rows = spark.read.parquet(f"{folder}/projects")
    return rows.groupBy("slug").agg(F.max_by(F.struct("workspace", "node_count", "edge_count", "last_indexed"), "last_indexed").alias("r")).select("slug", "r.*")


def slugs(projects: DataFrame) -> DataFrame:
    return projects.select("workspace", project_slug(F.col("workspace")).alias("slug"))


def export_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): the lines of a graph's export."""
    a = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    return a.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("json")))


def graph_svg(nodes: list[tuple[int, str]], edges: list[tuple[int, int]], size: int = 640) -> str:
    """A drawing of a small graph, nodes on a circle."""
    from html import escape
    from math import cos, pi, sin

    n = max(1, len(nodes))
    at = {i: (size / 2 + size * 0.4 * cos(2 * pi * k / n), size / 2 + size * 0.4 * sin(2 * pi * k / n)) for k, (i, _) in enumerate(nodes)}
    lines = [f'<line x1="{at[a][0]:.1f}" y1="{at[a][1]:.1f}" x2="{at[b][0]:.1f}" y2="{at[b][1]:.1f}" stroke="#999"/>' for a, b in edges if a in at and b in at]
    dots = [f'<circle cx="{at[i][0]:.1f}" cy="{at[i][1]:.1f}" r="6" fill="#369"/><text x="{at[i][0] + 8:.1f}" y="{at[i][1]:.1f}" font-size="10">{escape(name)}</text>' for i, name in nodes]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">{"".join(lines + dots)}</svg>'
