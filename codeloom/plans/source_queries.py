"""Queries of sources, the store and change streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import metrics
from codeloom.plans.registry import edges, nodes, query
from codeloom.session import table
from codeloom.sources import files
from codeloom.streaming import watch


@query(
    """WITH p AS (SELECT DISTINCT path, size_bytes FROM source_files) SELECT path FROM p WHERE regexp_matches(lower(path), '\\.(py|js|ts|go|java|rs|c)$') AND coalesce(size_bytes, 0) <= 1048576
    AND NOT list_has_any(string_split(path, '/'), ['node_modules', 'target', 'dist', 'build', 'out', '.git', '__pycache__', 'vendor', 'DerivedData', 'tmp', 'coverage', 'htmlcov', 'results', 'logs', 'third_party'])
    AND len(list_filter(string_split(path, '/'), lambda x: starts_with(x, '.'))) = 0""",
    graph=False,
)
def s1_scan_files(spark, folder):
    paths = table(spark, folder, "source_files").select("path", "size_bytes").distinct()
    return files.scan_files(paths, exclude=["third_party"], max_files=None).select("path")


@query()
def s3_parse_files(spark, folder):
    return files.parse_files(table(spark, folder, "source_files").select("path", "code")).drop("ms")


@query()
def s6_parser_metrics(spark, folder):
    parsed = files.parse_files(table(spark, folder, "source_files").select("path", "code"))
    return metrics.parser_metrics(files.parse_results(parsed))


@query(
    """WITH r AS (SELECT coalesce(language, 'none') AS language, code IS NOT NULL AS ok, size_bytes AS entities, len(path) AS relations, size_bytes / 1000.0 AS ms FROM source_files WHERE size_bytes IS NOT NULL)
    SELECT language, count(*) AS attempted, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, CAST(sum(entities) AS BIGINT) AS entities, CAST(sum(relations) AS BIGINT) AS relations, round(sum(ms), 3) AS total_ms, round(avg(ms), 6) AS average_ms,
    count(*) FILTER (ok) / count(*) AS rate FROM r GROUP BY ROLLUP (language)""",
    graph=False,
)
def s6_metrics_of_results(spark, folder):
    """Results made of the files' sizes, as those of a parser depend on the clock."""
    f = table(spark, folder, "source_files").where("size_bytes IS NOT NULL")
    results = f.select(F.coalesce("language", F.lit("none")).alias("language"), F.col("code").isNotNull().alias("ok"), F.col("size_bytes").alias("entities"), F.length("path").alias("relations"), (F.col("size_bytes") / 1000.0).alias("ms"))
    return metrics.parser_metrics(results).withColumns({"total_ms": F.round("total_ms", 3), "average_ms": F.round("average_ms", 6)})


@query()
def a9_all_phases(spark, folder):
    """The graph of all files: imported symbols, calls, type references and ancestors that names lead to, by type."""
    from codeloom.session import Scratch

    parsed = Scratch(spark, "index").cut(files.parse_files(table(spark, folder, "source_files").where("code IS NOT NULL").select(F.concat_ws("/", "project", "path").alias("path"), "code").distinct()))
    return files.graph_of(parsed)[1].groupBy("edge_type").agg(F.count("*").alias("edges"))


_CHANGED = "changed AS (SELECT DISTINCT path FROM n WHERE node_type = 'Class')"


@query(f"WITH {_CHANGED} SELECT node_id, path FROM n WHERE path IS NULL OR path NOT IN (SELECT path FROM changed WHERE path IS NOT NULL)")
def s9_kept_nodes(spark, folder):
    n, e = nodes(spark, folder), edges(spark, folder)
    changed = n.where("node_type = 'Class'").select("path").distinct()
    return files.replace_files(n, e, n.limit(0), changed)[0].select("node_id", "path")


@query(f"WITH {_CHANGED}, gone AS (SELECT node_id FROM n WHERE path IN (SELECT path FROM changed)) SELECT edge_id FROM e WHERE src NOT IN (SELECT node_id FROM gone) AND dst NOT IN (SELECT node_id FROM gone)")
def s9_kept_edges(spark, folder):
    n, e = nodes(spark, folder), edges(spark, folder)
    changed = n.where("node_type = 'Class'").select("path").distinct()
    return files.replace_files(n, e, n.limit(0), changed)[1].select("edge_id")


@query(
    """WITH a AS (SELECT DISTINCT project || '/' || path AS path, commit_hash AS h FROM source_files WHERE language IS NOT NULL), b AS (SELECT DISTINCT project || '/' || path AS path, CASE WHEN size_bytes > 2000 THEN 'new' ELSE commit_hash END AS h FROM source_files WHERE code IS NOT NULL)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'A' WHEN b.path IS NULL THEN 'D' ELSE 'M' END AS status FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h""",
    graph=False,
)
def s17_changes(spark, folder):
    """Two snapshots made of the files: the first has the labelled ones, the second those with code, of which the longer ones are new."""
    f = table(spark, folder, "source_files").select(F.concat_ws("/", "project", "path").alias("path"), F.col("commit_hash").alias("hash"), "language", "code", "size_bytes")
    old = f.where("language IS NOT NULL").select("path", "hash").distinct()
    new = f.where("code IS NOT NULL").select("path", F.when(F.col("size_bytes") > 2000, "new").otherwise(F.col("hash")).alias("hash")).distinct()
    return files.changes(old, new)


@query(
    "SELECT slug, 'ws' AS workspace, count(n.node_id) AS node_count, CAST(0 AS BIGINT) AS edge_count FROM projects p JOIN n ON n.project = p.slug GROUP BY slug"
)
def s12_projects(spark, folder):
    """The registry of a store into which every project was written twice, first as an empty one."""
    from codeloom.session import Scratch

    place = Scratch(spark, "store").root
    n = nodes(spark, folder)
    counts = table(spark, folder, "projects").join(n.groupBy(F.col("project").alias("slug")).agg(F.count("*").alias("node_count")), "slug")
    rows = counts.select("slug", F.lit("ws").alias("workspace"), "node_count", F.lit(0).cast("bigint").alias("edge_count"), F.lit("2025-01-02 00:00:00").cast("timestamp").alias("last_indexed"))
    before = rows.withColumns({"node_count": F.lit(0).cast("bigint"), "last_indexed": F.lit("2025-01-01 00:00:00").cast("timestamp")})
    rows.unionByName(before).write.mode("overwrite").parquet(f"{place}/projects")
    return files.list_projects(spark, place).drop("last_indexed")


@query("SELECT workspace, regexp_replace(lower(regexp_extract(workspace, '([^/]*)/?$', 1)), '[^a-z0-9]', '-', 'g') || '-' || right(md5(workspace), 4) AS slug FROM projects", graph=False)
def s13_slugs(spark, folder):
    return files.slugs(table(spark, folder, "projects"))


@query("SELECT 'node' AS kind, count(*) AS lines FROM n UNION ALL SELECT 'edge', count(*) FROM e")
def s_export_lines(spark, folder):
    return files.graph_json(nodes(spark, folder), edges(spark, folder)).groupBy("kind").agg(F.count("*").alias("lines"))


_RUNS = """s AS (SELECT user_id, event_type, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s)"""


@query(f"WITH {_RUNS} SELECT user_id AS path, arg_max(event_type, (ts, event_type)) AS kind, count(*) AS events, max(ts) + INTERVAL 6 HOUR AS ended FROM g GROUP BY user_id, run", graph=False)
def w1_debounce(spark, folder):
    """Events of a user as those of a path, with six hours of quiet."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("kind"), "ts")
    return watch.debounce(events, "6 hours")


@query(
    """WITH s AS (SELECT user_id % 10 AS repo, event_type AS c, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id % 10 ORDER BY ts)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY repo ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s), r AS (SELECT repo, arg_max(c, (ts, c)) AS c, max(ts) + INTERVAL 1 HOUR AS ended FROM g GROUP BY repo, run),
    b AS (SELECT *, lag(c) OVER (PARTITION BY repo ORDER BY ended) AS before FROM r) SELECT repo, c AS "commit", ended FROM b WHERE before IS DISTINCT FROM c""",
    graph=False,
)
def w3_branch_switches(spark, folder):
    heads = table(spark, folder, "events").select((F.col("user_id") % 10).alias("repo"), F.col("event_type").alias("commit"), "ts")
    return watch.branch_switches(heads, "1 hour")


@query(
    f"WITH {_RUNS}, r AS (SELECT user_id AS path, arg_max(event_type, (ts, event_type)) AS kind, count(*) AS events, max(ts) + INTERVAL 6 HOUR AS ended FROM g GROUP BY user_id, run) SELECT * FROM r WHERE ended <= (SELECT max(ts) - INTERVAL 10 SECOND FROM events)",
    graph=False,
)
def w1_debounce_stream(spark, folder):
    """The same as a stream over the whole table, run until all of it is read; runs the watermark has not passed are still open."""
    from codeloom.session import Scratch

    scratch = Scratch(spark, "watch")
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # The stream reads a folder: that of this one table.
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    events = events.select(F.col("user_id").alias("path"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    out = f"{scratch.root}/out"
    run = watch.debounce(events, "6 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{scratch.root}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("path bigint, kind string, events bigint, ended timestamp").parquet(out)
