"""Queries over the symbol graph. Those that speak of one symbol ask for the one most edges lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import graph
from codeloom.plans.registry import edges, nodes, query

_CALLS = "calls AS (SELECT DISTINCT src, dst FROM e WHERE edge_type = 'Calls')"
_TOP = "top AS (SELECT dst AS id FROM e JOIN n ON n.node_id = e.dst WHERE e.edge_type = 'Calls' AND n.node_type = 'Function' GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"


def _functions(spark: SparkSession, folder: str) -> DataFrame:
    return nodes(spark, folder).where("node_type = 'Function'").select(F.col("node_id").alias("start"))


def most_called(n: DataFrame, e: DataFrame) -> int:
    functions = n.where("node_type = 'Function'").select(F.col("node_id").alias("dst"))
    return e.where("edge_type = 'Calls'").join(functions, "dst", "left_semi").groupBy("dst").count().orderBy(F.desc("count"), "dst").first()["dst"]


@query("SELECT node_type, count(*) AS symbols FROM n GROUP BY node_type")
def m6_graph_stats(spark, folder):
    return graph.symbols_by(nodes(spark, folder), "node_type")


@query("SELECT count(*) AS symbols, count(DISTINCT path) AS files, count(DISTINCT name) AS names FROM n")
def m8_index_stats(spark, folder):
    return nodes(spark, folder).agg(F.count("*").alias("symbols"), F.count_distinct("path").alias("files"), F.count_distinct("name").alias("names"))


@query("SELECT path, count(*) AS symbols FROM n GROUP BY path")
def a5_symbols_by_file(spark, folder):
    return graph.symbols_by(nodes(spark, folder), "path")


@query(
    f"""WITH {_CALLS}, ends AS (SELECT dst AS node_id, 1 AS i, 0 AS o FROM calls UNION ALL SELECT src, 0, 1 FROM calls)
    SELECT node_id, CAST(sum(i) AS BIGINT) AS callers, CAST(sum(o) AS BIGINT) AS callees FROM ends GROUP BY node_id"""
)
def g1_call_adjacency(spark, folder):
    return graph.call_adjacency(edges(spark, folder))


@query("SELECT DISTINCT n.name AS module, e.src AS node_id FROM e JOIN n ON n.node_id = e.dst WHERE e.edge_type = 'Imports' AND n.name <> ''")
def g1_import_index(spark, folder):
    return graph.import_index(nodes(spark, folder), edges(spark, folder))


@query(
    f"""WITH {_CALLS},
    walk(start, node, depth) AS (
        SELECT n.node_id, c.dst, 1 FROM n JOIN calls c ON c.src = n.node_id WHERE n.node_type = 'Function'
        UNION
        SELECT w.start, c.dst, w.depth + 1 FROM walk w JOIN calls c ON c.src = w.node WHERE w.depth < 3
    )
    SELECT start, node, min(depth) AS depth FROM walk WHERE node IN (SELECT node_id FROM n WHERE name IS NOT NULL) GROUP BY start, node"""
)
def g2_call_chain_depth3(spark, folder):
    return graph.call_chain(nodes(spark, folder), edges(spark, folder), _functions(spark, folder), 3)


@query(
    f"""WITH {_CALLS},
    walk(start, node, depth) AS (
        SELECT n.node_id, c.src, 1 FROM n JOIN calls c ON c.dst = n.node_id WHERE n.node_type = 'Function'
        UNION
        SELECT w.start, c.src, w.depth + 1 FROM walk w JOIN calls c ON c.dst = w.node WHERE w.depth < 2
    )
    SELECT start, node, min(depth) AS depth FROM walk GROUP BY start, node"""
)
def g3_callers_depth2(spark, folder):
    return graph.reach(graph.links(edges(spark, folder), ["Calls"], "incoming"), _functions(spark, folder), 2)


@query(
    f"""WITH {_CALLS}, named AS (SELECT node_id, name FROM n WHERE name IS NOT NULL), fns AS (SELECT node_id, name FROM n WHERE node_type = 'Function' AND name IS NOT NULL),
    own AS (SELECT s.node_id AS start, c.src AS node, s.node_id AS via FROM n s JOIN calls c ON c.dst = s.node_id JOIN named m ON m.node_id = c.src WHERE s.node_type = 'Function'),
    twins AS (SELECT a.node_id AS start, b.node_id AS via FROM fns a JOIN fns b ON a.name = b.name AND a.node_id <> b.node_id WHERE a.node_id NOT IN (SELECT start FROM own))
    SELECT start, node, 1 AS depth, via FROM own UNION ALL SELECT t.start, c.src, 1, t.via FROM twins t JOIN calls c ON c.dst = t.via JOIN named m ON m.node_id = c.src"""
)
def g3_callers_with_twins(spark, folder):
    return graph.callers(nodes(spark, folder), edges(spark, folder), _functions(spark, folder))


@query(
    f"""WITH {_CALLS}, named AS (SELECT node_id, name FROM n WHERE name IS NOT NULL), fns AS (SELECT node_id, name FROM n WHERE node_type = 'Function' AND name IS NOT NULL),
    own AS (SELECT s.node_id AS start, c.dst AS node, s.node_id AS via FROM n s JOIN calls c ON c.src = s.node_id JOIN named m ON m.node_id = c.dst WHERE s.node_type = 'Function'),
    twins AS (SELECT a.node_id AS start, b.node_id AS via FROM fns a JOIN fns b ON a.name = b.name AND a.node_id <> b.node_id WHERE a.node_id NOT IN (SELECT start FROM own))
    SELECT start, node, 1 AS depth, via FROM own UNION ALL SELECT t.start, c.dst, 1, t.via FROM twins t JOIN calls c ON c.src = t.via JOIN named m ON m.node_id = c.dst"""
)
def g3_callees_with_twins(spark, folder):
    return graph.callers(nodes(spark, folder), edges(spark, folder), _functions(spark, folder), direction="outgoing")


@query(
    f"""WITH {_TOP},
    l1 AS (SELECT * FROM (SELECT e.src AS node, [id, e.src] AS path, [0, e.edge_id] AS rank, e.edge_type, row_number() OVER (PARTITION BY e.src ORDER BY e.edge_id) AS k FROM e JOIN top ON e.dst = id WHERE e.src <> id) WHERE k = 1),
    l2 AS (SELECT * FROM (SELECT e.src AS node, list_append(l1.path, e.src) AS path, list_append(l1.rank, e.edge_id) AS rank, e.edge_type, row_number() OVER (PARTITION BY e.src ORDER BY l1.rank, e.edge_id) AS k FROM e JOIN l1 ON e.dst = l1.node
        WHERE e.src NOT IN (SELECT id FROM top) AND e.src NOT IN (SELECT node FROM l1)) WHERE k = 1),
    l3 AS (SELECT * FROM (SELECT e.src AS node, list_append(l2.path, e.src) AS path, list_append(l2.rank, e.edge_id) AS rank, e.edge_type, row_number() OVER (PARTITION BY e.src ORDER BY l2.rank, e.edge_id) AS k FROM e JOIN l2 ON e.dst = l2.node
        WHERE e.src NOT IN (SELECT id FROM top) AND e.src NOT IN (SELECT node FROM l1) AND e.src NOT IN (SELECT node FROM l2)) WHERE k = 1),
    every AS (SELECT *, 1 AS depth FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3)
    SELECT v.node AS node_id, n.name, n.node_type, v.depth, v.edge_type, v.path FROM every v JOIN n ON n.node_id = v.node ORDER BY v.depth, v.rank LIMIT 100"""
)
def g4_traverse(spark, folder):
    n, e = nodes(spark, folder), edges(spark, folder)
    return graph.traverse(n, e, most_called(n, e), depth=3, direction="incoming")


@query(
    f"""WITH {_CALLS}, {_TOP},
    up(node, depth) AS (SELECT c.src, 1 FROM calls c JOIN top ON c.dst = top.id UNION SELECT c.src, u.depth + 1 FROM up u JOIN calls c ON c.dst = u.node WHERE u.depth < 3),
    down(node, depth) AS (SELECT c.dst, 1 FROM calls c JOIN top ON c.src = top.id UNION SELECT c.dst, d.depth + 1 FROM down d JOIN calls c ON c.src = d.node WHERE d.depth < 3),
    sides AS (SELECT node, min(depth) AS depth, 0 AS o, 'caller' AS relation FROM up GROUP BY node UNION ALL SELECT node, min(depth), 1, 'callee' FROM down GROUP BY node),
    one AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY o) AS k FROM sides WHERE node <> (SELECT id FROM top))
    SELECT one.node AS node_id, n.name, one.relation, one.depth FROM one JOIN n ON n.node_id = one.node WHERE k = 1 AND n.name IS NOT NULL"""
)
def g5_call_graph(spark, folder):
    n, e = nodes(spark, folder), edges(spark, folder)
    return graph.call_graph(n, e, most_called(n, e))


_FILE = "home AS (SELECT n.path, count(*) AS k FROM e JOIN n ON n.node_id = e.dst WHERE e.edge_type = 'Imports' AND n.node_type = 'CodeFile' GROUP BY n.path ORDER BY k DESC, n.path LIMIT 1)"
_REACHED = f"""{_FILE}, starts AS (SELECT node_id FROM n WHERE node_type = 'CodeFile' AND path = (SELECT path FROM home)), imports AS (SELECT DISTINCT src, dst FROM e WHERE edge_type = 'Imports'),
    up(node, depth) AS (SELECT i.src, 1 FROM imports i JOIN starts s ON i.dst = s.node_id UNION SELECT i.src, u.depth + 1 FROM up u JOIN imports i ON i.dst = u.node WHERE u.depth < 3),
    down(node, depth) AS (SELECT i.dst, 1 FROM imports i JOIN starts s ON i.src = s.node_id UNION SELECT i.dst, d.depth + 1 FROM down d JOIN imports i ON i.src = d.node WHERE d.depth < 3),
    members AS (SELECT n.node_id, n.name, n.path FROM n WHERE n.node_id IN (SELECT node FROM up UNION SELECT node FROM down UNION SELECT node_id FROM starts))"""


def most_imported(n: DataFrame, e: DataFrame) -> str:
    files = n.where("node_type = 'CodeFile'").select(F.col("node_id").alias("dst"), "path")
    return e.where("edge_type = 'Imports'").join(files, "dst").groupBy("path").count().orderBy(F.desc("count"), "path").first()["path"]


@query(f"WITH {_REACHED} SELECT * FROM members")
def g6_dependency_graph(spark, folder):
    n, e = nodes(spark, folder), edges(spark, folder)
    return graph.dependency_nodes(n, e, most_imported(n, e))


@query(f"WITH {_REACHED} SELECT i.src, i.dst, 'import' AS label FROM imports i WHERE i.src IN (SELECT node_id FROM members) AND i.dst IN (SELECT node_id FROM members)")
def g6_dependency_edges(spark, folder):
    n, e = nodes(spark, folder), edges(spark, folder)
    return graph.dependency_edges(e, graph.dependency_nodes(n, e, most_imported(n, e)))


@query(
    """SELECT e.dst AS target, e.src AS node_id, e.edge_id, n.path, CASE e.edge_type WHEN 'Calls' THEN 'caller' WHEN 'Extends' THEN 'subclass' WHEN 'Implements' THEN 'implementation' ELSE 'reference' END AS impact,
    'breaking' AS severity FROM e JOIN n ON n.node_id = e.src WHERE e.dst IN (SELECT node_id FROM n WHERE node_type = 'Function')"""
)
def g7_impact_direct(spark, folder):
    targets = _functions(spark, folder).withColumnRenamed("start", "target")
    return graph.direct_impact(nodes(spark, folder), edges(spark, folder), targets, "delete")


@query(
    f"""WITH {_CALLS},
    walk(start, node, depth) AS (
        SELECT n.node_id, c.src, 1 FROM n JOIN calls c ON c.dst = n.node_id WHERE n.node_type = 'Function'
        UNION
        SELECT w.start, c.src, w.depth + 1 FROM walk w JOIN calls c ON c.dst = w.node WHERE w.depth < 3
    ),
    counts AS (SELECT start, count(DISTINCT node) AS k FROM walk GROUP BY start)
    SELECT n.node_id AS target, coalesce(k, 0) AS callers, CASE WHEN k > 10 THEN 'critical' WHEN k > 0 THEN 'high' ELSE 'low' END AS risk FROM n LEFT JOIN counts ON start = node_id WHERE node_type = 'Function'"""
)
def g7_impact_risk(spark, folder):
    return graph.impact_risk(edges(spark, folder), _functions(spark, folder).withColumnRenamed("start", "target"), "delete")


@query(
    f"""WITH {_TOP}, steps AS (SELECT DISTINCT dst AS at_, src AS to_ FROM e), direct AS (SELECT DISTINCT e.src AS node_id, n.path FROM e JOIN top ON e.dst = top.id JOIN n ON n.node_id = e.src),
    one AS (SELECT DISTINCT s.to_ AS node FROM direct d JOIN steps s ON s.at_ = d.node_id), two AS (SELECT DISTINCT s.to_ AS node FROM one o JOIN steps s ON s.at_ = o.node),
    around AS (SELECT node FROM one UNION SELECT node FROM two)
    SELECT (SELECT id FROM top) AS target, n.path, min(n.node_id) AS node_id FROM around a JOIN n ON n.node_id = a.node WHERE a.node <> (SELECT id FROM top) AND n.path NOT IN (SELECT path FROM direct WHERE path IS NOT NULL) GROUP BY n.path"""
)
def g7_impact_indirect(spark, folder):
    n, e = nodes(spark, folder), edges(spark, folder)
    target = spark.createDataFrame([(most_called(n, e),)], "target bigint")
    return graph.indirect_impact(n, e, graph.direct_impact(n, e, target, "delete"))


_UNRESOLVED = "unresolved AS (SELECT DISTINCT e.src AS node_id, n.name FROM e JOIN n ON n.node_id = e.dst WHERE e.edge_type = 'Calls' AND e.resolved_by = 'name')"


def with_unresolved(n: DataFrame, e: DataFrame) -> DataFrame:
    """Nodes whose unresolved calls are the callees that the indexer found by bare name only."""
    names = e.where("edge_type = 'Calls' AND resolved_by = 'name'").join(n.select(F.col("node_id").alias("dst"), F.col("name").alias("callee")), "dst").groupBy(F.col("src").alias("node_id")).agg(F.collect_set("callee").alias("found"))
    return n.drop("unresolved_calls").join(names.withColumnRenamed("found", "unresolved_calls"), "node_id", "left")


@query(
    f"""WITH {_UNRESOLVED}
    SELECT DISTINCT d.project, d.name, u.node_id AS consumer FROM unresolved u JOIN n c ON c.node_id = u.node_id JOIN n d ON d.name = u.name AND d.node_type = 'Function' AND d.name <> '' WHERE d.project <> c.project"""
)
def g8_consumers(spark, folder):
    return graph.consumers(with_unresolved(nodes(spark, folder), edges(spark, folder)))


@query(
    """WITH calls AS (SELECT DISTINCT src, dst FROM e WHERE edge_type = 'Calls'), pairs AS (SELECT DISTINCT src, dst FROM e),
    testers AS (SELECT node_id FROM n WHERE starts_with(name, 'test_') OR ends_with(name, '_test') OR contains(name, 'test ') OR contains(path, '/test')),
    imp AS (SELECT src AS node_id, dst AS other FROM e WHERE edge_type IN ('Imports', 'ImportsFrom') UNION ALL SELECT dst, src FROM e WHERE edge_type IN ('Imports', 'ImportsFrom'))
    SELECT n.node_id, (SELECT count(*) FROM calls c WHERE c.dst = n.node_id) AS callers, (SELECT count(*) FROM calls c WHERE c.src = n.node_id) AS callees, (SELECT count(*) FROM pairs p WHERE p.dst = n.node_id) AS referrers,
    (SELECT count(DISTINCT m.name) FROM imp i JOIN n m ON m.node_id = i.other WHERE i.node_id = n.node_id AND m.name <> '') AS imports, greatest(line_end - line_start + 1, 1) AS loc,
    EXISTS (SELECT 1 FROM calls c WHERE c.dst = n.node_id AND c.src IN (SELECT node_id FROM testers)) AS has_tests, is_public, false AS deprecated, CAST(NULL AS INT) AS complexity
    FROM n WHERE node_type = 'Function' AND name IS NOT NULL"""
)
def g9_symbol_info(spark, folder):
    return graph.symbol_info(nodes(spark, folder), edges(spark, folder))


@query(
    """WITH ends AS (SELECT src AS node_id, CASE WHEN edge_type = 'Calls' THEN 'callee' ELSE 'dependency' END AS relation, dst AS other FROM e WHERE edge_type IN ('Calls', 'Imports', 'ImportsFrom')
        UNION SELECT dst, CASE WHEN edge_type = 'Calls' THEN 'caller' ELSE 'dependent' END, src FROM e WHERE edge_type IN ('Calls', 'Imports', 'ImportsFrom'))
    SELECT ends.node_id, relation, other, n.name FROM ends JOIN n ON n.node_id = other WHERE n.name <> ''"""
)
def g9_symbol_neighbours(spark, folder):
    return graph.symbol_neighbours(nodes(spark, folder), edges(spark, folder))


@query(
    """SELECT node_id, concat_ws(chr(10) || chr(10), coalesce(signature, concat_ws(' ', lower(node_type), name)), CASE WHEN trim(docstring, ' ') <> '' THEN docstring END) AS text FROM n WHERE name IS NOT NULL"""
)
def g11_hover(spark, folder):
    return graph.hover(nodes(spark, folder))


@query(
    """WITH home AS (SELECT path FROM n WHERE node_type = 'Class' AND path IS NOT NULL GROUP BY path ORDER BY count(*) DESC, path LIMIT 1), held AS (SELECT e.dst, max(e.src) AS parent FROM e JOIN n h ON h.node_id = e.src WHERE e.edge_type = 'Contains' AND h.node_type IN ('Class', 'Interface', 'Module')
        AND h.path = (SELECT path FROM home) GROUP BY e.dst)
    SELECT n.node_id, held.parent, n.name, n.node_type, n.line_start, n.line_end FROM n LEFT JOIN held ON held.dst = n.node_id WHERE n.path = (SELECT path FROM home) AND n.node_type <> 'CodeFile' AND n.name IS NOT NULL"""
)
def g11_document_symbols(spark, folder):
    n = nodes(spark, folder)
    home = n.where("node_type = 'Class' AND path IS NOT NULL").groupBy("path").count().orderBy(F.desc("count"), "path").first()
    return graph.document_symbols(n, edges(spark, folder), home["path"] if home else "")


@query(f"WITH {_TOP} SELECT n.node_id, n.name, n.path, n.line_start, count(*) AS calls FROM e JOIN top ON e.dst = id JOIN n ON n.node_id = e.src WHERE e.edge_type = 'Calls' AND n.name IS NOT NULL GROUP BY ALL")
def g11_call_hierarchy(spark, folder):
    n, e = nodes(spark, folder), edges(spark, folder)
    return graph.call_hierarchy(n, e, most_called(n, e))


@query(f"WITH {_TOP} SELECT e.edge_id, e.project, e.src, e.dst, e.edge_type, e.resolved_by FROM e, top WHERE e.src = top.id OR e.dst = top.id")
def g10_edges_around(spark, folder):
    n, e = nodes(spark, folder), edges(spark, folder)
    return graph.edges_around(e, most_called(n, e))


@query("SELECT src AS node_id, arg_min(dst, (edge_id, dst)) AS target FROM e WHERE edge_type IN ('Calls', 'References', 'Imports') GROUP BY src")
def g11_definitions(spark, folder):
    return graph.definitions(edges(spark, folder))


@query("SELECT DISTINCT dst AS node_id, src AS referrer FROM e")
def g11_references(spark, folder):
    return graph.references(edges(spark, folder))


_POSITIONS = "positions AS (SELECT node_id AS position_id, path, line_end + 2 AS line FROM n WHERE node_type = 'Function' AND path IS NOT NULL)"


@query(
    f"""WITH {_POSITIONS}, pairs AS (SELECT p.position_id, s.node_id, NOT (p.line BETWEEN s.line_start AND s.line_end) AS o,
        CASE WHEN p.line BETWEEN s.line_start AND s.line_end THEN s.line_end - s.line_start WHEN s.line_start > p.line THEN s.line_start - p.line ELSE p.line - s.line_end + 1000 END AS d
        FROM positions p JOIN n s ON s.path = p.path AND s.node_type <> 'CodeFile'),
    best AS (SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY o, d, node_id) AS k FROM pairs)
    SELECT position_id, node_id, o AS used_fallback FROM best WHERE k = 1"""
)
def g12_nearest_symbol(spark, folder):
    n = nodes(spark, folder)
    positions = n.where("node_type = 'Function' AND path IS NOT NULL").select(F.col("node_id").alias("position_id"), "path", (F.col("line_end") + 2).alias("line"))
    return graph.nearest_symbols(n, positions)


@query(
    """WITH positions AS (SELECT node_id AS position_id, path, line_start + 1 AS line, 5 AS column FROM n WHERE node_type = 'Function' AND path IS NOT NULL),
    pairs AS (SELECT p.position_id, s.node_id, (s.line_end - s.line_start) * 10000 + 10000 - 0 AS size FROM positions p JOIN n s ON s.path = p.path WHERE p.line BETWEEN s.line_start AND s.line_end),
    best AS (SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY size, node_id) AS k FROM pairs)
    SELECT position_id, node_id FROM best WHERE k = 1"""
)
def g13_at_position(spark, folder):
    n = nodes(spark, folder)
    positions = n.where("node_type = 'Function' AND path IS NOT NULL").select(F.col("node_id").alias("position_id"), "path", (F.col("line_start") + 1).alias("line"), F.lit(5).alias("column"))
    return graph.at_position(n.select("path", "node_id", "line_start", "line_end", "col_start", "col_end"), positions)


@query("SELECT node_id, path, greatest(line_start - 1, 0) AS line, greatest(CASE WHEN line_end > 0 THEN line_end ELSE line_start END - 1, 0) AS end_line, 0 AS \"column\", 10000 AS end_column FROM n WHERE path IS NOT NULL")
def g14_locations(spark, folder):
    return graph.locations(nodes(spark, folder))


@query(
    f"""WITH {_TOP}, steps AS (SELECT src AS at_, dst AS to_ FROM e UNION SELECT dst, src FROM e), one AS (SELECT DISTINCT to_ AS node FROM steps JOIN top ON at_ = id),
    two AS (SELECT DISTINCT to_ AS node FROM steps JOIN one ON at_ = node), ids AS (SELECT id AS node_id FROM top UNION SELECT node FROM one UNION SELECT node FROM two)
    SELECT node_id FROM ids WHERE node_id IN (SELECT node_id FROM n)"""
)
def g15_expand(spark, folder):
    n, e = nodes(spark, folder), edges(spark, folder)
    return graph.expand(n, e, spark.createDataFrame([(most_called(n, e),)], "node_id bigint"))


@query(
    """SELECT node_id, name, node_type, path, greatest(line_start, 1) AS line, CASE WHEN line_end > 0 THEN line_end ELSE greatest(line_start, 1) END AS end_line,
    CASE WHEN length(signature) > 500 THEN substr(signature, 1, 497) || '...' ELSE signature END AS signature, CASE WHEN length(docstring) > 500 THEN substr(docstring, 1, 497) || '...' ELSE docstring END AS doc,
    is_public, coalesce(visibility, CASE WHEN is_public THEN 'public' ELSE 'private' END) AS visibility FROM n WHERE name IS NOT NULL"""
)
def j1_symbol_records(spark, folder):
    return graph.symbol_records(nodes(spark, folder))


@query("SELECT e.edge_id, d.name AS dst_name, s.name AS src_name FROM e JOIN n d ON d.node_id = e.dst JOIN n s ON s.node_id = e.src")
def g10_named_edges(spark, folder):
    return graph.skewed_lookup(spark, edges(spark, folder), nodes(spark, folder)).select("edge_id", "dst_name", "src_name")
