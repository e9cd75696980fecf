"""Queries for code metrics. The indexed table stores no complexity; a stand-in follows from the node_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import graph, metrics
from codeloom.plans.graph_queries import _REACHED, most_imported
from codeloom.plans.registry import edges, nodes, query
from codeloom.plans.search_queries import _TESTNODE
from codeloom.session import table

_COMPLEX = "f AS (SELECT node_id, path, name, CAST(1 + node_id % 55 AS INT) AS complexity, greatest(line_end - line_start, 0) + 1 AS loc, CAST(node_id % 7 AS INT) AS nesting FROM n WHERE node_type = 'Function')"


def _functions(spark, folder):
    n = nodes(spark, folder).withColumns({"complexity": (F.lit(1) + F.pmod("node_id", F.lit(55))).cast("int"), "complexity_nesting": F.pmod("node_id", F.lit(7)).cast("int")})
    return metrics.function_complexity(n)


@query(f"WITH {_COMPLEX} SELECT *, 0 AS branches, 0 AS loops, 0 AS logical_ops, 0 AS exceptions, 0 AS early_returns, CASE WHEN complexity <= 5 THEN 'A' WHEN complexity <= 10 THEN 'B' WHEN complexity <= 20 THEN 'C' WHEN complexity <= 50 THEN 'D' ELSE 'F' END AS grade FROM f")
def m1_function_complexity(spark, folder):
    return _functions(spark, folder)


@query(
    f"""WITH {_COMPLEX}, g AS (SELECT path, count(*) AS functions, avg(complexity) AS average, max(complexity) AS greatest, count(*) FILTER (complexity > 10) AS above FROM f GROUP BY path)
    SELECT *, CASE WHEN floor(average) <= 5 THEN 'A' WHEN floor(average) <= 10 THEN 'B' WHEN floor(average) <= 15 THEN 'C' WHEN floor(average) <= 25 THEN 'D' ELSE 'F' END AS grade FROM g"""
)
def m1_file_complexity(spark, folder):
    return metrics.file_complexity(_functions(spark, folder))


@query(
    f"""WITH {_COMPLEX} SELECT path, 'Function ''' || name || ''' has complexity ' || complexity || ', consider splitting it' AS advice FROM f WHERE complexity > 10
    UNION ALL SELECT path, 'The average complexity is high, consider splitting the file' FROM f GROUP BY path HAVING avg(complexity) > 15
    UNION ALL SELECT path, count(*) || ' functions are nested deeper than 4 levels, consider returning early or extracting some' FROM f WHERE nesting > 4 GROUP BY path"""
)
def m1_advice(spark, folder):
    return metrics.complexity_advice(_functions(spark, folder))


_NAMES = (
    "'main','setup','Args','it','describe','activate','deactivate','invoke','dispose','refresh','initialized','shutdown','references','hover','completion','formatting','rename',"
    "'default','fmt','from','into','clone','eq','ne','cmp','hash','drop','deref','next','serialize','deserialize','source','description','embed','dimension','encode','insert','remove','get','contains','len','iter','clear','distance','build','parse','new'"
)
_UNUSED = f"""cand AS (SELECT * FROM n WHERE node_type IN ('Function', 'Class', 'Variable', 'Interface', 'Type') AND NOT coalesce(list_has_any(string_split(path, '/'), ['out', 'dist', 'target', 'node_modules', 'build']), false)
        AND NOT coalesce({_TESTNODE}, false) AND name NOT IN ('', 'arrow_function', 'anonymous') AND NOT starts_with(name, '<') AND name NOT IN ({_NAMES})),
    tests AS (SELECT node_id FROM n WHERE coalesce({_TESTNODE}, false)), called AS (SELECT DISTINCT dst FROM e WHERE edge_type = 'Calls'),
    used AS (SELECT DISTINCT dst FROM e WHERE edge_type IN ('References', 'Uses', 'Invokes', 'Instantiates', 'Extends', 'Implements', 'Imports') AND src NOT IN (SELECT node_id FROM tests)),
    left_ AS (SELECT * FROM cand WHERE node_id NOT IN (SELECT dst FROM called) AND node_id NOT IN (SELECT dst FROM used)),
    live AS (SELECT * FROM n WHERE node_type = 'Function' AND node_id IN (SELECT dst FROM called)), holders AS (SELECT src FROM e WHERE edge_type = 'Contains' AND dst IN (SELECT node_id FROM live)),
    kept AS (SELECT * FROM left_ WHERE node_type NOT IN ('Class', 'Type') OR (node_id NOT IN (SELECT src FROM holders) AND (path IS NULL OR path NOT IN (SELECT path FROM live WHERE path IS NOT NULL)))),
    scored AS (SELECT node_id, name, node_type, path, line_start, line_end, is_public, CASE WHEN regexp_matches(name, '[hH]andler|[cC]allback|[lL]istener|[mM]iddleware') THEN 0.2 WHEN ends_with(name, '_tool') OR starts_with(name, 'default_') THEN 0.1
        WHEN starts_with(name, 'migrate_') OR starts_with(name, 'migration_') THEN 0.2 WHEN starts_with(name, 'on_') OR regexp_matches(name, '^on[A-Z]') OR regexp_matches(name, '^handle[A-Z]') THEN 0.2 WHEN is_public THEN 0.5 ELSE 0.9 END AS confidence FROM kept)"""


@query(f"WITH {_UNUSED} SELECT * FROM scored WHERE confidence >= 0.7")
def m2_unused(spark, folder):
    return metrics.unused(nodes(spark, folder), edges(spark, folder))


@query(
    f"""WITH {_UNUSED} SELECT node_type, count(*) AS symbols, count(*) FILTER (NOT is_public AND confidence > 0.8) AS safe_to_remove,
    CAST(coalesce(sum(CASE WHEN confidence > 0.8 THEN line_end - line_start + 1 END), 0) AS BIGINT) AS removable_lines FROM scored WHERE confidence >= 0.1 GROUP BY node_type"""
)
def m3_unused_summary(spark, folder):
    return metrics.unused_summary(metrics.unused(nodes(spark, folder), edges(spark, folder), least=0.1))


@query(f"WITH {_REACHED}, inside AS (SELECT count(*) AS k FROM imports i WHERE i.src IN (SELECT node_id FROM members) AND i.dst IN (SELECT node_id FROM members)) SELECT k AS afferent, k AS efferent, CASE WHEN k > 0 THEN 0.5 ELSE 0.0 END AS instability FROM inside")
def m4_graph_coupling(spark, folder):
    n, e = nodes(spark, folder), edges(spark, folder)
    return metrics.graph_coupling(graph.dependency_edges(e, graph.dependency_nodes(n, e, most_imported(n, e))))


@query(
    r"""WITH at_ AS (SELECT node_id, path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM n WHERE path IS NOT NULL),
    ends AS (SELECT a.path AS a, b.path AS b, a.stem AS sa, b.stem AS sb FROM e JOIN at_ a ON a.node_id = e.src JOIN at_ b ON b.node_id = e.dst WHERE e.edge_type IN ('Imports', 'Calls')),
    going AS (SELECT a AS path, count(DISTINCT sb) FILTER (a <> b) AS ce, count(*) FILTER (a = b) AS inside, count(*) AS total FROM ends GROUP BY a), coming AS (SELECT b AS path, count(DISTINCT sa) AS ca FROM ends WHERE a <> b GROUP BY b),
    joined AS (SELECT p.path, coalesce(ca, 0) AS afferent, coalesce(ce, 0) AS efferent, coalesce(inside, 0) AS inside, coalesce(total, 0) AS total FROM (SELECT DISTINCT path FROM at_) p LEFT JOIN going USING (path) LEFT JOIN coming USING (path)),
    r AS (SELECT path, afferent, efferent, CASE WHEN afferent + efferent > 0 THEN efferent / (afferent + efferent) ELSE 0.0 END AS instability, CASE WHEN total > 0 THEN inside / total ELSE 1.0 END AS internal_ratio FROM joined)
    SELECT *, CASE WHEN internal_ratio > 0.7 THEN 'functional' WHEN internal_ratio > 0.4 THEN 'sequential' ELSE 'coincidental' END AS cohesion, instability < 0.2 AND efferent > 5 AS violation FROM r"""
)
def m5_file_coupling(spark, folder):
    return metrics.file_coupling(nodes(spark, folder), edges(spark, folder))


@query()
def m5_coupling_advice(spark, folder):
    return metrics.coupling_advice(metrics.file_coupling(nodes(spark, folder), edges(spark, folder)))


@query("SELECT count(*) FILTER (code IS NOT NULL AND code <> '') AS succeeded, count(*) AS total, count(*) FILTER (code IS NOT NULL AND code <> '') / count(*) AS rate FROM source_files", graph=False)
def m9_success_rate(spark, folder):
    return metrics.success_rate(table(spark, folder, "source_files").select((F.coalesce("code", F.lit("")) != "").alias("ok")))


def history(spark, folder):
    """Commits and their files: orders and the parts of their lines."""
    orders = table(spark, folder, "orders")
    commits = orders.select(F.col("o_orderkey").alias("hash"), F.concat(F.lit("change for "), F.col("o_orderpriority")).alias("subject"), F.col("o_orderdate").alias("author_date"))
    files = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"))
    return commits, files


@query(
    """WITH r AS (SELECT l_partkey AS path, o_orderkey AS hash, 'change for ' || o_orderpriority AS subject, o_orderdate AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    t AS (SELECT path, count(*) AS changes, count(DISTINCT hash) AS commits FROM r GROUP BY path HAVING count(*) >= 10), s AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY d DESC, hash, subject) AS k FROM r)
    SELECT t.path, changes, commits, list(subject ORDER BY k) FILTER (k <= 5) AS subjects FROM t JOIN s USING (path) GROUP BY ALL""",
    graph=False,
)
def m10_hotspots(spark, folder):
    return metrics.hotspots(*history(spark, folder))


@query(
    """WITH f AS (SELECT DISTINCT l_orderkey AS hash, l_partkey AS path FROM lineitem), c AS (SELECT path, count(*) AS k FROM f GROUP BY path),
    p AS (SELECT a.path AS path_a, b.path AS path_b, count(*) AS together FROM f a JOIN f b ON a.hash = b.hash AND a.path < b.path GROUP BY ALL)
    SELECT path_a, path_b, together, together / least(x.k, y.k) AS strength, greatest(x.k, y.k) AS changes FROM p JOIN c x ON x.path = path_a JOIN c y ON y.path = path_b WHERE together / least(x.k, y.k) >= 0.1""",
    graph=False,
)
def m11_cochange(spark, folder):
    return metrics.cochange(history(spark, folder)[1], 0.1)
