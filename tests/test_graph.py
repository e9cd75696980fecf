"""Hand-built graphs: chains, filters, callers, impact, positions, unused code, empty tables."""

import pytest

from codeloom.operators import graph, metrics, search
from codeloom.operators.skew import join_counted
from codeloom.schema import edges_of, nodes_of

NODE = "node_id bigint, node_type string, name string, path string, line_start int, line_end int"


def make_nodes(spark, rows, schema=NODE):
    return nodes_of(spark.createDataFrame(rows, schema))


def make_edges(spark, rows):
    return edges_of(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "edge_id bigint, src bigint, dst bigint, edge_type string"))


@pytest.fixture(scope="module")
def chain(spark):
    n = make_nodes(spark, [(1, "Function", "a", "/s/a.rs", 1, 5), (2, "Function", "b", "/s/a.rs", 6, 9), (3, "Function", "c", "/s/b.rs", 1, 3)])
    return n, make_edges(spark, [(1, 2, "Calls"), (2, 3, "calls")])


def test_traverse_depth(spark, chain):
    n, e = chain
    assert {r.name for r in graph.traverse(n, e, 1, 2).collect()} == {"b", "c"}
    assert {r.name for r in graph.traverse(n, e, 1, 1).collect()} == {"b"}
    assert [r.path for r in graph.traverse(n, e, 1, 2).where("node_id = 3").collect()] == [[1, 2, 3]]


def test_traverse_filters_what_is_given_not_what_is_expanded(spark):
    n = make_nodes(spark, [(1, "Function", "a", "x", 1, 1), (2, "Class", "B", "x", 2, 2), (3, "Function", "c", "x", 3, 3)])
    e = make_edges(spark, [(1, 2, "Calls"), (2, 3, "Calls")])
    assert {r.name for r in graph.traverse(n, e, 1, 3, node_types=["function"]).collect()} == {"c"}
    mixed = make_edges(spark, [(1, 2, "Calls"), (2, 3, "Imports")])
    assert {r.name for r in graph.traverse(n, mixed, 1, 3, edge_types=["calls"]).collect()} == {"B"}


def test_callers_and_cycles(spark, chain):
    n, e = chain
    start = spark.createDataFrame([(3,)], "start bigint")
    assert {(r.node, r.depth) for r in graph.callers(n, e, start, 2).collect()} == {(2, 1), (1, 2)}
    loop = make_edges(spark, [(1, 2, "Calls"), (2, 1, "Calls")])
    found = graph.reach(graph.links(loop, ["Calls"]), spark.createDataFrame([(1,)], "start bigint"), 3)
    assert {(r.node, r.depth) for r in found.collect()} == {(2, 1), (1, 2)}


def test_callers_fall_back_to_the_same_name(spark):
    n = make_nodes(spark, [(1, "Function", "run", "a", 1, 2), (2, "Function", "run", "b", 1, 2), (3, "Function", "x", "c", 1, 2)])
    e = make_edges(spark, [(3, 2, "Calls")])
    rows = graph.callers(n, e, spark.createDataFrame([(1,)], "start bigint")).collect()
    assert [(r.start, r.node, r.via) for r in rows] == [(1, 3, 2)]


def test_call_graph_prefers_caller(spark):
    n = make_nodes(spark, [(1, "Function", "r", "a", 1, 1), (2, "Function", "m", "a", 2, 2), (3, "Function", "d", "a", 3, 3)])
    e = make_edges(spark, [(2, 1, "Calls"), (1, 2, "Calls"), (1, 3, "Calls")])
    assert {(r.node_id, r.relation) for r in graph.call_graph(n, e, 1).collect()} == {(2, "caller"), (3, "callee")}


def test_impact(spark, chain):
    n, e = chain
    targets = spark.createDataFrame([(3,)], "target bigint")
    direct = graph.direct_impact(n, e, targets, "delete")
    assert [(r.node_id, r.impact, r.severity) for r in direct.collect()] == [(2, "caller", "breaking")]
    assert graph.indirect_impact(n, e, direct).count() == 0  # the only other file is impacted already
    assert graph.impact_risk(e, targets, "delete").first().risk == "high"
    assert graph.impact_risk(e, targets, "modify").first().risk == "low"


def test_positions(spark):
    ranges = spark.createDataFrame([("f", 1, 1, 0, 100, 0), ("f", 2, 10, 4, 20, 5)], "path string, node_id bigint, line_start int, col_start int, line_end int, col_end int")
    asked = spark.createDataFrame([(1, "f", 15, 10), (2, "f", 50, 0), (3, "g", 1, 1)], "position_id bigint, path string, line int, column int")
    assert {(r.position_id, r.node_id) for r in graph.at_position(ranges, asked).collect()} == {(1, 2), (2, 1)}


def test_nearest_symbol_falls_back(spark, chain):
    n, _ = chain
    asked = spark.createDataFrame([(1, "/s/a.rs", 7), (2, "/s/b.rs", 9)], "position_id bigint, path string, line int")
    assert {(r.position_id, r.node_id, r.used_fallback) for r in graph.nearest_symbols(n, asked).collect()} == {(1, 2, False), (2, 3, True)}


def test_entry_points_and_signatures(spark):
    schema = NODE + ", is_async boolean, is_public boolean, is_static boolean, return_type string, param_count int, signature string"
    rows = [
        (1, "Function", "getUserById", "/s/u.ts", 1, 2, True, True, False, "User", 1, None),
        (2, "Function", "getOrderById", "/s/u.ts", 3, 4, True, False, False, "Order", 1, None),
        (3, "Function", "createUser", "/s/u.ts", 5, 6, False, True, True, "Result<String, Error>", None, "fn createUser(&mut self, a: Map<K, V>, b: (i32, i32)) -> X"),
        (4, "Function", "main", "/s/main.rs", 1, 2, False, False, False, None, 0, None),
        (5, "Function", "test_it", "/s/x.rs", 1, 2, None, False, None, None, None, "nothing"),
    ]
    n = make_nodes(spark, rows, schema)
    names = lambda df: {r.name for r in df.collect()}
    assert names(search.by_signature(n, "get*ById")) == {"getUserById", "getOrderById"}
    assert names(search.by_signature(n, returns="Result")) == {"createUser"}
    assert names(search.by_signature(n, params=(2, 2))) == {"createUser"}
    assert names(search.by_signature(n, modifiers=["async", "public"])) == {"getUserById"}
    assert names(search.by_signature(n, modifiers=["static"])) == {"createUser"}
    assert names(search.by_signature(n, modifiers=["nonsense"])) == set()
    assert {(r.name, r.entry) for r in search.entry_points(n, ["main", "test_entry"]).collect()} == {("main", "main"), ("test_it", "test_entry")}


def test_unused(spark):
    rows = [(1, "Function", "lonely", "/s/a.rs", 1, 3), (2, "Function", "on_click", "/s/a.rs", 4, 5), (3, "Class", "K", "/s/b.rs", 1, 9), (4, "Function", "inner", "/s/b.rs", 2, 3), (5, "Function", "user", "/s/c.rs", 1, 2), (6, "Function", "fmt", "/s/c.rs", 3, 4)]
    n = make_nodes(spark, [(*r, "private") for r in rows], NODE + ", visibility string")
    e = make_edges(spark, [(5, 4, "Calls")])
    assert {r.name for r in metrics.unused(n, e).collect()} == {"lonely", "user"}


def test_bm25_ranks(spark):
    n = make_nodes(spark, [(1, "Function", "validateEmail", "x", 1, 1), (2, "Function", "processEmail", "x", 1, 1), (3, "Function", "validatePhone", "x", 1, 1)])
    f = search.index_fields(n)
    ids = [r.node_id for r in search.bm25(search.postings(f), search.doc_stats(f), "validate email").collect()]
    assert ids[0] == 1 and set(ids) == {1, 2, 3}
    words = spark.range(1).select(search.tokens(__import__("pyspark").sql.functions.lit("getUserById hello-world_test.foo a id HTMLParser"))).first()[0]
    assert words == ["get", "user", "by", "id", "hello", "world", "test", "foo", "id", "htmlparser"]


def test_normalisation(spark):
    raw = spark.createDataFrame([(1, "f", None, "a,b", 3), (None, "g", None, None, 1)], "node_id bigint, name string, visibility string, attributes string, start_line int")
    row = nodes_of(raw).collect()
    assert len(row) == 1 and row[0].is_public and row[0].attributes == ["a", "b"] and row[0].line_start == 3
    e = edges_of(spark.createDataFrame([(1, 1, 2, "CALLS"), (1, 1, 2, "CALLS"), (2, 1, None, "Calls")], "edge_id bigint, src bigint, dst bigint, edge_type string"))
    assert [(r.src, r.dst, r.edge_type) for r in e.dropDuplicates(["edge_id"]).collect()] == [(1, 2, "Calls")]


def test_empty_tables(spark):
    n, e = make_nodes(spark, []), make_edges(spark, [])
    assert graph.reach(graph.links(e), spark.createDataFrame([], "start bigint"), 3).count() == 0
    assert metrics.unused(n, e).count() == 0 and metrics.file_coupling(n, e).count() == 0
    f = search.index_fields(n)
    assert search.bm25(search.postings(f), search.doc_stats(f), "x").count() == 0
    assert metrics.success_rate(spark.createDataFrame([], "ok boolean")).first().rate == 1.0


def test_join_counted_splits_hot_keys(spark):
    left = spark.range(50_000).selectExpr("CASE WHEN id < 30000 THEN 7 ELSE id END AS k", "id AS v")
    right = left.groupBy("k").count().selectExpr("k", "k * 2 AS w", "count AS n")
    out = join_counted(left, right, "k", "n", 50_000, "left", 4)
    assert out.count() == 50_000 and out.where("w <> k * 2").count() == 0
