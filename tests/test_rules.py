"""Tables of cases for predicates, commits, routes, notes, context and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from codeloom.functions import rules
from codeloom.operators import context, history, metrics, notes, vectors
from codeloom.sources import files, git
from codeloom.streaming import watch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "subject, body, pattern, confidence",
    [
        ("fix: resolve null pointer in parser", "", "BugFix", 0.9),
        ("feat: new API", "BREAKING CHANGE: removed old endpoint", "BreakingChange", 0.95),
        ("Fixed the login page crash", "", "BugFix", 0.75),
        ("Added dark mode support", "", "Feature", 0.7),
        ("Refactored the database layer", "", "Refactor", 0.7),
        ("Updated README with install instructions", "", "Documentation", 0.7),
        ("Added unit tests for auth module", "", "Test", 0.7),
        ("wip", None, "Other", 0.5),
    ],
)
def test_commits(spark, subject, body, pattern, confidence):
    got = one(spark, rules.commit_pattern(F.lit(subject), F.lit(body)))
    assert (got.pattern, got.confidence) == (pattern, confidence)


def test_issue_and_revert(spark):
    assert one(spark, rules.issue_reference(F.lit("fix: resolve #123"))) == "#123"
    assert one(spark, rules.issue_reference(F.lit("no issue"))) is None
    assert one(spark, rules.revert_hash(F.lit("Revert abcdef1"))) == "abcdef1"


@pytest.mark.parametrize(
    "decorator, route, method",
    [('@app.get("/users")', "/users", "GET"), ('@router.get("/users/{user_id}")', "/users/{user_id}", "GET"), ('@app.route("/hello")', "/hello", "ANY"), ('@GetMapping("/api/users")', "/api/users", "GET"), ('@RequestMapping("/api")', "/api", "ANY"), ("@Get('/users')", "/users", "GET"), ("@staticmethod", None, None)],
)
def test_routes(spark, decorator, route, method):
    got = one(spark, rules.route_of_decorator(F.lit(decorator)))
    assert (got and (got.route, got.http_method)) == ((route, method) if route else None)


def test_route_forms(spark):
    for given, wanted in (("/users/", "/users"), ("/users?page=1", "/users"), ("/", "/")):
        assert one(spark, rules.normal_route(F.lit(given))) == wanted
    for pattern, path, ok in (("/users/{id}", "/users/123", True), ("/users/:id", "/users/456", True), ("/users/{id}", "/posts/123", False), ("/users/{id}/posts", "/users/123", False)):
        assert one(spark, rules.route_matches(F.lit(pattern), F.lit(path))) is ok


def test_grades_layers_and_paths(spark):
    for value, grade in ((1, "A"), (5, "A"), (6, "B"), (10, "B"), (11, "C"), (20, "C"), (21, "D"), (50, "D"), (51, "F"), (0, "F")):
        assert one(spark, rules.complexity_grade(F.lit(value))) == grade
    for value, grade in ((3.0, "A"), (8.0, "B"), (12.0, "C"), (20.0, "D"), (30.0, "F"), (5.9, "A")):
        assert one(spark, rules.file_grade(F.lit(value))) == grade
    assert one(spark, rules.layer(F.lit("/src/controllers/x.ts"))) == "controller"
    assert one(spark, rules.layer(F.lit("/src/foo.ts"))) is None
    assert one(spark, rules.test_paths(F.lit("/src/foo.ts")))[:3] == ["/src/foo.test.ts", "/src/foo.spec.ts", "/src/foo_test.ts"]
    assert one(spark, rules.test_paths(F.lit("/src/Makefile"))) == []
    assert one(spark, rules.language_of_path(F.lit("a/b.h"))) == "c"


def test_text_forms(spark):
    assert len(one(spark, rules.truncate(F.lit("x" * 600)))) == 500
    code = "\n".join(["first", *[f"l{k}" for k in range(40)], "call target()", *[f"m{k}" for k in range(20)]])
    short = one(spark, rules.call_site(F.lit(code), F.lit("target")))
    assert short.startswith("first\n") and "call target()" in short and "lines omitted" in short
    assert one(spark, rules.call_site(F.lit("a\nb"), F.lit("zzz"))) == "a\nb"


def test_glob():
    import re

    assert re.match(rules.anchored_pattern("get*ById"), "getUserById") and not re.match(rules.anchored_pattern("get*"), "forget")
    assert rules.anchored_pattern("get.*") == "^get.*$"


def test_notes_over_time(spark):
    t = datetime.datetime(2025, 1, 1, 12)
    rows = [("1", t - datetime.timedelta(hours=1), None), ("2", t - datetime.timedelta(hours=2), t - datetime.timedelta(hours=1))]
    df = spark.createDataFrame(rows, "id string, valid_at timestamp, invalid_at timestamp").withColumns({"created_at": F.col("valid_at"), "superseded_at": F.lit(None).cast("timestamp")})
    at = lambda m: {r.id for r in notes.as_of(df, F.lit(str(t - datetime.timedelta(minutes=m))).cast("timestamp")).collect()}
    assert at(0) == {"1"} and at(30) == {"1"} and at(90) == {"2"} and at(120) == {"2"} and at(180) == set() and at(60) == {"1"}


def test_note_log(spark):
    schema = "id string, kind string, title string, invalid_at timestamp, superseded_at timestamp, version bigint, deleted boolean"
    log = spark.createDataFrame([("a", "k", "t", None, None, 1, False), ("b", "k", None, None, None, 1, False)], schema)
    assert notes.latest(notes.delete(log, spark.createDataFrame([("a",), ("zz",)], "id string"), 2)).count() == 1
    ended = notes.invalidate(log, spark.createDataFrame([("b",), ("nobody",)], "id string"), F.current_timestamp(), 2)
    assert notes.get(ended, "b").count() == 0 and notes.get(ended, "a").count() == 1


def test_budgets(spark):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate((50, 60, 10, 30))], "g int, position int, tokens bigint")
    assert [r.position for r in context.within(rows, "g", 100, "position").orderBy("position").collect()] == [0, 1]
    assert [r.position for r in context.fitting(rows, "g", 100, ["position"]).orderBy("position").collect()] == [0, 2, 3]


def test_mining_skips_known(spark):
    commits = spark.createDataFrame([("h1", "fix: a", "", datetime.datetime(2025, 1, 2)), ("h2", "fix: b", "", datetime.datetime(2025, 1, 1)), ("h3", "wip", "", datetime.datetime(2025, 1, 3))], "hash string, subject string, body string, author_date timestamp")
    touched = spark.createDataFrame([("h1", "p")], "hash string, path string")
    some = spark.createDataFrame([("p", k) for k in range(9)], "path string, node_id bigint")
    out = history.mine(commits, touched, some, spark.createDataFrame([("h2",)], "hash string")).collect()
    assert [(r.hash, r.kind, r.links) for r in out] == [("h1", "debug_context", [0, 1, 2, 3, 4])]


def test_history_metrics(spark):
    f = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", "b"), ("c3", "a")], "hash string, path string")
    assert [(r.path_a, r.path_b, r.together, r.strength) for r in metrics.cochange(f).collect()] == [("a", "b", 2, 1.0)]


def test_log_parsing(spark):
    good = git.FIELD.join(["h", "s", "b\n", "n", "e", "2025-01-01T00:00:00Z"]) + git.RECORD + "broken" + git.RECORD
    assert [(r.hash, r.body) for r in git.parse_log(spark.createDataFrame([(good,)], "output string")).collect()] == [("h", "b")]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0]), (6, None)], "node_id bigint, embedding array<float>")
    got = {(r.node_id_a, r.node_id_b): round(r.similarity, 6) for r in vectors.similar_pairs(v, 0.5).collect()}
    assert got == {(1, 2): 1.0}
    assert one(spark, vectors.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0
    near = vectors.similar(v.where("node_id < 5"), v.where("node_id = 1"), 3).collect()
    assert [(r.node_id, round(r.similarity, 6)) for r in near] == [(2, 1.0)]
    assert {(r.leader, r.node_id) for r in vectors.clusters(v.where("node_id < 5"), 0.5).collect()} == {(1, 1), (1, 2)}


def test_similar_pairs_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    v = spark.createDataFrame([(k, [float(a) for a in r]) for k, r in enumerate(x)], "node_id bigint, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.8}
    assert {(r.node_id_a, r.node_id_b) for r in vectors.similar_pairs(v, 0.8).collect()} == want


def test_tree_and_store(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("def foo(): pass\n")
    (tmp_path / "src" / "b.rs").write_text("fn b() {}\n")
    (tmp_path / "src" / "readme.txt").write_text("x")
    (tmp_path / "src" / "node_modules" / "c.ts").write_text("function c() {}")
    tree = files.read_tree(spark, str(tmp_path / "src"))
    assert {r.path.rsplit("/", 1)[1] for r in tree.collect()} == {"a.py", "b.rs"}
    parsed = files.parse_files(tree)
    assert {r.name for r in parsed.where("node_type = 'Function'").collect()} == {"foo", "b"}
    bad = files.parse_results(files.parse_files(spark.createDataFrame([("x.py", "def ("), ("y.py", "")], "path string, code string")))
    total = metrics.parser_metrics(bad).where("language IS NULL").first()
    assert (total.attempted, total.succeeded, total.rate) == (2, 1, 0.5)
    store = f"file://{tmp_path}/store"
    e = files.contains_edges(parsed)
    for slug in ("p-1", "p-2", "p-1"):
        files.save_graph(parsed, e, store, slug, "/ws")
    assert {(r.slug, r.node_count, r.edge_count) for r in files.list_projects(spark, store).collect()} == {("p-1", 4, 2), ("p-2", 4, 2)}
    n1, e1 = files.load_graph(spark, store, "p-1")
    assert n1.count() == 4 and e1.count() == 2
    assert files.graph_svg([(1, "a<"), (2, "b")], [(1, 2), (1, 9)]).count("<line") == 1


def test_debounce(spark):
    t = datetime.datetime(2025, 1, 1)
    at = lambda ms: t + datetime.timedelta(milliseconds=ms)
    e = spark.createDataFrame([("p", "create", at(0)), ("p", "modify", at(100)), ("p", "remove", at(900)), ("q", "modify", at(0))], "path string, kind string, ts timestamp")
    assert {(r.path, r.kind, r.events) for r in watch.debounce(e).collect()} == {("p", "modify", 2), ("p", "remove", 1), ("q", "modify", 1)}
    gone, again = watch.split_changes(spark.createDataFrame([("D", "a"), ("M", "b"), ("R", "c")], "status string, path string"))
    assert [r.path for r in gone.collect()] == ["a"] and again.count() == 2
