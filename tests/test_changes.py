"""Changes of an indexed workspace, git, stored indexes, and rules against word-for-word versions."""

import datetime
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.api import Workspace
from codeloom.functions import rules
from codeloom.operators import context, graph, metrics, notes, search, vectors
from codeloom.operators.skew import join_spread, spread
from codeloom.sources import git
from codeloom.streaming import watch

A, B = "def helper(x):\n    return x\n", "from a import helper\n\n\ndef run(y):\n    return helper(y)\n"


@pytest.fixture()
def work(spark, tmp_path):
    for name, code in (("a.py", A), ("b.py", B)):
        (tmp_path / name).write_text(code)
    w = Workspace.index_directory(spark, [str(tmp_path)], "demo")
    w.path = {r.name: r.path for r in w.nodes.where("node_type = 'CodeFile'").collect()}
    return w


def calls(w):
    n = w.nodes.select("node_id", "name")
    ends = w.edges.where("edge_type = 'Calls'").join(n.select(F.col("node_id").alias("src"), F.col("name").alias("a")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("name").alias("b")), "dst")
    return {(r.a, r.b) for r in ends.collect()}


def test_a_changed_file_replaces_itself(spark, work):
    ids = {r.name: r.node_id for r in work.nodes.collect()}
    at = datetime.datetime(2025, 1, 1)
    work.memory_store(notes.make(spark, "convention", "On helper", "c", links={ids["helper"]: 1.0}, note="n1", moment=at))
    work.memory_store(notes.make(spark, "convention", "On run", "c", links={ids["run"]: 1.0}, note="n2", moment=at))
    assert calls(work) == {("run", "helper")}
    work.on_save(work.path["a.py"], "\n\ndef helper(x):\n    return other(x)\n\n\ndef other(x):\n    return x\n")
    assert calls(work) == {("run", "helper"), ("helper", "other")}
    assert {r.id for r in work.memory_list().collect()} == {"n2"}  # helper moved, so what was said of it ended
    named = work.vectors.join(work.nodes.select("node_id", "name"), "node_id")
    assert {r.name for r in named.collect()} == {"helper", "other", "run"}
    before = work.nodes.count()
    work.on_change(work.path["a.py"], "def broken(:\n")
    assert work.nodes.count() == before  # what doesn't parse changes nothing
    assert work.on_close(work.path["a.py"]).nodes.count() == before


def test_open_and_branches(spark, work):
    work.on_open("/z/new.py", "def fresh():\n    return run(1)\n", at_startup=False)
    assert work.nodes.where("name = 'fresh'").isEmpty()
    work.on_open("/z/vendor/new.py", "def fresh():\n    pass\n", exclude=["vendor"])
    assert work.nodes.where("name = 'fresh'").isEmpty()
    changes = spark.createDataFrame([(work.path["a.py"], "D"), ("/z/new.py", "A"), ("/z/gone.py", "A")], "path string, status string")
    work.switch_branch(changes, spark.createDataFrame([("/z/new.py", "def fresh():\n    return run(1)\n"), (work.path["b.py"], "x = 1\n")], "path string, code string"))
    assert calls(work) == {("fresh", "run")}
    state = [work._state()]
    events = spark.createDataFrame([("/z/new.py", "remove"), (work.path["b.py"], "modify")], "path string, kind string")
    watch.event_handler(state, lambda paths: paths.withColumn("code", F.lit("def only():\n    pass\n")))(events, 0)
    assert {r.name for r in state[0].nodes.where("node_type = 'Function'").collect()} == {"only"}


def test_branch_handler_keeps_the_last_commit(spark, tmp_path):
    seen = []
    handle = watch.branch_handler(f"file://{tmp_path}/last", lambda df, k: seen.append(sorted((r.repo, r.commit) for r in df.collect())))
    rows = lambda *x: spark.createDataFrame([(r, c, datetime.datetime(2025, 1, d)) for r, c, d in x], "repo string, commit string, ended timestamp")
    handle(rows(("r", "a", 1), ("s", "a", 1)), 0)
    handle(rows(("r", "a", 2), ("s", "b", 2)), 1)
    handle(rows(("r", "a", 2), ("s", "b", 2)), 1)  # a batch that comes again
    assert seen == [[("r", "a"), ("s", "a")], [("s", "b")], [("s", "b")]]


def test_git(spark, tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True)

    run("init", "-q")
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    run("add", ".")
    run("commit", "-qm", "feat: first\n\nbody")
    (tmp_path / "a.txt").write_text("one\nzwei\ndrei\n")
    run("commit", "-qam", "fix: second")
    log = git.log(spark, str(tmp_path)).collect()
    assert [r.subject for r in log] == ["fix: second", "feat: first"] and log[1].body == "body"
    assert {(r.status, r.path) for r in git.files(spark, str(tmp_path)).collect()} == {("A", "a.txt"), ("M", "a.txt")}
    assert [tuple(r) for r in git.show_stat(spark, str(tmp_path), log[0].hash).collect()] == [("a.txt", 2, 1)]
    assert git.show_message(str(tmp_path), log[1].hash) == "feat: first\n\nbody"
    assert [(r.line, r.hash == log[0].hash) for r in git.blame(spark, str(tmp_path), "a.txt", 1, 2).collect()] == [(1, False), (2, True)]


def test_parameters_at_any_depth(spark):
    deep = "(" * 9 + "a, b" + ")" * 9
    rows = {
        "f()": 0, "f( )": 0, "f(a, b)": 2, f"f({deep}, c)": 2, "fn f(&self, a: Map<K, (V, W)>)": 1, "fn f(&'a mut self)": 0, "f(self: X, a)": 1, "f(g: (a, b) => c, d)": 2, "f(x: fn(u8) -> u8, y)": 2, "none": None, "f(a": None,
        "f(a, b,)": 2, "x(selfish, b)": 2, None: None,
    }
    got = spark.createDataFrame([(k,) for k in rows], "s string").select("s", rules.params_of(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in got} == rows


def test_replaced_vectors_are_those_of_paths_that_end_alike(spark):
    r = random.Random(3)
    paths = ["".join(r.choice("ab/") for _ in range(r.randint(1, 5))).strip("/") or "a" for _ in range(60)]
    nodes = spark.createDataFrame([(k, "Function", f"f{k}", p, None, None) for k, p in enumerate(paths)], "node_id bigint, node_type string, name string, path string, signature string, doc string")
    old = nodes.select("node_id", F.array(F.lit(9.0).cast("float")).alias("embedding"))
    changed = paths[:6]
    out = vectors.replace_by_file(old, nodes, spark.createDataFrame([(c,) for c in changed], "path string")).collect()
    assert len(out) == len(paths)
    fresh = {x.node_id for x in out if len(x.embedding) > 1}
    assert fresh == {k for k, p in enumerate(paths) if any(p.endswith(c) or c.endswith(p) for c in changed)}


def test_clients_end_with_their_names(spark):
    rows = [(1, "std::reqwest::get", 1), (1, "prefetch", 2), (2, "my_axios.post", 1), (3, "getter", 1), (4, "requests.get", 2), (4, "http.put", 1)]
    got = search.http_clients(spark.createDataFrame(rows, "node_id bigint, callee string, position int")).collect()
    assert {(r.node_id, r.method) for r in got} == {(1, "ANY"), (2, "POST"), (4, "GET")}


def test_stored_index_is_the_same_search(spark, tmp_path):
    n = spark.createDataFrame([(1, "validateEmail", "checks an email"), (2, "processEmail", None), (3, "validatePhone", ""), (4, None, None)], "node_id bigint, name string, doc string")
    posted, stats = (f(search.index_fields(n)) for f in (search.postings, search.doc_stats))
    search.save_index(posted, stats, f"file://{tmp_path}/i", 4)
    for q in ("validate email email", "nothing", "", "Phone"):
        a, b = (sorted((r.node_id, round(r.score, 9)) for r in x.collect()) for x in (search.bm25(posted, stats, q), search.search_index(search.open_index(spark, f"file://{tmp_path}/i"), q)))
        assert a == b, q
    assert search.has_term(posted, "email") and not search.has_term(posted, "mail")


def test_hubs_are_spread(spark):
    left = spark.createDataFrame([(k % 3, k) for k in range(30)], "at int, x int")
    right = spark.createDataFrame([(0, k) for k in range(50)] + [(1, 7)], "at int, to int")
    cut, hot = spread(right, "at", 10)
    assert [tuple(r) for r in hot.collect()] == [(0, 5)]
    assert sorted(map(tuple, join_spread(left, cut, hot, "at").select("at", "x", "to").collect())) == sorted(map(tuple, left.join(right, "at").select("at", "x", "to").collect()))


def test_reach_at_any_depth_has_the_plan_of_one_hop(spark):
    steps = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(5, 0)], "at bigint, to bigint")
    found = graph.reach(steps, spark.createDataFrame([(0,)], "start bigint"), 8)
    assert {(r.node, r.depth) for r in found.collect()} == {(k, k) for k in range(1, 9)} | {(0, 6)}
    joins = lambda d: graph.reach(steps, spark.createDataFrame([(0,)], "start bigint"), d)._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins(3) == joins(6) == 0


def test_notes_by_table_and_vector(spark):
    at = datetime.datetime(2025, 1, 1)
    two = notes.make(spark, "convention", "T", "ledger", links={7: 0.5}, note="a", moment=at).unionByName(notes.make(spark, "convention", "U", "ledger", links={8: 0.9, 7: 0.1}, note="b", moment=at))
    by_list = notes.search(two, "ledger", code=[8]).collect()
    assert by_list == notes.search(two, "ledger", code=spark.createDataFrame([(8,), (99,)], "node_id bigint")).collect() and by_list[0].id == "b"
    done = notes.embedded(two.unionByName(notes.make(spark, "convention", "V", None, note="c", moment=at)), vectors.hashed_embedding, vectors.EMBED_SIZE)
    assert {r.id: len(r.embedding) for r in done.collect()} == {"a": 256, "b": 256}
    assert notes.nearest(done, [float(x) for x in done.where("id = 'a'").first().embedding], 1).first().id == "a"
    assert [r.title for r in context.notes_within(two.withColumn("score", F.lit(1.0)), 8000).collect()] == ["T", "U"]
    row = spark.createDataFrame([("abcdef1234", "Renamed")], "c string, k string").select(rules.is_at_commit(F.col("c"), "abcdef1").alias("a"), rules.is_at_commit(F.col("c"), "abc").alias("b"), rules.change_action(F.col("k")).alias("x")).first()
    assert (row.a, row.b, row.x.action, row.x.confidence) == (True, False, "Update", 0.7)


def test_large_commits_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "COMMIT_FILES", 3)
    rows = [("h", f"p{k}") for k in range(10)] + [("i", "p0"), ("i", "p1"), ("i", "p1")]
    got = {(r.path_a, r.path_b): r.together for r in metrics.cochange(spark.createDataFrame(rows, "hash string, path string"), 0.0).collect()}
    assert len(got) == 45 and got[("p0", "p1")] == 2 and set(got.values()) == {1, 2}


def test_metrics_advise(spark):
    c = spark.createDataFrame([("a", 12, 9, 0.9, 0.1, True)], "path string, afferent long, efferent long, instability double, internal_ratio double, violation boolean")
    assert metrics.coupling_advice(c).count() == 4
    assert metrics.parser_metrics(spark.createDataFrame([], "language string, ok boolean, entities long, relations long, ms double")).first().rate == 0.0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_keys_are_joined_apart(spark, monkeypatch, how):
    from codeloom.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    left = spark.range(1000).selectExpr("CASE WHEN id < 600 THEN 7 WHEN id < 610 THEN NULL ELSE id END AS k", "id AS v")
    right = left.where("k IS NOT NULL AND k % 3 < 2").groupBy("k").count().selectExpr("k", "k * 2 AS w", "count AS n")
    got = skew.join_counted(left, right, "k", "n", 1000, how)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    want = left.join(right.drop("n"), "k", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_figures_of_what_is_written(spark):
    from codeloom.session import Scratch

    scratch = Scratch(spark, "test")
    df, seen = scratch.cut_counted(spark.range(100).repartition(7), F.count("*").alias("n"), F.bit_xor("id").alias("x"))
    assert df.count() == seen["n"] == 100 and seen["x"] == 0
    empty, seen = scratch.cut_counted(spark.range(0), F.count("*").alias("n"))
    assert empty.count() == seen["n"] == 0
    scratch.close()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_symbols_against_all_pairs(spark, seed):
    r = random.Random(seed)
    ranges = [(k, "Function", f"f{k}", r.choice("pq"), a := r.randint(0, 80), r.choice([0, a, a + r.randint(0, 5), a + r.randint(0, 60)])) for k in range(40)]
    asked = [(k, r.choice("pqz"), r.randint(0, 120)) for k in range(80)]

    def best(path, line):
        keys = []
        for n, _, _, p, a, z in ranges:
            if p == path:
                inside = a <= line <= z
                keys.append((not inside, z - a if inside else a - line if a > line else line - z + 1000, n))
        return min(keys)[::-2] if keys else None  # id, whether outside

    n = spark.createDataFrame(ranges, "node_id bigint, node_type string, name string, path string, line_start int, line_end int")
    got = {r.position_id: (r.node_id, r.used_fallback) for r in graph.nearest_symbols(n, spark.createDataFrame(asked, "position_id bigint, path string, line int")).collect()}
    assert got == {k: b for k, p, line in asked if (b := best(p, line))}
