"""A workspace from source files to answers, through the tools' names."""

import datetime

import pytest
from pyspark.sql import functions as F

from codeloom.api import Workspace
from codeloom.operators import notes

PY = 'def helper(x):\n    return x + 1\n\n\ndef run(y):\n    if y:\n        return helper(y)\n    return 0\n\n\ndef test_run():\n    assert run(1)\n\n\ndef lonely_thing():\n    return 2\n'


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tree")
    (folder / "a.py").write_text(PY)
    (folder / "b.js").write_text("export function other(a) {\n  return helper(a);\n}\n")
    w = Workspace.index_directory(spark, [str(folder)], "demo")
    w.nodes, w.edges = w.nodes.cache(), w.edges.cache()
    w.commits = spark.createDataFrame([("h1", "fix: helper", "cause: typo", "n", datetime.datetime(2025, 1, 2)), ("h2", "wip", "", "n", datetime.datetime(2025, 1, 1))], "hash string, subject string, body string, author_name string, author_date timestamp")
    w.commit_files = spark.createDataFrame([("h1", "a.py"), ("h2", "a.py")], "hash string, path string")
    return w


def names(w, df, column="node_id"):
    return {r.name for r in df.select(column).join(w.nodes.select(F.col("node_id").alias(column), "name"), column).collect()}


def test_graph_tools(work):
    ids = {r.name: r.node_id for r in work.nodes.collect()}
    assert names(work, work.get_callers(ids["helper"], depth=2), "node") == {"run", "other", "test_run"}
    assert names(work, work.get_callees(ids["run"]), "node") == {"helper"}
    assert {r.name for r in work.get_call_graph(ids["run"]).collect()} == {"test_run", "helper"}
    assert {r.name for r in work.traverse_graph(ids["run"]).collect()} == {"helper"}
    assert work.analyze_impact(ids["helper"], change="delete")["risk"].first().risk == "high"
    assert work.get_detailed_symbol(ids["helper"]).first().code.startswith("def helper")
    path = work.nodes.where("name = 'run'").first().path
    assert work.at(path=path, line=6) == ids["run"]
    assert names(work, work.find_related_tests(ids["helper"])) == {"test_run"}
    assert names(work, work.find_unused_code(confidence=0.1)) >= {"lonely_thing"}
    assert work.graph_stats().where("node_type = 'Function'").first().symbols == 5


def test_search_and_vectors(work):
    assert work.symbol_search("helper", 5).first().name == "helper"
    ids = {r.name: r.node_id for r in work.nodes.collect()}
    assert work.find_similar(ids["run"]).count() >= 0
    assert work.compare_symbols(ids["run"], ids["test_run"]).count() == 1
    assert work.cross_project_search("helper").count() == 0
    assert work.find_entry_points(["test_entry"]).count() == 1
    assert {r.section for r in work.get_curated_context("run helper").collect()} >= {"symbol"}
    assert work.get_ai_context(ids["helper"]).count() >= 1 and work.get_edit_context(ids["helper"]).count() >= 1
    assert work.analyze_coupling().count() == 2 and work.analyze_complexity()["functions"].count() == 5


def test_notes_and_history(spark, work):
    with pytest.raises(ValueError):
        notes.make(spark, "nonsense", "t", "c")
    with pytest.raises(ValueError):
        notes.make(spark, "convention", "t", "c", severity="high")
    at = datetime.datetime(2025, 1, 1)
    work.log = None
    work.memory_store(notes.make(spark, "debug_context", "Test Problem", "the ledger overflowed", ["test"], {7: 0.9}, note="n1", moment=at, problem_description="p"))
    work.memory_store(notes.make(spark, "known_issue", "Other", "slow import of ledgers", note="n2", moment=at, commit="h1"))
    assert work.memory_search("ledger overflowed", code=[7]).first().id == "n1"
    assert {r.id for r in work.memory_list().collect()} == {"n1", "n2"}
    assert [r.hash for r in work.mine_git_history().collect()] == []  # h1 is known, the other is nothing
    assert [r.hash for r in work.search_git_history("helper").collect()][0] == "h1"
    work.memory_invalidate("n1")
    assert work.memory_get("n1").count() == 0 and work.memory_get("n2").count() == 1
    assert {(r.kind, r.current) for r in work.memory_stats()["kinds"].collect()} == {("debug_context", 0), ("known_issue", 1)}
    assert work.hotspots(2).first().path == "a.py"
