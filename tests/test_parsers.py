"""Extraction in sixteen languages, and an indexed tree that answers what the operators ask."""

import pytest
from pyspark.sql import functions as F

from codeloom.api import Workspace
from codeloom.functions.rules import LANGUAGES
from codeloom.sources import parsers

EXTENSIONS = {e: lang for lang, exts in LANGUAGES.items() for e in exts.split()}
#: path, code, imports (module, names, target), then for some symbols (name, what is expected of it).
SAMPLES = [
    ("p/a.py", 'import os\nfrom ..b import helper, Thing as T\nclass A(Base, m.Other):\n    """Doc A."""\n    @property\n    async def f(self, a: Foo, *b) -> Bar:\n        """Doc f."""\n        if a and b:\n            return requests.get(a)\n        for x in b:\n            helper(x)\n', [("os", [], None), ("..b", ["helper", "Thing"], "b")],
     {"A": dict(node_type="Class", extends=["Base", "Other"], doc="Doc A."), "f": dict(is_async=True, return_type="Bar", param_count=2, attributes=["@property"], doc="Doc f.", calls=["get", "helper", "requests.get"], shape=(1, 1, 1, 1, 0, 1))}),
    ("s/a.ts", "import { x, type Y as Z } from '../m';\nimport fs from 'fs';\n/** Doc C. */\nexport class C<T> extends B implements I, J {\n  /** Doc m. */\n  @Log()\n  private async m(a: Foo, b?: Map<string, number>): Promise<Bar> {\n    if (a && b) { return axios.get(a); }\n    for (const q of b) { g(q); }\n    return new Baz();\n  }\n}\nexport const f = (a: number) => a + 1;\nfunction g(a) { m(a); }\n// call(x) {}\ntype U = string;\n", [("../m", ["x", "Y"], "m"), ("fs", ["fs"], None)],
     {"C": dict(extends=["B"], implements=["I", "J"], line_end=12), "m": dict(visibility="private", is_async=True, return_type="Promise<Bar>", param_count=2, doc="Doc m.", attributes=["@Log()"], types=["Bar", "Baz", "Foo"], shape=(1, 1, 1, 1, 0, 1)), "f": dict(param_count=1, is_public=True), "g": dict(is_public=False, calls=["m"]), "U": dict(node_type="Type")}),
    ("a.go", 'package a\nimport (\n\t"fmt"\n\tx "a/b"\n)\n// Run doc.\nfunc (s *S) Run(a int, b ...Foo) (Bar, error) {\n\tif a > 1 { return fmt.Println(a) }\n\treturn nil\n}\ntype S struct {\n a int\n}\ntype I interface { M() }\nfunc lower() interface{} { Run() }\n', [("fmt", [], None), ("a/b", [], None)],
     {"Run": dict(is_public=True, return_type="(Bar, error)", param_count=2, doc="Run doc.", line_end=10), "lower": dict(visibility="private", calls=["Run"]), "S": dict(node_type="Class"), "I": dict(node_type="Interface")}),
    ("A.java", "package p;\nimport a.b.Foo;\nimport static a.B.*;\n/** Doc A. */\n@Entity\npublic class A extends B<X> implements I, J {\n  @Override\n  public static List<Foo> f(int a, Map<K, V> b) throws E {\n    while (a > 1 || b) { try { g(a); } catch (E e) { } }\n    return null;\n  }\n  A(int x) { this.x = x; }\n}\ninterface I { void q(); }\n", [("a.b.Foo", ["Foo"], None), ("a.B", [], None)],
     {"A": dict(extends=["B"], implements=["I", "J"], attributes=["@Entity"], doc="Doc A."), "f": dict(is_static=True, return_type="List<Foo>", param_count=2, attributes=["@Override"], shape=(0, 1, 1, 2, 1, 0))}),
    ("d/a.rs", "use std::collections::{HashMap, HashSet};\nuse crate::foo::Bar;\nmod sub;\n/// Doc S.\n#[derive(Debug)]\npub struct S { a: u8 }\nimpl Tr for S {\n  /// Doc f.\n  #[inline]\n  pub async fn f(&self, a: &Foo, b: u8) -> Result<Bar, E> { match a { _ => g(b) } if x { return 1; } }\n}\nfn g(b: u8) {}\npub trait T { }\n", [("std::collections", ["HashMap", "HashSet"], None), ("crate::foo", ["Bar"], None), ("sub", [], "d/sub")],
     {"S": dict(implements=["Tr"], attributes=["#[derive(Debug)]"], doc="Doc S."), "f": dict(is_async=True, return_type="Result<Bar, E>", param_count=2, is_public=True), "g": dict(visibility="private"), "T": dict(node_type="Interface")}),
    ("a.c", '#include <stdio.h>\n#include "x.h"\n/* Doc f. */\nstatic int *f(struct S *a, int b)\n{\n  if (b) return g(a);\n  return 0;\n}\nint main(void) { f(1); }\n', [("stdio.h", [], "stdio"), ("x.h", [], "x")], {"f": dict(visibility="private", return_type="int *", param_count=2, doc="Doc f.", line_end=8), "main": dict(param_count=0, calls=["f"])}),
    ("a.cpp", '#include "b.hpp"\nnamespace n {\nclass A : public B, private C<D> {\npublic:\n  A(int x) : x_(x) {}\n  // Doc f.\n  virtual int f(const Foo& a, int b) const { return g(a); }\nprivate:\n  void h() { }\n};\n}\nint n::A::k(int z) { for (;;) { f(z); } }\n', [("b.hpp", [], "b")],
     {"A": dict(extends=["B", "C"]), "f": dict(return_type="int", param_count=2, visibility="public", doc="Doc f."), "h": dict(visibility="private"), "k": dict(param_count=1)}),
    ("a.cs", 'using System.Text;\nnamespace N {\npublic class A : B, IC {\n  /// Doc f.\n  [HttpGet("/x")]\n  public async Task<Foo> F(int a, string b) { if (a > 1) { return await G(a); } return null; }\n  int H() => 1;\n}\n}\n', [("System.Text", [], None)], {"A": dict(extends=["B"], implements=["IC"]), "F": dict(is_async=True, return_type="Task<Foo>", attributes=['[HttpGet("/x")]'], doc="Doc f."), "H": dict(visibility="private")}),
    ("a.kt", "import a.b.Foo\nimport c.*\n/** Doc A. */\ndata class A(val x: Int) : B(x), I {\n  @Test\n  private suspend fun f(a: Foo, b: Int = 1): Bar { if (a == null) return g(b); return h() }\n  fun one(x: Int) = x + 1\n}\n", [("a.b.Foo", ["Foo"], None), ("c", [], None)], {"A": dict(extends=["B"], implements=["I"]), "f": dict(is_async=True, visibility="private", return_type="Bar", param_count=2), "one": dict(line_end=7)}),
    ("a.php", "<?php\nuse A\\B\\Foo;\nrequire_once 'lib/x.php';\nclass A extends B implements I, J {\n  #[Route('/x')]\n  private static function f(Foo $a, int $b): Bar { if ($a) { return g($b); } return new Baz(); }\n}\n", [("A\\B\\Foo", ["Foo"], None), ("lib/x.php", [], "lib/x")], {"A": dict(extends=["B"], implements=["I", "J"]), "f": dict(is_static=True, visibility="private", return_type="Bar", attributes=["#[Route('/x')]"])}),
    ("a.rb", "require 'json'\nrequire_relative 'lib/x'\nmodule M\n  # Doc A.\n  class A < B\n    # Doc f.\n    def self.f(a, b = 1)\n      if a && b\n        return g(b)\n      end\n      b.each do |x|\n        foo.bar x\n      end\n    end\n    private\n    def sq(x) = x * x\n    def h; end\n  end\nend\n", [("json", [], None), ("lib/x", [], "lib/x")],
     {"M": dict(node_type="Module", line_end=19), "A": dict(extends=["B"], doc="Doc A.", line_end=18), "f": dict(is_static=True, param_count=2, doc="Doc f.", line_end=14), "sq": dict(line_end=16, visibility="private"), "h": dict(visibility="private")}),
    ("a.swift", "import Foundation\n/// Doc A.\npublic class A: B, P {\n  @objc\n  private static func f(_ a: Foo, b: Int) async throws -> Bar { guard a else { return g(b) }; return h() }\n}\nprotocol P { }\n", [("Foundation", [], None)], {"A": dict(extends=["B"], implements=["P"], doc="Doc A."), "f": dict(is_async=True, is_static=True, return_type="Bar", param_count=2), "P": dict(node_type="Interface")}),
    ("a.f90", "module m\n  use iso_c, only: c_int, c_ptr\n  type, extends(base) :: T\n    integer :: a\n  end type T\ncontains\n  ! Doc f.\n  subroutine f(a, b)\n    if (a > 1) then\n      call g(b)\n    end if\n    do i = 1, 2\n      x = 1\n    end do\n  end subroutine f\nend module m\n", [("iso_c", ["c_int", "c_ptr"], None)], {"m": dict(line_end=16), "T": dict(extends=["base"], line_end=5), "f": dict(param_count=2, calls=["g"], doc="Doc f.", line_end=15)}),
    ("a.tcl", "package require Tk\n# Doc f.\nproc f {a b} {\n  if {$a} { g $b }\n  return [h 1]\n}\n", [("Tk", [], None)], {"f": dict(param_count=2, calls=["g", "h"], doc="Doc f.", line_end=6)}),
    ("a.cob", "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. PAYROLL.\n       COPY REC.\n       PROCEDURE DIVISION.\n       MAIN-PARA.\n           PERFORM CALC-PARA\n           IF A > 1 DISPLAY 'X'.\n       CALC-PARA.\n           ADD 1 TO A.\n", [("REC", [], None)], {"PAYROLL": dict(node_type="Class"), "MAIN-PARA": dict(calls=["CALC-PARA"], line_end=7)}),
    ("a.v", '`include "defs.vh"\n// Doc m.\nmodule m(input a, output b);\n  function [7:0] f(input x);\n    if (x) f = g(x);\n  endfunction\nendmodule\n', [("defs.vh", [], "defs")], {"m": dict(node_type="Class", doc="Doc m.", line_end=7), "f": dict(param_count=1, calls=["g"], line_end=6)}),
]


@pytest.mark.parametrize("path, code, imports, wanted", SAMPLES, ids=[s[0] for s in SAMPLES])
def test_extraction(path, code, imports, wanted):
    lang = EXTENSIONS[path.rsplit(".", 1)[1]]
    found = parsers.parse(path, lang, code)
    assert [tuple(i) for i in found.imports] == imports
    by_name = {}
    for s in found.symbols:
        by_name.setdefault(s.name, s)
    for name, expected in wanted.items():
        got = {k: tuple(v) if isinstance(v, tuple) else v for k, v in vars(by_name[name]).items()}
        assert {k: got[k] for k in expected} == expected


def test_every_language_of_the_list():
    assert set(LANGUAGES) - {"python"} <= set(parsers._PATTERNS) | {"typescript", "javascript"}
    assert {EXTENSIONS[s[0].rsplit(".", 1)[1]] for s in SAMPLES} >= set(LANGUAGES) - {"javascript"}


@pytest.mark.parametrize("lang", sorted(parsers._PATTERNS))
def test_odd_text(lang):
    for code in ("", "\n", "{{{", ")))", "\"", "/* open", "'", "(" * 2000, "function f(", "class", "\0", "é ü"):
        parsers.parse("x", lang, code)
    assert parsers.rows_of("x.py", "python", "def f(:")[0][2] is False


TREE = {
    "app/main.py": '"""Entry."""\nfrom app.util import helper, Tool\nimport requests\n\n\ndef main():\n    """Runs everything."""\n    t = Tool()\n    if t:\n        for x in range(3):\n            helper(x)\n    return requests.get("/users/7")\n',
    "app/util.py": 'import os\n\n\nclass Base:\n    pass\n\n\nclass Tool(Base):\n    def go(self, n: int) -> str:\n        return helper(n)\n\n\ndef helper(x):\n    return x\n\n\ndef _never(a, b, c):\n    return 1\n',
    "app/__init__.py": "",
    "web/view.ts": "import { send } from './net';\nexport class View extends Page implements Shown {\n  @Get('/users/:id')\n  show(id: string): Html { return send(id); }\n}\n",
    "web/net.ts": "export function send(a) { return a ? 1 : 2; }\nexport class Page { }\nexport interface Shown { }\nexport class Html { }\n",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tree")
    for name, code in TREE.items():
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_text(code)
    return Workspace.index_directory(spark, [str(folder)], "demo")


def test_an_indexed_tree_answers(tree):
    n, e = tree.nodes, tree.edges
    names = n.select(F.col("node_id").alias("id"), "name", "node_type")
    links = {
        (r.edge_type, r.a, r.b)
        for r in e.join(names.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst").collect()
    }
    assert {("Imports", "main.py", "requests"), ("Imports", "main.py", "util.py"), ("Imports", "main.py", "helper"), ("Imports", "main.py", "Tool"), ("Imports", "view.ts", "net.ts"), ("Imports", "view.ts", "send")} <= links
    assert {("Calls", "main", "helper"), ("Calls", "main", "Tool"), ("Calls", "go", "helper"), ("Calls", "show", "send"), ("Extends", "Tool", "Base"), ("Extends", "View", "Page"), ("Implements", "View", "Shown"), ("References", "show", "Html")} <= links
    assert ("Contains", "Tool", "go") in links and ("Contains", "util.py", "go") in links
    ids = {r.name: r.node_id for r in n.collect()}
    path = {r.name: r.path for r in n.collect()}
    assert {r.node_id for r in tree.find_by_imports(["requests"]).collect()} == {ids["main.py"]}
    assert {r.name for r in tree.get_dependency_graph(path["main.py"]).collect()} >= {"main.py", "util.py"}
    assert [r.complexity for r in tree.analyze_complexity(path["main.py"])["functions"].collect()] == [3]
    assert {r.name for r in tree.find_unused_code(confidence=0.1).collect()} >= {"_never"}
    assert "helper" not in {r.name for r in tree.find_unused_code(confidence=0.1).collect()}
    assert {r.name for r in tree.find_by_signature(params=(3, 3)).collect()} == {"_never"}
    assert {r.name for r in tree.find_by_signature(returns="str").collect()} == {"go"}
    coupling = {r.path: r for r in tree.analyze_coupling().collect()}
    assert coupling[path["main.py"]].efferent >= 1 and coupling[path["util.py"]].afferent >= 1
    assert tree.symbol_search("runs everything", 5).first().name == "main"
