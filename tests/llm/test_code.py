"""Lexers, grammars, documentation pairs and hand-written files: small cases, brute force, and odd rows."""

import ast
import inspect

import pytest

from codeloom.llm import docpairs, handwritten, repair, syntax
from codeloom.llm.lexing import CODE, language_of, scan
from codeloom.llm.source_code import broken_files, broken_rates, documented_functions, syntax_verdicts

GOOD = {
    "javascript": [
        "", "// only a comment", "const a = `x ${b ? `in ${c}` : '}'} y`;\n", "const r = s.replace(/[/({]\\//g, '(');\nlet q = a / b / c;\n", "export default class A extends B { static #x = 1; get y() { return this.#x } async *z() {} }\n",
        "for (const [k, v] of Object.entries(o)) { if (!k) continue\n else v() }\n", "let f = async (x) => ({ ...x, [k]: 1 })\nf()\n", "label: while (1) break label;", "a = b\n++c\n", "import x, { y as z } from './m.js';\nexport * from 'q';\n", "var o = { async, get, set, of: 1, get a() { return 1 }, b() {} };",
        "do x++; while (x < 5) y()\n", "if (a) b(); else c();", "switch (x) { case 1: case 2: y(); break; default: z() }", "x = a ? b : c ? d : e;", "new Foo(...args).bar?.[0]?.(1) ?? 2 ** 3;",
    ],
    "typescript": [
        "function f<T extends A = B>(this: X, a?: Map<string, number[]>, ...r: T[]): a is B { return a as unknown as B; }\n", "type A = { readonly [K in keyof T]?: T[K] } & Partial<B> | null;\n", "interface I<T> extends J { (a: number): string; new (): I<T>; m?(x: T): void; readonly k: 'x' | 1 }\n",
        "abstract class C<T> implements I { private readonly x: number = 1; constructor(public y?: string) { super(); } abstract f(): void; get z(): T { return this.q!; } }\n", "enum E { A = 1, B = 'x', C }\n", "const x = <T,>(a: T): a is T => true;\n", "declare module 'x' { export function f(a: number): void; }\n",
        "export type { A } from './a';\nimport type { B } from './b';\n", "let v = f<string>(x)!.y satisfies Z;\n", "@Dec() class A { @Inp() a: string; @Out()\n b = 1 }\n", "type F = (a: string, b?: number) => asserts a is string;\n", "let t: [a: string, b?: number, ...c: boolean[]] = x;\n",
    ],
    "go": [
        "package a\n", "package a\n\nimport (\n\t\"fmt\"\n\t. \"x\"\n)\n\ntype S[T any] struct {\n\ta, b int `json:\"x\"`\n\t*E\n}\n\nfunc (s *S[T]) F(a, b int, c ...string) (x int, err error) {\n\tfor i := range 10 {\n\t\tif v, ok := m[i]; ok {\n\t\t\treturn\n\t\t}\n\t}\n\tswitch t := x.(type) {\n\tcase int, []string:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\tcase d <- 1:\n\t}\n\tgo func() {}()\n\treturn 1, nil\n}\n",
        "package a\n\nvar x = map[string][]int{\"a\": {1, 2}, \"b\": nil}\n\nfunc g()\n", "package a\n\nconst (\n\tA = iota\n\tB\n)\n\nfunc f() {\n\tx := []T{{1, 2}, {a: 3}}\n\tx[1:2], y = 1, 'a'\n\tp := &q{}\n\tdefer p.f(a...)\n\tL:\n\tfor {\n\t\tbreak L\n\t}\n}\n",
    ],
    "java": [
        "", "package a.b;\nimport static java.util.List.*;\n@A(x = {1, 2}, y = \"z\")\npublic final class C<T extends Comparable<? super T>> extends D<T> implements E, F {\n  private static final int[][] X = {{1}, {2}};\n  C() { this(1); }\n  <R> R f(final List<? extends T> a, int... b) throws E { for (int i = 0, j = 1; i < 3; i++) ; for (var x : a) { } return (R) a.get(0); }\n  abstract int g();\n  static { }\n}\n",
        "class A { void f() { Runnable r = () -> g(1); Function<A, B> h = A::new; int x = a > b ? 1 : 2; try (var z = q(); w) { } catch (E | F e) { } finally { } switch (x) { case 1 -> y(); default -> { } } String s = \"\"\"\n  text \"quoted\"\n  \"\"\"; Object o = new int[]{1, 2}; if (o instanceof String t && !t.isEmpty()) return; } }\n", "enum E implements I { A(1) { int f() { return 1; } }, B; private int x; E() { } }\n", "record P(int x, String y) { P { } }\ninterface I { default int f() { return 1; } int g(); }\n",
    ],
    "rust": [
        "", "#![allow(x)]\nuse a::{b, c::*, d as e};\npub(crate) struct S<'a, T: Clone + 'a>(pub &'a T, u8) where T: Copy;\nenum E { A, B(i32), C { x: u8 }, D = 3 }\nimpl<'a, T> Tr for S<'a, T> where T: X<Item = u8> { const N: usize = 3; type O = T; fn f(&mut self, (a, b): (u8, &str)) -> Result<Vec<T>, Box<dyn E + Send>> { let Some(x) = y else { return None }; Ok(x?) } }\n",
        "fn f() { let c = '{'; let s = r#\"a \" {\"#; let l: &'static str = b\"x\"; match x { Some(n @ 1..=5) if n > 2 => {} A::B { x, .. } | C(_) => y(), _ => (), } for (i, v) in a.iter().enumerate() { if let Some(x) = v && x > 1 { continue 'l; } } let g = |x: u32| -> u32 { x * 2 }; let v = vec![1; 3]; println!(\"{}\", v[0] as f32); x.await?.y::<T>(); }\n", "macro_rules! m { ($x:expr) => { $x }; }\nm!{ a }\nextern \"C\" { fn g(x: *const u8) -> i32; }\nunsafe trait T: A { fn f(self: Box<Self>) where Self: Sized; }\n", "/* a /* nested */ b */ fn f<const N: usize>(x: [u8; N]) -> impl Fn(u8) -> u8 { move |y| y + x[0] }\n",
    ],
    "c": [
        "", "#include <a.h>\n#define F(x) ((x) * \\\n 2)\ntypedef struct { int a : 3; char *b[4]; } T;\nenum e { A, B = 2, };\nstatic const char *const s[] = { \"a\" \"b\", [2] = \"(\" };\nint f(void), g(int, char *);\nint (*fp)(int a, ...);\n",
        "unsigned long f(const T *x, int n[static 3]) { for (int i = 0; i < 3; i++) if (x) continue; else break; do { n[0]++; } while (n[0] < 3); switch (n[1]) { case 'a': case 2: ; default: goto end; } T y = { .a = 1 }; y = (T){ 0 }; *x->b[0] = (char) (sizeof(int) + sizeof y); end: return (unsigned) ~x->a ? 1 : 2; }\n", "extern \"C\" { int f(int); }\nstruct s; union u { int a; float b; };\nint a = 1, *b = &a;\n",
    ],
}
BAD = {
    "javascript": ["const x = ;", "function f( { }", "<<<<<<< HEAD\na();\n=======\nb();\n>>>>>>> x\n", "let a b;", "f(1, 2;", "const s = 'abc\n';", "/* open", "if (a { }", "function f(a: string) { }", "}", "`open ${a}", "<!DOCTYPE html>\n<html></html>", "x = 0b12;", "package main\nfunc f() {}\n", "class A { private x: number; }", "const x;", "const { a };"],
    "typescript": ["type A = ;", "interface I { a: }", "function f(a: ) {}", "package a;\npublic class B { }\n", "let x: Map<string = 1;", "... 3 lines omitted ..."],
    "go": ["func f() {}\n", "package a\nfunc f() {\n", "package a\nvar x int = \n", "package a\nclass A {}\n", "package a\nx := 1\n", "package a\nfunc f() { if x { }\n", "package a\nfunc f(a int b int) {}\n", "package a\n\0\n", "package a\nfunc f() { switch x := y.() { } }\n", "package a\nvar x = map[string][]int{\"a\" {1}}\n", "package a\nfunc f() { g(type) }\n", "package a\nvar s = \"open\n"],
    "java": ["class A {", "class A { void f() { int x = 1 } }", "class A { void f( { } }", "def f(): pass\n", "class A { void f() { (x); } }", "class A { void f() { y; } }", "class A { int f() { return 1; } } }", "class A { void f() { x = 'ab; } }", "package a;\nimport b\nclass C { }", "```java\nclass A { }\n```\n"],
    "rust": ["fn f( { }", "fn f() { let x = }", "pub fn f() -> u8", "fn f() { let x: = 1; }", "class A { }", "fn f() { \"open }", "/* /* */ fn f() {}", "fn f() {}}", "fn f\ufffdg() {}", "import a from 'b';"],
    "c": ["int f( {", "int x = ;", "int f(void) { return 1 }", "public class A { };", "int a[3;", "char *s = \"open\n;", "fn f() -> u8 { 1 }", "int f(int a { return 1; }"],
}


@pytest.mark.parametrize("lang, code", [(k, c) for k, cs in GOOD.items() for c in cs])
def test_valid(lang, code):
    assert syntax.parses(lang, code)
    assert syntax.parses(lang, "\ufeff" + code)
    if lang != "go":
        assert syntax.parses(lang, code.replace("\n", "\r\n"))


@pytest.mark.parametrize("lang, code", [(k, c) for k, cs in BAD.items() for c in cs])
def test_invalid(lang, code):
    assert not syntax.parses(lang, code)


def test_python_is_cpython():
    for code in ("def f(:\n  pass", "x = 1", "a\0b", "if x:\npass", "match x:\n    case 1: pass\n", ""):
        try:
            ast.parse(code)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        assert syntax.parses("python", code) is ok


@pytest.mark.parametrize("lang", ["javascript", "typescript", "go", "java", "rust", "c"])
def test_chunks_reduce_in_any_grouping(lang):
    """Verdicts and summaries do not depend on where a file is cut (here at every line end), nor on how chunks are grouped."""
    p = syntax.parser(lang)
    for code in GOOD[lang] + BAD[lang] + ["/* a\nb\nc */\n" + GOOD[lang][-1], GOOD[lang][-1] + "\n/* open\n"]:
        for text in (code, code.replace("; ", ";\n").replace("{ ", "{\n").replace(", ", ",\n"), code + "\n/* a\n */\n/ 2;\n"):
            maps = [syntax.state_map(lang, part, k == 0) for k, part in enumerate(syntax.chunks(text, 1))]
            left = syntax.reduce_maps(lang, maps)
            assert syntax.verdict(lang, left) is syntax.parses(lang, text), text
            right = maps[-1]
            for m in reversed(maps[:-1]):
                right = syntax.join_maps(lang, m, right)
            assert right[CODE][0] == left[CODE][0] and p.valid(*right[CODE]) is p.valid(*left[CODE])


def test_scan_keeps_offsets():
    code = "a = 'x' // c\nb = `t\n${1}`; /* d\n */ e"
    s = scan(code, "javascript")
    assert len(s.masked) == len(code) and s.masked.count("\n") == 2 and s.state == CODE
    assert scan("x = 'a", "javascript").error and scan("/* /* */", "rust").state == "/*1"


def test_language():
    assert [language_of(p) for p in ("a/b.PY", "x.h", "x", None, "a.tar.rs", "b.xyz")] == ["python", "c", None, None, "rust", None]


DOCS = {
    "a.py": ('def a():\n    """Counts the rows of the table."""\n\nclass B:\n    @dec\n    async def c(self):\n        r\'\'\'Walks up the tree.\'\'\'\n        def d(): "says what it does here"\n\ndef e():\n    f"""Not a docstring at all."""\n\ndef g():\n    """TODO: document"""\n\nx = "def h():  # text"\n', {("a", 1), ("c", 6), ("d", 8)}),
    "a.js": ("/** Adds two numbers together. */\nexport function add(a, b) {}\n/** Says nothing. */\n\nfunction gap() {}\n/**\n * Keeps the newest entry.\n * @param {X} a\n */\nexport const keep = async (a) => {};\n/* plain comment here, no doc */\nfunction p() {}\nclass C {\n  /** Reads the next block. */\n  static async read(x) {}\n  /** mul */\n  mul() {}\n}\nconst o = {\n  /** Handles the request once. */\n  once() {}\n};\ns = '/** Inside a string it is. */ function q() {}';\n", {("add", 2), ("keep", 10), ("read", 15), ("once", 21)}),
    "a.ts": ("/** Finds the user by id. */\n// other\nfunction no() {}\n\n\nabstract class A {\n  /** Sends the whole batch. */\n  @Log()\n  protected send(a: { x: number }, b?: Map<string, T[]>): Promise<void> { }\n  /** Must be given by children. */\n  abstract part(): { a: number };\n}\ninterface I {\n  /** Opens the named file. */\n  open(name: string): void;\n}\n", {("send", 9), ("part", 11), ("open", 15)}),
    "a.go": ("package a\n\n// Run starts the loop and waits.\n// It never returns.\nfunc Run[T any](x T) {\n}\n\n// Detached comment about nothing.\n\nfunc Gap() {}\n\n// Stop ends all of the workers.\nfunc (s *S) Stop() {}\n\n//go:noinline\nfunc Fast() {}\n// Fast\nfunc Fast2() {}\n", {("Run", 5), ("Stop", 13)}),
    "A.java": ("class A {\n  /** Opens the door for guests. */\n  A(int x) { }\n  /**\n   * Gives the number of rows.\n   */\n  @Override\n  public Map<String, List<Integer>> size(final int[] a) throws E { return f(1); }\n  /** {@inheritDoc} */\n  int g();\n  /** Asked of all children here. */\n  abstract void h();\n}\n", {("A", 3), ("size", 8), ("h", 12)}),
    "a.rs": ("/// Adds one to every element.\n#[inline]\npub(crate) async fn add<'a>(x: &'a str) {}\n//// not a doc comment at all\nfn n() {}\nimpl X {\n    /** Takes the lock and waits. */\n    fn take(&self) {}\n    /// noqa\n    fn q() {}\n}\n//! inner doc for all\nfn z() {}\n", {("add", 3), ("take", 8)}),
    "a.c": ("/// Frees everything that was taken.\nstatic void drop_all(struct s *x);\n/**\n * Copies the whole buffer over.\n */\nint *copy(int a)\n{\n  /** Inside of a body it is. */\n  other(a);\n}\n/** A macro is not a function. */\n#define F(x) x\n", {("drop_all", 2), ("copy", 6)}),
}


@pytest.mark.parametrize("path", sorted(DOCS))
def test_documented(path):
    code, wanted = DOCS[path]
    lang = language_of(path)
    got = {(d.name, d.line_no) for d in docpairs.documented(code, lang) if not docpairs.is_trivial(d.doc, d.name)}
    assert got == wanted
    # What documentation leads to is what a search for all declarations finds with documentation.
    assert [d for d in docpairs.declarations(code, lang) if d.doc is not None] == docpairs.documented(code, lang)


@pytest.mark.parametrize(
    "doc, name, trivial",
    [
        (None, "f", True), ("  ", "f", True), ("!!", "f", True), ("====", "f", True), ("Find user.", "find_user", True), ("findUser", "findUser", True), ("The find user function.", "findUser", True), ("Builds the header.", "buildHeader", True), ("TODO", "f", True),
        ("Noch nicht dokumentiert.", "f", True), ("Documentación pendiente.", "f", True), ("See above.", "f", True), ("@param a\n@return", "f", True), (":param x:\n:return:", "f", True), ("noqa", "f", True), ("pylint: disable=x", "f", True), ("(no description)", "f", True), ("{@inheritDoc}", "f", True),
        ("Deprecated.", "f", True), ("Function f.\n\n:param x:", "f", True), ("Returns the oldest row, or nothing.", "oldest", False), ("@param a the row to start from", "f", False), ("Internal.\nReads the next block from disk.", "f", False), ("Liest die Datei zeilenweise.", "read", False), ("Not safe to call twice.", "f", False),
    ],
)
def test_trivial(doc, name, trivial):
    assert docpairs.is_trivial(doc, name) is trivial


FILES = "file_id bigint, project string, path string, code string, kind string, lang string, broken string"


def test_operators_take_odd_rows(spark):
    rows = [
        (1, "p", "a.py", "def f(:\n", "x", "y", "z"), (1, "p", "a.py", "def f(:\n", "x", "y", "z"), (2, "p", "b.py", None, None, None, None), (3, None, "c.js", "", None, None, None), (4, "q", None, "x", None, None, None),
        (5, "q", "d.txt", "((", None, None, None), (None, "q", "e.go", "func", None, None, None), (6, "q", "f.c", "int x;", None, None, None), (7, "q", "g.py", 'def f():\n    """Does it well enough."""\n', None, None, None),
    ]
    df = spark.createDataFrame(rows, FILES)
    assert [r.file_id for r in broken_files(df).collect()] == [1]
    assert {(r.project, r.language, r.files, r.broken_files) for r in broken_rates(df.where("file_id IS NOT NULL")).collect()} == {("p", "python", 1, 1), (None, "javascript", 1, 0), ("q", "c", 1, 0), ("q", "python", 1, 0)}
    assert [(r.file_id, r.line_no, r.fn_name) for r in documented_functions(df).collect()] == [(7, 1, "f")]
    empty = df.limit(0)
    assert broken_files(empty).count() == documented_functions(empty).count() == broken_rates(empty).count() == 0


def test_long_files_are_cut(spark):
    body = "function f() {\n  /* a\n b */ return `x\n${1}`;\n}\n" * 200
    rows = [(1, "p", "a.js", body, None, None, None), (2, "p", "b.js", body + "}\n", None, None, None), (3, "p", "c.py", "x = 1\n" * 2000, None, None, None)]
    got = {r.file_id: r.broken for r in syntax_verdicts(spark.createDataFrame(rows, FILES), chunk_chars=500).collect()}
    assert got == {1: False, 2: True, 3: False}


# Grammars -----------------------------------------------------------------------------------------------------------


def test_repair():
    import numpy as np

    rng = np.random.default_rng(1)
    noise, repeat, empty = rng.integers(0, 200, 2000), np.tile(np.arange(10), 200), np.zeros(0, dtype=np.int64)
    g = repair.infer([noise, repeat, empty, np.zeros(1000, dtype=np.int64)])
    assert list(g.length) == [2000, 2000, 0, 1000]
    assert g.size[1] < 60 and g.size[3] < 40 and g.size[2] == 0 and g.size[0] > 1200
    assert g.bits[0] > 0.8 * g.plain_bits[0] and g.bits[1] < 0.1 * g.plain_bits[1]


def test_phrases_are_the_same_wherever_text_stands():
    import numpy as np

    rng = np.random.default_rng(2)
    shared = rng.integers(0, 2**63, 600).astype(np.uint64)
    a = np.r_[rng.integers(0, 2**63, 300).astype(np.uint64), shared]
    b = np.r_[shared, rng.integers(0, 2**63, 500).astype(np.uint64)]
    doc, rule, weight = repair.phrases([a, b], 32)
    both = set(rule[doc == 0].tolist()) & set(rule[doc == 1].tolist())
    mass = weight[(doc == 0) & np.isin(rule, list(both))].sum()
    assert mass > 400 and weight[doc == 0].sum() == 900
    assert len(repair.phrases([], 8)[0]) == 0 and len(repair.phrases([np.zeros(0, dtype=np.uint64)], 8)[0]) == 0


def _hand(k):
    import random

    r = random.Random(k)
    w = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "zeta", "theta"]
    lines = ["import os", ""]
    for j in range(8):
        a, b, c = r.sample(w, 3)
        lines.append(f"def {a}_{j}({b}, {c}={r.randint(1, 99)}):")
        for _ in range(r.randint(2, 6)):
            lines.append(r.choice([f"    {a} = {b} + {r.randint(1, 999)}", f"    if {c} is None:\n        return {r.choice(w)}({b})", f"    for x in {b}:\n        {r.choice(w)}.append(x * {r.randint(2, 9)})", f"    print('{r.choice(w)} {r.choice(w)}', {a}[{r.randint(0, 9)}])", f"    with {r.choice(w)}({c}) as f: f.write({b!r})"]))
        lines.append(f"    return {c}\n")
    return "\n".join(lines)


def test_handwritten(spark):
    import base64
    import random

    lib = _hand(1000)
    blob = base64.b64encode(random.Random(1).randbytes(2000)).decode()
    rows = [
        (1, "p", "src/a.py", _hand(1)), (2, "p", "src/b.py", "\n".join(f"def get_{k}(self):\n    return self.data[{k}]\n" for k in range(60))), (3, "p", "src/c.py", f"X = '{blob}'\n"), (4, "p", "src/d.py", lib), (5, "q", "src/e.py", "# moved here\n" + lib.replace("import os", "import os  # changed")),
        (6, "q", "node_modules/x/f.py", _hand(2)), (7, "q", "src/vendor_portal/g.py", "# This code generates the stubs; the stubs carry a DO NOT EDIT banner.\n" + _hand(3)), (8, "q", "src/h.py", "# Code generated by x. DO NOT EDIT.\nA = 1\n"), (9, None, "src/i.py", None), (10, None, None, ""),
        (11, "q", "src/j.py", _hand(4) + "NAMES = 'a|b|" + "|".join(f"name{k % 7}" for k in range(80)) + "'\n"), (12, "q", "src/k.js", "!function(e,t){" + "".join(f"var n{k}=e.a{k % 9}(t[{k}],{k % 5}?r:o);if(n{k})return i({k});" for k in range(60)) + "}(window);"), (1, "p", "src/a.py", _hand(1)),
    ]
    df = spark.createDataFrame(rows, "file_id bigint, project string, path string, code string")
    got = {r.file_id: r.kind for r in handwritten.not_handwritten(spark, df).collect()}
    assert got.pop(12) in ("minified", "generated")
    assert got == {2: "generated", 3: "encoded", 5: "vendored", 6: "vendored", 8: "generated"}  # the original, 4, stays
    known = spark.createDataFrame([("l", "f.py", _hand(1))], "library string, file_name string, code string")
    assert {r.file_id for r in handwritten.not_handwritten(spark, df, known).collect()} == set(got) | {1, 12}
    assert handwritten.not_handwritten(spark, df.limit(0), known).count() == 0


def test_copies_and_originals(spark):
    lib, own = _hand(1000), _hand(3)
    tiny = "def f(a, b):\n    return [a + 1, b * 2, a - b, {a: b}, (a, b, 7), a.x(b)]\n"
    rows = [
        (20, "late", "src/copy.py", lib, 50), (21, "early", "src/lib.py", lib, 10), (22, "third", "src/again.py", lib.replace("import os", "import os, sys"), 60),
        (23, "early", "deps/own/x.py", own, 5), (24, "early", "src/x.py", own, 6), (25, "late", "vendor/lib/y.py", _hand(1002), 70),
        (26, "early", "a/t.py", tiny, 1), (27, "late", "a/t.py", tiny, 2), (28, "late", "b/one.py", "x = 1\n", 3), (29, "early", "b/one.py", "x = 1\n", 3),
    ]
    df = spark.createDataFrame(rows, "file_id bigint, project string, path string, code string, since bigint").selectExpr("*", "timestamp_micros(since) AS modified_at")
    kinds = lambda d, known=None: {r.file_id: r.kind for r in handwritten.not_handwritten(spark, d, known).collect()}
    # 23 lies in a third-party folder, but its project holds the same code elsewhere; 25 is nobody's else.
    assert kinds(df) == {20: "vendored", 22: "vendored", 25: "vendored", 27: "vendored"}
    assert set(kinds(df.drop("modified_at"))) == {21, 22, 25, 27}  # without dates the least file_id is the original
    known = spark.createDataFrame([("tiny.py", tiny), ("lib.py", lib), (None, None)], "file_name string, code string")
    assert set(kinds(df, known)) == {20, 21, 22, 25, 26, 27}


def test_claims_only_lower_thresholds():
    hand = inspect.getsource(repair.infer)
    rows = "".join(f"def get_{k}(self, key_{k}, other={k % 3}):\n    self.check(key_{k})\n    return self.data[{k}]{'.copy()' if k % 2 else ''}\n" for k in range(30))
    kinds = handwritten.measure(["gen/generated/a.py", "a.py", "a_pb2.py"], ["# Code generated by x. DO NOT EDIT.\n" + hand, "# Generated by hand, honestly.\n" + hand, rows]).kinds
    assert kinds == [None, None, "generated"]


def test_batches_by_size():
    import pandas as pd

    f = pd.DataFrame({"code": ["a" * n for n in (10, handwritten.BATCH_CHARS, 5, 5, handwritten.BATCH_CHARS * 2)] + ["b"] * 1200})
    parts = list(handwritten._batches(f))
    assert sum(map(len, parts)) == len(f) and [len(p) for p in parts][:4] == [1, 1, 2, 1] and max(map(len, parts)) == handwritten.BATCH_FILES


def test_grammars_do_not_depend_on_the_batch():
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(0, 9, 300), np.tile(rng.integers(0, 20, 15), 10)])
    alone = repair.infer([x])
    among = repair.infer([rng.integers(0, 30, 500), x, x[:40], x])
    for name in ("size", "bits", "plain_bits"):
        assert getattr(alone, name)[0] == getattr(among, name)[1] == getattr(among, name)[3]


BODIES = {
    "python": ('class A:\n    @dec\n    def f(self, a=(\n1,\n)):\n        """Keeps the whole of it."""\n        x = """\nflat\n"""\n        y = [\n1]\n        z = 1 + \\\n2\n# note\n        return x\n\n    b = 1\n', "def f(self", "return x"),
    "javascript": ("/** Keeps the whole of it. */\nexport const f = async (a) => a\n  .b({ c: 1 })\n  .d;\nf()\n", "export const f", ".d"),
    "typescript": ("class A {\n  /** Keeps the whole of it. */\n  @D()\n  async f(a: { b: 1 }): Promise<{ c: 1 }> {\n    return `}${1}`; // }\n  }\n  g() {}\n}\n", "async f", "// }\n  }"),
    "go": ("package a\n\n// F keeps the whole of it.\nfunc (s *S) F(a map[string]interface{}) (x interface{}, e struct{ y int }) {\n\tif a { return }\n}\n\nfunc G() {}\n", "func (s *S) F", "return }\n}"),
    "java": ("class A {\n  /** Keeps the whole of it. */\n  @X({1})\n  public int[] f(int a) throws E { while (a) { } return 1; }\n  int g() { }\n}\n", "public int[] f", "return 1; }"),
    "rust": ("/// Keeps the whole of it.\n#[x]\npub fn f<T>(a: T) -> [u8; 4] where T: X { match a { _ => {} } }\nfn g() {}\n", "pub fn f", "{} } }"),
    "c": ("/** Keeps the whole of it. */\nstatic int\n*f(int a[3])\n{\n  char c = '}';\n}\nint g(void);\n", "static int\n*f", "'}';\n}"),
}


@pytest.mark.parametrize("lang", sorted(BODIES))
def test_code_of_pairs(lang):
    text, start, end = BODIES[lang]
    assert syntax.parses(lang, text)
    (found,) = docpairs.documented(text, lang)
    assert found.code.startswith(start) and found.code.endswith(end), found.code
    assert [d for d in docpairs.declarations(text, lang) if d.doc is not None] == [found]
    assert docpairs.documented(text, lang, texts=False, says=True)[0][:2] == found[:2]


def test_bodiless_declarations():
    (a,) = docpairs.documented("/** Keeps the whole of it. */\nint f(void);\nint g(void) { }\n", "c")
    (b,) = docpairs.documented("trait A {\n    /// Keeps the whole of it.\n    fn f(&self) -> u8;\n    fn g(&self) {}\n}\n", "rust")
    (c,) = docpairs.documented("/** Keeps the whole of it. */\ndeclare function f(a: number): void;\nfunction g() {}\n", "typescript")
    assert (a.code, b.code, c.code) == ("int f(void);", "fn f(&self) -> u8;", "declare function f(a: number): void;")
