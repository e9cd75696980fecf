"""Source files that shortcuts of the syntax check once refused, or judged by their size."""

import pytest

from codeloom.llm import syntax
from codeloom.llm.source_code import broken_files, chunk_verdicts, documented_functions, syntax_verdicts

RESERVED = {
    "rust": ["mod tests { impl Tr for Mock { fn a(&self) {} } }\n", "impl S { fn m<F>(&self, f: F) where F: for<'a> Fn(&'a str) -> u8 { } }\n", "impl S { const N: usize = if A { 1 } else { 2 }; }\n", "trait T { const N: u8 = match A { 1 => 2, _ => 3 }; }\n"],
    "javascript": ["f(gen.return(1), p.throw(x));\n", "x = [a.for, b.if];\n", "y = { if: 1, return() {}, for: b.while };\n", "class A { return() {} throw(e) {} static if = 1; }\n", "import { default as x, if as y } from 'm';\n"],
    "typescript": ["class A { constructor(\n  @Inject(X)\n  private x: Y) { } }\n", "interface I { return(v: T): R; throw?(e: E): R; if: 1 }\n", "enum E { if, for = 2, return }\n", "let v: Map<a.for, b> = f(it.return!());\n"],
    "java": ["class A { int x = switch (y) { case 1 -> 2; default -> 3; }; }\n"],
}


@pytest.mark.parametrize("lang, code", [(k, c) for k, cs in RESERVED.items() for c in cs])
def test_reserved_words_where_the_grammar_takes_them(lang, code):
    assert syntax.parses(lang, code)


@pytest.mark.parametrize("lang", ["javascript", "typescript", "go", "java", "rust", "c"])
def test_foreign_characters_are_those_no_match_holds(lang):
    """Content of every group of the samples: a role that Grammar.foreign rules out is one whose pattern doesn't match."""
    from tests.llm.test_code import BAD, GOOD

    p = syntax.Parser(lang)
    for code in GOOD[lang] + BAD[lang] + RESERVED.get(lang, []):
        p.summarise(code)
    assert p.cache
    for opener, content in p.cache:
        flat = p.breaks(content)
        for _, name, _, foreign in p.roles[opener]:
            if foreign and foreign.search(flat):
                assert not p.grammar.roles[name].fullmatch(flat), (name, flat)


FILES = "file_id bigint, project string, path string, code string"
FUNCTION = "func f() {\n\tg(\n\t\t1,\n\t)\n}\n"


def test_repeated_long_files_are_judged_once(spark):
    go, js = "package a\n\n" + FUNCTION * 100, "function f() {\n  g(\n1)\n}\n" * 100
    rows = [(1, "p", "a.go", go), (1, "p", "a.go", go), (2, "p", "b.js", js), (2, "p", "b.js", js), (3, "p", "c.js", js), (4, "p", "d.js", js + "}\n"), (4, "p", "d.js", js), (5, "p", "e.js", go), (5, "p", "e.go", go), (None, "p", "f.go", go)]
    got = sorted(((r.file_id or 0, r.lang, r.broken) for r in syntax_verdicts(spark.createDataFrame(rows, FILES), chunk_chars=500).collect()))
    assert got == [(0, "go", False), (1, "go", False), (1, "go", False), (2, "javascript", False), (2, "javascript", False), (3, "javascript", False), (4, "javascript", False), (4, "javascript", True), (5, "go", False), (5, "javascript", True)]


#: Chunks that begin in states beyond those of the maps: raw strings with many #, deep comments, template substitutions, and a slash whose meaning the line before decides.
EDGES = {
    "rust": ['fn f() { let s = r###"a\n"#\n{"## b\n"###; }\n', "/* a /* b /* c\n */ { */\n */ fn f() { let x = 1.\n; }\n"],
    "javascript": ["let s = `a ${f({\n  x: `b ${[\n1]}`,\n})} {`;\n", "let x = a\n/ b(/[/]\n/g, c\n/ d);\n".replace("/[/]\n/g", "/[/]/g,\n2"), "let y = f(1)\n/ 2 / (3);\n"],
    "typescript": ["const t: string = `a ${g<A>((\n) => `}`)}\n${1}`;\n"],
}


@pytest.mark.parametrize("lang, code", [(k, c) for k, cs in EDGES.items() for c in cs])
def test_maps_are_right_or_leave_it_open(lang, code):
    for text in (code, code + "}\n", code.replace("(", "", 1)):
        maps = [syntax.state_map(lang, x, k == 0) for k, x in enumerate(syntax.chunks(text, 1))]
        assert syntax.verdict(lang, syntax.reduce_maps(lang, maps)) in (syntax.parses(lang, text), None)
    assert syntax.parses(lang, code)
    deep = "###" in code or "/* c" in code or "${" in code
    assert deep is (syntax.verdict(lang, syntax.reduce_maps(lang, [syntax.state_map(lang, x, k == 0) for k, x in enumerate(syntax.chunks(code, 1))])) is None)


def test_long_files_are_reduced_from_maps(spark):
    """Several runs of chunks each; what maps leave open is null."""
    body = "function f() {\n  /* a\n b */ return `x\n$1`;\n}\n"
    rows = [("a", "javascript", body * 300), ("b", "javascript", body * 300 + "}\n"), ("c", "javascript", body * 9 + EDGES["javascript"][0] * 9), ("a", "javascript", body * 300), ("d", "go", "package a\n" + FUNCTION * 200)]
    got = chunk_verdicts(spark.createDataFrame(rows, "key string, lang string, code string"), 40).collect()
    assert sorted((r.key, r.broken) for r in got) == [("a", False), ("b", True), ("c", None), ("d", False)]


def test_long_files_in_any_lexer_state(spark):
    """Each as a short file, and again beyond the size from which files are cut."""
    rows = [(k, "p", f"a{k}.{ {'rust': 'rs', 'javascript': 'js', 'typescript': 'ts'}[lang] }", (code.replace("fn f", "fn f%d" % k)) * n) for k, (lang, code, n) in enumerate((lang, c, n) for lang, cs in EDGES.items() for c in cs for n in (1, 40))]
    got = {r.file_id: r.broken for r in syntax_verdicts(spark.createDataFrame(rows, FILES), chunk_chars=100).collect()}
    assert got == {k: False for k in range(len(rows))}


@pytest.mark.parametrize("lang", sorted(EDGES))
def test_documented_functions_of_long_files(spark, lang):
    """Long files keep their documented functions whatever state the edge of a chunk is in."""
    doc, ext = {"rust": ("/// Reads the next block of rows.\nfn g() {}\n", "rs"), "javascript": ("/** Reads the next block of rows. */\nfunction g() {}\n", "js"), "typescript": ("/** Reads the next block of rows. */\nfunction g(): void {}\n", "ts")}[lang]
    hashes = {"rust": 'const S: &str = r###"%s"###;\n', "javascript": "s = `a ${f({\n%s})}`;\n", "typescript": "s = `a ${f({\n%s})}`;\n"}[lang]
    filler = ('" {\n' if lang == "rust" else "x: '}',\n") * (1 << 18)
    df = spark.createDataFrame([(1, "p", "a." + ext, doc + hashes % filler)], FILES)
    assert [(r.line_no, r.fn_name) for r in documented_functions(df, False).collect()] == [(2, "g")]
    assert broken_files(df).count() == 0


@pytest.mark.parametrize("lang, code", [("typescript", "function f(a) { if (a); else; }\n"), ("javascript", "function f(a) {\n  if (a) { b() }\n  else;\n}\n"), ("rust", "fn f() { " + "if a { 1 } else if b { 2 } " * 1 + "else if c { 3 } " * 20 + "else { 4 }; }\n")])
def test_statements_in_many_pieces_beside_another_role(lang, code):
    """The content is also a list of members or macro text, which must not take its role as a block."""
    assert syntax.parses(lang, code)


def test_groups_of_hot_records(spark, monkeypatch):
    """A record in most pairs, at the end of long chains: its rows are joined apart from the others'."""
    from codeloom.llm.components import match_groups
    from codeloom.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    pairs = [(500, k) for k in range(501, 800)] + [(k, k + 1) for k in range(0, 40)] + [(40, 500), (900, 901)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "node_id_a bigint, node_id_b bigint, similarity double")
    got = {r.node_id: r.group_id for r in match_groups(spark, df).collect()}
    assert got == {n: 0 for n in [*range(41), *range(500, 800)]} | {900: 900, 901: 900}
