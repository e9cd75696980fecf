"""Symbols, imports and metrics of source files in sixteen languages.

Python has a parser of its own. For the others comments and literals are blanked, which keeps every offset, declarations are found by patterns, and bodies
are delimited by braces or end words. What a pattern can't know (inferred types, macros, dynamic calls) is not claimed.
"""

from __future__ import annotations

import ast
import bisect
import posixpath
import re
import time
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd

SCHEMA = (
    "path string, language string, ok boolean, ms double, node_type string, name string, line_start int, line_end int, signature string, doc string, visibility string, is_public boolean, "
    "is_async boolean, is_static boolean, return_type string, param_count int, attributes array<string>, complexity int, complexity_branches int, complexity_loops int, complexity_logical_ops int, "
    "complexity_nesting int, complexity_exceptions int, complexity_early_returns int, unresolved_calls array<string>, unresolved_type_refs array<string>, extends array<string>, implements array<string>, "
    "holder struct<node_type:string,name:string,line_start:int>, imports array<struct<module:string,names:array<string>,target:string>>"
)
COLUMNS = [c.split()[0] for c in re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "", SCHEMA).split(", ")]


class Shape(NamedTuple):
    """Counts that make up the complexity of a function."""

    branches: int = 0
    loops: int = 0
    logical: int = 0
    nesting: int = 0
    exceptions: int = 0
    returns: int = 0

    @property
    def complexity(self) -> int:
        return 1 + self.branches + self.loops + self.logical + self.exceptions


@dataclass
class Symbol:
    node_type: str
    name: str
    line_start: int
    line_end: int
    signature: str | None = None
    doc: str | None = None
    visibility: str | None = None
    is_public: bool | None = None
    is_async: bool | None = None
    is_static: bool | None = None
    return_type: str | None = None
    param_count: int | None = None
    attributes: list[str] = field(default_factory=list)
    shape: Shape | None = None
    calls: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    extends: list[str] = field(default_factory=list)
    implements: list[str] = field(default_factory=list)


class Import(NamedTuple):
    module: str
    names: list[str]
    target: str | None  # the path, without extension, that a relative import means


class Parsed(NamedTuple):
    symbols: list[Symbol]
    imports: list[Import]


# Python -----------------------------------------------------------------------------------------------------------------


def _dotted(node: ast.expr) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        left = _dotted(node.value)
        return f"{left}.{node.attr}" if left else None
    return None


def _inside(node: ast.AST) -> Iterator[ast.AST]:
    """All nodes below, but for those of functions and classes declared there."""
    for child in ast.iter_child_nodes(node):
        if not isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            yield child
            yield from _inside(child)


_PY_BLOCKS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)


def _depth(node: ast.AST) -> int:
    deepest = 0
    for child in ast.iter_child_nodes(node):
        if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            continue
        chained = isinstance(node, ast.If) and isinstance(child, ast.If) and child in node.orelse  # elif
        deepest = max(deepest, _depth(child) + (isinstance(child, _PY_BLOCKS) and not chained))
    return deepest


def _python_shape(node: ast.AST) -> Shape:
    found = list(_inside(node))

    def count(*kinds: type) -> int:
        return sum(isinstance(x, kinds) for x in found)

    logical = sum(len(x.values) - 1 for x in found if isinstance(x, ast.BoolOp))
    last = node.body[-1] if getattr(node, "body", None) else None
    return Shape(count(ast.If, ast.IfExp, ast.match_case), count(ast.For, ast.AsyncFor, ast.While, ast.comprehension), logical, _depth(node), count(ast.ExceptHandler), count(ast.Return) - isinstance(last, ast.Return))


def _type_names(*nodes: ast.expr | None) -> list[str]:
    names = {x.id for n in nodes if n is not None for x in ast.walk(n) if isinstance(x, ast.Name)} | {x.attr for n in nodes if n is not None for x in ast.walk(n) if isinstance(x, ast.Attribute)}
    return sorted(n for n in names if n[:1].isupper())


def parse_python(path: str, code: str) -> Parsed:
    """Raises SyntaxError for a file that does not parse."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(code)
    symbols, imports = [], []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [Import(a.name, [], None) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            base = node.module or ""
            target = None
            if node.level:
                folder = posixpath.normpath(posixpath.join(posixpath.dirname(path), *[".."] * (node.level - 1)))
                target = posixpath.normpath(posixpath.join(folder, base.replace(".", "/"))) if base else folder
            imports.append(Import("." * node.level + base, [a.name for a in node.names if a.name != "*"], target))
        elif isinstance(node, ast.ClassDef):
            attributes = ["@" + ast.unparse(d) for d in node.decorator_list]
            bases = [b for b in (_dotted(x.value if isinstance(x, ast.Subscript) else x) for x in node.bases) if b]
            public = not node.name.startswith("_")
            symbols.append(
                Symbol("Class", node.name, node.lineno, node.end_lineno or node.lineno, f"class {node.name}" + (f"({', '.join(map(ast.unparse, node.bases))})" if node.bases else ""), ast.get_docstring(node), "public" if public else "private", public, attributes=attributes, types=_type_names(*node.bases), extends=[b.rsplit(".", 1)[-1] for b in bases])
            )
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            symbols.append(_python_function(node))
    for node in tree.body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        for t in targets:
            if isinstance(t, ast.Name):
                public = not t.id.startswith("_")
                symbols.append(Symbol("Variable", t.id, node.lineno, node.end_lineno or node.lineno, visibility="public" if public else "private", is_public=public))
    return Parsed(sorted(symbols, key=lambda s: (s.line_start, s.name)), imports)


def _python_function(node: ast.FunctionDef | ast.AsyncFunctionDef) -> Symbol:
    a = node.args
    every = [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]
    own = [x for x in every if x.arg not in ("self", "cls")]
    attributes = ["@" + ast.unparse(d) for d in node.decorator_list]
    returns = ast.unparse(node.returns) if node.returns else None
    word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    calls = set()
    for x in _inside(node):
        if isinstance(x, ast.Call):
            full = _dotted(x.func)
            last = full.rsplit(".", 1)[-1] if full else x.func.attr if isinstance(x.func, ast.Attribute) else None
            calls |= {n for n in (full, last) if n}
    public = not node.name.startswith("_") or node.name.startswith("__") and node.name.endswith("__")
    return Symbol(
        "Function", node.name, node.lineno, node.end_lineno or node.lineno, f"{word} {node.name}({ast.unparse(a)})" + (f" -> {returns}" if returns else ""), ast.get_docstring(node), "public" if public else "private", public,
        isinstance(node, ast.AsyncFunctionDef), any(d in ("@staticmethod", "@classmethod") for d in attributes), returns, len(own), attributes, _python_shape(node), sorted(calls), _type_names(node.returns, *[x.annotation for x in every]),
    )


# The others ------------------------------------------------------------------------------------------------------------


_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_C_COMMENT = r"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"
_TRIPLE = r"\"\"\"[\s\S]*?\"\"\""
#: Comments (group c) and literals.
_SKIP = {
    "c": rf"{_C_COMMENT}|{_QUOTED}",
    "cpp": rf"{_C_COMMENT}|R\"(?P<t>\w*)\([\s\S]*?\)(?P=t)\"|{_QUOTED}",
    "csharp": rf"{_C_COMMENT}|\"\"\"[\s\S]*?\"\"\"|\$?@\$?\"(?:[^\"]|\"\")*\"|{_QUOTED}",
    "go": rf"{_C_COMMENT}|`[^`]*`|{_QUOTED}",
    "java": rf"{_C_COMMENT}|{_TRIPLE}|{_QUOTED}",
    "kotlin": rf"{_C_COMMENT}|{_TRIPLE}|{_QUOTED}",
    "swift": rf"{_C_COMMENT}|{_TRIPLE}|\"(?:[^\"\\\n]|\\.)*\"",
    "javascript": rf"{_C_COMMENT}|`(?:[^`\\]|\\[\s\S])*`|{_QUOTED}",
    "rust": rf"{_C_COMMENT}|\bb?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[^\n][^'\n]*)'",
    "php": r"(?P<c>//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*'",
    "ruby": rf"(?P<c>#(?!\{{)[^\n]*|(?m:^=begin[\s\S]*?^=end[^\n]*))|{_QUOTED}",
    "tcl": r"(?P<c>(?m:^)[ \t]*#[^\n]*|(?<=;)[ \t]*#[^\n]*)|\"(?:[^\"\\]|\\[\s\S])*\"",
    "fortran": r"(?P<c>![^\n]*|(?m:^\*)[^\n]*)|\"[^\"\n]*\"|'[^'\n]*'",
    "cobol": r"(?P<c>(?m:^.{6}\*)[^\n]*|\*>[^\n]*)|\"[^\"\n]*\"|'[^'\n]*'",
    "verilog": rf"{_C_COMMENT}|\"(?:[^\"\\\n]|\\.)*\"",
}
_SKIP["typescript"] = _SKIP["javascript"]
_SKIPPERS = {lang: re.compile(p) for lang, p in _SKIP.items()}

_ID = r"(?P<name>[A-Za-z_$][\w$]*)"
_JAVA_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|synchronized|native|default|strictfp|virtual|override|async|sealed|partial|unsafe|extern|readonly|new)\s+)*"
_KT_MODS = r"(?:(?:public|private|protected|internal|open|override|suspend|inline|operator|infix|tailrec|abstract|final|external|actual|expect|data|sealed|enum|annotation|inner|value|companion)\s+)*"
_SWIFT_MODS = r"(?:(?:@\w+(?:\([^)]*\))?|public|private|fileprivate|internal|open|static|class|override|mutating|final|required|convenience|nonisolated|indirect)\s+)*"
_JVM_TYPE = r"[\w$.]+(?:\s*<[^(){};=]*>)?(?:\s*\[\s*\])*\??"
_RUST_PUB = r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?"
#: Declarations: (node type, pattern on blanked text). A function's parameters follow its name.
_DECLARED = {
    "javascript": [
        ("Function", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*{_ID}"),
        ("Function", rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+{_ID}\s*(?::[^=\n]*)?=\s*(?:async\s*)?(?:function\b|(?:<[^>()]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=\n{{]*)?=>|[A-Za-z_$][\w$]*\s*=>)"),
        ("Method", r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)\s+|\*\s*)*(?P<name>#?[A-Za-z_$][\w$]*)\s*(?:<[^>\n]*>)?\s*(?=\()"),
        ("Class", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:class|enum|const\s+enum)\s+{_ID}"),
        ("Interface", rf"^[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+{_ID}"),
        ("Type", rf"^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+{_ID}\s*(?:<[^=\n]*>)?\s*="),
    ],
    "go": [
        ("Function", rf"^func\s+(?:\([^)]*\)\s*)?{_ID}\s*(?:\[[^\]]*\])?\s*(?=\()"), ("Class", rf"^type\s+{_ID}(?:\[[^\]]*\])?\s+struct\b"), ("Interface", rf"^type\s+{_ID}(?:\[[^\]]*\])?\s+interface\b"),
        ("Type", rf"^type\s+{_ID}\s+=?\s*(?!struct\b|interface\b)[\w*\[(]"), ("Variable", rf"^(?:var|const)\s+{_ID}\b"),
    ],
    "java": [("Method", rf"^[ \t]*{_JAVA_MODS}(?:<[^>(){{}};=]*>\s*)?(?:(?P<type>{_JVM_TYPE})\s+)?{_ID}\s*(?=\()"), ("Class", rf"^[ \t]*{_JAVA_MODS}(?:class|enum|record)\s+{_ID}"), ("Interface", rf"^[ \t]*{_JAVA_MODS}@?interface\s+{_ID}")],
    "csharp": [
        ("Method", rf"^[ \t]*{_JAVA_MODS}(?:(?P<type>{_JVM_TYPE})\s+)?{_ID}\s*(?:<[^>(){{}};=]*>)?\s*(?=\()"), ("Class", rf"^[ \t]*{_JAVA_MODS}(?:class|struct|enum|record(?:\s+(?:class|struct))?)\s+{_ID}"), ("Interface", rf"^[ \t]*{_JAVA_MODS}interface\s+{_ID}"),
    ],
    "rust": [
        ("Function", rf"{_RUST_PUB}(?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"\s*\"\s+)?)*fn\s+{_ID}"), ("Class", rf"{_RUST_PUB}(?:struct|enum|union)\s+{_ID}"), ("Interface", rf"{_RUST_PUB}(?:unsafe\s+)?trait\s+{_ID}"),
        ("Type", rf"{_RUST_PUB}type\s+{_ID}[^;=]*="), ("Variable", rf"^(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?{_ID}\s*:"),
    ],
    "c": [("Method", r"^(?P<type>[A-Za-z_][\w \t*]*?[ \t*])(?P<name>[A-Za-z_]\w*)\s*(?=\()"), ("Class", rf"^(?:typedef\s+)?(?:struct|union|enum)\s+{_ID}\s*(?=\{{)")],
    "cpp": [
        ("Method", r"^[ \t]*(?P<type>(?:[A-Za-z_][\w:]*(?:<[^(){};=]*>)?[\s*&]+)+)(?P<name>(?:[A-Za-z_]\w*::)*~?[A-Za-z_]\w*)\s*(?=\()"), ("Method", r"^[ \t]*(?P<name>(?:[A-Za-z_]\w*::)*~?[A-Z]\w*)\s*(?=\()"),
        ("Class", rf"^[ \t]*(?:template\s*<[^{{}}]*>\s*)?(?:typedef\s+)?(?:class|struct|union|enum(?:\s+class)?)\s+{_ID}[^;(){{]*(?=\{{)"), ("Module", rf"^[ \t]*(?:inline\s+)?namespace\s+{_ID}\s*(?=\{{)"),
    ],
    "kotlin": [("Function", rf"^[ \t]*{_KT_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?{_ID}\s*(?=\()"), ("Interface", rf"^[ \t]*{_KT_MODS}(?:fun\s+)?interface\s+{_ID}"), ("Class", rf"^[ \t]*{_KT_MODS}(?:class|object)\s+{_ID}")],
    "php": [("Function", rf"^[ \t]*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?\s*{_ID}\s*(?=\()"), ("Class", rf"^[ \t]*(?:(?:abstract|final|readonly)\s+)*(?:class|trait|enum)\s+{_ID}"), ("Interface", rf"^[ \t]*interface\s+{_ID}")],
    "ruby": [("Function", r"^[ \t]*(?:(?:private|public|protected|private_class_method)\s+)?def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)"), ("Class", r"^[ \t]*class\s+(?P<name>[A-Z]\w*(?:::\w+)*)"), ("Module", r"^[ \t]*module\s+(?P<name>[A-Z]\w*(?:::\w+)*)")],
    "swift": [
        ("Function", rf"^[ \t]*{_SWIFT_MODS}func\s+{_ID}\s*(?:<[^>]*>)?\s*(?=\()"), ("Function", rf"^[ \t]*{_SWIFT_MODS}(?P<name>init)[?!]?\s*(?=\()"), ("Class", rf"^[ \t]*{_SWIFT_MODS}(?:class(?!\s+(?:func|var|let)\b)|struct|enum|actor)\s+{_ID}"),
        ("Interface", rf"^[ \t]*{_SWIFT_MODS}protocol\s+{_ID}"),
    ],
    "fortran": [
        ("Function", r"^(?![ \t]*end\b)[ \t]*(?:[A-Za-z_]\w*(?:\s*\([^)\n]*\))?[ \t]+)*(?:subroutine|function)[ \t]+(?P<name>\w+)"), ("Module", r"^[ \t]*module[ \t]+(?!procedure\b)(?P<name>\w+)[ \t]*$"), ("Function", r"^[ \t]*program[ \t]+(?P<name>\w+)"),
        ("Class", r"^[ \t]*type(?:[ \t]*,[^:\n]*)?(?:[ \t]*::)?[ \t]+(?!is\b)(?P<name>\w+)[ \t]*$"),
    ],
    "tcl": [("Function", r"^[ \t]*proc\s+(?P<name>[\w:]+)\s+"), ("Module", r"^[ \t]*namespace\s+eval\s+(?P<name>[\w:]+)\s+(?=\{)"), ("Class", r"^[ \t]*(?:oo::class\s+create|itcl::class)\s+(?P<name>[\w:]+)\s+(?=\{)"), ("Function", r"^[ \t]*method\s+(?P<name>\w+)\s+")],
    "cobol": [("Class", r"^.{0,7}\s*program-id\.\s+(?P<name>[\w-]+)"), ("Function", r"^(?:.{6} |[ \t]{0,3})(?P<name>[A-Za-z0-9][\w-]*)(?:\s+section)?\s*\.[ \t]*$")],
    "verilog": [
        ("Class", rf"^[ \t]*(?:module|macromodule|program)\s+(?:automatic\s+|static\s+)?{_ID}"), ("Class", rf"^[ \t]*(?:virtual\s+)?class\s+{_ID}"), ("Interface", rf"^[ \t]*interface\s+(?!class\b){_ID}"), ("Module", rf"^[ \t]*package\s+{_ID}\s*;"),
        ("Function", rf"^[ \t]*(?:(?:virtual|static|protected|local|extern|pure)\s+)*(?:function|task)\s+(?:automatic\s+|static\s+)?(?:[\w\[\]:$]+\s+(?:\[[^\]]*\]\s*)?)?{_ID}\s*(?=[(;])"),
    ],
}
_DECLARED["typescript"] = _DECLARED["javascript"]
_FOLDED = {"fortran", "cobol"}  # languages without case
_PATTERNS = {lang: [(kind, re.compile(p, re.M | (re.I if lang in _FOLDED else 0))) for kind, p in rows] for lang, rows in _DECLARED.items()}

#: Imports: patterns with a module and, or not, names, on text without comments.
_IMPORTED = {
    "javascript": [r"\bimport\s+(?:type\s+)?(?P<names>[\w$*\s{},]+?)\s+from\s*['\"](?P<module>[^'\"\n]+)['\"]", r"\bimport\s*\(?\s*['\"](?P<module>[^'\"\n]+)['\"]", r"\bexport\s+(?:type\s+)?(?P<names>[\w$*\s{},]+?)\s+from\s*['\"](?P<module>[^'\"\n]+)['\"]", r"(?:(?:const|let|var)\s+(?P<names>[\w$\s{},:]+?)\s*=\s*)?\brequire\s*\(\s*['\"](?P<module>[^'\"\n]+)['\"]"],
    "go": [r"^import\s+(?:[\w.]+\s+)?\"(?P<module>[^\"\n]+)\"", r"(?<=[\n(])[ \t]*(?:[\w.]+[ \t]+)?\"(?P<module>[\w./-]+)\"[ \t]*(?=[\n)])"],
    "java": [r"^\s*import\s+(?:static\s+)?(?P<module>[\w.]+(?:\.\*)?)\s*;"],
    "csharp": [r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<module>[\w.]+)\s*;"],
    "kotlin": [r"^\s*import\s+(?P<module>[\w.]+(?:\.\*)?)"],
    "swift": [r"^\s*(?:@\w+\s+)?import\s+(?:(?:class|struct|enum|protocol|func|var|let|typealias)\s+)?(?P<module>[\w.]+)"],
    "rust": [r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<module>[\w:]+?)(?:::(?P<names>\{[^;]*\}|\*))?(?:\s+as\s+\w+)?\s*;", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<module>\w+)\s*;"],
    "c": [r"^[ \t]*#[ \t]*(?:include|import)[ \t]*[<\"](?P<module>[^>\"\n]+)[>\"]"],
    "php": [r"^\s*use\s+(?:function\s+|const\s+)?(?P<module>[\w\\]+)(?:\\(?P<names>\{[^;]*\}))?(?:\s+as\s+\w+)?\s*;", r"\b(?:require|include)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?['\"](?P<module>[^'\"\n]+)['\"]"],
    "ruby": [r"^\s*(?:require|require_relative|load)\s*\(?\s*['\"](?P<module>[^'\"\n]+)['\"]", r"^\s*(?:include|extend|prepend)\s+(?P<module>[A-Z][\w:]*)"],
    "tcl": [r"^\s*package\s+require\s+(?:-exact\s+)?(?P<module>[\w:]+)", r"^\s*source\s+(?P<module>[\w./-]+)"],
    "fortran": [r"^\s*use(?:\s*,\s*\w+\s*::)?\s+(?P<module>\w+)(?:\s*,\s*only\s*:\s*(?P<names>[^\n]*))?", r"^\s*include\s+['\"](?P<module>[^'\"\n]+)['\"]"],
    "cobol": [r"\bcopy\s+['\"]?(?P<module>[\w.-]+?)['\"]?\s*(?:\.|\breplacing\b)"],
    "verilog": [r"^[ \t]*`include\s+\"(?P<module>[^\"\n]+)\"", r"\bimport\s+(?P<module>\w+)::(?P<names>\w+|\*)\s*;"],
}
_IMPORTED["typescript"], _IMPORTED["cpp"] = _IMPORTED["javascript"], _IMPORTED["c"]
_IMPORTS = {lang: [re.compile(p, re.M | (re.I if lang in _FOLDED else 0)) for p in rows] for lang, rows in _IMPORTED.items()}

#: Words before a parenthesis that call nothing, or begin no declaration.
_NOT_CALLED = set("if for while switch catch return function sizeof match fn func def class new await typeof super elif elsif unless until foreach using lock fixed when case else do try throw assert synchronized and or not in is as where select from let var const end endif call perform".split())
_CALLED = re.compile(r"(?<![\w$])((?:[A-Za-z_$][\w$]*(?:\.|::|->|\?\.))*)([A-Za-z_$][\w$]*[?!]?)\s*\(")
_CALL_WORDS = {"fortran": re.compile(r"\bcall\s+()(\w+)", re.I), "cobol": re.compile(r"\bperform\s+()([\w-]+)", re.I), "tcl": re.compile(r"(?m)(?:^|[\[;{])[ \t]*()((?:::)?[A-Za-z_][\w:]*)(?=[ \t\]\n])"), "ruby": re.compile(r"(?<![\w$@:])((?:[A-Za-z_]\w*\.)+)([a-z_]\w*[?!]?)(?![\w(])")}
_WORDS = {
    "branches": re.compile(r"\b(?:if|elif|elsif|elseif|unless|case|when|guard|evaluate)\b|\?(?=\s*[^.?:\s>\])])", re.I),
    "loops": re.compile(r"\b(?:for|foreach|while|until|loop|repeat|do\s+\w+\s*=|forever)\b", re.I),
    "logical": re.compile(r"&&|\|\||\b(?:and|or)\b|\.(?:and|or)\.", re.I),
    "exceptions": re.compile(r"\b(?:catch|rescue|except)\b", re.I),
    "returns": re.compile(r"\breturn\b", re.I),
}
_UPPER = re.compile(r"\b[A-Z]\w*\b")
_NEW = re.compile(r"\bnew\s+([A-Za-z_$][\w$]*)")
_NOT_TYPES = {"Self", "String", "Option", "Result", "Vec", "Box", "None", "Some", "Ok", "Err", "Promise", "Array", "Map", "Set", "Record", "Partial", "List", "Object", "Integer", "Boolean", "Void", "T", "K", "V", "E", "R"}
_HEIR = {
    "javascript": r"\bextends\s+(?P<extends>[\w$.]+)|\bimplements\s+(?P<implements>[\w$.<>, ]+)",
    "java": r"\bextends\s+(?P<extends>[\w$.<>, ]+?)(?=\s+implements\b|\s*$)|\bimplements\s+(?P<implements>[\w$.<>, ]+)",
    "php": r"\bextends\s+(?P<extends>[\w\\, ]+?)(?=\s+implements\b|\s*$)|\bimplements\s+(?P<implements>[\w\\, ]+)",
    "cpp": r"(?<!:):(?!:)\s*(?P<extends>[^{]+)",
    "csharp": r"(?<!:):(?!:)\s*(?P<extends>[^{]+?)(?=\bwhere\b|\s*$)",
    "kotlin": r"(?<!:):(?!:)\s*(?P<extends>[^{]+)",
    "swift": r"(?<!:):(?!:)\s*(?P<extends>[^{]+?)(?=\bwhere\b|\s*$)",
    "ruby": r"<\s*(?P<extends>[\w:]+)",
    "verilog": r"\bextends\s+(?P<extends>\w+)",
    "fortran": r"extends\s*\(\s*(?P<extends>\w+)",
}
_HEIR["typescript"] = _HEIR["javascript"]
_HEIRS = {lang: re.compile(p, re.I if lang == "fortran" else 0) for lang, p in _HEIR.items()}
_RUST_IMPL = re.compile(r"(?m)^[ \t]*(?:unsafe\s+)?impl(?:\s*<[^{;]*?>)?\s+(?:[\w]+::)*(\w+)(?:<[^{;]*?>)?\s+for\s+(?:[\w]+::)*(\w+)")
_ATTRIBUTE = {"java": r"@", "kotlin": r"@", "javascript": r"@", "typescript": r"@", "swift": r"@", "rust": r"#\[", "php": r"#\[", "csharp": r"\["}
_ENDED = {
    "ruby": (re.compile(r"(?m)^[ \t]*(?:(?:private|public|protected)\s+)?(?:class|module|def(?![^\n]*?\)[ \t]*=[^=~]|[ \t]+[\w.]+[ \t]*=[ \t])|if|unless|while|until|for|begin|case)\b|\bdo\b|(?:=|\(|\breturn)[ \t]*(?:if|unless|case|begin)\b"), re.compile(r"(?<![.\w])end\b")),
    "fortran": (re.compile(r"(?im)^(?![ \t]*end\b)[ \t]*(?:(?:[A-Za-z_]\w*(?:\s*\([^)\n]*\))?[ \t]+)*(?:subroutine|function)[ \t]+\w+|module[ \t]+(?!procedure)\w+[ \t]*$|program[ \t]+\w+|type(?:[ \t]*,[^\n:]*)?(?:[ \t]*::)?[ \t]+\w+[ \t]*$|interface\b|do\b|select[ \t]+\w+|if[ \t]*\(.*\)[ \t]*then\b|where[ \t]*\(.*\)[ \t]*$|associate\b|block\b)"), re.compile(r"(?im)^[ \t]*end[ \t]*(?:subroutine|function|module|program|type|interface|do|select|if|where|associate|block)?\b")),
}
_VERILOG_END = {"module": "endmodule", "macromodule": "endmodule", "program": "endprogram", "class": "endclass", "interface": "endinterface", "package": "endpackage", "function": "endfunction", "task": "endtask"}


class _Text:
    """A file's text, without comments, and without comments and literals; all with the same offsets."""

    def __init__(self, lang: str, code: str):
        self.lang, self.code = lang, code
        self.comments: list[tuple[int, int]] = []
        bare, plain, last = [], [], 0
        for m in _SKIPPERS[lang].finditer(code):
            gap = code[last : m.start()]
            body = m[0]
            blank = re.sub(r"[^\n]", " ", body)
            bare.append(gap)
            plain.append(gap)
            if m["c"] is not None:
                self.comments.append(m.span())
                bare.append(blank)
                plain.append(blank)
            else:
                bare.append(body[0] + blank[1:-1] + body[-1] if len(body) > 1 and body[0] != "\n" else blank)
                plain.append(body)
            last = m.end()
        self.bare = "".join(bare) + code[last:]
        self.plain = "".join(plain) + code[last:]
        self.starts = [0, *[m.end() for m in re.finditer("\n", code)]]
        self.ends = [z for _, z in self.comments]

    def line(self, pos: int) -> int:
        return bisect.bisect_right(self.starts, pos)

    def closing(self, k: int) -> int:
        """The partner of the bracket at ``k`` among those of its kind, or the end."""
        opening = self.bare[k]
        closing = {"(": ")", "[": "]", "{": "}"}[opening]
        depth, pos = 0, k
        while (at := self.bare.find(closing, pos)) >= 0:
            depth += self.bare.count(opening, pos, at) - 1
            if not depth:
                return at
            pos = at + 1
        return len(self.bare) - 1

    def next(self, pos: int, wanted: str) -> int:
        """The next character of ``wanted`` outside parentheses and brackets, or the end."""
        pattern = re.compile(r"[(\[" + re.escape(wanted) + "]")
        while m := pattern.search(self.bare, pos):
            if m[0] not in "([":
                return m.start()
            pos = self.closing(m.start()) + 1
        return len(self.bare)

    def before(self, pos: int) -> tuple[str | None, list[str]]:
        """The documentation and the attributes that stand directly before a declaration's line."""
        top = self.line(pos) - 1
        attributes: list[str] = []
        mark = _ATTRIBUTE.get(self.lang)
        while mark and top and re.match(r"[ \t]*" + mark, above := self.plain[self.starts[top - 1] : self.starts[top]]):
            attributes.insert(0, above.strip())
            top -= 1
        at = self.starts[top] if top < len(self.starts) else len(self.code)
        k = bisect.bisect_right(self.ends, at) - 1
        parts: list[str] = []
        while k >= 0:
            a, z = self.comments[k]
            gap = self.code[z:at]
            if gap.strip() or gap.count("\n") > 1 or self.code[self.starts[self.line(a) - 1] : a].strip():
                break
            parts.insert(0, self.code[a:z])
            at, k = a, k - 1
            if parts[0].startswith(("/*", "=begin")):
                break
        text = "\n".join(re.sub(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!/)|//[/!]?|#+|!+>?|=begin|=end|\*>)?[ \t]?", "", line) for part in parts for line in re.sub(r"\s*\*+/\s*$", "", part).split("\n")).strip()
        return text or None, attributes


def _parameters(text: str) -> list[str]:
    """Top-level parts of a parameter list."""
    parts, depth, last = [], 0, 0
    for k, c in enumerate(text):
        if c in "([{" or c == "<":
            depth += 1
        elif c in ")]}" or c == ">" and k and text[k - 1] not in "-=":
            depth -= 1
        elif c == "," and depth <= 0:
            parts.append(text[last:k])
            last = k + 1
    parts.append(text[last:])
    return [p.strip() for p in parts if p.strip() and p.strip() != "void"]


_SELF = re.compile(r"(?:&\s*(?:'\w+\s+)?)?(?:mut\s+)?(?:self|this)\b(?:\s*:.*)?$", re.S)


def _returns(lang: str, head: str, tail: str, typed: str | None) -> str | None:
    if typed is not None:
        words = [w for w in typed.split() if w not in ("static", "inline", "extern", "const", "constexpr", "virtual", "explicit", "friend", "register", "public", "private")]
        return " ".join(words) or None
    if lang in ("typescript", "javascript", "kotlin", "php"):
        found = re.match(r"\s*:\s*(.+?)\s*(?:=>)?\s*$", tail, re.S)
    elif lang in ("rust", "swift"):
        found = re.search(r"->\s*(.+?)\s*(?:\bwhere\b.*)?$", tail, re.S)
    elif lang == "go":
        found = re.match(r"\s*(\S.*?)\s*$", tail, re.S)
    else:
        found = None
    return " ".join(found[1].split()) if found else None


def _visibility(lang: str, head: str, name: str, member: bool) -> str:
    words = set(re.findall(r"[\w#]+", head))
    for w in ("private", "fileprivate", "protected", "internal", "public", "open", "local"):
        if w in words:
            return {"fileprivate": "private", "open": "public", "local": "private"}.get(w, w)
    if lang in ("javascript", "typescript"):
        return "private" if name.startswith("#") else "public" if member or "export" in words else "private"
    if lang == "go":
        return "public" if name[:1].isupper() else "private"
    if lang == "rust":
        return "public" if re.search(r"\bpub\b(?!\s*\()", head) else "internal" if "pub" in words else "private"
    if lang in ("java", "swift"):
        return "internal"
    if lang == "csharp":
        return "private" if member else "internal"
    if lang in ("c", "cpp") and "static" in words:
        return "private"
    return "public"


def _shape(t: _Text, start: int, end: int) -> Shape:
    body = t.bare[start:end]
    count = {k: len(p.findall(body)) for k, p in _WORDS.items()}
    if t.lang in _ENDED:
        ends = len(_ENDED[t.lang][1].findall(body))
        count["branches"] -= sum(1 for m in re.finditer(r"\bend[ \t]*(?:if|select)\b", body, re.I))
        count["loops"] -= sum(1 for m in re.finditer(r"\bend[ \t]*do\b", body, re.I))
        depth = deepest = 0
        opener, closer = _ENDED[t.lang]
        for at, step in sorted([(m.start(), 1) for m in opener.finditer(body)] + [(m.start(), -1) for m in closer.finditer(body)]):
            depth += step
            deepest = max(deepest, depth)
        nesting = max(0, deepest - 1) if ends else 0
    else:
        depth = deepest = 0
        for m in re.finditer(r"[{}]", body):
            depth += 1 if m[0] == "{" else -1
            deepest = max(deepest, depth)
        nesting = max(0, deepest - 1)
    early = count["returns"] - bool(re.search(r"\breturn\b[^{}]*[\s;]*\}?\s*$", body))
    return Shape(max(0, count["branches"]), max(0, count["loops"]), count["logical"], nesting, count["exceptions"], max(0, early))


def _calls(t: _Text, start: int, end: int, own: str) -> list[str]:
    body = t.bare[start:end]
    out = set()
    for m in (*_CALLED.finditer(body), *(_CALL_WORDS[t.lang].finditer(body) if t.lang in _CALL_WORDS else ())):
        name = m[2]
        if name.lower() in _NOT_CALLED or name == own and not m[1]:
            continue
        out.add(name)
        if m[1]:
            out.add(re.sub(r"::|->|\?\.", ".", m[1]) + name)
    return sorted(out)


def _end_of(t: _Text, kind: str, head: str, pos: int) -> tuple[int, int]:
    """(where the body starts, where the declaration ends) of one whose name and parameters end at ``pos``."""
    size = len(t.bare)
    if t.lang in _ENDED:
        opener, closer = _ENDED[t.lang]
        if t.lang == "ruby" and re.match(r"[ \t]*(?:\([^)\n]*\))?[ \t]*=(?!=)", t.bare[pos : t.next(pos, "\n")]):
            return pos, t.next(pos, "\n")
        events = sorted([(m.start(), m.end(), 1) for m in opener.finditer(t.bare, pos)] + [(m.start(), m.end(), -1) for m in closer.finditer(t.bare, pos)])
        depth = 1
        for at, stop, step in events:
            if step > 0 and t.bare[at:stop] == "do" and re.match(r"[ \t]*(?:while|until|for)\b", t.bare[t.starts[t.line(at) - 1] : at]):
                continue
            depth += step
            if not depth:
                return pos, stop
        return pos, size
    if t.lang == "verilog":
        word = next((w for w in re.findall(r"\w+", head) if w in _VERILOG_END), "module")
        m = re.compile(rf"\b{_VERILOG_END[word]}\b").search(t.bare, pos)
        return pos, m.end() if m else size
    if t.lang == "cobol":
        m = _PATTERNS["cobol"][1 if kind == "Function" else 0][1].search(t.bare, pos)
        return pos, m.start() if m else size
    if t.lang == "tcl":
        if kind == "Function" and t.bare[pos : pos + 1] == "{":
            pos = t.closing(pos) + 1
        k = t.bare.find("{", pos)
        return (k, t.closing(k) + 1) if k >= 0 else (pos, size)
    if kind == "Function" and t.lang in ("javascript", "typescript") and (m := re.compile(r"\s*(?::[^=\n]*)?=>\s*").match(t.bare, pos)):
        if t.bare[m.end() : m.end() + 1] != "{":
            return m.end(), min(t.next(m.end(), ";\n"), size)
        return m.end(), t.closing(m.end()) + 1
    k = t.next(pos, "{;=\n" if t.lang == "go" else "{;=" if t.lang in ("kotlin", "csharp") else "{;")
    if t.lang == "go" and t.bare[k : k + 1] == "{" and re.search(r"(?:interface|struct)\s*$", t.bare[pos:k]) and kind == "Function":
        k = t.next(t.closing(k) + 1, "{;\n")
    if t.bare[k : k + 1] == "{":
        return k, t.closing(k) + 1
    if t.bare[k : k + 1] == "=" and t.lang == "kotlin":
        return k, t.next(k, "\n")
    if t.bare[k : k + 1] == "=" and t.lang == "csharp":
        return k, t.next(k, ";") + 1
    return k, min(k + 1, size)


def _import_of(lang: str, path: str, m: re.Match) -> Import:
    module = m["module"]
    groups = m.groupdict()
    names = [w for part in re.sub(r"[{}()]", ",", groups.get("names") or "").split(",") if (w := re.sub(r"^\s*(?:type\s+)?|\s+as\s.*$|\s*:.*$|=>.*$", "", part.strip()).split("::")[-1].strip()) and w not in ("*", "self", "default") and not w.startswith("*")]
    target = None
    folder = posixpath.dirname(path)
    if lang in ("javascript", "typescript") and module.startswith("."):
        target = re.sub(r"\.(?:m|c)?[jt]sx?$", "", posixpath.normpath(posixpath.join(folder, module)))
    elif lang in ("c", "cpp", "php", "tcl", "verilog", "fortran") and "." in module and "\\" not in module:
        target = posixpath.splitext(posixpath.normpath(posixpath.join(folder, module)))[0]
    elif lang == "ruby" and "require_relative" in m[0]:
        target = posixpath.splitext(posixpath.normpath(posixpath.join(folder, module)))[0]
    elif lang == "rust":
        parts = module.split("::")
        if not names and len(parts) > 1:
            names, parts = [parts[-1]], parts[:-1]
        module = "::".join(parts)
        if m[0].lstrip().split()[-1].rstrip(";") == module and "mod " in m[0]:
            target = posixpath.join(folder, module)
    elif lang in ("java", "kotlin") and module[module.rfind(".") + 1 :][:1].isupper():
        names = [module.rsplit(".", 1)[-1]]
    elif lang == "php" and "\\" in module and not names:
        names = [module.rsplit("\\", 1)[-1]]
    return Import(module.removesuffix("*").rstrip("."), names, target)


def _names_in(text: str) -> list[str]:
    """The types of a list of ancestors, without their arguments."""
    flat = re.sub(r"<[^<>]*>|\([^()]*\)", "", re.sub(r"<[^<>]*>", "", text))
    words = [re.findall(r"\w+", part) for part in re.split(r"[,&]", flat)]
    return [w[-1] for w in words if w]


def parse_other(lang: str, path: str, code: str) -> Parsed:
    t = _Text(lang, code)
    found: dict[int, tuple[Symbol, int, int]] = {}
    for kind, pattern in _PATTERNS[lang]:
        for m in pattern.finditer(t.bare):
            symbol = _symbol(t, kind, m)
            if symbol is not None and m.start("name") not in found:
                found[m.start("name")] = symbol
    rows = [found[k] for k in sorted(found)]
    holders = [(a, z) for s, a, z in rows if s.node_type in ("Class", "Interface")]
    symbols = []
    for s, a, z in rows:
        member = any(x < a and z <= y for x, y in holders)
        if s.node_type == "Function" and lang in ("javascript", "typescript") and s.visibility == "method" and not member:
            continue  # what looks like a method outside of a class is a call
        head = t.bare[t.starts[t.line(a) - 1] : a]
        s.visibility = _visibility(lang, head + " " + (s.signature or "").split("(", 1)[0] if lang == "cpp" else head, s.name, member)
        if lang == "cpp" and member:
            x = max(x for x, y in holders if x < a and z <= y)
            labels = re.findall(r"\b(public|private|protected)\s*:(?!:)", t.bare[x:a])
            s.visibility = labels[-1] if labels else "public" if re.search(r"\bstruct\b", t.bare[t.starts[t.line(x) - 1] : x]) else "private"
        if lang == "ruby" and s.node_type == "Function":
            labels = [w for w in re.findall(r"(?m)^[ \t]*(public|private|protected)[ \t]*$", t.bare[max([x for x, y in holders if x < a and z <= y], default=0) : a])]
            s.visibility = labels[-1] if labels else s.visibility
        s.is_public = s.visibility in ("public", "pub")
        symbols.append(s)
    if lang == "rust":
        for m in _RUST_IMPL.finditer(t.bare):
            for s in symbols:
                if s.name == m[2] and s.node_type == "Class" and m[1] not in s.implements:
                    s.implements.append(m[1])
    imports, seen = [], set()
    for pattern in _IMPORTS[lang]:
        for m in pattern.finditer(t.plain):
            if m.start("module") not in seen:
                seen.add(m.start("module"))
                imports.append(_import_of(lang, path, m))
    return Parsed(symbols, imports)


def _symbol(t: _Text, kind: str, m: re.Match) -> tuple[Symbol, int, int] | None:
    """The symbol of a declaration's match, its name's offset and its end; None if it is none after all."""
    lang, name, pos = t.lang, m["name"], m.end()
    method, groups = kind == "Method", m.groupdict()
    words = re.findall(r"\w+", m[0][: m.start("name") - m.start()])
    if name.lower() in _NOT_CALLED or method and (set(words) & {"return", "new", "throw", "else", "case", "goto", "typedef", "await", "yield", "delete", "in", "of"} or lang in ("c", "cpp") and "=" in m[0]):
        return None
    typed = groups.get("type")
    if typed is not None and lang == "cpp":
        typed = re.sub(r"\b(?:public|private|protected)\s*:(?!:)", "", typed).strip() or None
    if typed is not None and typed.strip() in _NOT_CALLED:
        return None
    kind = "Function" if method else kind
    params = None
    after = pos
    if kind == "Function" and lang not in ("cobol", "tcl"):
        k = re.compile(r"\s*(?:<[^(){};]*>)?\s*").match(t.bare, m.end("name")).end()
        if lang in ("javascript", "typescript") and t.bare[k : k + 1] != "(":
            arrow = t.bare.rfind("=>", m.start(), pos)
            k = t.bare.find("(", m.end("name"), arrow if arrow >= 0 else t.next(m.end("name"), "{;\n")) if "=" in t.bare[m.end("name") : pos] else -1
            if k < 0:
                params = _parameters(re.sub(r"^.*=|=>|\basync\b", "", t.bare[m.end("name") : pos])) if arrow >= 0 else []
                k = -1
                after = arrow if arrow >= 0 else pos
        if t.bare[k : k + 1] == "(" and k >= 0:
            close = t.closing(k)
            params = _parameters(t.bare[k + 1 : close])
            after = close + 1
    elif lang == "tcl" and kind == "Function":
        k = re.compile(r"\s*").match(t.bare, m.end("name")).end()
        params = t.bare[k + 1 : t.closing(k)].split() if t.bare[k : k + 1] == "{" else t.bare[k : t.next(k, " \n")].split()
        after = pos = k
    if method:
        tail = re.compile(r"(?:\s*(?:const|noexcept|override|final|throws[\w\s.,]*|where[^{;]*|->[^{;]*|:[^{;]*|volatile|&{1,2}))*\s*").match(t.bare, after)
        stop = tail.end()
        body = t.bare[stop : stop + 1] == "{" or lang == "csharp" and t.bare.startswith("=>", stop)
        abstract = lang in ("java", "csharp") and typed is not None and t.bare[stop : stop + 1] == ";" or lang == "typescript" and "abstract" in words
        if not body and not abstract or typed is None and lang in ("java", "csharp") and not body:
            return None
        if lang in ("java", "csharp") and typed is None and not re.search(rf"\b(?:class|enum|record|struct)\s+{re.escape(name)}\b", t.bare):
            return None
        if lang in ("c", "cpp") and typed is None and not re.search(rf"\b(?:class|struct)\s+{re.escape(name.lstrip('~').rsplit(':', 1)[-1].lstrip('~'))}\b|{re.escape(name.rsplit('::', 1)[0])}::", t.bare):
            return None
    head = t.bare[t.starts[t.line(m.start("name")) - 1] : m.start("name")]
    body, end = _end_of(t, kind, m[0], after)
    doc, attributes = t.before(m.start("name") if not m[0].lstrip().startswith("template") else m.start())
    stop = body if t.bare[body : body + 1] in ("{", ";", "=") or lang in ("javascript", "typescript", "go") else t.next(after, "\n")
    begin = t.starts[t.line(m.start("name")) - 1]
    signature = re.sub(r"\s*(?:=>|[{;=])$", "", " ".join(t.code[begin : max(stop, after if kind == "Function" else stop)].split())) or None
    s = Symbol(kind, name.rsplit("::", 1)[-1] if lang == "cpp" else name, t.line(m.start("name")), t.line(max(m.start("name"), min(end, len(t.bare)) - 1)), signature, doc, "method" if method else None, attributes=attributes)
    if kind == "Function":
        tail = t.bare[after:stop]
        s.is_async = bool(re.search(r"\b(?:async|suspend)\b", head) or lang == "swift" and re.search(r"\basync\b", tail) or re.search(r"=\s*async\b", t.bare[m.end("name") : after]))
        s.is_static = bool(re.search(r"\bstatic\b", head)) and lang not in ("c",) or lang == "ruby" and "self." in m[0] or lang == "swift" and bool(re.search(r"\bclass\b", head))
        s.return_type = _returns(lang, head, tail, typed)
        if params is not None:
            s.param_count = len(params) - bool(params and _SELF.match(params[0]))
        elif lang in ("ruby", "fortran", "verilog", "cobol"):
            s.param_count = 0
        s.shape = _shape(t, body, end)
        s.calls = _calls(t, body, end, name)
        text = t.bare[m.end("name") : stop] + " " + (typed or "")
        s.types = sorted({w for w in _UPPER.findall(text) if w not in _NOT_TYPES} | {w for w in _NEW.findall(t.bare[body:end]) if w not in _NOT_TYPES})
    elif kind in ("Class", "Interface") and lang in _HEIRS:
        tail = t.bare[m.end("name") : body if t.bare[body : body + 1] == "{" else t.next(pos, "\n")]
        if lang == "fortran":
            tail = m[0]
        for h in _HEIRS[lang].finditer(re.sub(r"^\s*(?:<[^{]*?>(?=\s|$|\())?(?:\s*\([^()]*\))?", "", tail)):
            for what in ("extends", "implements"):
                text = h.groupdict().get(what)
                if text:
                    getattr(s, what).extend(_names_in(re.sub(r"\b(?:public|private|protected|virtual)\b", "", text)))
        if lang in ("kotlin", "csharp", "swift") and s.extends:  # by convention the first may be a class, others are interfaces
            s.extends, s.implements = s.extends[:1], s.extends[1:]
    return s, m.start("name"), end


def parse(path: str, language: str, code: str) -> Parsed:
    """Raises SyntaxError, for Python only, if the file does not parse."""
    code = code[1:] if code[:1] == "﻿" else code
    return parse_python(path, code) if language == "python" else parse_other(language, path, code) if language in _PATTERNS else Parsed([], [])


def _row(path: str, language: str, ok: bool, ms: float, s: Symbol, holder: Symbol | None, imports: list[Import]) -> tuple:
    shape = s.shape
    parts = (shape.complexity, *shape) if shape else (None,) * 7
    inside = {"node_type": holder.node_type, "name": holder.name, "line_start": holder.line_start} if holder else None
    return (
        path, language, ok, ms, s.node_type, s.name, s.line_start, s.line_end, s.signature, s.doc, s.visibility, s.is_public, s.is_async, s.is_static, s.return_type, s.param_count, s.attributes or None, *parts,
        s.calls, s.types, s.extends, s.implements, inside, [{"module": i.module, "names": i.names, "target": i.target} for i in imports],
    )


def rows_of(path: str, language: str, code: str) -> list[tuple]:
    """The rows of a file: its CodeFile with the imports, then its symbols with the innermost class that holds them."""
    began = time.perf_counter()
    try:
        found, ok = parse(path, language, code), True
    except (SyntaxError, ValueError, RecursionError):
        found, ok = Parsed([], []), False
    ms = (time.perf_counter() - began) * 1000
    lines = code.count("\n") + 1
    rows = [_row(path, language, ok, ms, Symbol("CodeFile", path.rsplit("/", 1)[-1], 1, lines, is_public=True), None, found.imports)]
    open_: list[Symbol] = []
    for s in found.symbols:
        while open_ and open_[-1].line_end < s.line_start:
            open_.pop()
        rows.append(_row(path, language, ok, 0.0, s, open_[-1] if open_ and s.line_end <= open_[-1].line_end else None, []))
        if s.node_type in ("Class", "Interface"):
            open_.append(s)
    return rows


def parse_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [r for path, language, code in zip(f["path"], f["language"], f["code"]) for r in rows_of(path, language, code or "")]
        out = pd.DataFrame(rows, columns=COLUMNS)
        for c in COLUMNS:
            if c.startswith("complexity") or c == "param_count":
                out[c] = out[c].astype("Int32")
        yield out
