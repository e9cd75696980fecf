"""Predicates and labels over nodes, commits, routes and paths as Columns; all of them stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names called by frameworks, not by code.
FRAMEWORK_NAMES = (
    "main setup Args it describe beforeEach afterEach beforeAll afterAll activate deactivate getTreeItem getChildren getParent resolveTreeItem resolveWebviewView "
    "provideFollowups provideCodeContext buildEnhancedPrompt provideCodeActions provideCodeLenses resolveCodeLens provideCompletionItems resolveCompletionItem invoke "
    "prepareInvocation dispose refresh getIcon initialized shutdown did_open did_change did_save did_close goto_definition references hover document_symbol "
    "prepare_call_hierarchy incoming_calls outgoing_calls execute_command completion code_action code_lens formatting rename did_change_configuration"
).split()
# Methods that implement well-known traits or are called by a runtime.
TRAIT_NAMES = (
    "default fmt from into clone clone_from eq ne partial_cmp cmp hash drop deref deref_mut as_ref as_mut try_from try_into from_str to_string next size_hint "
    "serialize deserialize visit_str visit_map visit_seq expecting into_iter from_iter source description embed embed_batch dimension encode "
    "insert remove get contains len is_empty iter clear distance build parse new toString valueOf toJSON Symbol.iterator [Symbol.iterator]"
).split()
# Names too common to be clones of each other, in lower case.
BOILERPLATE_NAMES = (
    "default new from fmt clone drop deref eq hash into try_from try_into serialize deserialize tostring hashcode equals compareto getclass finalize dispose close gettype "
    "gethashcode __init__ __str__ __repr__ __eq__ __hash__ __len__ __iter__ __next__ __enter__ __exit__ __del__ constructor valueof tolocalestring tojson main init destroy "
    "free malloc realloc string error len __construct __destruct __tostring __clone __get __set initialize to_s to_str inspect eql? deinit description get set getvalue setvalue"
).split()
# Path parts that name a layer, in the order they are tried.
LAYERS = [
    ("controller", "controllers controller routes router endpoints api/"),
    ("presentation", "views view templates pages components ui/"),
    ("handler", "handlers handler"),
    ("service", "services service usecases use_cases application/"),
    ("command", "commands command"),
    ("query", "queries query"),
    ("domain", "models model entities entity domain/"),
    ("aggregate", "aggregates aggregate"),
    ("value_object", "value_objects valueobjects"),
    ("repository", "repositories repository repos"),
    ("persistence", "database db/ persistence"),
    ("infrastructure", "adapters adapter infrastructure/"),
    ("client", "clients client"),
    ("provider", "providers provider"),
    ("middleware", "middleware middlewares"),
    ("utility", "utils util helpers helper lib/"),
    ("configuration", "config configuration settings"),
    ("contract", "types interfaces contracts"),
    ("test", "tests test __tests__ spec specs"),
    ("test_support", "fixtures mocks stubs"),
]
# Decorators of routes in the order they are tried; the second says whether the name holds the method.
ROUTE_DECORATORS = [
    ("app.route", False), ("app.get", True), ("app.post", True), ("app.put", True), ("app.patch", True), ("app.delete", True),
    ("router.get", True), ("router.post", True), ("router.put", True), ("router.patch", True), ("router.delete", True),
    ("GetMapping", True), ("PostMapping", True), ("PutMapping", True), ("PatchMapping", True), ("DeleteMapping", True), ("RequestMapping", False),
    ("Get", True), ("Post", True), ("Put", True), ("Patch", True), ("Delete", True),
]
# Functions that call over HTTP.
HTTP_CLIENTS = (
    "fetch requests.get requests.post requests.put requests.patch requests.delete httpx.get httpx.post httpx.put httpx.patch httpx.delete http.Get http.Post http.NewRequest "
    "reqwest::get axios.get axios.post axios.put axios.patch axios.delete http.get http.post http.put http.patch http.delete"
).split()
# File extensions of the languages, tried in this order.
LANGUAGES = {
    "c": "c h", "cobol": "cob cbl cpy", "cpp": "cpp cc cxx hpp hh hxx", "csharp": "cs", "fortran": "f f90 f95 f03 f08 for", "go": "go", "java": "java", "kotlin": "kt kts", "php": "php",
    "python": "py pyi pyw", "ruby": "rb", "rust": "rs", "swift": "swift", "tcl": "tcl", "typescript": "ts tsx", "javascript": "js jsx mjs cjs", "verilog": "v sv vh svh",
}
# Other names of languages.
LANGUAGE_ALIASES = {"c++": "cpp", "c#": "csharp", "javascriptreact": "javascript", "typescriptreact": "typescript", "js": "javascript", "ts": "typescript", "py": "python", "rs": "rust", "golang": "go", "clang": "c"}
# Directories that are never scanned.
SKIPPED_DIRECTORIES = "node_modules target dist build out .git __pycache__ vendor DerivedData tmp coverage htmlcov results logs".split()


def _any(column: Column, parts: list[str]) -> Column:
    """Whether ``column`` contains one of ``parts``."""
    return column.rlike("|".join(re.escape(p) for p in parts))


def is_test_node(name: Column, path: Column, flag: Column) -> Column:
    named = name.startswith("test_") | name.endswith("_test") | name.contains("test ") | name.startswith("Test")
    placed = _any(path, ["/test", "\\test", ".test.", ".spec.", "_test."])
    return F.coalesce(flag, F.lit(False)) | F.coalesce(named, F.lit(False)) | F.coalesce(placed, F.lit(False))


def is_build_output(path: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(path, r"[/\\]"), F.array(*[F.lit(d) for d in ("out", "dist", "target", "node_modules", "build")])), F.lit(False))


def unused_confidence(name: Column, exported: Column) -> Column:
    """How sure it is that a symbol without callers is unused."""
    return (
        F.when(name.rlike("[hH]andler|[cC]allback|[lL]istener|[mM]iddleware"), 0.2)
        .when(name.endswith("_tool") | name.startswith("default_"), 0.1)
        .when(name.startswith("migrate_") | name.startswith("migration_"), 0.2)
        .when(name.startswith("on_") | name.rlike(r"^on\p{Lu}"), 0.2)
        .when(name.rlike(r"^handle\p{Lu}"), 0.2)
        .when(exported, 0.5)
        .otherwise(0.9)
    )


def entry_type(name: Column, path: Column, route: Column, method: Column, is_test: Column, is_cli: Column, is_public: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(route.isNotNull() | method.isNotNull(), "http_handler")
        .when(name.isin("main", "__main__"), "main")
        .when(low.startswith("test_") | low.endswith("_test") | name.startswith("Test") | F.coalesce(is_test, F.lit(False)), "test_entry")
        .when(_any(path, ["/test/", "/tests/", "/__tests__/", ".test.", ".spec.", "_test."]), "test_entry")
        .when(low.contains("command") | low.contains("cli") | F.coalesce(is_cli, F.lit(False)), "cli_command")
        .when(low.startswith("on_") | low.startswith("handle_") | low.endswith("_handler") | low.endswith("_callback"), "event_handler")
        .when(is_public, "public_api")
    )


def complexity_grade(value: Column) -> Column:
    return F.when(value.between(1, 5), "A").when(value.between(6, 10), "B").when(value.between(11, 20), "C").when(value.between(21, 50), "D").otherwise("F")


def file_grade(average: Column) -> Column:
    """The average is truncated before it is graded."""
    whole = F.floor(average)
    return F.when(whole <= 5, "A").when(whole <= 10, "B").when(whole <= 15, "C").when(whole <= 25, "D").otherwise("F")


def layer(path: Column) -> Column:
    low = F.lower(path)
    stem = F.regexp_replace(F.regexp_extract(low, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    out = None
    for name, parts in LAYERS:
        hit = _any(low, parts.split())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return (
        out.when(stem.endswith("controller"), "controller")
        .when(stem.endswith("service"), "service")
        .when(stem.endswith("repository") | stem.endswith("repo"), "repository")
        .when(stem.endswith("model") | stem.endswith("entity"), "domain")
        .when(stem.endswith("handler"), "handler")
        .when(stem.endswith("middleware"), "middleware")
        .when(stem.startswith("test_") | stem.endswith("_test") | stem.endswith(".test") | stem.endswith(".spec"), "test")
    )


def anchored_pattern(pattern: str) -> str:
    """An anchored regular expression from a regular expression or a glob."""
    if any(mark in pattern for mark in (".*", r"\w", r"\d", "(", "|", "[", "+", "{")):
        return pattern if pattern.startswith("^") and pattern.endswith("$") else f"^{pattern.removeprefix('^').removesuffix('$')}$"
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


# Names of the same type.
_TYPE_ALIASES = {"boolean": "bool", "integer": "int", "i32": "int", "i64": "int", "str": "string", "&str": "string", "()": "void", "none": "void", "null": "void"}


def type_matches(actual: Column, expected: str) -> Column:
    """Exact, by alias, by * as wildcard, or by the name before generic arguments."""
    low = F.lower(actual)
    aliases = F.create_map(*[F.lit(x) for pair in _TYPE_ALIASES.items() for x in pair])
    canonical = F.coalesce(F.try_element_at(aliases, low), low)
    wanted = _TYPE_ALIASES.get(expected.lower(), expected.lower())
    hit = (actual == expected) | (canonical == wanted) | actual.startswith(expected + "<") | (F.substring_index(low, "<", 1) == expected.lower().split("<")[0])
    if "*" in expected:
        hit = hit | actual.rlike("^" + ".*".join(re.escape(p) for p in expected.split("*")) + "$")
    return F.coalesce(hit, F.lit(False))


def return_type_of(signature: Column) -> Column:
    arrow = F.regexp_extract(signature, r"^.*->(.*)$", 1)
    colon = F.regexp_extract(signature, r"^.*\)\s*:(.*)$", 1)
    found = F.trim(F.regexp_replace(F.when(arrow != "", arrow).otherwise(colon), r"[{;\s]+$", ""))
    return F.when(found != "", found)


def params_of(signature: Column) -> Column:
    """Parameters in the first balanced parentheses of a signature, without a leading self; null without parentheses.

    The characters behind the first parenthesis are folded, with the depth of brackets of all kinds, so nesting may go as deep as it likes; an angle
    bracket closes nothing behind - or =. A part of blanks only is none.
    """
    start = F.locate("(", signature)
    chars = F.split(F.substr(signature, start + 1), "")
    zero, no = F.lit(0), F.lit(False)
    state = F.struct(F.lit(1).alias("depth"), zero.alias("parts"), no.alias("filled"), F.lit("").alias("first"), F.lit("").alias("before"))

    def step(s: Column, c: Column) -> Column:
        opens = c.isin("(", "[", "{", "<")
        closes = c.isin(")", "]", "}") | ((c == ">") & ~s["before"].isin("-", "="))
        comma = (c == ",") & (s["depth"] == 1)
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        ends = comma | (depth == 0)
        filled = F.when(ends, no).otherwise(s["filled"] | ~c.rlike(r"^\s*$"))
        parts = s["parts"] + F.when(ends & s["filled"], 1).otherwise(0)
        first = F.when((s["parts"] == 0) & ~ends & (F.length(s["first"]) < 64), F.concat(s["first"], c)).otherwise(s["first"])
        return F.when(s["depth"] == 0, s).otherwise(F.struct(depth.alias("depth"), parts.alias("parts"), filled.alias("filled"), first.alias("first"), c.alias("before")))

    end = F.aggregate(chars, state, step)
    own = F.trim(end["first"]).rlike(r"^(?:&\s*(?:'\w+\s+)?(?:mut\s+)?|mut\s+)?self\s*(?::.*)?$")
    return F.when((start > 0) & (end["depth"] == 0), end["parts"] - F.when(own, 1).otherwise(0))


def modifiers_hold(names: list[str], node: dict[str, Column]) -> Column:
    """Whether all modifiers hold; an unknown one never does."""
    no = F.lit(False)
    vis = F.lower(F.coalesce(node["visibility"], F.lit("")))
    public = F.coalesce(node["is_public"], vis.isin("public", "pub"))
    known = {
        "async": F.coalesce(node["is_async"], no), "public": public, "pub": public, "private": (vis == "private") | (~public & (vis != "")),
        "protected": vis == "protected", "static": F.coalesce(node["is_static"], no), "const": F.coalesce(node["is_const"], no),
    }
    out = F.lit(True)
    for n in names:
        out = out & known.get(n.lower(), no)
    return out


def test_paths(path: Column) -> Column:
    """The seven places where tests of a file are looked for; none for a file without extension."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(file, r".\.([^.]*)$", 1)
    stem = F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")

    def at(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    places = F.array(
        at(folder, "/", stem, ".test.", ext), at(folder, "/", stem, ".spec.", ext), at(folder, "/", stem, "_test.", ext), at(folder, "/tests/", stem, ".", ext),
        at(folder, "/__tests__/", stem, ".", ext), at(folder, "/test/", stem, ".", ext), at(folder, "/tests/", stem, "_test.", ext),
    )
    return F.when(ext != "", places).otherwise(F.array().cast("array<string>"))


def usage_description(caller: Column, target: Column, code: Column) -> Column:
    head = F.when(F.coalesce(caller, F.lit("")) != "", F.concat(F.lit("`"), caller, F.lit("` calls `"), target, F.lit("`"))).otherwise(F.concat(F.lit("Usage of `"), target, F.lit("`")))
    return F.concat_ws(
        " ", head, F.when(code.rlike("await|async"), "(async)"), F.when(code.rlike(r"try|catch|\?"), "with error handling"), F.when(code.rlike("if|match|switch"), "conditionally")
    )


def truncate(text: Column, length: int = 500) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("..."))).otherwise(text)


def call_site(code: Column, target: Column, most: int = 30, around: int = 5) -> Column:
    """At most ``most`` lines of code whole; of longer code the first line and those around the first line that holds the target."""
    lines = F.split(code, "\n")
    size = F.size(lines)
    hit = F.array_position(F.transform(lines, lambda x: x.contains(target)), True)
    begin = F.greatest(hit - around, F.lit(2))
    end = F.least(hit + around, size)
    before = F.when(begin > 2, F.array(F.concat(F.lit("    // ... ("), (begin - 2).cast("string"), F.lit(" lines omitted)"))))
    after = F.when(end < size, F.array(F.concat(F.lit("    // ... ("), (size - end).cast("string"), F.lit(" lines omitted)"))))
    none = F.array().cast("array<string>")
    part = F.concat(F.slice(lines, 1, 1), F.coalesce(before, none), F.slice(lines, begin.cast("int"), F.greatest(end - begin + 1, F.lit(0)).cast("int")), F.coalesce(after, none))
    return F.when(size <= most, code).when(hit > 0, F.array_join(part, "\n")).otherwise(F.array_join(F.slice(lines, 1, most), "\n"))


def tokens_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4)


# Commits ---------------------------------------------------------------------------------------------------------

# How a commit's subject or body shows what it is, in the order tried: (pattern, confidence, subject, body).
COMMIT_RULES = [
    ("BugFix", 0.9, r"^(?:fix:|fix\(|bug:|bugfix:)", None),
    ("BreakingChange", 0.95, r"^breaking:", r"breaking change|^breaking:"),
    ("Deprecation", 0.9, r"^(?:deprecate:|deprecated:)", None),
    ("Revert", 0.95, r"^revert", None),
    ("ArchitecturalDecision", 0.85, r"^(?:arch:|adr:|decision:)", r"architectural decision|adr-"),
    ("Feature", 0.8, r"^(?:feat:|feat\(|feature:|add:)", None),
    ("Refactor", 0.8, r"^(?:refactor:|refactor\(|cleanup:|clean:)", None),
    ("Documentation", 0.9, r"^(?:docs:|doc:|documentation:)", None),
    ("Test", 0.9, r"^(?:test:|tests:|testing:)", None),
    ("BugFix", 0.75, r"fixed |fixes |fixing |closes #|fixes #|bug |bugfix|hotfix|patch |resolve |resolved |resolves |crash|error handling|workaround", None),
    ("BreakingChange", 0.8, r"breaking|incompatible", None),
    ("Deprecation", 0.75, r"deprecat", r"deprecat"),
    ("Test", 0.7, r"test|spec |coverage", None),
    ("Documentation", 0.7, r"readme|document|comment|changelog", None),
    ("Refactor", 0.7, r"refactor|restructur|reorganiz|simplif|clean up|cleanup|move |rename |extract ", None),
    ("Feature", 0.7, r"added |adding |implement|introduce|new |support for|enable ", None),
]


def commit_pattern(subject: Column, body: Column) -> Column:
    """struct(pattern, confidence) of a commit."""
    s, b = F.lower(F.coalesce(subject, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    out = None
    for name, confidence, in_subject, in_body in COMMIT_RULES:
        hit = s.rlike(in_subject) | b.rlike(in_body) if in_body else s.rlike(in_subject)
        value = F.struct(F.lit(name).alias("pattern"), F.lit(confidence).alias("confidence"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.lit("Other").alias("pattern"), F.lit(0.5).alias("confidence")))


def _found(text: Column, pattern: str) -> Column:
    hit = F.regexp_extract(text, pattern, 1)
    return F.when(hit != "", hit)


def issue_reference(text: Column) -> Column:
    number = F.coalesce(*[_found(text, p) for p in (r"#(\d+)", r"(?i)gh-(\d+)", r"(?i)closes?\s+#(\d+)", r"(?i)fixes?\s+#(\d+)")])
    return F.concat(F.lit("#"), number)


def revert_hash(subject: Column) -> Column:
    return _found(subject, r"(?i)revert\s+([a-f0-9]{7,40})")


def body_field(body: Column, names: str) -> Column:
    """The text behind the first body line that starts with one of ``names`` and a colon."""
    line = F.try_element_at(F.filter(F.split(body, "\n"), lambda x: F.lower(x).rlike(f"^(?:{names}):")), F.lit(1))
    return F.trim(F.regexp_replace(line, r"^[^:]*:", ""))


def memory_kind_of_commit(pattern: Column, body: Column) -> Column:
    return (
        F.when(pattern == "BugFix", "debug_context")
        .when(pattern == "ArchitecturalDecision", "architectural_decision")
        .when((pattern == "Feature") & (F.octet_length(F.coalesce(body, F.lit(""))) > 50), "architectural_decision")
        .when(pattern.isin("BreakingChange", "Deprecation", "Revert"), "known_issue")
    )


# Routes ----------------------------------------------------------------------------------------------------------


def route_of_decorator(decorator: Column) -> Column:
    """struct(route, http_method) of a decorator, null if it is none of a route."""
    text = F.regexp_replace(decorator, "^@+", "")
    out = None
    for name, has_method in ROUTE_DECORATORS:
        rest = F.trim(F.substring(text, len(name) + 1, 100_000))
        quoted = F.coalesce(_found(rest, r'^\([^"]*"([^"]*)"'), _found(rest, r"^\([^']*'([^']*)'"), F.lit(""))
        method = name.rsplit(".", 1)[-1].lower().removesuffix("mapping").upper() if has_method else "ANY"
        value = F.struct(quoted.alias("route"), F.lit(method).alias("http_method"))
        out = F.when(text.startswith(name), value) if out is None else out.when(text.startswith(name), value)
    return out


def method_of_client(name: Column) -> Column:
    last = F.lower(F.regexp_extract(name, r"([^.:]*)$", 1))
    return F.when(last.isin("get", "post", "put", "patch", "delete"), F.upper(last)).otherwise("ANY")


def url_paths(source: Column) -> Column:
    """Paths in literals, then those of whole addresses that are not among them."""
    plain = F.regexp_extract_all(source, F.lit(r"[\"'`](/[a-zA-Z0-9_/{}\-\.]+)"), 1)
    full = F.regexp_extract_all(source, F.lit(r"https?://[^/\s\"'`]+(/[a-zA-Z0-9_/{}\-\.]+)"), 1)
    return F.concat(plain, F.array_except(full, plain))


def normal_route(route: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(route, r"(?s)[?#].*$", ""), "/+$", "")
    return F.when(cut == "", "/").otherwise(cut)


def route_matches(pattern: Column, path: Column) -> Column:
    a, b = F.split(pattern, "/"), F.split(path, "/")
    same = F.forall(F.zip_with(a, b, lambda p, x: F.coalesce((p == x) | p.rlike(r"^\{.*\}$|^:|^<.*>$"), F.lit(False))), lambda ok: ok)
    return (F.size(a) == F.size(b)) & same


def language_of_path(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    table = F.create_map(*[F.lit(x) for lang, exts in LANGUAGES.items() for e in exts.split() for x in (e, lang)])
    return F.try_element_at(table, ext)


def canonical_language(name: Column) -> Column:
    low = F.lower(F.trim(name))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, low), low)


def project_slug(folder: Column) -> Column:
    """Name of the folder in lower case with dashes, and four hexadecimal digits of its path's MD5."""
    base = F.regexp_replace(F.lower(F.regexp_extract(folder, r"([^/]*)/?$", 1)), "[^a-z0-9]", "-")
    return F.concat_ws("-", base, F.right(F.md5(folder.cast("binary")), F.lit(4)))


def symbol_kind(name: str) -> str | None:
    """The node type that a symbol type's name or alias means."""
    table = {"function": "Function", "method": "Function", "class": "Class", "struct": "Class", "variable": "Variable", "constant": "Variable", "module": "Module", "namespace": "Module", "interface": "Interface", "trait": "Interface", "type": "Type", "enum": "Type", "file": "CodeFile"}
    return table.get(name.lower())


def symbol_weight(complexity: Column, start: Column, end: Column) -> Column:
    return F.coalesce(complexity, F.lit(1)) * 100 + F.greatest(end - start, F.lit(0)) + 1


def embed_text(name: Column, signature: Column, doc: Column, source: Column | None = None) -> Column:
    """What a symbol's vector is made of; with ``source`` up to 2048 characters of body if that adds more than ten."""
    sig, text = F.coalesce(signature, F.lit("")), F.coalesce(doc, F.lit(""))
    base = F.when((sig != "") & (text != ""), F.concat(name, F.lit(": "), sig, F.lit(" — "), text)).when(sig != "", F.concat(name, F.lit(": "), sig)).when(text != "", F.concat(name, F.lit(" — "), text)).otherwise(name)
    if source is None:
        return base
    return F.when(F.length(source) > F.length(base) + 10, F.concat(base, F.lit("\n"), F.substring(source, 1, 2048))).otherwise(base)


def was_valid_at(valid: Column, invalid: Column, moment: Column) -> Column:
    return (valid <= moment) & (invalid.isNull() | (moment < invalid))


def was_current_at(created: Column, superseded: Column, moment: Column) -> Column:
    return (created <= moment) & (superseded.isNull() | (moment < superseded))


def is_at_commit(commit: Column, wanted: str) -> Column:
    """Whether a note is of a commit, of which either name may be cut short to seven characters or more."""
    short = F.lit(wanted)
    return F.coalesce((F.length(commit) >= 7) & (F.length(short) >= 7) & (commit.startswith(short) | short.startswith(commit)), F.lit(False)) | F.coalesce(commit == short, F.lit(False))


def change_action(change: Column) -> Column:
    """(action, confidence): what a change of code asks of the notes that speak of it; null for an unknown change."""
    out = None
    for name, (action, sure) in CHANGE_ACTIONS.items():
        value = F.struct(F.lit(action).alias("action"), F.lit(sure).alias("confidence"))
        out = F.when(change == name, value) if out is None else out.when(change == name, value)
    return out


# What a change of code asks of memories that speak of it, and how surely.
CHANGE_ACTIONS = {"Deleted": ("Invalidate", 1.0), "SignatureChanged": ("Review", 0.9), "MajorRefactor": ("Review", 0.8), "MinorEdit": ("None", 0.0), "Renamed": ("Update", 0.7), "Moved": ("Update", 0.7)}
