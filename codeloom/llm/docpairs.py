"""Functions paired with their documentation, from lexed source: declarations are found on masked text, where comments
and literals cannot mislead, braces and parentheses are matched to delimit them, and the comment that stands directly
before a declaration (in Python the docstring) is attached.
"""

from __future__ import annotations

import ast
import bisect
import inspect
import re
from collections.abc import Iterator
from typing import NamedTuple

from codeloom.llm.lexing import STR_HEAD, Scan, Token, scan


class Declaration(NamedTuple):
    name: str
    line_no: int
    signature: str
    doc: str | None
    code: str  # from the declaration, behind its annotations, to the end of its body


#: Words that may stand before a parenthesis without naming a function.
_CONTROL = {
    "javascript": set("if for while switch catch with function return typeof new await super import do else yield void delete in of instanceof case throw".split()),
    "java": set("if for while switch catch synchronized try return new super this assert throw do else case yield instanceof".split()),
    "c": set("if for while switch return sizeof do else case defined _Alignof _Alignas _Static_assert __attribute__ __asm__ asm typeof".split()),
}
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_BRACKETS = re.compile(r"[()\[\]{}]")
_PY_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t\\]+([^\W\d]\w*)\s*(\[|\()", re.M)
_GO_FUNC = re.compile(r"^func\b\s*(\()?", re.M)
_IDENT = re.compile(r"[^\W\d][\w$]*")
_RUST_FN = re.compile(r"\bfn\s+((?:r#)?[^\W\d]\w*)\s*[<(]")
_JS_FUNCTION = re.compile(r"(?<![\w$.])function\s*\*?\s*([^\W\d][\w$]*)\s*[<(]|(?<![\w$.])function\s*\*?\s*(\$[\w$]*)\s*[<(]")
_JS_BOUND = re.compile(r"(?<![\w$.])(?:const|let|var)\s+([^\W\d][\w$]*|\$[\w$]*)\s*(?=[:=])")
_JS_ARROW = re.compile(r"\s*(?:async\b\s*)?(?:function\b|(?:<[^()]*>\s*)?(\()|[^\W\d][\w$]*\s*=>)")
_CALL = re.compile(r"([^\W\d][\w$]*)\s*(?=\()")
_JS_CALL = re.compile(r"(#?(?:[^\W\d]|\$)[\w$]*)\s*(?:<[^(){};=]*>\s*)?(?=\()")
#: Modifiers of members.
_JS_MODS = set("static async get set public private protected readonly abstract override declare accessor *".split())
_JAVA_HEAD = re.compile(r"(?:(?:public|private|protected|static|final|abstract|native|synchronized|transient|strictfp|default)\b\s*)*(?:<[^()=;]*>\s*)?(?:[^\W\d][\w$]*(?:\s*\.\s*[^\W\d][\w$]*)*\s*(?:<[^()=;]*>)?(?:\s*\[\s*\])*\s*)?$")
_C_HEAD = re.compile(r"(?:[^\W\d]\w*\s*|\*\s*)+$")
_THROWS = re.compile(r"\s*throws\b[^{};=]*")
_NAME_BEFORE = re.compile(r"[\w$]+\s*$|[.\])\"'\x02\x03]\s*$")


_STOP = re.compile(r"[(\[{;]")
_GO_STOP = re.compile(r"(?:interface|struct)\s*\{|[(\[{\n]")
_EXPRESSION_END = re.compile(r"[()\[\]{};,]|\n(?!\s*[.?:&|+*/)=-])")
_PY_LINE = re.compile(r"\n([ \t]*)(?=[^\s])")
_OPENING = re.compile(r"[(\[{]")
_SPACE = re.compile(r"\s*")


class _Brackets:
    """Partners of all brackets of a masked text and the bracket each position lies in."""

    def __init__(self, masked: str):
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        for m in _BRACKETS.finditer(masked):
            k = m.start()
            if m[0] in "([{":
                stack.append(k)
            elif stack and _CLOSE[masked[stack[-1]]] == m[0]:
                o = stack.pop()
                self.partner[o] = k
                self.partner[k] = o


def _lines(text: str) -> list[int]:
    return [m.start() for m in re.finditer("\n", text)]


def _clean_block(text: str) -> str:
    body = text[3:-2] if text.endswith("*/") and len(text) >= 5 else text[3:]
    return "\n".join(re.sub(r"^\s*\*? ?", "", line.rstrip(), count=1) if k else line.strip() for k, line in enumerate(body.split("\n"))).strip()


class _Docs:
    """The comment blocks that may document what follows them."""

    def __init__(self, text: str, s: Scan, lang: str):
        self.text, self.lang = text, lang
        self.comments = [t for t in s.comments if t.kind != "directive"]
        self.ends = [t.end for t in self.comments]

    def _is_doc(self, t: Token) -> str | None:
        head = self.text[t.start : t.start + 4]
        if t.kind == "block":
            return "block" if self.lang != "go" and head.startswith("/**") and head not in ("/**/",) and not (self.lang == "rust" and head == "/***") else None
        if self.lang == "go":
            return "line"
        if self.lang in ("rust", "c"):
            return "line" if head.startswith("///") and head != "////" else None
        return None

    def before(self, pos: int) -> str | None:
        """The documentation that ends right before ``pos``; a blank line or another comment between ends the search."""
        k = bisect.bisect_right(self.ends, pos) - 1
        if k < 0:
            return None
        t = self.comments[k]
        gap = self.text[t.end : pos]
        if gap.strip() or gap.count("\n") > 1:
            return None
        kind = self._is_doc(t)
        if kind == "block":
            return _clean_block(self.text[t.start : t.end])
        if kind is None:
            return None
        lines = []
        while k >= 0:
            t = self.comments[k]
            line_start = self.text.rfind("\n", 0, t.start) + 1
            if t.kind != "line" or self._is_doc(t) != "line" or self.text[line_start : t.start].strip():
                break
            if lines:
                gap = self.text[t.end : below]
                if gap.strip() or gap.count("\n") != 1:
                    break
            below = t.start
            mark = 2 if self.lang == "go" else 3
            lines.append(self.text[t.start + mark : t.end].rstrip("\r"))
            k -= 1
        if not lines:
            return None
        return "\n".join(x[1:] if x[:1] == " " else x for x in reversed(lines)).strip()


def _back(masked: str, b: _Brackets, pos: int, stops: str = ";{}(,[") -> int:
    """The start of the declaration that goes on at ``pos``: behind the last of ``stops`` outside parentheses."""
    k = pos - 1
    while k >= 0:
        c = masked[k]
        if c in ")]":
            k = b.partner.get(k, 0)
        elif c in stops:
            break
        k -= 1
    return k + 1


def _word_before(masked: str, pos: int) -> tuple[int, int]:
    """(start, end) of the word, or other single character, that is last before ``pos``."""
    end = pos
    while end and masked[end - 1].isspace():
        end -= 1
    start = end
    while start and (masked[start - 1].isalnum() or masked[start - 1] in "_$"):
        start -= 1
    return (start, end) if start < end else (max(0, end - 1), end)


def _before_words(masked: str, pos: int, words: set[str]) -> int:
    """Where the run of ``words`` begins that ends before ``pos``; ``pos`` if there is none."""
    while True:
        start, end = _word_before(masked, pos)
        if start == end or masked[start:end] not in words or start and masked[start - 1] in ".#$":
            return pos
        pos = start


def _first(masked: str, start: int, pos: int) -> int:
    while start < pos and masked[start].isspace():
        start += 1
    return start


def _strip_annotations(masked: str, b: _Brackets, pos: int, end: int, lang: str) -> tuple[int, int]:
    """Skips attributes, annotations or decorators from ``pos``: (the first of them, the declaration proper)."""
    first = pos
    while pos < end:
        if lang == "rust" and masked[pos] == "#":
            k = masked.find("[", pos, end)
            if k < 0:
                break
            pos = b.partner.get(k, end) + 1
        elif lang != "rust" and masked[pos] == "@":
            m = re.compile(r"@\s*[^\W\d][\w$]*(?:\s*\.\s*[^\W\d][\w$]*)*\s*").match(masked, pos)
            if not m or m[0].strip() == "@interface":
                break
            pos = m.end()
            if masked[pos : pos + 1] == "(":
                pos = b.partner.get(pos, end) + 1
        else:
            break
        pos = _first(masked, min(pos, end), end)
    return first, pos


def _skip_type(masked: str, b: _Brackets, pos: int) -> int:
    """Behind a TypeScript type that starts at ``pos``: at the body's brace, a semicolon, a comma or the end."""
    angle, fresh = 0, True
    n = len(masked)
    while pos < n:
        c = masked[pos]
        if c == "{" and not fresh and not angle:
            return pos
        if c in "([{":
            pos = b.partner.get(pos, n)
            fresh = False
        elif c == "<":
            angle += 1
        elif c == ">" and masked[pos - 1] != "=":
            angle -= 1
            fresh = False
        elif c in ";,)}" and angle <= 0:
            return pos
        elif c in "|&?:" or masked.startswith("=>", pos):
            fresh = True
        elif not c.isspace():
            word = _IDENT.match(masked, pos)
            if word:
                fresh = word[0] in ("keyof", "is", "extends", "typeof", "infer", "asserts", "readonly")
                pos = word.end() - 1
            else:
                fresh = False
        pos += 1
    return n


def _stop(masked: str, b, pos: int, lang: str) -> int:
    """Where the head of a function ends whose parameters end before ``pos``: at its body's brace, a semicolon, or (Go) the line's end."""
    pattern = _GO_STOP if lang == "go" else _STOP
    while m := pattern.search(masked, pos):
        if m[0] in "([" or m[0] != "{" and len(m[0]) > 1:  # a group of the result's type
            pos = b.partner.get(m.end() - 1, m.end()) + 1
        else:
            return m.start()
    return len(masked)


def _script_stop(masked: str, b, k: int) -> int:
    """The same behind the parameters that open at ``k`` in JavaScript and TypeScript."""
    rest = _SPACE.match(masked, b.partner.get(k, k) + 1).end()
    return _skip_type(masked, b, rest + 1) if masked[rest : rest + 1] == ":" else rest


def _body_end(masked: str, b, stop: int) -> int:
    """Behind the body of a function whose head ends at ``stop``, found by matching its brace; -1 if that is open. A function without
    a body ends with its head, an arrow's expression where its statement does."""
    if stop >= len(masked):
        return len(masked)
    if masked.endswith("function", 0, stop):
        stop = _script_stop(masked, b, masked.find("(", stop))
    elif masked.startswith("=>", stop - 2):
        stop -= 2
    if masked.startswith("=>", stop):
        stop = _SPACE.match(masked, stop + 2).end()
        if masked[stop : stop + 1] != "{":
            while m := _EXPRESSION_END.search(masked, stop):
                if m[0] not in "([{":
                    return m.start()
                stop = b.partner.get(m.start(), len(masked)) + 1
            return len(masked)
    if masked[stop : stop + 1] == "{":
        return b.partner.get(stop, -2) + 1
    return stop + (masked[stop : stop + 1] == ";")


def _indented_end(masked: str, b, start: int, colon: int) -> int:
    """Behind the suite of a Python function that is declared at ``start``: before the next line that isn't indented deeper."""
    own = len(masked[masked.rfind("\n", 0, start) + 1 : start].expandtabs())
    last = colon + 1
    for m in _PY_LINE.finditer(masked, colon):
        if m.start() < last:
            continue  # within brackets
        if len(m[1].expandtabs()) <= own and masked[m.start() - 1 : m.start()] != "\\":
            opened = _open_bracket(masked, b, last, m.start())
            if opened < 0:
                return len(masked[: m.start()].rstrip())
            last = b.partner.get(opened, len(masked)) + 1
    return len(masked.rstrip())


def _open_bracket(masked: str, b, pos: int, end: int) -> int:
    """The first bracket in between that closes behind ``end``; -1 if there is none."""
    while m := _OPENING.search(masked, pos, end):
        pos = b.partner.get(m.start(), len(masked))
        if pos >= end:
            return m.start()
    return -1


def declarations(text: str, lang: str, s: Scan | None = None) -> list[Declaration]:
    """All function and method declarations of a valid file, in order, with their raw documentation."""
    s = s or scan(text, lang)
    masked = s.masked
    b = _Brackets(masked)
    newlines = _lines(text)
    found: list[tuple[int, str, int, str | None, int]] = []  # name's offset, name, end of signature, doc, begin
    docs = None if lang == "python" else _Docs(text, s, lang)

    def paren_end(k: int) -> int:
        return b.partner.get(k, -1)

    if lang == "python":
        starts = {t.start: t for t in s.strings}
        for m in _PY_DEF.finditer(masked):
            k = m.end() - 1
            if masked[k] == "[":
                k = masked.find("(", paren_end(k))
            end = paren_end(k)
            if end < 0:
                continue
            colon = end + 1
            while colon < len(masked) and masked[colon] != ":":
                colon = b.partner.get(colon, colon) + 1 if masked[colon] in "([{" else colon + 1
            found.append((m.start(1), m[1], colon, _docstring(text, masked, starts, colon + 1), _first(masked, m.start(), m.start(1))))
    elif lang == "go":
        for m in _GO_FUNC.finditer(masked):
            pos = m.end()
            if m[1]:
                pos = paren_end(pos - 1) + 1
            name = _IDENT.match(masked, _first(masked, pos, len(masked)))
            if not name:
                continue
            k = _first(masked, name.end(), len(masked))
            if masked[k : k + 1] == "[":
                k = _first(masked, paren_end(k) + 1, len(masked))
            if masked[k : k + 1] != "(":
                continue
            found.append((name.start(), name[0], _stop(masked, b, paren_end(k) + 1, lang), docs.before(m.start()), m.start()))
    elif lang == "rust":
        for m in _RUST_FN.finditer(masked):
            start = _first(masked, _back(masked, b, m.start(), ";{},"), m.start())
            first, proper = _strip_annotations(masked, b, start, m.start(), lang)
            found.append((m.start(1), m[1], _stop(masked, b, paren_end(masked.find("(", m.end() - 1)) + 1, lang), docs.before(first), proper))
    elif lang in ("java", "c"):
        classes = set(re.findall(r"\b(?:class|enum|record)\s+([^\W\d][\w$]*)", masked)) if lang == "java" else set()
        depth = _depths(masked) if lang == "c" else None
        for m in _CALL.finditer(masked):
            if m[1] in _CONTROL[lang] or depth is not None and depth(m.start()):
                continue
            end = paren_end(masked.find("(", m.end()))
            if end < 0:
                continue
            after = end + 1
            if lang == "java":
                t = _THROWS.match(masked, after)
                after = t.end() if t else after
            after = _first(masked, after, len(masked))
            if masked[after : after + 1] not in ("{", ";"):
                continue
            start = _first(masked, _back(masked, b, m.start(), ";{}(" if lang == "java" else ";{}(,["), m.start())
            first, proper = _strip_annotations(masked, b, start, m.start(), lang)
            head = masked[proper : m.start()]
            if lang == "java":
                if not _JAVA_HEAD.match(head):
                    continue
                words = head.split()
                kind = [w for w in words if w not in ("public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "strictfp", "default")]
                if any(w in _CONTROL["java"] for w in words) or not kind and m[1] not in classes or not kind and masked[after] == ";":
                    continue
            elif not head.strip() or not _C_HEAD.match(head) or set(head.split()) & {"return", "else", "typedef", "goto", "case", "do"}:
                continue
            found.append((m.start(1), m[1], after, docs.before(first), proper))
    else:
        _script(masked, b, docs, found)
    found.sort(key=lambda x: x[0])
    out, last = [], -1
    for pos, name, stop, doc, begin in found:
        if pos == last:
            continue
        last = pos
        end = _indented_end(masked, b, begin, stop) if lang == "python" else _body_end(masked, b, stop)
        if end < 0:
            continue
        line = bisect.bisect_left(newlines, pos) + 1
        out.append(Declaration(name, line, " ".join(text[text.rfind("\n", 0, pos) + 1 : stop].split()), doc, text[begin:end]))
    return out


def _depths(masked: str):
    """A function that tells how many braces are open at a position, without those of extern blocks."""
    at, level, stack = [0], [0], []
    for m in re.finditer(r"[{}]", masked):
        if m[0] == "{":
            at_end = _word_before(masked, m.start())[1]
            outer = False
            if masked[at_end - 1 : at_end] == "\x03":  # extern "C"
                word = _word_before(masked, masked.rfind(STR_HEAD, 0, at_end))
                outer = masked[word[0] : word[1]] == "extern"
            stack.append(outer)
            d = level[-1] + (not outer)
        else:
            d = level[-1] - (not stack.pop() if stack else 0)
        at.append(m.end())
        level.append(d)
    return lambda pos: level[bisect.bisect_right(at, pos) - 1]


_CLASS_HEAD = re.compile(r"(?<![\w$.])(?:class|interface)\b(?!\s*[:=,;)])[^{};=()]*(?:\([^(){}]*\)[^{};=()]*)*$")


def _script(masked: str, b: _Brackets, docs: _Docs, found: list) -> None:
    size = len(masked)
    for m in _JS_FUNCTION.finditer(masked):
        name = m[1] or m[2]
        start = _before_words(masked, m.start(), {"export", "default", "async", "declare"})
        begin = _first(masked, _back(masked, b, start), start)
        first, proper = _strip_annotations(masked, b, begin, start, "javascript")
        found.append((m.start(1) if m[1] else m.start(2), name, _script_stop(masked, b, masked.find("(", m.end() - 1)), docs.before(start), start))
    for m in _JS_BOUND.finditer(masked):
        k = m.end()
        if masked[k] == ":":
            k = _to_assign(masked, b, k + 1)
        if k < 0 or masked[k : k + 2] in ("==", "=>"):
            continue
        a = _JS_ARROW.match(masked, k + 1)
        if not a:
            continue
        if a[1]:
            end = b.partner.get(a.end() - 1, -1)
            rest = _first(masked, end + 1, size)
            if end < 0:
                continue
            if masked[rest : rest + 1] == ":":
                arrow = masked.find("=>", rest)
                if arrow < 0 or re.search(r"[;]", masked[rest:arrow]):
                    continue
                rest = arrow
            if not masked.startswith("=>", rest):
                continue
            stop = rest
        else:
            stop = a.end()
        start = _before_words(masked, m.start(), {"export", "declare"})
        found.append((m.start(1), m[1], stop, docs.before(start), start))
    bodies = set()
    for m in re.finditer(r"\{", masked):
        o = m.start()
        head = masked[_head_start(masked, b, o) : o]
        if _CLASS_HEAD.search(head):
            bodies.add(o)
    parents = _parents(masked)
    for m in _JS_CALL.finditer(masked):
        name = m[1]
        if name in _CONTROL["javascript"]:
            continue
        start = _before_words(masked, m.start(), _JS_MODS)
        j = start - 1
        while j >= 0 and masked[j].isspace():
            j -= 1
        deco = j
        prev = masked[j] if j >= 0 else ""
        if start and masked[start - 1 : start] and (masked[start - 1].isalnum() or masked[start - 1] in "_$.#"):
            continue
        k = masked.find("(", m.end() - 1)
        end = b.partner.get(k, -1)
        if end < 0:
            continue
        rest = _first(masked, end + 1, size)
        parent = parents(start)
        in_class = parent in bodies
        typed = masked[rest : rest + 1] == ":"
        if typed:
            rest = _skip_type(masked, b, rest + 1)
        body = masked[rest : rest + 1] == "{"
        if in_class:
            line_gap = "\n" in masked[end:rest] or masked[rest : rest + 1] in ";}"
            if not body and not (typed or line_gap):
                continue
            if prev not in "{};)" and not _line_break(masked, deco, start):
                continue
        elif not body or prev not in "{," or typed and not body:
            continue
        elif prev == "{" and parent >= 0 and not _object_brace(masked, parent):
            continue
        begin = start
        if in_class:
            begin = _first(masked, _back(masked, b, start), start)
            begin, _ = _strip_annotations(masked, b, begin, start, "javascript")
            begin = begin if masked[begin] == "@" else start
        found.append((m.start(1), name, rest, docs.before(begin), start))


def _line_break(masked: str, a: int, z: int) -> bool:
    return "\n" in masked[a:z]


def _object_brace(masked: str, o: int) -> bool:
    """Whether the brace at ``o`` opens an object literal rather than a block."""
    start, end = _word_before(masked, o)
    return start < end and (masked[end - 1] in "=(,:[?&|" or masked[start:end] in ("return", "default"))


def _to_assign(masked: str, b: _Brackets, pos: int) -> int:
    """The = that follows a type annotation; -1 if the statement ends before."""
    n = len(masked)
    while pos < n:
        c = masked[pos]
        if c in "([{":
            pos = b.partner.get(pos, n)
        elif c == "=" and masked[pos + 1 : pos + 2] == ">":
            pos += 1
        elif c == "=":
            return pos
        elif c in ";)}":
            return -1
        pos += 1
    return -1


def _head_start(masked: str, b: _Brackets, pos: int) -> int:
    k = pos - 1
    while k >= 0:
        c = masked[k]
        if c in ")]":
            k = b.partner.get(k, 0)
        elif c in ";{}":
            break
        k -= 1
    return k + 1


def _parents(masked: str):
    """A function that gives the innermost open brace, parenthesis or bracket at a position, -1 outside."""
    at, inside, stack = [0], [-1], []
    for m in _BRACKETS.finditer(masked):
        if m[0] in "([{":
            stack.append(m.start())
        elif stack:
            stack.pop()
        at.append(m.end())
        inside.append(stack[-1] if stack else -1)
    return lambda pos: inside[bisect.bisect_right(at, pos) - 1]


_PY_GAP = re.compile(r"[ \t\r\n\\]*")


def _docstring(text: str, masked: str, starts: dict[int, Token], pos: int) -> str | None:
    parts = []
    pos = _PY_GAP.match(masked, pos).end()
    while pos < len(masked) and masked[pos] == STR_HEAD:
        token = starts.get(pos)
        if token is None:
            return None
        body = text[token.start : token.end]
        prefix = body[: len(body) - len(body.lstrip("rRbBuUfFtT"))].lower()
        if set(prefix) & set("bft"):
            return None
        try:
            parts.append(ast.literal_eval(body))
        except (SyntaxError, ValueError):
            parts.append(body.strip("\"'"))
        gap = re.compile(r"[ \t\\]*").match(masked, token.end)
        pos = gap.end()
        if pos >= len(masked) or masked[pos] in "\r\n;#":
            break
    else:
        return None
    return inspect.cleandoc("".join(parts))


# The same, led by the documentation -----------------------------------------------------------------------------

_PAIRS = re.compile(r"[()\[\]{}]")
_NAME = r"([^\W\d][\w$]*)"
_LED = {
    "rust": re.compile(r"(?:pub\s*(?:\([^)]*\)\s*)?)?(?:(?:default|const|async|unsafe|extern(?:\s*\x02\x03*)?)\s*\b)*\s*fn\s+((?:r#)?[^\W\d]\w*)\s*[<(]"),
    "go": re.compile(r"func\b\s*(?:\([^()]*\)\s*)?" + _NAME + r"\s*[\[(]"),
    "java": re.compile(r"(?:(?:public|private|protected|static|final|abstract|native|synchronized|transient|strictfp|default|@[\w.]+(?:\([^()]*\))?)\s+)*(?:<[^()=;{}]*>\s*)?(?:([^\W\d][\w$]*(?:\s*\.\s*[^\W\d][\w$]*)*\s*(?:<[^()=;{}]*>)?(?:\s*\[\s*\])*)\s*(?<=[\s>\]]))?" + _NAME + r"\s*\("),
    "c": re.compile(r"((?:[^\W\d]\w*(?:\s+|\s*\*\s*)(?:\*\s*)*)+)" + _NAME + r"\s*\("),
}
_JS_LED = re.compile(r"(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:(?:async\s+)?function\s*\*?\s*((?:[^\W\d]|\$)[\w$]*)\s*[<(]|(?:const|let|var)\s+((?:[^\W\d]|\$)[\w$]*)\s*(?=[:=]))")
_JS_MEMBER = re.compile(r"(?:(?:static|async|get|set|public|private|protected|readonly|abstract|override|declare|accessor)\b(?!\s*[(<:=?;])\s*|\*\s*)*(#?(?:[^\W\d]|\$)[\w$]*)\s*\??\s*(?:<[^(){};=]*>\s*)?\(")
_ANNOTATION = re.compile(r"@\s*[^\W\d][\w$]*(?:\s*\.\s*[^\W\d][\w$]*)*\s*")


def _closing(masked: str, k: int) -> int:
    """The partner of the bracket at ``k`` among those of its kind; -1 if there is none."""
    opening = masked[k]
    closing = _CLOSE.get(opening)
    depth, pos = 0, k
    while closing:
        at = masked.find(closing, pos)
        if at < 0:
            break
        depth += masked.count(opening, pos, at) - 1
        if not depth:
            return at
        pos = at + 1
    return -1


class _Partners(dict):
    """Partners of opening brackets, found when asked for."""

    def __init__(self, masked: str):
        super().__init__()
        self.masked = masked

    def get(self, k: int, default=None):
        found = self.setdefault(k, _closing(self.masked, k)) if k not in self else self[k]
        return default if found < 0 else found


class _Lazy:
    def __init__(self, masked: str):
        self.partner = _Partners(masked)


def _blocks(text: str, s: Scan, lang: str) -> Iterator[tuple[int, str]]:
    """(end, raw text) of the comments, or runs of line comments, that are documentation by their form."""
    run: list[Token] = []
    mark = 2 if lang == "go" else 3

    def flush() -> Iterator[tuple[int, str]]:
        if run:
            lines = [text[t.start + mark : t.end].rstrip("\r") for t in run]
            yield run[-1].end, "\n".join(x[1:] if x[:1] == " " else x for x in lines).strip()
            run.clear()

    by_line = lang in ("go", "rust", "c")
    for t in s.comments:
        head = text[t.start : t.start + 4]
        if by_line and t.kind == "line" and (lang == "go" or head.startswith("///") and head != "////"):
            own_line = not text[text.rfind("\n", 0, t.start) + 1 : t.start].strip()
            if run and (not own_line or text.count("\n", run[-1].end, t.start) != 1 or text[run[-1].end : t.start].strip()):
                yield from flush()
            if own_line:
                run.append(t)
        else:
            yield from flush()
            if t.kind == "block" and lang != "go" and head.startswith("/**") and head != "/**/" and not (lang == "rust" and head == "/***"):
                yield t.end, _clean_block(text[t.start : t.end])
    yield from flush()


def documented(text: str, lang: str, s: Scan | None = None, texts: bool = True, says: bool = False) -> list[Declaration]:
    """The declarations that documentation stands before, in order; what ``declarations`` gives, without those without.
    Without ``texts`` signatures and code are empty; with ``says`` trivial documentation counts as none.

    Starts from each comment that is documentation by its form and matches the declaration behind it, brackets only where
    they are needed, so its cost follows the documentation and not the code.
    """
    s = s or scan(text, lang)
    masked = s.masked
    out: list[Declaration] = []
    last, line = 0, 1

    lazy = _Lazy(masked)

    def add(begin: int, pos: int, name: str, stop: int, doc: str | None) -> None:
        nonlocal last, line
        if says and is_trivial(doc, name):
            return
        end = _indented_end(masked, lazy, begin, stop) if lang == "python" else _body_end(masked, lazy, stop)
        if end < 0:
            return
        line += text.count("\n", last, pos)
        last = pos
        if texts:
            out.append(Declaration(name, line, " ".join(text[text.rfind("\n", 0, pos) + 1 : stop].split()), doc, text[begin:end]))
        else:
            out.append(Declaration(name, line, "", doc, ""))

    if lang == "python":
        starts = {t.start: t for t in s.strings}
        for m in _PY_DEF.finditer(masked):
            k = m.end() - 1
            if masked[k] == "[":
                k = masked.find("(", _closing(masked, k))
            end = _closing(masked, k)
            if end < 0:
                continue
            colon = masked.find(":", end)
            for o in _PAIRS.finditer(masked, end + 1, colon if colon >= 0 else end + 1):
                colon = masked.find(":", _closing(masked, o.start()))
                break
            doc = _docstring(text, masked, starts, colon + 1) if colon >= 0 else None
            if doc is not None:
                add(_first(masked, m.start(), m.start(1)), m.start(1), m[1], colon, doc)
        return out
    size = len(masked)
    depth, depth_at, parents, bodies = 0, 0, None, None
    for end, doc in _blocks(text, s, lang):
        pos = _SPACE.match(masked, end).end()
        gap = text[end:pos]
        if pos >= size or gap.strip() or gap.count("\n") > 1:
            continue
        while masked[pos : pos + 1] in ("@", "#"):
            if lang == "rust" and masked[pos] == "#":
                k = masked.find("[", pos)
                pos = lazy.partner.get(k, size) + 1 if k >= 0 else size
            elif lang != "rust" and (m := _ANNOTATION.match(masked, pos)) and m[0].strip() != "@interface":
                pos = m.end()
                if masked[pos : pos + 1] == "(":
                    pos = lazy.partner.get(pos, size) + 1
            else:
                break
            pos = _SPACE.match(masked, pos).end()
        if lang in ("javascript", "typescript"):
            m = _JS_LED.match(masked, pos)
            if m and m[1]:
                add(pos, m.start(1), m[1], _script_stop(masked, lazy, masked.find("(", m.end() - 1)), doc)
                continue
            if m:
                stop = _bound_function(masked, lazy, m.end())
                if stop >= 0:
                    add(pos, m.start(2), m[2], stop, doc)
                continue
            m = _JS_MEMBER.match(masked, pos)
            if not m or m[1] in _CONTROL["javascript"]:
                continue
            close = lazy.partner.get(m.end() - 1, -1)
            if close < 0:
                continue
            rest = _SPACE.match(masked, close + 1).end()
            typed = masked[rest : rest + 1] == ":"
            if typed:
                rest = _skip_type(masked, lazy, rest + 1)
            if masked[rest : rest + 1] != "{":
                if parents is None:
                    parents = _parents(masked)
                    whole = _Brackets(masked)
                    bodies = {o.start() for o in re.finditer(r"\{", masked) if _CLASS_HEAD.search(masked[_head_start(masked, whole, o.start()) : o.start()])}
                if parents(pos) not in bodies or not (typed or masked[rest : rest + 1] in ";}" or "\n" in masked[close:rest]):
                    continue
            add(pos, m.start(1), m[1], rest, doc)
            continue
        m = _LED[lang].match(masked, pos)
        if not m:
            continue
        if lang == "rust":
            k = masked.find("(", m.end() - 1)
            add(pos, m.start(1), m[1], _stop(masked, lazy, lazy.partner.get(k, m.end()) + 1, lang), doc)
            continue
        if lang == "go":
            if pos and masked[pos - 1] != "\n":
                continue
            k = m.end() - 1
            if masked[k] == "[":
                k = _SPACE.match(masked, lazy.partner.get(k, size) + 1).end()
            close = lazy.partner.get(k, -1)
            if close < 0:
                continue
            add(pos, m.start(1), m[1], _stop(masked, lazy, close + 1, lang), doc)
            continue
        close = lazy.partner.get(m.end() - 1, -1)
        if close < 0 or m[2] in _CONTROL[lang]:
            continue
        after = close + 1
        if lang == "java":
            t = _THROWS.match(masked, after)
            after = t.end() if t else after
        after = _SPACE.match(masked, after).end()
        if masked[after : after + 1] not in ("{", ";"):
            continue
        words = set((m[1] or "").split())
        if lang == "java":
            if words & _CONTROL["java"] or not m[1] and (masked[after] == ";" or not re.search(rf"\b(?:class|enum|record)\s+{re.escape(m[2])}\b", masked)):
                continue
        else:
            depth += masked.count("{", depth_at, pos) - masked.count("}", depth_at, pos)
            depth_at = pos
            if words & {"return", "else", "typedef", "goto", "case", "do"} or depth and _depths(masked)(pos):
                continue
        add(pos, m.start(2), m[2], after, doc)
    return out


def _bound_function(masked: str, b: _Lazy, k: int) -> int:
    """Where the signature of the function bound by a const, let or var ends whose name ends before ``k``; -1 if it is none."""
    if masked[k] == ":":
        k = _to_assign(masked, b, k + 1)
    if k < 0 or masked[k : k + 2] in ("==", "=>"):
        return -1
    a = _JS_ARROW.match(masked, k + 1)
    if not a:
        return -1
    if not a[1]:
        return a.end()
    end = b.partner.get(a.end() - 1, -1)
    if end < 0:
        return -1
    rest = _SPACE.match(masked, end + 1).end()
    if masked[rest : rest + 1] == ":":
        arrow = masked.find("=>", rest)
        if arrow < 0 or ";" in masked[rest:arrow]:
            return -1
        rest = arrow
    return rest if masked.startswith("=>", rest) else -1


# Whether documentation says anything ------------------------------------------------------------------------------

#: Notes in place of documentation, in the languages the texts are written in.
_PLACEHOLDER = re.compile(
    r"(?:todo|fixme|xxx|tbd|tba|tbc|hack|wip)\b.*"
    r"|n/?a|none|nil|null|empty|dummy|placeholder|stub|lorem ipsum.*|docs?|documentation|description|comment|summary|javadoc|docstring"
    r"|(?:\(|\[|<)?\s*(?:no|missing|without|needs?|add|insert|write|pending|some)\s+(?:any\s+)?(?:docs?|documentation|docstring|description|comments?|summary|text)(?:\s+(?:yet|here|available|provided|given|needed|later))?\s*(?:\)|\]|>)?"
    r"|(?:enter |insert |your |short |a )*(?:description|documentation|docs?|comment|text)\s+(?:goes|comes|to be|will be|is|follows?|pending|missing)\b.*"
    r"|(?:not|un|to be|yet to be|still to be)[ -]?(?:yet )?(?:documented|described|written)(?: yet)?"
    r"|auto-?\s?generated\b.*|automatically generated\b.*|generated (?:method|function|constructor|by)\b.*"
    r"|(?:non-javadoc|no-?op doc)\b.*"
    r"|noch nicht (?:dokumentiert|beschrieben)|(?:beschreibung|dokumentation|doku) (?:folgt|fehlt)(?: noch)?|(?:ohne|keine|fehlende) (?:beschreibung|dokumentation)|nicht dokumentiert|undokumentiert"
    r"|documentaci[oó]n (?:pendiente|por hacer|faltante)|(?:descripci[oó]n|documentaci[oó]n) (?:va aqu[ií]|aqu[ií])|(?:sin|falta(?: la)?) (?:documentaci[oó]n|documentar|descripci[oó]n)|(?:por|a[uú]n sin) (?:documentar|describir)|pendiente(?: de documentar)?"
    r"|(?:pas encore|non|à) (?:document[eé]|documenter|d[eé]crit)|(?:documentation|description) (?:manquante|à venir|à compl[eé]ter|à [eé]crire)|sans (?:documentation|description)|à compl[eé]ter"
    r"|(?:see|same as|siehe|voir|ver|v[eé]ase)\s+(?:above|below|elsewhere|there|oben|unten|ci-dessus|ci-dessous|arriba|abajo|(?:the )?(?:docs?|documentation|wiki|readme|parent|base class|super ?class|interface|header|spec))"
    r"|(?:see|siehe|voir|ver|v[eé]ase)(?:\s+also)?:?\s+\S+|\{?@?inherit-?doc\}?|(?:as|like) above|ditto|inherited\b.*|siehe dort"
    r"|internal|intern|interne|interno|deprecated|veraltet|obsolete|private|public|protected|experimental|unused",
    re.I,
)
#: Directives to tools.
_DIRECTIVE = re.compile(
    r"(?:noqa|nosec|nolint|pylint|pyright|mypy|flake8|type:\s*ignore|pragma|fmt:|yapf|isort|black|eslint|tslint|jshint|jslint|prettier|istanbul|c8|v8|ts-(?:ignore|nocheck|expect-error)|@ts-\S+|go:[a-z]+|\+build|line |export |clippy|rustfmt|allow\(|deny\(|clang-format|clang-tidy|cppcheck|lint|coverity|checkstyle|suppresswarnings|spotless|formatter|region|endregion|vim|-\*-|nocheck|noinspection|jscs|globals?\b|doxygen|spell|cspell)[:\s(-].*|(?:noqa|nosec|nolint|pragma|go:[a-z]+|@?ts-\S+|eslint-\S+|prettier-ignore)\b\S*",
    re.I,
)
_TAG_LINE = re.compile(r"(?:[@\\](\w+)(?:\{[^}]*\})?|:(\w+))\s*(.*)$")
_FIELD = re.compile(r":\w+(?:\s+[\w.*\[\], ]+)?:\s*(.*)$")
_HEADING = re.compile(r"(?:#+\s*)?(?:args?|arguments?|params?|parameters?|returns?|raises?|throws?|errors?|panics?|examples?|notes?|yields?|attributes?|safety|see also|todo)\s*:?$", re.I)
_LISTED = re.compile(r"(?:[*+-]\s*)?[`*]*([\w.$]+)[`*]*\s*(?:\([^)]*\))?\s*(?:[:–—-]\s*(.*))?$")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|_|\W")
#: Words that add nothing to a name.
_EMPTY_WORDS = set("a an the this that is it to of for and function method func fn def procedure routine constructor getter setter helper class does do performs perform implements implementation die das der diese funktion methode ist la le el les los una un cette esta fonction función método méthode est es".split())
_TAGS_WITH_NAME = {"param", "arg", "argument", "tparam", "throws", "exception", "raises", "raise", "keyword", "key", "type", "rtype", "var", "ivar", "cvar", "template", "typeparam", "retval", "property", "prop"}
_TAGS_NO_TEXT = {"override", "inheritdoc", "deprecated", "internal", "private", "public", "protected", "readonly", "static", "abstract", "async", "ignore", "hidden", "todo", "fixme", "see", "link", "author", "since", "version", "date", "copyright", "category", "group", "module", "file", "name", "function", "method", "memberof", "class", "constructor", "fn", "ingroup", "addtogroup", "license", "api", "test"}


def _restates(words: list[str], name_words: set[str]) -> bool:
    for w in words:
        if w in _EMPTY_WORDS or w in name_words:
            continue
        stems = {w[:-1] if w.endswith("s") else w, w[:-2] if w.endswith(("es", "ed", "er")) else w, w[:-3] if w.endswith("ing") else w, w[:-3] + "e" if w.endswith("ing") else w, w[:-1] if w.endswith("d") else w}
        stems |= {s[:-1] for s in stems if len(s) > 2 and s[-1] == s[-2:-1]}
        if not stems & name_words:
            return False
    return True


#: First words of lines that need the full look.
_GUARDED = set("todo fixme xxx tbd tba tbc hack wip lorem enter insert your short a description documentation docs doc comment text auto autogenerated automatically generated non inherited noqa nosec nolint pylint pyright mypy flake8 type pragma fmt yapf isort black eslint tslint jshint jslint prettier istanbul line export clippy rustfmt lint coverity checkstyle spotless formatter region endregion vim noinspection global globals cspell spell dummy placeholder stub".split())


def _says_much(doc: str, name_starts: set[str]) -> bool:
    """A quick yes for documentation with a plain sentence of seven words or more, four of which are not of the name."""
    for line in doc.split("\n"):
        words = line.lower().split()
        if len(words) < 7 or not words[0][0].isalpha() or words[0].rstrip(".:,;!-") in _GUARDED or words[0].endswith(":") or "-" in words[0]:
            continue
        fresh = 0
        for w in words:
            if len(w) > 2 and w.isalpha() and w not in _EMPTY_WORDS and w[:4] not in name_starts:
                fresh += 1
                if fresh == 4:
                    return True
    return False


def is_trivial(doc: str | None, name: str) -> bool:
    """No words, only the name again, a placeholder or a pointer elsewhere, or only tags, names and directives."""
    if not doc or not doc.strip():
        return True
    if _says_much(doc, {p.lower()[:4] for p in _CAMEL.split(name) if p}):
        return False
    name_words = {w.lower() for p in _CAMEL.split(name) for w in [p, *_WORD.findall(p)] if w} | {name.lower()}
    for raw in doc.split("\n"):
        line = raw.strip().strip("*").strip() if raw.strip().startswith("*") and not raw.strip().startswith("* ") else raw.strip()
        if not line or not _WORD.search(line) or _DIRECTIVE.fullmatch(line) or _HEADING.fullmatch(line):
            continue
        m = _FIELD.match(line)
        if m:
            if len(_WORD.findall(m[1])) >= 2:
                return False
            continue
        m = _TAG_LINE.match(line)
        if m:
            tag, rest = (m[1] or m[2] or "").lower(), m[3]
            if tag in _TAGS_WITH_NAME:
                rest = re.sub(r"^(?:\{[^}]*\}\s*)?[\[\]\w.$*&=<>,]+\s*-?\s*", "", rest, count=1)
            if tag in ("brief", "summary", "details", "description", "desc", "remarks", "note", "doc"):
                line = rest
            elif tag in _TAGS_NO_TEXT or len(_WORD.findall(rest)) < 2:
                continue
            else:
                return False
        elif line[0] in "{<" and re.fullmatch(r"\{@\w+[^}]*\}\.?|</?\w+/?>", line):
            continue
        plain = line.strip(" \t.!?:;…-–—=~#*_`\"'()[]<>/")
        if not plain or not _WORD.search(plain) or _PLACEHOLDER.fullmatch(plain) or _PLACEHOLDER.fullmatch(line.rstrip(" .!…")):
            continue
        m = _LISTED.match(line)
        if m and (not m[2] or not _WORD.search(m[2])) and (line.endswith(":") or line[0] in "*+-`"):
            continue
        words = [w.lower() for w in _WORD.findall(" ".join(_CAMEL.split(plain)))]
        if _restates(words, name_words):
            continue
        head = re.match(rf"{re.escape(name)}\s*[:\-–—]?\s+(.*)$", line)
        if head and _PLACEHOLDER.fullmatch(head[1].strip(" .!?")):
            continue
        return False
    return True
