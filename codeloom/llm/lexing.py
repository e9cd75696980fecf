"""String- and comment-aware lexers of seven languages.

``scan`` is a state machine over source text: from an entry state it finds comments and literals, masks them, and gives
the state it ends in. Masked text keeps every offset: comments become blanks, literals become STR_HEAD STR_TAIL*.
"""

from __future__ import annotations

import re
from typing import NamedTuple

CODE = ""
STR_HEAD, STR_TAIL = "\x02", "\x03"

#: File extension -> language.
EXTENSIONS = {
    "py": "python", "pyi": "python",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "go": "go", "java": "java", "rs": "rust", "c": "c", "h": "c",
}


def language_of(path: str | None) -> str | None:
    """The language the extension names; None for null, no or unknown extension."""
    if not path or "." not in path:
        return None
    return EXTENSIONS.get(path.rsplit(".", 1)[1].lower())


class Token(NamedTuple):
    start: int
    end: int
    kind: str  # "line", "block" (comments), "string", "char", "regex", "template", "directive"


class Scan(NamedTuple):
    masked: str
    comments: list[Token]
    strings: list[Token]
    state: str  # CODE, or the construct that is still open at the end
    error: str | None
    divides: bool = False  # whether a slash that comes next divides (JavaScript, in code and comments)

    @property
    def exit(self) -> str:
        """The state a text that goes on begins in."""
        return self.state + DIVIDES if self.divides and self.state in (CODE, "/*") else self.state


_LINE_STRING = r"\"(?:[^\"\\\n]|\\[\s\S])*\""
_C_ESC_STRING = r"\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\""
_OPENERS = {
    "python": r"#[^\n]*|(?<![\w])(?:[rR][bB]?|[bB][rR]?|[uU]|[fF][rR]?|[rR][fF]|[tT][rR]?)?(?:\"\"\"|'''|\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'|[\"'])|\"\"\"|'''|\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'|[\"']",
    "javascript": r"//[^\n]*|/\*|" + _C_ESC_STRING + r"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'|[`\"'/]",
    "go": r"//[^\n]*|/\*|\"(?:[^\"\\\n]|\\[^\n])*\"|'(?:[^'\\\n]|\\[^\n])[^'\n]*'|`|[\"']",
    "java": r"//[^\n]*|/\*|\"\"\"|\"(?:[^\"\\\n]|\\[^\n])*\"|'(?:[^'\\\n]|\\[^\n])[^'\n]*'|[\"']",
    "rust": r"//[^\n]*|/\*|(?<![\w])(?:br|cr|r)(?P<hash>#*)\"|(?<![\w])[bc]?\"|\"|(?<![\w])b?'(?:[^'\\\n]|\\(?:u\{[^}\n]*\}|x..|.))'|'(?:[^'\\\n]|\\(?:u\{[^}\n]*\}|x..|.))'|'[A-Za-z_]\w*(?!')|'",
    "c": r"//(?:[^\n\\]|\\[\s\S])*|/\*|^[ \t]*#(?:[^\n\\/\"]|\\(?:\r\n|[\s\S])|/(?![/*])|\"(?:[^\"\\\n]|\\.)*\"|\"(?=[^\"\n]*$))*|(?:\b(?:u8|[uUL]))?" + _C_ESC_STRING + r"|(?:\b[uUL])?'(?:[^'\\\n]|\\[^\n])(?:[^'\\\n]|\\[^\n])*'|[\"']",
}
_OPENERS["typescript"] = _OPENERS["javascript"]
_PATTERNS = {lang: re.compile(p, re.M if lang == "c" else 0) for lang, p in _OPENERS.items()}
#: How each construct that may span lines ends; a chunk may begin inside any of these.
_CLOSERS = {
    "/*": re.compile(r"\*/"),
    '"""': re.compile(r"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\""),
    "'''": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"),
    "`raw": re.compile(r"[^`]*+`"),
    '"rust': re.compile(r"(?:[^\"\\]|\\[\s\S])*+\""),
}
#: A state's last character if a slash that comes next divides (JavaScript).
DIVIDES = "÷"
#: The states a chunk's map holds. Deeper ones (comments nested or raw strings fenced beyond these, substitutions of templates) are left
#: open there, and whoever joins the maps has to scan the text in order.
STATES = {
    "javascript": [CODE, DIVIDES, "/*", "/*" + DIVIDES, "`t"],
    "typescript": [CODE, DIVIDES, "/*", "/*" + DIVIDES, "`t"],
    "go": [CODE, "/*", "`raw"],
    "java": [CODE, "/*", '"""'],
    "rust": [CODE, "/*1", "/*2", '"rust', "r0", "r1", "r2"],
    "c": [CODE, "/*"],
}
_REGEX_BODY = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
#: Words after which a slash begins a regular expression.
_REGEX_WORDS = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "yield", "await", "instanceof"}
_WORD_END = re.compile(r"[\w$]+$")
_NOT_NEWLINE = re.compile(r"[^\n]")
_NESTED = re.compile(r"/\*|\*/")
_COMMENT_END = re.compile(r"\*/")
_TEMPLATE = re.compile(r"[`\\]|\$\{")
_IN_SUBST = re.compile(r"[{}`]|//[^\n]*|/\*|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'")


def _template_end(text: str, pos: int, state: str) -> tuple[int, str]:
    """Where a template literal ends that goes on at ``pos``: (end, CODE), or (len, state) if it stays open.

    A state is a backquote, the brace depths of the open substitutions, and t in text, s in a substitution, c in a comment of one.
    """
    depths = [int(d) for d in state[1:-1].split(".") if d]
    place = state[-1]
    while True:
        m = (_TEMPLATE if place == "t" else _IN_SUBST if place == "s" else _COMMENT_END).search(text, pos)
        if m is None:
            return len(text), "`" + ".".join(map(str, depths)) + place
        t = m[0]
        pos = m.end() + (t == "\\")
        if place == "c":
            place = "s"
        elif place == "t":
            if t == "`":
                if not depths:
                    return pos, CODE
                place = "s"
            elif t == "${":
                depths.append(1)
                place = "s"
        elif t == "{":
            depths[-1] += 1
        elif t == "}":
            depths[-1] -= 1
            if not depths[-1]:
                depths.pop()
                place = "t"
        elif t == "`":
            place = "t"
        elif t == "/*":
            place = "c"


def _nested_end(text: str, pos: int, depth: int) -> tuple[int, int]:
    for m in _NESTED.finditer(text, pos):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end(), 0
    return -1, depth


def _close(text: str, pos: int, state: str) -> tuple[int, str]:
    """Where the construct ``state`` ends that goes on at ``pos``: (end, CODE), or (len, state) if it stays open."""
    if state[0] == "`" and state != "`raw":
        return _template_end(text, pos, state)
    if state.startswith("/*") and len(state) > 2:
        end, depth = _nested_end(text, pos, int(state[2:]))
        if end < 0:
            return len(text), f"/*{depth}"
    elif state[0] == "r":
        end = text.find('"' + "#" * int(state[1:]), pos)
        end = end if end < 0 else end + 1 + int(state[1:])
    else:
        m = _CLOSERS[state].search(text, pos) if state == "/*" else _CLOSERS[state].match(text, pos)
        end = m.end() if m else -1
    return (len(text), state) if end < 0 else (end, CODE)


def _divides(carry: str) -> bool:
    """Whether a slash divides behind ``carry``, the last significant text before it."""
    word = _WORD_END.search(carry)
    if word:
        return word[0] not in _REGEX_WORDS or carry[: word.start()].endswith(".")
    return bool(carry) and carry[-1] in ")]}\"'`"


def scan(text: str, lang: str, entry: str = CODE) -> Scan:
    """Runs the state machine of ``lang`` over ``text`` from the state ``entry``."""
    pattern = _PATTERNS[lang]
    out: list[str] = []
    comments: list[Token] = []
    strings: list[Token] = []
    error = None
    last, pos, size = 0, 0, len(text)
    script = lang in ("javascript", "typescript")
    carry = ""  # JavaScript: the last significant text, which decides what a slash is

    def literal(start: int, end: int, kind: str) -> None:
        strings.append(Token(start, end, kind))
        out.append(STR_HEAD + STR_TAIL * (end - start - 1))

    def comment(start: int, end: int, kind: str) -> None:
        comments.append(Token(start, end, kind))
        body = text[start:end]
        out.append(" " * (end - start) if "\n" not in body else _NOT_NEWLINE.sub(" ", body))

    if entry[-1:] == DIVIDES:
        carry, entry = ")", entry[:-1]
    if entry:
        end, state = _close(text, 0, entry)
        if end:
            if entry.startswith("/*"):
                comment(0, end, "block")
            else:  # the rest of a literal that began before: no token of its own
                strings.append(Token(0, end, "string"))
                out.append(STR_TAIL * end)
        if state:
            return Scan("".join(out), comments, strings, state, None, bool(carry))
        last = pos = end
        carry = carry if entry.startswith("/*") else '"'
    search = pattern.search
    while True:
        m = search(text, pos)
        if m is None:
            break
        start, end = m.span()
        tok = m[0]
        gap = text[last:start]
        if script:
            solid = gap.rstrip()
            if solid:
                carry = solid
            if tok == "/":
                is_regex = not _divides(carry)
                body = _REGEX_BODY.match(text, start) if is_regex else None
                if body:
                    out.append(gap)
                    literal(start, body.end(), "regex")
                    last = pos = body.end()
                    carry = '"'
                else:
                    pos = end
                continue
        out.append(gap)
        head = tok[:2]
        if head == "//" or (tok[0] == "#" and lang == "python"):
            if lang == "python" or tok[-1] != "\r":
                comment(start, end, "line")
            else:
                comment(start, end, "line")
        elif head == "/*":
            if lang == "rust":
                stop, depth = _nested_end(text, end, 1)
                state = f"/*{depth}"
            else:
                stop = text.find("*/", end)
                stop, state = (stop + 2, CODE) if stop >= 0 else (-1, "/*")
            if stop < 0:
                comment(start, size, "block")
                return Scan("".join(out), comments, strings, state, error, script and _divides(carry))
            comment(start, stop, "block")
            end = stop
        elif lang == "c" and tok.lstrip()[:1] == "#":
            comments.append(Token(start, end, "directive"))
            out.append(_NOT_NEWLINE.sub(" ", tok))
        elif lang == "rust" and tok[0] == "'" and tok[-1] != "'":
            out.append(tok)  # a lifetime stays code
        elif tok == "`" or tok.endswith(('"""', "'''")) and len(tok) <= 5 or lang == "rust" and tok[-1] == '"' and (len(tok) <= 2 or m["hash"] is not None):
            if tok == "`":
                state = "`raw" if lang == "go" else "`t"
            elif lang == "rust":
                state = f"r{len(m['hash'])}" if m["hash"] is not None else '"rust'
            else:
                state = tok[-3:]
            stop, state = _close(text, end, state)
            literal(start, stop, "template" if tok == "`" else "string")
            if state:
                return Scan("".join(out), comments, strings, state, error)
            end = stop
            carry = '"'
        elif len(tok) == 1:
            error = error or "unterminated literal"
            literal(start, end, "string")
        else:
            literal(start, end, "char" if tok[-1] == "'" and lang in ("go", "java", "rust", "c") else "string")
            carry = '"'
        last = pos = end
    gap = text[last:]
    out.append(gap)
    return Scan("".join(out), comments, strings, CODE, error, script and _divides(gap.rstrip() or carry))
