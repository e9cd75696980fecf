"""Which source files do not parse: bracket summaries of chunks, reduced associatively, then local grammars over balanced
groups.

A chunk is summarised by its token string in which every bracket pair that closes inside the chunk is folded into one role
character. As the state a chunk begins in is known only from the text before, its map holds such a summary, and the state
the chunk ends in, for each state of the lexer it may begin in. Two maps are joined by following the states and folding the
concatenated summaries, which gives the map of the concatenated text: joining is associative, so chunks may be reduced in
any grouping. A file is valid if, begun in CODE, it ends in CODE, nothing is left unfolded, and what is left matches the
language's file rule. Where a chunk ends in a state that maps don't hold, the verdict stays open and the file is scanned in order.
"""

from __future__ import annotations

import ast
import re
import warnings

from codeloom.llm.grammars import BASES, IDENT, NUMBER, ROLES, STRING, grammar
from codeloom.llm.lexing import CODE, DIVIDES, STATES, Scan, scan

#: Characters of a chunk; it changes how files are spread, not what is found.
CHUNK_CHARS = 1 << 16
#: Groups whose roles are kept per process; the cache starts anew beyond this.
CACHE_ENTRIES = 200_000

BAD = "\x01"
#: The end state of a text whose verdict is open.
OPEN = "?"
#: (state a text begins in) -> (state it ends in, its summary)
Map = dict[str, tuple[str, str]]
_OPEN = {")": "(", "]": "[", "}": "{"}
_SPLIT = re.compile(r"([()\[\]{}])")

_NUMBERS = {
    "javascript": r"0[xX][\da-fA-F]+(?:_[\da-fA-F]+)*n?|0[bB][01]+(?:_[01]+)*n?|0[oO]?[0-7]+(?:_[0-7]+)*n?|(?:\d+(?:_\d+)*)?\.?(?:\d+(?:_\d+)*)?(?:[eE][+-]?\d+)?n?",
    "go": r"0[xX][\da-fA-F_]*\.?[\da-fA-F_]*(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?i?",
    "java": r"0[xX][\da-fA-F_]*\.?[\da-fA-F_]*(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?[lLfFdD]?",
    "rust": r"(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+)(?:[ui](?:8|16|32|64|128|size))?|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[uif](?:8|16|32|64|128|size))?",
    "c": r"0[xX][\da-fA-F']*\.?[\da-fA-F]*(?:[pP][+-]?\d+)?[uUlLfF]*|0[bB][01']+[uUlL]*|[\d']*\.?[\d']*(?:[eE][+-]?\d+)?[uUlLfF]*",
}
_NUMBER_TOKEN = {lang: r"\.?\d(?:[eEpP][+-]|[\w.])*" for lang in _NUMBERS} | {
    "rust": r"0[xob]\w*|\d\w*(?:\.(?![.\w]|\Z)|\.\d(?:[eE][+-]|\w)*)?",
    "javascript": r"0[xXbBoO]\w*|\.?\d(?:[eE][+-]|[\w.])*",
    "c": r"0[xX](?:[pP][+-]|[\w.])*|\.?\d(?:[eE][+-]|[\w.])*",
}


class _Classes(dict):
    """Token text -> class character, filled as tokens are met."""

    def __init__(self, lang: str):
        g = grammar(lang)
        words = "javascript" if lang == "typescript" else lang
        super().__init__(g.operators | g.words | {b: b for b in "()[]{}"} | {"\n": "\n"})
        self.fixed = dict(self)
        self.number = re.compile(_NUMBERS[words])

    def __missing__(self, token: str) -> str:
        first = token[0]
        if first == "\x02":
            return STRING
        if first == "\x03":  # the rest of a literal that began in the chunk before
            return ""
        if first == "'" and len(token) > 1:
            return "l"
        if first.isdigit() or first == "." and len(token) > 1:
            kind = NUMBER if self.number.fullmatch(token) else BAD
        elif first.isalpha() or first in "_$#" or token.isidentifier():
            kind = IDENT
        else:
            kind = BAD
        if len(self) > CACHE_ENTRIES:
            self.clear()
            self.update(self.fixed)
        self[token] = kind
        return kind


#: Roles that are lists of independent statements or members. Such a content is tried in pieces, so that a piece met
#: before costs one look-up.
_LISTS = {"javascript": {"{B", "{C"}, "go": {"{B"}, "java": {"{B", "{C"}, "rust": {"{B", "{I"}, "c": {"{B"}}
#: Pieces that are joined before a list is matched as a whole.
_JOIN = 6
#: Words that carry a statement on behind a block.
_CARRY_ON = {"else", "catch", "finally", "while", "instanceof", "in", "as", "of", "from"}
#: What a content must hold to play a role by its grammar; with Grammar.foreign, what it must not hold, spares most matches that can't succeed.
_NEEDS = {
    "javascript": {"(F": "; of in", "{S": "case default"},
    "go": {"(D": "s i"},
    "java": {"(F": "; :", "{W": "case default"},
    "rust": {"{W": "=>"},
    "c": {"(F": ";"},
}


class Parser:
    """Summaries, reduction and verdicts of one language."""

    def __init__(self, lang: str):
        self.lang = lang
        words = "javascript" if lang == "typescript" else lang
        self.grammar = g = grammar(lang)
        self.classes = _Classes(lang)
        # Commonest alternatives first: names, then marks that begin no longer operator, then the rest.
        longer = [o for o in sorted(g.operators, key=len, reverse=True) if len(o) > 1]
        plain = "".join(re.escape(o) for o in g.operators if len(o) == 1 and not any(x[0] == o for x in longer) and o not in "'#$")
        mixed = "".join(re.escape(x) for x in sorted({o[0] for o in longer}))
        ops = f"(?=[{mixed}])(?:" + "|".join(re.escape(o) for o in longer) + ")"
        newline = r"\n" if words in ("javascript", "go") else ""
        ident = r"[#]?[^\W\d][\w$]*|\$[\w$]*" if words == "javascript" else r"r#[^\W\d]\w*|'[^\W\d]\w*|[^\W\d]\w*" if words == "rust" else r"[^\W\d][\w$]*" if words in ("java", "c") else r"[^\W\d]\w*"
        if words == "javascript":
            ident = r"#?(?:[^\W\d]|\$)[\w$]*"
        self.tokens = re.compile(rf"{ident}|[()\[\]{{}}{plain}{newline}]|{_NUMBER_TOKEN[words]}|{ops}|\x02\x03*|[^\s\x03]|\x03+")
        self.cache: dict[tuple[str, str], str] = {}
        self.pieces: dict[tuple[str, str], bool] = {}
        self.lists = _LISTS[words]

        def holding(named: dict[str, str], role: str) -> re.Pattern | None:
            return re.compile("[" + "".join(re.escape(g.char.get(w, w)) for w in named[role].split()) + "]") if role in named else None

        self.roles = {b: [(1 << k, b + r, holding(_NEEDS[words], b + r), g.foreign[b + r]) for k, r in enumerate(rs)] for b, rs in ROLES[words].items()}
        starts = "i" + "".join(v for w, v in g.words.items() if w not in _CARRY_ON)
        self.cuts = re.compile(f"(?<=[{g.char[';']}L])" + ("" if words == "go" else f"|(?<=[{chr(BASES['{'])}-{chr(0xE8FF)}])(?=[{starts}])"))
        group = f"{chr(BASES['('])}-{chr(0xE8FF)}"
        comma = g.char[","]
        self.signed = comma + g.char["-"] + NUMBER, comma + NUMBER
        self.runs = re.compile(f"([ins{group}]{comma}\n?)\\1{{2,}}")
        c = g.char
        if words == "javascript":
            end = "ins" + group + "".join(c[w] for w in "this super null true false return break continue debugger void of as from ++ --".split() if w in c)
            stop = {"in", "instanceof", "of", "as", "extends", "implements", "from", "catch", "finally", "satisfies", "is"}
            start = "ins" + "".join(v for w, v in g.words.items() if w not in stop) + "".join(c[o] for o in ("@", "#", "!", "~", "++", "--"))
            self._break = (re.compile(f"(?<=[{re.escape(end).replace(chr(92) + '-', '-')}])\n+(?=[{start}])"), "L")
        elif words == "go":
            end = "ins" + group + "".join(c[w] for w in "break continue fallthrough return ++ --".split())
            self._break = (re.compile(f"(?<=[{end}])\n+"), c[";"])
        else:
            self._break = None

    def summarise(self, text: str, entry: str = CODE) -> tuple[str, str]:
        """The state that ``text`` ends in and its folded token string; BAD in the string marks an error."""
        s = scan(text, self.lang, entry)
        return s.exit, self.fold_masked(s.masked) + (BAD if s.error or self.lang == "go" and "\0" in text else "")

    def fold_masked(self, masked: str) -> str:
        return self.fold("".join(map(self.classes.__getitem__, self.tokens.findall(masked))))

    def breaks(self, content: str) -> str:
        if self._break and "\n" in content:
            pattern, mark = self._break
            return pattern.sub(mark, content).replace("\n", "")
        return content

    def role(self, opener: str, content: str) -> str:
        if len(content) > 24:  # a long run of equal elements is a list just as two of them are; so is one of numbers with signs
            content = self.runs.sub(r"\1\1", content.replace(*self.signed))
        key = (opener, content)
        found = self.cache.get(key)
        if found is None:
            flat = self.breaks(content)
            bits = 0
            if BAD not in flat:
                for bit, name, needs, foreign in self.roles[opener]:
                    if flat and needs and not needs.search(flat) or foreign and foreign.search(flat):
                        continue
                    if name in self.lists and self.matches_list(name, flat) or self.grammar.roles[name].fullmatch(flat):
                        bits |= bit
            found = chr(BASES[opener] + bits) if bits else BAD
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            self.cache[key] = found
        return found

    def matches_list(self, name: str, flat: str) -> bool:
        """Whether ``flat`` is a concatenation of pieces that are lists of the role ``name``, hence such a list itself."""
        pattern = self.grammar.roles.get(name, self.grammar.file)
        parts = self.cuts.split(flat)
        known = self.pieces
        held, count = "", 0
        for part in parts:
            held += part
            count += 1
            ok = known.get((name, held))
            if ok is None:
                if len(known) > CACHE_ENTRIES:
                    known.clear()
                ok = known[name, held] = pattern.fullmatch(held) is not None
            if ok:
                held, count = "", 0
            elif count == _JOIN:
                return False
        return not held

    def fold(self, tokens: str) -> str:
        """Replaces every closed group by its role character; unmatched brackets stay where they are."""
        parts = _SPLIT.split(tokens)
        stack: list[tuple[list[str], str]] = []
        current: list[str] = []
        done: list[str] = []
        for k in range(0, len(parts) - 1, 2):
            if parts[k]:
                current.append(parts[k])
            bracket = parts[k + 1]
            if bracket in "([{":
                stack.append((current, bracket))
                current = []
            elif not stack:
                done += current
                done.append(bracket)
                current = []
            else:
                outer, opener = stack.pop()
                if opener != _OPEN[bracket]:
                    return BAD
                outer.append(self.role(opener, "".join(current)))
                current = outer
        current.append(parts[-1])
        for outer, opener in stack:
            done += outer
            done.append(opener)
        return "".join(done + current)

    def valid(self, state: str, folded: str) -> bool:
        if state.rstrip(DIVIDES) != CODE or BAD in folded or _SPLIT.search(folded):
            return False
        flat = self.breaks(folded + "\n" if self.lang == "go" else folded)
        if self.lang in ("go", "java"):
            return self.grammar.file.fullmatch(flat) is not None
        return self.matches_list("file", flat) or self.grammar.file.fullmatch(flat) is not None


_PARSERS: dict[str, Parser] = {}


def parser(lang: str) -> Parser:
    if lang not in _PARSERS:
        _PARSERS[lang] = Parser(lang)
    return _PARSERS[lang]


def python_parses(text: str) -> bool:
    """CPython's own grammar; a text nested too deep for it counts as valid."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "<file>", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except (SyntaxError, ValueError):
        return False
    except (RecursionError, MemoryError):
        return True
    return True


def chunks(code: str, size: int = CHUNK_CHARS) -> list[str]:
    """Cuts behind line ends that no backslash continues; a line longer than ``size`` stays whole. A byte order mark at the start is dropped."""
    text = code[1:] if code[:1] == "\ufeff" else code
    if len(text) <= size:
        return [text]
    out, pos = [], 0
    while pos < len(text):
        end = text.find("\n", min(pos + size, len(text)) - 1)
        while end > 0 and text[max(0, end - 2) : end].endswith(("\\", "\\\r")):
            end = text.find("\n", end + 1)
        end = len(text) if end < 0 else end + 1
        out.append(text[pos:end])
        pos = end
    return out


#: A script that begins with a slash, or holds no code, in which the state before decides more than where it began.
_SLASH_FIRST = re.compile(r"(?:\s|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))*(?:/|\Z)")


def state_map(lang: str, text: str, first: bool) -> Map:
    """The map of a chunk; the first chunk of a file begins in CODE."""
    p = parser(lang)
    out = {CODE: p.summarise(text)}
    for entry in [] if first else STATES[lang][1:]:
        out[entry] = out[CODE] if entry == DIVIDES and not _SLASH_FIRST.match(text) else p.summarise(text, entry)
    return out


def join_maps(lang: str, a: Map, b: Map) -> Map:
    """The map of two adjoining texts; associative. An entry whose state ``b`` doesn't hold is left open."""
    p = parser(lang)
    out = {}
    for entry, (state, left) in a.items():
        end, right = b.get(state, (OPEN, ""))
        out[entry] = (end, "") if end == OPEN else (end, p.fold(left + right))
    return out


def reduce_maps(lang: str, maps: list[Map]) -> Map:
    """The map of adjoining texts from theirs, in order."""
    total = maps[0]
    for m in maps[1:]:
        total = join_maps(lang, total, m)
    return total


def verdict(lang: str, whole: Map) -> bool | None:
    """Whether the file with this map is valid; None if that is open."""
    state, folded = whole[CODE]
    return None if state == OPEN else parser(lang).valid(state, folded)


def scan_parses(lang: str, text: str, s: Scan) -> bool:
    """The verdict on a whole text that is scanned already, which is that of its map as one chunk; not for Python."""
    if lang == "go" and "\0" in text or s.error or s.state:
        return False
    p = parser(lang)
    return p.valid(s.state, p.fold_masked(s.masked))


def parses(lang: str, code: str) -> bool:
    """Whether a whole file is valid in its language, scanned in order."""
    text = code[1:] if code[:1] == "\ufeff" else code
    return python_parses(text) if lang == "python" else scan_parses(lang, text, scan(text, lang))
