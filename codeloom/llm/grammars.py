"""Local grammars: what one balanced group, or the outermost level of a file, may hold in each language.

A token is one character; a nested group is one character too, which carries the set of roles its own content can play
(a block, an object literal, a parameter list ...). So every grammar here is flat, works bottom-up, and can be cached by
content. Tokens are written in backquotes, sub-rules in <angle brackets>, roles as {role}; white space counts nothing.
"""

from __future__ import annotations

import re

import regex

#: The reserved and contextual words of each language that the grammars name.
WORDS = {
    "javascript": "async await break case catch class const continue debugger default delete do else export extends false finally for from function get if import in instanceof let new null of return set static super switch this throw true try typeof var void while with yield as "
    "abstract accessor asserts declare enum implements infer interface is keyof module namespace override private protected public readonly satisfies type unique",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class continue default do double else enum extends false final finally float for if implements import instanceof int interface long native new null package private protected public record return sealed permits short static strictfp super switch synchronized this throw throws transient true try var void volatile while yield non",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while macro_rules",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Alignof _Alignas _Static_assert _Noreturn _Thread_local _Atomic _Generic",
}
#: Operators, longest first.
OPERATORS = {
    "javascript": "... >= <= === !== == != => ** ++ -- && || ?? ?. **= += -= *= /= %= &&= ||= ??= &= |= ^= << <<= + - * / % & | ^ ! ~ ? : = < > . , ; @ #",
    "go": "... &^= <<= >>= && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ < > = ! ~ . , ; :",
    "java": "... -> :: >= <= == != && || ++ -- += -= *= /= %= &= |= ^= <<= << + - * / % & | ^ ! ~ ? : = < > . , ; @",
    "rust": "..= ... .. -> => :: == != <= >= && || += -= *= /= %= ^= &= |= <<= << + - * / % ^ & | ! = < > @ . , ; : # $ ? ~ '",
    "c": "... -> ++ -- <<= >>= << >> <= >= == != && || += -= *= /= %= &= |= ^= + - * / % & | ^ ! ~ ? : = < > . , ; #",
}

#: Roles by bracket. A group character is base + bit set of roles.
ROLES = {
    "javascript": {"(": ["E", "A", "P", "F", "T"], "[": ["L", "K"], "{": ["B", "O", "C", "S", "I", "Y", "N"]},
    "go": {"(": ["A", "P", "D", "X"], "[": ["K", "M"], "{": ["B", "V", "S", "I", "W"]},
    "java": {"(": ["E", "A", "P", "F", "R", "T", "X"], "[": ["K", "Z"], "{": ["B", "V", "C", "W", "N"]},
    "rust": {"(": ["A", "P", "T", "M"], "[": ["A", "T", "M"], "{": ["B", "V", "S", "N", "I", "W", "U", "M"]},
    "c": {"(": ["E", "A", "P", "F", "T", "R"], "[": ["K"], "{": ["B", "V", "S", "N"]},
}
BASES = {"(": 0xE400, "[": 0xE600, "{": 0xE800}

IDENT, NUMBER, STRING, NEWLINE, BREAK, LIFETIME = "i", "n", "s", "\n", "L", "l"


_BRACKETS = re.compile(r"`[^`]+`|\{[(\[{]\w\}|\[[^\]]*\]|\(\?<?[=!]|[()]")


def _without_lookaround(text: str) -> str:
    """A rule's text without its lookarounds, which take nothing in."""
    out, pos, depth, inside = [], 0, 0, 0
    for m in _BRACKETS.finditer(text):
        if m[0][0] == "(":
            depth += 1
            if len(m[0]) > 1 and not inside:
                out.append(text[pos : m.start()])
                inside = depth
        elif m[0] == ")":
            if depth == inside:
                pos, inside = m.end(), 0
            depth -= 1
    return "".join(out) + text[pos:]


class Grammar:
    """The compiled grammar of one language: token characters and a pattern for each role."""

    def __init__(self, lang: str, rules: dict[str, str], roles: dict[str, str], file: str):
        names = [*dict.fromkeys(OPERATORS[lang].split())]
        self.char = {t: t for t in (IDENT, NUMBER, STRING, BREAK, LIFETIME)}
        self.char |= {t: chr(0xE000 + k) for k, t in enumerate(WORDS[lang].split())}
        self.words = {t: self.char[t] for t in WORDS[lang].split()}
        self.operators = {t: chr(0xE200 + k) for k, t in enumerate(names)}
        self.char |= self.operators
        self.role_bits = {(b, r): 1 << k for b, rs in ROLES[lang].items() for k, r in enumerate(rs)}
        self.all_words = f"[i{chr(0xE000)}-{chr(0xE0FF)}]"
        self.groups = f"[{chr(0xE400)}-{chr(0xE8FF)}]"
        define = "(?(DEFINE)" + "".join(f"(?P<{n}>{self._compile(p, lang)})" for n, p in rules.items()) + ")"
        self.roles = {k: regex.compile(f"{define}(?:{self._compile(p, lang)})") for k, p in roles.items()}
        self.file = regex.compile(f"{define}(?:{self._compile(file, lang)})")
        self.foreign = {k: self._foreign(p, rules) for k, p in roles.items()}

    def _foreign(self, rule: str, rules: dict[str, str]) -> re.Pattern | None:
        """Finds a character that no alternative of ``rule`` takes in, so that content with one can't match; None if all are taken."""
        chars: set[str] = set()
        seen: set[str] = set()
        todo = [rule]
        while todo:
            text = _without_lookaround(todo.pop())
            if "\\s\\S" in text:
                return None
            chars.update(*(self.char[t] for ts in re.findall(r"`([^`]+)`", text) for t in ts.split()))
            text = re.sub(r"`[^`]+`", "", text)
            chars.update(*(self._role_class(b, r)[1:-1] for b, r in re.findall(r"\{([(\[{])(\w)\}", text)))
            names = set(re.findall(r"<(\w+)>", text))
            chars.update(*([IDENT, *self.words.values()] if "ANY" in names else []), *(map(chr, range(0xE400, 0xE900)) if "GROUP" in names else []))
            todo += [rules[n] for n in names - seen - {"ANY", "GROUP"}]
            seen |= names
        return re.compile("[^" + "".join(re.escape(c) for c in sorted(chars)) + "]" if chars else r"[\s\S]")

    def _role_class(self, bracket: str, role: str) -> str:
        bit = self.role_bits[bracket, role]
        size = 1 << sum(1 for b, _ in self.role_bits if b == bracket)
        return "[" + "".join(chr(BASES[bracket] + m) for m in range(size) if m & bit) + "]"

    def _compile(self, text: str, lang: str) -> str:
        def tok(m):
            alternatives = m[1].split()
            if len(alternatives) == 1:
                return regex.escape(self.char[alternatives[0]], special_only=True)
            return "[" + "".join(regex.escape(self.char[a], special_only=True) for a in alternatives) + "]"

        text = regex.sub(r"\s+(?=(?:[^`]*`[^`]*`)*[^`]*$)", "", text)
        text = regex.sub(r"\{([(\[{])(\w)\}", lambda m: self._role_class(m[1], m[2]), text)
        text = text.replace("<ANY>", self.all_words).replace("<GROUP>", self.groups)
        text = regex.sub(r"<(\w+)>", r"(?&\1)", text)
        return regex.sub(r"`([^`]+)`", tok, text)


# JavaScript and TypeScript ---------------------------------------------------------------------------------------
_JS = {
    "id": "`i async as from get of set static let type abstract accessor asserts declare infer is keyof module namespace override private protected public readonly satisfies unique await yield`",
    "name": "<ANY>|`s n`|{[L}",
    "arrow": "`async`?(?:<id>|{(P})`=>`(?:{{B}|<e>)",
    "prim": "(?:<arrow>|`async`?`function``*`?<id>?{(P}{{B}|`class`<id>?(?:`extends`<post_e>)?{{C}|`new``.`<ANY>|`new`<newt>{(A}?|`import`(?:{(A}|`.`<ANY>)|`super this null true false n s`|{(E}|{[L}|{{O}|<id>)",
    "newt": "(?:`new`<newt>{(A}?|{(E}|`this super`|`function`<id>?{(P}{{B}|`class`<id>?{{C}|<id>)(?:`. ?.`<ANY>|{[L})*+",
    "suffix": "(?:`. ?.`<ANY>|`?.`(?:{(A}|{[L})|{(A}|{[L}|`s`|`++ --`)",
    "post_e": "<prim><suffix>*+",
    "un": "`! ~ + - ++ -- typeof void delete await yield`|`yield``*`",
    "binop": "`+ - * / % ** << & | ^ && || ?? == === != !== < <= >= instanceof in = += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=`|`>`{1,3}`>=`?",
    "b": "(?:<un>)*+<post_e>(?:(?:<binop>)(?:<un>)*+<post_e>)*+",
    "e": "(?:`yield`(?=[,;L)]|$)|<b>(?:`?`<e>`:`<e>)?+)",
    "es": "<e>(?:`,`<e>)*+",
    "T": "(?:`; L`|$)",
    "target": "(?:<id>|{{O}|{[L})",
    "decl": "<target>(?:`=`<e>)?+",
    "lex": "(?:`var let`<decl>(?:`,`<decl>)*+|`const`<target>`=`<e>(?:`,`<target>`=`<e>)*+)",
    "cls": "`class`<id>?(?:`extends`<post_e>)?{{C}",
    "fn": "`async`?`function``*`?<id>{(P}{{B}",
    "mod": "`import`(?:<T>(?!)|`s`<T>|(?:<id>|`*``as`<id>|{{I})(?:`,`(?:`*``as`<id>|{{I}))?`from``s`(?:`with`{{O})?<T>)|`export`(?:`default`(?:(?:`async`?`function``*`?<id>?{(P}{{B}|<deco>*`class`<id>?(?:`extends`<post_e>)?{{C})|<e><T>)|`*`(?:`as`<ANY>)?`from``s`<T>|{{I}(?:`from``s`)?<T>|(?:<lex><T>|<fn>|<deco>*<cls>))",
    "deco": "`@`(?:<id>(?:`.`<ANY>)*+{(A}?|{(E})`L`?",
    "st": "(?>`L`*+(?:`;`|{{B}`;`?|<mod>|<lex><T>|<fn>|<deco>*<cls>|`if`{(E}<st>`L`?(?:`else`<st>)?+|`for``await`?{(F}<st>|`while`{(E}<st>|`do`<st>`L`?`while`{(E}<T>?|`return`<es>?<T>|`break continue`<id>?<T>|`throw`<es><T>|`debugger`<T>|`try`{{B}`L`?(?:`catch`{(P}?{{B}`L`?(?:`finally`{{B})?+|`finally`{{B})|`switch`{(E}{{S}|`with`{(E}<st>|<id>`:`<st>|<es><T>))",
    "prop": "(?:`...`<e>|(?:`async get set`|`*`|`async``*`)?(?:<name>){(P}{{B}|(?:<name>)`:`<e>|<id>(?:`=`<e>)?+)",
    "param": "`...`?<target>(?:`=`<e>)?+",
    "member": "`L`*+(?:`;`|`static`{{B}|<deco>*+(?:`static`(?![(=;L]|<GROUP>))?(?:(?:`async`?`*`?|`get set`)(?:<name>){(P}{{B}|(?:<name>)(?:`=`<e>)?+<T>))",
}
_JS_ROLES = {
    "(E": "<es>",
    "(A": "(?:(?:`...`?<e>)(?:`,``...`?<e>)*+`,`?)?",
    "(P": "(?:<param>(?:`,`<param>)*+`,`?)?",
    "(F": "(?:(?:`var let const`<decl>(?:`,`<decl>)*+|<es>)?`;`<es>?`;`<es>?|(?:`var let const`)?(?:<target>|<post_e>)`of`<e>|(?:`var let const`)?(?:<target>|<post_e>)`in`<es>)",
    "(T": "(?!)",
    "[L": "(?:`,`|(?:`...`?<e>)(?:`,`|$))*+",
    "[K": "(?!)",
    "{B": "<st>*+`L`*",
    "{O": "(?:<prop>(?:`,`<prop>)*+`,`?)?",
    "{C": "(?><member>)*+`L`*",
    "{S": "(?>`L`*(?:`case`<es>|`default`)`:`<st>*+)*+`L`*",
    "{I": "(?:`type`?(?:<ANY>|`s`)(?:`as`(?:<ANY>|`s`))?(?:`,`|$))*+",
    "{Y": "(?!)",
    "{N": "(?!)",
}
_TS = _JS | {
    "ret": "`:`(?:`asserts`?(?:<id>|`this`)(?:`is`<type>)?+(?=<GROUP>|[;L{]|`=> ; L , =`|$)|<type>)",
    "gen": "`<`(?:`const`?<id>(?:`extends`<type>)?+(?:`=`<type>)?+(?:`,`|(?=`>`)))+`>`",
    "targs": "`<`<type>(?:`,`<type>)*+`>`",
    "tname": "<id>(?:`.`<ANY>)*+<targs>?+",
    "tatom": "(?:`typeof`(?:`import`{(A}|<id>|`this`)(?:`.`<ANY>)*+<targs>?+|`import`{(A}(?:`.`<ANY>)*+<targs>?+|`-`?`n`|`s`|`void null this true false`|`unique``i`|<gen>?{(P}`=>`(?:<ret1>|<type>)|`abstract`?`new`<gen>?{(P}`=>`<type>|{(T}|{{Y}|{[K}|{{O}(?!)|<tname>)(?:{[K})*+",
    "ret1": "`asserts`?(?:<id>|`this`)`is`<type>",
    "tpre": "(?:`keyof readonly infer`(?=<id>|<GROUP>|`typeof`))*+<tatom>",
    "tu": "`| &`?<tpre>(?:`| &`<tpre>)*+",
    "type": "<tu>(?:`extends`<tu>`?`<type>`:`<type>)?+",
    "arrow": "`async`?<gen>?(?:{(P}<ret>?|<id>)`=>`(?:{{B}|<e>)",
    "prim": "(?:<arrow>|`async`?`function``*`?<id>?<gen>?{(P}<ret>?{{B}|`class`<id>?<gen>?<herit>{{C}|`new``.`<ANY>|`new`<newt><targs>?{(A}?|`import`(?:{(A}|`.`<ANY>)|`super this null true false n s`|{(E}|{[L}|{{O}|<id>)",
    "herit": "(?:`extends`<post_e>(?:<targs>)?)?(?:`implements`<type>(?:`,`<type>)*+)?",
    "suffix": "(?:`. ?.`<ANY>|`?.`(?:{(A}|{[L})|<targs>(?=<GROUP>|`s`){(A}|<targs>`s`|{(A}|{[L}|`s`|`++ --`|`!`(?!`=`)|`as satisfies`(?:`const`|<type>))",
    "decl": "<target>`!`?(?:`:`<type>)?+(?:`=`<e>)?+",
    "lex": "`var let const`<decl>(?:`,`<decl>)*+",
    "cls": "`declare`?`abstract`?`class`<id>?<gen>?<herit>{{C}",
    "fn": "`declare`?`async`?`function``*`?<id><gen>?{(P}<ret>?(?:{{B}|<T>)",
    "iface": "`interface`<id><gen>?(?:`extends`<tname>(?:`,`<tname>)*+)?{{Y}|`type`<id><gen>?`=`<type><T>|`const`?`enum`<id>{{N}|(?:`namespace module`)(?:<id>(?:`.`<id>)*|`s`)(?:{{B}|<T>)|`abstract``class`<id><gen>?<herit>{{C}",
    "mod": "`import`(?:`s`<T>|`type`?(?:<id>|`*``as`<id>|{{I})(?:`,`(?:`*``as`<id>|{{I}))?`from``s`(?:`with`{{O})?<T>|`type`?<id>`=`<es><T>)|`export`(?:`default`(?:(?:`async`?`function``*`?<id>?<gen>?{(P}<ret>?(?:{{B}|<T>)|<deco>*`abstract`?`class`<id>?<gen>?<herit>{{C}|`interface`<id><gen>?{{Y})|<e><T>)|`=`<es><T>|`as``namespace`<id><T>|`type`?`*`(?:`as`<ANY>)?`from``s`<T>|`type`?{{I}(?:`from``s`)?<T>|`declare`?(?:<iface>|`var let const`<decl>(?:`,`<decl>)*+<T>|<fn>|<deco>*<cls>))|`declare`(?:<iface>|`var let const`<decl>(?:`,`<decl>)*+<T>|<fn>|<cls>|`module namespace i`(?:<id>|`s`)?{{B})|<iface>",
    "prop": "(?:`...`<e>|(?:`async get set`|`*`|`async``*`)?(?:<name>)<gen>?{(P}<ret>?{{B}|(?:<name>)`:`<e>|<id>(?:`=`<e>)?+)",
    "mods": "(?:`public private protected static readonly abstract override declare accessor`(?=<ANY>|`s n * #`|<GROUP>)(?!{(P}))*",
    "param": "<deco>*+(?:`public private protected readonly override`(?=<id>))*`...`?(?:<target>|`this`)`?`?(?:`:`<type>)?+(?:`=`<e>)?+",
    "member": "`L`*+(?:`;`|`static`{{B}|<mods>{[K}`:`<type><T>|<deco>*+<mods>(?:(?:`async`?`*`?|`get set`)(?:<name>)`?`?<gen>?{(P}<ret>?(?:{{B}|<T>)|(?:<name>)(?:`? !`)?(?:`:`<type>)?+(?:`=`<e>)?+<T>))",
    "tmember": "(?:(?:`readonly -`|`+`)*(?:{[K}(?:`- +`?`?`)?(?:`:`<type>)?+|(?:`get set`)?(?:<name>)`?`?(?:<gen>?{(P}<ret>?|(?:`:`<type>)?+)|`new`?<gen>?{(P}<ret>?))",
}
_TS_ROLES = _JS_ROLES | {
    "(T": "<type>",
    "[K": "(?:`readonly`?(?:`...`?(?:<id>`?`?`:`)?<type>`?`?)(?:`,`|$))*+|<id>`:`<type>|<id>`in`<type>(?:`as`<type>)?",
    "{Y": "(?>`L`*<tmember>(?:`, ; L`+|$))*+`L`*",
    "{N": "(?:(?:<name>)(?:`=`<e>)?+(?:`,`|$))*+",
}

# Go --------------------------------------------------------------------------------------------------------------
_GO = {
    "qual": "`i`(?:`.``i`)?(?:{[K})?",
    "type": "(?:`*`<type>|{[K}<type>|`map`{[M}<type>|`<-`?`chan``<-`?<type>|`func`{(P}(?:<result>)?+|`struct`{{S}|`interface`{{I}|`i`(?:`.``i`)?(?:{[K}(?!`i *`|{(P}))?|{(P})",
    "result": "(?:{(P}|<type>)",
    "lit": "(?:{[K}<type>|`map`{[M}<type>|`struct`{{S}){{V}",
    "prim": "(?:`n s`|`func`{(P}(?:<result>)?+{{B}|<lit>|(?:{[K}<type>|`map`{[M}<type>|`chan`<type>|`interface`{{I}|`struct`{{S}){(A}?|`i`|{(A})",
    "suf": "(?:`.``i`|`.`{(X}|{(A}|{[K})",
    "comp": "(?:`i`(?:`.``i`)?(?:{[K})?{{V}|<prim>)",
    "un": "(?:`+ - ! ^ * & <-`)*+",
    "op": "`&& || == != < <= > >= + - | ^ * / % << >> & &^`",
    "u": "<un><comp>(?:<suf>)*+",
    "e": "<u>(?:<op><u>)*+",
    "un0": "<un><prim>(?:<suf>)*+",
    "e0": "<un0>(?:<op><un0>)*+",
    "es": "<e>(?:`,`<e>)*+",
    "es0": "<e0>(?:`,`<e0>)*+",
    "simple": "<es>(?:`:= = += -= *= /= %= &= |= ^= <<= >>= &^=`(?:`range`<e>|<es>)|`++ --`|`<-`<e>)?+",
    "simple0": "<es0>(?:`:= = += -= *= /= %= &= |= ^= <<= >>= &^=`(?:`range`<e0>|<es0>)|`++ --`|`<-`<e0>)?+",
    "spec": "`i`(?:`,``i`)*+<type>?+(?:`=`<es>)?+",
    "tspec": "`i`(?:{[K}(?=`i * struct interface func map`|<GROUP>))?`=`?<type>",
    "decl": "`var const`(?:<spec>|{(D})|`type`(?:<tspec>|{(D})",
    "if": "`if`(?:<simple0>?`;`)?(?:<e0>){{B}(?:`else`(?:<if>|{{B}))?+",
    "for": "`for`(?:<simple0>?`;`<e0>?`;`<simple0>?|`range`<e0>|<simple0>)?{{B}",
    "stm": "(?:{{B}|<if>|<for>|`switch`(?:<simple0>?`;`)?(?:<simple0>)?{{W}|`select`{{W}|`go defer`<e>|`return`<es>?|`break continue`(?:`i`)?|`goto``i`|`fallthrough`|<decl>|`i``:`(?:`;`?<stm>)?|<simple>)",
    "list": "(?>`;`|<stm>(?:`;`|$))*+",
    "param": "(?:(?:`i`(?:`,``i`)*`...`?)?<type>|`...`<type>)",
    "imp": "(?:`i .`)?`s`",
    "top": "(?:`import`(?:<imp>|{(D})|<decl>|`func`(?:{(P})?`i`(?:{[K})?{(P}(?:<result>)?+(?:{{B})?)",
}
_GO_ROLES = {
    "(A": "(?:(?:<e>|<type>)`...`?(?:`,`|$)|`;`)*+",
    "(X": "`type`|<type>",
    "(P": "(?:(?:<param>)(?:`,`|$)|`;`)*+",
    "(D": "(?:`;`|(?:<imp>|<tspec>|<spec>)(?:`;`|$))*+",
    "[M": "<type>",
    "[K": "(?:`...`|(?:<e>)?`:`(?:<e>)?(?:`:`<e>)?|(?:(?:`i`(?:`,``i`)*)?(?:`~`?<type>)(?:`|``~`?<type>)*(?:`,`|$))+|(?:<e>|<type>)(?:`,`(?:<e>|<type>))*`,`?)?",
    "{B": "<list>",
    "{V": "(?:(?:(?:<e>|{{V})(?:`:`(?:<e>|{{V}))?)(?:`,`|$))*+`;`?",
    "{S": "(?:`;`|(?:`i`(?:`,``i`)*<type>|`*`?<qual>)`s`?(?:`;`|$))*+",
    "{I": "(?:`;`|(?:`i`{(P}(?:<result>)?+|(?:`~`?<type>)(?:`|``~`?<type>)*)(?:`;`|$))*+",
    "{W": "(?>`;`*(?:`case`(?:(?:<type>|<e>)(?:`,`(?:<type>|<e>))*+(?=`:`)|<simple>)|`default`)`:`<list>)*+",
}

# Java ------------------------------------------------------------------------------------------------------------
_JAVA = {
    "id": "`i record sealed permits var yield non`",
    "basic": "`int long short byte char boolean float double`",
    "ann": "`@`<id>(?:`.`<id>)*+{(A}?+",
    "qn": "<id><targs>?+(?:`.`<ann>*+<id><targs>?+)*+",
    "targs": "`<`(?:<targ>(?:`,`<targ>)*+)?`>`",
    "targ": "<ann>*+(?:`?`(?:`extends super`<type>(?:`&`<type>)*)?|<type>)",
    "type": "<ann>*+(?:<basic>|<qn>)(?:<ann>*+{[Z})*+",
    "tparams": "`<`<ann>*<id>(?:`extends`<type>(?:`&`<type>)*)?(?:`,`<ann>*<id>(?:`extends`<type>(?:`&`<type>)*)?)*`>`",
    "mods": "(?:`public private protected static final abstract native synchronized transient volatile strictfp default`|`sealed`(?=`class interface abstract public static`)|`non``-``sealed`|<ann>(?!`interface`))*",
    "lambda": "(?:<id>|{(P}|{(X})`->`(?:{{B}|<e>)",
    "cast": "{(T}(?=`i n s ! ~ this super new true false null record var yield switch int long short byte char boolean float double`|{(E}|{(P}|{(X}|{(T})",
    "prim": "(?:<lambda>|`switch`{(E}{{W}|`new`<ann>*(?:<targs>)?(?:<basic>|<qn>)(?:{[K}+{[Z}*|{[Z}+{{V}|{(A}{{C}?)|(?:<basic>|<qn>){[Z}*`::`(?:`new`|<id>)|(?:<basic>|`void`){[Z}*`.``class`|<qn>{[Z}+`.``class`|`this super null true false n s`|{(E}|<id>)",
    "suf": "(?:`.`(?:`new`<id><targs>?{(A}{{C}?|<targs>?(?:<id>|`this super class`))|{(A}|{[K}|`::`(?:`new`|<targs>?<id>)|`++ --`)",
    "u": "(?:`+ - ! ~ ++ --`|<cast>)*<prim>(?:<suf>)*+",
    "op": "`+ - * / % & | ^ && || == != < <= >= = += -= *= /= %= &= |= ^= <<= <<`|`>`{1,3}`>=`?",
    "pat": "`final`?<type>(?:{(R}<id>?|<id>)(?:`&&`<e>)?|<type>",
    "b": "<u>(?:<op><u>|`instanceof`<pat>)*+",
    "e": "<b>(?:`?`<e>`:`<e>)?+",
    "es": "<e>(?:`,`<e>)*+",
    "var": "<id>{[Z}*(?:`=`(?:<e>|{{V}))?+",
    "local": "(?:`final`|<ann>)*<type><var>(?:`,`<var>)*+",
    "type_decl": "<mods>(?:`class`<id><tparams>?(?:`extends`<type>)?(?:`implements`<type>(?:`,`<type>)*+)?(?:`permits`<qn>(?:`,`<qn>)*+)?{{C}|`interface`<id><tparams>?(?:`extends`<type>(?:`,`<type>)*+)?(?:`permits`<qn>(?:`,`<qn>)*+)?{{C}|`enum`<id>(?:`implements`<type>(?:`,`<type>)*+)?{{N}|`record`<id><tparams>?{(P}(?:`implements`<type>(?:`,`<type>)*+)?{{C}|`@``interface`<id>{{C})",
    "st": "(?>`;`|{{B}|<type_decl>|`if`{(E}<st>(?:`else`<st>)?+|`for`{(F}<st>|`while`{(E}<st>|`do`<st>`while`{(E}`;`|`return`<e>?`;`|`break continue`<id>?`;`|`throw`<e>`;`|`yield`<e>`;`|`assert`<e>(?:`:`<e>)?`;`|`synchronized`{(E}{{B}|`try`(?:{{B}(?:`catch`{(X}{{B})*+(?:`finally`{{B})?|{(R}{{B}(?:`catch`{(X}{{B})*+(?:`finally`{{B})?)|`switch`{(E}{{W}|<id>`:`<st>|<local>`;`|(?!(?:{(E}|`i n s this`)`;`)<e>`;`)",
    "param": "(?:`final`|<ann>)*(?:<type>(?:<ann>*`...`)?(?:<id>`.`)?(?:<id>|`this`){[Z}*)",
    "member": "(?>`;`|`static`?{{B}|<type_decl>|<mods><tparams>?<ann>*(?:(?:`void`|<type>)?<id>{(P}{[Z}*(?:`throws`<type>(?:`,`<type>)*+)?(?:{{B}|`default`(?:<e>|{{V}|<ann>)`;`|`;`)|<id>{{B})|<mods><type><var>(?:`,`<var>)*+`;`)",
}
_JAVA_ROLES = {
    "(E": "<e>",
    "(A": "(?:(?:<e>|<ann>|{{V}|<id>`=`(?:{{V}|<ann>))(?:`,`(?:<e>|<ann>|{{V}|<id>`=`(?:{{V}|<ann>)))*+)?",
    "(P": "(?:<param>(?:`,`<param>)*+)?",
    "(X": "<id>(?:`,`<id>)*+|(?:`final`|<ann>)*<type>(?:`|`<type>)*+<id>",
    "(F": "(?:<local>|<es>)?`;`<e>?`;`<es>?|(?:`final`|<ann>)*<type><id>`:`<e>",
    "(R": "(?:(?:<local>|<e>)(?:`;`|$))+|(?:<pat>(?:`,`<pat>)*+)?",
    "(T": "<type>(?:`&`<type>)*+",
    "[K": "<e>",
    "[Z": "",
    "{B": "<st>*+",
    "{V": "(?:(?:<e>|{{V}|<ann>)(?:`,`(?:<e>|{{V}|<ann>))*+`,`?)?|`,`",
    "{C": "<member>*+",
    "{W": "(?>(?:`case`(?:<clabel>)(?:`,`(?:<clabel>))*+(?:`i`<e>)?|`default`)(?:`:`<st>*+|`->`(?:{{B}|`throw`<e>`;`|<e>`;`)))*+",
    "{N": "(?:<ann>*<id>{(A}?{{C}?(?:`,`|(?=`;`|$)))*+(?:`;`<member>*+)?",
}
_JAVA["clabel"] = "`null`|`default`|<e>(?!`i`|{(R})|<pat>"

# Rust ------------------------------------------------------------------------------------------------------------
_RUST = {
    "id": "`i union macro_rules`",
    "seg": "`i union self Self super crate`",
    "attr": "`#``!`?{[M}",
    "gargs": "`<`(?:(?:`l`|`n s`|`-``n`|{{B}|<id><gargs0>?`=`<type>|<type>(?:`:`<bounds>)?)(?:`,`|(?=`>`)))*+`>`",
    "gargs0": "`<`(?:(?:`l`|<type>)(?:`,`|(?=`>`)))*+`>`",
    "path": "`::`?<seg>(?:`::``<`?(?!)|`::`(?:<seg>|<gargs>))*+",
    "tpath": "(?:`<`<type>(?:`as`<tpath>)?`>``::`)?`::`?<seg>(?:(?:`::`)?<gargs>|{(T}(?:`->`<type>)?)?+(?:`::`<seg>(?:(?:`::`)?<gargs>|{(T}(?:`->`<type>)?)?+)*+",
    "bound": "`?`?`~`?(?:`l`|`for`<gparams><tpath>|<tpath>|{(T})",
    "bounds": "(?:<bound>(?:`+`<bound>)*+`+`?)?",
    "fnty": "(?:`for`<gparams>)?`unsafe`?(?:`extern``s`?)?`fn`{(T}(?:`->`<type>)?",
    "type": "(?:`& &&``l`?`mut`?<type>|`*``const mut`<type>|`!`|`impl dyn`<bounds>|<fnty>|{(T}|{[T}|`for`<gparams><tpath>|<tpath>(?:`!`<GROUP>)?)",
    "gparams": "`<`(?:(?:<attr>)*(?:`l`(?:`:``l`(?:`+``l`)*)?|`const``i``:`<type>(?:`=`(?:`n`|{{B}))?|`i`(?:`:`<bounds>)?(?:`=`<type>)?)(?:`,`|(?=`>`)))*+`>`",
    "where": "(?:`where`(?:(?:(?:`for`<gparams>)?<type>|`l`)`:`<bounds>(?:`,`|(?=<GROUP>|`;`|$)))*+)?",
    "pat1": "(?:`&`|`&&`|`mut`|`ref``mut`?)*+(?:`i``@`<pat1>|`..`|`-`?`n``..= .. ...`(?:`-`?`n`|<path>)?|`-`?`n`|`s`(?:`..= ..``s`)?|`true false`|<xpath>(?:{(A}|{(P}|{{V}|`..= ..`(?:`-`?`n`|<path>))?|{(A}|{[A}|{(P})",
    "xpath": "(?:`<`<type>(?:`as`<tpath>)?`>``::`)?<path>",
    "pat": "`|`?<pat1>(?:`|`<pat1>)*+",
    "closure": "`move`?(?:`||`|`|`(?:<pat1>(?:`:`<type>)?(?:`,`|(?=`|`)))*+`|`)(?:`->`<type>{{B}|<e>)",
    "blocky": "(?:(?:`l``:`)?(?:`loop`{{B}|`while`(?:<cond>){{B}|`for`<pat>`in`<ns>{{B}|{{B})|`unsafe`{{B}|`async``move`?{{B}|`const`{{B}|<if>|`match`<ns>{{W})",
    "cond": "(?:`let`<pat>`=`<nsb>|<nsu>)(?:<op>(?:`let`<pat>`=`<nsb>|<nsu>))*+",
    "if": "`if`(?:<cond>){{B}(?:`else`(?:<if>|{{B}))?+",
    "macro": "<path>`!`(?:`i`)?<GROUP>",
    "prim": "(?:<closure>|`async``move`?<closure>|<blocky>|`n s`|`true false`|<macro>|`return`<e>?|`break``l`?<e>?|`continue``l`?|<xpath>(?:{{V})?|{(A}|{[A}|{[M}(?!))",
    "suf": "(?:`?`|`.``await`|`.`(?:<seg>|`n`)(?:`::`<gargs>)?|{(A}|{[A})",
    "un": "(?:`- ! *`|`& &&`(?:`mut`)?|`& &&``i``const mut`)*+",
    "u": "<un><prim>(?:<suf>|`as`<type>)*+",
    "op": "`+ - * / % ^ & | && || == != < <= >= << = += -= *= /= %= ^= &= |= <<=`|`>`{1,2}`>=`?(?!`>`)",
    "e": "(?:`.. ..=`<u>?|<u>)(?:(?:<op>)<u>|`.. ..=`(?:<u>)?)*+",
    "nsprim": "(?:<closure>|<blocky>(?!)|`match`<ns>{{W}|<if>|`unsafe loop`{{B}|`n s`|`true false`|<macro>|<xpath>|{(A}|{[A})",
    "nsu": "<un><nsprim>(?:<suf>|`as`<type>)*+",
    "nsb": "<nsu>(?:`+ - * / % ^ & | == != < <= >= > <<`<nsu>)*+",
    "ns": "(?:`.. ..=`<nsu>?|<nsu>)(?:(?:<op>)<nsu>|`.. ..=`(?:<nsu>)?)*+",
    "vis": "(?:`pub`(?:{(M})?|`crate`(?!`::`))?",
    "fnq": "(?:`const async unsafe`|`extern``s`?)*",
    "fn": "<fnq>`fn``i`(?:<gparams>)?{(P}(?:`->`<type>)?<where>(?:{{B}|`;`)",
    "item": "<attr>*+<vis>(?:<fn>|`struct``i`(?:<gparams>)?(?:<where>(?:{{S}|`;`)|{(T}<where>`;`)|`union``i`(?:<gparams>)?<where>{{S}|`enum``i`(?:<gparams>)?<where>{{N}|`unsafe`?`impl`(?:<gparams>)?`!`?<type>(?:`for`<type>)?<where>{{I}|`unsafe`?`trait``i`(?:<gparams>)?(?:`:`<bounds>)?<where>{{I}|`mod``i`(?:`;`|{{I})|`unsafe`?`extern``s`?{{I}|`extern``crate`(?:`i self`)(?:`as``i`)?`;`|`use`<use>`;`|`const static``mut`?(?:`i`)`:`<type>(?:`=`<e>)?`;`|`type``i`(?:<gparams>)?(?:`:`<bounds>)?<where>(?:`=`<type>)?<where>`;`|`macro_rules``!``i`(?:{{M}|<GROUP>`;`)|<path>`!``i`?(?:{{M}|<GROUP>`;`))",
    "use": "`::`?(?:(?:<seg>`::`)*(?:`*`|{{U}|<seg>(?:`as``i`)?)|{{U})",
    "let": "`let`<pat>(?:`:`<type>)?(?:`=`<e>(?:`else`{{B})?)?`;`",
    "stmt": "(?>`;`|<attr>*+<let>|<item>|<attr>*+<blocky>(?!`. ?`|<op>(?!`* & - && |`))`;`?|<attr>*+<macro>(?<=[-])(?!`. ?`)|<attr>*+<e>(?:`;`|$))",
    "field": "<attr>*+<vis>`i``:`<type>",
}
_RUST_ROLES = {
    "(A": "(?:<attr>*(?:<e>|<pat>)(?:`,`|$))*+",
    "(P": "(?:<attr>*(?:`&`?`l`?`mut`?`self`(?:`:`<type>)?|<pat1>`:`<type>|`...`)(?:`,`|$))*+",
    "(T": "(?:<attr>*<vis>(?:`i``:`)?(?:<type>|`...`)(?:`,`|$))*+",
    "(M": "[\\s\\S]*",
    "[A": "(?:<e>|<pat>)`;`<e>|(?:<attr>*(?:<e>|<pat>)(?:`,`|$))*+",
    "[T": "<type>(?:`;`<e>)?",
    "[M": "[\\s\\S]*",
    "{B": "(?:`#``!`{[M})*+<stmt>*+",
    "{V": "(?:<attr>*(?:`..`<e>?|(?:`i n`)`:`(?:<e>|<pat>)|`ref`?`mut`?`i`)(?:`,`|$))*+",
    "{S": "(?:<field>(?:`,`|$))*+",
    "{N": "(?:<attr>*<vis>`i`(?:{(T}|{{S})?(?:`=`<e>)?(?:`,`|$))*+",
    "{I": "(?:`#``!`{[M})*+(?>`i`?(?:<item>))*+",
    "{W": "(?>(?:<attr>)*+<pat>(?:`if`<cond>)?`=>`(?:<blocky>`,`?(?=$|<pat>(?:`if`|`=>`)|`#`)|<e>(?:`,`|$)))*+",
    "{U": "(?:(?:<use>)(?:`,`|$))*+",
    "{M": "[\\s\\S]*",
}

# C ---------------------------------------------------------------------------------------------------------------
_C = {
    "kwtype": "`void char short int long float double signed unsigned _Bool`",
    "qualif": "`const volatile restrict static extern register auto inline typedef _Noreturn _Thread_local _Atomic`|`_Alignas`<GROUP>|`i`{(A}(?=`i struct union enum void char short int long float double signed unsigned _Bool const static`)",
    "agg": "`struct union`(?:`i`?{{S}|`i`)|`enum`(?:`i`?{{N}|`i`)",
    "spec": "(?:<qualif>)*(?:(?:<kwtype>)(?:<kwtype>|<qualif>)*|(?:<agg>)(?:<qualif>)*|`i`(?:<qualif>)*)",
    "ptr": "(?:`*`(?:`const volatile restrict`)*)*",
    "dtor": "<ptr>(?:`i`|{(R})(?:{[K}|{(P})*+",
    "adtor": "<ptr>(?:`i`|{(R})?(?:{[K}|{(P})*+",
    "init": "(?:`=`(?:<e>|{{V}))?+",
    "decl": "<spec>(?:<dtor>(?:`:`<e>)?<init>(?:`,`<dtor>(?:`:`<e>)?<init>)*+)?`;`",
    "param": "(?:<spec><adtor>|`...`)",
    "tyname": "<spec><ptr>(?:{(R})?(?:{[K}|{(P})*+",
    "cast": "{(T}(?=`i n s ~ ! sizeof`|{(E}|{{V}|{(T})|{(T}(?=`- * & +`)",
    "prim": "(?:`n`|`s`+|`i`|{(T}{{V}|{(E}|`_Generic`<GROUP>|`sizeof _Alignof`(?:{(T}|<u>))",
    "suf": "(?:`. ->``i`|{(A}|{[K}|`++ --`)",
    "u": "(?:`+ - ! ~ * & ++ --`|<cast>)*<prim>(?:<suf>)*+",
    "op": "`+ - * / % & | ^ && || == != < <= > >= << >> = += -= *= /= %= &= |= ^= <<= >>=`",
    "b": "<u>(?:<op><u>)*+",
    "e": "<b>(?:`?`<es>?`:`<e>)?+",
    "es": "<e>(?:`,`<e>)*+",
    "st": "(?>`;`|{{B}|`if`{(E}<st>(?:`else`<st>)?+|`for`{(F}<st>|`while`{(E}<st>|`do`<st>`while`{(E}`;`|`switch`{(E}<st>|`case`<e>(?:`...`<e>)?`:`<st>?|`default``:`<st>?|`return`<es>?`;`|`break continue``;`|`goto``i``;`|`i``:`<st>?|`_Static_assert`<GROUP>`;`|<decl>|<es>`;`)",
    "top": "(?>`;`|`_Static_assert`<GROUP>`;`|`extern``s`{{B}|(?:<spec>)<dtor>(?:<decl>)*{{B}|<decl>|`i`{(A}`;`?)",
}
_C_ROLES = {
    "(E": "<es>",
    "(A": "(?:(?:<e>|<tyname>)(?:`,`(?:<e>|<tyname>))*+)?",
    "(P": "(?:<param>(?:`,`<param>)*+|`i`(?:`,``i`)*+)?",
    "(F": "(?:<decl>|<es>?`;`)<es>?`;`<es>?",
    "(T": "<tyname>",
    "(R": "<dtor>",
    "[K": "(?:`static const restrict`)*(?:`*`|<e>)?",
    "{B": "<st>*+",
    "{V": "(?:(?:(?:`.``i`|{[K})+`=`)?(?:<e>|{{V})(?:`,`|$))*+",
    "{S": "(?:`;`|<spec>(?:(?:<dtor>)?(?:`:`<e>)?(?:`,`<dtor>(?:`:`<e>)?)*+)?`;`)*+",
    "{N": "(?:`i`(?:`=`<e>)?(?:`,`|$))*+",
}


_SPECS = {
    "javascript": ("javascript", _JS, _JS_ROLES, "(?:<st>)*+`L`*"),
    "typescript": ("javascript", _TS, _TS_ROLES, "(?:<st>)*+`L`*"),
    "go": ("go", _GO, _GO_ROLES, "`;`*`package``i``;`(?:`;`|<top>(?:`;`|$))*+"),
    "java": ("java", _JAVA, _JAVA_ROLES, "(?:<ann>*`package`<qn>`;`)?(?:`import``static`?<id>(?:`.`<id>)*+(?:`.``*`)?`;`|`;`)*+(?:<type_decl>`;`*)*+"),
    "rust": ("rust", _RUST, _RUST_ROLES, "(?:`#``!`{[M})*+(?><item>)*+"),
    "c": ("c", _C, _C_ROLES, "<top>*+"),
}
_BUILT: dict[str, Grammar] = {}


def grammar(lang: str) -> Grammar:
    """The compiled grammar of a language, built once per process."""
    if lang not in _BUILT:
        words, rules, roles, file = _SPECS[lang]
        _BUILT[lang] = Grammar(words, rules, roles, file)
    return _BUILT[lang]
