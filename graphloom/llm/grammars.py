"""Syntax checks for nine source languages.

Python, JSON and TOML are read by the interpreter's own parsers. For C, Java, JavaScript, TypeScript, Go and Rust a
lexer turns the text into a string with one character for each token. Bracket groups are reduced from the inside out:
the content of a group is matched against the productions it may stand for (block, arguments, type, literal ...), and
the group becomes one character that carries the set of those that fit. What a content may stand for is remembered, so
recurring statements are parsed once per worker.
"""

from __future__ import annotations

import json
import keyword
import re
import tomllib
import warnings
from collections import Counter
from collections.abc import Callable

LANGUAGES = ("python", "rust", "javascript", "typescript", "go", "java", "c", "json", "toml")
#: Groups remembered per language.
MEMO = 100_000
#: Tokens remembered per language, and the longest one that is.
CACHED_TOKENS, CACHED_LENGTH = 100_000, 32
#: Levels of brackets that are reduced a level at a time; groups further out go one by one, so that depth costs no more than length.
LEVELS = 8

_BASE = {"(": 0xE000, "[": 0xE400, "{": 0xE800}
_CLOSE = {")": "(", "]": "[", "}": "{"}
#: Groups that fit no production.
_NOTHING = frozenset(map(chr, _BASE.values()))
_BITS = 8


class Grammar:
    """Productions of one language. groups: names of what each kind of bracket may stand for."""

    def __init__(self, groups: dict[str, list[str]], soft_newlines: bool = False) -> None:
        self.groups = groups
        # names used most come first; with the highest bits their classes are few ranges
        self.bit = {(bracket, name): len(names) - 1 - k for bracket, names in groups.items() for k, name in enumerate(names)}
        self.soft = soft_newlines
        #: Tokens after which a group may hold anything; without them a group that fits no production ends the parse.
        self.loose = ""
        #: What a file can begin with, and the characters that it can end with; others are no file of the language, whatever stands between.
        self.head = re.compile("")
        self.last = ""
        self.angles: re.Pattern[str] | None = None
        self.parts: list[tuple[re.Pattern[str], str | Callable[[re.Match[str]], str]]] = []
        self.memo: dict[str, str] = {}
        self.tests: dict[tuple[str, str], Callable[[str], object]] = {}
        self.tokens: Callable[[str], str | None] = lambda text: None
        self.top: Callable[[str], object] = lambda s: None

    def cls(self, bracket: str, *names: str) -> str:
        """Character class of the groups that may stand for any of the names."""
        want = sum(1 << self.bit[bracket, n] for n in names)
        fits = [m for m in range(1 << len(self.groups[bracket])) if m & want]
        runs = [m for m in fits if m - 1 not in fits]
        ends = [m for m in fits if m + 1 not in fits]
        return "[" + "".join(chr(_BASE[bracket] + x) + (f"-{chr(_BASE[bracket] + y)}" if y > x else "") for x, y in zip(runs, ends)) + "]"

    def any(self, bracket: str) -> str:
        return f"[{chr(_BASE[bracket])}-{chr(_BASE[bracket] + (1 << _BITS) - 1)}]"

    def _group(self, text: str) -> str:
        """The character for a group, given with its brackets."""
        memo = self.memo
        found = memo.get(text)
        if found is None:
            bracket, content = text[0], text[1:-1]
            body = content.replace("\n", "") if self.soft and bracket != "{" else content
            mask = 0
            for form in self._forms(body):
                mask = mask or sum(1 << self.bit[bracket, name] for name in self.groups[bracket] if self.tests[bracket, name](form))
            if len(memo) >= MEMO:
                memo.clear()
            found = memo[text] = chr(_BASE[bracket] + mask)
        return found

    def _forms(self, body: str) -> list[str]:
        """The content with its parts reduced: first with type arguments as one character, then with < and > that compare."""
        forms = [body]
        if self.angles is not None and "<" in body:
            form, n = self.angles.subn(ANGLES, body)
            while n:
                form, n = self.angles.subn(ANGLES, form)
            if form != body:
                forms = [form, body]
        for part, char in self.parts:
            forms = [part.sub(char, f) for f in forms]
        return forms

    def parses(self, text: str) -> bool:
        if not self.head.match(text) or not self._may_end(text):
            return False
        flat = self.tokens(text)
        return flat is not None and (reduced := self.reduce(flat)) is not None and any(map(self.top, self._forms(reduced)))

    def _may_end(self, text: str) -> bool:
        if not self.last or text[-1:] in self.last:
            return True
        end = len(text.rstrip())
        if not end or text[end - 1] in self.last or text[end - 1] == "/":
            return True
        line = text.rfind("\n", 0, end) + 1
        # a comment, a directive or its continuation
        return "//" in text[line:end] or text.startswith("#", line + len(text[line:end]) - len(text[line:end].lstrip())) or text[:line].rstrip().endswith("\\")

    def reduce(self, flat: str) -> str | None:
        """The tokens with every bracket group as one character; None if brackets don't match."""
        stack: list[tuple[str, list[str]]] = []
        parts: list[str] = []
        at = 0
        strict = not any(c in flat for c in self.loose)
        known, whole = self.memo.get, self._group

        def group_of(m: re.Match[str]) -> str:
            group = known(m[0]) or whole(m[0])
            if strict and group in _NOTHING:
                raise _NoProduction
            return group

        try:
            for _ in range(LEVELS):
                flat, n = _INNERMOST.subn(group_of, flat)
                if not n:
                    break
        except _NoProduction:
            return None
        for m in _BRACKETS.finditer(flat):
            c, k = m[0], m.start()
            parts.append(flat[at:k])
            at = k + 1
            if c in _BASE:
                stack.append((c, parts))
                parts = []
            else:
                if not stack or stack[-1][0] != _CLOSE[c]:
                    return None
                content = "".join(parts)
                bracket, parts = stack.pop()
                group = self._group(f"{bracket}{content}{c}")
                if strict and group in _NOTHING:
                    return None
                parts.append(group)
        if stack:
            return None
        parts.append(flat[at:])
        return "".join(parts)


class _NoProduction(Exception):
    pass


_BRACKETS = re.compile(r"[()\[\]{}]")
_INNERMOST = re.compile(r"\([^()\[\]{}]*+\)|\[[^()\[\]{}]*+\]|\{[^()\[\]{}]*+\}")
#: Stands for a list of type arguments or parameters.
ANGLES = "\uf700"
#: Stand for a function or class, an arrow with a block, the head of an arrow or closure, and a block-like expression.
FUNCTION, ARROW, HEAD, BLOCKLIKE = "\uf701", "\uf702", "\uf703", "\uf704"
#: A function or class without a name, which is no statement.
NAMELESS = "\uf705"
#: An if with its block, before its else.
IF = "\uf706"


def _full(pattern: str) -> Callable[[str], object]:
    return re.compile(pattern).fullmatch


def _sequence(statement: str = "", prefix: str = r"(?!)", label: str = r"(?!)", step: re.Pattern[str] | None = None, without: tuple[str, ...] = ()) -> Callable[[str], bool]:
    """Matches statements one after another. After a prefix (if (x), for (...), else) a statement has to follow; else needs an if before it.

    step: the pattern of a step with the groups p (prefix), l (label), and others for statements, of which those named in without may not occur.
    """
    step = step or re.compile(f"(?:(?P<p>{prefix})|(?P<l>{label})|(?P<s>{statement}))")

    def run(s: str) -> bool:
        at, open_prefix, chain, after_if = 0, False, False, False
        while at < len(s):
            m = step.match(s, at)
            if not m or m.end() == at:
                return False
            kind = m.lastgroup
            if kind in without:
                return False
            if kind == "p" or kind == "e":
                word = s[at]
                if word == "L":
                    if not after_if:
                        return False
                chain = chain or word == "I" if word != "L" else False
                open_prefix, after_if = True, False
            elif kind != "l" and m[0].strip("\n"):
                after_if, chain, open_prefix = chain, False, False
            at = m.end()
        return not open_prefix

    return run


class _Classes(dict):
    """Token to its class, which depends on nothing but its text."""

    def __init__(self, classify: Callable[[str], str]) -> None:
        super().__init__()
        self.classify = classify

    def __missing__(self, token: str) -> str:
        found = self.classify(token)
        if len(token) <= CACHED_LENGTH:
            if len(self) >= CACHED_TOKENS:
                self.clear()
            self[token] = found
        return found


def _lexer(words: dict[str, str], operators: dict[str, str], strings: str, number: str, comments: str, extra: str = r"(?!)", extra_class: str = "", word: str = r"[^\W\d]\w*"):
    """Token classes of a text, or None at a character that starts no token."""
    ops = "|".join(re.escape(o) for o in sorted(operators, key=len, reverse=True))
    tokens = f"(?!/\\*)(?:{ops})"
    # a character that starts no token takes the rest of the text with it
    rx = re.compile(rf"[ \t\r\f]*(?:(\n|{comments}|{extra}|{word}|{number}|{strings}|{tokens})|[^ \t\r\f].*)", re.S)
    kinds = re.compile(rf"(\n)|({comments})|({extra})|({word})|({number})|({strings})|({tokens})", re.S)

    def classify(token: str) -> str:
        k = kinds.match(token).lastindex
        if k == 2:
            return "\n" if "\n" in token else ""
        return words.get(token, "i") if k == 4 else operators[token] if k == 7 else {1: "\n", 3: extra_class, 5: "0", 6: "s"}[k]

    classes = _Classes(classify)

    def run(text: str) -> list[str] | None:
        found = rx.findall(text)
        return None if found and not found[-1] else [classes[t] for t in found]

    return run


_NUMBER = r"(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?){}(?![\w])"
_COMMENTS = r"//[^\n]*|/\*.*?\*/"
_FLAT_COMMENT = r"/\*(?:[^*/]+|\*(?!/)|/(?!\*))*+\*/"
#: Comments that nest, two levels deep.
_NESTED = r"//[^\n]*|/\*(?:[^*/]+|\*(?!/)|/(?!\*)|" + rf"/\*(?:[^*/]+|\*(?!/)|/(?!\*)|{_FLAT_COMMENT})*+\*/" + r")*+\*/"
_STRING = r'"(?:[^"\\\n]|\\.)*"'


def _head(start: str, comments: str = r"//[^\n]*|/\*.*?\*/") -> re.Pattern[str]:
    """What follows blanks and comments at the beginning: nothing, or start."""
    return re.compile(rf"(?:#![^\[\n][^\n]*)?(?:\s|{comments})*+(?:\Z|{start})", re.S)




def _table(spec: str) -> dict[str, str]:
    return {w: c for part in spec.split() for c, _, ws in [part.partition(":")] for w in ws.split(",")}


def _ops(spec: str, extra: dict[str, str] | None = None) -> dict[str, str]:
    return {o: o for o in spec.split()} | (extra or {})


def _ternary(unary: str, binary: str) -> str:
    return f"{unary}(?:{binary}{unary}|\\?{unary}(?:{binary}{unary})*:{unary})*"


# ---------------------------------------------------------------- C


def _c() -> Grammar:
    g = Grammar({"(": ["args", "params", "for", "type", "generic", "pointer", "cond"], "[": ["index"], "{": ["block", "init", "fields", "enum"]})
    words = _table(
        "T:int,char,void,float,double,long,short,unsigned,signed,_Bool,_Complex,__int128,__signed__ "
        "Q:const,static,extern,volatile,inline,register,restrict,auto,_Thread_local,_Noreturn,_Atomic,__inline,__inline__,__restrict,__restrict__,__volatile__,__const,__extension__ "
        "U:struct,union E:enum I:if L:else F:for W:while D:do S:switch C:case d:default B:break,continue R:return G:goto Y:typedef Z:sizeof,_Alignof,__alignof__ "
        "k:__attribute__,__declspec,_Alignas t:typeof,__typeof__,__typeof H:_Static_assert,static_assert r:_Generic M:asm,__asm__,__asm"
    )
    ops = _ops("( ) [ ] { } , ; : ? . + - * & = < >", {"->": ".", "++": "p", "--": "p", "!": "!", "~": "!", "...": "v"})
    ops |= dict.fromkeys("/ % ^ | << >> <= >= == != && ||".split(), "o") | dict.fromkeys("+= -= *= /= %= &= |= ^= <<= >>=".split(), "a")
    directive = r'(?:^|(?<=\n))[ \t]*\#[ \t]*(?:include[ \t]*(?:<[^>\n]+>|"[^"\n]+")[ \t]*(?://[^\n]*|/\*[^\n]*\*/)?\r?(?=\n|\Z)|(?:define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|line)\b(?:[^\n\\]|\\\r?\n|\\.)*)'
    lex = _lexer(words, ops, rf"(?:L|u8|u|U)?{_STRING}|L?'(?:[^'\\\n]|\\[^\n'][\w]*|\\')+'", _NUMBER.format("[uUlLfF]*"), _COMMENTS, directive, "", word=r"(?!(?:L|u8|u|U)[\"'])[^\W\d]\w*")

    def tokens(text: str) -> str | None:
        out = lex(text)
        return None if out is None else "".join(out).replace("\n", "")

    args, params, for_, cast, generic, pointer, cond = (g.cls("(", n) for n in ("args", "params", "for", "type", "generic", "pointer", "cond"))
    index, block, init, fields, enum = g.cls("[", "index"), g.cls("{", "block"), g.cls("{", "init"), g.cls("{", "fields"), g.cls("{", "enum")
    g.loose = "ktM"
    g.head, g.last = _head(r"[;]|#(?!\s*[\[!])|(?!\w+\s+\w+\s*(?:::|\.)|(?!struct|union|enum)\w+\s*\{|const\s+\w+\s*=|export\s+(?:const|function|class|default|async|type|interface|enum)\b|(?:public|abstract|final)\s+(?:\w+\s+)?(?:class|interface|enum)\b|pub\s+(?:fn|struct|enum|static)\b|class\s+\w+\s*(?:\{|extends\b|implements\b)|package\s+\w+(?:\s+(?:import|func|type|var|const)\b|\s*;\s*import\s+\w+\s*\.))\w"), ";}"
    # attributes stand wherever qualifiers do
    g.parts = [(re.compile(f"k{g.any('(')}"), "Q"), (re.compile(f"t{g.any('(')}"), "T")]
    prim = f"(?:i|0|s+|{args}|Z(?:{cast}|{args})|{cast}{init}|r{generic})"
    unary = f"(?:[-+*&!pZ]|{cast})*{prim}(?:{args}|{index}|\\.i|p)*"
    expr = _ternary(unary, "[-+*&o=a<>]")
    exprs = f"{expr}(?:,{expr})*"
    base = f"Q*(?:T+(?:Q|T)*|UQ*(?:i|i?{fields})|EQ*(?:i|i?{enum})|i)Q*"
    name = f"(?:\\*Q*)*(?:i|{args}{params})(?:{index})*(?:{params})?"
    decl1 = f"{name}(?:M{args})?Q*(?::{expr})?(?:=(?:{expr}|{init}))?"
    decl = f"Y?{base}(?:{decl1}(?:,{decl1})*)?;"
    param = f"{base}(?:\\*Q*)*(?:i|(?:{args}|{pointer}){params})?(?:{index})*Q*"
    typed = f"{base}(?:\\*Q*)*(?:{pointer}{params})?(?:{index})*"
    g.tests = {
        ("(", "args"): _full(f"(?:{exprs})?"),
        ("(", "params"): _full(f"(?:{param}(?:,{param})*(?:,v)?)?"),
        ("(", "for"): _full(f"(?:{decl}|(?:{exprs})?;)(?:{exprs})?;(?:{exprs})?"),
        ("(", "type"): _full(typed),
        ("(", "generic"): _full(f"{expr}(?:,(?:d|{typed}):{expr})+"),
        ("(", "pointer"): _full(f"(?:\\*Q*)+(?:{index})*"),
        ("(", "cond"): _full(exprs),
        ("[", "index"): _full(f"Q*(?:{expr}|\\*)?"),
        ("{", "init"): _full(f"(?:(?:(?:\\.i|{index})+=)?(?:{expr}|{init})(?:,(?:(?:\\.i|{index})+=)?(?:{expr}|{init}))*,?)?"),
        ("{", "fields"): _sequence(f"{decl}|H{args};"),
        ("{", "enum"): _full(f"i(?:={expr})?(?:,i(?:={expr})?)*,?"),
    }
    prefix = f"I{cond}|F{for_}|W{cond}|S{cond}|L|D"
    inline = f"M(?:Q|G)*{g.any('(')};"
    g.tests["{", "block"] = _sequence(f";|{block}|R(?:{exprs})?;|B;|G(?:i|\\*{expr});|H{args};|{inline}|{exprs};|{decl}", prefix, f"C{expr}(?:v{expr})?:|d:|i:")
    g.tokens = tokens
    g.top = _sequence(f";|{base}(?:\\*Q*)*i{params}Q*{block}|{base}(?:\\*Q*)*i{args}(?:{decl})+{block}|H{args};|{inline}|{decl}")
    return g


# ---------------------------------------------------------------- Java


def _java() -> Grammar:
    g = Grammar({"(": ["args", "params", "for", "type", "try", "record"], "[": ["index", "empty"], "{": ["block", "init", "class", "enum", "cases", "module"]})
    words = _table(
        "T:int,boolean,byte,char,short,long,float,double,void M:public,private,protected,static,final,abstract,synchronized,native,transient,volatile,strictfp,default "
        "K:class,interface E:enum N:new X:extends,implements,throws P:package m:import I:if L:else F:for W:while D:do R:return O:throw y:try c:catch f:finally "
        "S:switch C:case B:break,continue w:instanceof V:assert"
    )
    ops = _ops("( ) [ ] { } , ; : ? . + - * & = < > @", {"++": "p", "--": "p", "!": "!", "~": "!", "...": "v", "->": "Z", "::": "q"})
    ops |= dict.fromkeys("/ % ^ | << <= >= == != && ||".split(), "o") | dict.fromkeys("+= -= *= /= %= &= |= ^= <<=".split(), "a")
    lex = _lexer(words, ops, r'"""[ \t]*\r?\n(?:[^\\]|\\.)*?"""|' + _STRING + r"|'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'", _NUMBER.format("[lLfFdD]?"), _COMMENTS, word=r"[^\W\d][\w$]*|\$[\w$]*")
    g.head, g.last = _head(r"[@;]|(?:package|import|public|private|protected|static|abstract|final|strictfp|sealed|non-sealed|class|interface|enum|record|open|module)\b"), ";}"
    # words that mean something in one place only
    sealed = re.compile(r"\b(?:non-)?sealed(?=\s+(?:public|private|protected|static|abstract|strictfp|class|interface)\b)")
    permits = re.compile(r"\bpermits(?=\s+[\w.$]+(?:\s*,\s*[\w.$]+)*\s*\{)")

    def tokens(text: str) -> str | None:
        if "sealed" in text or "permits" in text:
            text = permits.sub("implements", sealed.sub("final", text))
        out = lex(text)
        return None if out is None else "".join(out).replace("\n", "")

    args, params, for_, cast, res, record = (g.cls("(", n) for n in ("args", "params", "for", "type", "try", "record"))
    index, empty = g.cls("[", "index"), g.cls("[", "empty")
    block, init, body, enum, cases, module = (g.cls("{", n) for n in ("block", "init", "class", "enum", "cases", "module"))
    note = f"(?:@i(?:\\.i)*(?:{args})?)"
    type_ = f"{note}*(?:i{ANGLES}?(?:\\.i{ANGLES}?)*|T)(?:{empty})*"
    arg = f"(?:{note}*\\?(?:[Xi]{type_})?|{type_}(?:X{type_}(?:&{type_})*)?)"
    g.angles = re.compile(f"(?<=[i.MN{{}};@q])<(?:{arg}(?:,{arg})*)?>|^<(?:{arg}(?:,{arg})*)?>|(?<=\\.)<{type_}>")
    generic = ANGLES
    lam = f"(?:i|{params}|{args})Z"
    prim = (
        f"(?:N{type_}(?:{index})*(?:{args}(?:{body})?|{init})?|(?:{lam}){block}|i|0|s|{args}|T(?:{empty})*\\.K|S{args}{cases}|{type_}q(?:i|N))"
    )
    suffix = f"(?:\\.{ANGLES}?i|\\.K|\\.N{type_}{args}|{args}|{index}|p|q(?:i|N))"
    unary = f"(?:[-+!p]|{cast}|{lam})*{prim}{suffix}*"
    # a literal takes no assignment
    pattern = f"M*{type_}(?:i|{record}i?)"
    step = f"(?:(?:[-+*&o<]|(?<![0s])[=a]|>{{1,3}}=?){unary}|w(?:{pattern}|M*{type_}))"
    expr = f"{unary}(?:{step}|\\?{unary}{step}*:{unary})*"
    exprs = f"{expr}(?:,{expr})*"
    value = f"(?:{expr}|{init})"
    var1 = f"i(?:{empty})*(?:={value})?"
    var = f"(?:{note}|M)*{type_}{var1}(?:,{var1})*"
    param = f"(?:{note}|M)*{type_}v?i(?:{empty})*"
    mods = f"(?:{note}|M)*"
    types = f"{type_}(?:,{type_})*"
    klass = f"{mods}(?:@?K|i)i{generic}?(?:{params})?(?:X{types})*{body}|{mods}Ei(?:X{types})*{enum}"
    g.tests = {
        ("(", "args"): _full(f"(?:{exprs}|i={value}(?:,i={value})*|{init})?"),
        ("(", "params"): _full(f"(?:{param}(?:,{param})*|i(?:,i)*)?"),
        ("(", "for"): _full(f"(?:{var}|{exprs})?;(?:{expr})?;(?:{exprs})?|{param}:{expr}"),
        ("(", "type"): _full(f"{type_}(?:&{type_})*"),
        ("(", "try"): _full(f"(?:{var}|{expr})(?:;(?:{var}|{expr}))*;?|M*{type_}(?:o{type_})*i"),
        ("(", "record"): _full(f"(?:{pattern}(?:,{pattern})*)?"),
        ("[", "index"): _full(f"(?:{expr})?"),
        ("[", "empty"): lambda s: not s,
        ("{", "init"): _full(f"(?:(?:{value}|{note})(?:,(?:{value}|{note}))*,?)?"),
    }
    member = f";|{klass}|M?{block}|{mods}{generic}?(?:{type_})?i{params}(?:{empty})*(?:X{types})?(?:{block}|(?:M{value})?;)|{mods}i{block}|{var};"
    g.tests["{", "class"] = _sequence(member)
    const = f"{note}*i(?:{args})?(?:{body})?"
    head = re.compile(f"(?:{const}(?:,{const})*,?)?(?:;|$)")
    members = g.tests["{", "class"]
    g.tests["{", "enum"] = lambda s: (m := head.match(s)) is not None and members(s[m.end() :])
    case = f"C(?:{pattern}(?:,{pattern})*|{exprs}(?:,M)?)(?:i{expr})?"
    g.tests["{", "cases"] = _full(f"(?:(?:{case}|M)Z(?:{expr};|{block}|O{expr};))*")
    called = f"i(?:\\.i)*"
    g.tests["{", "module"] = _full(f"(?:iM?i?{called}(?:i{called}(?:,{called})*)?;)*")
    # expressions that are statements: assignments, steps, calls and new objects
    effect = f"(?:{unary}(?<![0s])[=a]{expr}|p{unary}|{unary}(?<=p)|{prim}{suffix}*(?<={args})(?<!^{args})|N{type_}{args}(?:{body})?)"
    stmt = f";|{klass}|{block}|R(?:{expr})?;|O{expr};|B(?:i)?;|V{expr}(?::{expr})?;|y(?:{res}{block}(?:c{res}{block})*(?:f{block})?|{block}(?:(?:c{res}{block})+(?:f{block})?|f{block}))|S{args}{cases}|M{args}{block}|i{expr};|{effect};|{var};"
    g.tests["{", "block"] = _sequence(stmt, f"I{args}|F{for_}|W{args}|S{args}|L|D", f"{case}:|M:|i:")
    g.tokens = tokens
    g.top = _sequence(f";|{note}*i{{1,2}}i(?:\\.i)*{module}|{note}*Pi(?:\\.i)*;|mM?i(?:\\.i)*(?:\\.\\*)?;|{klass}")
    return g


# ---------------------------------------------------------------- JavaScript, TypeScript

_JS_WORDS = (
    "f:function a:async c:class x:extends n:new u:typeof,void,delete,await Y:yield v:var,let K:const I:if L:else F:for W:while D:do S:switch C:case d:default "
    "B:break,continue R:return O:throw y:try h:catch z:finally m:import e:export N:in o:instanceof l:of g:get,set,static j:as,satisfies r:from "
    "J:interface M:namespace,module Q:implements,public,private,protected q:type,declare,abstract,readonly,keyof,infer,is,override,asserts,unique,accessor,global "
    "E:enum X:with,debugger"
)
_REGEX = r"/(?![/*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_JS_COMMENT_OPEN = re.compile(r"\s*")


def _js_tokens():
    """Token classes of JavaScript and TypeScript. Reserved words that only the latter uses are J and Q."""
    words = _table(_JS_WORDS)
    ops = _ops("( ) [ ] { } , ; : ? . + - * & | = < > @", {"++": "p", "--": "p", "!": "!", "~": "!", "...": "V", "=>": "Z", "?.": "."})
    ops |= dict.fromkeys("/ % ^ << <= >= == != === !== && || ?? **".split(), "o") | dict.fromkeys("+= -= *= /= %= &= |= ^= <<= **= &&= ||= ??=".split(), "A")
    names = "|".join(re.escape(o) for o in sorted(ops, key=len, reverse=True))
    blank = "[ \\t\\r\\f\ufeff\\xa0]"
    kinds = [r"\n", _COMMENTS, r"\#?[^\W\d][\w$]*|\#?\$[\w$]*", _NUMBER.format("n?"), rf"{_STRING}|'(?:[^'\\\n]|\\.)*'", "`", _REGEX, rf"(?!/\*)(?:{names})"]
    rx = re.compile(rf"{blank}*(?:{'|'.join(f'({kind})' for kind in kinds)}|([^{blank[1:]}))", re.S)
    ends = frozenset("i0s)]}p%")
    division = re.compile("/=?")

    def template(text: str, at: int, out: list[str]) -> int:
        """Reads a template from after its opening mark; its expressions follow it as if they were arguments."""
        out.append("s")
        size = len(text)
        while at < size:
            c = text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                return at + 1
            elif c == "$" and text.startswith("{", at + 1):
                out.append("(")
                at = scan(text, at + 2, out, True)
                if at < 0:
                    return -1
                out.append(")")
            else:
                at += 1
        return -1

    def scan(text: str, at: int, out: list[str], inner: bool) -> int:
        depth, size = 0, len(text)
        match = rx.scanner(text, at).match
        while at < size:
            m = match()
            if m is None:  # only blanks are left
                return -1 if inner else size
            k = m.lastindex
            at = m.end()
            if k == 3:
                word = m[3]
                out.append("i" if out and out[-1] == "." else words.get(word, "i"))
            elif k == 8:
                c = ops[m[8]]
                if inner and c in "{}":
                    if c == "}" and not depth:
                        return at
                    depth += 1 if c == "{" else -1
                out.append(c)
            elif k == 1:
                if out and out[-1] != "\n":
                    out.append("\n")
            elif k == 2:
                if "\n" in m[2] and out and out[-1] != "\n":
                    out.append("\n")
            elif k == 4:
                out.append("0")
            elif k == 5:
                out.append("s")
            elif k == 6:
                at = template(text, at, out)
                if at < 0:
                    return -1
                match = rx.scanner(text, at).match
            elif k == 7:
                last = next((c for c in reversed(out) if c != "\n"), "")
                if last in ends and last:
                    d = division.match(text, m.start(7))
                    out.append("A" if len(d[0]) == 2 else "o")
                    at = d.end()
                    match = rx.scanner(text, at).match
                else:
                    out.append("s")
            else:
                return -1
        return -1 if inner else size

    # a line end means nothing beside these tokens
    drop = re.compile(r"\n+(?=[.,?:=o*&|A<>)\]ZNlj])|(?<=[-.,?:=o*+&|A<>(\[Z!uvKnNxVfac])\n+|^\n+")

    # A text is read at once if its tokens tell their classes: no template holds more than plain expressions, and nothing
    # that looks like a regular expression may be a division. slow marks tokens that don't, pattern is a regular expression;
    # instanceof after a point is a name, but another operator isn't.
    plain = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{[^{}`'\"/\n]*\})*+`"
    whole = re.compile(rf"{blank}*(?:({'|'.join([plain, *kinds])})|[^{blank[1:]}.*)", re.S)
    pattern, slow, instanceof = "\uf7fd", "\uf7fe", "\uf7ff"
    named = re.compile(f"(?<=\\.)[{''.join(sorted(set(words.values()) - {'o'}))}{instanceof}]")
    divided = re.compile(f"[{re.escape(''.join(sorted(ends)))}{pattern}]\n*{pattern}")
    lines = re.compile(r"\n{2,}")

    def classify(token: str) -> str:
        k = rx.match(token).lastindex
        if k == 2:
            return "\n" if "\n" in token else ""
        if k == 3:
            return instanceof if words.get(token) == "o" else words.get(token, "i")
        if k == 6:
            out: list[str] = []
            return "".join(out) if len(token) > 1 and scan(token, 0, out, False) >= 0 else slow
        return ops[token] if k == 8 else {1: "\n", 4: "0", 5: "s", 7: pattern}[k]

    classes = _Classes(classify)

    def read(text: str) -> str | None:
        found = whole.findall(text)
        failed = bool(found) and not found[-1]
        if failed:
            found.pop()
        flat = named.sub("i", "".join([classes[t] for t in found]))
        if slow not in flat and not (pattern in flat and divided.search(flat)):
            return None if failed else lines.sub("\n", flat.replace(instanceof, "o").replace(pattern, "s")).lstrip("\n")
        out: list[str] = []
        return None if scan(text, 0, out, False) < 0 else "".join(out)

    last: list = [None, None]  # the text read last: both languages read it one after the other

    def run(text: str) -> str | None:
        if last[0] is not text:
            body = text[text.find("\n") if "\n" in text else len(text) :] if text.startswith("#!") else text
            flat = read(body)
            last[:] = text, None if flat is None else drop.sub("", flat)
        return last[1]

    return run


_JS_TOKENS = _js_tokens()
_TYPED = str.maketrans("Q", "q")
_UNTYPED = str.maketrans("JQ", "%%")


def _js(typed: bool) -> Grammar:
    g = Grammar({"(": ["args", "params", "for", "type"], "[": ["array", "pattern", "empty", "tuple"], "{": ["block", "object", "class", "names", "type", "pattern", "enum", "module"]}, soft_newlines=True)
    args, params, for_, ptype = (g.cls("(", n) for n in ("args", "params", "for", "type"))
    array, bpat, empty, tuple_ = (g.cls("[", n) for n in ("array", "pattern", "empty", "tuple"))
    block, obj, body, names, otype, opat, enum = (g.cls("{", n) for n in ("block", "object", "class", "names", "type", "pattern", "enum"))
    # two names in a row begin no statement unless the first one is a keyword or the second an operator, nor does a key with its value
    keyword = "for|function|async|class|var|let|const|import|export|new|typeof|void|delete|await|yield|do|return|throw|case|break|continue|type|interface|enum|namespace|module|declare|abstract"
    twice = rf"(?!(?:{keyword})\b)[^\W\d][\w$]*[ \t]+(?!(?:in|of|instanceof|as|satisfies)\b)[^\W\d]"
    imports = r"import\b(?!\s*[{*(\"'.]|\s+(?:type\s+)?[\w$]+\s+from\s*[\"']|\s+[\w$]+\s*[,=]|\s+type\s*[{*])|from\s+[\w.]+\s+import\b|class\s+[\w$]+\s*[:(]"
    key = r"\{\s*\"(?:[^\"\\\n]|\\.)*+\"\s*:"
    g.head = _head(rf"(?!{twice}|{imports}|{key}|\"\"\"|#(?!!)).")
    module = g.cls("{", "module")
    ident = "[igjlqraJM]"
    word = "[igjlqraJMcfxnuvKYILFWDSCdBROyhzmeNoEX%]"
    never = "(?!)"
    if typed:
        one = f"(?:[qu]\n?|n?{HEAD}|n?{ANGLES}?{params}Z)*(?:(?:{ident}|u|m{args})(?:\\.{word})*{ANGLES}?|s(?:{args}|{ptype})*|0|-0|{otype}|{tuple_}|{ptype})(?:{empty}|{tuple_})*"
        type_ = f"[|&]?{one}(?:[|&]{one})*"
        either = f"{type_}(?:x{type_}\\?{type_}:{type_})*"
        given = f"(?:K ?)?{either}(?:x{type_})?(?:={type_})?".replace(" ?", "")
        g.angles = re.compile(f"<\n?{given}(?:,\n?{given})*,?\n?>")
        note, targs, cast = f"(?::{type_}(?:q{type_})?)?", ANGLES, f"(?:j(?:{type_}|K))"
        generics = f"{ANGLES}?"
        optional, bang = "\\??", "!"
    else:
        type_, either, note, targs, cast, generics, optional, bang = never, never, "", never, never, "", "", never
    binding = f"(?:{ident}|{bpat}|{opat})"
    func = f"{generics}{params}{note}{block}"
    arrow = f"a?(?:{ident}|{generics}{params}{note})Z"
    heritage = f"(?:x{ident}(?:\\.{word})*(?:{args}|{targs})*)?" + (f"(?:q{type_}(?:,{type_})*)?" if typed else "")
    klass = f"{generics}{heritage}{body}"
    name = f"(?:{ident}|Y)"
    g.parts = [
        (re.compile(f"a?f\\*?{name}{func}"), FUNCTION),
        (re.compile(f"a?f\\*?{func}"), NAMELESS),
        (re.compile(f"{arrow}{block}"), ARROW),
        (re.compile(arrow), HEAD),
        (re.compile(f"c{ident}{klass}"), FUNCTION),
        (re.compile(f"c{klass}"), NAMELESS),
    ]
    prim = f"(?:[{FUNCTION}{NAMELESS}{ARROW}]|{ident}|0|s|{args}|{array}|{obj}|m(?={args}|\\.)|n\\.{word}|Y)"
    unary = f"(?:[-+!pun{HEAD}{ANGLES if typed else ''}]|Y\\*?)*{prim}(?:\\.{word}|\\.(?={args}|{array})|{args}|{array}|s|p|{targs}{args}|{bang}(?![=]))*(?:{cast})*"
    expr = _ternary(unary, "(?:[-+*&|o<N]|(?<![0s])[=A]|>{1,3}=?)")
    exprs = f"{expr}(?:,{expr})*"
    item = f"V?{expr}"
    default = f"(?:={expr})?"
    deco = f"(?:@{ident}(?:\\.{word})*(?:{args})?\n?)*"
    access = "(?:q)*" if typed else ""
    param = f"{deco}{access}V?{binding}{optional}{note}{default}"
    end = r"(?:;\n*|\n+|$)"
    key = f"(?:{word}|s|0|{array})"
    var1 = f"{binding}{'!?' if typed else ''}{note}{default}"
    const1 = f"{binding}{note}={expr}"
    var = f"(?:v{var1}(?:,\n?{var1})*|K{const1}(?:,\n?{const1})*)"
    ambient = f"K{binding}{note}(?:,\n?{binding}{note})*"
    member = f"V?(?:{ident}\\??:)?{type_}\\??"
    g.tests = {
        ("(", "args"): _full(f"(?:{item}(?:,{item})*,?)?"),
        ("(", "params"): _full(f"(?:{param}(?:,{param})*,?)?"),
        ("(", "for"): _full(f"(?:{var}|{exprs})?;(?:{exprs})?;(?:{exprs})?|(?:[vK]{binding}|{expr})l{expr}|[vK]{binding}N{expr}|{expr}"),
        ("(", "type"): _full(either if typed else never),
        ("[", "array"): _full(f"(?:(?:{item})?(?:,(?:{item})?)*)?"),
        ("[", "pattern"): _full(f"(?:V?{binding}{default})?(?:,(?:V?{binding}{default})?)*"),
        ("[", "empty"): lambda s: not s,
        ("[", "tuple"): _full(f"{member}(?:,{member})*,?|{ident}N{type_}(?:j{type_})?" if typed else never),
        ("{", "names"): _full(f"\n?(?:q?{word}(?:j{word})?(?:,\n?q?{word}(?:j{word})?)*,?)?\n?"),
        ("{", "pattern"): _full(f"\n?(?:V?{ident}{default}|{key}:{binding}{default})?(?:,\n?(?:V?{ident}{default}|{key}:{binding}{default}))*,?\n?"),
        ("{", "enum"): _full(f"\n?(?:{ident}|s){default}(?:,\n?(?:{ident}|s){default})*,?\n?" if typed else never),
    }
    method = f"(?:[ga]\n?)*\\*?{key}{generics}{params}{note}{block}"
    entry = f"(?:{key}:{expr}|{method}|V{expr}|{ident}{default})"
    g.tests["{", "object"] = _full(f"\n?(?:{entry}\n?(?:,\n?{entry}\n?)*,?)?\n?")
    mods = "(?:[gq](?=[^(:=;?!]))*" if typed else "(?:g(?=[^=;(]))*"
    g.tests["{", "class"] = _sequence(
        f"[;\n]|{deco}{mods}a?\\*?{key}{optional}{generics}{params}{note}(?:{block}|{end if typed else never})|{deco}{mods}{key}{'[?!]?' if typed else ''}{note}{default}{end}|g{block}"
    )
    g.tests["{", "type"] = _sequence(f"[;,\n]|(?:q)?(?:{key}|g{key}){optional}(?:{generics}{params})?{note}(?:[;,\n]|$)|n?{generics}{params}{note}(?:[;,\n]|$)|(?:[-+]?q)?{tuple_}(?:[-+]?\\?)?:{type_}(?:[;,\n]|$)") if typed else (lambda s: False)
    stmt = (
        f"[;\n]|{deco}(?:q)?{FUNCTION}\n?|y{block}\n?(?:h(?:{params})?{block}\n?(?:z{block}\n?)?|z{block}\n?)|R(?:{exprs})?{end}|O{exprs}{end}|B(?:{ident})?{end}|X{end}|"
        f"{'(?:q)?' if typed else ''}{var}{end}|{block}\n?|(?![{{{FUNCTION}{NAMELESS}]){exprs}{end}"
    )
    if typed:
        stmt = (
            f"q*(?:J{ident}{generics}(?:x{type_}(?:,{type_})*)?{otype}\n?|q{ident}{generics}={either}{end}|K?E{ident}{enum}\n?|(?:M(?:{ident}(?:\\.{ident})*|s)|q)(?:{block}|{module})\n?)|"
            f"q*a?f\\*?{ident}{generics}{params}{note}{end}|q{ambient}{end}|" + stmt
        )
    prefix = f"I{args}\n?|F(?:u)?{for_}\n?|W{args}\n?|S{args}|L\n?|D\n?"
    label = f"C{exprs}:|d:|{ident}:"
    clause = f"q?(?:{ident}|{names}|\\*j{ident})(?:,(?:{names}|\\*j{ident}))?"
    modules = f"m(?:s|{clause}rs){end}|ed(?:(?:q)?[{FUNCTION}{NAMELESS}]\n?|{exprs}{end})|eq?{names}(?:rs)?{end}|e\\*(?:j{word})?rs{end}"
    if typed:
        modules += f"|e?m{ident}={exprs}{end}|e={exprs}{end}"
    bare = f"e?{ambient}(?![=,:]){end}" if typed else never
    step = re.compile(f"(?:(?P<p>{prefix})|(?P<m>{modules})|(?P<e>e(?=[fvKcaqJM@E{FUNCTION}]))|(?P<l>{label})|(?P<s>{stmt})|(?P<c>{bare}))")
    # a file takes what a block takes, and imports and exports; a declared module takes constants without a value, too
    g.tests["{", "block"] = _sequence(step=step, without=("e", "m", "c"))
    g.top = _sequence(step=step, without=("c",))
    g.tests["{", "module"] = _sequence(step=step) if typed else (lambda s: False)
    g.tokens = lambda text: None if (flat := _JS_TOKENS(text)) is None else flat.translate(_TYPED if typed else _UNTYPED)
    return g


# ---------------------------------------------------------------- Go


def _go() -> Grammar:
    g = Grammar({"(": ["args", "params", "type", "group"], "[": ["index", "empty"], "{": ["block", "literal", "fields", "iface"]})
    words = _table(
        "P:package m:import f:func T:type S:struct N:interface v:var,const I:if L:else F:for r:range w:switch,select C:case d:default R:return B:break,continue,fallthrough G:goto D:defer,go M:map H:chan"
    )
    ops = _ops("( ) [ ] { } , ; : . + - * & = ! | ^ ~ <", {"++": "p", "--": "p", ":=": "A", "...": "V", "<-": "h"})
    ops |= dict.fromkeys("/ % << >> <= >= == != && || > &^".split(), "b") | dict.fromkeys("+= -= *= /= %= &= |= ^= <<= >>= &^=".split(), "t")
    lex = _lexer(words, ops, r"`[^`]*`|" + _STRING + r"|'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))'", _NUMBER.format("i?"), _COMMENTS)
    g.head = _head(r";*\s*package\s")
    auto = re.compile(r"(?<=[i0sBRp)\]}])\n")

    def tokens(text: str) -> str | None:
        out = lex(text)
        return None if out is None else auto.sub(";", "".join(out) + "\n").replace("\n", "")

    args, params, ptype, group = (g.cls("(", n) for n in ("args", "params", "type", "group"))
    index, empty = g.cls("[", "index"), g.cls("[", "empty")
    block, literal, fields, iface = (g.cls("{", n) for n in ("block", "literal", "fields", "iface"))
    lead = f"(?:\\*|{index}|{empty}|h?Hh?|M{index})*"
    base = f"{lead}(?:i(?:\\.i)?(?:{index})?|S{fields}|N{iface}|{ptype})"
    type_ = f"(?:{lead}f{params}(?:{base}|{params})?|{base})"
    result = f"(?:{type_}|{params})?"
    prim = f"(?:i|0|s|{args}|f{params}{result}{block}|{type_}(?:{literal}|{args})|(?:{index}|{empty}|M{index}|H){type_})"
    unary = f"(?:[-+!^*&h])*{prim}(?:\\.i|\\.{args}|\\.{ptype}|{args}|{index}|{literal})*"
    expr = f"{unary}(?:[-+*&b|^<]{unary})*"
    exprs = f"{expr}(?:,{expr})*"
    changes = f"(?:{exprs}(?<![0s])[A=t]{exprs}|{expr}p|{expr}h{expr})"
    simple = f"(?:{changes}|{expr})"
    end = "(?:;|$)"
    arg = f"(?:{expr}|{type_})V?"
    param = f"(?:i(?:,i)*V?{type_}|V?{type_})"
    spec = f"i(?:,i)*(?:{type_})?(?:={exprs})?"
    tspec = f"i(?:{index})?=?{type_}"
    bounded = f"i(?:,i)*~?{type_}(?:[|]~?{type_})*"
    g.tests = {
        ("(", "args"): _full(f"(?:{arg}(?:,{arg})*,?)?"),
        ("(", "params"): _full(f"(?:{param}(?:,{param})*,?)?"),
        ("(", "type"): _full(f"{type_}|T"),
        ("(", "group"): _full(f"(?:(?:{spec}|{tspec}|(?:i|\\.)?s){end})*"),
        ("[", "index"): _full(f"(?:{expr}|{type_})(?:,(?:{expr}|{type_}))*|(?:{expr})?:(?:{expr})?(?::{expr})?|V|{bounded}(?:,{bounded})*,?"),
        ("[", "empty"): lambda s: not s,
        ("{", "literal"): _full(f"(?:(?:(?:{expr}|{literal}):)?(?:{expr}|{literal})(?:,(?:(?:{expr}|{literal}):)?(?:{expr}|{literal}))*,?)?"),
        ("{", "fields"): _full(f"(?:(?:i(?:,i)*{type_}|\\*?i(?:\\.i)?)(?:s)?{end})*"),
        ("{", "iface"): _full(f"(?:(?:i{params}{result}|~?{type_}(?:[|]~?{type_})*){end})*"),
    }
    cond = f"(?:(?:{simple})?;)?{expr}"
    g.parts = [(re.compile(f"I{cond}{block}"), IF)]
    if_ = f"{IF}(?:L{IF})*(?:L{block})?"
    for_ = f"F(?:(?:{simple})?;(?:{expr})?;(?:{simple})?|(?:{exprs}[A=])?r{expr}|{expr})?{block}"
    decl = f"v(?:{spec}|{group})|T(?:{tspec}|{group})"
    stmt = f";|(?:{if_}|{for_}|w(?:(?:{simple})?;)?(?:{simple})?{block}|R(?:{exprs})?|B(?:i)?|Gi|D{expr}|{decl}|{changes}|{expr}(?<={args})|h+{expr}|{block}){end}"
    g.tests["{", "block"] = _sequence(stmt, label=f"C(?:{simple}|(?:{expr}|{type_})(?:,(?:{expr}|{type_}))*):|d:|i:")
    g.tokens = tokens
    rest = _sequence(f";|(?:f(?:{params})?i(?:{index})?{params}{result}(?:{block})?|{decl}){end}")
    package = re.compile(f";*Pi;(?:;|m(?:(?:i|\\.)?s|{group}){end})*")
    g.top = lambda s: (m := package.match(s)) is not None and rest(s[m.end() :]) or not s.strip(";")
    return g


# ---------------------------------------------------------------- Rust


def _rust() -> Grammar:
    g = Grammar({"(": ["args", "params", "types"], "[": ["array", "type"], "{": ["block", "arms", "fields", "literal", "tree", "enum", "items"]})
    words = _table(
        "u:use P:pub f:fn S:struct,union E:enum M:impl T:trait m:mod C:const c:static Y:type U:unsafe,async X:extern W:where k:mut r:ref L:let I:if e:else F:for n:in w:while O:loop a:match "
        "R:return B:break,continue V:move D:dyn j:as"
    )
    g.loose = "!#"
    g.head, g.last = _head(r"#!?\[|;|(?:use|pub|fn|struct|enum|impl|trait|mod|const|static|type|unsafe|async|extern|union)\b|(?:::)?[^\W\d]\w*(?:\s*::\s*\w+)*\s*!", _NESTED), ";}])"
    words.pop("union")
    union = re.compile(r"\s+[^\W\d]\w*\s*[<{]")
    ops = _ops("( ) [ ] { } , ; : ? . + - * & | = < > ! # @ $", {"::": "q", "->": "z", "=>": "Z", "..": "d", "..=": "d", "...": "d", "||": "Q"})
    ops |= dict.fromkeys("/ % ^ << <= >= == != &&".split(), "b") | dict.fromkeys("+= -= *= /= %= &= |= ^= <<=".split(), "t")
    strings = r'b?r(#*)".*?"(?P=raw)|' + r'[bc]?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))\''
    strings = strings.replace("(#*)", "(?P<raw>#*)")
    number = r"(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*|\.(?![\w.]))?(?:[eE][+-]?\d+)?)(?:[iuf](?:8|16|32|64|128|size))?(?!\w)"
    names = "|".join(re.escape(o) for o in sorted(ops, key=len, reverse=True))
    kinds = re.compile(rf"({_NESTED})|({strings})|('[^\W\d]\w*(?!'))|((?:r\#)?[^\W\d]\w*)|({number})|((?!/\*)(?:{names}))", re.S)
    rx = re.compile(rf"\s*(?:({_NESTED}|{strings}|'[^\W\d]\w*(?!')|(?:r\#)?[^\W\d]\w*|{number}|(?!/\*)(?:{names}))|\S.*)", re.S)
    maybe_union = "\uf7fe"

    def classify(token: str) -> str:
        m = kinds.match(token)
        if m[5] is not None:
            return maybe_union if token == "union" else words.get(token, "i")
        return ops[token] if m[7] is not None else "s" if m[2] is not None else "0" if m[6] is not None else "l" if m[4] is not None else ""

    classes = _Classes(classify)

    def tokens(text: str) -> str | None:
        if text.startswith("#!") and not text.startswith("#!["):
            text = text[text.find("\n") if "\n" in text else len(text) :]
        found = rx.findall(text)
        if found and not found[-1][0]:
            return None
        flat = "".join([classes[t] for t, _ in found])
        if maybe_union in flat:
            flat = "".join("S" if m[1] == "union" and union.match(text, m.end()) else "i" if m[1] == "union" else classes[m[1]] for m in rx.finditer(text))
        return None if "dd" in flat else flat  # no range follows a range

    args, params, types = (g.cls("(", n) for n in ("args", "params", "types"))
    array, btype = g.cls("[", "array"), g.cls("[", "type")
    block, arms, fields, literal, tree, enum, items = (g.cls("{", n) for n in ("block", "arms", "fields", "literal", "tree", "enum", "items"))
    anything = f"(?:{g.any('(')}|{g.any('[')}|{g.any('{')})"
    macro = f"(?:q?i(?:qi)*!i?{anything})"
    result = f"z(?:&l?k?|\\*[Ck])*(?:i(?:q?{ANGLES})?(?:qi(?:q?{ANGLES})?)*|{types}|{btype}|!)"
    path = f"(?:{ANGLES}q|q)?i(?:q?{ANGLES})?(?:qi(?:q?{ANGLES})?)*(?:{types}(?:{result})?)?"
    bound = f"\\??(?:F{ANGLES})?{path}"
    bounds = f"(?:{bound}|l|{args})(?:\\+(?:{bound}|l|{args}))*"
    type_ = f"(?:&l?k?|\\*[Ck])*(?:{macro}|(?:D|M){bounds}|{path}|{types}|{btype}|!|(?:F{ANGLES})?(?:U|X(?:s)?)*f{types}(?:{result})?)"
    garg = f"(?:l(?::l(?:\\+l)*)?|s|-?0|{block}|C?i:(?:{bounds})(?:={type_})?|{type_}(?:=(?:{type_}|0))?)"
    g.angles = re.compile(f"<(?:{garg}(?:,{garg})*,?|{type_}j{type_})?>")
    generics, gargs = f"{ANGLES}?", ANGLES
    where = f"(?:W(?:(?:F{ANGLES})?(?:{type_}|l):(?:{bounds})?,?)*)?"
    turbo = f"(?:q{gargs})"
    pat1 = f"(?:&k?)*(?:r?k?i@)?(?:r?k?{path}(?:{args}|{literal}|{fields})?|-?0(?:d(?:-?0)?)?|s(?:ds)?|{args}|{array}|d|{macro})"
    pat = f"\\|?{pat1}(?:\\|{pat1})*"
    closure = f"(?:U?V?(?:\\|(?:{pat1}(?::{type_})?(?:,{pat1}(?::{type_})?)*,?)?\\||Q)(?:z{type_}(?={block}))?)"
    value = f"(?:0|s|{macro}|(?:{ANGLES}q)?q?i(?:qi|{turbo})*(?:{literal})?|{args}|{array})"

    # where an operand that may be left out is left out
    ends = f"(?=$|[,;Z]|{block}|{arms})"

    def expression(atom: str) -> str:
        unary = f"(?:[-*!R]|Bl?|l:|&k?|b(?=[ik&])k?|d|{closure})*(?:{atom}|(?<=[RBd])l?{ends})(?:\\.i(?:{turbo})?|\\.0|{args}|{array}|\\?)*(?:j{type_})*"
        return f"{unary}(?:(?:[-+*&|<=tbQ]|>{{1,2}}=?){unary}|d(?:{unary}|{ends}))*"

    inner = expression(value)
    cond = f"(?:(?:L{pat}=)?{inner}(?:b(?=L)|(?![b])))+"
    g.parts = [
        (re.compile(f"(?:l:)?[Iw]{cond}{block}"), lambda m: IF if m[0].lstrip("l:")[0] == "I" else BLOCKLIKE),
        (re.compile(f"{IF}(?:e{IF})*(?:e{block})?|(?:l:)?(?:O{block}|F{pat}n{inner}{block}|a{inner}{arms})"), BLOCKLIKE),
    ]
    special = f"(?:{BLOCKLIKE}|(?:UV?|C)?{block})"
    expr = expression(f"(?:{special}|{value})")
    vis = f"(?:P(?:{args})?)?"
    attr = f"(?:#!?{g.any('[')})"
    fn = f"(?:[CU]|X(?:s)?)*fi{generics}{params}(?:z{type_})?{where}(?:{block}|;)"
    item = (
        f"{attr}*{vis}(?:{fn}|Si{generics}(?:{types}{where};|{args}{where};|{where}{fields}|;)|Ei{generics}{where}{enum}|U?M{generics}(?:!?{type_}F)?{type_}{where}{items}|U?Ti{generics}(?::(?:{bounds})?)?{where}{items}|"
        f"mi(?:;|{items})|u(?:q?(?:i q?)*)?q?(?:i(?:qi)*(?:q(?:\\*|{tree}))?|{tree}|\\*)(?:ji)?;|[Cc]k?i:{type_}(?:={expr})?;|Yi{generics}(?::{bounds})?{where}(?:={type_})?;|Xii?(?:ji)?;|Xs?{items})"
    ).replace("(?:i q?)*", "(?!)")
    leaf = f"q?(?:i(?:qi)*(?:q(?:\\*|{tree}))?(?:ji)?|\\*|{tree})"
    param = f"{attr}*(?:(?:&l?)?k?i(?!:)|{pat1}:{type_})"
    # an item that is both is not tried twice
    either = f"(?>(?:{expr}|{pat})(?=,|$))"
    g.tests = {
        ("(", "args"): _full(f"(?:{either}(?:,{either})*,?)?|ni(?:qi)*"),
        ("(", "params"): _full(f"(?:{param}(?:,{param})*(?:,(?:i:)?d)?,?)?"),
        ("(", "types"): _full(f"(?:{attr}*{vis}(?:i:)?{type_}(?:,{attr}*{vis}(?:i:)?{type_})*(?:,d)?,?)?"),
        ("[", "array"): _full(f"(?:{expr}(?:,{expr})*,?|{expr};{expr})?"),
        ("[", "type"): _full(f"{type_}(?:;{expr})?"),
        ("{", "fields"): _full(f"(?:{attr}*{vis}i:{type_}(?:,{attr}*{vis}i:{type_})*,?)?"),
        ("{", "literal"): _full(f"(?:(?:r?k?i|0)(?::{either})?(?:,(?:r?k?i|0)(?::{either})?)*,?)?(?:(?:^|(?<=,))d(?:{expr})?)?"),
        ("{", "tree"): _full(f"(?:{leaf}(?:,{leaf})*,?)?"),
        ("{", "enum"): _full(f"(?:{attr}*i(?:{types}|{fields})?(?:={expr})?(?:,{attr}*i(?:{types}|{fields})?(?:={expr})?)*,?)?"),
        ("{", "items"): _sequence(f"{item}|{macro};?|{attr}(?=.)"),
        ("{", "arms"): _full(f"(?:{attr}*{pat}(?:I{cond}(?=Z))?Z(?:{special},?(?=[^.?])|{special}$|{expr}(?:,|$)))*"),
    }
    stmt = f";|{attr}(?=.)|L{pat}(?::{type_})?(?:={expr}(?:e{block})?)?;|{item}|{special}(?:;|(?=[^-.?+*=<>&|bt])|$)|{macro}(?:;|(?=i))|{expr}(?:;|$)"
    g.tests["{", "block"] = _sequence(stmt)
    g.tokens = tokens
    g.top = _sequence(f";|{attr}(?=.)|{item}|{macro};?")
    return g


# ---------------------------------------------------------------- all languages


def _no_constant(name: str) -> None:
    raise ValueError(name)


_JSON = json.JSONDecoder(parse_constant=_no_constant)
_BUILT: dict[str, Grammar] = {}
_MAKERS = {"c": _c, "java": _java, "javascript": lambda: _js(False), "typescript": lambda: _js(True), "go": _go, "rust": _rust}


def grammar(language: str) -> Grammar:
    if language not in _BUILT:
        _BUILT[language] = _MAKERS[language]()
    return _BUILT[language]


_JSON_TOKEN = re.compile(r'[ \t\r\n]*(?:([\[{])|([\]}])|(,)|(:)|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|(?:true|false|null)\b)|([^ \t\r\n]))')


def _deep_json(text: str) -> bool:
    """json nested to any depth, which the interpreter's parser doesn't read."""
    stack: list[str] = []
    before = ""  # "" a value has to follow, v it has ended, [ and { just opened, k after a key, : and , as they are
    for m in _JSON_TOKEN.finditer(text):
        kind = m.lastindex
        wants_key = bool(stack) and stack[-1] == "{" and before in ("{", ",")
        wants_value = not wants_key and before in ("", "[", ":", ",")
        if kind == 1 and wants_value:
            before = m[1]
            stack.append(before)
        elif kind == 2 and stack and (stack[-1] == "[") == (m[2] == "]") and before in ("v", stack[-1]):
            stack.pop()
            before = "v"
        elif kind == 3 and stack and before == "v":
            before = ","
        elif kind == 4 and before == "k":
            before = ":"
        elif kind == 5 and (wants_key or wants_value):
            before = "k" if wants_key else "v"
        elif kind == 6 and wants_value:
            before = "v"
        else:
            return False
    return before == "v" and not stack


# Beginnings that no Python file has, after comments: another comment mark, a name after a name, an import of no name. The
# interpreter's parser finds them, too, but reads the whole text for its message. A declared encoding may change the text.
_RESERVED = "|".join(keyword.kwlist + keyword.softkwlist)
_NO_PYTHON = re.compile(rf"(?:[ \t]*(?:#(?![^\n]*coding)[^\n]*)?\r?\n)*+(?://|/\*|import[ \t]*[{{*\"']|(?!(?:{_RESERVED})\b)[A-Za-z_]\w*[ \t]+(?!(?:{_RESERVED})\b)[A-Za-z_]\w*(?![\w\"']))", re.A)


def check_all(raw: bytes, order: list[str]) -> dict[str, bool | None]:
    """check() of every language in order. The syntax of typescript includes that of javascript, so what the latter accepts isn't parsed again."""
    try:
        text = raw.decode("utf-8-sig")
    except ValueError:
        text = None
    found: dict[str, bool | None] = {}
    for language in sorted(order, key="typescript".__eq__):  # after javascript
        found[language] = language == "typescript" and found.get("javascript") or check(raw, language, text)
    return {language: found[language] for language in order}


def check(raw: bytes, language: str, text: str | None = None) -> bool | None:
    """Whether raw (text, if it is utf-8 and decoded before) is a syntactically valid file of the language; an empty file is, except in json. None if the parser ran out of its means."""
    try:
        if language == "python":
            if text is not None and _NO_PYTHON.match(text):
                return False
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(raw, "file", "exec", dont_inherit=True)
            return True
        text = raw.decode("utf-8-sig") if text is None else text
        if language == "json":
            try:
                _JSON.decode(text)
            except RecursionError:
                return _deep_json(text)
            return True
        if language == "toml":
            tomllib.loads(text)
            return True
        return "\0" not in text and grammar(language).parses(text)
    except (RecursionError, MemoryError):
        return None
    except (SyntaxError, ValueError, OverflowError):
        return False


def is_valid(raw: bytes, language: str) -> bool:
    return check(raw, language) is True


#: Words and marks that tell languages apart in the ranking of candidates. Fixed values.
MARKERS: dict[str, frozenset[bytes]] = {
    "python": frozenset(b"def self None elif except lambda import from True False raise with pass".split()),
    "rust": frozenset(b"fn let pub use impl match mut crate usize struct enum mod".split()),
    "javascript": frozenset(b"const function require export import let null this undefined typeof constructor".split()),
    "typescript": frozenset(b"interface string number export const type boolean import readonly Promise".split()),
    "go": frozenset(b"func package import fmt nil range type struct defer chan".split()),
    "java": frozenset(b"public private class static package import final void String List boolean".split()),
    "c": frozenset(b"include static const char int struct void printf define typedef sizeof".split()),
    "json": frozenset(b"true false null".split()),
    "toml": frozenset(b"true false".split()),
}
_OWNERS = {w: [lang for lang, marks in MARKERS.items() if w in marks] for w in frozenset().union(*MARKERS.values())}
#: Bytes that no word has, as blanks.
_LETTERS = bytes(c if chr(c).isascii() and (chr(c).isalpha() or c == ord("_")) else ord(" ") for c in range(256))


def ranked(raw: bytes) -> list[str]:
    """Languages by the share of their marker words among the tokens, best first; ties in the order of LANGUAGES."""
    words = raw.translate(_LETTERS).split()
    held = Counter(words)
    score = dict.fromkeys(LANGUAGES, 0)
    for w in _OWNERS.keys() & held.keys():
        for lang in _OWNERS[w]:
            score[lang] += held[w]
    start = raw.lstrip()[:1]
    if start in (b"{", b"["):
        score["json" if start == b"{" or b"=" not in raw else "toml"] += len(words) + 1
    return sorted(LANGUAGES, key=lambda lang: -score[lang])
