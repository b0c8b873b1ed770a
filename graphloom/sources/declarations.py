"""What source files declare, import and call, by language.

A handler gets the text of a file and gives rows (kind, name, parent, line). Languages with a parser in the standard library
are in files.py; here are those that are read line by line: a line's parent is the last declaration above it that is
indented less. register() adds a language or replaces one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

Row = tuple[str, str, str, int]
Handler = Callable[[str], list[Row]]

_HANDLERS: dict[str, Handler] = {}
_EXTENSIONS: dict[str, str] = {}


def register(language: str, handler: Handler, extensions: Iterable[str] = ()) -> None:
    """Make a language known, under the extensions of its files. Workers import this module anew: register in a module of theirs."""
    _HANDLERS[language] = handler
    _EXTENSIONS.update({e.lower().lstrip("."): language for e in extensions})


def handler(language: str) -> Handler | None:
    return _HANDLERS.get(language)


def language_of(path: str) -> str | None:
    return _EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def languages() -> list[str]:
    return sorted(_HANDLERS)


_STRINGS = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`")
_CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_][\w$]*(?:\.|::|->))*)([A-Za-z_]\w*)\s*(?:::<[^>]*>)?\(")
#: Words before a bracket that call nothing. Fixed values.
_NO_CALL = frozenset(
    "if for while switch match catch return sizeof typeof and or not elif else do in new function fn func def defer go await yield throw with foreach using lock fixed unless until case when assert super this self".split()
)
#: Kinds that hold methods.
_CLASSES = ("class", "struct", "trait", "interface", "impl", "enum", "object", "record")
_PUBLIC = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|virtual|async|readonly|partial|synchronized|native|default|implicit|lazy|case|open|unsafe|extern|inline|constexpr|explicit|friend)\s+)*"


def lines(declared: list[tuple[str, str]], imports: list[str], comment: str, calls: bool = True) -> Handler:
    """Handler of a language from its patterns, each matched at a line's first character. declared: kind and pattern with the name as its group."""
    rules = [(kind, re.compile(p)) for kind, p in declared]
    taken = [re.compile(p) for p in imports]
    remark = re.compile(comment)

    def run(text: str) -> list[Row]:
        out: list[Row] = []
        above: list[tuple[int, str, str]] = []
        for number, line in enumerate(text.split("\n"), 1):
            bare = line.strip()
            if not bare or remark.match(bare):
                continue
            indent = len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
            while above and above[-1][0] >= indent:
                above.pop()
            parent, inside = (above[-1][1], above[-1][2]) if above else ("", "")
            found = next(((kind, m[1]) for kind, p in rules if (m := p.match(bare)) and m[1] not in _NO_CALL), None)
            if found:
                kind, name = found
                if kind == "method" and inside not in _CLASSES:
                    found = None
                elif kind == "receiver" or kind == "function" and inside in _CLASSES:
                    kind = "method"
            if found:
                out.append((kind, name, parent, number))
                above.append((indent, name, kind))
                continue
            source = next((m[1] for p in taken if (m := p.match(bare))), None)
            if source is not None:
                out.append(("import", source, parent, number))
            elif calls:
                out += [("call", m[2], parent, number) for m in _CALL.finditer(_STRINGS.sub('""', bare)) if m[2] not in _NO_CALL]
        return out

    return run


def _markdown(text: str) -> list[Row]:
    """Headings with the one above as parent, code fences by their language, and the targets of links."""
    out: list[Row] = []
    above: list[tuple[int, str]] = []
    fence = ""
    for number, line in enumerate(text.split("\n"), 1):
        mark = re.match(r" {0,3}(```+|~~~+)\s*(\S*)", line)
        parent = above[-1][1] if above else ""
        if fence:
            fence = "" if mark and mark[1].startswith(fence) and not mark[2] else fence
        elif mark:
            fence = mark[1]
            out.append(("code", mark[2] or "text", parent, number))
        elif head := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line):
            slug = re.sub(r"\s+", "-", re.sub(r"[^\w\s-]", "", head[2].lower()).strip())
            while above and above[-1][0] >= len(head[1]):
                above.pop()
            out.append(("heading", slug, above[-1][1] if above else "", number))
            above.append((len(head[1]), slug))
        else:
            out += [("import", m, parent, number) for m in re.findall(r"\]\(([^()\s]+)", line)]
    return out


_C_TYPE = r"(?:(?:static|inline|extern|const|unsigned|signed|volatile|virtual|explicit|constexpr|friend|struct|enum|union)\s+)*[A-Za-z_][\w:<>, ]*[\s*&]+"
_C_LIKE = [("struct", r"(?:typedef\s+)?struct\s+(\w+)\s*\{?\s*$"), ("enum", r"(?:typedef\s+)?enum\s+(?:class\s+)?(\w+)"), ("function", rf"(?!return\b|else\b|typedef\b|using\b|new\b){_C_TYPE}([A-Za-z_][\w:~]*)\s*\([^;]*\)?\s*(?:const\s*)?(?:override\s*)?\{{?\s*$")]
_JS = [
    ("function", r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"),
    ("class", r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("function", r"(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)(?:\s*:[^=]+)?|[A-Za-z_$][\w$]*)\s*=>"),
    ("constant", r"(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*[:=]"),
    ("method", r"(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+|\*\s*)*(#?[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^;]*\{\s*$"),
]
_TS = [("interface", r"(?:export\s+)?(?:declare\s+)?interface\s+([A-Za-z_$][\w$]*)"), ("enum", r"(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)"), ("type", r"(?:export\s+)?(?:declare\s+)?type\s+([A-Za-z_$][\w$]*)"), ("module", r"(?:export\s+)?(?:declare\s+)?(?:namespace|module)\s+([\w$.]+)")]
_JS_IMPORTS = [r"import\b[^'\"]*['\"]([^'\"]+)", r"export\b[^'\"]*\bfrom\s*['\"]([^'\"]+)", r".*\brequire\(\s*['\"]([^'\"]+)"]
_JVM = [("class", rf"{_PUBLIC}class\s+(\w+)"), ("interface", rf"{_PUBLIC}@?interface\s+(\w+)"), ("enum", rf"{_PUBLIC}enum\s+(\w+)"), ("record", rf"{_PUBLIC}record\s+(?:struct\s+)?(\w+)")]
_BRACE_METHOD = rf"{_PUBLIC}(?!return\b|new\b|else\b|throw\b)(?:[\w.<>\[\],?]+\s+)?([A-Za-z_]\w*)\s*\([^;]*\)?[^;=]*\{{?\s*$"
_SLASHES = r"//|/\*|\*"

register("rust", lines(
    [("function", r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)"), ("struct", r"(?:pub(?:\([^)]*\))?\s+)?(?:struct|union)\s+(\w+)"), ("enum", r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait", r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)"),
     ("impl", r"(?:unsafe\s+)?impl\b(?:<[^>]*>)?\s+(?:.+\s+for\s+)?([A-Za-z_]\w*)"), ("module", r"(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)"), ("constant", r"(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(\w+)\s*:"), ("type", r"(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)")],
    [r"(?:pub(?:\([^)]*\))?\s+)?use\s+([\w:]+)", r"extern\s+crate\s+(\w+)"], _SLASHES), ["rs"])
register("go", lines(
    [("receiver", r"func\s+\([^)]*\)\s*(\w+)"), ("function", r"func\s+(\w+)"), ("struct", r"type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b"), ("type", r"type\s+(\w+)"), ("constant", r"const\s+(\w+)")],
    [r"import\s+(?:[\w.]+\s+)?\"([^\"]+)\"", r"(?:[\w.]+\s+)?\"([^\"\s]+)\"$"], _SLASHES), ["go"])
register("javascript", lines(_JS, _JS_IMPORTS, _SLASHES), ["js", "mjs", "cjs", "jsx"])
register("typescript", lines(_TS + _JS, _JS_IMPORTS, _SLASHES), ["ts", "mts", "cts", "tsx"])
register("java", lines([*_JVM, ("method", _BRACE_METHOD), ("module", r"package\s+([\w.]+)")], [r"import\s+(?:static\s+)?([\w.*]+)"], _SLASHES), ["java"])
register("csharp", lines([*_JVM, ("struct", rf"{_PUBLIC}struct\s+(\w+)"), ("module", r"namespace\s+([\w.]+)"), ("method", _BRACE_METHOD)], [r"(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;"], _SLASHES), ["cs"])
register("scala", lines([("class", rf"{_PUBLIC}class\s+(\w+)"), ("object", rf"{_PUBLIC}object\s+(\w+)"), ("trait", rf"{_PUBLIC}trait\s+(\w+)"), ("enum", rf"{_PUBLIC}enum\s+(\w+)"), ("function", rf"{_PUBLIC}def\s+(\w+)"), ("constant", rf"{_PUBLIC}val\s+(\w+)"), ("module", r"package\s+([\w.]+)")], [r"import\s+([\w.{}, *]+)"], _SLASHES), ["scala", "sc"])
register("php", lines([("class", rf"{_PUBLIC}class\s+(\w+)"), ("interface", r"interface\s+(\w+)"), ("trait", r"trait\s+(\w+)"), ("enum", r"enum\s+(\w+)"), ("function", rf"{_PUBLIC}function\s+&?(\w+)"), ("module", r"namespace\s+([\w\\]+)"), ("constant", rf"{_PUBLIC}const\s+(\w+)")], [r"use\s+([\w\\]+)", r"(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)"], r"//|#|/\*|\*|<\?|\?>"), ["php"])
register("c", lines(_C_LIKE, [r"#\s*include\s*[<\"]([^>\"]+)"], _SLASHES), ["c", "h"])
register("cpp", lines([("class", r"(?:template\s*<[^>]*>\s*)?class\s+(\w+)"), ("module", r"namespace\s+([\w:]+)"), *_C_LIKE], [r"#\s*include\s*[<\"]([^>\"]+)", r"using\s+(?:namespace\s+)?([\w:]+)\s*;"], _SLASHES), ["cpp", "cc", "cxx", "hpp", "hh", "hxx"])
register("ruby", lines([("class", r"class\s+([\w:]+)"), ("module", r"module\s+([\w:]+)"), ("function", r"def\s+(?:self\.)?([\w?!=]+)")], [r"require(?:_relative)?\s*\(?\s*['\"]([^'\"]+)", r"(?:include|extend|prepend)\s+([\w:]+)"], r"#"), ["rb"])
register("bash", lines([("function", r"(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)"), ("function", r"function\s+([A-Za-z_][\w-]*)"), ("constant", r"(?:readonly|export|declare(?:\s+-\w+)*)\s+([A-Za-z_]\w*)=")], [r"(?:source|\.)\s+['\"]?([^'\"\s]+)"], r"#"), ["sh", "bash"])
register("css", lines([("rule", r"([.#]?[\w-][^{;@]*?)\s*\{"), ("rule", r"(@(?:media|supports|keyframes|font-face)[^{]*?)\s*\{"), ("constant", r"(--[\w-]+)\s*:")], [r"@import\s+(?:url\()?\s*['\"]?([^'\")\s;]+)"], r"/\*|\*", calls=False), ["css"])
register("markdown", _markdown, ["md", "markdown"])
