"""Generated, minified and vendored source files, and data saved as code.

Recurring text is found by winnowing: the token stream without comments, its literals normalised, is hashed in k-grams,
and the least hash of every window is a fingerprint. A file whose fingerprints largely recur in many unrelated
repositories, or in files known to be vendored, is a vendored copy; one that recurs because it is little else than
literals, as an exact check of its text confirms, is dumped data. A file's path and the banners in its comments declare
the other kinds, its form shows lock files, minified scripts and the counters of generators.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.parsecheck import language_of
from graphloom.session import cut_lineage, spread

#: Tokens in a hashed k-gram, and k-grams in a winnowing window: any copied run of K + WINDOW - 1 tokens shares a fingerprint.
#: Both are 16: sums and minima are doubled four times.
K = 16
WINDOW = 16
#: Repositories that must hold a fingerprint for it to recur, share of a file's windows that must, and fewest distinct fingerprints that tell a copy from a common phrase.
MIN_REPOS = 5
#: Repositories for the text of a dump, which is checked exactly afterwards: its own and another.
DUMP_REPOS = 2
MIN_SHARE = 0.8
MIN_PRINTS = 6
#: Parts into which the files that hold one fingerprint are split, so that a fingerprint of every second file is looked up in several tasks.
SALTS = 8
#: Numbers, or characters of encoded text, that a dump has at least; records of a table.
DUMP_NUMBERS, DUMP_CHARS, DUMP_RECORDS = 60, 480, 8
#: Tokens whose codes a worker remembers.
CACHED_TOKENS = 1_000_000

# Folders in which package managers and vendoring tools place copies.
_VENDOR_PATH = re.compile(
    r"(?:^|/)(?:third[_-]?party|node_modules|bower_components|jspm_packages|Pods|Carthage|_vendor|site-packages|dist-packages)/|(?:^|/)vendor/[^/]+|(?:^|/)(?:deps|extern|externals?|vendored)/[^/]+/",
)
# Names that code generators give their output.
_GENERATED_NAME = re.compile(
    r"(?:\.pb\.go|\.pb-c\.[ch]|\.pb\.(?:cc|h)|_pb2(?:_grpc)?\.pyi?|(?:_pb|_pb_service|_grpc_pb)\.[jt]s|OuterClass\.java|\.(?:g|gen|generated|autogen|designer)\.[A-Za-z]+|\.tab\.[ch]|lex\.yy\.c"
    r"|[_-](?:generated|autogen)\.[A-Za-z]+|(?:^|/)zz_generated[^/]*|_string\.go)$"
)
_MIN_NAME = re.compile(r"[.-]min\.(?:js|mjs|cjs)$|\.bundle\.js$")
_LOCK_NAME = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|[^/]*[.-]lock\.(?:json|toml)|(?:Cargo|poetry|uv|Pipfile)\.lock)$")

# The phrases by which tools mark their output; each has to begin a comment line or name the tool.
_GENERATED_BANNER = re.compile(
    rb"code generated by [^\n]{1,80}?\bdo not (?:edit|modify)|(?:this|the) (?:file|code|class|module) (?:was|is|has been) (?:auto(?:matically)?[- ]?)generated|"
    rb"(?:this|the) (?:file|code|class|module) (?:was|is|has been) generated (?:by|from|with)|^\W*auto[- ]?generated (?:file|code|by|from|with|using)\b|^\W*autogenerated\b|<auto-generated>|@generated\b|"
    rb"^\W*generated (?:file|code|source)\b|^\W*generated (?:by|from|with) \S+ |^\W*machine[- ](?:written|generated|made) (?:by|from|with)\b|"
    rb"^\W*do not (?:edit|modify)(?: this file| by hand| manually)?\W*$|changes (?:made )?(?:here|to this file) (?:will|may) be (?:lost|overwritten)|manual (?:edits|changes) (?:are|will be) (?:overwritten|lost)|"
    rb"^\W*regenerate (?:with|using|by)\b|automatisch (?:erzeugt|generiert|erstellt)|g\xc3\xa9n\xc3\xa9r\xc3\xa9(?:e)? automatiquement|generad[oa] autom\xc3\xa1ticamente",
    re.I | re.M,
)
# The phrases by which copies name where they come from.
_VENDOR_BANNER = re.compile(
    rb"imported unchanged from|\bupstream-version:|^\W*upstream: *\S+/\S+|\bimported-by:|\bvendored (?:from|copy)\b|\bupstream build\b|local (?:fixes|changes) go upstream|"
    rb"^\W*\(c\) the [\w.-]+ (?:contributors|authors|developers)\b|copyright (?:\(c\) )?[\d, -]+ (?:the )?[\w.-]+ (?:authors|contributors|developers)\b|released under [^\n]{1,60}licen[cs]e-[\w.-]+|"
    rb"redistribution in source and (?:compiled|binary) forms? is permitted",
    re.I | re.M,
)
# Of those phrases the ones that speak of the whole file wherever they stand; between lines of code the others may speak of the line below.
_ANYWHERE_BANNER = re.compile(
    rb"^\W*code generated by [^\n]{1,80}?\bdo not (?:edit|modify)|^\W*(?:this|the) file (?:was|is|has been) (?:auto(?:matically)?[- ]?)generated\b|^\W*auto[- ]?generated file\b|^\W*<auto-generated>|^\W*@generated\b|"
    rb"^\W*generated file\b[^\n]{0,80}?\b(?:do not (?:edit|modify)|overwritten|lost)\b|^\W*(?:generated|machine[- ](?:written|generated|made)) (?:by|from|with) \S+ [^\n]{0,80}?\bdo not (?:edit|modify)",
    re.I | re.M,
)
_ANYWHERE_VENDOR = re.compile(rb"^\W*(?:this file (?:was|is) )?(?:imported unchanged from|vendored (?:from|copy of) \S+[/@]\S+|upstream-version:|imported-by:)", re.I | re.M)
# Every banner has one of these, lower-cased; a text without them needs no search for its comments.
_BANNER_WORDS = re.compile(
    rb"generat|do not (?:edit|modify)|machine[- ]|(?:be|are) (?:lost|overwritten)|automatisch|automatiquement|autom\xc3\xa1ticamente|upstream|imported|vendored|\(c\) the|copyright|released under|redistribution in"
)
_BANNER_PARTS = (b"generat", b"do not ", b"machine", b"lost", b"overwritten", b"autom", b"upstream", b"imported", b"vendored", b"(c) the", b"copyright", b"released under", b"redistribution in")
_LOCK_JSON = re.compile(rb'\A\s*\{\s*(?:"[^"]*"\s*:\s*(?:"[^"]*"|\d+|true|false)\s*,\s*)*"lockfileVersion"\s*:')
_LOCK_TOML = re.compile(rb'^\[\[package\]\]\s*\r?\nname = "[^"\n]*"\r?\nversion = "[^"\n]*"\r?\n(?:source = "[^"\n]*"\r?\n)?checksum = ', re.M)
# A shorter run is passed over as a whole.
_LONG_STRING = re.compile(rb"([A-Za-z0-9+/=_-]{40,}|(?:\\x[0-9a-fA-F]{2}){12,})|[A-Za-z0-9+/=_-]++")
_NUMBER = re.compile(rb"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)(?:[uUlLfF]|[iuf]\d+)?(?![\w.])")
_DIGITS = b"0123456789"
_BLANKS = b" \t\r\n\f"
_SHAPE = re.compile(rb"0[xX][0-9a-fA-F]+|\d+|\"[^\"\n]*\"|'[^'\n]*'")
_COUNTER = re.compile(rb"[A-Za-z_]\w*?(\d{3,})\b")


_RECORD = re.compile(rb"^[ \t]*\d+(?:,[^,\r\n\"'(){}\[\];=:]*){2,}$", re.M)
_BINARY = re.compile(rb"[\x00-\x08\x0e-\x1a\x1c-\x1f]")


def _is_table(raw: bytes) -> bool:
    """Whether the text is a table without code: records of equally many fields under a running number."""
    found = _RECORD.findall(raw)
    if len(found) < DUMP_RECORDS:
        return False
    lines = sum(1 for x in raw.split(b"\n") if x.strip())
    keys = [int(r.split(b",", 1)[0]) for r in found]
    steps = sum(y - x == 1 for x, y in zip(keys, keys[1:]))
    return len(found) >= 0.8 * lines and steps >= 0.8 * (len(keys) - 1) and len({r.count(b",") for r in found}) == 1


def form_of(raw: bytes, language: str | None) -> str | None:
    """data, minified, lock or generated if the form of the text alone shows it."""
    size = len(raw)
    digits = size - len(raw.translate(None, _DIGITS))
    if digits > 0.12 * size:
        numbers = [len(n) for n in _NUMBER.findall(raw)]
        code = len(raw.translate(None, _BLANKS))
        if len(numbers) >= DUMP_NUMBERS and sum(numbers) > 0.5 * code or _is_table(raw):
            return "data"
    encoded = sum(map(len, _LONG_STRING.findall(raw)))
    if encoded >= DUMP_CHARS and encoded > 0.6 * size:
        return "data"
    if language == "json":
        return "lock" if _LOCK_JSON.match(raw) else None
    if language == "toml":
        return "lock" if _LOCK_TOML.search(raw) and raw.count(b"[[package]]") * 3 >= raw.count(b"\n[") else None
    if language in ("javascript", "typescript"):
        blanks = size - len(raw.translate(None, _BLANKS))
        if blanks < 0.06 * size and size > 120 * (raw.rstrip().count(b"\n") + 1) and not _BINARY.search(raw):
            return "minified"
    counters = _COUNTER.findall(raw) if digits > 0.04 * size else ()
    if len(counters) >= 8:
        numbers = sorted({int(c) for c in counters})
        runs = sum(b - a == 1 for a, b in zip(numbers, numbers[1:]))
        if runs >= 6 and runs >= 0.6 * (len(numbers) - 1):
            shapes = [s for s in (_SHAPE.sub(b"0", line.strip()) for line in raw.split(b"\n")) if s]
            if len({re.sub(rb"\w*0\w*", b"0", s) for s in shapes}) <= 0.34 * len(shapes):
                return "generated"
    return None


def utf8(raw: bytes) -> bytes:
    return raw.decode("utf-16", "replace").encode() if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else raw


def declared(raw: bytes, path: str | None, language: str | None) -> str | None:
    """What path or banner (of a UTF-8 text) say a file is: generated, minified, vendored or lock; else None."""
    path = path or ""
    if _VENDOR_PATH.search(path):
        return "vendored"
    if _GENERATED_NAME.search(path):
        return "generated"
    if language in (None, "javascript") and _MIN_NAME.search(path):
        return "minified"
    if language in (None, "json", "toml") and _LOCK_NAME.search(path):
        return "lock"
    return banner(raw, language)


def evidence(raw: bytes, path: str | None, language: str | None) -> str | None:
    """What path, banner or form of one file alone say, without a look at other files."""
    raw = utf8(raw)
    return declared(raw, path, language) or form_of(raw, language)


def banner(raw: bytes, language: str | None) -> str | None:
    """generated or vendored by the comments of the text, of any length, that stand on lines of their own.

    Before the first and after the last line of code every banner counts; between lines of code the ones that name the whole
    file. A comment mark within a string begins no comment.
    """
    lower = raw.lower()
    if not any(part in lower for part in _BANNER_PARTS) or not _BANNER_WORDS.search(lower):
        return None
    ends, inner = _comments(raw, language)
    if language in _COMMENTS:
        ends += _comments(raw, None)[0]  # the extension may be wrong
    for generated, vendored, lines in ((_GENERATED_BANNER, _VENDOR_BANNER, _comment_head(raw) + ends), (_ANYWHERE_BANNER, _ANYWHERE_VENDOR, inner)):
        lines = [x for x in lines if _BANNER_WORDS.search(x.lower())]
        if any(map(generated.search, lines)):
            return "generated"
        if any(map(vendored.search, lines)):
            return "vendored"
    return None


_SLASHES = rb"(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z))"
_HASHES = rb"(?P<comment>#[^\n]*)"
# A string without end takes the rest of its line or text, so that no start is tried twice.
_QUOTED = rb'"(?:\\.|[^"\\\n])*+"?'
_SINGLE = rb"'(?:\\.|[^'\\\n])*+'?"
_TRIPLE = rb'"""(?:\\.|[^"\\]|"(?!""))*+(?:"""|\Z)'
_TRIPLE_SINGLE = rb"'''(?:\\.|[^'\\]|'(?!''))*+(?:'''|\Z)"
_CHAR = rb"'(?:\\[^\n]{1,9}?|[^'\\\n]{1,4})'"  # Rust writes lifetimes with one mark
_BACKTICK = rb"`(?:\\.|[^`\\])*+`?"
_RAW_TICK = rb"`[^`]*+`?"
_RAW_RUST = rb'\br(?P<h>#{0,8})"[\s\S]*?(?:"(?P=h)|\Z)'
# Comments and strings by language; what begins first decides, so that each is skipped as a whole.
_COMMENTS = {
    name: re.compile(b"|".join(parts), re.S)
    for name, parts in {
        "python": (_TRIPLE, _TRIPLE_SINGLE, _QUOTED, _SINGLE, _HASHES),
        "toml": (_TRIPLE, _TRIPLE_SINGLE, _QUOTED, rb"'[^'\n]*+'?", _HASHES),
        "c": (_QUOTED, _CHAR, _SLASHES),
        "java": (_TRIPLE, _QUOTED, _CHAR, _SLASHES),
        "rust": (_RAW_RUST, rb'"(?:\\.|[^"\\])*+"?', _CHAR, _SLASHES),
        "go": (_RAW_TICK, _QUOTED, _CHAR, _SLASHES),
        "javascript": (_BACKTICK, _QUOTED, _SINGLE, _SLASHES),
        "typescript": (_BACKTICK, _QUOTED, _SINGLE, _SLASHES),
        "json": (_QUOTED, _SLASHES),
        None: (_QUOTED, _SLASHES, rb"(?:(?<=\n)|\A)[ \t]*(?P<line>(?:#|--|;|<!--)[^\n]*)"),
    }.items()
}


def _comments(raw: bytes, language: str | None) -> tuple[list[bytes], list[bytes]]:
    """Lines of the comments after the last line of code, and of those between, that stand on lines of their own."""
    found = []
    for m in _COMMENTS.get(language, _COMMENTS[None]).finditer(raw):
        if m.lastgroup in ("comment", "line"):
            lo = m.start(m.lastgroup)
            if not raw[raw.rfind(b"\n", 0, lo) + 1 : lo].strip(b" \t\xef\xbb\xbf"):
                found.append((lo, m.end()))
    end, tail = _code_end(raw, len(raw)), len(found)
    while tail and found[tail - 1][1] >= end:
        tail -= 1
        end = _code_end(raw, found[tail][0])
    lines = lambda parts: [x.strip() for lo, hi in parts for x in raw[lo:hi].split(b"\n")]
    return lines(found[tail:]), lines(found[:tail])


def _code_end(raw: bytes, at: int) -> int:
    while at and raw[at - 1 : at].isspace():
        at -= 1
    return at


def _comment_head(head: bytes) -> list[bytes]:
    """The comment lines before the first line of code."""
    out: list[bytes] = []
    block = False
    at = 0
    while at < len(head):
        end = head.find(b"\n", at)
        end = len(head) if end < 0 else end
        line, at = head[at:end], end + 1
        bare = line.strip().removeprefix(b"\xef\xbb\xbf")
        if not bare:
            continue
        if block or bare.startswith((b"//", b"/*", b"*", b"#", b"--", b";", b"<!--")) and not bare.startswith((b"#include", b"#define", b"#if", b"#!", b"#[")):
            block = (block or bare.startswith(b"/*")) and b"*/" not in bare
            out.append(bare)
        elif bare.startswith(b"#!") and not out:
            continue
        else:
            break
    return out


# Every alternative begins with a character or class, by which others are passed over; blanks go with the token
# before them unless a # follows.
_TOKEN = re.compile(
    rb"(?://[^\n]*|/\*.*?(?:\*/|\Z)|#(?<![^\n]#)(?!include|define|if|end|else|\[)[^\n]*|[ \t](?<![^\n][ \t])[ \t]*#(?!include|define|if|end|else|\[)[^\n]*"
    rb"|(\"(?:\\.|[^\"\\\n])*+\"(?:\s*:)?|'(?:\\.|[^'\\\n(){}\[\];<>])*+'|-?\d[\w.]*|[A-Za-z_]\w*|[^\s\w]))(?:\s*+(?!#))?",
    re.S,
)
#: Stands for a comment; no token has this code.
_NO_TOKEN = 1 << 63
_POWERS = {step: np.uint64(pow(0x9E3779B97F4A7C15, step, 1 << 64)) for step in (1, 2, 4, 8)}
_FIRST = np.ones(1, dtype=bool)
_IS_NUMBER = re.compile(rb"\s*-?\d[\w.]*\s*\Z")


class _Codes(dict):
    """Token to number: all numbers alike, all strings but keys alike."""

    def __missing__(self, token: bytes) -> int:
        if not token:
            code = _NO_TOKEN
        elif token[:1].isdigit() or token[:1] == b"-" and len(token) > 1:
            code = zlib.crc32(b"0")
        elif token[:1] in (b'"', b"'") and len(token) > 1 and token[-1:] != b":":
            code = zlib.crc32(b'""')
        else:
            code = zlib.crc32(token)
        if len(token) <= 32:
            if len(self) >= CACHED_TOKENS:
                self.clear()
            self[token] = code
        return code


_CODES = _Codes()


def _record(found: re.Match) -> bytes:
    """A record of a table as literals."""
    return b",".join(b"0" if _IS_NUMBER.match(x) else b'""' for x in found[0].split(b","))


def winnow(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct winnowed fingerprints (int64) of the token stream without comments and blanks, and how many windows chose each."""
    tokens = _TOKEN.findall(_RECORD.sub(_record, raw))
    codes = np.fromiter(map(_CODES.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    codes = codes[codes != _NO_TOKEN]
    if len(codes) < K:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # sums over K tokens and minima over WINDOW sums, both from those over half as many
    grams = codes
    for step, power in _POWERS.items():
        grams = grams[:-step] + grams[step:] * power
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    if len(grams) > WINDOW:
        for step in (1, 2, 4, 8):
            grams = np.minimum(grams[:-step], grams[step:])
    else:
        grams = grams.min(keepdims=True)
    grams.sort()
    starts = np.flatnonzero(np.concatenate([_FIRST, grams[1:] != grams[:-1]]))
    return grams[starts].view(np.int64), np.diff(starts, append=len(grams))


def fingerprints(raw: bytes) -> np.ndarray:
    return winnow(raw)[0]


_JUDGED = "work_id long, repo_id long, declared string, form string, prints array<struct<print:long,windows:long>>"


def judge_files(files: DataFrame) -> DataFrame:
    """work_id, repo_id, declared, form, prints: what path or banner and what the form of each file with bytes say, and its fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, langs, raws = (batch.column(i).to_pylist() for i in (2, 3, 4))
            raws = [utf8(raw) for raw in raws]
            said = [declared(raw, path, lang) for raw, path, lang in zip(raws, paths, langs)]
            forms = [form_of(raw, lang) if kind is None else None for raw, lang, kind in zip(raws, langs, said)]
            found = [winnow(raw) for raw in raws]
            ends = np.cumsum([0, *(len(p) for p, _ in found)])
            none = [np.zeros(0, dtype=np.int64)]
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(none + [x[i] for x in found])) for i in (0, 1)], names=["print", "windows"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(forms, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                names=["work_id", "repo_id", "declared", "form", "prints"],
            )

    rows = files.filter(F.col("bytes").isNotNull()).select("work_id", "repo_id", "rel_path", language_of(F.col("orig_language"), F.col("rel_path")).alias("language"), "bytes")
    return spread(rows).mapInArrow(run, _JUDGED)


def recurring(judged: DataFrame, min_repos: int = MIN_REPOS, min_share: float = MIN_SHARE, min_prints: int = MIN_PRINTS, dump_repos: int = DUMP_REPOS) -> DataFrame:
    """work_id and kind of the undeclared files whose fingerprints largely recur.

    A fingerprint recurs if at least min_repos repositories hold it, counted over all files whatever they are, the file's
    own repository among them. Files are data if min_share of their windows recur, here in dump_repos repositories, and
    their form is that of a dump (form data); vendored if min_share of at least min_prints distinct fingerprints recur, or are held by files that path
    or banner declare to be vendored, of any repository.
    """
    held = judged.select("repo_id", F.col("declared").eqNullSafe("vendored").alias("known"), F.explode("prints.print").alias("print"))
    by_repo = held.groupBy("print", "repo_id").agg(F.max("known").alias("known"))
    counted = by_repo.groupBy("print").agg((F.count(F.lit(1)) >= min_repos).alias("often"), (F.count(F.lit(1)) >= dump_repos).alias("again"), F.max("known").alias("known"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    known = counted.filter("often OR again OR known").select("print", "often", "again", "known", salts)
    asked = (
        judged.filter(F.col("declared").isNull() & (F.col("form").isNull() | (F.col("form") == "data")))
        .withColumn("row", F.monotonically_increasing_id())  # before the rows are multiplied
        .select(
            "row",
            "work_id",
            "form",
            F.size("prints").alias("distinct"),
            F.aggregate("prints.windows", F.lit(0).cast("long"), lambda a, n: a + n).alias("all_windows"),
            F.explode("prints").alias("p"),
        )
        .select("row", "work_id", "form", "distinct", "all_windows", "p.print", "p.windows", F.pmod(F.hash("row"), F.lit(SALTS)).alias("salt"))
    )
    shares = (
        asked.join(known, ["print", "salt"])
        .groupBy("row", "work_id", "form", "distinct", "all_windows")
        .agg(F.sum(F.when(F.col("again"), F.col("windows")).otherwise(0)).alias("windows"), F.count_if("often").alias("often"), F.count_if("known").alias("known"))
    )
    dumped = (F.col("form") == "data") & (F.col("windows") >= F.col("all_windows") * min_share)
    copied = (F.col("distinct") >= min_prints) & (F.greatest("often", "known") >= F.col("distinct") * min_share)
    return shares.select("work_id", F.when(dumped, "data").when(copied, "vendored").alias("kind")).filter(F.col("kind").isNotNull())


def not_handwritten(files: DataFrame, min_repos: int = MIN_REPOS, min_share: float = MIN_SHARE, min_prints: int = MIN_PRINTS, dump_repos: int = DUMP_REPOS) -> DataFrame:
    """work_id and kind (generated, minified, vendored, lock or data) of the files that nobody wrote by hand.

    Only files with bytes take part. Path and banner are asked first, then the forms of lock files, minified scripts and
    counters; everything else is decided by fingerprints that recur in other repositories or in files declared to be
    vendored (so also the original of a library, once another file of the table is a marked copy of it). A dump counts
    as data only if its fingerprints recur; one with fewer tokens than a fingerprint needs, such as a single encoded
    string, has none, and its form decides. work_id is taken to be unique; null paths and languages only leave those
    signs out. Repeated rows are repeated in the result. Files of any length are read whole. An empty table gives an
    empty result.
    """
    judged = cut_lineage(judge_files(files))  # three branches read it; files are tokenised once
    by_sign = judged.select("work_id", F.coalesce("declared", F.when((F.col("form") != "data") | (F.size("prints") == 0), F.col("form"))).alias("kind"))
    return by_sign.filter(F.col("kind").isNotNull()).unionByName(recurring(judged, min_repos, min_share, min_prints, dump_repos))
