"""Source files that do not parse, and why.

Every file is parsed against all grammars, in the order of a token-based ranking. One that its own grammar rejects has a
wrong extension if another accepts it, and is corrupt if none does.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.grammars import LANGUAGES, check_all, ranked
from graphloom.session import spread

#: Languages by extension. Fixed values.
EXTENSIONS = {
    "py": "python", "rs": "rust", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "go": "go", "java": "java", "c": "c", "h": "c", "json": "json", "toml": "toml",
}


def language_of(orig_language: Column, rel_path: Column) -> Column:
    """orig_language or, if null, the language of the path's extension; null if neither is known."""
    by_ext = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(F.lower(F.btrim(orig_language)), by_ext[F.lower(F.regexp_extract(rel_path, r"\.([^./]+)$", 1))])


def _tells(raw: bytes, language: str) -> bool:
    """Whether a valid text shows its language: a bare value of json and comments of toml don't."""
    if language == "json":
        return raw.removeprefix(b"\xef\xbb\xbf").lstrip()[:1] in (b"{", b"[")
    return language != "toml" or bool(tomllib.loads(raw.decode("utf-8-sig")))


def verdict(raw: bytes | None, language: str | None) -> tuple[str, list[str]]:
    """valid, wrong_language, corrupt, undecided or unknown, and the languages whose grammar accepts the file, its own or the best ranked first.

    Unknown are null bytes and languages without grammar; undecided are files for which the parser of their language ran out
    of its means, such as its depth of recursion.
    """
    if raw is None or language not in LANGUAGES:
        return "unknown", []
    found = check_all(raw, ranked(raw))
    tells = [other for other, fits in found.items() if fits and other != language and raw.strip() and _tells(raw, other)]
    if found[language] is None:
        return "undecided", tells
    if found[language]:
        return "valid", [language, *tells]
    return ("wrong_language" if tells else "corrupt"), tells


def check_files(files: DataFrame) -> DataFrame:
    """work_id, repo_id, language, verdict, parses_as, parses: one row for every row of files.

    verdict is valid, wrong_language (bytes parse as parses_as instead), corrupt, undecided (the parser's means ran out), or
    unknown (null bytes, or a language without grammar); parses lists all languages whose grammar accepts the bytes. Empty
    files are valid except in json. Nulls in any column, repeated rows and files of any length are allowed. An empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist()))
            known: dict[tuple[bytes | None, str | None], tuple[str, list[str]]] = {}  # copies in a batch are parsed once
            found = [known[x] if x in known else known.setdefault(x, verdict(*x)) for x in pairs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    pa.array([v for v, _ in found], pa.string()),
                    pa.array([p[0] if p and v in ("valid", "wrong_language") else None for v, p in found], pa.string()),
                    pa.array([p for _, p in found], pa.list_(pa.string())),
                ],
                names=["work_id", "repo_id", "language", "verdict", "parses_as", "parses"],
            )

    rows = files.select("work_id", "repo_id", language_of(F.col("orig_language"), F.col("rel_path")).alias("language"), "bytes")
    return spread(rows).mapInArrow(run, "work_id long, repo_id long, language string, verdict string, parses_as string, parses array<string>")


def unparsable(files: DataFrame) -> DataFrame:
    """Files that are syntactically invalid in their language; undecided ones are not among them."""
    return check_files(files).filter(F.col("verdict").isin("wrong_language", "corrupt"))


def rates(files: DataFrame) -> DataFrame:
    """Per repository and language: files with bytes, how many don't parse, of which in a wrong language, and the rate."""
    checked = check_files(files).filter(~F.col("verdict").isin("unknown", "undecided"))
    bad = F.col("verdict") != "valid"
    return (
        checked.groupBy("repo_id", "language")
        .agg(F.count(F.lit(1)).alias("files"), F.count_if(bad).alias("invalid"), F.count_if(F.col("verdict") == "wrong_language").alias("wrong_language"))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )
