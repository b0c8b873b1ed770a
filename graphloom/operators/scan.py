"""Keyed scans, lookups and predicates on nodes, edges and files.

Every function takes DataFrames and gives a lazy DataFrame. Lookups come in a form for many keys at once: the keys are
a DataFrame and the lookup a join, so that one plan serves one key or millions.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.schema import CALLABLE


def by_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose column is among the keys (a DataFrame with that column). Null keys match nothing."""
    return df.join(keys.select(column).distinct(), column, "left_semi")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str | None = None) -> DataFrame:
    """First `limit` rows of each key in a total order."""
    numbered = df.withColumn(rank or "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    kept = numbered.filter(F.col(rank or "_rank") <= limit)
    return kept if rank else kept.drop("_rank")


def callables(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*CALLABLE))


def with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column begins with the prefix, letter case of ASCII ignored as SQL LIKE does there."""
    return df.filter(F.lower(column).startswith(prefix.lower()))


def filters(
    repo_ids: list[int] | None = None,
    kind: str | None = None,
    language: str | None = None,
    file_path: str | None = None,
    is_test: bool | None = None,
    subpath: str | None = None,
    include_files: bool = False,
) -> Column:
    """Conjunction of the filters that are given; without a kind, file nodes are left out unless include_files."""
    parts: list[Column] = [F.lit(True)]
    if repo_ids:
        parts.append(F.col("repo_id").isin(*repo_ids))
    if kind is not None:
        parts.append(F.col("kind") == kind)
    elif not include_files:
        parts.append(F.col("kind") != "file")
    if language is not None:
        parts.append(F.col("language") == language)
    if file_path is not None:
        parts.append(F.col("file_path") == file_path)
    if is_test is not None:
        parts.append(F.col("is_test") == is_test)
    if subpath is not None:
        parts.append(F.lower("file_path").startswith(subpath.lower()))
    return reduce(Column.__and__, parts)


def regex_match(pattern: str, *columns: str) -> Column:
    """True where a column matches; null never does. Empty patterns and back references are errors."""
    if not pattern:
        raise ValueError("the pattern is empty")
    if re.search(r"\\[1-9]", pattern):
        raise ValueError("back references aren't supported")
    return reduce(Column.__or__, (F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in columns))


#: Signs of a path that isn't canonical: absolute, drive, ./, ../, doubled or trailing slash, backslash. Fixed values.
NONCANONICAL = r"^/|^[A-Za-z]:|^\./|(^|/)\.\.(/|$)|/\./|//|/$|\\"


def noncanonical(column: str) -> Column:
    return F.col(column).rlike(NONCANONICAL)


def canonicalise(path: Column) -> Column:
    """Slashes one way, without empty, . and trailing parts; a part before .. is dropped with it."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: ~p.isin("", "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(folded, "/")


def composed(df: DataFrame, column: str) -> DataFrame:
    """The column in Unicode form NFC. Only values with other than ASCII letters go through Python, in Arrow batches."""

    @F.pandas_udf("string")
    def nfc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")

    plain = df.filter(F.col(column).isNull() | ~F.col(column).rlike(r"[^\x00-\x7f]"))
    return plain.unionByName(df.filter(F.col(column).rlike(r"[^\x00-\x7f]")).withColumn(column, nfc(column)))


def is_public(modifiers: Column) -> Column:
    return F.coalesce(F.lower(modifiers).rlike("pub|export"), F.lit(False))


def low_confidence() -> Column:
    return (F.coalesce(F.col("tier"), F.lit("")) == "low") | (F.col("confidence") < 0.5)


def glob_regex(pattern: str) -> str:
    """Regular expression of a path glob: * within and across folders, ? for one character, a plain word as a folder prefix."""
    if not any(c in pattern for c in "*?"):
        return f"^{re.escape(pattern.rstrip('/'))}(/|$)"
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def ignored(path: Column, patterns: list[str]) -> Column:
    return reduce(Column.__or__, (path.rlike(glob_regex(p)) for p in patterns), F.lit(False))


def normal_kind_token(qn: Column) -> Column:
    """Qualified name with its kind token in the short spelling: function and func become fn, constant becomes const."""
    return F.regexp_replace(F.regexp_replace(qn, r"(?i)^([^:]*)::(?:function|func)::", "$1::fn::"), r"(?i)^([^:]*)::constant::", "$1::const::")
