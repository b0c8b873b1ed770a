"""Files as tables: inventory scan, hashes, parsers that emit nodes and edges."""

from __future__ import annotations

import ast
import difflib
import json
import re
import tomllib
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.scan import ignored
from graphloom.session import cut_lineage, spread
from graphloom.sources import declarations

NODES = "file string, kind string, name string, parent string, line int"


def inventory(spark: SparkSession, folder: str, pattern: str = "*", max_bytes: int = 1 << 20, ignore: list[str] = ()) -> DataFrame:
    """path, size, hash and binary flag of the files below a folder that aren't ignored or too large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    local = F.regexp_replace("path", r"^file:/*", "/")
    return (
        files.filter((F.col("length") <= max_bytes) & ~ignored(F.regexp_replace(local, f"^{re.escape(folder.rstrip('/'))}/", ""), list(ignore)))
        .select(local.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), F.hex(F.substring("content", 1, 8192)).rlike("^(?:..)*?00").alias("binary"))
    )


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[str, str, str, int]] = []
        self.stack: list[str] = ["document"]
        self.seen: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        n = self.seen[tag] = self.seen.get(tag, -1) + 1
        name = f"{tag}[{n}]"
        self.rows.append(("module", name, self.stack[-1], self.getpos()[0]))
        for key, value in attrs:
            if key in ("src", "href", "srcset", "data-src", "data-href") and value:
                self.rows.append(("import", value, name, self.getpos()[0]))
        if tag not in ("br", "img", "hr", "input", "meta", "link"):
            self.stack.append(name)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].startswith(f"{tag}["):
                del self.stack[k:]
                break


def _python(text: str) -> list[tuple[str, str, str, int]]:
    out = []

    def visit(node: ast.AST, parent: str) -> None:
        for child in ast.iter_child_nodes(node):
            name = parent
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                out.append((kind, child.name, parent, child.lineno))
                name = child.name
            elif isinstance(child, ast.Import):
                out.extend(("import", a.name, parent, child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append(("import", "." * child.level + (child.module or ""), parent, child.lineno))
            elif isinstance(child, ast.Call):
                f = child.func
                called = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
                if called:
                    out.append(("call", called, parent, child.lineno))
            visit(child, name)

    visit(ast.parse(text), "")
    return out


def _keys(value: object, parent: str) -> list[tuple[str, str, str, int]]:
    """Keys at any depth with the path of those above them."""
    out: list[tuple[str, str, str, int]] = []
    open_ = [(value, parent)]
    while open_:
        value, parent = open_.pop()
        if isinstance(value, dict):
            out += [("key", str(k), parent, 0) for k in value]
            open_ += [(v, f"{parent}.{k}".strip(".")) for k, v in value.items()]
    return out


def _html(text: str) -> list[tuple[str, str, str, int]]:
    parser = _Html()
    parser.feed(text)
    return parser.rows


declarations.register("python", _python, ["py", "pyi"])
declarations.register("json", lambda text: _keys(json.loads(text), ""), ["json"])
declarations.register("toml", lambda text: _keys(tomllib.loads(text), ""), ["toml"])
declarations.register("html", _html, ["html", "htm"])


def parse_text(raw: bytes, language: str) -> list[tuple[str, str, str, int]]:
    """(kind, name, parent, line) of what a file declares, imports and calls; nothing if it isn't UTF-8, doesn't parse or no handler is registered."""
    handle = declarations.handler(language)
    try:
        return handle(raw.decode("utf-8-sig")) if handle else []
    except (SyntaxError, ValueError, RecursionError):
        return []


def parse_files(files: DataFrame) -> DataFrame:
    """Declarations of files with columns file, language, content (bytes): file, kind, name, parent, line. Null contents give nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (f, *row) for f, lang, raw in zip(pdf["file"], pdf["language"], pdf["content"]) if raw is not None for row in parse_text(bytes(raw), lang)
            ]
            yield pd.DataFrame(rows, columns=["file", "kind", "name", "parent", "line"]).astype({"line": "int32"})

    return spread(files.select("file", "language", "content")).mapInPandas(run, NODES)


def parse_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (qn, kind, name, file_path, line_start) and edges (source, target, kind, file_path, confidence, tier) of files: file, language, content.

    qn is file::kind::name; of equal ones the first line counts. A file and each declaration contain what is declared in
    them. Imports go from the file to the name as it stands. Calls are bound to the callable of that name in the same file
    (confidence 0.9), else to the only one of the name in all files of the language (0.65), else to the bare name (0.3).
    """
    language = files.select(F.col("file").alias("file_path"), "language").distinct()
    rows = cut_lineage(parse_files(files).withColumnRenamed("file", "file_path").join(language, "file_path"))
    name = F.concat_ws("::", "file_path", "kind", "name")
    declared = rows.filter(~F.col("kind").isin("import", "call")).groupBy("file_path", "language", "kind", "name").agg(F.min("line").alias("line_start"), F.min_by("parent", "line").alias("parent"))
    top = language.select("file_path", "language", F.lit("file").alias("kind"), F.regexp_extract("file_path", r"([^/]*)$", 1).alias("name"), F.lit(1).alias("line_start"), F.lit("").alias("parent"))
    nodes = declared.unionByName(top).withColumn("qn", F.when(F.col("kind") == "file", F.col("file_path")).otherwise(name))
    holders = declared.select("file_path", F.col("name").alias("parent"), name.alias("holder"), "line_start").groupBy("file_path", "parent").agg(F.min_by("holder", "line_start").alias("holder"))
    inside = lambda df: df.join(holders, ["file_path", "parent"], "left").withColumn("source", F.coalesce("holder", "file_path"))
    edge = lambda df, target, kind, confidence: df.select("source", target.alias("target"), F.lit(kind).alias("kind"), "file_path", confidence.alias("confidence"))
    contains = edge(inside(declared.withColumn("target", name)), F.col("target"), "contains", F.lit(1.0))
    imports = edge(rows.filter("kind = 'import'").withColumn("source", F.col("file_path")), F.col("name"), "imports", F.lit(0.9))
    callables = declared.filter(F.col("kind").isin("function", "method")).select("language", "file_path", "name", name.alias("qn"))
    here = callables.groupBy("file_path", "name").agg(F.min("qn").alias("here"))
    only = callables.groupBy("language", "name").agg(F.count(F.lit(1)).alias("n"), F.min("qn").alias("there")).filter("n = 1").drop("n")
    called = inside(rows.filter("kind = 'call'")).join(here, ["file_path", "name"], "left").join(only, ["language", "name"], "left")
    sure = F.when(F.col("here").isNotNull(), 0.9).when(F.col("there").isNotNull(), 0.65).otherwise(0.3)
    edges = contains.unionByName(imports).unionByName(edge(called, F.coalesce("here", "there", "name"), "calls", sure)).distinct()
    return nodes.select("qn", "kind", "name", "file_path", "language", "line_start"), edges.withColumn("tier", F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low"))


def patch(old: str, new: str, path: str, context: int = 3) -> str:
    """Unified diff of two texts."""
    return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{path}", f"b/{path}", n=context))


def patches(pairs: DataFrame) -> DataFrame:
    """path and patch of each pair of texts (path, old, new) that differ; nulls are empty texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [patch(o or "", n or "", p) for p, o, n in zip(pdf["path"], pdf["old"], pdf["new"])]
            yield pd.DataFrame({"path": pdf["path"], "patch": made})

    return pairs.filter(~F.col("old").eqNullSafe(F.col("new"))).select("path", "old", "new").mapInPandas(run, "path string, patch string")
