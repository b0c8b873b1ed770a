"""Markdown and diagram texts of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_docs(nodes: DataFrame) -> DataFrame:
    """One Markdown page per file: path, page."""
    line = F.concat(F.lit("- `"), F.col("name"), F.lit("` ("), F.col("kind"), F.lit(")"))
    per = nodes.groupBy(F.col("file_path").alias("path")).agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("body"))
    return per.select("path", F.concat(F.lit("# "), F.col("path"), F.lit("\n\n"), F.col("body")).alias("page"))


def mermaid(edges: DataFrame) -> DataFrame:
    """Diagram of module edges (repo_id, source_label, target_label, n) per repository, as text."""
    line = F.concat(F.lit("  "), F.col("source_label"), F.lit(" -->|"), F.col("n").cast("string"), F.lit("| "), F.col("target_label"))
    return edges.groupBy("repo_id").agg(F.concat(F.lit("graph LR\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("diagram"))
