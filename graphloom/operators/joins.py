"""Neighbourhoods: joins of edges and nodes, semi-joins and anti-joins.

Either-direction joins are unions of two equi-joins, never a join on OR, so that each side hashes on one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.scan import top_per_key
from graphloom.schema import REFERENCE_KINDS


def neighbours(nodes: DataFrame, edges: DataFrame, key: str, other: str, limit: int | None = None) -> DataFrame:
    """Edges with the node at their `other` end, by the node at their `key` end: the most confident ones first."""
    joined = edges.select(F.col(key).alias("seed"), F.col(other).alias("qn"), F.col("kind").alias("edge_kind"), "confidence").join(
        nodes.select("qn", "name", F.col("kind").alias("node_kind"), "file_path"), "qn"
    )
    if limit is None:
        return joined
    return top_per_key(joined, ["seed"], [F.col("confidence").desc(), F.col("qn"), F.col("edge_kind")], limit, "rank")


def direct_callers(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    return neighbours(nodes, edges.filter(F.col("kind") == "calls"), "target", "source", limit)


def direct_callees(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    return neighbours(nodes, edges.filter(F.col("kind") == "calls"), "source", "target", limit)


def either_way(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Neighbours over edges of the kinds in either direction, duplicates kept, the seed itself left out."""
    picked = edges.filter(F.col("kind").isin(*kinds) & (F.col("source") != F.col("target")))
    return neighbours(nodes, picked, "target", "source").withColumn("direction", F.lit("in")).unionByName(neighbours(nodes, picked, "source", "target").withColumn("direction", F.lit("out")))


def siblings(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """The first `limit` other nodes of each node's file with the same parent (the least that contains it, or none), by name: seed, sibling.

    Only the first limit + 1 members of a group are joined to its nodes, never all with all.
    """
    parents = edges.filter("kind = 'contains'").groupBy(F.col("target").alias("qn")).agg(F.min("source").alias("parent"))
    placed = nodes.select("qn", "file_path").join(parents, "qn", "left").select(F.col("qn").alias("seed"), "file_path", F.coalesce("parent", F.lit("")).alias("parent"))
    first = top_per_key(placed.select(F.col("seed").alias("sibling"), "file_path", "parent"), ["file_path", "parent"], [F.col("sibling")], limit + 1)
    pairs = placed.join(first, ["file_path", "parent"]).filter(F.col("seed") != F.col("sibling")).select("seed", "sibling")
    return top_per_key(pairs, ["seed"], [F.col("sibling")], limit)


def edge_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the files of both ends."""
    at = nodes.select("qn", "file_path")
    return (
        edges.select("source", "target", "kind")
        .join(at.select(F.col("qn").alias("source"), F.col("file_path").alias("source_file")), "source")
        .join(at.select(F.col("qn").alias("target"), F.col("file_path").alias("target_file")), "target")
    )


def dependents(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Files, not changed themselves, with an edge into a changed file (changed: path)."""
    paths = changed.select(F.col("path").alias("target_file")).distinct()
    return (
        edge_files(nodes, edges)
        .join(paths, "target_file", "left_semi")
        .join(paths.withColumnRenamed("target_file", "source_file"), "source_file", "left_anti")
        .select(F.col("source_file").alias("path"))
        .distinct()
    )


def dependents_of_symbols(nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files with an edge into one of the symbols (qn), but none of the symbols' own files."""
    own = nodes.join(symbols, "qn", "left_semi").select(F.col("file_path").alias("path"))
    uses = edges.join(symbols.select(F.col("qn").alias("target")), "target", "left_semi").select(F.col("source").alias("qn"))
    return nodes.join(uses, "qn", "left_semi").select(F.col("file_path").alias("path")).join(own, "path", "left_anti").distinct()


def referencing_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each file the other files that refer to its symbols, and over how many edges."""
    return edge_files(nodes, edges).filter(F.col("source_file") != F.col("target_file")).groupBy("target_file", "source_file").agg(F.count(F.lit(1)).alias("edges"))


def co_referencing_files(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """The `limit` other files that share most referenced symbols with each seed (path): file_a, file_b, shared. A stated set of files against all."""
    held = edge_files(nodes, edges).select("source_file", "target").distinct()
    mine = held.join(seeds.select(F.col("path").alias("source_file")).distinct(), "source_file", "left_semi").select(F.col("source_file").alias("file_a"), "target")
    pairs = mine.join(held.withColumnRenamed("source_file", "file_b"), "target").filter("file_a <> file_b")
    counts = pairs.groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("shared"))
    return top_per_key(counts, ["file_a"], [F.col("shared").desc(), F.col("file_b")], limit)



def unused(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no reference edge points to."""
    return nodes.join(edges.filter(F.col("kind").isin(*REFERENCE_KINDS)).select(F.col("target").alias("qn")), "qn", "left_anti")


def dead_code(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("function", "method", "class", "struct", "trait", "enum", "constant")) -> DataFrame:
    """Candidates for removal: unused, neither public nor a test."""
    public = F.coalesce(F.lower("modifiers").contains("pub") | F.lower("modifiers").contains("export"), F.lit(False))
    return unused(nodes.filter(F.col("kind").isin(*kinds) & ~public & ~F.col("is_test")), edges)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return nodes.join(edges.select(F.col("source").alias("qn")), "qn", "left_anti").join(edges.select(F.col("target").alias("qn")), "qn", "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node, once for each such end."""
    parts = [edges.join(nodes.select(F.col("qn").alias(side)), side, "left_anti").withColumn("side", F.lit(side)) for side in ("source", "target")]
    return parts[0].unionByName(parts[1])


def one_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Keys one edge away from the seeds (qn) in either direction, without the seeds."""
    out = edges.join(seeds.select(F.col("qn").alias("source")), "source", "left_semi").select(F.col("target").alias("qn"))
    into = edges.join(seeds.select(F.col("qn").alias("target")), "target", "left_semi").select(F.col("source").alias("qn"))
    return out.union(into).distinct().join(seeds, "qn", "left_anti")


def resolve_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Call edges whose target is no node, matched to the one best candidate of that name.

    Candidates have the target's name and the caller's repository. One in a file that the caller's file already has an
    edge into is taken at confidence 0.75, one of the same folder at 0.65; a tier counts only if it has a single candidate.
    """
    at = nodes.select("qn", "file_path", "repo_id", "name")
    open_calls = (
        edges.filter(F.col("kind") == "calls")
        .join(nodes.select(F.col("qn").alias("target")), "target", "left_anti")
        .select("source", "target", "repo_id", F.element_at(F.split("target", "::"), -1).alias("name"), F.col("file_path").alias("from_file"))
        .distinct()
    )
    links = edge_files(nodes, edges).filter(F.col("source_file") != F.col("target_file")).select(F.col("source_file").alias("from_file"), F.col("target_file").alias("file_path")).distinct()
    candidates = open_calls.join(at.withColumnRenamed("qn", "resolved"), ["repo_id", "name"])
    imported = candidates.join(links, ["from_file", "file_path"], "left_semi").withColumn("confidence", F.lit(0.75))
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    near = candidates.filter(folder("from_file") == folder("file_path")).withColumn("confidence", F.lit(0.65))
    single = imported.unionByName(near).groupBy("source", "target", "confidence").agg(F.count(F.lit(1)).alias("n"), F.min("resolved").alias("resolved")).filter(F.col("n") == 1)
    return top_per_key(single, ["source", "target"], [F.col("confidence").desc()], 1).select("source", "target", "resolved", "confidence")


def owners(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Of each path the longest root (root, owner) that is a folder above it. Every folder of the path is looked up by equality."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = paths.select("path", F.explode(folders).alias("root")).join(roots, "root")
    return found.groupBy("path").agg(F.max_by("owner", F.length("root")).alias("owner"))


def renames(now: DataFrame, old: DataFrame) -> DataFrame:
    """old_path and path of files (repo_id, path, file_hash) that are in only one of two listings and have the same hash; several of one hash are paired in order of their paths. A null hash equals none."""
    order = Window.partitionBy("repo_id", "file_hash").orderBy("path")
    came = now.filter("file_hash is not null").join(old.select("path"), "path", "left_anti").withColumn("n", F.row_number().over(order))
    went = old.filter("file_hash is not null").join(now.select("path"), "path", "left_anti").withColumn("n", F.row_number().over(order))
    return came.join(went.withColumnRenamed("path", "old_path"), ["repo_id", "file_hash", "n"]).select("old_path", "path")
