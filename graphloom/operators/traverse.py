"""Iterative operators: bounded traversal, components, propagation, paths and cycles.

Each round is one join of the frontier with the edges; lineage is cut after it by a checkpoint in the shared folder,
so plans stay short and a lost executor costs no earlier round. Loops end when a round finds nothing new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.schema import EDGE_WEIGHTS
from graphloom.session import cut_lineage


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    """src, dst of every edge in both directions."""
    out = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), *keep)
    return out.unionByName(edges.select(F.col("target").alias("src"), F.col("source").alias("dst"), *keep))


def bfs(seeds: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
    """qn and least depth of everything within `depth` steps (src, dst) of the seeds (qn), the seeds at depth 0.

    Only the frontier of each round is written; what was visited before is the union of them.
    """
    frontier = visited = cut_lineage(seeds.select("qn").distinct().withColumn("depth", F.lit(0)))
    steps = cut_lineage(steps.select("src", "dst").distinct())
    for d in range(1, depth + 1):
        found = frontier.join(steps, F.col("qn") == F.col("src")).select(F.col("dst").alias("qn")).distinct().join(visited.select("qn"), "qn", "left_anti")
        frontier = cut_lineage(found.withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def impact_radius(seeds: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """Traversal over edges of any kind in either direction."""
    return bfs(seeds, both_ways(edges), depth)


def first_cause(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """qn, depth and edge kind by which each node is first reached against the edges; among several of one round the most confident, then the least kind."""
    back = cut_lineage(edges.select(F.col("target").alias("src"), F.col("source").alias("dst"), "kind", "confidence"))
    visited = cut_lineage(seeds.select("qn").distinct().select("qn", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("edge_kind")))
    frontier = visited
    for d in range(1, depth + 1):
        step = (
            frontier.join(back, F.col("qn") == F.col("src"))
            .groupBy(F.col("dst").alias("found"))
            .agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("kind").alias("k"))).alias("m"))
            .select(F.col("found").alias("qn"), F.lit(d).alias("depth"), F.col("m.k").alias("edge_kind"))
        )
        frontier = cut_lineage(step.join(visited, "qn", "left_anti"))
        if frontier.isEmpty():
            break
        visited = cut_lineage(visited.unionByName(frontier))
    return visited


def propagate(seeds: DataFrame, edges: DataFrame, decay: float = 0.25, rounds: int | None = None) -> DataFrame:
    """Greatest product of seed score, decay and weight times confidence along any path: qn, score.

    Weights are at most 3, so each step shrinks a score, the best path repeats no node, and the rounds end by themselves.
    rounds, if given, bounds the length of the path.
    """
    weight = F.create_map(*(F.lit(x) for kv in EDGE_WEIGHTS.items() for x in kv))
    steps = cut_lineage(both_ways(edges.withColumn("w", F.coalesce(weight[F.col("kind")], F.lit(1.0)) * F.col("confidence") * decay), "w"))
    frontier = best = cut_lineage(seeds.groupBy("qn").agg(F.max("score").alias("score")))
    done = 0
    while rounds is None or done < rounds:
        done += 1
        reached = frontier.join(steps, F.col("qn") == F.col("src")).groupBy(F.col("dst").alias("found")).agg(F.max(F.col("score") * F.col("w")).alias("new"))
        merged = best.join(reached, F.col("qn") == F.col("found"), "full").select(
            F.coalesce("qn", "found").alias("qn"), F.greatest("score", "new").alias("score"), (F.col("score").isNull() | (F.col("new") > F.col("score"))).alias("better")
        )
        merged = cut_lineage(merged)
        best = merged.select("qn", "score")
        frontier = merged.filter("better").select("qn", "score")
        if frontier.isEmpty():
            break
    return best


def components(edges: DataFrame) -> DataFrame:
    """qn and component (its least member) over undirected edges.

    Alternating large-star and small-star rounds: the number of rounds grows with the logarithm of the component size, and
    no node's neighbourhood is ever gathered in one place.
    """
    links = cut_lineage(edges.filter("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct())
    while True:
        # large star: every larger neighbour points to the least one
        sides = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sides.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself point to the least smaller one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        if nxt.count() == links.count() and nxt.join(links, ["u", "v"], "left_anti").isEmpty():
            break
        links = nxt
    members = links.select(F.col("u").alias("qn"), F.col("v").alias("component"))
    return members.union(links.select("v", "v")).distinct()


def longest_depths(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Length of the longest path that leaves each node: qn, depth.

    With rounds, steps are counted up to that many, around cycles too: a depth of rounds means that or more. Without, paths
    may be of any length, and a cycle counts as one node: its nodes have the depth of what leaves it.
    """
    steps = edges.filter("source <> target").select("source", "target").distinct()
    if rounds is not None:
        return _walks(cut_lineage(steps), rounds)
    steps = cut_lineage(steps)
    of = strong_components(steps).select("qn", "component")
    place = cut_lineage(steps.select(F.col("source").alias("qn")).union(steps.select("target")).distinct().join(of, "qn", "left").select("qn", F.coalesce("component", "qn").alias("place")))
    outer = steps.join(place.select(F.col("qn").alias("source"), F.col("place").alias("a")), "source").join(place.select(F.col("qn").alias("target"), F.col("place").alias("b")), "target")
    depths = _walks(cut_lineage(outer.filter("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target")).distinct()), None)
    return place.join(depths.withColumnRenamed("qn", "place"), "place", "left").select("qn", F.coalesce("depth", F.lit(0)).alias("depth"))


def _walks(steps: DataFrame, rounds: int | None) -> DataFrame:
    """Longest walk from each node, at most rounds; without a bound the steps must have no cycle."""
    depths = steps.select(F.col("target").alias("qn")).union(steps.select("source")).distinct().withColumn("depth", F.lit(0))
    live, d = None, 0
    while rounds is None or d < rounds:
        # after round d a node is alive exactly if a walk of d steps leaves it
        d += 1
        onward = steps if live is None else steps.join(live.select(F.col("qn").alias("target")), "target", "left_semi")
        live = cut_lineage(onward.select(F.col("source").alias("qn")).distinct().withColumn("depth", F.lit(d)))
        if live.isEmpty():
            break
        depths = depths.unionByName(live)
    return cut_lineage(depths.groupBy("qn").agg(F.max("depth").alias("depth")))


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (a, b) with a path of any length from a to b, by doubling: for module graphs, whose nodes are few."""
    paths = cut_lineage(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    size = paths.count()
    while True:
        longer = paths.join(paths.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        paths = cut_lineage(paths.union(longer).distinct())
        grown = paths.count()
        if grown == size:
            break
        size = grown
    return paths


def in_cycles(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have both one coming in and one going out, again and again: all cycles, and paths between them."""
    left = cut_lineage(edges.select("source", "target").distinct())
    size = left.count()
    while size:
        kept = left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        kept = cut_lineage(kept.select("source", "target"))
        now = kept.count()
        left = kept
        if now == size:
            break
        size = now
    return left


def strong_components(edges: DataFrame) -> DataFrame:
    """qn, component (least member) and size of cycles: nodes that reach each other, or themselves by an edge. Edges outside cycles are cut off first, cycles of any length are found."""
    paths = closure(in_cycles(edges))
    mutual = paths.join(paths.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"])
    named = mutual.groupBy(F.col("a").alias("qn")).agg(F.min("b").alias("component"))
    return named.join(named.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("qn", "component", "size")


def cycle_paths(edges: DataFrame) -> DataFrame:
    """One shortest cycle through the least node of each strongly connected component, of any length: component, size, cycle.

    Of equally short ones the least by the names along it. A breadth-first search within all components at once.
    """
    of = cut_lineage(strong_components(edges.filter("source <> target")).select("qn", "component"))
    steps = edges.filter("source <> target").select("source", "target").distinct()
    steps = steps.join(of.select(F.col("qn").alias("source"), "component"), "source").join(of.select(F.col("qn").alias("target"), F.col("component").alias("same")), "target")
    steps = cut_lineage(steps.filter("component = same").select("component", "source", "target"))
    frontier = of.filter("qn = component").select("component", F.col("qn").alias("at"), F.array("qn").alias("path"))
    seen, found = frontier.select("component", "at"), None
    while True:
        onward = cut_lineage(frontier.join(steps.withColumnRenamed("source", "at"), ["component", "at"]).groupBy("component", F.col("target").alias("at")).agg(F.min("path").alias("path")))
        closed = onward.filter("at = component").select("component", F.size("path").alias("size"), F.array_join("path", " > ").alias("cycle"))
        found = closed if found is None else found.unionByName(closed)
        frontier = cut_lineage(onward.join(seen, ["component", "at"], "left_anti").join(closed.select("component"), "component", "left_anti").select("component", "at", F.concat("path", F.array("at")).alias("path")))
        if frontier.isEmpty():
            return found
        seen = seen.unionByName(frontier.select("component", "at"))


def call_chains(edges: DataFrame, length: int, longest: int | None = None) -> DataFrame:
    """Simple paths of `length` nodes, or of all lengths from it to `longest`, over the edges: the array path."""
    steps = edges.select("source", "target").distinct()
    chains = steps.filter("source <> target").select(F.array("source", "target").alias("path"))
    out = chains if length <= 2 else None
    for size in range(3, max(length, longest or length) + 1):
        chains = (
            chains.join(steps, F.element_at("path", -1) == F.col("source"))
            .filter(~F.array_contains("path", F.col("target")))
            .select(F.concat("path", F.array("target")).alias("path"))
        )
        if size >= length:
            out = chains if out is None else out.unionByName(chains)
    return out


def shortest_cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """Of each node on a cycle of at most `longest` nodes the least of its shortest cycles, as text."""
    steps = cut_lineage(edges.filter("source <> target").select("source", "target").distinct())
    paths = steps.select(F.col("source").alias("start"), F.col("target").alias("at"), F.array("source", "target").alias("path"))
    found = None
    for size in range(2, longest + 1):
        closed = paths.join(steps.withColumnRenamed("source", "at").withColumnRenamed("target", "start"), ["at", "start"]).select("start", F.lit(size).alias("size"), F.array_join("path", " > ").alias("cycle"))
        found = closed if found is None else found.unionByName(closed)
        if size < longest:
            paths = cut_lineage(
                paths.join(steps, F.col("at") == F.col("source")).filter(~F.array_contains("path", F.col("target"))).select("start", F.col("target").alias("at"), F.concat("path", F.array("target")).alias("path"))
            )
    return found.groupBy(F.col("start").alias("qn")).agg(F.min(F.struct("size", "cycle")).alias("m")).select("qn", "m.size", "m.cycle")


def rename_chain(renames: DataFrame) -> DataFrame:
    """First name of each current path through renames (old_path, path): path, origin, hops.

    Chains of any length, by doubling. Raises if renames form a cycle, which has no first name.
    """
    chain = cut_lineage(renames.select("path", F.col("old_path").alias("origin")).distinct().withColumn("hops", F.lit(1)))
    links = chain.count()
    while True:
        further = chain.select(F.col("path").alias("origin"), F.col("origin").alias("older"), F.col("hops").alias("more"))
        joined = chain.join(further, "origin", "left").select("path", F.coalesce("older", "origin").alias("origin"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("older").isNotNull().alias("grown"))
        joined = cut_lineage(joined.groupBy("path", "origin", "hops").agg(F.max("grown").alias("grown")))
        chain = joined.select("path", "origin", "hops")
        if joined.filter("grown").isEmpty():
            return chain
        if not joined.filter(F.col("hops") > links).isEmpty():
            raise ValueError("renames form a cycle")


def next_in_chain(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Of each node the neighbour from which the longest path goes on, at equal length the greatest name: qn, next."""
    depths = longest_depths(edges, rounds).select(F.col("qn").alias("target"), "depth")
    steps = edges.filter("source <> target").select("source", "target").distinct().join(depths, "target")
    return steps.groupBy(F.col("source").alias("qn")).agg(F.max_by("target", F.struct("depth", "target")).alias("next"))


def longest_paths(edges: DataFrame) -> DataFrame:
    """The nodes of a longest path from each node, at equal length by way of the greatest names: qn, path. Cycles are not entered twice; edges within them are left out."""
    of = strong_components(edges.filter("source <> target")).select("qn", "component")
    side = lambda c: of.select(F.col("qn").alias(c), F.col("component").alias(f"{c}_in"))
    outer = edges.filter("source <> target").select("source", "target").distinct().join(side("source"), "source", "left").join(side("target"), "target", "left")
    outer = cut_lineage(outer.filter(~F.coalesce(F.col("source_in") == F.col("target_in"), F.lit(False))).select("source", "target"))
    paths = outer.select(F.col("source").alias("qn")).union(outer.select("target")).distinct().withColumn("path", F.array("qn"))
    live = cut_lineage(paths)
    found = live
    while True:
        grown = outer.join(live.withColumnRenamed("qn", "target"), "target").groupBy(F.col("source").alias("qn")).agg(F.max("path").alias("rest"))
        live = cut_lineage(grown.select("qn", F.concat(F.array("qn"), "rest").alias("path")))
        if live.isEmpty():
            return found.groupBy("qn").agg(F.max_by("path", F.size("path")).alias("path"))
        found = found.unionByName(live)
