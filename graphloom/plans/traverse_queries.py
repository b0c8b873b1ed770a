"""Queries on traversal, impact and cycles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import joins, scan, traverse
from graphloom.plans.adapter import Graph, sql
from graphloom.plans.graph_queries import CHANGED, DEAD, changed_files

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return register


def changed_nodes(g):
    return scan.by_keys(g.nodes, changed_files(g).withColumnRenamed("path", "file_path"), "file_path")


CN = "cn AS (SELECT * FROM nodes WHERE file_path IN (SELECT path FROM changed))"
UND = "und AS (SELECT source AS src, target AS dst FROM edges UNION SELECT target, source FROM edges)"


def _bfs(seed: str, steps: str, depth: int, name: str = "b") -> str:
    return f"{name}0 AS (SELECT qn, 0 AS depth FROM {seed} UNION SELECT {steps}.dst, depth + 1 FROM {name}0 JOIN {steps} ON {steps}.src = {name}0.qn WHERE depth < {depth}),\n{name} AS (SELECT qn, min(depth)::INTEGER AS depth FROM {name}0 GROUP BY 1)"


@query("impact_radius", sql("SELECT qn, depth FROM b", CHANGED, CN, UND, _bfs("cn", "und", 3), recursive=True))
def _(g):
    return traverse.impact_radius(changed_nodes(g), g.edges, 3)


@query("impact_capped", sql("""SELECT repo_id, qn, depth FROM (SELECT n.repo_id, b.qn, depth, row_number() OVER (PARTITION BY n.repo_id ORDER BY depth, b.qn) AS r FROM b JOIN nodes n USING (qn)) WHERE r <= 20""",
    CHANGED, CN, UND, _bfs("cn", "und", 3), recursive=True))
def _(g):
    reached = traverse.impact_radius(changed_nodes(g), g.edges, 3).join(g.nodes.select("qn", "repo_id"), "qn")
    return scan.top_per_key(reached, ["repo_id"], [F.col("depth"), F.col("qn")], 20).select("repo_id", "qn", "depth")


@query("impact_files", sql("SELECT DISTINCT n.file_path AS path FROM b JOIN nodes n USING (qn) WHERE n.file_path NOT IN (SELECT path FROM changed)", CHANGED, CN, UND, _bfs("cn", "und", 3), recursive=True))
def _(g):
    reached = traverse.impact_radius(changed_nodes(g), g.edges, 3)
    return scan.by_keys(g.nodes, reached, "qn").select(F.col("file_path").alias("path")).distinct().join(changed_files(g), "path", "left_anti")


@query("impact_edges", sql("SELECT source, target, kind FROM edges WHERE source IN (SELECT qn FROM b) AND target IN (SELECT qn FROM b)", CHANGED, CN, UND, _bfs("cn", "und", 2), recursive=True))
def _(g):
    reached = traverse.impact_radius(changed_nodes(g), g.edges, 2).select("qn")
    inside = scan.by_keys(g.edges, reached.withColumnRenamed("qn", "source"), "source")
    return scan.by_keys(inside, reached.withColumnRenamed("qn", "target"), "target").select("source", "target", "kind")


@query("traverse_qn", sql("SELECT qn, depth FROM b", "steps AS (SELECT DISTINCT source AS src, target AS dst FROM edges)", "seed AS (SELECT qn FROM nodes WHERE kind = 'trait')", _bfs("seed", "steps", 4), recursive=True))
def _(g):
    return traverse.bfs(g.nodes.filter("kind = 'trait'"), g.edges.select(F.col("source").alias("src"), F.col("target").alias("dst")), 4)


@query("graph_expand", sql("SELECT qn, depth, round(10.0::DOUBLE / (depth + 1), 6) AS score FROM b", UND, "seed AS (SELECT qn FROM nodes WHERE kind = 'enum')", _bfs("seed", "und", 2), recursive=True))
def _(g):
    return traverse.impact_radius(g.nodes.filter("kind = 'enum'"), g.edges, 2).withColumn("score", F.round(10.0 / (F.col("depth") + 1), 6))


_CAUSE = "back AS (SELECT DISTINCT target AS src, source AS dst, kind, confidence FROM edges)"


def _cause(depth: int) -> str:
    parts = ["l0 AS (SELECT DISTINCT qn, 0 AS depth, NULL::VARCHAR AS edge_kind FROM seed)", "v0 AS (SELECT * FROM l0)"]
    for d in range(1, depth + 1):
        parts.append(f"l{d} AS (SELECT dst AS qn, {d} AS depth, arg_min(kind, (-confidence, kind)) AS edge_kind FROM l{d - 1} JOIN back ON src = qn WHERE dst NOT IN (SELECT qn FROM v{d - 1}) GROUP BY 1)")
        parts.append(f"v{d} AS (SELECT * FROM v{d - 1} UNION ALL SELECT * FROM l{d})")
    return ",\n".join(parts)


_CLASS = "CASE WHEN edge_kind IN ('calls', 'imports', 'tests', 'tested_by', 'implements', 'extends') OR depth = 0 THEN 'definite' WHEN edge_kind = 'references' THEN CASE WHEN depth <= 1 THEN 'definite' ELSE 'probable' END ELSE 'weak' END"


@query("removal_impact", sql(f"SELECT qn, depth, coalesce(edge_kind, '') AS edge_kind, {_CLASS} AS impact_class FROM v3", "seed AS (SELECT qn FROM nodes WHERE kind = 'struct')", _CAUSE, _cause(3)))
def _(g):
    reached = traverse.first_cause(g.nodes.filter("kind = 'struct'"), g.edges, 3)
    kind = F.coalesce("edge_kind", F.lit(""))
    cls = (
        F.when(kind.isin("calls", "imports", "tests", "tested_by", "implements", "extends") | (F.col("depth") == 0), "definite")
        .when((kind == "references") & (F.col("depth") <= 1), "definite")
        .when(kind == "references", "probable")
        .otherwise("weak")
    )
    return reached.select("qn", "depth", kind.alias("edge_kind"), cls.alias("impact_class"))


_BASE = "CASE WHEN kind IN ('function', 'method') THEN 1.0 WHEN kind IN ('class', 'struct', 'enum', 'trait', 'interface') THEN 1.2 WHEN kind IN ('module', 'package') THEN 0.8 WHEN kind IN ('constant', 'variable') THEN 0.5 WHEN kind = 'test' THEN 0.4 ELSE 0.6 END * CASE WHEN modifiers LIKE '%pub%' THEN 1.5 ELSE 1.0 END"


def base_score():
    kind = F.col("kind")
    base = (
        F.when(kind.isin("function", "method"), 1.0)
        .when(kind.isin("class", "struct", "enum", "trait", "interface"), 1.2)
        .when(kind.isin("module", "package"), 0.8)
        .when(kind.isin("constant", "variable"), 0.5)
        .when(kind == "test", 0.4)
        .otherwise(0.6)
    )
    return base * F.when(F.coalesce(F.col("modifiers").contains("pub"), F.lit(False)), 1.5).otherwise(1.0)


_W = "we AS (SELECT *, confidence * 0.25 * CASE kind WHEN 'calls' THEN 3.0 WHEN 'imports' THEN 2.0 WHEN 'tests' THEN 1.5 WHEN 'contains' THEN 1.0 ELSE 2.5 END::DOUBLE AS weight FROM edges), w AS (SELECT source AS src, target AS dst, weight FROM we UNION ALL SELECT target, source, weight FROM we)"


def _propagate(rounds: int) -> str:
    parts = [f"p0 AS (SELECT qn, max(({_BASE})::DOUBLE) AS score FROM cn GROUP BY 1)"]
    for d in range(1, rounds + 1):
        parts.append(f"p{d} AS (SELECT qn, max(score) AS score FROM (SELECT * FROM p{d - 1} UNION ALL SELECT dst, score * weight FROM p{d - 1} JOIN w ON src = qn) GROUP BY 1)")
    return ",\n".join(parts)


@query("impact_scores", sql("SELECT qn, round(score + 1e-9, 6) AS score FROM p4", CHANGED, CN, _W, _propagate(4)))
def _(g):
    seeds = changed_nodes(g).select("qn", base_score().cast("double").alias("score"))
    return traverse.propagate(seeds, g.edges, rounds=4).select("qn", F.round(F.col("score") + 1e-9, 6).alias("score"))


_KIND = "CASE WHEN kind IN ('function', 'method') AND modifiers LIKE '%pub%' THEN CASE WHEN params IS NOT NULL OR return_type IS NOT NULL THEN 'signature_change' ELSE 'api_change' END WHEN kind IN ('class', 'struct', 'enum', 'trait', 'interface') AND modifiers LIKE '%pub%' THEN 'api_change' ELSE 'internal_change' END"


def change_kind():
    public = F.coalesce(F.col("modifiers").contains("pub"), F.lit(False))
    shape = F.col("params").isNotNull() | F.col("return_type").isNotNull()
    call = F.col("kind").isin("function", "method")
    types = F.col("kind").isin("class", "struct", "enum", "trait", "interface")
    return F.when(public & call & shape, "signature_change").when(public & (call | types), "api_change").otherwise("internal_change")


@query("change_kinds", sql(f"SELECT qn, {_KIND} AS change_kind FROM cn", CHANGED, CN))
def _(g):
    return changed_nodes(g).select("qn", change_kind().alias("change_kind"))


@query("change_summary", sql(f"SELECT repo_id, {_KIND} AS change_kind, count(*) AS nodes, count(DISTINCT file_path) AS files FROM cn GROUP BY 1, 2", CHANGED, CN))
def _(g):
    return changed_nodes(g).groupBy("repo_id", change_kind().alias("change_kind")).agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("file_path").alias("files"))


@query("test_impact", sql("SELECT DISTINCT t.qn FROM nodes t JOIN und ON und.src = t.qn JOIN cn ON cn.qn = und.dst WHERE t.is_test", CHANGED, CN, UND))
def _(g):
    near = traverse.both_ways(g.edges).join(changed_nodes(g).select(F.col("qn").alias("dst")), "dst", "left_semi").select(F.col("src").alias("qn"))
    return scan.by_keys(g.nodes.filter("is_test"), near, "qn").select("qn")


@query("uncovered_changes", sql("SELECT qn FROM cn WHERE NOT is_test AND qn NOT IN (SELECT dst FROM und JOIN nodes t ON t.qn = und.src WHERE t.is_test)", CHANGED, CN, UND))
def _(g):
    covered = traverse.both_ways(g.edges).join(g.nodes.filter("is_test").select(F.col("qn").alias("src")), "src", "left_semi").select(F.col("dst").alias("qn"))
    return changed_nodes(g).filter("not is_test").join(covered, "qn", "left_anti").select("qn")


_MOD = "regexp_extract({c}, '^(.*)/[^/]*$', 1)"


def module(column: str):
    return F.regexp_extract(column, r"^(.*)/[^/]*$", 1)


@query("boundary_violations", sql(f"SELECT b.qn, {_MOD.format(c='n.file_path')} AS module FROM b JOIN nodes n USING (qn) WHERE depth > 0 AND {_MOD.format(c='n.file_path')} NOT IN (SELECT {_MOD.format(c='file_path')} FROM cn)", CHANGED, CN, UND, _bfs("cn", "und", 2), recursive=True))
def _(g):
    reached = traverse.impact_radius(changed_nodes(g), g.edges, 2).filter("depth > 0")
    homes = changed_nodes(g).select(module("file_path").alias("module")).distinct()
    return scan.by_keys(g.nodes, reached, "qn").select("qn", module("file_path").alias("module")).join(homes, "module", "left_anti").select("qn", "module")


@query("components", sql("SELECT qn, min(dst) AS component FROM (SELECT qn, qn AS dst FROM (SELECT src AS qn FROM und WHERE src <> dst) UNION SELECT root, node_at FROM r) GROUP BY 1",
    UND, "r AS (SELECT src AS root, dst AS node_at FROM und WHERE src <> dst UNION SELECT r.root, und.dst FROM r JOIN und ON und.src = r.node_at)", recursive=True))
def _(g):
    return traverse.components(g.edges)


_ME = f"me AS (SELECT DISTINCT e.repo_id, a.m AS source, b.m AS target FROM edges e JOIN (SELECT qn, {_MOD.format(c='file_path')} AS m FROM nodes) a ON a.qn = e.source JOIN (SELECT qn, {_MOD.format(c='file_path')} AS m FROM nodes) b ON b.qn = e.target WHERE a.m <> b.m)"


def module_edges(g):
    m = g.nodes.select("qn", module("file_path").alias("m"))
    return (
        g.edges.join(m.select(F.col("qn").alias("source"), F.col("m").alias("sm")), "source")
        .join(m.select(F.col("qn").alias("target"), F.col("m").alias("tm")), "target")
        .filter("sm <> tm")
        .select(F.col("sm").alias("source"), F.col("tm").alias("target"))
        .distinct()
    )


_CLOSURE = "cl AS (SELECT source AS a, target AS b FROM me UNION SELECT cl.a, me.target FROM cl JOIN me ON me.source = cl.b)"


@query("module_scc", sql("SELECT qn, component, count(*) OVER (PARTITION BY component) AS size FROM (SELECT x.a AS qn, min(x.b) AS component FROM cl x JOIN cl y ON x.a = y.b AND x.b = y.a GROUP BY 1)", _ME, _CLOSURE, recursive=True))
def _(g):
    return traverse.strong_components(module_edges(g))


_EE = "ee AS (SELECT DISTINCT source, target FROM edges WHERE source <> target)"


@query("shortest_cycles", sql("SELECT qn, size::INTEGER AS size, cycle FROM (SELECT path[1] AS qn, len(path) AS size, array_to_string(path, ' > ') AS cycle FROM sp JOIN ee ON ee.source = sp.at AND ee.target = sp.path[1]) QUALIFY row_number() OVER (PARTITION BY qn ORDER BY size, cycle) = 1",
    _EE, "sp AS (SELECT target AS at, [source, target] AS path FROM ee UNION ALL SELECT ee.target, list_append(path, ee.target) FROM sp JOIN ee ON ee.source = sp.at WHERE len(path) < 4 AND NOT list_contains(path, ee.target))", recursive=True))
def _(g):
    return traverse.shortest_cycles(g.edges, 4)


@query("call_chains", sql("SELECT names, count(*) AS n FROM (SELECT split_part(a.source, '::', 2) || ' > ' || split_part(b.source, '::', 2) || ' > ' || split_part(b.target, '::', 2) AS names FROM ee a JOIN ee b ON b.source = a.target WHERE b.target <> a.source) GROUP BY 1 HAVING count(*) > 1", _EE))
def _(g):
    kinds = F.array_join(F.transform("path", lambda q: F.split_part(q, F.lit("::"), F.lit(2))), " > ")
    return traverse.call_chains(g.edges, 3).groupBy(kinds.alias("names")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _walks(rounds: int) -> str:
    parts = ["k0 AS (SELECT source AS qn FROM ee UNION SELECT target FROM ee)"]
    for d in range(1, rounds + 1):
        parts.append(f"k{d} AS (SELECT DISTINCT source AS qn FROM ee WHERE target IN (SELECT qn FROM k{d - 1}))")
    union = " UNION ALL ".join(f"SELECT qn, {d} AS depth FROM k{d}" for d in range(rounds + 1))
    return ",\n".join([*parts, f"kd AS ({union})"])


@query("dep_depth", sql("SELECT qn, max(depth)::INTEGER AS depth FROM kd GROUP BY 1", _EE, _walks(6)))
def _(g):
    return traverse.longest_depths(g.edges, 6)


@query("symbol_context", sql("""SELECT seed, role, qn FROM (SELECT *, row_number() OVER (PARTITION BY seed, role ORDER BY confidence DESC, qn) AS r FROM (
  SELECT target AS seed, 'caller' AS role, source AS qn, max(confidence) AS confidence FROM edges WHERE kind = 'calls' GROUP BY 1, 3
  UNION ALL SELECT source, 'callee', target, max(confidence) FROM edges WHERE kind = 'calls' AND target IN (SELECT qn FROM nodes) GROUP BY 1, 3
  UNION ALL SELECT source, 'import', target, max(confidence) FROM edges WHERE kind = 'imports' AND target IN (SELECT qn FROM nodes) GROUP BY 1, 3)) WHERE r <= 3"""))
def _(g):
    known = g.nodes.select("qn")

    def role(kind, key, other, name):
        picked = g.edges.filter(F.col("kind") == kind).groupBy(F.col(key).alias("seed"), F.col(other).alias("qn")).agg(F.max("confidence").alias("confidence"))
        return picked.join(known, "qn", "left_semi").select("seed", F.lit(name).alias("role"), "qn", "confidence")

    parts = role("calls", "target", "source", "caller").unionByName(role("calls", "source", "target", "callee")).unionByName(role("imports", "source", "target", "import"))
    return scan.top_per_key(parts, ["seed", "role"], [F.col("confidence").desc(), F.col("qn")], 3).select("seed", "role", "qn")


@query("caller_callee_paths", sql("SELECT a.source AS caller, a.target AS middle, b.target AS callee, round(a.confidence + b.confidence, 6) AS score FROM edges a JOIN edges b ON b.source = a.target WHERE a.kind = 'calls' AND b.kind = 'calls' QUALIFY row_number() OVER (PARTITION BY a.target ORDER BY round(a.confidence + b.confidence, 6) DESC, a.source, b.target) <= 5"))
def _(g):
    calls = g.edges.filter("kind = 'calls'")
    a = calls.select(F.col("source").alias("caller"), F.col("target").alias("middle"), F.col("confidence").alias("c1"))
    b = calls.select(F.col("source").alias("middle"), F.col("target").alias("callee"), F.col("confidence").alias("c2"))
    # the best five paths run through the best five callers and callees
    a = scan.top_per_key(a, ["middle"], [F.col("c1").desc(), F.col("caller")], 5)
    b = scan.top_per_key(b, ["middle"], [F.col("c2").desc(), F.col("callee")], 5)
    paths = a.join(b, "middle").select("caller", "middle", "callee", F.round(F.col("c1") + F.col("c2"), 6).alias("score"))
    return scan.top_per_key(paths, ["middle"], [F.col("score").desc(), F.col("caller"), F.col("callee")], 5)


@query("dead_code_reasons", sql("SELECT d.qn, CASE WHEN d.qn IN (SELECT target FROM edges) THEN 'contained only' ELSE 'no inbound edge' END AS reason, CASE WHEN d.kind IN ('trait', 'class', 'struct') THEN 'medium' ELSE 'high' END AS certainty FROM dead d WHERE d.name NOT IN ('main', 'new', 'default', 'init', 'setup', 'teardown')", DEAD))
def _(g):
    dead = joins.dead_code(g.nodes, g.edges).filter(~F.col("name").isin("main", "new", "default", "init", "setup", "teardown"))
    held = g.edges.select(F.col("target").alias("qn"), F.lit(True).alias("held")).distinct()
    return dead.join(held, "qn", "left").select(
        "qn", F.when(F.col("held"), "contained only").otherwise("no inbound edge").alias("reason"), F.when(F.col("kind").isin("trait", "class", "struct"), "medium").otherwise("high").alias("certainty")
    )


@query("rename_chain", """WITH RECURSIVE e AS (SELECT DISTINCT repo_id || '#' || parent_sha AS old_path, repo_id || '#' || commit_sha AS path FROM commits WHERE parent_sha IS NOT NULL),
r AS (SELECT path, old_path AS origin, 1 AS hops FROM e UNION SELECT r.path, e.old_path, hops + 1 FROM r JOIN e ON e.path = r.origin WHERE hops < 20)
SELECT path, arg_max(origin, hops) AS origin, max(hops)::INTEGER AS hops FROM r GROUP BY 1""")
def _(g):
    # the parent chain of commits has the form of a rename chain
    links = g.t("commits").filter("parent_sha is not null").select(F.concat_ws("#", "repo_id", "parent_sha").alias("old_path"), F.concat_ws("#", "repo_id", "commit_sha").alias("path"))
    return traverse.rename_chain(links)


@query("reference_depths", sql("""SELECT pl.qn, max(w.d)::INTEGER AS depth FROM pl JOIN w ON w.place = pl.place GROUP BY 1""", _EE,
    "cl AS (SELECT source AS a, target AS b FROM ee UNION SELECT cl.a, ee.target FROM cl JOIN ee ON ee.source = cl.b)",
    "pl AS (SELECT n.qn, coalesce(min(x.b), n.qn) AS place FROM (SELECT source AS qn FROM ee UNION SELECT target FROM ee) n LEFT JOIN (SELECT x.a, x.b FROM cl x JOIN cl y ON x.a = y.b AND x.b = y.a) x ON x.a = n.qn GROUP BY n.qn)",
    "co AS (SELECT DISTINCT p.place AS a, q.place AS b FROM ee JOIN pl p ON p.qn = ee.source JOIN pl q ON q.qn = ee.target WHERE p.place <> q.place)",
    "w AS (SELECT DISTINCT place, 0 AS d FROM pl UNION SELECT co.a, w.d + 1 FROM w JOIN co ON co.b = w.place)", recursive=True))
def _(g):
    """Longest path of references from each symbol, of any length, a cycle counting as one symbol."""
    return traverse.longest_depths(g.edges)


@query("reference_paths", None)
def _(g):
    """The symbols along it."""
    return traverse.longest_paths(g.edges).select("qn", F.size("path").alias("nodes"), F.array_join("path", " > ").alias("path"))


@query("cycle_paths", None)
def _(g):
    """One shortest cycle of modules through the first module of each strongly connected component."""
    return traverse.cycle_paths(module_edges(g))


@query("call_chain_lengths", sql("SELECT names, nodes, count(*) AS n FROM (SELECT split_part(a.source, '::', 2) || ' > ' || split_part(a.target, '::', 2) || ' > ' || split_part(b.target, '::', 2) AS names, 3 AS nodes FROM ee a JOIN ee b ON b.source = a.target WHERE b.target <> a.source UNION ALL SELECT split_part(a.source, '::', 2) || ' > ' || split_part(a.target, '::', 2) || ' > ' || split_part(b.target, '::', 2) || ' > ' || split_part(c.target, '::', 2), 4 FROM ee a JOIN ee b ON b.source = a.target JOIN ee c ON c.source = b.target WHERE b.target <> a.source AND c.target NOT IN (a.source, a.target)) GROUP BY 1, 2 HAVING count(*) > 1", _EE))
def _(g):
    """Sequences of kinds along call chains of three and four symbols that come more than once."""
    kinds = F.array_join(F.transform("path", lambda q: F.split_part(q, F.lit("::"), F.lit(2))), " > ")
    chains = traverse.call_chains(g.edges, 3, 4)
    return chains.groupBy(kinds.alias("names"), F.size("path").alias("nodes")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
