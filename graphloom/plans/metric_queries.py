"""Queries on metrics, risk and architecture, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import joins, metrics, scan
from graphloom.plans.adapter import Graph, sql

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return register


REF = "kind IN ('calls', 'references', 'imports', 'extends', 'implements')"
FOLD = "regexp_extract({}, '^(.*)/[^/]*$', 1)"
NM = f"""fi AS (SELECT target AS qn, count(*) AS c FROM edges WHERE {REF} GROUP BY 1), fo AS (SELECT source AS qn, count(*) AS c FROM edges WHERE {REF} GROUP BY 1),
nt AS (SELECT e.target AS qn, count(DISTINCT e.source) AS c FROM edges e JOIN nodes t ON t.qn = e.source AND t.is_test GROUP BY 1),
nm AS (SELECT n.repo_id, n.qn, n.name, n.kind, n.file_path, n.modifiers, n.is_test, {FOLD.format('n.file_path')} AS module, coalesce(fi.c, 0)::BIGINT AS fan_in, coalesce(fo.c, 0)::BIGINT AS fan_out, coalesce(nt.c, 0)::BIGINT AS tests,
  CASE WHEN n.kind IN ('function', 'method') THEN line_end - line_start + 1 ELSE 0 END::BIGINT AS loc FROM nodes n LEFT JOIN fi USING (qn) LEFT JOIN fo USING (qn) LEFT JOIN nt USING (qn))"""
LOC = f"""le AS (SELECT e.*, a.m AS sm, b.m AS tm FROM edges e JOIN (SELECT qn, {FOLD.format('file_path')} AS m FROM nodes) a ON a.qn = e.source JOIN (SELECT qn, {FOLD.format('file_path')} AS m FROM nodes) b ON b.qn = e.target)"""
SIDE = """un AS (SELECT qn, count(*) AS c FROM (SELECT source AS qn FROM edges WHERE tier = 'low' OR confidence < 0.5 UNION ALL SELECT target FROM edges WHERE tier = 'low' OR confidence < 0.5) GROUP BY 1),
oc AS (SELECT e.target AS qn, count(*) AS c FROM edges e JOIN nodes a ON a.qn = e.source JOIN nodes b ON b.qn = e.target WHERE a.file_path <> b.file_path GROUP BY 1),
nmod AS (SELECT qn, count(DISTINCT m) AS c FROM (SELECT source AS qn, tm AS m FROM le WHERE sm <> tm UNION ALL SELECT target, sm FROM le WHERE sm <> tm) GROUP BY 1),
cr AS (SELECT qn, count(*) AS c FROM (SELECT source AS qn FROM le WHERE sm <> tm UNION ALL SELECT target FROM le WHERE sm <> tm) GROUP BY 1),
mx AS (SELECT nm.*, coalesce(un.c, 0) AS unresolved, coalesce(cr.c, 0) AS crossings, coalesce(oc.c, 0) AS outside, coalesce(nmod.c, 0) AS modules, coalesce(regexp_matches(modifiers, 'pub|export'), false) AS pub
  FROM nm LEFT JOIN un USING (qn) LEFT JOIN cr USING (qn) LEFT JOIN oc USING (qn) LEFT JOIN nmod USING (qn))"""


@query("graph_stats", sql("SELECT kind, count(*) AS n, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM files) AS files FROM nodes GROUP BY 1"))
def _(g):
    totals = g.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(g.files.agg(F.count(F.lit(1)).alias("files")))
    return g.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(totals))


@query("edge_kind_stats", sql("SELECT kind, count(*) AS n FROM edges GROUP BY 1"))
def _(g):
    return g.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("language_stats", sql("SELECT language, count(*) AS files, sum(size)::BIGINT AS bytes FROM files WHERE size IS NOT NULL GROUP BY 1"))
def _(g):
    return g.files.filter("size is not null").groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query("top_files", sql("SELECT file_path, count(*) AS n FROM nodes GROUP BY 1 ORDER BY n DESC, file_path LIMIT 20"))
def _(g):
    return g.nodes.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "file_path").limit(20)


@query("provenance", "SELECT repo_id, count(*) AS rows, max(indexed_at) AS last_indexed FROM commits GROUP BY 1")
def _(g):
    return g.t("commits").groupBy("repo_id").agg(F.count(F.lit(1)).alias("rows"), F.max("indexed_at").alias("last_indexed"))


@query("node_metrics", sql("SELECT qn, module, fan_in, fan_out, tests, loc FROM nm", NM))
def _(g):
    return metrics.node_metrics(g.nodes, g.edges).select("qn", "module", "fan_in", "fan_out", "tests", "loc")


@query("file_metrics", sql("""SELECT file_path, nodes, avg_fan_in, avg_fan_out, coalesce(edges, 0)::BIGINT AS edges, coalesce(imports, 0)::BIGINT AS imports, test_share FROM (
  SELECT file_path, count(*) AS nodes, round(avg(fan_in), 6) AS avg_fan_in, round(avg(fan_out), 6) AS avg_fan_out, round(count(*) FILTER (is_test) / nullif(count(*) FILTER (kind IN ('function', 'method')), 0)::DOUBLE, 6) AS test_share FROM nm GROUP BY 1)
  LEFT JOIN (SELECT file_path, count(*) AS edges, count(*) FILTER (kind = 'imports') AS imports FROM edges GROUP BY 1) USING (file_path)""", NM))
def _(g):
    return metrics.file_metrics(metrics.node_metrics(g.nodes, g.edges), g.edges)


@query("module_metrics", sql(f"""SELECT module, nodes, internal, outbound, inbound, CASE WHEN nodes > 1 THEN least(1.0, round(internal / (nodes * (nodes - 1))::DOUBLE, 6)) ELSE 0.0 END::DOUBLE AS cohesion, outbound + inbound AS coupling FROM (
  SELECT s.module, nodes, coalesce(i, 0)::BIGINT AS internal, coalesce(o, 0)::BIGINT AS outbound, coalesce(n, 0)::BIGINT AS inbound FROM (SELECT {FOLD.format('file_path')} AS module, count(*) AS nodes FROM nodes GROUP BY 1) s
  LEFT JOIN (SELECT sm AS module, count(*) FILTER (sm = tm) AS i, count(*) FILTER (sm <> tm) AS o FROM le GROUP BY 1) a USING (module)
  LEFT JOIN (SELECT tm AS module, count(*) AS n FROM le WHERE sm <> tm GROUP BY 1) b USING (module))""", LOC))
def _(g):
    return metrics.module_metrics(g.nodes, g.edges)


@query("module_edges", sql("SELECT sm AS source_module, tm AS target_module, count(*) AS edges, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM le WHERE sm <> tm GROUP BY 1, 2", LOC))
def _(g):
    return metrics.module_edges(g.nodes, g.edges)


@query("module_degrees", sql("SELECT module, count(*) AS degree FROM (SELECT DISTINCT sm, tm FROM le WHERE sm <> tm) d, unnest([d.sm, d.tm]) u(module) GROUP BY 1", LOC))
def _(g):
    return metrics.module_degrees(g.nodes, g.edges)


@query("distributions", sql("SELECT kind, min(fan_in) AS least, max(fan_in) AS greatest, round(avg(fan_in), 6) AS mean, round(quantile_cont(fan_in, 0.5), 6) AS p50, round(quantile_cont(fan_in, 0.9), 6) AS p90, round(quantile_cont(fan_in, 0.95), 6) AS p95 FROM nm GROUP BY 1", NM))
def _(g):
    return metrics.distribution(metrics.node_metrics(g.nodes, g.edges), "fan_in", ["kind"])


@query("outliers", sql("SELECT qn, loc, round(cutoff, 6) AS cutoff FROM nm JOIN (SELECT kind, greatest(80.0, quantile_cont(loc, 0.95)) AS cutoff FROM nm GROUP BY 1) c USING (kind) WHERE loc > cutoff", NM))
def _(g):
    return metrics.outliers(metrics.node_metrics(g.nodes, g.edges), "loc", ["kind"], 80).select("qn", "loc", F.round("cutoff", 6).alias("cutoff"))


@query("hub_cutoff", sql("SELECT repo_id, list_sort(list(fan_in + fan_out))[round(0.9 * (count(*) - 1))::INTEGER + 1] AS value FROM nm GROUP BY 1", NM))
def _(g):
    m = metrics.node_metrics(g.nodes, g.edges).withColumn("degree", F.col("fan_in") + F.col("fan_out"))
    return metrics.nearest_rank(m, "degree", ["repo_id"], 0.9)


@query("coverage_tier", sql("""SELECT qn, CASE WHEN qn IN (SELECT qn FROM direct) THEN 'direct' WHEN qn IN (SELECT e.target FROM edges e WHERE e.kind = 'calls' AND e.source IN (SELECT qn FROM direct)) THEN 'through_callers'
  WHEN file_path IN (SELECT file_path FROM nodes WHERE is_test) THEN 'same_file' ELSE 'none' END AS coverage FROM nodes WHERE kind IN ('function', 'method') AND NOT is_test""",
    "direct AS (SELECT e.target AS qn FROM edges e JOIN nodes t ON t.qn = e.source AND t.is_test WHERE e.kind = 'calls')"))
def _(g):
    return metrics.coverage(g.nodes, g.edges)


@query("crossings", sql("SELECT qn, count(*) AS crossings FROM (SELECT source AS qn FROM le WHERE sm <> tm UNION ALL SELECT target FROM le WHERE sm <> tm) GROUP BY 1", LOC))
def _(g):
    return metrics.crossings(g.nodes, g.edges)


@query("safety_score", sql("""SELECT qn, score, CASE WHEN score >= 0.7 THEN 'safe' WHEN score >= 0.4 THEN 'caution' ELSE 'risky' END AS band FROM (SELECT qn, round(least(greatest(1.0 - (
  CASE WHEN pub THEN 0.25 ELSE 0 END::DOUBLE + least(fan_in * 0.04::DOUBLE, 0.3) + least(outside * 0.05::DOUBLE, 0.25) + CASE WHEN fan_out > 10 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN tests = 0 THEN 0.15 WHEN tests >= 3 THEN -0.05 ELSE 0 END::DOUBLE + least(unresolved * 0.03::DOUBLE, 0.2)), 0.0), 1.0), 6) AS score FROM mx)""", NM, LOC, SIDE))
def _(g):
    return metrics.safety(g.nodes, g.edges)


@query("change_risk", sql("""SELECT qn, points, CASE WHEN points >= 8 THEN 'critical' WHEN points >= 5 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT qn, (CASE WHEN pub THEN 3 ELSE 0 END + CASE WHEN tests = 0 THEN 2 ELSE 0 END + CASE WHEN crossings > 0 THEN 2 ELSE 0 END
  + CASE WHEN fan_in > 10 THEN 2 WHEN fan_in > 3 THEN 1 ELSE 0 END + CASE WHEN unresolved > 0 THEN 1 ELSE 0 END)::BIGINT AS points FROM mx)""", NM, LOC, SIDE))
def _(g):
    return metrics.change_risk(g.nodes, g.edges)


def _depths(rounds: int) -> str:
    """How many steps of references lead away from each symbol, up to so many."""
    parts = [f"r0 AS (SELECT DISTINCT source, target FROM edges WHERE {REF} AND source <> target)", "d1 AS (SELECT DISTINCT source AS qn FROM r0)"]
    parts += [f"d{d} AS (SELECT DISTINCT source AS qn FROM r0 WHERE target IN (SELECT qn FROM d{d - 1}))" for d in range(2, rounds + 1)]
    return ",\n".join([*parts, "dd AS (SELECT qn, max(depth) AS depth FROM (" + " UNION ALL ".join(f"SELECT qn, {d} AS depth FROM d{d}" for d in range(1, rounds + 1)) + ") GROUP BY 1)"])


_CYCLES = """me AS (SELECT DISTINCT sm AS source, tm AS target FROM le WHERE sm <> tm),
cl AS (SELECT source AS a, target AS b FROM me UNION SELECT cl.a, me.target FROM cl JOIN me ON me.source = cl.b),
direct AS (SELECT e.target AS qn FROM edges e JOIN nodes t ON t.qn = e.source AND t.is_test WHERE e.kind = 'calls'),
ft AS (SELECT file_path, count(*) AS c FROM nodes WHERE is_test GROUP BY 1)"""


@query("weighted_risk", sql("""SELECT qn, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT qn, round(least(greatest((CASE WHEN pub THEN 1.5 ELSE 0 END::DOUBLE + least(fan_in / 20.0::DOUBLE, 1) * 1.25::DOUBLE + least(fan_out / 10.0::DOUBLE, 1) * 0.75::DOUBLE + least(modules / 15.0::DOUBLE, 1) * 1.0::DOUBLE
  + least(coalesce(depth, 0) / 6.0::DOUBLE, 1) * 0.75::DOUBLE + least(unresolved / 3.0::DOUBLE, 1) * 1.25::DOUBLE + least(loc / 80.0::DOUBLE, 1) * 1.25::DOUBLE + CASE WHEN module IN (SELECT a FROM cl WHERE a = b) THEN 1.0 ELSE 0 END::DOUBLE
  - least(CASE WHEN tests > 0 THEN tests ELSE coalesce(ft.c, 0) END / 3.0::DOUBLE, 1) * CASE WHEN kind NOT IN ('function', 'method') OR is_test THEN 0 WHEN qn IN (SELECT qn FROM direct) THEN 1 WHEN qn IN (SELECT e.target FROM edges e WHERE e.kind = 'calls' AND e.source IN (SELECT qn FROM direct)) THEN 0.75 WHEN ft.c IS NOT NULL THEN 0.5 ELSE 0 END::DOUBLE
  ) / 11.5::DOUBLE * 100, 0), 100), 4) AS score FROM mx LEFT JOIN dd USING (qn) LEFT JOIN ft USING (file_path))""", NM, LOC, SIDE, _depths(6), _CYCLES, recursive=True))
def _(g):
    return metrics.weighted_risk(metrics.risk_factors(g.nodes, g.edges))


@query("rename_radius", sql("""SELECT n.qn, coalesce(sf, 0)::BIGINT AS same_file, coalesce(xf, 0)::BIGINT AS other_files, hit AS collides, CASE WHEN hit OR (pub AND coalesce(sf + xf, 0) > 20) THEN 'high' WHEN coalesce(man, 0) > 0 OR coalesce(sf + xf, 0) > 10 OR pub THEN 'medium' ELSE 'low' END AS risk
  FROM (SELECT *, coalesce(regexp_matches(modifiers, 'pub|export'), false) AS pub, EXISTS (SELECT 1 FROM nodes o WHERE o.file_path = x.file_path AND o.name = replace(x.name, '_', '')) AS hit FROM nodes x) n
  LEFT JOIN (SELECT e.target AS qn, count(*) FILTER (a.file_path = b.file_path) AS sf, count(*) FILTER (a.file_path <> b.file_path) AS xf, count(*) FILTER (e.tier = 'low') AS man FROM edges e JOIN nodes a ON a.qn = e.source JOIN nodes b ON b.qn = e.target GROUP BY 1) r USING (qn)"""))
def _(g):
    return metrics.rename_radius(g.nodes, g.edges, F.regexp_replace("name", "_", ""))


@query("dependency_removal", sql("SELECT n.qn, count(e.source) AS users, count(e.source) = 0 AS removable FROM nodes n LEFT JOIN edges e ON e.target = n.qn AND e.kind <> 'contains' GROUP BY 1"))
def _(g):
    users = g.edges.filter("kind <> 'contains'").groupBy(F.col("target").alias("qn")).agg(F.count(F.lit(1)).alias("users"))
    return g.nodes.select("qn").join(users, "qn", "left").select("qn", F.coalesce("users", F.lit(0)).cast("long").alias("users"), F.col("users").isNull().alias("removable"))


@query("large_functions", sql("SELECT qn, loc FROM nm WHERE kind IN ('function', 'method') AND loc >= 80 ORDER BY loc DESC, file_path, qn LIMIT 50", NM))
def _(g):
    m = metrics.node_metrics(g.nodes, g.edges)
    return m.filter(F.col("kind").isin("function", "method") & (F.col("loc") >= 80)).orderBy(F.col("loc").desc(), "file_path", "qn").limit(50).select("qn", "loc")


@query("large_ranked", sql("SELECT qn, loc, fan_in, fan_out, tests, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY loc DESC, fan_in DESC, fan_out DESC, tests, module, file_path, name, qn) AS rank FROM nm WHERE kind IN ('function', 'method')) WHERE rank <= 5", NM))
def _(g):
    m = metrics.node_metrics(g.nodes, g.edges).filter(F.col("kind").isin("function", "method"))
    order = [F.col("loc").desc(), F.col("fan_in").desc(), F.col("fan_out").desc(), F.col("tests"), F.col("module"), F.col("file_path"), F.col("name"), F.col("qn")]
    return scan.top_per_key(m, ["repo_id"], order, 5, "rank").select("qn", "loc", "fan_in", "fan_out", "tests", "rank")


@query("metric_findings", sql("""SELECT * FROM (SELECT 'high_fan_in' AS category, qn, fan_in AS value FROM nm WHERE fan_in > 2 UNION ALL SELECT 'high_fan_out', qn, fan_out FROM nm WHERE fan_out > 2 UNION ALL SELECT 'large', qn, loc FROM nm WHERE loc > 80)
  QUALIFY row_number() OVER (PARTITION BY category ORDER BY value DESC, qn) <= 50""", NM))
def _(g):
    m = metrics.node_metrics(g.nodes, g.edges)
    rules = F.array(*(F.struct(F.lit(n).alias("category"), F.col(c).alias("value"), (F.col(c) > t).alias("hit")) for n, c, t in (("high_fan_in", "fan_in", 2), ("high_fan_out", "fan_out", 2), ("large", "loc", 80))))
    hits = m.select("qn", F.explode(rules).alias("f")).select("qn", "f.*").filter("hit")
    return scan.top_per_key(hits, ["category"], [F.col("value").desc(), F.col("qn")], 50).select("category", "qn", "value")


@query("layer_violations", sql("""SELECT sm AS source_module, tm AS target_module, count(*) AS edges FROM le JOIN (VALUES ('lib', 1), ('crates', 2), ('packages', 3), ('internal', 4), ('src', 5)) a(layer, r1) ON a.layer = split_part(split_part(sm, '#', 2), '/', 1)
  JOIN (VALUES ('lib', 1), ('crates', 2), ('packages', 3), ('internal', 4), ('src', 5)) b(layer, r2) ON b.layer = split_part(split_part(tm, '#', 2), '/', 1) WHERE r1 < r2 GROUP BY 1, 2""", LOC))
def _(g):
    layers = F.create_map(*(F.lit(x) for kv in {"lib": 1, "crates": 2, "packages": 3, "internal": 4, "src": 5}.items() for x in kv))
    rank = lambda c: layers[F.split_part(F.split_part(c, F.lit("#"), F.lit(2)), F.lit("/"), F.lit(1))]
    at = metrics.located(g.nodes, g.edges)
    return at.filter(rank("source_module") < rank("target_module")).groupBy("source_module", "target_module").agg(F.count(F.lit(1)).alias("edges"))


@query("unused_modules", sql(f"SELECT DISTINCT {FOLD.format('file_path')} AS module FROM nodes WHERE {FOLD.format('file_path')} NOT IN (SELECT tm FROM le WHERE sm <> tm)", LOC))
def _(g):
    used = metrics.located(g.nodes, g.edges).filter("source_module <> target_module").select(F.col("target_module").alias("module"))
    return g.nodes.select(metrics.folder("file_path").alias("module")).distinct().join(used, "module", "left_anti")


@query("file_hotspots", "SELECT repo_id, file_path, churn, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY churn DESC, file_path) AS rank FROM (SELECT repo_id, p AS file_path, sum(change_count)::BIGINT AS churn FROM (SELECT repo_id, change_count, unnest(list_distinct(current_file_paths)) AS p FROM symbol_churn) GROUP BY 1, 2)) WHERE rank <= 3")
def _(g):
    churn = g.t("symbol_churn").select("repo_id", "change_count", F.explode(F.array_distinct("current_file_paths")).alias("file_path")).filter("file_path is not null").groupBy("repo_id", "file_path").agg(F.sum("change_count").alias("churn"))
    return scan.top_per_key(churn, ["repo_id"], [F.col("churn").desc(), F.col("file_path")], 3, "rank")


@query("edge_aggregation", sql("SELECT sm AS source_label, tm AS target_label, kind, count(*) AS n FROM le WHERE sm <> tm GROUP BY 1, 2, 3", LOC))
def _(g):
    return metrics.located(g.nodes, g.edges).filter("source_module <> target_module").groupBy(F.col("source_module").alias("source_label"), F.col("target_module").alias("target_label"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query("inferred_modules", sql(f"""SELECT m.module, files, symbols, coalesce(deps_out, 0)::BIGINT AS deps_out, coalesce(deps_in, 0)::BIGINT AS deps_in FROM (SELECT {FOLD.format('file_path')} AS module, count(DISTINCT file_path) AS files, count(*) AS symbols FROM nodes GROUP BY 1) m
  LEFT JOIN (SELECT sm AS module, count(DISTINCT tm) AS deps_out FROM le WHERE sm <> tm GROUP BY 1) o USING (module) LEFT JOIN (SELECT tm AS module, count(DISTINCT sm) AS deps_in FROM le WHERE sm <> tm GROUP BY 1) i USING (module)""", LOC))
def _(g):
    pairs = metrics.located(g.nodes, g.edges).filter("source_module <> target_module").select("source_module", "target_module").distinct()
    out = pairs.groupBy(F.col("source_module").alias("module")).agg(F.count(F.lit(1)).alias("deps_out"))
    into = pairs.groupBy(F.col("target_module").alias("module")).agg(F.count(F.lit(1)).alias("deps_in"))
    base = g.nodes.groupBy(metrics.folder("file_path").alias("module")).agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("symbols"))
    return base.join(out, "module", "left").join(into, "module", "left").fillna(0, ["deps_out", "deps_in"])


@query("file_community", "SELECT repo_id, file, arg_max(concept_id, (n, -concept_id)) AS community FROM (SELECT repo_id, f AS file, concept_id, count(*) AS n FROM (SELECT repo_id, concept_id, unnest(files) AS f FROM file_concepts) WHERE f IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _(g):
    votes = g.t("file_concepts").select("repo_id", "concept_id", F.explode("files").alias("file")).filter("file is not null").groupBy("repo_id", "file", "concept_id").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("repo_id", "file").agg(F.max(F.struct("n", (-F.col("concept_id")).alias("c"))).alias("m")).select("repo_id", "file", (-F.col("m.c")).alias("community"))


@query("component_labels", sql("""SELECT label, count(*) AS files, max(confidence) AS confidence FROM (SELECT path, 'tests' AS label, 0.9::DOUBLE AS confidence FROM files WHERE regexp_matches(path, 'test|fixture') UNION ALL SELECT path, 'storage', 0.7::DOUBLE FROM files WHERE regexp_matches(path, 'store|cache|snapshot')
  UNION ALL SELECT path, 'search', 0.8::DOUBLE FROM files WHERE regexp_matches(path, 'search|index|posting|trigram') UNION ALL SELECT path, 'parsing', 0.8::DOUBLE FROM files WHERE regexp_matches(path, 'pars|token|grammar')) GROUP BY 1"""))
def _(g):
    rules = {"tests": ("test|fixture", 0.9), "storage": ("store|cache|snapshot", 0.7), "search": ("search|index|posting|trigram", 0.8), "parsing": ("pars|token|grammar", 0.8)}
    found = F.filter(F.array(*(F.when(F.col("path").rlike(rx), F.struct(F.lit(n).alias("label"), F.lit(c).alias("confidence"))) for n, (rx, c) in rules.items())), lambda x: x.isNotNull())
    return g.files.select(F.explode(found).alias("l")).select("l.*").groupBy("label").agg(F.count(F.lit(1)).alias("files"), F.max("confidence").alias("confidence"))


@query("impacted_components", sql(f"SELECT {FOLD.format('file_path')} AS component, count(*) AS nodes, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM nodes GROUP BY 1"))
def _(g):
    return g.nodes.groupBy(metrics.folder("file_path").alias("component")).agg(F.count(F.lit(1)).alias("nodes"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def trimmed(symbols: str):
    return F.transform(symbols, lambda s: F.btrim(s, F.lit(" \t")))


@query("cross_file_links", "SELECT repo_id, from_file, to_file, count(DISTINCT s) AS strength FROM (SELECT repo_id, from_file, to_file, trim(unnest(via_symbols), ' ' || chr(9)) AS s FROM semantic_links) WHERE s <> '' GROUP BY 1, 2, 3")
def _(g):
    rows = g.t("semantic_links").select("repo_id", "from_file", "to_file", F.explode(trimmed("via_symbols")).alias("s")).filter("s <> ''")
    return rows.groupBy("repo_id", "from_file", "to_file").agg(F.count_distinct("s").alias("strength"))


@query("concept_clusters", """SELECT repo_id, from_file, file, shared, round(shared / total::DOUBLE, 6) AS density FROM (
  SELECT a.repo_id, a.from_file, b.from_file AS file, count(*) AS shared FROM t a JOIN t b ON a.repo_id = b.repo_id AND a.s = b.s AND a.from_file <> b.from_file GROUP BY 1, 2, 3)
  JOIN (SELECT repo_id, from_file, count(*) AS total FROM t GROUP BY 1, 2) USING (repo_id, from_file) QUALIFY row_number() OVER (PARTITION BY repo_id, from_file ORDER BY shared DESC, file) <= 3""".replace("SELECT repo_id, from_file, file, shared", "WITH t AS (SELECT DISTINCT repo_id, from_file, s FROM (SELECT repo_id, from_file, trim(unnest(via_symbols), ' ' || chr(9)) AS s FROM semantic_links) WHERE s <> '') SELECT repo_id, from_file, file, shared", 1))
def _(g):
    t = g.t("semantic_links").select("repo_id", "from_file", F.explode(trimmed("via_symbols")).alias("s")).filter("s <> ''").distinct()
    shared = t.join(t.withColumnRenamed("from_file", "file"), ["repo_id", "s"]).filter("from_file <> file").groupBy("repo_id", "from_file", "file").agg(F.count(F.lit(1)).alias("shared"))
    full = shared.join(t.groupBy("repo_id", "from_file").agg(F.count(F.lit(1)).alias("total")), ["repo_id", "from_file"])
    kept = scan.top_per_key(full, ["repo_id", "from_file"], [F.col("shared").desc(), F.col("file")], 3)
    return kept.select("repo_id", "from_file", "file", "shared", F.round(F.col("shared") / F.col("total"), 6).alias("density"))
