"""Queries on scans, filters and joins of the property graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import joins, scan
from graphloom.plans.adapter import Graph, sql

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None):
    """Registers f(graph) under the name with its SQL."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return register


CHANGED = """changed AS (SELECT n.path FROM last_listing n JOIN snap_order o ON o.repo_id = n.repo_id AND o.next_id IS NULL
  LEFT JOIN listing p ON p.repo_id = n.repo_id AND p.pos = o.pos - 1 AND p.path = n.path
  WHERE o.pos > 1 AND (p.path IS NULL OR p.file_hash <> n.file_hash))"""


def changed_files(g: Graph):
    """Files of the last snapshots that are new or have another hash than in the snapshot before."""
    last = g.order.filter(F.col("next_id").isNull() & (F.col("pos") > 1)).select("repo_id", "pos")
    now = g.last.join(last, ["repo_id", "pos"], "left_semi").select("repo_id", "path", "file_hash")
    before = g.listing.join(last.withColumn("pos", F.col("pos") - 1), ["repo_id", "pos"], "left_semi").select("repo_id", "path", F.col("file_hash").alias("old_hash"), F.lit(True).alias("was"))
    return now.join(before, ["repo_id", "path"], "left").filter(F.col("was").isNull() | (F.col("file_hash") != F.col("old_hash"))).select("path")


@query("node_scan", sql("SELECT repo_id, qn, name, kind, file_path, language, line_start, line_end, modifiers, params, is_test FROM nodes"))
def _(g):
    return g.nodes.select("repo_id", "qn", "name", "kind", "file_path", "language", "line_start", "line_end", "modifiers", "params", "is_test")


@query("edge_scan", sql("SELECT repo_id, source, target, kind, confidence, tier FROM edges"))
def _(g):
    return g.edges.select("repo_id", "source", "target", "kind", "confidence", "tier")


@query("file_scan", sql("SELECT repo_id, path, hash, language, coalesce(size, -1) AS size FROM files"))
def _(g):
    return g.files.withColumn("size", F.coalesce("size", F.lit(-1)))


@query("nodes_of_changed_files", sql("SELECT qn, file_path FROM nodes WHERE file_path IN (SELECT path FROM changed)", CHANGED))
def _(g):
    return scan.by_keys(g.nodes, changed_files(g).withColumnRenamed("path", "file_path"), "file_path").select("qn", "file_path")


@query("edges_of_changed_files", sql("SELECT source, target, kind FROM edges WHERE file_path IN (SELECT path FROM changed)", CHANGED))
def _(g):
    return scan.by_keys(g.edges, changed_files(g).withColumnRenamed("path", "file_path"), "file_path").select("source", "target", "kind")


@query("nodes_by_result_names", sql("SELECT qn FROM nodes WHERE qn IN (SELECT repo_id || '#' || qualified_name FROM batch_results)"))
def _(g):
    return scan.by_keys(g.nodes, g.t("batch_results").select(F.concat_ws("#", "repo_id", "qualified_name").alias("qn")).filter(F.col("qn").contains("#")), "qn").select("qn")


@query("first_nodes_by_name", sql("SELECT name, qn, rank FROM (SELECT name, qn, row_number() OVER (PARTITION BY name ORDER BY file_path, line_start, qn) AS rank FROM nodes) WHERE rank <= 3"))
def _(g):
    return scan.top_per_key(g.nodes.select("name", "qn", "file_path", "line_start"), ["name"], [F.col("file_path"), F.col("line_start"), F.col("qn")], 3, "rank").select("name", "qn", "rank")


@query("callables_by_language_name", sql("SELECT language, name, count(*) AS n, min(qn) AS first_qn FROM nodes WHERE kind IN ('function', 'method', 'test') GROUP BY 1, 2"))
def _(g):
    return scan.callables(g.nodes).groupBy("language", "name").agg(F.count(F.lit(1)).alias("n"), F.min("qn").alias("first_qn"))


@query("paths_with_prefix", sql("SELECT path FROM files WHERE lower(split_part(path, '#', 2)) LIKE 'src/%'"))
def _(g):
    return scan.with_prefix(g.files.withColumn("local", F.split_part("path", F.lit("#"), F.lit(2))), "local", "SRC/").select("path")


@query("commit_log", sql("SELECT repo_id, commit_sha, author_time, rank FROM (SELECT repo_id, commit_sha, author_time, row_number() OVER (PARTITION BY repo_id ORDER BY author_time DESC, commit_sha) AS rank FROM c0) WHERE rank <= 5"))
def _(g):
    commits = g.t("commits").groupBy("repo_id", "commit_sha").agg(F.min("author_time").alias("author_time"))
    return scan.top_per_key(commits, ["repo_id"], [F.col("author_time").desc(), F.col("commit_sha")], 5, "rank")


@query("snapshots_ordered", sql("SELECT repo_id, snapshot_id, pos, coalesce(next_id, -1) AS next_id FROM snap_order"))
def _(g):
    return g.order.withColumn("next_id", F.coalesce("next_id", F.lit(-1)))


@query("latest_commit", sql("SELECT repo_id, arg_max(commit_sha, (author_time, commit_sha)) AS commit_sha FROM c0 GROUP BY 1"))
def _(g):
    return g.t("commits").groupBy("repo_id").agg(F.max_by("commit_sha", F.struct("author_time", "commit_sha")).alias("commit_sha"))


@query("change_set", sql("""SELECT coalesce(n.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change_type
  FROM (SELECT * FROM last_listing WHERE (repo_id, pos) IN (SELECT (repo_id, pos) FROM snap_order WHERE pos > 1)) n
  FULL JOIN (SELECT l.* FROM listing l JOIN snap_order o ON o.repo_id = l.repo_id AND o.next_id IS NULL AND l.pos = o.pos - 1) p USING (path)
  WHERE p.path IS NULL OR n.path IS NULL OR n.file_hash <> p.file_hash"""))
def _(g):
    last = g.order.filter(F.col("next_id").isNull() & (F.col("pos") > 1)).select("repo_id", "pos")
    now = g.last.join(last, ["repo_id", "pos"], "left_semi").select("path", F.col("file_hash").alias("new_hash"), F.lit(1).alias("n"))
    old = g.listing.join(last.withColumn("pos", F.col("pos") - 1), ["repo_id", "pos"], "left_semi").select("path", F.col("file_hash").alias("old_hash"), F.lit(1).alias("o"))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("new_hash") != F.col("old_hash"), "modified")
    return now.join(old, "path", "full").select("path", kind.alias("change_type")).filter(F.col("change_type").isNotNull())


_TWO = """nw AS (SELECT * FROM last_listing WHERE (repo_id, pos) IN (SELECT (repo_id, pos) FROM snap_order WHERE pos > 1)),
ol AS (SELECT l.* FROM listing l JOIN snap_order o ON o.repo_id = l.repo_id AND o.next_id IS NULL AND l.pos = o.pos - 1),
ad AS (SELECT n.repo_id, n.path, n.file_hash FROM nw n WHERE n.path NOT IN (SELECT path FROM ol) AND n.file_hash IS NOT NULL), de AS (SELECT o.repo_id, o.path, o.file_hash FROM ol o WHERE o.path NOT IN (SELECT path FROM nw) AND o.file_hash IS NOT NULL)"""


@query("renamed_files", sql("SELECT d.path AS old_path, a.path FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file_hash ORDER BY path) AS n FROM ad) a JOIN (SELECT *, row_number() OVER (PARTITION BY repo_id, file_hash ORDER BY path) AS n FROM de) d USING (repo_id, file_hash, n)", _TWO))
def _(g):
    """Files that went and came under another path with the same hash since the snapshot before; several of one hash in order of their paths."""
    last = g.order.filter(F.col("next_id").isNull() & (F.col("pos") > 1)).select("repo_id", "pos")
    now = g.last.join(last, ["repo_id", "pos"], "left_semi").select("repo_id", "path", "file_hash")
    old = g.listing.join(last.withColumn("pos", F.col("pos") - 1), ["repo_id", "pos"], "left_semi").select("repo_id", "path", "file_hash")
    return joins.renames(now, old)


@query("search_filters", sql("SELECT qn FROM nodes WHERE kind = 'function' AND language = 'rust' AND NOT is_test AND lower(split_part(file_path, '#', 2)) LIKE 'src/%' AND kind <> 'file'"))
def _(g):
    nodes = g.nodes.withColumn("file_path", F.split_part("file_path", F.lit("#"), F.lit(2)))
    return nodes.filter(scan.filters(kind="function", language="rust", is_test=False, subpath="SRC/")).select("qn")


@query("regex_scan", sql("SELECT qn, 1.0::DOUBLE AS score FROM nodes WHERE regexp_matches(name, '^(load|parse)_.*(cache|graph|index)$') OR regexp_matches(qn, '(?i)RANKING/.*::method::')"))
def _(g):
    return g.nodes.filter(scan.regex_match("^(load|parse)_.*(cache|graph|index)$", "name") | scan.regex_match("(?i)RANKING/.*::method::", "qn")).select("qn", F.lit(1.0).alias("score"))


@query("visible_nodes", sql("SELECT qn, coalesce(regexp_matches(lower(modifiers), 'pub|export'), false) AS public, kind IN ('function', 'method', 'test') AS is_callable FROM nodes"))
def _(g):
    return g.nodes.select("qn", scan.is_public(F.col("modifiers")).alias("public"), F.col("kind").isin("function", "method", "test").alias("is_callable"))


@query("ignored_files", sql("SELECT path FROM files WHERE regexp_matches(split_part(path, '#', 2), '^internal(/|$)|^.*/wire/.*\\.rs$')"))
def _(g):
    return g.files.filter(scan.ignored(F.split_part("path", F.lit("#"), F.lit(2)), ["internal/", "*/wire/*.rs"])).select("path")


@query("noncanonical_paths", "SELECT snapshot_id, file_path, regexp_replace(file_path, '^(\\./)+', '') AS canonical FROM snapshot_membership WHERE regexp_matches(file_path, '^/|^[A-Za-z]:|^\\./|(^|/)\\.\\.(/|$)|/\\./|//|/$|\\\\')")
def _(g):
    return g.t("snapshot_membership").filter(scan.noncanonical("file_path")).select("snapshot_id", "file_path", scan.canonicalise(F.col("file_path")).alias("canonical"))


@query("payload_predicate", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90 OR json_extract_string(props, '$.k') IS NULL")
def _(g):
    k = F.get_json_object("props", "$.k").cast("long")
    return g.t("events").filter((k >= 90) | k.isNull()).select("event_id", k.alias("k"))


@query("array_overlap_filter", "SELECT link_id FROM semantic_links WHERE list_has_any(via_symbols, ['corelib::io::Reader', 'corelib::time::now'])")
def _(g):
    return g.t("semantic_links").filter(F.arrays_overlap("via_symbols", F.array(F.lit("corelib::io::Reader"), F.lit("corelib::time::now")))).select("link_id")


@query("low_confidence_edges", sql("SELECT source, target, kind FROM edges WHERE tier = 'low' OR confidence < 0.5"))
def _(g):
    return g.edges.filter(scan.low_confidence()).select("source", "target", "kind")


@query("normal_names", "SELECT result_id, regexp_replace(regexp_replace(qualified_name, '^([^:]*)::(?:function|func)::', '\\1::fn::', 'i'), '^([^:]*)::constant::', '\\1::const::', 'i') AS qn FROM batch_results")
def _(g):
    return g.t("batch_results").select("result_id", scan.normal_kind_token(F.col("qualified_name")).alias("qn"))


_NEAR = "SELECT seed, qn, edge_kind, confidence, node_kind, rank FROM (SELECT e.{key} AS seed, n.qn, e.kind AS edge_kind, confidence, n.kind AS node_kind, row_number() OVER (PARTITION BY e.{key} ORDER BY confidence DESC, n.qn, e.kind) AS rank FROM edges e JOIN nodes n ON n.qn = e.{other} WHERE {where}) WHERE rank <= {limit}"
_COLS = ["seed", "qn", "edge_kind", "confidence", "node_kind", "rank"]


@query("direct_callers", sql(_NEAR.format(key="target", other="source", where="e.kind = 'calls'", limit=5)))
def _(g):
    return joins.direct_callers(g.nodes, g.edges, 5).select(*_COLS)


@query("direct_callees", sql(_NEAR.format(key="source", other="target", where="e.kind = 'calls'", limit=5)))
def _(g):
    return joins.direct_callees(g.nodes, g.edges, 5).select(*_COLS)


@query("inbound_edges", sql(_NEAR.format(key="target", other="source", where="true", limit=10)))
def _(g):
    return joins.neighbours(g.nodes, g.edges, "target", "source", 10).select(*_COLS)


@query("outbound_edges", sql(_NEAR.format(key="source", other="target", where="true", limit=10)))
def _(g):
    return joins.neighbours(g.nodes, g.edges, "source", "target", 10).select(*_COLS)


_BOTH = "SELECT e.target AS seed, n.qn, 'in' AS direction FROM edges e JOIN nodes n ON n.qn = e.source WHERE e.kind IN ({k}) AND source <> target UNION ALL SELECT e.source, n.qn, 'out' FROM edges e JOIN nodes n ON n.qn = e.target WHERE e.kind IN ({k}) AND source <> target"


@query("import_neighbors", sql(_BOTH.format(k="'imports'")))
def _(g):
    return joins.either_way(g.nodes, g.edges, ["imports"]).select("seed", "qn", "direction")


@query("test_neighbors", sql("""SELECT e.target AS seed, n.qn FROM edges e JOIN nodes n ON n.qn = e.source AND n.is_test WHERE e.kind = 'calls' AND source <> target
  UNION ALL SELECT e.source, n.qn FROM edges e JOIN nodes n ON n.qn = e.target AND n.is_test WHERE e.kind = 'calls' AND source <> target"""))
def _(g):
    return joins.either_way(g.nodes.filter("is_test"), g.edges, ["calls"]).select("seed", "qn")


@query("siblings", sql("SELECT a.qn AS seed, b.qn AS sibling FROM pn a JOIN pn b USING (file_path, parent) WHERE a.qn <> b.qn QUALIFY row_number() OVER (PARTITION BY a.qn ORDER BY b.qn) <= 10",
    "pn AS (SELECT qn, file_path, coalesce((SELECT min(source) FROM edges e WHERE e.kind = 'contains' AND e.target = n.qn), '') AS parent FROM nodes n)"))
def _(g):
    return joins.siblings(g.nodes, g.edges, 10)


_EF = "ef AS (SELECT e.source, e.target, e.kind, a.file_path AS sf, b.file_path AS tf FROM edges e JOIN nodes a ON a.qn = e.source JOIN nodes b ON b.qn = e.target)"


@query("dependents_of_files", sql("SELECT DISTINCT sf AS path FROM ef WHERE tf IN (SELECT path FROM changed) AND sf NOT IN (SELECT path FROM changed)", CHANGED, _EF))
def _(g):
    return joins.dependents(g.nodes, g.edges, changed_files(g))


@query("dependents_of_symbols", sql("""SELECT DISTINCT n.file_path AS path FROM nodes n JOIN edges e ON e.source = n.qn WHERE e.target IN (SELECT qn FROM nodes WHERE kind = 'trait')
  AND n.file_path NOT IN (SELECT file_path FROM nodes WHERE kind = 'trait')"""))
def _(g):
    return joins.dependents_of_symbols(g.nodes, g.edges, g.nodes.filter("kind = 'trait'").select("qn"))


@query("refs_into_file", sql("SELECT tf AS target_file, sf AS source_file, count(*) AS edges FROM ef WHERE sf <> tf GROUP BY 1, 2", _EF))
def _(g):
    return joins.referencing_files(g.nodes, g.edges)


@query("shared_refs", sql("SELECT * FROM (SELECT a.sf AS file_a, b.sf AS file_b, count(*) AS shared FROM (SELECT DISTINCT sf, target FROM ef WHERE sf IN (SELECT path FROM changed)) a JOIN (SELECT DISTINCT sf, target FROM ef) b USING (target) WHERE a.sf <> b.sf GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY file_a ORDER BY shared DESC, file_b) <= 20", _EF, CHANGED))
def _(g):
    return joins.co_referencing_files(g.nodes, g.edges, changed_files(g), 20)


DEAD = "dead AS (SELECT * FROM nodes n WHERE NOT coalesce(modifiers LIKE '%pub%', false) AND NOT is_test AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target = n.qn AND e.kind IN ('calls', 'references', 'imports', 'extends', 'implements')))"


@query("dead_code", sql("SELECT qn, kind FROM dead", DEAD))
def _(g):
    return joins.dead_code(g.nodes, g.edges).select("qn", "kind")


@query("orphans", sql("SELECT qn FROM nodes WHERE qn NOT IN (SELECT source FROM edges) AND qn NOT IN (SELECT target FROM edges)"))
def _(g):
    return joins.orphans(g.nodes, g.edges).select("qn")


@query("dangling", sql("SELECT source, target, kind, 'target' AS side FROM edges WHERE target NOT IN (SELECT qn FROM nodes) UNION ALL SELECT source, target, kind, 'source' FROM edges WHERE source NOT IN (SELECT qn FROM nodes)"))
def _(g):
    return joins.dangling(g.nodes, g.edges).select("source", "target", "kind", "side")


@query("unreferenced_hashes", sql("SELECT DISTINCT file_hash AS hash FROM listing WHERE file_hash IS NOT NULL AND file_hash NOT IN (SELECT hash FROM files WHERE hash IS NOT NULL)"))
def _(g):
    old = g.listing.filter(F.col("file_hash").isNotNull()).select(F.col("file_hash").alias("hash")).distinct()
    return old.join(g.files, "hash", "left_anti")


@query("one_hop", sql("SELECT DISTINCT qn FROM (SELECT target AS qn FROM edges WHERE source IN (SELECT qn FROM nodes WHERE kind = 'trait') UNION SELECT source FROM edges WHERE target IN (SELECT qn FROM nodes WHERE kind = 'trait')) WHERE qn NOT IN (SELECT qn FROM nodes WHERE kind = 'trait')"))
def _(g):
    return joins.one_hop(g.edges, g.nodes.filter("kind = 'trait'").select("qn"))


@query("snapshot_nodes", sql("SELECT snapshot_id, count(*) AS nodes, count(DISTINCT file_path) AS files FROM hnodes GROUP BY 1"))
def _(g):
    return g.node_rows(g.listing, "snapshot_id").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("file_path").alias("files"))


@query("snapshot_edges", sql("SELECT snapshot_id, kind, count(*) AS edges FROM hedges GROUP BY 1, 2"))
def _(g):
    return g.edge_rows(g.listing, "snapshot_id").groupBy("snapshot_id", "kind").agg(F.count(F.lit(1)).alias("edges"))


@query("resolve_calls", sql("""SELECT source, target, resolved, confidence FROM (
  SELECT source, target, confidence, min(resolved) AS resolved, count(*) AS n FROM (
    SELECT DISTINCT o.source, o.target, n.qn AS resolved, 0.75::DOUBLE AS confidence FROM open o JOIN nodes n ON n.repo_id = o.repo_id AND n.name = o.name JOIN ef ON ef.sf = o.from_file AND ef.tf = n.file_path AND ef.sf <> ef.tf
    UNION ALL SELECT o.source, o.target, n.qn, 0.65::DOUBLE FROM open o JOIN nodes n ON n.repo_id = o.repo_id AND n.name = o.name WHERE regexp_extract(o.from_file, '^(.*)/[^/]*$', 1) = regexp_extract(n.file_path, '^(.*)/[^/]*$', 1))
  GROUP BY 1, 2, 3 HAVING count(*) = 1) QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY confidence DESC) = 1""",
    _EF, "open AS (SELECT DISTINCT source, target, repo_id, split_part(target, '::', -1) AS name, file_path AS from_file FROM edges WHERE kind = 'calls' AND target NOT IN (SELECT qn FROM nodes))"))
def _(g):
    return joins.resolve_calls(g.edges, g.nodes)


@query("owner_prefix", sql("SELECT path, arg_max(root, length(root)) AS owner FROM files f JOIN (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root FROM files WHERE language = 'rust') r ON starts_with(f.path, r.root || '/') GROUP BY 1"))
def _(g):
    roots = g.files.filter("language = 'rust'").select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("root")).distinct()
    return joins.owners(g.files, roots.withColumn("owner", F.col("root")))


@query("concept_members", "SELECT DISTINCT concept_id, f AS file FROM (SELECT concept_id, unnest(files) AS f FROM file_concepts) WHERE f IS NOT NULL")
def _(g):
    return g.t("file_concepts").select("concept_id", F.explode("files").alias("file")).filter(F.col("file").isNotNull()).distinct()


@query("relevant_sessions", sql("SELECT session_id, count(*) AS hits, max(created_at) AS last FROM ledger l JOIN (SELECT DISTINCT '\"k\": ' || length(name) AS term FROM nodes WHERE is_test) t ON contains(lower(payload), t.term || '}') GROUP BY 1"))
def _(g):
    # focus terms are values of a payload field, so the match is an equality join, not a search per pair
    terms = g.nodes.filter("is_test").select(F.length("name").cast("string").alias("term")).distinct()
    events = g.ledger.withColumn("term", F.get_json_object("payload", "$.k"))
    return events.join(terms, "term").groupBy("session_id").agg(F.count(F.lit(1)).alias("hits"), F.max("created_at").alias("last"))
