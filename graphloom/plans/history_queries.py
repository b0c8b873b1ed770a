"""Queries on history and windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import metrics, scan, temporal
from graphloom.plans.adapter import Graph, sql

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return register


LASTPOS = "lastpos AS (SELECT repo_id, max(pos) AS last FROM snap_order GROUP BY 1)"


def _presence(rows: str, keys: str, sig: str = "0") -> str:
    return f"""pr0 AS (SELECT r.repo_id, {keys}, pos, lag(pos) OVER w AS before, lead(pos) OVER w AS after, {sig} AS sig, lag({sig}) OVER w AS psig, last FROM ({rows}) r JOIN lastpos USING (repo_id) WINDOW w AS (PARTITION BY r.repo_id, {keys} ORDER BY pos)),
pr AS (SELECT repo_id, {keys}, min(pos) AS first_pos, max(pos) AS last_pos, count(*) FILTER (before IS NULL OR before < pos - 1) AS introductions, count(*) FILTER (after > pos + 1 OR (after IS NULL AND pos < last)) AS removals,
  count(*) FILTER (before = pos - 1 AND sig IS DISTINCT FROM psig) AS rewrites FROM pr0 GROUP BY ALL)"""


_PCOLS = "first_pos, last_pos, introductions, removals, removals + introductions - 1 + rewrites AS changes"
_STAB = "round(least(greatest(1.0 - (removals + introductions - 1 + rewrites) / (last_pos - first_pos + 1)::DOUBLE - (introductions + removals) / (last_pos - first_pos + 1)::DOUBLE * 0.25::DOUBLE, 0.0), 1.0), 6) AS stability"


def last_pos(g):
    return g.order.groupBy("repo_id").agg(F.max("pos").alias("last"))


@query("symbol_churn_rebuilt", sql(f"SELECT qn, {_PCOLS}, {_STAB} FROM pr", LASTPOS, _presence("SELECT repo_id, qn, pos, coalesce(hash, '') AS hash FROM hnodes", "qn", "hash")))
def _(g):
    rows = g.node_rows(g.listing, "pos")
    churn = temporal.stability(temporal.presence(rows, ["qn"], last_pos(g), F.coalesce("hash", F.lit(""))))
    return churn.select("qn", "first_pos", "last_pos", "introductions", "removals", "changes", "stability")


@query("dep_churn", sql(f"SELECT source, target, kind, {_PCOLS} FROM pr", LASTPOS, _presence("SELECT DISTINCT repo_id, source, target, kind, pos FROM hedges", "source, target, kind")))
def _(g):
    rows = g.edge_rows(g.listing, "pos").select("repo_id", "source", "target", "kind", "pos").distinct()
    return temporal.presence(rows, ["source", "target", "kind"], last_pos(g)).select("source", "target", "kind", "first_pos", "last_pos", "introductions", "removals", "changes")


_FROWS = "SELECT repo_id, path, pos, coalesce(file_hash, '') AS hash, coalesce(len(list_distinct(qualified_names)), 0) AS n, coalesce(len(list_distinct(edge_keys)), 0) AS e FROM listing"


@query("file_churn", sql(f"SELECT path, {_PCOLS}, coalesce(delta, 0)::BIGINT AS delta FROM pr JOIN (SELECT path, sum(abs(n - pn) + abs(e - pe)) AS delta FROM (SELECT path, n, e, lag(n) OVER w AS pn, lag(e) OVER w AS pe FROM ({_FROWS}) WINDOW w AS (PARTITION BY path ORDER BY pos)) GROUP BY 1) USING (path)", LASTPOS, _presence(_FROWS, "path", "hash")))
def _(g):
    from pyspark.sql import Window

    size = lambda c: F.coalesce(F.size(F.array_distinct(F.coalesce(c, F.lit(None)))), F.lit(0))
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(size(c))
    rows = g.listing.select("repo_id", "path", "pos", F.coalesce("file_hash", F.lit("")).alias("hash"), count("qualified_names").alias("n"), count("edge_keys").alias("e"))
    w = Window.partitionBy("path").orderBy("pos")
    delta = rows.withColumn("d", F.abs(F.col("n") - F.lag("n").over(w)) + F.abs(F.col("e") - F.lag("e").over(w))).groupBy("path").agg(F.coalesce(F.sum("d"), F.lit(0)).alias("delta"))
    churn = temporal.presence(rows, ["path"], last_pos(g), F.col("hash"))
    return churn.join(delta, "path").select("path", "first_pos", "last_pos", "introductions", "removals", "changes", "delta")


@query("lifecycle", sql("""SELECT qn, a.commit_sha AS first_commit, b.commit_sha AS last_commit, coalesce(c.commit_sha, '') AS removal_commit FROM (SELECT repo_id, qn, min(pos) AS f, max(pos) AS l FROM hnodes GROUP BY 1, 2) x
  JOIN snap_order a ON a.repo_id = x.repo_id AND a.pos = f JOIN snap_order b ON b.repo_id = x.repo_id AND b.pos = l LEFT JOIN snap_order c ON c.repo_id = x.repo_id AND c.pos = l + 1"""))
def _(g):
    shas = g.order.join(g.t("graph_snapshots").groupBy("repo_id", "snapshot_id").agg(F.min("commit_sha").alias("sha")), ["repo_id", "snapshot_id"]).select("repo_id", "pos", "sha")
    life = g.node_rows(g.listing, "pos").groupBy("repo_id", "qn").agg(F.min("pos").alias("f"), F.max("pos").alias("l"))
    at = lambda pos, name: shas.select(F.col("repo_id").alias("r"), F.col("pos").alias("p"), F.col("sha").alias(name))
    out = life
    for pos, name, how in (("f", "first_commit", "inner"), ("l", "last_commit", "inner"), ("l1", "removal_commit", "left")):
        key = F.col("l") + 1 if pos == "l1" else F.col(pos)
        out = out.join(at(pos, name), (F.col("repo_id") == F.col("r")) & (key == F.col("p")), how).drop("r", "p")
    return out.select("qn", "first_commit", "last_commit", F.coalesce("removal_commit", F.lit("")).alias("removal_commit"))


@query("growth", sql("SELECT repo_id, arg_max(n, pos) - arg_min(n, pos) AS growth FROM (SELECT repo_id, pos, count(*) AS n FROM hnodes GROUP BY 1, 2) GROUP BY 1"))
def _(g):
    per = g.node_rows(g.listing, "pos").groupBy("repo_id", "pos").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("repo_id").agg((F.max_by("n", "pos") - F.min_by("n", "pos")).alias("growth"))


def _diff(rows: str, keys: str) -> str:
    return f"""d0 AS (SELECT r.*, lag(pos) OVER w AS before, lead(pos) OVER w AS after, last FROM (SELECT DISTINCT repo_id, {keys}, pos FROM {rows}) r JOIN lastpos USING (repo_id) WINDOW w AS (PARTITION BY r.repo_id, {keys} ORDER BY pos)),
dd AS (SELECT repo_id, pos, {keys}, 'added' AS change FROM d0 WHERE pos > 1 AND (before IS NULL OR before < pos - 1) UNION ALL SELECT repo_id, pos + 1, {keys}, 'removed' FROM d0 WHERE pos < last AND (after IS NULL OR after > pos + 1))"""


@query("snapshot_diff_nodes", sql("SELECT repo_id, pos, qn, change FROM dd", LASTPOS, _diff("hnodes", "qn")))
def _(g):
    return temporal.diff_neighbours(g.node_rows(g.listing, "pos"), ["qn"], g.order)


@query("snapshot_diff_edges", sql("SELECT repo_id, pos, source, target, kind, change FROM dd", LASTPOS, _diff("hedges", "source, target, kind")))
def _(g):
    rows = g.edge_rows(g.listing, "pos").select("repo_id", "source", "target", "kind", "pos").distinct()
    return temporal.diff_neighbours(rows, ["source", "target", "kind"], g.order)


@query("snapshot_diff_modules", sql("SELECT repo_id, pos, regexp_extract(split_part(qn, '::', 1), '^(.*)/[^/]*$', 1) AS module, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed FROM dd GROUP BY 1, 2, 3", LASTPOS, _diff("hnodes", "qn")))
def _(g):
    d = temporal.diff_neighbours(g.node_rows(g.listing, "pos"), ["qn"], g.order)
    module = F.regexp_extract(F.split_part("qn", F.lit("::"), F.lit(1)), r"^(.*)/[^/]*$", 1)
    return d.groupBy("repo_id", "pos", module.alias("module")).agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))


@query("module_trend", sql("SELECT repo_id, pos, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS module, count(*) AS nodes, count(DISTINCT file_path) AS files FROM hnodes GROUP BY 1, 2, 3"))
def _(g):
    return g.node_rows(g.listing, "pos").groupBy("repo_id", "pos", metrics.folder("file_path").alias("module")).agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("file_path").alias("files"))


@query("retention", sql("SELECT repo_id, snapshot_id FROM snap_order QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY pos DESC) <= 2 OR author_time >= 1735689600 OR row_number() OVER (PARTITION BY repo_id, floor(author_time / 604800) ORDER BY author_time DESC, snapshot_id DESC) = 1"))
def _(g):
    times = g.t("commits").groupBy("repo_id", "commit_sha").agg(F.min("author_time").alias("author_time"))
    shas = g.t("graph_snapshots").groupBy("repo_id", "snapshot_id").agg(F.min("commit_sha").alias("commit_sha"))
    order = g.order.join(shas, ["repo_id", "snapshot_id"]).join(times, ["repo_id", "commit_sha"])
    return temporal.retention(order, 2, 1735689600)


@query("storage_diag", sql("SELECT count(*) AS memberships, count(DISTINCT file_hash) AS hashes, sum(coalesce(size, 0))::BIGINT AS bytes_total, (SELECT sum(s)::BIGINT FROM (SELECT file_hash, min(coalesce(size, 0)) AS s FROM listing WHERE file_hash IS NOT NULL GROUP BY 1)) AS bytes_distinct FROM listing WHERE file_hash IS NOT NULL"))
def _(g):
    held = g.listing.filter("file_hash is not null").groupBy("file_hash").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("all"), F.min(F.coalesce("size", F.lit(0))).alias("one"))
    return held.agg(F.sum("n").alias("memberships"), F.count(F.lit(1)).alias("hashes"), F.sum("all").alias("bytes_total"), F.sum("one").alias("bytes_distinct"))


@query("history_status", sql("SELECT repo_id, count(*) AS snapshots, max(author_time) AS last_author_time, arg_max(commit_sha, pos) AS last_commit FROM snap_order GROUP BY 1"))
def _(g):
    times = g.t("commits").groupBy("repo_id", "commit_sha").agg(F.min("author_time").alias("author_time"))
    shas = g.t("graph_snapshots").groupBy("repo_id", "snapshot_id").agg(F.min("commit_sha").alias("commit_sha"))
    order = g.order.join(shas, ["repo_id", "snapshot_id"]).join(times, ["repo_id", "commit_sha"])
    return order.groupBy("repo_id").agg(F.count(F.lit(1)).alias("snapshots"), F.max("author_time").alias("last_author_time"), F.max_by("commit_sha", "pos").alias("last_commit"))


@query("unindexed_commits", "SELECT DISTINCT repo_id, commit_sha FROM commits WHERE (repo_id, commit_sha) NOT IN (SELECT (repo_id, commit_sha) FROM graph_snapshots)")
def _(g):
    return g.t("commits").select("repo_id", "commit_sha").distinct().join(g.t("graph_snapshots"), ["repo_id", "commit_sha"], "left_anti")


@query("parse_reuse", sql("SELECT repo_id, count(*) AS files, count(DISTINCT file_hash) AS to_parse, round(1 - count(DISTINCT file_hash) / count(*)::DOUBLE, 6) AS reuse FROM listing WHERE file_hash IS NOT NULL GROUP BY 1"))
def _(g):
    per = g.listing.filter("file_hash is not null").groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("file_hash").alias("to_parse"))
    return per.withColumn("reuse", F.round(1 - F.col("to_parse") / F.col("files"), 6))


@query("build_cost", sql("SELECT repo_id, round(sum(CASE language WHEN 'rust' THEN 0.02 WHEN 'typescript' THEN 0.015 WHEN 'java' THEN 0.012 ELSE 0.01 END::DOUBLE), 6) AS seconds FROM (SELECT DISTINCT repo_id, file_hash, language FROM listing WHERE file_hash IS NOT NULL) GROUP BY 1"))
def _(g):
    cost = F.when(F.col("language") == "rust", 0.02).when(F.col("language") == "typescript", 0.015).when(F.col("language") == "java", 0.012).otherwise(0.01)
    return g.listing.filter("file_hash is not null").select("repo_id", "file_hash", "language").distinct().groupBy("repo_id").agg(F.round(F.sum(cost), 6).alias("seconds"))


@query("changed_signatures", sql("""SELECT n.repo_id, n.qn FROM (SELECT h.* FROM hnodes h JOIN lastpos ON lastpos.repo_id = h.repo_id AND h.pos = last) n JOIN (SELECT h.* FROM hnodes h JOIN lastpos ON lastpos.repo_id = h.repo_id AND h.pos = last - 1) p USING (repo_id, qn) WHERE n.hash <> p.hash""", LASTPOS))
def _(g):
    rows = g.node_rows(g.listing, "pos").join(last_pos(g), "repo_id")
    now = rows.filter("pos = last").select("repo_id", "qn", F.col("hash").alias("now"))
    old = rows.filter("pos = last - 1").select("repo_id", "qn", F.col("hash").alias("old"))
    return now.join(old, ["repo_id", "qn"]).filter("now <> old").select("repo_id", "qn")


@query("span_merge", sql("""SELECT file_path, min(line_start)::INTEGER AS start, max(line_end)::INTEGER AS "end", count(*) AS spans FROM (SELECT *, sum(CASE WHEN line_start <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file_path ORDER BY line_start, line_end) AS island FROM (
  SELECT file_path, line_start, line_end, max(line_end) OVER (PARTITION BY file_path ORDER BY line_start, line_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM nodes)) GROUP BY file_path, island"""))
def _(g):
    return temporal.merge_spans(g.nodes.select("file_path", F.col("line_start").alias("start"), F.col("line_end").alias("end")), "file_path")


@query("budget_prefix", "SELECT query_id, result_id, used FROM (SELECT query_id, result_id, sum(length(name)) OVER (PARTITION BY query_id ORDER BY score DESC, result_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM batch_results WHERE score IS NOT NULL AND NOT isnan(score)) WHERE used <= 500")
def _(g):
    rows = g.t("batch_results").filter("score is not null and not isnan(score)").withColumn("size", F.length("name"))
    return temporal.within_budget(rows, "query_id", [F.col("score").desc(), F.col("result_id")], "size", 500).select("query_id", "result_id", "used")


@query("workflow_ngrams", sql("SELECT pattern, count(*) AS n FROM (SELECT lag(k, 2) OVER w || ' > ' || lag(k) OVER w || ' > ' || k AS pattern FROM (SELECT *, json_extract_string(payload, '$.k') AS k FROM ledger WHERE event_type = 'click') WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)) WHERE pattern IS NOT NULL GROUP BY 1"))
def _(g):
    clicks = g.ledger.filter("event_type = 'click'").withColumn("k", F.get_json_object("payload", "$.k"))
    return temporal.ngrams(clicks, "session_id", ["created_at", "id"], "k", 3)


@query("evict", sql("SELECT session_id, id FROM ledger QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY priority DESC, created_at DESC, id DESC) <= 40"))
def _(g):
    return scan.top_per_key(g.ledger, ["session_id"], [F.col("priority").desc(), F.col("created_at").desc(), F.col("id").desc()], 40).select("session_id", "id")


@query("rank_in_list", "SELECT query_id, result_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, result_id) AS rank FROM batch_results WHERE score IS NOT NULL AND NOT isnan(score)")
def _(g):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "result_id")
    return g.t("batch_results").filter("score is not null and not isnan(score)").select("query_id", "result_id", F.row_number().over(w).cast("long").alias("rank"))


@query("symbol_history", sql("SELECT o.repo_id, qn, pos, commit_sha FROM hnodes JOIN snap_order o USING (repo_id, pos) WHERE kind = 'trait'"))
def _(g):
    shas = g.order.join(g.t("graph_snapshots").groupBy("repo_id", "snapshot_id").agg(F.min("commit_sha").alias("commit_sha")), ["repo_id", "snapshot_id"]).select("repo_id", "pos", "commit_sha")
    return g.node_rows(g.listing, "pos").filter("kind = 'trait'").join(shas, ["repo_id", "pos"]).select("repo_id", "qn", "pos", "commit_sha")


@query("churn_evidence", "SELECT repo_id, string_agg(DISTINCT commit_sha, ',' ORDER BY commit_sha) AS evidence FROM graph_snapshots GROUP BY 1")
def _(g):
    return g.t("graph_snapshots").groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_set("commit_sha")), ",").alias("evidence"))
