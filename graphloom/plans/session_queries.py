"""Queries on sessions, sinks, parsed sources and streams, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from graphloom.operators import ledger, metrics, scan
from graphloom.plans.adapter import Graph, sql
from graphloom.plans.graph_queries import CHANGED, changed_files
from graphloom.sources import docs, files, store
from graphloom.streaming import events as streams

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return register


@query("event_dedup", sql("SELECT session_id, event_hash, min(id) AS id FROM ledger GROUP BY 1, 2"))
def _(g):
    return ledger.dedup(g.ledger).select("session_id", "event_hash", "id")


@query("event_dedup_window", sql("SELECT id FROM (SELECT id, epoch_us(created_at) - lag(epoch_us(created_at)) OVER (PARTITION BY session_id, event_hash ORDER BY created_at, id) AS gap FROM ledger) WHERE gap IS NULL OR gap > 86400000000"))
def _(g):
    return ledger.dedup_within(g.ledger, 86400).select("id")


@query("global_access", sql("SELECT json_extract_string(payload, '$.k') AS key, count(*) AS n, min(created_at) AS first, max(created_at) AS last FROM ledger GROUP BY 1"))
def _(g):
    return ledger.access_counts(g.ledger, F.get_json_object("payload", "$.k"))


@query("frequent", sql("SELECT key, n FROM (SELECT json_extract_string(payload, '$.k') AS key, count(*) AS n, max(created_at) AS last FROM ledger WHERE event_type = 'view' GROUP BY 1) ORDER BY n DESC, last DESC, key LIMIT 10"))
def _(g):
    counts = ledger.access_counts(g.ledger.filter("event_type = 'view'"), F.get_json_object("payload", "$.k"))
    return counts.orderBy(F.col("n").desc(), F.col("last").desc(), "key").limit(10).select("key", "n")


@query("session_stats", sql("SELECT session_id, count(*) AS events, count(DISTINCT event_type) AS types, min(created_at) AS first, max(created_at) AS last, count(DISTINCT event_hash) AS hashes FROM ledger GROUP BY 1"))
def _(g):
    return g.ledger.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("event_type").alias("types"), F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.count_distinct("event_hash").alias("hashes"))


@query("compaction", sql("""SELECT id, session_id, CASE WHEN event_type = 'error' AND age = 1 THEN 90 ELSE priority END AS priority, CASE WHEN event_type = 'error' AND age = 1 THEN 'promote' WHEN age > CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 3 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 END THEN 'decay' ELSE 'keep' END AS fate
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id, event_type, coalesce(json_extract_string(payload, '$.k'), '_unknown_') ORDER BY created_at DESC, id DESC) AS age FROM ledger)"""))
def _(g):
    return ledger.compact(g.ledger)


@query("resume_state", sql("""SELECT session_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, coalesce(max(k) FILTER (event_type = 'signup' AND age = 1), '') AS intent, coalesce(string_agg(k, ',' ORDER BY created_at, id) FILTER (event_type = 'click' AND age <= 10), '') AS commands
  FROM (SELECT *, json_extract_string(payload, '$.k') AS k, row_number() OVER (PARTITION BY session_id, event_type ORDER BY created_at DESC, id DESC) AS age FROM ledger) GROUP BY 1"""))
def _(g):
    return ledger.resume(g.ledger).withColumn("intent", F.coalesce("intent", F.lit("")))


@query("memory_recall", sql("SELECT topic, id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY tier, created_at DESC, id) AS rank FROM (SELECT coalesce(lang, '?') AS topic, id, created_at, CASE WHEN title = 'Ledger' THEN 0 WHEN contains(lower(title), 'ledger') THEN 1 WHEN contains(lower(content), 'ledger') THEN 2 END AS tier FROM chunks) WHERE tier IS NOT NULL) WHERE rank <= 10"))
def _(g):
    memories = g.chunks.withColumn("topic", F.coalesce("lang", F.lit("?")))
    return ledger.recall(memories, "Ledger", 10).select("topic", "id", "tier", "rank")


@query("keyset_page", sql("SELECT created_at, id FROM ledger WHERE created_at < TIMESTAMP '2024-01-20 00:00:00' OR (created_at = TIMESTAMP '2024-01-20 00:00:00' AND id < 500) ORDER BY created_at DESC, id DESC LIMIT 50"))
def _(g):
    from datetime import datetime

    return ledger.page_after(g.ledger.select("created_at", "id"), ["created_at", "id"], [datetime(2024, 1, 20), 500], 50)


@query("size_limited_sources", sql("SELECT source, id FROM (SELECT source, id, sum(strlen(content)) OVER (PARTITION BY source ORDER BY created_at DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM chunks WHERE source IS NOT NULL) WHERE used <= 20000"))
def _(g):
    rows = g.chunks.filter("source is not null")
    return ledger.size_limited(rows, "source", [F.col("created_at").desc(), F.col("id")], F.octet_length("content"), 20000).select("source", "id")


@query("expired_sources", sql("SELECT source, count(*) AS n FROM chunks WHERE created_at < TIMESTAMP '2024-06-01 00:00:00' AND source IS NOT NULL GROUP BY 1"))
def _(g):
    return g.chunks.filter("created_at < timestamp_ntz'2024-06-01 00:00:00' and source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("weekly_buckets", "SELECT user_id, floor(epoch(ts) / 604800)::BIGINT AS week, count(*) AS n FROM events GROUP BY 1, 2")
def _(g):
    week = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 604800)
    return g.t("events").groupBy("user_id", week.alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("canonical_payloads", "SELECT event_id, '{\"event\":\"' || event_type || '\",\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS payload FROM events")
def _(g):
    pairs = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("event"), F.col("event_type"))
    return g.t("events").select("event_id", ledger.canonical_json(pairs).alias("payload"))


@query("stored_events", sql("SELECT id, event_type FROM ledger WHERE event_type IN ('error', 'purchase', 'signup') AND value > 5"))
def _(g):
    return g.ledger.filter(F.col("event_type").isin("error", "purchase", "signup") & (F.col("value") > 5)).select("id", "event_type")


@query("content_stats", sql("SELECT content_type, count(*) AS chunks, sum(strlen(content))::BIGINT AS bytes, count(DISTINCT source) AS sources FROM chunks GROUP BY 1"))
def _(g):
    return g.chunks.groupBy("content_type").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("content")).alias("bytes"), F.count_distinct("source").alias("sources"))


@query("artifact_routes", sql("SELECT id, CASE WHEN strlen(content) <= 512 THEN 'raw' WHEN strlen(content) <= 4096 THEN 'preview' ELSE 'pointer' END AS route FROM chunks"))
def _(g):
    return g.chunks.select("id", store.route(F.octet_length("content")).alias("route"))


@query("chunk_caps", sql("SELECT source, id FROM chunks WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY chunk_index, id) <= 5"))
def _(g):
    return scan.top_per_key(g.chunks.filter("source is not null"), ["source"], [F.col("chunk_index"), F.col("id")], 5).select("source", "id")


# ---- sinks: the table that a write would leave

_OLD = "oldn AS (SELECT DISTINCT h.qn, h.file_path FROM hnodes h JOIN (SELECT repo_id, max(pos) AS last FROM snap_order GROUP BY 1) l ON l.repo_id = h.repo_id AND h.pos = l.last - 1)"


def old_nodes(g):
    last = g.order.groupBy("repo_id").agg((F.max("pos") - 1).alias("pos"))
    return g.node_rows(g.listing, "pos").join(last, ["repo_id", "pos"], "left_semi").select("qn", "file_path")


@query("replace_file_slices", sql("SELECT qn, file_path FROM oldn WHERE file_path NOT IN (SELECT path FROM changed) UNION ALL SELECT qn, file_path FROM nodes WHERE file_path IN (SELECT path FROM changed)", CHANGED, _OLD))
def _(g):
    # files without nodes are cleared as well, so their paths are given as removed
    changed = changed_files(g).withColumnRenamed("path", "file_path")
    new = scan.by_keys(g.nodes.select("qn", "file_path"), changed, "file_path")
    return store.replace_slices(old_nodes(g), new, "file_path", changed)


@query("delete_file_slices", sql("SELECT qn FROM oldn WHERE file_path IN (SELECT path FROM files)", _OLD))
def _(g):
    gone = old_nodes(g).select("file_path").join(g.files.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    return store.delete_slices(old_nodes(g), gone, "file_path").select("qn")


@query("rename_files", sql("SELECT qn, CASE WHEN language = 'rust' THEN replace(file_path, '#', '#moved/') ELSE file_path END AS file_path FROM nodes WHERE language IS NOT NULL"))
def _(g):
    nodes = g.nodes.filter("language is not null")
    renames = nodes.filter("language = 'rust'").select(F.col("file_path").alias("old_path"), F.regexp_replace("file_path", "#", "#moved/").alias("new_path")).distinct()
    return store.rename_paths(nodes.select("qn", "file_path"), renames, "file_path")


@query("upsert_results", "SELECT query_id, qualified_name, result_id FROM batch_results QUALIFY row_number() OVER (PARTITION BY query_id, qualified_name ORDER BY result_id DESC) = 1")
def _(g):
    rows = g.t("batch_results").select("query_id", "qualified_name", "result_id", "returned_at")
    old, new = rows.filter("result_id % 2 = 0"), rows.filter("result_id % 2 = 1")
    return store.upsert(old, new, ["query_id", "qualified_name"], "result_id").select("query_id", "qualified_name", "result_id")


@query("distinct_historical_nodes", sql("SELECT DISTINCT hash, qn FROM hnodes WHERE hash IS NOT NULL"))
def _(g):
    return g.node_rows(g.listing, "pos").filter("hash is not null").select("hash", "qn").distinct()


@query("membership_decoded", "SELECT DISTINCT snapshot_id, q AS qn FROM (SELECT snapshot_id, unnest(string_split(array_to_string(qualified_names, chr(10)), chr(10))) AS q FROM snapshot_membership WHERE len(qualified_names) > 0)")
def _(g):
    packed = g.t("snapshot_membership").filter(F.size("qualified_names") > 0).select("snapshot_id", F.array_join("qualified_names", "\n").alias("blob"))
    return packed.select("snapshot_id", F.explode(F.split("blob", "\n")).alias("qn")).distinct()


@query("integrity", sql("SELECT 'dangling_edge' AS rule, count(*) AS n FROM edges WHERE target NOT IN (SELECT qn FROM nodes) UNION ALL SELECT 'unhashed_file', count(*) FROM files WHERE hash IS NULL UNION ALL SELECT 'unknown_language', count(*) FROM files WHERE language IS NULL"))
def _(g):
    from graphloom.operators import joins

    rules = joins.dangling(g.nodes, g.edges).filter("side = 'target'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("dangling_edge").alias("rule"), "n")
    for name, condition in (("unhashed_file", "hash is null"), ("unknown_language", "language is null")):
        rules = rules.unionByName(g.files.filter(condition).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n"))
    return rules


@query("build_budget", "SELECT repo_id, count(*) AS files, sum(n)::BIGINT AS bytes FROM (SELECT repo_id, n, row_number() OVER w AS r, sum(n) OVER w AS used FROM (SELECT repo_id, work_id, octet_length(bytes) AS n FROM parse_work WHERE bytes IS NOT NULL AND octet_length(bytes) <= 4000) WINDOW w AS (PARTITION BY repo_id ORDER BY work_id)) WHERE r <= 50 AND used <= 20000 GROUP BY 1")
def _(g):
    from pyspark.sql import Window

    w = Window.partitionBy("repo_id").orderBy("work_id")
    small = g.t("parse_work").withColumn("n", F.octet_length("bytes")).filter("n <= 4000")
    kept = small.withColumn("r", F.row_number().over(w)).withColumn("used", F.sum("n").over(w)).filter("r <= 50 and used <= 20000")
    return kept.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("bytes"))


@query("content_hashes", "SELECT work_id, sha256(bytes) AS hash FROM parse_work WHERE bytes IS NOT NULL")
def _(g):
    return g.t("parse_work").filter("bytes is not null").select("work_id", F.sha2("bytes", 256).alias("hash"))


@query("unchanged_files", sql("SELECT n.path FROM files n JOIN (SELECT DISTINCT path, file_hash FROM listing l JOIN (SELECT repo_id, max(pos) AS last FROM snap_order GROUP BY 1) x ON x.repo_id = l.repo_id AND l.pos = x.last - 1) p ON p.path = n.path AND p.file_hash = n.hash"))
def _(g):
    last = g.order.groupBy("repo_id").agg((F.max("pos") - 1).alias("pos"))
    before = g.listing.join(last, ["repo_id", "pos"], "left_semi").select("path", F.col("file_hash").alias("hash"))
    return g.files.join(before, ["path", "hash"], "left_semi").select("path")


# ---- documents of the graph


@query("docs_index", sql("SELECT file_path AS path, '# ' || file_path || chr(10) || chr(10) || string_agg(DISTINCT '- `' || name || '` (' || kind || ')', chr(10) ORDER BY '- `' || name || '` (' || kind || ')') AS page FROM nodes GROUP BY 1"))
def _(g):
    return docs.file_docs(g.nodes)


@query("diagram", sql("SELECT repo_id, 'graph LR' || chr(10) || string_agg('  ' || sm || ' -->|' || n || '| ' || tm, chr(10) ORDER BY '  ' || sm || ' -->|' || n || '| ' || tm) AS diagram FROM (SELECT e.repo_id, a.m AS sm, b.m AS tm, count(*) AS n FROM edges e JOIN (SELECT qn, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS m FROM nodes) a ON a.qn = e.source JOIN (SELECT qn, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS m FROM nodes) b ON b.qn = e.target WHERE a.m <> b.m GROUP BY 1, 2, 3) GROUP BY 1"))
def _(g):
    at = metrics.located(g.nodes, g.edges).filter("source_module <> target_module")
    return docs.mermaid(at.groupBy("repo_id", F.col("source_module").alias("source_label"), F.col("target_module").alias("target_label")).agg(F.count(F.lit(1)).alias("n")))


@query("owner_graph", sql("SELECT 'owner:' || repo_id AS owner, path FROM files"))
def _(g):
    return g.files.select(F.concat(F.lit("owner:"), F.col("repo_id").cast("string")).alias("owner"), "path")


# ---- parsed sources


@query("parsed_symbols", None)
def _(g):
    rows = g.t("parse_work").select(F.col("work_id").cast("string").alias("file"), F.coalesce("orig_language", F.lit("")).alias("language"), F.col("bytes").alias("content"))
    return files.parse_files(rows).groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n"))


def _sources(g):
    """Files that are text, named by repository and path."""
    path = F.concat_ws("#", "repo_id", F.regexp_replace("rel_path", r"^(\./)+", ""))
    rows = g.t("parse_work").filter("bytes is not null and orig_language is not null").groupBy(path.alias("file")).agg(F.min_by(F.struct("orig_language", "bytes"), "work_id").alias("r"))
    return rows.select("file", F.col("r.orig_language").alias("language"), F.col("r.bytes").alias("content"))


@query("source_nodes", None)
def _(g):
    """Declarations of all files, as nodes of a graph."""
    return files.parse_graph(_sources(g))[0]


@query("source_edges", None)
def _(g):
    """What they contain, import and call."""
    return files.parse_graph(_sources(g))[1].select("source", "target", "kind", "confidence", "tier")


@query("html_links", sql("SELECT id::VARCHAR AS file, unnest(regexp_extract_all(content, '(?i)<a href=\"([^\"]+)\"', 1)) AS name, 'a[' || (generate_subscripts(regexp_extract_all(content, '(?i)<a href=\"([^\"]+)\"', 1), 1) - 1) || ']' AS parent FROM chunks WHERE regexp_matches(content, '<[a-zA-Z]')"))
def _(g):
    rows = g.chunks.filter(F.col("content").rlike("<[a-zA-Z]")).select(F.col("id").cast("string").alias("file"), F.lit("html").alias("language"), F.encode("content", "UTF-8").alias("content"))
    return files.parse_files(rows).filter("kind = 'import'").select("file", "name", "parent")


@query("json_top_keys", "SELECT work_id::VARCHAR AS file, unnest(json_keys(t)) AS name FROM (SELECT work_id, ltrim(try(decode(bytes)), chr(65279)) AS t FROM parse_work WHERE orig_language = 'json' AND bytes IS NOT NULL) WHERE json_valid(t) AND json_type(t) = 'OBJECT'")
def _(g):
    rows = g.t("parse_work").filter("orig_language = 'json'")
    parsed = files.parse_files(rows.select(F.col("work_id").cast("string").alias("file"), F.lit("json").alias("language"), F.col("bytes").alias("content")))
    return parsed.filter("parent = ''").select("file", "name")


# ---- streams


def event_stream(g):
    schema = g.t("events").schema
    # a stream reads folders; the events table may be one file, which is then named by a glob of its own
    path = f"{g.sf_dir}/events.parquet"
    return streams.read_events(g.spark, path if os.path.isdir(path) else f"{g.sf_dir}/[e]vents.parquet", schema)


@query("stream_dedup", "SELECT DISTINCT user_id, event_type, props FROM events")
def _(g):
    return streams.run_once(streams.dedup_stream(event_stream(g), ["user_id", "event_type", "props"], "60 days")).select("user_id", "event_type", "props")


@query("stream_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(g):
    from pyspark.sql import Window

    out = streams.run_once(streams.window_counts(event_stream(g)), "update")
    latest = out.withColumn("r", F.row_number().over(Window.partitionBy("window", "event_type").orderBy(F.col("batch").desc()))).filter("r = 1")
    return latest.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("coalesced_changes", "SELECT file_path AS path, max(result_id) AS seq FROM batch_results WHERE file_path IS NOT NULL GROUP BY 1")
def _(g):
    rows = g.t("batch_results").filter("file_path is not null").select(F.col("result_id").alias("seq"), F.col("file_path").alias("path"), F.lit("modified").alias("change"), F.lit(None).cast("string").alias("old_path"))
    return streams.coalesce_changes(rows).select("path", "seq")
