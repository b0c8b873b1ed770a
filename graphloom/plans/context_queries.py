"""Queries on contexts, duplicates, edits and further public operators, with their SQL."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import context, duplicates, metrics, scan, temporal
from graphloom.plans.adapter import Graph, sql
from graphloom.plans.graph_queries import CHANGED, changed_files
from graphloom.plans.traverse_queries import CN, UND, _bfs, changed_nodes
from graphloom.operators import traverse
from graphloom.session import spread

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return register


_CTX = """cx AS (SELECT n.repo_id, n.qn, CASE WHEN depth = 0 THEN 'target' ELSE 'impacted' END AS reason,
  ((CASE WHEN depth = 0 THEN 100 ELSE 30 END) + greatest(20.0 - depth * 5, 0.0) + CASE WHEN regexp_matches(coalesce(modifiers, ''), 'pub|export') THEN 5 ELSE 0 END + CASE WHEN kind IN ('function', 'method') THEN 3 WHEN kind IN ('class', 'struct', 'trait') THEN 2 ELSE 0 END - CASE WHEN is_test THEN 10 ELSE 0 END)::DOUBLE AS score
  FROM b JOIN nodes n USING (qn)),
ck AS (SELECT * FROM cx QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY (reason = 'target') DESC, score DESC, qn) <= 15)"""


def review_context(g):
    reached = traverse.impact_radius(changed_nodes(g), g.edges, 2)
    nodes = reached.join(g.nodes, "qn").withColumn("reason", F.when(F.col("depth") == 0, "target").otherwise("impacted"))
    return context.trim(nodes.withColumn("score", context.node_score()), g.edges, "repo_id", 15)


@query("review_context", sql("SELECT repo_id, qn, reason, score FROM ck", CHANGED, CN, UND, _bfs("cn", "und", 2), _CTX, recursive=True))
def _(g):
    return review_context(g)[0].select("repo_id", "qn", "reason", "score")


@query("review_context_edges", sql("SELECT source, target, kind FROM edges WHERE source IN (SELECT qn FROM ck) AND target IN (SELECT qn FROM ck)", CHANGED, CN, UND, _bfs("cn", "und", 2), _CTX, recursive=True))
def _(g):
    return review_context(g)[1].select("source", "target", "kind")


@query("payload_budget", sql("SELECT repo_id, qn, used FROM (SELECT repo_id, qn, sum(length(qn)) OVER (PARTITION BY repo_id ORDER BY score DESC, qn ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM cx) WHERE used <= 600", CHANGED, CN, UND, _bfs("cn", "und", 2), _CTX, recursive=True))
def _(g):
    reached = traverse.impact_radius(changed_nodes(g), g.edges, 2)
    nodes = reached.join(g.nodes, "qn").withColumn("reason", F.when(F.col("depth") == 0, "target").otherwise("impacted")).withColumn("score", context.node_score()).withColumn("size", F.length("qn"))
    return temporal.within_budget(nodes, "repo_id", [F.col("score").desc(), F.col("qn")], "size", 600).select("repo_id", "qn", "used")


# ---- duplicates


_KW = ", ".join(f"'{k}'" for k in duplicates.KEYWORDS.split())
_PLAIN = "pw AS (SELECT work_id, try(decode(bytes)) AS t FROM parse_work WHERE bytes IS NOT NULL)"


def readable(g):
    """Files whose bytes are UTF-8, as text."""
    return g.t("parse_work").select("work_id", F.try_validate_utf8(F.col("bytes").cast("string")).alias("t")).filter("t is not null")


def decoded(g):
    """Every file with bytes as text: UTF-8, else UTF-16 where a byte order mark tells so, else Latin-1, which reads any bytes. Marks are left out."""

    @F.pandas_udf("string")
    def other(raws: pd.Series) -> pd.Series:
        return raws.map(lambda raw: raw.decode("utf-16", "replace") if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else raw.decode("latin-1"))

    files = g.t("parse_work").filter("bytes is not null").select("work_id", "bytes", F.is_valid_utf8(F.col("bytes").cast("string")).alias("utf8"))
    rest = files.filter(~F.col("utf8")).select("work_id", other("bytes").alias("t"))
    return files.filter("utf8").select("work_id", F.regexp_replace(F.col("bytes").cast("string"), "^\ufeff", "").alias("t")).unionByName(rest)


# UTF-16 by its mark and Latin-1, from the hex digits of the bytes
_DECODED = r"""pw AS (SELECT work_id, regexp_replace(coalesce(try(decode(bytes)), array_to_string(list_transform(
  CASE WHEN h[:4] = 'FFFE' THEN list_transform(regexp_extract_all(h[5:], '....'), lambda x: x[3:4] || x[1:2]) WHEN h[:4] = 'FEFF' THEN regexp_extract_all(h[5:], '....') ELSE regexp_extract_all(h, '..') END,
  lambda x: chr(('0x' || x)::INTEGER)), '')), '^\x{feff}', '') AS t FROM (SELECT work_id, bytes, hex(bytes) AS h FROM parse_work WHERE bytes IS NOT NULL))"""


@query("exact_code_groups", f"""WITH {_DECODED}, k AS (SELECT work_id, list_transform(regexp_extract_all(t, '[A-Za-z_][0-9A-Za-z_]*|[0-9]+|[^\\s\\x0b0-9A-Za-z_]'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '<num>' WHEN regexp_matches(x, '^[A-Za-z_]') AND NOT list_contains([{_KW}], lower(x)) THEN '<id>' ELSE x END) AS s FROM pw),
h AS (SELECT work_id, sha256(array_to_string(s, ' ')) AS signature FROM k WHERE len(s) >= 6) SELECT work_id, signature, members FROM h JOIN (SELECT signature, count(*) AS members FROM h GROUP BY 1 HAVING count(*) > 1) USING (signature)""")
def _(g):
    return duplicates.exact_groups(decoded(g), "work_id", "t")


@query("near_code_classes", f"""WITH RECURSIVE {_DECODED}, tk AS (SELECT work_id, regexp_extract_all(t, '[A-Za-z_][0-9A-Za-z_]*|[0-9]+|[^\\s\\x0b0-9A-Za-z_]') AS k FROM pw),
sh AS (SELECT work_id, list_sort(list_distinct(CASE WHEN len(k) = 0 THEN [] WHEN len(k) < 5 THEN [array_to_string(k, ' ')] ELSE list_transform(range(1, len(k) - 3), lambda i: array_to_string(k[i:i + 4], ' ')) END)) AS s FROM tk),
re AS (SELECT work_id, min(work_id) OVER (PARTITION BY s) AS rep, s FROM sh), fi AS (SELECT rep, s, len(s) AS n FROM re WHERE work_id = rep AND len(s) > 0), it AS (SELECT rep, n, unnest(s) AS g FROM fi),
pr AS (SELECT x.rep AS a, y.rep AS b FROM it x JOIN it y ON x.g = y.g AND x.rep < y.rep AND x.n >= 0.8 * y.n - 1e-9 AND y.n >= 0.8 * x.n - 1e-9 GROUP BY x.rep, y.rep, x.n, y.n HAVING round(count(*) / (x.n + y.n - count(*))::DOUBLE, 6) >= 0.8),
un AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr), co AS (SELECT a AS rep, a AS c FROM un UNION SELECT co.rep, un.b FROM co JOIN un ON un.a = co.c),
cl AS (SELECT rep, min(c) AS class_id FROM co GROUP BY 1), ln AS (SELECT a AS rep, count(*) AS links FROM un GROUP BY 1)
SELECT work_id, coalesce(class_id, rep) AS class_id, coalesce(links, 0) AS links FROM re LEFT JOIN cl USING (rep) LEFT JOIN ln USING (rep)""")
def _(g):
    return duplicates.near_classes(decoded(g), "work_id", duplicates.code_tokens(F.col("t")))


@query("near_item_pairs", r"""WITH t AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM eval_items),
s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, (len(w) - 3)::BIGINT), lambda i: array_to_string(w[i:i + 1], ' '))) AS g FROM t), c AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1)
SELECT a, b, similarity FROM (SELECT x.item_id AS a, y.item_id AS b, round(count(*) / (min(ca.n) + min(cb.n) - count(*))::DOUBLE, 6) AS similarity FROM s x JOIN s y ON x.g = y.g AND x.item_id < y.item_id JOIN c ca ON ca.item_id = x.item_id JOIN c cb ON cb.item_id = y.item_id GROUP BY 1, 2) WHERE similarity >= 0.15""".replace("(len(w) - 3)", "len(w)"))
def _(g):
    sets = g.t("eval_items").select("item_id", T.tokens(F.col("text")).alias("t")).select("item_id", T.shingles(F.col("t"), 2).alias("s"))
    return duplicates.near_pairs(sets.select("item_id", F.transform("s", lambda s: F.xxhash64(s)).alias("items")), "item_id", 0.15)


# ---- edits and excerpts


@query("rename_edits", sql("SELECT id, line::INTEGER AS line, before, regexp_replace(before, '\\bsnapshot\\b', 'capture', 'g') AS after FROM (SELECT id, unnest(string_split(content, chr(10))) AS before, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM chunks) WHERE regexp_matches(before, '\\bsnapshot\\b')"))
def _(g):
    return context.rename_edits(g.chunks.filter("content is not null"), "id", "content", "snapshot", "capture")


_LINES = "ln AS (SELECT id, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM chunks)"


@query("longest_runs", sql("SELECT id, start::BIGINT AS start, length FROM (SELECT id, run, min(line) AS start, count(*) AS length FROM (SELECT *, sum(blank) OVER (PARTITION BY id ORDER BY line) AS run FROM (SELECT *, CASE WHEN regexp_matches(raw, '[^ \\t\\r\\n]') THEN 0 ELSE 1 END AS blank FROM ln)) WHERE blank = 0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY length DESC, start) = 1", _LINES))
def _(g):
    return context.longest_runs(g.chunks, "id", "content").select("id", F.col("start").cast("long").alias("start"), "length")


@query("line_windows", sql("SELECT id, ((line - 1) // 51)::BIGINT AS part, count(*) AS lines, sum(strlen(raw) + 1)::BIGINT AS bytes FROM ln GROUP BY 1, 2", _LINES))
def _(g):
    return context.line_windows(g.chunks, "id", "content")


@query("excerpts", sql("SELECT id, string_agg(raw, chr(10) ORDER BY line) AS excerpt FROM ln WHERE line BETWEEN 2 AND 4 GROUP BY 1", _LINES))
def _(g):
    parts = F.slice(F.split("content", "\n"), 2, 3)
    return g.chunks.filter(F.size(F.split("content", "\n")) >= 2).select("id", F.array_join(parts, "\n").alias("excerpt"))


@query("files_by_glob", "SELECT work_id FROM parse_work WHERE regexp_matches(rel_path, '^src/.*_[a-z]+\\.rs$')")
def _(g):
    return g.t("parse_work").filter(F.col("rel_path").rlike(scan.glob_regex("src/*.rs")) & F.col("rel_path").rlike("_[a-z]+\\.rs$")).select("work_id")


@query("bounded_commits", "SELECT repo_id, commit_sha FROM (SELECT DISTINCT repo_id, commit_sha, author_time FROM commits WHERE author_time >= 1704067200 AND author_time < 1735689600) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY author_time DESC, commit_sha) <= 5")
def _(g):
    picked = g.t("commits").filter("author_time >= 1704067200 and author_time < 1735689600").select("repo_id", "commit_sha", "author_time").distinct()
    return scan.top_per_key(picked, ["repo_id"], [F.col("author_time").desc(), F.col("commit_sha")], 5).select("repo_id", "commit_sha")


@query("replayed_files", sql("SELECT repo_id, path FROM last_listing"))
def _(g):
    first = g.listing.filter("pos = 1").select("repo_id", "pos", "path", F.lit("added").alias("change"))
    diffs = temporal.diff_neighbours(g.listing.select("repo_id", "pos", "path"), ["path"], g.order).select("repo_id", "pos", "path", "change")
    return context.replay(first.unionByName(diffs))


# ---- resolution and ranking


@query("resolved_targets", sql("SELECT result_id, priority, candidates FROM (SELECT r.result_id, CASE WHEN q.qn IS NOT NULL THEN 1 WHEN m.name IS NOT NULL THEN 2 ELSE 9 END AS priority, CASE WHEN q.qn IS NOT NULL THEN 1 ELSE coalesce(m.n, 0) END AS candidates FROM batch_results r LEFT JOIN (SELECT DISTINCT qn FROM nodes) q ON q.qn = r.repo_id || '#' || r.qualified_name LEFT JOIN (SELECT name, count(*) AS n FROM nodes GROUP BY 1) m ON m.name = r.name)"))
def _(g):
    full = g.nodes.select(F.col("qn").alias("full"), F.lit(True).alias("hit"))
    named = g.nodes.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    r = g.t("batch_results").select("result_id", "name", F.when(F.col("repo_id").isNotNull(), F.concat_ws("#", "repo_id", "qualified_name")).alias("full"))
    joined = r.join(full, "full", "left").join(named, "name", "left")
    return joined.select("result_id", F.when(F.col("hit"), 1).when(F.col("n").isNotNull(), 2).otherwise(9).alias("priority"), F.when(F.col("hit"), F.lit(1)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("candidates"))


@query("decision_search", sql("SELECT id, score FROM (SELECT id, (CASE WHEN lower(title) = 'ledger' THEN 8 WHEN contains(lower(title), 'ledger') THEN 5 ELSE 0 END + CASE WHEN contains(lower(content), 'ledger') THEN 4 ELSE 0 END + CASE WHEN contains(lower(source), 'ledger') THEN 1 ELSE 0 END)::DOUBLE AS score FROM chunks) WHERE score > 0 ORDER BY score DESC, id LIMIT 20"))
def _(g):
    low = lambda c: F.coalesce(F.lower(c), F.lit(""))
    score = F.when(low("title") == "ledger", 8.0).when(low("title").contains("ledger"), 5.0).otherwise(0.0) + F.when(low("content").contains("ledger"), 4.0).otherwise(0.0) + F.when(low("source").contains("ledger"), 1.0).otherwise(0.0)
    return g.chunks.select("id", score.alias("score")).filter("score > 0").orderBy(F.col("score").desc(), "id").limit(20)


@query("saved_context", sql("SELECT repo_id, id, round(10.0::DOUBLE / (rank + 1) + CASE WHEN created_at >= TIMESTAMP '2025-06-01 00:00:00' THEN 5 ELSE 0 END, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, id) - 1 AS rank FROM chunks WHERE repo_id IS NOT NULL AND content_type = 'session')"))
def _(g):
    from pyspark.sql import Window

    w = Window.partitionBy("repo_id").orderBy(F.col("created_at").desc(), "id")
    ranked = g.chunks.filter("repo_id is not null and content_type = 'session'").withColumn("rank", F.row_number().over(w) - 1)
    recent = F.when(F.col("created_at") >= F.expr("timestamp_ntz'2025-06-01 00:00:00'"), 5.0).otherwise(0.0)
    return ranked.select("repo_id", "id", F.round(10.0 / (F.col("rank") + 1) + recent, 6).alias("score"))


@query("adjacent_assets", sql("SELECT path FROM files WHERE regexp_extract(path, '^(.*)/[^/]*$', 1) IN (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM changed) AND path NOT IN (SELECT path FROM changed)", CHANGED))
def _(g):
    changed = changed_files(g)
    folders = changed.select(metrics.folder("path").alias("folder")).distinct()
    return g.files.select("path", metrics.folder("path").alias("folder")).join(folders, "folder", "left_semi").join(changed, "path", "left_anti").select("path")


@query("expansion_terms", sql("SELECT seed, string_agg(term, ',' ORDER BY term) AS terms FROM (SELECT seed, term, row_number() OVER (PARTITION BY seed ORDER BY term) AS r FROM (SELECT DISTINCT source AS seed, split_part(target, '::', -1) AS term FROM edges)) WHERE r <= 8 GROUP BY 1"))
def _(g):
    terms = g.edges.select(F.col("source").alias("seed"), F.element_at(F.split("target", "::"), -1).alias("term")).distinct()
    kept = scan.top_per_key(terms, ["seed"], [F.col("term")], 8)
    return kept.groupBy("seed").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms"))


# ---- summaries


@query("agent_memory", sql("SELECT session_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS duties, max(created_at) AS last, count(*) FILTER (event_type = 'error') AS failures, arg_max(event_type, (created_at, id)) AS state FROM ledger GROUP BY 1"))
def _(g):
    return g.ledger.groupBy("session_id").agg(
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("duties"), F.max("created_at").alias("last"), F.count_if(F.col("event_type") == "error").alias("failures"), F.max_by("event_type", F.struct("created_at", "id")).alias("state")
    )


@query("postprocess_summary", sql("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT regexp_extract(file_path, '^(.*)/[^/]*$', 1)) FROM nodes) AS modules, (SELECT count(*) FROM nodes WHERE is_test) AS tests, (SELECT count(DISTINCT concept_id) FROM file_concepts) AS communities"))
def _(g):
    one = g.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct(metrics.folder("file_path")).alias("modules"), F.count_if("is_test").alias("tests"))
    two = g.edges.agg(F.count(F.lit(1)).alias("edges")).crossJoin(g.t("file_concepts").agg(F.count_distinct("concept_id").alias("communities")))
    return one.crossJoin(two)


@query("entity_ids", sql("SELECT id, 'mem_' || left(sha256(content_type || ':' || coalesce(title, '') || ':' || id), 16) AS memory_id FROM chunks"))
def _(g):
    return g.chunks.select("id", F.concat(F.lit("mem_"), F.left(F.sha2(F.concat_ws(":", "content_type", F.coalesce("title", F.lit("")), F.col("id").cast("string")), 256), F.lit(16))).alias("memory_id"))


@query("language_policy", "SELECT work_id, CASE orig_language WHEN 'python' THEN 'exact' WHEN 'json' THEN 'exact' WHEN 'toml' THEN 'exact' ELSE 'declarations' END AS maturity FROM parse_work WHERE orig_language IS NOT NULL")
def _(g):
    policy = g.spark.createDataFrame([(n, "exact" if n in ("python", "json", "toml") else "declarations") for n in ("python", "json", "toml", "rust", "go", "java", "c", "javascript", "typescript")], "orig_language string, maturity string")
    return g.t("parse_work").join(F.broadcast(policy), "orig_language").select("work_id", "maturity")


@query("file_modules", sql("SELECT path, coalesce('concept:' || c.concept_id, 'module:' || nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), 'module:<root>') AS module FROM files f LEFT JOIN (SELECT repo_id || '#' || file AS p, arg_max(concept_id, (n, -concept_id)) AS concept_id FROM (SELECT repo_id, f AS file, concept_id, count(*) AS n FROM (SELECT repo_id, concept_id, unnest(files) AS f FROM file_concepts) WHERE f IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1) c ON c.p = f.path"))
def _(g):
    votes = g.t("file_concepts").select("repo_id", "concept_id", F.explode("files").alias("file")).filter("file is not null").groupBy(F.concat_ws("#", "repo_id", "file").alias("path"), "concept_id").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("path").agg(F.max(F.struct("n", (-F.col("concept_id")).alias("c"))).alias("m")).select("path", F.concat(F.lit("concept:"), (-F.col("m.c")).cast("string")).alias("concept"))
    folder = metrics.folder("path")
    return g.files.select("path").join(best, "path", "left").select("path", F.coalesce("concept", F.when(folder != "", F.concat(F.lit("module:"), folder)), F.lit("module:<root>")).alias("module"))


@query("recent_files", sql("SELECT repo_id, path FROM (SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY max_at DESC, path) AS r FROM (SELECT repo_id, regexp_replace(file_path, '^(\\./)+', '') AS path, max(ingested_at) AS max_at FROM snapshot_membership GROUP BY 1, 2)) WHERE r <= 3"))
def _(g):
    from graphloom.operators.snapshots import canonical_path

    at = g.t("snapshot_membership").groupBy("repo_id", canonical_path(F.col("file_path")).alias("path")).agg(F.max("ingested_at").alias("at"))
    return scan.top_per_key(at, ["repo_id"], [F.col("at").desc(), F.col("path")], 3).select("repo_id", "path")


@query("history_counts", sql("SELECT count(DISTINCT snapshot_id) AS snapshots, count(*) AS memberships, count(DISTINCT path) AS paths FROM listing"))
def _(g):
    return g.listing.agg(F.count_distinct("snapshot_id").alias("snapshots"), F.count(F.lit(1)).alias("memberships"), F.count_distinct("path").alias("paths"))


def _complexity(batches):
    for pdf in batches:
        out = []
        for work, raw in zip(pdf["work_id"], pdf["bytes"]):
            try:
                tree = ast.parse(bytes(raw))
            except (SyntaxError, ValueError, RecursionError):
                continue
            for f in ast.walk(tree):
                if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    branches = sum(isinstance(x, (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.BoolOp, ast.IfExp, ast.comprehension)) for x in ast.walk(f))
                    out.append((work, f.name, f.lineno, branches + 1))
        yield pd.DataFrame(out, columns=["work_id", "name", "line", "complexity"]).astype({"work_id": "int64", "line": "int64", "complexity": "int64"})


@query("python_complexity", None)
def _(g):
    rows = g.t("parse_work").filter("orig_language = 'python' and bytes is not null").select("work_id", "bytes")
    return spread(rows).mapInPandas(_complexity, "work_id long, name string, line long, complexity long")


# ---- further public operators


@query("comments_above", f"""WITH {_PLAIN}, l AS (SELECT work_id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM pw WHERE t IS NOT NULL),
c AS (SELECT *, regexp_matches(raw, '^\\s*//') AS is_comment, sum(CASE WHEN regexp_matches(raw, '^\\s*//') THEN 0 ELSE 1 END) OVER (PARTITION BY work_id ORDER BY line) AS island FROM l),
n AS (SELECT work_id, max(line) + 1 AS line, count(*) AS lines FROM c WHERE is_comment GROUP BY work_id, island)
SELECT work_id, line::INTEGER AS line, least(lines, 16)::INTEGER AS lines FROM n JOIN l USING (work_id, line) WHERE regexp_matches(raw, '^(pub fn|export function|func) ')""")
def _(g):
    return context.comments_above(readable(g), "work_id", "t", r"^(pub fn|export function|func) ", r"^\s*//").select("work_id", "line", "lines")


@query("repo_graph", sql("SELECT 'repo:' || repo_id AS repo, count(*) AS files, count(DISTINCT language) AS languages FROM files GROUP BY 1"))
def _(g):
    return g.files.groupBy(F.concat(F.lit("repo:"), F.col("repo_id").cast("string")).alias("repo")).agg(F.count(F.lit(1)).alias("files"), F.count_distinct("language").alias("languages"))


@query("stripped_payloads", "SELECT event_id, CASE WHEN length(json_extract_string(props, '$.k')) <= 1 THEN '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' ELSE '{}' END AS payload FROM events")
def _(g):
    return g.t("events").select("event_id", context.strip_payload(F.col("props"), ["content", "text"], 1).alias("payload"))


@query("span_overlaps", sql("SELECT qn FROM (SELECT qn, line_start, max(line_end) OVER (PARTITION BY file_path ORDER BY line_start, line_end, qn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM nodes) WHERE line_start <= reach"))
def _(g):
    spans = g.nodes.select("file_path", F.col("line_start").alias("start"), F.col("line_end").alias("end"), F.col("qn").alias("id"))
    return context.overlapping(spans, "file_path").select(F.col("id").alias("qn"))


@query("snapshot_validation", sql("SELECT o.snapshot_id, coalesce(n.n, 0) AS counted, g.node_count AS claimed, coalesce(n.n, 0) = g.node_count AS valid FROM snap_order o JOIN (SELECT repo_id, snapshot_id, max(node_count) AS node_count FROM graph_snapshots GROUP BY 1, 2) g USING (repo_id, snapshot_id) LEFT JOIN (SELECT repo_id, snapshot_id, count(*) AS n FROM hnodes GROUP BY 1, 2) n USING (repo_id, snapshot_id)"))
def _(g):
    claimed = g.t("graph_snapshots").groupBy("repo_id", "snapshot_id").agg(F.max("node_count").alias("claimed"))
    counted = g.node_rows(g.listing, "snapshot_id").groupBy("repo_id", "snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    found = F.coalesce("n", F.lit(0))
    return g.order.join(claimed, ["repo_id", "snapshot_id"]).join(counted, ["repo_id", "snapshot_id"], "left").select("snapshot_id", found.alias("counted"), "claimed", (found == F.col("claimed")).alias("valid"))


@query("nodes_by_hash", sql("SELECT hash, count(DISTINCT qn) AS nodes, count(DISTINCT snapshot_id) AS snapshots FROM hnodes WHERE hash IS NOT NULL GROUP BY 1"))
def _(g):
    return g.node_rows(g.listing, "snapshot_id").filter("hash is not null").groupBy("hash").agg(F.count_distinct("qn").alias("nodes"), F.count_distinct("snapshot_id").alias("snapshots"))


@query("evidence_merge", "SELECT query_id, qualified_name, bool_or(kind = 'function') AS any_function, min(line_start) AS first_line, max(score) AS score FROM batch_results WHERE score IS NOT NULL AND NOT isnan(score) AND kind IS NOT NULL GROUP BY 1, 2")
def _(g):
    known = g.t("batch_results").filter("score is not null and not isnan(score) and kind is not null")
    return known.groupBy("query_id", "qualified_name").agg(F.bool_or(F.col("kind") == "function").alias("any_function"), F.min("line_start").alias("first_line"), F.max("score").alias("score"))


@query("next_in_chain", sql("SELECT source AS qn, arg_max(target, (depth, target)) AS next FROM (SELECT ee.source, ee.target, d.depth FROM ee JOIN (SELECT qn, max(depth) AS depth FROM kd GROUP BY 1) d ON d.qn = ee.target) GROUP BY 1",
    "ee AS (SELECT DISTINCT source, target FROM edges WHERE source <> target)", "k0 AS (SELECT source AS qn FROM ee UNION SELECT target FROM ee)", *(f"k{d} AS (SELECT DISTINCT source AS qn FROM ee WHERE target IN (SELECT qn FROM k{d - 1}))" for d in range(1, 5)), "kd AS (" + " UNION ALL ".join(f"SELECT qn, {d} AS depth FROM k{d}" for d in range(5)) + ")"))
def _(g):
    return traverse.next_in_chain(g.edges, 4)


@query("callable_prints", sql("SELECT qn, line_end - line_start + 1 AS loc, CASE coalesce(params, '()') WHEN '()' THEN 0 WHEN '(a)' THEN 1 ELSE 2 END AS arity, coalesce(n, 0) AS neighbours FROM nodes LEFT JOIN (SELECT qn, count(DISTINCT o) AS n FROM (SELECT source AS qn, target AS o FROM edges UNION ALL SELECT target, source FROM edges) GROUP BY 1) USING (qn) WHERE kind IN ('function', 'method')"))
def _(g):
    near = traverse.both_ways(g.edges).groupBy(F.col("src").alias("qn")).agg(F.count_distinct("dst").alias("n"))
    picked = g.nodes.filter(F.col("kind").isin("function", "method")).join(near, "qn", "left")
    return picked.select("qn", (F.col("line_end") - F.col("line_start") + 1).alias("loc"), T.arity(F.col("params")).alias("arity"), F.coalesce("n", F.lit(0)).alias("neighbours"))


@query("architecture_findings", sql("""SELECT 'coupling' AS category, module AS subject, coupling AS value FROM (SELECT m AS module, count(*) AS coupling FROM (SELECT sm AS m FROM le WHERE sm <> tm UNION ALL SELECT tm FROM le WHERE sm <> tm) GROUP BY 1) WHERE coupling >= 8
  UNION ALL SELECT 'mutual', a.sm || ' <> ' || a.tm, 2 FROM (SELECT DISTINCT sm, tm FROM le WHERE sm <> tm) a JOIN (SELECT DISTINCT sm, tm FROM le WHERE sm <> tm) b ON a.sm = b.tm AND a.tm = b.sm WHERE a.sm < a.tm""",
    "le AS (SELECT e.*, a.m AS sm, b.m AS tm FROM edges e JOIN (SELECT qn, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS m FROM nodes) a ON a.qn = e.source JOIN (SELECT qn, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS m FROM nodes) b ON b.qn = e.target)"))
def _(g):
    apart = metrics.located(g.nodes, g.edges).filter("source_module <> target_module")
    coupling = apart.select(F.explode(F.array("source_module", "target_module")).alias("subject")).groupBy("subject").agg(F.count(F.lit(1)).alias("value")).filter("value >= 8")
    pairs = apart.select("source_module", "target_module").distinct()
    back = pairs.select(F.col("target_module").alias("source_module"), F.col("source_module").alias("target_module"))
    mutual = pairs.join(back, ["source_module", "target_module"], "left_semi").filter("source_module < target_module")
    return coupling.select(F.lit("coupling").alias("category"), "subject", "value").unionByName(mutual.select(F.lit("mutual").alias("category"), F.concat_ws(" <> ", "source_module", "target_module").alias("subject"), F.lit(2).cast("long").alias("value")))


_FOLDER = "regexp_extract({}, '^(.*)/[^/]*$', 1)"
_RISK = f"""ck0 AS (SELECT repo_id, bool_or(kind IN ('class', 'struct', 'trait', 'enum', 'interface') AND modifiers LIKE '%pub%' OR kind IN ('function', 'method') AND modifiers LIKE '%pub%' AND params IS NULL AND return_type IS NULL) AS api,
  bool_or(kind IN ('function', 'method') AND modifiers LIKE '%pub%' AND (params IS NOT NULL OR return_type IS NOT NULL)) AS sig FROM cn GROUP BY 1),
uc AS (SELECT repo_id, count(*) AS uncovered FROM cn WHERE NOT is_test AND qn NOT IN (SELECT dst FROM und JOIN nodes t ON t.qn = und.src WHERE t.is_test) GROUP BY 1),
im AS (SELECT n.repo_id, count(*) AS impacted, count(*) FILTER ({_FOLDER.format('n.file_path')} NOT IN (SELECT {_FOLDER.format('file_path')} FROM cn)) AS outside FROM b JOIN nodes n USING (qn) WHERE depth > 0 GROUP BY 1)"""


@query("advanced_impact", sql("""SELECT repo_id, coalesce(impacted, 0)::BIGINT AS impacted, coalesce(outside, 0)::BIGINT AS outside, coalesce(uncovered, 0)::BIGINT AS uncovered, CASE WHEN coalesce(api, false) AND coalesce(outside, 0) > 0 THEN 'critical' WHEN coalesce(api, false) THEN 'high' WHEN coalesce(sig, false) OR coalesce(outside, 0) > 0 OR coalesce(impacted, 0) > 20 OR coalesce(uncovered, 0) > 0 THEN 'medium' ELSE 'low' END AS risk
  FROM ck0 LEFT JOIN uc USING (repo_id) LEFT JOIN im USING (repo_id)""", CHANGED, CN, UND, _bfs("cn", "und", 2), _RISK, recursive=True))
def _(g):
    from graphloom.plans.traverse_queries import change_kind

    changed = changed_nodes(g)
    kinds = changed.groupBy("repo_id").agg(F.bool_or(change_kind() == "api_change").alias("api"), F.bool_or(change_kind() == "signature_change").alias("sig"))
    covered = traverse.both_ways(g.edges).join(g.nodes.filter("is_test").select(F.col("qn").alias("src")), "src", "left_semi").select(F.col("dst").alias("qn"))
    bare = changed.filter("not is_test").join(covered, "qn", "left_anti").groupBy("repo_id").agg(F.count(F.lit(1)).alias("uncovered"))
    homes = changed.select(metrics.folder("file_path").alias("folder")).distinct().withColumn("home", F.lit(True))
    reached = scan.by_keys(g.nodes, traverse.impact_radius(changed, g.edges, 2).filter("depth > 0"), "qn").withColumn("folder", metrics.folder("file_path"))
    spread_out = reached.join(homes, "folder", "left").groupBy("repo_id").agg(F.count(F.lit(1)).alias("impacted"), F.count_if(F.col("home").isNull()).alias("outside"))
    all_ = kinds.join(bare, "repo_id", "left").join(spread_out, "repo_id", "left").fillna(0, ["uncovered", "impacted", "outside"])
    risk = (
        F.when(F.col("api") & (F.col("outside") > 0), "critical")
        .when(F.col("api"), "high")
        .when(F.col("sig") | (F.col("outside") > 0) | (F.col("impacted") > 20) | (F.col("uncovered") > 0), "medium")
        .otherwise("low")
    )
    return all_.select("repo_id", "impacted", "outside", "uncovered", risk.alias("risk"))


@query("import_cleanup", sql("SELECT DISTINCT i.source, i.target FROM edges i WHERE i.kind = 'imports' AND NOT EXISTS (SELECT 1 FROM edges u WHERE u.kind IN ('calls', 'references', 'implements', 'extends') AND u.file_path = i.file_path AND split_part(u.target, '::', 1) = split_part(i.target, '::', 1))"))
def _(g):
    home = F.split_part("target", F.lit("::"), F.lit(1))
    imports = g.edges.filter("kind = 'imports'").select("source", "target", "file_path", home.alias("home"))
    used = g.edges.filter(F.col("kind").isin("calls", "references", "implements", "extends")).select("file_path", home.alias("home"))
    return imports.join(used, ["file_path", "home"], "left_anti").select("source", "target").distinct()


@query("session_events", sql("SELECT session_id, id, created_at, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS place FROM ledger"))
def _(g):
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    return g.ledger.select("session_id", "id", "created_at", F.row_number().over(w).cast("long").alias("place"))


@query("recent_sources", sql("SELECT source, chunks, last FROM (SELECT source, count(*) AS chunks, max(created_at) AS last FROM chunks WHERE source LIKE 'wiki/%' GROUP BY 1) ORDER BY last DESC, source LIMIT 20"))
def _(g):
    per = g.chunks.filter(F.col("source").startswith("wiki/")).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.max("created_at").alias("last"))
    return per.orderBy(F.col("last").desc(), "source").limit(20)


@query("document_patches", None)
def _(g):
    from pyspark.sql import Window

    from graphloom.sources import files

    w = Window.partitionBy("source", "title").orderBy("id")
    pairs = g.chunks.filter("title is not null and source is not null").select(F.col("id").cast("string").alias("path"), F.lag("content").over(w).alias("old"), F.col("content").alias("new"))
    return files.patches(pairs.filter("old is not null")).select("path", F.length("patch").alias("length"))
