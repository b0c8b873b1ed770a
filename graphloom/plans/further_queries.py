"""Queries on search words, counters, summaries, states and re-exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import context, ledger, search
from graphloom.operators.scan import top_per_key
from graphloom.plans.adapter import Graph, sql
from graphloom.plans.graph_queries import CHANGED, changed_files

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return register


# ---- full text


@query("search_words", sql("SELECT id, array_to_string(list_filter(string_split_regex(title, '[^\\p{L}\\p{N}_]+'), lambda t: t <> ''), ' ') AS words FROM chunks WHERE title IS NOT NULL"))
def _(g):
    return g.chunks.filter("title is not null").select("id", F.array_join(T.search_words(F.col("title")), " ").alias("words"))


@query("escaped_queries", """SELECT item_id, CASE WHEN regexp_full_match(text, '[ \\t\\n\\r\\f\\x0b]*[A-Za-z0-9_]+\\*?(?:[ \\t\\n\\r\\f\\x0b]+[A-Za-z0-9_]+\\*?)*[ \\t\\n\\r\\f\\x0b]*') THEN text ELSE '"' || replace(text, '"', '""') || '"' END AS query FROM eval_items
UNION ALL SELECT DISTINCT -length(title), title FROM documents WHERE regexp_full_match(title, '[A-Za-z]+')""")
def _(g):
    """Texts as queries, most of which need quotes, and titles of one word, which need none."""
    texts = g.t("eval_items").select("item_id", "text").unionByName(g.t("documents").filter(F.col("title").rlike(r"^[A-Za-z]+\z")).select((-F.length("title")).cast("long").alias("item_id"), F.col("title").alias("text")).distinct())
    return texts.select("item_id", T.escape_query(F.col("text")).alias("query"))


NODE_FIELDS = ("qn", "name", "kind", "file_path", "language", "params", "return_type", "modifiers")
WORDS = ((1, "stale"), (1, "cache"), (2, "ledger"), (3, "function"), (3, "python"), (3, "pub"))
_ASKED = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{w}')" for k, w in WORDS) + ") v(query_id, term))"
_TERMS = " UNION ALL ".join(f"SELECT qn, unnest(list_filter(string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda t: t <> '')) AS term FROM nodes" for c in NODE_FIELDS)
_BM25 = "round(sum(greatest(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (sum_len / n_docs)))), 6)"


@query("node_search", sql(f"SELECT query_id, qn, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, qn) AS rank FROM (SELECT query_id, qn, {_BM25} AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN ln USING (qn), tn GROUP BY 1, 2) QUALIFY rank <= 20",
    _ASKED, f"tt AS ({_TERMS})", "tf AS (SELECT qn, term, count(*) AS f FROM tt GROUP BY 1, 2)", "df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)", "ln AS (SELECT qn, count(*) AS len FROM tt GROUP BY 1)", "tn AS (SELECT (SELECT count(*) FROM nodes) AS n_docs, (SELECT count(*) FROM tt) AS sum_len)"))
def _(g):
    """Symbols by full text over eight columns."""
    asked = g.spark.createDataFrame(list(WORDS), "query_id long, term string")
    return search.ask(g.nodes.select(*NODE_FIELDS), "qn", {c: 1.0 for c in NODE_FIELDS}, asked, 20)


PHRASES = ((1, "ger imp"), (2, "Stale Cac"), (3, "r\u00f6\u00dfer als"), (4, "xy"))


@query("trigram_search", sql(f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, {_BM25} AS score FROM h JOIN d USING (query_id), tn GROUP BY 1, 2) QUALIFY rank <= 20",
    "ph AS (SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{p.lower()}')" for k, p in PHRASES) + ") v(query_id, phrase))", "lw AS (SELECT id, lower(content) AS low, greatest(length(content) - 2, 0) AS len FROM chunks)",
    "h AS (SELECT query_id, id, (length(low) - length(replace(low, phrase, ''))) / length(phrase)::DOUBLE AS f, len FROM lw JOIN ph ON length(phrase) >= 3 AND contains(low, phrase))",
    "d AS (SELECT query_id, count(*) AS df FROM h GROUP BY 1)", "tn AS (SELECT count(*) AS n_docs, sum(len) AS sum_len FROM lw)"))
def _(g):
    """Texts by parts of words, ranked over trigrams; phrases of two characters find nothing."""
    return search.substring_ranked(g.chunks, "id", "content", g.spark.createDataFrame(list(PHRASES), "query_id long, phrase string"), 20)


@query("fallback_search", None)
def _(g):
    """A misspelt phrase, found by its corrected words."""
    return search.with_fallback(g.chunks, "id", {"content": 1.0}, "snapshto ledgr", 20)


_SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_AT = "list_filter(range(1, len(w) + 1), lambda i: contains(w[i], '{}'))"
_BY = "coalesce(list_sum(list_transform({}, lambda a: len(list_filter({}, lambda b: abs(a - b) <= 50)))), 0)"


@query("proximity_scores", sql(f"SELECT id, ({_BY.format('p1', 'p2')} + {_BY.format('p1', 'p3')} + {_BY.format('p2', 'p3')} + CASE WHEN contains(lower(title), 'stale') THEN 5 ELSE 0 END + CASE WHEN contains(lower(title), 'cache') THEN 5 ELSE 0 END + CASE WHEN contains(lower(title), 'ledger') THEN 5 ELSE 0 END)::INTEGER AS near FROM pp WHERE near > 0",
    f"ws AS (SELECT id, title, list_filter(string_split_regex(lower(content), '{_SPACE}'), lambda x: x <> '') AS w FROM chunks)", f"pp AS (SELECT id, title, {_AT.format('stale')} AS p1, {_AT.format('cache')} AS p2, {_AT.format('ledger')} AS p3 FROM ws)"))
def _(g):
    """How near the words of a phrase stand in each text."""
    return search.proximity(g.chunks, "id", "content", "title", ["stale", "Cache", "ledger"]).filter("near > 0")


_LOAD = "list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda t: t <> '')"


@query("symbol_search", sql(f"""SELECT qn, round(base + CASE WHEN n = 'load_node' THEN 20 ELSE 0 END + CASE WHEN n <> 'load_node' AND starts_with(n, 'load_node') THEN 5 ELSE 0 END + CASE WHEN levenshtein(n, 'load_node') <= 3 AND NOT starts_with(n, 'load_node') THEN CASE levenshtein(n, 'load_node') WHEN 0 THEN 24 WHEN 1 THEN 18 WHEN 2 THEN 12 ELSE 8 END + CASE WHEN kind IN ('function', 'method') THEN 10 WHEN kind IN ('module', 'package') THEN 5 ELSE 8 END ELSE 0 END
  + CASE WHEN kind IN ('function', 'method') THEN 3 WHEN kind IN ('class', 'struct', 'trait', 'interface') THEN 2 WHEN kind = 'enum' THEN 1 ELSE 0 END + CASE WHEN regexp_matches(coalesce(modifiers, ''), 'pub|export') THEN 2 ELSE 0 END, 6)::DOUBLE AS score
  FROM (SELECT qn, max(score) AS base FROM al GROUP BY 1) JOIN nn USING (qn) ORDER BY score DESC, qn LIMIT 20""",
    f"nn AS (SELECT *, lower(name) AS n, {_LOAD} AS parts FROM nodes)", "q AS (SELECT * FROM (VALUES (1::BIGINT, 'load'), (1, 'node')) v(query_id, term))", "tt AS (SELECT qn, unnest(parts) AS term FROM nn)",
    "tf AS (SELECT qn, term, count(*) AS f FROM tt GROUP BY 1, 2)", "df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)", "ln AS (SELECT qn, count(*) AS len FROM tt GROUP BY 1)", "tn AS (SELECT (SELECT count(*) FROM nodes) AS n_docs, (SELECT count(*) FROM tt) AS sum_len)",
    f"ft AS (SELECT qn, score FROM (SELECT query_id, qn, {_BM25} AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN ln USING (qn), tn GROUP BY 1, 2) ORDER BY score DESC, qn LIMIT 60)",
    "al AS (SELECT * FROM ft UNION ALL SELECT qn, 100 FROM nn WHERE lower(qn) = 'load_node' UNION ALL SELECT qn, 80 FROM nn WHERE n = 'load_node' UNION ALL SELECT qn, 0 FROM nn WHERE levenshtein(n, 'load_node') <= 3 AND len(list_filter(parts, lambda w: w[:3] IN ('loa', 'no', 'lo') OR w[:2] IN ('loa', 'no', 'lo'))) > 0)"))
def _(g):
    """Exact names, full text and near names with boosts, as the dispatcher runs them."""
    return search.execute(g.nodes, g.edges, "load_node", fuzzy=True).select("qn", F.round("score", 6).alias("score"))


@query("context_search", None)
def _(g):
    """Search around the files of the last changes and the symbols that were asked for before."""
    known = g.t("batch_results").select("qualified_name").distinct().join(g.nodes.select(F.split_part("qn", F.lit("#"), F.lit(2)).alias("qualified_name"), "qn"), "qualified_name").select("qn").orderBy("qn").limit(10)
    return search.context_boosted(g.nodes, g.edges, "load_node cache", changed_files(g), known)


# ---- counters and states


@query("counted_tokens", sql("SELECT id, ceil(strlen(content) / 4.0)::BIGINT AS tokens, 'heuristic' AS method, 'no tokenizer is set' AS reason FROM chunks"))
def _(g):
    return context.count_tokens(g.chunks, "id", "content", context.token_counter())


_LAST = "SELECT session_id, id AS seq, payload AS snapshot FROM ledger WHERE strlen(payload) <= 64 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) = 1"


@query("resume_snapshots", sql(f"SELECT session_id, seq, snapshot, session_id IN (SELECT session_id FROM ledger WHERE event_type = 'signup') AS consumed FROM ({_LAST})"))
def _(g):
    """The last payload of each session of at most 64 bytes as its snapshot, put in two steps and consumed where there was a sign-up."""
    rows = g.ledger.select("session_id", F.col("id").alias("seq"), F.col("payload").alias("snapshot"))
    none = rows.limit(0).withColumn("consumed", F.lit(False))
    early = rows.filter("seq % 2 = 0")
    stored = ledger.put_snapshots(ledger.put_snapshots(none, early.groupBy("session_id").agg(F.max_by(F.struct("seq", "snapshot"), F.when(F.octet_length("snapshot") <= 64, F.col("seq"))).alias("s")).select("session_id", "s.*"), 64), rows, 64)
    return ledger.consume_snapshots(stored, g.ledger.filter("event_type = 'signup'"))


@query("postprocess_states", """WITH r AS (SELECT repo_id, snapshot_id, max(completeness) AS c, min(created_at) AS t FROM graph_snapshots GROUP BY 1, 2)
SELECT repo_id AS scope, CASE WHEN c = 1.0 THEN 'succeeded' WHEN c >= 0.5 THEN 'failed' ELSE 'running' END AS state, t AS began, CASE WHEN c >= 0.5 THEN t END AS ended FROM r QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY snapshot_id DESC) = 1""")
def _(g):
    """The run after each snapshot: begun at its time, finished if it is whole, failed if it is half a one, else still running."""
    runs = g.t("graph_snapshots").groupBy(F.col("repo_id").alias("scope"), "snapshot_id").agg(F.max("completeness").alias("c"), F.min("created_at").alias("at"))
    begun = runs.select("scope", (F.col("snapshot_id") * 2).alias("seq"), F.lit("begin").alias("event"), "at")
    ended = runs.filter("c >= 0.5").select("scope", (F.col("snapshot_id") * 2 + 1).alias("seq"), F.when(F.col("c") == 1.0, "finish").otherwise("fail").alias("event"), "at")
    return ledger.run_states(begun.unionByName(ended))


# ---- duplicates, summaries, order


@query("suppressed_duplicates", """WITH d AS (SELECT file_hash AS group_id, coalesce(orig_language, '') AS summary, rel_path AS path FROM parse_work WHERE file_hash IN (SELECT file_hash FROM parse_work GROUP BY 1 HAVING count(*) > 1))
SELECT DISTINCT group_id FROM d WHERE contains(group_id, 'abc') OR contains(summary, 'abc') OR starts_with(path, 'abc') OR contains(group_id, 'src/data/') OR contains(summary, 'src/data/') OR starts_with(path, 'src/data/')""")
def _(g):
    same = g.t("parse_work").select(F.col("file_hash").alias("group_id"), F.coalesce("orig_language", F.lit("")).alias("summary"), F.col("rel_path").alias("path"))
    many = same.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return context.suppressed(same.join(many, "group_id", "left_semi"), ["abc", " src/data/ ", ""])


@query("similarity_bands", "SELECT result_id, CASE WHEN score >= 0.72 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS similarity, CASE WHEN score >= 0.86 THEN 'high' WHEN score >= 0.74 THEN 'medium' ELSE 'low' END AS duplicate FROM batch_results WHERE score IS NOT NULL AND NOT isnan(score)")
def _(g):
    scored = g.t("batch_results").filter("score is not null and not isnan(score)")
    return scored.select("result_id", T.band(F.col("score"), 0.55, 0.72).alias("similarity"), T.band(F.col("score"), 0.74, 0.86).alias("duplicate"))


_NEAR = "nb AS (SELECT DISTINCT x.qn FROM (SELECT e.source AS qn, e.target AS o FROM edges e UNION ALL SELECT e.target, e.source FROM edges e) x WHERE x.o IN (SELECT qn FROM cn) AND x.qn NOT IN (SELECT qn FROM cn))"
_KEPT = """al AS (SELECT repo_id AS scope, n.qn, file_path, regexp_extract(file_path, '#([^/]+)', 1) AS component, false AS direct FROM nodes n WHERE qn IN (SELECT qn FROM nb) UNION ALL SELECT repo_id, qn, file_path, regexp_extract(file_path, '#([^/]+)', 1), true FROM cn),
rk AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY direct DESC, qn) AS rn FROM al),
kp AS (SELECT * FROM rk WHERE rn <= 20), sz AS (SELECT scope, component, count(*) AS n FROM kp GROUP BY 1, 2),
nm AS (SELECT scope, string_agg(component, ', ' ORDER BY n DESC, component) AS names FROM (SELECT * FROM sz QUALIFY row_number() OVER (PARTITION BY scope ORDER BY n DESC, component) <= 3) GROUP BY 1),
su AS (SELECT scope, count(*) AS retained, count(DISTINCT component) AS components, count(DISTINCT file_path) FILTER (NOT direct) AS beside FROM kp GROUP BY 1)"""


@query("workflow_summary", sql("""SELECT scope, retained, (SELECT count(*) FROM rk WHERE rk.scope = su.scope AND rn > 20) AS dropped, components, beside,
  CASE WHEN components <= 1 AND beside = 0 THEN 'Impact remains local to selected nodes.' ELSE concat_ws(' | ', CASE WHEN components > 1 THEN 'Impact spans ' || components || ' components: ' || names END, CASE WHEN beside > 0 THEN 'Change reaches ' || beside || ' neighboring file(s).' END) END AS effects FROM su JOIN nm USING (scope)""",
    CHANGED, "cn AS (SELECT * FROM nodes WHERE file_path IN (SELECT path FROM changed))", _NEAR, _KEPT))
def _(g):
    """What the last changes of each repository reach: twenty symbols are kept, changed ones first."""
    direct = g.nodes.join(changed_files(g).withColumnRenamed("path", "file_path"), "file_path", "left_semi")
    steps = g.edges.select(F.col("source").alias("qn"), F.col("target").alias("o")).union(g.edges.select("target", "source"))
    near = steps.join(direct.select(F.col("qn").alias("o")), "o", "left_semi").select("qn").distinct().join(direct, "qn", "left_anti")
    cols = [F.col("repo_id").alias("scope"), "qn", "file_path", F.regexp_extract("file_path", "#([^/]+)", 1).alias("component")]
    all_ = g.nodes.join(near, "qn", "left_semi").select(*cols, F.lit(False).alias("direct")).unionByName(direct.select(*cols, F.lit(True).alias("direct")))
    ranked = top_per_key(all_, ["scope"], [F.col("direct").desc(), F.col("qn")], 2**31, "rn")
    return context.ripple(ranked.filter("rn <= 20"), ranked.filter("rn > 20"))


@query("blocking_references", sql("SELECT target AS qn, rank, source FROM (SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY file_path, line_start, source) AS rank FROM (SELECT DISTINCT e.target, e.source, n.file_path, n.line_start FROM edges e JOIN nodes n ON n.qn = e.source WHERE e.kind <> 'contains')) WHERE rank <= 20"))
def _(g):
    """What keeps a symbol from being removed, in order of place."""
    at = g.nodes.select(F.col("qn").alias("source"), "file_path", "line_start")
    used = g.edges.filter("kind <> 'contains'").select("source", "target").distinct().join(at, "source")
    return top_per_key(used, ["target"], [F.col("file_path"), F.col("line_start"), F.col("source")], 20, "rank").select(F.col("target").alias("qn"), "rank", "source")


@query("reexports", sql("SELECT qn, origin, min(steps)::INTEGER AS steps FROM w WHERE steps > 0 AND origin <> qn GROUP BY 1, 2",
    "im AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'imports')", "w AS (SELECT DISTINCT source AS qn, source AS origin, 0 AS steps FROM im UNION SELECT w.qn, im.target, w.steps + 1 FROM w JOIN im ON im.source = w.origin WHERE w.steps < 4)", recursive=True))
def _(g):
    """Symbols that names reach through up to four imports of imports."""
    imports = g.edges.filter("kind = 'imports'").select(F.col("source").alias("symbol"), F.col("target").alias("from_symbol"))
    return context.follow_reexports(imports, imports.select(F.col("symbol").alias("qn")))
