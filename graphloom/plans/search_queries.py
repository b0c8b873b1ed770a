"""Queries on text, search and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import scan, search
from graphloom.plans.adapter import Graph, sql

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return register


ASKED = [(1, "stale cache"), (1, "rebuild"), (2, "ledger impact radius"), (3, "knoten prüfung index"), (4, "snapshots drift apart")]
TERMS = sorted({(q, t) for q, phrase in ASKED for t in __import__("re").split("[^a-z0-9]+", phrase.lower()) if t})


def asked(g):
    return g.spark.createDataFrame(TERMS, "query_id long, term string")


_ASK = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({q}::BIGINT, '{t}')" for q, t in TERMS) + ") v(query_id, term))"


def _toks(column: str) -> str:
    return f"list_filter(string_split_regex(lower({column}), '[^a-z0-9]+'), lambda t: t <> '')"


def _bm25(name: str, weighted: list[tuple[str, float]], key: str = "id", limit: int = 10) -> str:
    parts = " UNION ALL ".join(f"SELECT {key}, unnest({_toks(f'coalesce({c}, {chr(39) * 2})')}) AS term, {w}::DOUBLE AS w FROM chunks" for c, w in weighted)
    return f"""{name}t AS ({parts}), {name}l AS (SELECT {key}, count(*) AS len FROM {name}t GROUP BY 1), {name}f AS (SELECT term, {key}, sum(w) AS f FROM {name}t GROUP BY 1, 2),
{name}n AS (SELECT (SELECT count(*) FROM chunks) AS n_docs, (SELECT sum(len) FROM {name}l) AS sum_len), {name}d AS (SELECT term, count(*) AS df FROM {name}f GROUP BY 1),
{name}s AS (SELECT query_id, {key}, round(sum(greatest(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (sum_len / n_docs)))), 6) AS score
  FROM q JOIN {name}f USING (term) JOIN {name}d USING (term) JOIN {name}l USING ({key}), {name}n GROUP BY 1, 2),
{name} AS (SELECT query_id, {key}, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM {name}s QUALIFY rank <= {limit})"""


@query("bm25_top", sql("SELECT * FROM b", _ASK, _bm25("b", [("content", 1)])))
def _(g):
    return search.ask(g.chunks, "id", {"content": 1}, asked(g), 10)


@query("bm25_weighted", sql("SELECT * FROM b", _ASK, _bm25("b", [("title", 10), ("content", 1)])))
def _(g):
    return search.ask(g.chunks, "id", {"title": 10, "content": 1}, asked(g), 10)


@query("substring_search", sql("SELECT id FROM chunks WHERE contains(lower(content), 'ledger impact') OR contains(lower(content), 'stale cache')"))
def _(g):
    low = F.lower("content")
    return g.chunks.filter(low.contains("ledger impact") | low.contains("stale cache")).select("id")


@query("rrf", sql("SELECT query_id, id, score, fused_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS fused_rank FROM (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM x UNION ALL SELECT query_id, id, rank FROM b) GROUP BY 1, 2)) WHERE fused_rank <= 10",
    _ASK, _bm25("x", [("title", 1)]), _bm25("b", [("content", 1)])))
def _(g):
    one = search.ask(g.chunks, "id", {"title": 1}, asked(g), 10)
    two = search.ask(g.chunks, "id", {"content": 1}, asked(g), 10)
    return search.reciprocal_rank([one, two], "id", 10)


_COS = "round(CASE WHEN list_dot_product(a, a) = 0 OR list_dot_product(b, b) = 0 THEN 0 ELSE list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) END, 4)"
_VEC = f"v AS (SELECT query_id, vec_id, {_COS} AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, q.embedding::DOUBLE[] AS a, e.embedding::DOUBLE[] AS b FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0))"


def vector_queries(g):
    return g.t("embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("vector_topk", f"WITH {_VEC} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM v QUALIFY rank <= 10")
def _(g):
    return search.vector_top(g.t("embeddings"), vector_queries(g), 10)


@query("vector_dimensions", "SELECT label, count(*) AS n, min(len(embedding)) AS least, max(len(embedding)) AS greatest FROM embeddings GROUP BY 1")
def _(g):
    return g.t("embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).cast("long").alias("least"), F.max(F.size("embedding")).cast("long").alias("greatest"))


@query("missing_embeddings", "SELECT vec_id FROM embeddings WHERE embedding IS NULL OR len(embedding) = 0")
def _(g):
    return g.t("embeddings").filter(F.col("embedding").isNull() | (F.size("embedding") == 0)).select("vec_id")


@query("vocab_df", sql(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(list_filter({_toks('content')}, lambda t: length(t) >= 3))) AS term FROM chunks) GROUP BY 1"))
def _(g):
    words = F.array_distinct(F.filter(T.tokens(F.col("content")), lambda t: F.length(t) >= 3))
    return g.chunks.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


_VOC = f"voc AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(list_filter({_toks('content')}, lambda t: length(t) >= 4 AND NOT regexp_matches(t, '[0-9]')))) AS term FROM chunks) GROUP BY 1 HAVING count(*) >= 5)"
MISSPELT = ["snapshit", "ledgr", "watermrak", "boundry", "clustre", "prüfng"]


@query("correction", sql("SELECT word, term, df, distance FROM (SELECT word, term, df, levenshtein(word, term)::INTEGER AS distance FROM (VALUES " + ", ".join(f"('{w}')" for w in MISSPELT) + ") w(word), voc WHERE abs(length(word) - length(term)) <= 2) WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, df DESC, term) = 1", _VOC))
def _(g):
    words = F.array_distinct(F.filter(T.tokens(F.col("content")), lambda t: (F.length(t) >= 4) & ~t.rlike("[0-9]")))
    voc = g.chunks.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df >= 5")
    return search.corrections(voc, g.spark.createDataFrame([(w,) for w in MISSPELT], "word string"))


@query("token_counts", sql(f"SELECT id, len({_toks('content')})::BIGINT AS tokens, ceil(strlen(content) / 4.0::DOUBLE)::BIGINT AS approx_tokens FROM chunks"))
def _(g):
    return g.chunks.select("id", F.size(T.tokens(F.col("content"))).cast("long").alias("tokens"), T.approx_tokens(F.col("content")).alias("approx_tokens"))


@query("name_parts", sql("SELECT qn, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda t: t <> ''), ' ') AS parts FROM nodes"))
def _(g):
    return g.nodes.select("qn", F.array_join(T.split_camel(F.col("name")), " ").alias("parts"))


@query("shingle_counts", sql(f"SELECT id, CASE WHEN len(t) = 0 THEN 0 WHEN len(t) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, (len(t) - 3)::BIGINT), lambda i: array_to_string(t[i:i + 4], ' ')))) END::BIGINT AS shingles FROM (SELECT id, {_toks('content')} AS t FROM chunks)"))
def _(g):
    return g.chunks.select("id", T.tokens(F.col("content")).alias("t")).select("id", F.size(T.shingles(F.col("t"), 5)).cast("long").alias("shingles"))


# White space, and what words are made of, in Unicode; the other engine's classes are ASCII.
_SPACE = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_IN_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}"


@query("chunk_ids", sql(f"SELECT id, sha256(encode(source) || '\\x00'::BLOB || encode(regexp_replace(content, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'))) AS chunk_id FROM chunks WHERE source IS NOT NULL AND content IS NOT NULL"))
def _(g):
    return g.chunks.filter("source is not null and content is not null").select("id", T.chunk_id(F.col("source"), F.col("content")).alias("chunk_id"))


@query("paragraph_chunks", sql("SELECT id, count(*) AS parts, max(length(p)) AS longest FROM (SELECT id, unnest(list_filter(string_split_regex(replace(content, chr(13) || chr(10), chr(10)), '\\n[ \\t]*\\n'), lambda p: regexp_matches(p, '[^ \\t\\r\\n]'))) AS p FROM chunks WHERE content_type = 'markdown') GROUP BY 1"))
def _(g):
    p = search.paragraphs(g.chunks.filter("content_type = 'markdown'"), "id", "content")
    return p.groupBy("id").agg(F.count(F.lit(1)).alias("parts"), F.max(F.length("text")).cast("long").alias("longest"))


@query("doc_sections", sql("""SELECT id, line, level, title FROM (SELECT id, line, length(regexp_extract(raw, '^(#+)', 1))::INTEGER AS level, trim(regexp_replace(raw, '^#+ ', '')) AS title, raw, fenced FROM (
  SELECT id, raw, line::INTEGER AS line, sum(CASE WHEN starts_with(raw, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line) % 2 AS fenced FROM (SELECT id, unnest(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))) AS raw, generate_subscripts(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), 1) AS line FROM chunks WHERE content_type = 'markdown')))
  WHERE fenced = 0 AND regexp_matches(raw, '^#{1,6} ')"""))
def _(g):
    return search.headings(g.chunks.filter("content_type = 'markdown'"), "id", "content").select("id", "line", "level", "title")


@query("grep_context", sql("""SELECT id, line, hit FROM (SELECT id, line, hit, max(hit::INTEGER) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM (SELECT id, line::INTEGER - 1 AS line, regexp_matches(raw, 'stale_[a-z_]+') AS hit FROM (
  SELECT id, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM chunks))) WHERE near = 1"""))
def _(g):
    return search.grep(g.chunks, "id", "content", "stale_[a-z_]+", 1)


@query("exact_dups", sql("SELECT md5(content) AS body, count(*) AS copies, min(id) AS first_id FROM chunks GROUP BY 1 HAVING count(*) > 1"))
def _(g):
    return g.chunks.groupBy(F.md5("content").alias("body")).agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")).filter("copies > 1")


_SIM = f"""np AS (SELECT qn, file_path, line_start, language, kind, line_end - line_start + 1 AS loc, coalesce(near, []) AS near, list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda t: t <> '')) AS parts,
  list_distinct(list_filter(string_split_regex(coalesce(params, ''), '[^a-z]+'), lambda t: t <> '')) AS sig, CASE coalesce(params, '()') WHEN '()' THEN 0 WHEN '(a)' THEN 1 ELSE 2 END AS arity FROM nodes LEFT JOIN (SELECT qn, list_distinct(list(n)) AS near FROM (SELECT source AS qn, split_part(target, '::', -1) AS n FROM edges UNION ALL SELECT target, split_part(source, '::', -1) FROM edges) GROUP BY 1) USING (qn) WHERE kind IN ('function', 'method')),
sp AS (SELECT *, round(jn * 0.18::DOUBLE + js * 0.2::DOUBLE + 0.0::DOUBLE + jr * 0.18::DOUBLE + jm * 0.05::DOUBLE + jl * 0.05::DOUBLE, 6) AS score FROM (SELECT a.qn, b.qn AS match_qn, b.file_path, b.line_start, {{a}} FROM np a JOIN np b ON a.language = b.language AND a.kind = b.kind AND a.file_path <> b.file_path AND abs(a.arity - b.arity) <= 1))"""
_J = "CASE WHEN len(a.{c}) = 0 OR len(b.{c}) = 0 THEN 0 ELSE len(list_intersect(a.{c}, b.{c})) / len(list_distinct(list_concat(a.{c}, b.{c})))::DOUBLE END::DOUBLE"
_PARTS = f"{_J.format(c='parts')} AS jn, {_J.format(c='sig')} AS js, {_J.format(c='near')} AS jr, CASE WHEN regexp_extract(a.file_path, '^(.*)/[^/]*$', 1) = regexp_extract(b.file_path, '^(.*)/[^/]*$', 1) THEN 1.0 ELSE 0 END::DOUBLE AS jm, least(a.loc, b.loc) / greatest(a.loc, b.loc)::DOUBLE AS jl"


@query("similar_functions", sql("SELECT qn, match_qn, score, row_number() OVER (PARTITION BY qn ORDER BY score DESC, file_path, line_start, match_qn) AS rank FROM sp WHERE score >= 0.35 AND (jr >= 0.15 OR js >= 0.3) QUALIFY rank <= 3", _SIM.replace("{a}", _PARTS)))
def _(g):
    return search.similar_functions(g.nodes, g.edges, 0.35, 3)


@query("search_boosts", sql("""SELECT qn, score FROM (SELECT qn, (CASE WHEN n = 'load_node' THEN 20 ELSE 0 END + CASE WHEN n <> 'load_node' AND starts_with(n, 'load_node') THEN 5 ELSE 0 END + CASE WHEN levenshtein(n, 'load_node') <= 3 AND NOT starts_with(n, 'load_node') THEN CASE levenshtein(n, 'load_node') WHEN 0 THEN 24 WHEN 1 THEN 18 WHEN 2 THEN 12 ELSE 8 END + CASE WHEN kind IN ('function', 'method') THEN 10 ELSE 8 END ELSE 0 END
  + CASE WHEN kind IN ('function', 'method') THEN 3 WHEN kind IN ('class', 'struct', 'trait') THEN 2 WHEN kind = 'enum' THEN 1 ELSE 0 END + CASE WHEN regexp_matches(coalesce(modifiers, ''), 'pub|export') THEN 2 ELSE 0 END)::DOUBLE AS score FROM (SELECT *, lower(name) AS n FROM nodes)) WHERE score > 5"""))
def _(g):
    return g.nodes.withColumn("score", search.boosts("load_node")).filter("score > 5").select("qn", "score")


@query("exact_symbol_hits", sql("SELECT qn, max(score)::DOUBLE AS score FROM (SELECT n.qn, 100 AS score FROM nodes n WHERE split_part(n.qn, '#', 2) IN (SELECT qualified_name FROM batch_results) UNION ALL SELECT n.qn, 80 FROM nodes n WHERE n.name IN (SELECT name FROM batch_results)) GROUP BY 1"))
def _(g):
    asked_ = g.t("batch_results")
    full = g.nodes.withColumn("local", F.split_part("qn", F.lit("#"), F.lit(2))).join(asked_.select(F.col("qualified_name").alias("local")).distinct(), "local", "left_semi").select("qn", F.lit(100.0).alias("score"))
    short = g.nodes.join(asked_.select("name").distinct(), "name", "left_semi").select("qn", F.lit(80.0).alias("score"))
    return full.unionByName(short).groupBy("qn").agg(F.max("score").alias("score"))


@query("merge_ranked", "SELECT query_id, qualified_name, max(score) AS score, count(*) AS seen FROM batch_results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2")
def _(g):
    return g.t("batch_results").filter("score is not null and not isnan(score)").groupBy("query_id", "qualified_name").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("seen"))


@query("retrieval_eval", """WITH r AS (SELECT query_id, qualified_name, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, result_id) AS rank FROM batch_results WHERE score IS NOT NULL AND NOT isnan(score)),
e AS (SELECT DISTINCT query_id, qualified_name FROM batch_results WHERE language = 'rust'), h AS (SELECT e.query_id, e.qualified_name, min(rank) AS rank FROM e LEFT JOIN r USING (query_id, qualified_name) GROUP BY 1, 2)
SELECT query_id, round(count(*) FILTER (rank <= 5) / count(*)::DOUBLE, 6) AS recall_at_5, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS reciprocal_rank FROM h GROUP BY 1""")
def _(g):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "result_id")
    ranked = g.t("batch_results").filter("score is not null and not isnan(score)").select("query_id", "qualified_name", F.row_number().over(w).alias("rank"))
    wanted = g.t("batch_results").filter("language = 'rust'").select("query_id", "qualified_name").distinct()
    hits = wanted.join(ranked, ["query_id", "qualified_name"], "left").groupBy("query_id", "qualified_name").agg(F.min("rank").alias("rank"))
    return hits.groupBy("query_id").agg(F.round(F.count_if(F.col("rank") <= 5) / F.count(F.lit(1)), 6).alias("recall_at_5"), F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def _redacted(text: str) -> str:
    """SQL of the three patterns. Marks at both ends of a word are taken along, so that one applied twice meets neighbours that share theirs."""
    text = f"regexp_replace({text}, '(?i)(^|[^{_IN_WORD}])(password|passwd|secret|token|api[_-]?key)([{_SPACE}]*[=:][{_SPACE}]*)[^{_SPACE},;]+', '\\1\\2\\3[redacted]', 'g')"
    for word in ("[0-9a-fA-F]{32,}", "(?:ghp|gho|sk|pk|AKIA)[_-]?[A-Za-z0-9]{16,}"):
        for _ in range(2):
            text = f"regexp_replace({text}, '(^|[^{_IN_WORD}]){word}($|[^{_IN_WORD}])', '\\1[redacted]\\2', 'g')"
    return text


@query("redaction", sql(f"SELECT id, {_redacted('content')} AS content FROM chunks WHERE content IS NOT NULL"))
def _(g):
    return g.chunks.filter("content is not null").select("id", T.redact(F.col("content")).alias("content"))


@query("node_texts", sql("SELECT qn, kind || ' ' || name || coalesce(params, '') || CASE WHEN return_type IS NULL THEN '' ELSE ' -> ' || return_type END || '  [' || qn || ']' AS text FROM nodes"))
def _(g):
    return g.nodes.select("qn", T.chunk_text(F.col("kind"), F.col("name"), F.col("params"), F.col("return_type"), F.col("qn")).alias("text"))


@query("signature_hashes", sql("SELECT qn, coalesce(CASE WHEN params IS NULL AND return_type IS NULL AND modifiers IS NULL THEN NULL ELSE sha256(coalesce(params, '') || chr(31) || coalesce(return_type, '') || chr(31) || coalesce(modifiers, '')) END, '') AS hash FROM nodes"))
def _(g):
    return g.nodes.select("qn", F.coalesce(T.signature_hash(F.col("params"), F.col("return_type"), F.col("modifiers")), F.lit("")).alias("hash"))


@query("edge_hashes", sql("SELECT source, target, kind, sha256(kind || '|' || printf('%.6f', confidence) || '|' || tier) AS hash FROM edges"))
def _(g):
    return g.edges.select("source", "target", "kind", T.edge_hash(F.col("kind"), F.col("confidence"), F.col("tier")).alias("hash"))


@query("module_keys", sql("SELECT path, CASE WHEN regexp_matches(p, '^(packages|src|tests)/[^/]+/') THEN regexp_extract(p, '^((?:packages|src|tests)/[^/]+)/', 1) ELSE regexp_extract(p, '^([^/]+)', 1) END AS module FROM (SELECT path, split_part(path, '#', 2) AS p FROM files)"))
def _(g):
    return g.files.select("path", T.module_key(F.split_part("path", F.lit("#"), F.lit(2))).alias("module"))


@query("file_kinds", "SELECT work_id, CASE lower(regexp_extract(rel_path, '\\.([^./]+)$', 1)) WHEN 'json' THEN 'config' WHEN 'toml' THEN 'config' WHEN '' THEN 'none' ELSE 'code' END AS kind FROM parse_work")
def _(g):
    return g.t("parse_work").select("work_id", T.content_type(F.col("rel_path")).alias("kind"))


@query("intents", "SELECT item_id, CASE WHEN regexp_matches(t, 'affect|impact|break') THEN 'impact' WHEN regexp_matches(t, 'rename') THEN 'rename' WHEN regexp_matches(t, 'unused|dead code') THEN 'dead_code' WHEN regexp_matches(t, 'review|check') THEN 'review' WHEN regexp_matches(t, 'who calls|callers of|used by') THEN 'usage' WHEN regexp_matches(t, 'explain|how does|see how|why') THEN 'explain' ELSE 'search' END AS intent, coalesce(nullif(regexp_extract(text, '`([^`]+)`', 1), ''), nullif(regexp_extract(text, '([A-Za-z_]+::[A-Za-z_:]+)', 1), ''), nullif(regexp_extract(text, '\\b([a-z]+(?:_[a-z0-9]+)+)\\b', 1), ''), '') AS target FROM (SELECT *, lower(text) AS t FROM eval_items)")
def _(g):
    return g.t("eval_items").select("item_id", T.intent(F.col("text")).alias("intent"), T.target_of(F.col("text")).alias("target"))


@query("arities", sql("SELECT qn, CASE coalesce(params, '()') WHEN '()' THEN 0 WHEN '(a)' THEN 1 ELSE 2 END AS arity, length(name) AS n, CASE WHEN length(name) <= 3 THEN 0 WHEN length(name) <= 5 THEN 1 WHEN length(name) <= 8 THEN 2 ELSE 3 END AS fuzzy FROM nodes"))
def _(g):
    return g.nodes.select("qn", T.arity(F.col("params")).alias("arity"), F.length("name").cast("long").alias("n"), T.fuzzy_threshold(F.length("name")).alias("fuzzy"))


@query("occurrences", sql("SELECT name, count(*) AS docs FROM (SELECT DISTINCT n.name, c.id FROM (SELECT DISTINCT name FROM nodes WHERE contains(name, '_')) n JOIN (SELECT id, unnest(list_distinct(regexp_extract_all(content, '[A-Za-z0-9_]+'))) AS w FROM chunks) c ON c.w = n.name) GROUP BY 1"))
def _(g):
    words = g.chunks.select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("([A-Za-z0-9_]+)")))).alias("name"))
    names = g.nodes.filter(F.col("name").contains("_")).select("name").distinct()
    return words.join(names, "name").groupBy("name").agg(F.count_distinct("id").alias("docs"))


@query("title_proximity", sql(f"SELECT id, count(*) AS pairs FROM (SELECT id, p1, min(p2) AS p2 FROM (SELECT a.id, a.p AS p1, b.p AS p2 FROM pos a JOIN pos b ON a.id = b.id AND a.t = 'cache' AND b.t = 'stale' AND abs(a.p - b.p) <= 50) GROUP BY 1, 2) GROUP BY 1", f"pos AS (SELECT id, unnest(t) AS t, generate_subscripts(t, 1) AS p FROM (SELECT id, {_toks('content')} AS t FROM chunks))"))
def _(g):
    placed = g.chunks.select("id", F.posexplode(T.tokens(F.col("content"))).alias("p", "t")).filter(F.col("t").isin("cache", "stale"))
    a, b = placed.filter("t = 'cache'").select("id", F.col("p").alias("p1")), placed.filter("t = 'stale'").select("id", F.col("p").alias("p2"))
    return a.join(b, "id").filter("abs(p1 - p2) <= 50").select("id", "p1").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("pairs"))
