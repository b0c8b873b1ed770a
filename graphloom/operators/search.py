"""Full-text, fuzzy and vector search as joins on an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.scan import top_per_key

K1, B, RRF_K = 1.2, 0.75, 60


def postings(docs: DataFrame, key: str, fields: dict[str, float], terms: list[str] | None = None) -> DataFrame:
    """term, key, f (weighted frequency) and len (tokens of all fields), of all terms or some. Counted map-side per document before any shuffle."""
    def weighed(column: str, weight: float) -> Column:
        return F.transform(T.tokens(F.coalesce(column, F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("w")))

    parts = F.concat(*(weighed(c, w) for c, w in fields.items()))
    some = (lambda p: p) if terms is None else lambda p: F.filter(p, lambda x: x["term"].isin(terms))
    rows = docs.select(key, parts.alias("p")).select(key, F.size("p").alias("len"), some(F.col("p")).alias("p")).select(key, "len", F.explode("p").alias("x"))
    return rows.groupBy(F.col("x.term").alias("term"), key, "len").agg(F.sum("x.w").alias("f"))


def text_totals(docs: DataFrame, fields: dict[str, float]) -> DataFrame:
    """Documents and tokens in all, counted without a shuffle of postings."""
    length = sum((F.size(T.tokens(F.coalesce(c, F.lit("")))) for c in fields), F.lit(0))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(length).alias("sum_len"))


def bm25(index: DataFrame, docs: DataFrame, key: str, queries: DataFrame, limit: int, totals: DataFrame | None = None) -> DataFrame:
    """Best documents of each query (query_id, term): score, rank. idf has a floor of 1e-6; ties go to the smaller key.

    index: from postings(); totals: from text_totals(), without which the whole index is read once more for them.
    """
    if totals is None:
        totals = docs.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(index.select(key, "len").distinct().agg(F.sum("len").alias("sum_len")))
    wanted = index.join(queries.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return _scored(wanted.join(queries.distinct(), "term").join(df, "term"), key, totals, limit)


def _scored(hits: DataFrame, key: str, totals: DataFrame, limit: int) -> DataFrame:
    """hits: query_id, key, f, len, df, one row for each term of a query in a document."""
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    norm = K1 * (1 - B + B * F.col("len") / (F.col("sum_len") / F.col("n_docs")))
    scored = hits.crossJoin(F.broadcast(totals)).groupBy("query_id", key).agg(F.round(F.sum(idf * F.col("f") * (K1 + 1) / (F.col("f") + norm)), 6).alias("score"))
    return top_per_key(scored, ["query_id"], [F.col("score").desc(), F.col(key)], limit, "rank")


#: Different terms of all queries that are looked for before documents are taken apart; more are joined with the whole index.
PUSHED_TERMS = 1_000


def ask(docs: DataFrame, key: str, fields: dict[str, float], queries: DataFrame, limit: int) -> DataFrame:
    """bm25() without a stored index: only tokens that some query asks for are counted, so that one scan makes few postings."""
    totals = text_totals(docs, fields)
    terms = [r.term for r in queries.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    return bm25(postings(docs, key, fields, terms if len(terms) <= PUSHED_TERMS else None), docs, key, queries, limit, totals)


def substring_ranked(docs: DataFrame, key: str, content: str, queries: DataFrame, limit: int) -> DataFrame:
    """Best documents of each query (query_id, phrase of at least three characters) that hold the phrase, letter case ignored: score, rank.

    BM25 over trigrams, of which a phrase is one run: its frequency is the number of times it occurs, a document's length
    the number of its trigrams. The stated phrases are sent to the documents, which are scanned once.
    """
    low = docs.filter(F.col(content).isNotNull()).select(key, F.lower(content).alias("low"), F.greatest(F.length(content) - 2, F.lit(0)).alias("len"))
    asked = queries.select("query_id", F.lower("phrase").alias("phrase")).filter(F.length("phrase") >= 3)
    totals = low.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("len").alias("sum_len"))
    times = (F.length("low") - F.length(F.replace("low", F.col("phrase")))) / F.length("phrase")
    hits = low.join(F.broadcast(asked), F.contains("low", "phrase")).select("query_id", key, times.alias("f"), "len")
    df = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("df"))
    return _scored(hits.join(F.broadcast(df), "query_id"), key, totals, limit)


def reciprocal_rank(lists: list[DataFrame], key: str, limit: int, k: int = RRF_K) -> DataFrame:
    """Fused ranking of lists with query_id, key and rank."""
    rows = lists[0].select("query_id", key, "rank")
    for other in lists[1:]:
        rows = rows.unionByName(other.select("query_id", key, "rank"))
    fused = rows.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    return top_per_key(fused, ["query_id"], [F.col("score").desc(), F.col(key)], limit, "fused_rank")


def corrections(vocabulary: DataFrame, words: DataFrame, distance: int = 2) -> DataFrame:
    """Nearest vocabulary term (term, df) of each word: least distance, then most frequent, then least term.

    Candidates come from an equality join on deletion variants, not from comparing every word with every term: two words
    within two edits share a form with at most two letters deleted.
    """

    def without_one(form: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(form), F.lit(1))), lambda i: F.concat(F.substring(form, F.lit(1), i - 1), F.substring(form, i + 1, F.length(form))))

    def variants(column: str) -> Column:
        once = without_one(F.col(column))
        twice = F.flatten(F.transform(once, without_one))
        return F.array_distinct(F.concat(F.array(F.col(column)), once, twice))

    left = words.select("word").distinct().withColumn("form", F.explode(variants("word")))
    right = vocabulary.select("term", "df").withColumn("form", F.explode(variants("term")))
    pairs = left.join(right, "form").select("word", "term", "df").distinct()
    near = pairs.withColumn("distance", F.levenshtein("word", "term")).filter((F.col("distance") <= distance) & (F.abs(F.length("word") - F.length("term")) <= 2))
    return top_per_key(near, ["word"], [F.col("distance"), F.col("df").desc(), F.col("term")], 1)


#: Numbers that the queries of one broadcast hold at most.
BROADCAST_NUMBERS = 4_000_000


def vector_top(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Best vectors of each query by cosine. queries: query_id, q; a stated set of queries against all vectors.

    The queries are sent to the vectors in blocks of a checked size, so that vectors are scanned once for each block and
    never shuffled; every block keeps its best ones before the next.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("q")), F.lit(0)).alias("numbers")).first()
    blocks = max(1, -(-size["numbers"] // BROADCAST_NUMBERS))
    best = None
    for k in range(blocks):
        mine = queries if blocks == 1 else queries.filter(F.pmod(F.hash("query_id"), F.lit(blocks)) == k)
        scored = vectors.crossJoin(F.broadcast(mine)).select("query_id", "vec_id", F.round(T.cosine(F.col("q"), F.col("embedding")), 4).alias("score"))
        top = top_per_key(scored, ["query_id"], [F.col("score").desc(), F.col("vec_id")], limit, "rank")
        best = top if best is None else best.unionByName(top)
    return best


def fuzzy_cap(text: str) -> int:
    """Edits that a name may be away from a text of this length."""
    return 0 if len(text) <= 3 else 1 if len(text) <= 5 else 2 if len(text) <= 8 else 3


def boosts(query: str) -> Column:
    """Score added to a name hit: exact 20, prefix 5, full name 15, kind 3/2/1, public 2, fuzzy 24/18/12/8 with kind bonus where neither exact nor prefix."""
    q = query.strip().lower()
    cap = fuzzy_cap(q)
    name = F.lower("name")
    exact, prefix = name == q, (name != q) & name.startswith(q)
    d = F.levenshtein(name, F.lit(q))
    kind = F.col("kind")
    by_distance = F.when(d == 0, 24.0).when(d == 1, 18.0).when(d == 2, 12.0).otherwise(8.0)
    kind_bonus = F.when(kind.isin("function", "method"), 10.0).when(kind.isin("module", "package"), 5.0).otherwise(8.0)
    fuzzy = F.when((d <= cap) & ~exact & ~prefix & F.lit(cap > 0), by_distance + kind_bonus).otherwise(0.0)
    return (
        F.when(exact, 20.0).otherwise(0.0)
        + F.when(prefix, 5.0).otherwise(0.0)
        + F.when(F.lower("qn") == q, 15.0).otherwise(0.0)
        + fuzzy
        + F.when(kind.isin("function", "method"), 3.0).when(kind.isin("class", "struct", "trait", "interface"), 2.0).when(kind == "enum", 1.0).otherwise(0.0)
        + F.when(F.coalesce(F.lower("modifiers").rlike("pub|export"), F.lit(False)), 2.0).otherwise(0.0)
    )


#: Weights of what two functions have in common, and the least of body, neighbours or signature that a match needs. Fixed values.
SIMILAR = {"name": 0.18, "signature": 0.20, "body": 0.34, "near": 0.18, "module": 0.05, "size": 0.05}
SIMILAR_GATE = {"body": 0.15, "near": 0.15, "signature": 0.30}


def similar_functions(nodes: DataFrame, edges: DataFrame, min_score: float, limit: int) -> DataFrame:
    """Most similar callables of another file with the language, kind and nearly the arity of each one: qn, match_qn, score, rank.

    Compared are the parts of the name, the words of the signature, the body (column body of nodes: an array of shingles;
    without it this counts nothing), the names of neighbours, the module and the number of lines. Pairs come from equality
    joins on neighbours and shingles, and on name parts; of the latter only those go on that reach the score by name,
    signature, module and size. Pairs without any of these in common reach 0.3 at most, so min_score must be greater, and
    no pair is lost.
    """
    if min_score <= SIMILAR["signature"] + SIMILAR["module"] + SIMILAR["size"]:
        raise ValueError("min_score must be above 0.3: below, pairs that share nothing to join on would count")
    near = edges.select(F.col("source").alias("qn"), F.element_at(F.split("target", "::"), -1).alias("n")).unionByName(edges.select(F.col("target").alias("qn"), F.element_at(F.split("source", "::"), -1).alias("n")))
    neighbours = near.groupBy("qn").agg(F.array_sort(F.collect_set("n")).alias("near"))
    none = F.array().cast("array<string>")
    body = F.coalesce(F.col("body").cast("array<string>"), none) if "body" in nodes.columns else none
    prints = (
        nodes.filter(F.col("kind").isin("function", "method"))
        .join(neighbours, "qn", "left")
        .select(
            "qn",
            "file_path",
            "line_start",
            "language",
            "kind",
            F.array_distinct(T.split_camel(F.col("name"))).alias("name"),
            F.array_distinct(F.filter(F.split(F.coalesce("params", F.lit("")), "[^a-z]+"), lambda t: t != "")).alias("signature"),
            T.arity(F.col("params")).alias("arity"),
            body.alias("body"),
            F.coalesce("near", none).alias("near"),
            F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("module"),
            (F.col("line_end") - F.col("line_start") + 1).alias("loc"),
        )
    )
    sides = lambda rows, *more: (rows.select("language", "kind", "shared", *(F.col(c).alias(f"{side}_{c}") for c in ("qn", "arity", "file_path", *more))) for side in "ab")
    other = (F.col("a_file_path") != F.col("b_file_path")) & (F.abs(F.col("a_arity") - F.col("b_arity")) <= 1) & (F.col("a_qn") < F.col("b_qn"))

    def parts(*columns: str) -> dict[str, Column]:
        own = {c: T.jaccard(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in columns}
        own["module"] = F.when(F.col("a_module") == F.col("b_module"), 1.0).otherwise(0.0)
        return own | {"size": T.overlap_ratio(F.col("a_loc"), F.col("b_loc"))}

    total = lambda of: sum((of[c] * w for c, w in SIMILAR.items() if c in of), F.lit(0.0))
    # pairs that share a neighbour or a shingle; all others have to reach the score by the rest, which is told while they are joined on name parts
    mark = lambda column, tag: F.transform(column, lambda x: F.concat(F.lit(tag), x))
    a, b = sides(prints.select("*", F.explode(F.array_distinct(F.concat(mark(F.col("near"), "n"), mark(F.col("body"), "b")))).alias("shared")))
    near_pairs = a.join(b, ["language", "kind", "shared"]).filter(other).select("a_qn", "b_qn")
    # without a common word of the signature such a pair reaches 0.28 at most
    a, b = sides(prints.filter(F.size("signature") > 0).select("*", F.explode("name").alias("shared")), "name", "signature", "module", "loc")
    named = a.join(b, ["language", "kind", "shared"]).filter(other).filter(total(parts("name", "signature")) >= min_score - 1e-6).select("a_qn", "b_qn")
    pairs = near_pairs.unionByName(named).distinct()
    wanted = ["file_path", "line_start", "name", "signature", "body", "near", "module", "loc"]
    for side in "ab":
        pairs = pairs.join(prints.select(F.col("qn").alias(f"{side}_qn"), *(F.col(c).alias(f"{side}_{c}") for c in wanted)), f"{side}_qn")
    compared = parts("name", "signature", "body", "near")
    score = total(compared)
    passes = F.lit(False)
    for c, least in SIMILAR_GATE.items():
        passes = passes | (compared[c] >= least)
    scored = pairs.withColumn("score", F.round(score, 6)).filter((F.col("score") >= min_score) & passes)
    one = lambda x, y: F.struct(F.col(f"{x}_qn").alias("qn"), F.col(f"{y}_qn").alias("match_qn"), F.col(f"{y}_file_path").alias("file_path"), F.col(f"{y}_line_start").alias("line_start"), "score")
    both = scored.select(F.explode(F.array(one("a", "b"), one("b", "a"))).alias("m")).select("m.*")
    return top_per_key(both, ["qn"], [F.col("score").desc(), F.col("file_path"), F.col("line_start"), F.col("match_qn")], limit, "rank").select("qn", "match_qn", "score", "rank")


def paragraphs(docs: DataFrame, key: str, content: str) -> DataFrame:
    """Paragraphs of a text (parts between blank lines): key, part, text."""
    parts = F.filter(F.split(F.regexp_replace(content, "\r\n", "\n"), "\n[ \t]*\n"), lambda p: p.rlike("[^ \\t\\r\\n]"))
    return docs.select(key, F.posexplode(parts).alias("part", "text"))


def headings(docs: DataFrame, key: str, content: str) -> DataFrame:
    """Markdown sections: key, line, level, title and the line before the next heading (0 if it's the last). Code fences are left out."""
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(content, "\r\n", "\n"), "\n")).alias("line", "raw"))
    w = Window.partitionBy(key).orderBy("line")
    fenced = F.sum(F.when(F.col("raw").startswith("```"), 1).otherwise(0)).over(w) % 2 == 1
    marks = lines.withColumn("fenced", fenced).filter(~F.col("fenced") & F.col("raw").rlike("^#{1,6} "))
    return marks.select(
        key, (F.col("line") + 1).alias("line"), F.length(F.regexp_extract("raw", "^(#+)", 1)).alias("level"), F.btrim(F.regexp_replace("raw", "^#+ ", "")).alias("title"), F.coalesce(F.lead("line").over(w), F.lit(0)).alias("until")
    )


def grep(docs: DataFrame, key: str, content: str, pattern: str, context: int) -> DataFrame:
    """Lines that match a pattern and the lines around them: key, line, hit."""
    lines = docs.select(key, F.posexplode(F.split(content, "\n")).alias("line", "raw")).withColumn("hit", F.col("raw").rlike(pattern))
    near = F.max("hit").over(Window.partitionBy(key).orderBy("line").rowsBetween(-context, context))
    return lines.withColumn("near", near).filter("near").select(key, F.col("line").alias("line"), "hit")


def with_fallback(docs: DataFrame, key: str, fields: dict[str, float], phrase: str, limit: int, few: int = 3) -> DataFrame:
    """Full text first; with few hits also substrings, fused by rank; with none at all once more with corrected words.

    Phrases of several words are then put in order of how near their words stand (in the last field, with the first as title).
    The choice needs the number of hits, of which at most `few` are counted.
    """
    spark = docs.sparkSession
    title, content = next(iter(fields)), list(fields)[-1]

    def find(words: list[str]) -> DataFrame:
        text = " ".join(words)
        first = ask(docs, key, fields, spark.createDataFrame([(1, w) for w in words], "query_id long, term string"), limit)
        lists = [first]
        if len(first.take(few)) < few:
            lists.append(substring_ranked(docs.select(key, F.concat_ws(" ", *fields).alias("all_text")), key, "all_text", spark.createDataFrame([(1, text)], "query_id long, phrase string"), limit))
        fused = reciprocal_rank(lists, key, limit).select(key, "score", "fused_rank")
        if len(words) < 2:
            return fused.select(key, "score", F.col("fused_rank").alias("rank"))
        near = fused.join(proximity(docs.join(fused.select(key), key, "left_semi"), key, content, title, words), key)
        return near.select(key, "score", F.row_number().over(Window.orderBy(F.col("near").desc(), "fused_rank")).cast("long").alias("rank"))

    words = [w for w in phrase.lower().split() if w]
    found = find(words)
    if found.take(1):
        return found
    vocabulary = postings(docs, key, fields).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    better = {r.word: r.term for r in corrections(vocabulary, spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    return find([better.get(w, w) for w in words])


def proximity(docs: DataFrame, key: str, content: str, title: str, terms: list[str], window: int = 50) -> DataFrame:
    """key and near: pairs of words that hold two different terms at most `window` words apart, and 5 for each term in the title; letter case ignored. key is taken to be unique.

    Only words that hold a term leave the scan.
    """
    low = F.array(*(F.lit(t.lower()) for t in terms))
    words = docs.select(key, F.posexplode(F.filter(F.split(F.lower(content), r"(?U)\s+"), lambda w: w != "")).alias("pos", "word"))
    held = F.filter(F.sequence(F.lit(1), F.lit(len(terms))), lambda k: F.contains("word", F.get(low, k - 1)))
    hits = words.withColumn("held", held).filter(F.size("held") > 0).select(key, "pos", F.explode("held").alias("term"))
    placed = hits.groupBy(key).agg(F.collect_list(F.struct("pos", "term")).alias("at"))
    beside = F.aggregate("at", F.lit(0), lambda n, x: n + F.size(F.filter("at", lambda y: (y["term"] > x["term"]) & (F.abs(y["pos"] - x["pos"]) <= window))))
    named = sum((F.when(F.lower(title).contains(t.lower()), 5).otherwise(0) for t in terms), F.lit(0))
    return docs.select(key, named.alias("named")).join(placed.select(key, beside.alias("beside")), key, "left").select(key, (F.col("named") + F.coalesce("beside", F.lit(0))).alias("near"))


def hybrid(lexical: DataFrame, vector: DataFrame, key: str, limit: int) -> DataFrame:
    """Lexical and vector ranks (query_id, key, rank) fused."""
    return reciprocal_rank([lexical, vector], key, limit)


def expanded(nodes: DataFrame, edges: DataFrame, phrase: str, limit: int, terms: int = 8) -> DataFrame:
    """Symbol search with a second round by names of the hits' neighbours: qn, score (greater of both rounds).

    At most `terms` words come to the driver between the rounds.
    """
    spark = nodes.sparkSession
    docs = nodes.select("qn", F.array_join(T.split_camel(F.col("name")), " ").alias("content"))

    def find(words: list[str], n: int) -> DataFrame:
        return ask(docs, "qn", {"content": 1.0}, spark.createDataFrame([(1, w) for w in words], "query_id long, term string"), n).select("qn", "score")

    first = find([w for w in phrase.lower().split() if w], limit)
    near = edges.join(first.withColumnRenamed("qn", "source"), "source", "left_semi").select(F.explode(T.split_camel(F.element_at(F.split("target", "::"), -1))).alias("w"))
    extra = [r.w for r in near.distinct().orderBy("w").limit(terms).collect()]
    if not extra:
        return first
    second = find(extra, max(2 * limit, 40)).withColumn("score", F.col("score") * 0.5)
    return first.unionByName(second).groupBy("qn").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "qn").limit(limit)


def embed(texts: DataFrame, key: str, text: str, provider) -> DataFrame:
    """key and embedding of each text by provider(list of texts) -> list of vectors, called once for every batch. Null texts give null."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            known = pdf[text].notna()
            vectors = iter(provider(pdf.loc[known, text].tolist()))
            yield pd.DataFrame({key: pdf[key], "embedding": [next(vectors) if k else None for k in known]})

    return texts.select(key, text).mapInPandas(run, f"{key} long, embedding array<float>")


def query_terms(text: str) -> list[str]:
    """Distinct search terms of a text in order: its words, the parts of camelCase and snake_case ones, and the words as they are."""
    import re

    out: dict[str, None] = {}
    for word in re.findall(r"[A-Za-z0-9_]+", text):
        parts = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", word)).lower().split("_")
        for term in (word.lower().strip("_"), *parts):
            if term and "_" not in term:
                out[term] = None
    return list(out)


def relaxed_prefixes(text: str) -> list[str]:
    """Prefixes for a fuzzy second try: none for words under four letters, three letters from six on, two in between."""
    return [t[: 3 if len(t) >= 6 else 2] for t in query_terms(text) if len(t) >= 4]


def execute(nodes: DataFrame, edges: DataFrame, text: str, regex: str | None = None, semantic: bool = False, limit: int = 20, fuzzy: bool = False) -> DataFrame:
    """Symbol search in the mode that the question asks for: qn, score.

    Exact names (100 for the full one, 80 for the short one), full-text hits and, if fuzzy, names within the edit distance
    that the text's length allows, whose words begin as the text's do, are put together, and boosts added to them.
    """
    from graphloom.operators.context import query_mode
    from graphloom.operators.scan import regex_match

    mode = query_mode(text, regex, semantic)
    pool = nodes.filter(regex_match(regex, "name", "qn")) if regex else nodes
    if mode == "structural_scan":
        return pool.select("qn", F.lit(1.0).alias("score")).orderBy("qn").limit(limit)
    if mode == "empty":
        return nodes.select("qn", F.lit(0.0).alias("score")).limit(0)
    if mode == "semantic":
        return expanded(pool, edges, " ".join(query_terms(text)), limit)
    docs = pool.select("qn", F.array_join(T.split_camel(F.col("name")), " ").alias("content"))
    asked = nodes.sparkSession.createDataFrame([(1, t) for t in query_terms(text)], "query_id long, term string")
    q = text.strip().lower()
    hits = ask(docs, "qn", {"content": 1.0}, asked, limit * 3).select("qn", "score")
    hits = hits.unionByName(pool.filter(F.lower("qn") == q).select("qn", F.lit(100.0).alias("score"))).unionByName(pool.filter(F.lower("name") == q).select("qn", F.lit(80.0).alias("score")))
    cap, starts = fuzzy_cap(q), relaxed_prefixes(text)
    if fuzzy and cap and starts:
        begins = F.exists(T.split_camel(F.col("name")), lambda w: F.array_contains(F.array(*map(F.lit, starts)), F.substring(w, 1, 3)) | F.array_contains(F.array(*map(F.lit, starts)), F.substring(w, 1, 2)))
        hits = hits.unionByName(pool.filter(begins & (F.levenshtein(F.lower("name"), F.lit(q)) <= cap)).select("qn", F.lit(0.0).alias("score")))
    hits = hits.groupBy("qn").agg(F.max("score").alias("score"))
    return hits.join(pool, "qn").select("qn", (F.col("score") + boosts(text)).alias("score")).orderBy(F.col("score").desc(), "qn").limit(limit)


def context_boosted(nodes: DataFrame, edges: DataFrame, text: str, files: DataFrame, symbols: DataFrame, limit: int = 20, boost: float = 5.0) -> DataFrame:
    """Search within what is being worked on: qn, score. Known symbols (qn) join the hits with a score of 1, symbols in the context's files (path)
    gain a boost, and neighbours of the best `limit` hits follow with half of the score of the best one that they are next to."""
    asked = nodes.sparkSession.createDataFrame([(1, t) for t in query_terms(text)], "query_id long, term string")
    docs = nodes.select("qn", F.array_join(T.split_camel(F.col("name")), " ").alias("content"))
    hits = ask(docs, "qn", {"content": 1.0}, asked, limit).select("qn", "score")
    known = symbols.select("qn").distinct().join(hits, "qn", "left_anti").join(nodes.select("qn"), "qn", "left_semi").withColumn("score", F.lit(1.0))
    seeds = hits.unionByName(known).join(nodes.select("qn", "name", "kind", "modifiers", "file_path"), "qn").join(files.select(F.col("path").alias("file_path")).distinct().withColumn("near", F.lit(True)), "file_path", "left")
    best = seeds.select("qn", (F.col("score") + boosts(text) + F.when(F.col("near"), boost).otherwise(0.0)).alias("score")).orderBy(F.col("score").desc(), "qn").limit(limit)
    steps = edges.select("source", "target").union(edges.select("target", "source")).toDF("qn", "other").distinct()
    around = best.join(steps, "qn").groupBy(F.col("other").alias("qn")).agg((F.max("score") / 2).alias("score"))
    return best.unionByName(around).groupBy("qn").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "qn").limit(limit)
