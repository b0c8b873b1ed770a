"""Context of a symbol or change: selection, ranking, trimming to budgets, and plans of edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.scan import top_per_key

#: Priority of the reason for which a node is in a context. Fixed values.
PRIORITY = {"target": 100, "caller": 80, "callee": 80, "importer": 60, "imported": 60, "sibling": 50, "test": 40, "impacted": 30}


def reason_priority(reason: str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    return F.coalesce(table[F.col(reason)], F.lit(0))


def node_score() -> Column:
    """Priority, nearness, public and kind bonus, less a penalty for tests. Columns: reason, depth, modifiers, kind, is_test."""
    kind = F.when(F.col("kind").isin("function", "method"), 3.0).when(F.col("kind").isin("class", "struct", "trait", "interface"), 2.0).otherwise(0.0)
    public = F.when(F.coalesce(F.lower("modifiers").rlike("pub|export"), F.lit(False)), 5.0).otherwise(0.0)
    return reason_priority("reason") + F.greatest(20.0 - F.col("depth") * 5, F.lit(0.0)) + public + kind - F.when(F.col("is_test"), 10.0).otherwise(0.0)


def trim(nodes: DataFrame, edges: DataFrame, group: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Best nodes (qn, score, reason) of each group, targets first, and the edges between them."""
    w = Window.partitionBy(group).orderBy((F.col("reason") == "target").desc(), F.col("score").desc(), "qn")
    kept = nodes.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)
    names = kept.select("qn").distinct()
    inside = edges.join(names.withColumnRenamed("qn", "source"), "source", "left_semi").join(names.withColumnRenamed("qn", "target"), "target", "left_semi")
    return kept, inside


def replay(changes: DataFrame) -> DataFrame:
    """State of each path after its changes (repo_id, pos, path, change): the last one decides, removed paths are gone."""
    last = changes.groupBy("repo_id", "path").agg(F.max_by("change", "pos").alias("change"))
    return last.filter("change <> 'removed'").select("repo_id", "path")


def rename_edits(texts: DataFrame, key: str, text: str, old: str, new: str) -> DataFrame:
    """Lines that hold the old name between characters that aren't ASCII letters, digits or _, and what they become: key, line, before, after. Names are taken literally."""
    quoted = "\\Q" + old.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    whole = rf"(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])"
    new = new.replace("\\", "\\\\").replace("$", "\\$")
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "before"))
    return lines.filter(F.col("before").rlike(whole)).select(key, (F.col("line") + 1).alias("line"), "before", F.regexp_replace("before", whole, new).alias("after"))


def longest_runs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Longest run of lines that aren't blank in each text: key, start (from 1), length. The earlier one of equal runs."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    w = Window.partitionBy(key).orderBy("line")
    full = lines.withColumn("blank", (~F.col("raw").rlike(r"[^ \t\r\n]")).cast("int"))
    runs = full.withColumn("run", F.sum("blank").over(w)).filter("blank = 0").groupBy(key, "run").agg(F.min("line").alias("at"), F.count(F.lit(1)).alias("length"))
    best = runs.groupBy(key).agg(F.max(F.struct("length", (-F.col("at")).alias("at"))).alias("m"))
    return best.select(key, (1 - F.col("m.at")).alias("start"), F.col("m.length").alias("length"))


def line_windows(texts: DataFrame, key: str, text: str, size: int = 51) -> DataFrame:
    """Consecutive windows of so many lines: key, part, lines, bytes."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    return lines.groupBy(key, F.floor(F.col("line") / size).alias("part")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("raw") + 1).alias("bytes"))


def query_mode(text: str, regex: str | None = None, semantic: bool = False, vectors: bool = False) -> str:
    """How a search is run: structural scan, regex-filtered text, hybrid, semantic expansion or full text."""
    if not text.strip():
        return "structural_scan" if regex else "empty"
    if vectors:
        return "hybrid_semantic" if semantic else "hybrid"
    if regex:
        return "text_regex"
    return "semantic" if semantic else "full_text"


def comments_above(texts: DataFrame, key: str, text: str, declaration: str, comment: str, most: int = 16) -> DataFrame:
    """Comment lines straight above each declaration, at most the last so many: key, line of the declaration, lines, snippet."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    w = Window.partitionBy(key).orderBy("line")
    marked = lines.withColumn("is_comment", F.col("raw").rlike(comment)).withColumn("island", F.sum((~F.col("raw").rlike(comment)).cast("int")).over(w))
    notes = marked.filter("is_comment").groupBy(key, "island").agg(F.max("line").alias("until"), F.array_sort(F.collect_list(F.struct("line", "raw"))).alias("body"))
    kept = F.slice("body", F.greatest(F.size("body") - most + 1, F.lit(1)), most)
    above = notes.select(key, (F.col("until") + 1).alias("line"), F.size(kept).alias("lines"), F.array_join(F.transform(kept, lambda x: F.btrim(x["raw"])), "\n").alias("snippet"))
    return lines.filter(F.col("raw").rlike(declaration)).join(above, [key, "line"]).select(key, (F.col("line") + 1).alias("line"), "lines", "snippet")


def overlapping(spans: DataFrame, group: str) -> DataFrame:
    """Spans (start, end, id) that begin before an earlier one of their group has ended."""
    w = Window.partitionBy(group).orderBy("start", "end", "id").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reach", F.max("end").over(w)).filter(F.col("start") <= F.col("reach")).drop("reach")


def strip_payload(payload: Column, dropped: list[str], longest: int) -> Column:
    """Top-level fields of a JSON object without the named ones and without values longer than so many characters."""
    fields = F.from_json(payload, "map<string,string>")
    return F.to_json(F.map_filter(fields, lambda k, v: ~k.isin(*dropped) & (F.length(v) <= longest)))


def token_counter(path: str | None = None, bytes_per_token: int = 4):
    """A counter for count_tokens(): the tokenizer file at path, or None with the reason why bytes are counted instead."""
    if path is None:
        return None, "no tokenizer is set", bytes_per_token
    try:
        from tokenizers import Tokenizer

        Tokenizer.from_file(path)
    except Exception as failed:  # the library tells any trouble with a plain Exception
        return None, str(failed), bytes_per_token
    return path, None, bytes_per_token


def count_tokens(texts: DataFrame, key: str, text: str, counter) -> DataFrame:
    """key, tokens, method (tokenizer or heuristic) and why the heuristic was used. A null text has none."""
    path, reason, per = counter
    if path is None:
        return texts.select(key, F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / per).cast("long").alias("tokens"), F.lit("heuristic").alias("method"), F.lit(reason).alias("reason"))
    import pandas as pd

    @F.pandas_udf("long")
    def counted(column: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path).encode_batch(column.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([len(f.ids) for f in found])

    return texts.select(key, counted(text).alias("tokens"), F.lit("tokenizer").alias("method"), F.lit(None).cast("string").alias("reason"))


def suppressed(groups: DataFrame, patterns: list[str]) -> DataFrame:
    """Groups of duplicates (group_id, summary, path) that some pattern silences: it is in the group's id or summary, or begins a member's path."""
    hit = F.lit(False)
    for p in sorted({x.strip() for x in patterns} - {""}):
        hit = hit | F.col("group_id").contains(p) | F.col("summary").contains(p) | F.col("path").startswith(p)
    return groups.groupBy("group_id").agg(F.max(hit).alias("suppressed")).filter("suppressed").select("group_id")


def follow_reexports(exports: DataFrame, starts: DataFrame, depth: int = 4) -> DataFrame:
    """Where symbols come from: qn, origin and steps through re-exports (symbol, from_symbol), at most `depth` of them, each place once, at its least number of steps."""
    from graphloom.session import cut_lineage

    steps = cut_lineage(exports.select("symbol", "from_symbol").distinct())
    seen = frontier = cut_lineage(starts.select("qn", F.col("qn").alias("origin")).distinct().withColumn("steps", F.lit(0)))
    for k in range(1, depth + 1):
        found = frontier.join(steps, F.col("origin") == F.col("symbol")).select("qn", F.col("from_symbol").alias("origin")).distinct().join(seen, ["qn", "origin"], "left_anti")
        frontier = cut_lineage(found.withColumn("steps", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("steps > 0")


def ripple(kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """What a change reaches, by scope: kept nodes (scope, qn, file_path, component, direct) and dropped ones (scope, qn): retained, dropped, components, files beside, and the two sentences on them."""
    near = F.when(~F.col("direct"), F.col("file_path"))
    sums = kept.groupBy("scope").agg(F.count(F.lit(1)).alias("retained"), F.count_distinct("component").alias("components"), F.count_distinct(near).alias("beside"))
    size = kept.groupBy("scope", "component").agg(F.count(F.lit(1)).alias("n"))
    first = top_per_key(size, ["scope"], [F.col("n").desc(), F.col("component")], 3, "place")
    names = first.groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "component"))), lambda x: x["component"]), ", ").alias("names"))
    lost = dropped.groupBy("scope").agg(F.count(F.lit(1)).alias("dropped"))
    all_ = sums.join(names, "scope").join(lost, "scope", "left")
    spans = F.when(F.col("components") > 1, F.concat(F.lit("Impact spans "), F.col("components").cast("string"), F.lit(" components: "), "names"))
    reach = F.when(F.col("beside") > 0, F.concat(F.lit("Change reaches "), F.col("beside").cast("string"), F.lit(" neighboring file(s).")))
    said = F.concat_ws(" | ", spans, reach)
    return all_.select("scope", "retained", F.coalesce("dropped", F.lit(0)).cast("long").alias("dropped"), "components", "beside", F.when(said == "", "Impact remains local to selected nodes.").otherwise(said).alias("effects"))
