"""Session events and memories: dedup, counters, eviction, compaction, resume state, recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Compaction: of events of a type with one payload key the newest so many stay. Fixed values.
KEEP = {"view": 3, "click": 3, "purchase": 1, "signup": 2}
#: Priority that unresolved errors get when a session is compacted.
PROMOTED = 90


def dedup(events: DataFrame) -> DataFrame:
    """First event of each session and hash; the least id decides."""
    first = events.groupBy("session_id", "event_hash").agg(F.min("id").alias("id"))
    return events.join(first.select("id"), "id", "left_semi")


def dedup_within(events: DataFrame, seconds: int) -> DataFrame:
    """Events without an equal one in the session at most so many seconds before."""
    w = Window.partitionBy("session_id", "event_hash").orderBy("created_at", "id")
    gap = F.col("created_at").cast("timestamp").cast("double") - F.lag(F.col("created_at").cast("timestamp").cast("double")).over(w)
    return events.withColumn("gap", gap).filter(F.col("gap").isNull() | (F.col("gap") > seconds)).drop("gap")


def access_counts(events: DataFrame, key: Column) -> DataFrame:
    return events.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def compact(events: DataFrame) -> DataFrame:
    """id, session_id, priority and fate of each event: keep, decay (too old for its key), or promote (last error of its key)."""
    keep = F.create_map(*(F.lit(x) for kv in KEEP.items() for x in kv))
    key = F.coalesce(F.get_json_object("payload", "$.k"), F.lit("_unknown_"))
    w = Window.partitionBy("session_id", "event_type", key).orderBy(F.col("created_at").desc(), F.col("id").desc())
    age = events.withColumn("age", F.row_number().over(w)).withColumn("limit", keep[F.col("event_type")])
    promoted = (F.col("event_type") == "error") & (F.col("age") == 1)
    fate = F.when(promoted, "promote").when(F.col("age") > F.col("limit"), "decay").otherwise("keep")
    return age.select("id", "session_id", F.when(promoted, PROMOTED).otherwise(F.col("priority")).alias("priority"), fate.alias("fate"))


def resume(events: DataFrame, commands: int = 10) -> DataFrame:
    """One row per session: events, errors, last intent, and the last commands in order of time."""
    w = Window.partitionBy("session_id", "event_type").orderBy(F.col("created_at").desc(), F.col("id").desc())
    recent = events.withColumn("age", F.row_number().over(w))
    last = F.array_sort(F.collect_list(F.when((F.col("event_type") == "click") & (F.col("age") <= commands), F.struct("created_at", "id", F.get_json_object("payload", "$.k").alias("k")))))
    return recent.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.max(F.when((F.col("event_type") == "signup") & (F.col("age") == 1), F.get_json_object("payload", "$.k"))).alias("intent"),
        F.array_join(F.transform(last, lambda x: x["k"]), ",").alias("commands"),
    )


def recall(memories: DataFrame, phrase: str, limit: int) -> DataFrame:
    """Best memories of each topic: exact title first, then title, then text holds the phrase (letter case ignored but for the exact one); newest first."""
    low = phrase.lower()
    tier = F.when(F.col("title") == phrase, 0).when(F.lower("title").contains(low), 1).when(F.lower("content").contains(low), 2)
    w = Window.partitionBy("topic").orderBy("tier", F.col("created_at").desc(), "id")
    return memories.withColumn("tier", tier).filter("tier is not null").withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


def page_after(rows: DataFrame, keys: list[str], cursor: list, limit: int) -> DataFrame:
    """The page after a cursor in descending order of the keys, without skipping over earlier pages."""
    after, same = F.lit(False), F.lit(True)
    for k, v in zip(keys, cursor):
        after, same = after | (same & (F.col(k) < F.lit(v))), same & (F.col(k) == F.lit(v))
    return rows.filter(after).orderBy(*(F.col(k).desc() for k in keys)).limit(limit)


def size_limited(rows: DataFrame, key: str, order: list[Column], size: Column, cap: int) -> DataFrame:
    """Newest rows of each key that fit into the cap together."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(w)).filter(F.col("running") <= cap)


def canonical_json(pairs: Column) -> Column:
    """JSON of a map<string,string> with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def put_snapshots(stored: DataFrame, new: DataFrame, cap: int) -> DataFrame:
    """Resume snapshots (session_id, seq, snapshot, consumed) after newer ones are put: the latest of each session, not consumed yet. One of more than cap bytes is left out."""
    fresh = new.filter(F.octet_length("snapshot") <= cap).select("session_id", "seq", "snapshot", F.lit(False).alias("consumed"))
    both = stored.select("session_id", "seq", "snapshot", "consumed").unionByName(fresh)
    return both.groupBy("session_id").agg(F.max_by(F.struct("seq", "snapshot", "consumed"), F.struct("seq", ~F.col("consumed"), "snapshot")).alias("s")).select("session_id", "s.*")


def consume_snapshots(stored: DataFrame, sessions: DataFrame) -> DataFrame:
    """The same with those of the sessions (session_id) marked as consumed."""
    used = sessions.select("session_id").distinct().withColumn("_used", F.lit(True))
    return stored.join(used, "session_id", "left").select("session_id", "seq", "snapshot", (F.col("consumed") | F.coalesce("_used", F.lit(False))).alias("consumed"))


def run_states(events: DataFrame) -> DataFrame:
    """State of the latest run of each scope (scope, seq, event: begin, finish or fail; at): scope, state, began, ended. A begin starts anew."""
    from pyspark.sql import Window

    w = Window.partitionBy("scope").orderBy("seq")
    runs = events.withColumn("run", F.sum(F.when(F.col("event") == "begin", 1).otherwise(0)).over(w)).filter("run > 0")
    latest = runs.groupBy("scope", "run").agg(F.min("at").alias("began"), F.max_by("event", "seq").alias("event"), F.max(F.when(F.col("event") != "begin", F.col("at"))).alias("ended"))
    last = latest.groupBy("scope").agg(F.max_by(F.struct("began", "event", "ended"), "run").alias("r"))
    state = F.when(F.col("r.event") == "finish", "succeeded").when(F.col("r.event") == "fail", "failed").otherwise("running")
    return last.select("scope", state.alias("state"), "r.began", "r.ended")
