"""Window-style operators and the history of graphs over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def presence(rows: DataFrame, keys: list[str], last_pos: DataFrame, signature: Column | None = None) -> DataFrame:
    """Per key: first and last position, introductions, removals, changes and lifetime in snapshots.

    rows: one per key and position (repo_id, keys, pos). A gap is a removal and a new introduction; the first introduction
    is no change. last_pos: repo_id, last. Only positions that hold the key are sorted.
    """
    order = Window.partitionBy("repo_id", *keys).orderBy("pos")
    marked = rows.withColumn("sig", signature if signature is not None else F.lit(0))
    w = marked.select(
        "repo_id",
        *keys,
        "pos",
        (F.lag("pos").over(order).isNull() | (F.lag("pos").over(order) < F.col("pos") - 1)).alias("enters"),
        F.lead("pos").over(order).alias("next"),
        ((F.lag("pos").over(order) == F.col("pos") - 1) & ~F.lag("sig").over(order).eqNullSafe(F.col("sig"))).alias("differs"),
    )
    leaves = (F.col("next") > F.col("pos") + 1) | (F.col("next").isNull() & (F.col("pos") < F.col("last")))
    per = w.join(last_pos, "repo_id").groupBy("repo_id", *keys).agg(
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.count_if("enters").alias("introductions"),
        F.count_if(leaves).alias("removals"),
        F.count_if("differs").alias("rewrites"),
    )
    return per.withColumn("changes", F.col("removals") + F.col("introductions") - 1 + F.col("rewrites")).withColumn("lifetime", F.col("last_pos") - F.col("first_pos") + 1)


def stability(churn: DataFrame) -> DataFrame:
    """Adds stability: 1 less the change density and a quarter of the add and remove frequency, between 0 and 1."""
    life = F.greatest("lifetime", F.lit(1))
    value = 1.0 - F.col("changes") / life - (F.col("introductions") + F.col("removals")) / life * 0.25
    return churn.withColumn("stability", F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), 6))


def diff_neighbours(rows: DataFrame, keys: list[str], order: DataFrame) -> DataFrame:
    """Added and removed keys between all consecutive snapshots: repo_id, pos of the later one, keys, change. One sort, no self-join."""
    w = Window.partitionBy("repo_id", *keys).orderBy("pos")
    at = rows.select("repo_id", "pos", *keys).withColumn("before", F.lag("pos").over(w)).withColumn("after", F.lead("pos").over(w))
    last = order.groupBy("repo_id").agg(F.max("pos").alias("last"))
    events = F.filter(
        F.array(
            F.when((F.col("pos") > 1) & (F.col("before").isNull() | (F.col("before") < F.col("pos") - 1)), F.struct(F.col("pos").alias("pos"), F.lit("added").alias("change"))),
            F.when((F.col("pos") < F.col("last")) & (F.col("after").isNull() | (F.col("after") > F.col("pos") + 1)), F.struct((F.col("pos") + 1).alias("pos"), F.lit("removed").alias("change"))),
        ),
        lambda x: x.isNotNull(),
    )
    return at.join(last, "repo_id").select("repo_id", *keys, F.explode(events).alias("e")).select("repo_id", *keys, "e.pos", "e.change")


def merge_spans(spans: DataFrame, key: str, gap: int = 1) -> DataFrame:
    """Overlapping or adjacent line spans (start, end) of each key joined: key, start, end, spans."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.coalesce(F.col("start") <= F.col("reach") + gap, F.lit(False)), 0).otherwise(1)).over(w)
    return spans.withColumn("reach", reach).withColumn("island", island).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("spans")).drop("island")


def within_budget(rows: DataFrame, key: str, order: list[Column], size: str, budget: int) -> DataFrame:
    """Rows of each key, in order, as long as the running sum of sizes stays within the budget."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def ngrams(rows: DataFrame, key: str, order: list[str], item: str, n: int) -> DataFrame:
    """Sequences of n consecutive items of each key, counted over all keys."""
    w = Window.partitionBy(key).orderBy(*order)
    run = F.array(*(F.lag(item, k).over(w) for k in range(n - 1, 0, -1)), F.col(item))
    return rows.select(run.alias("run")).filter(~F.exists("run", lambda x: x.isNull())).groupBy(F.array_join("run", " > ").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def retention(order: DataFrame, latest: int, newer_than: int) -> DataFrame:
    """Snapshots to keep: the latest of each repository, those newer than a time, and the newest of each week."""
    last = Window.partitionBy("repo_id").orderBy(F.col("pos").desc())
    week = Window.partitionBy("repo_id", F.floor(F.col("author_time") / 604800)).orderBy(F.col("author_time").desc(), F.col("snapshot_id").desc())
    marked = order.withColumn("recent", F.row_number().over(last)).withColumn("of_week", F.row_number().over(week))
    return marked.filter((F.col("recent") <= latest) | (F.col("author_time") >= newer_than) | (F.col("of_week") == 1)).select("repo_id", "snapshot_id")
