"""Session events as streams: dedup, counters, watched changes and staged files, with watermarks where state must end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import shared_root

#: How late an event may come before its state is dropped.
WATERMARK = "1 hour"


def read_events(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream of events with ts as a timestamp."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def dedup_stream(events: DataFrame, keys: list[str], watermark: str = WATERMARK) -> DataFrame:
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def window_counts(events: DataFrame, width: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def coalesce_changes(batch: DataFrame) -> DataFrame:
    """Last change (seq, path, change, old_path) of each path; a rename takes away what is pending for the old path."""
    last = batch.groupBy("path").agg(F.max_by(F.struct("seq", "change", "old_path"), "seq").alias("c")).select("path", "c.*")
    renamed = batch.filter("change = 'renamed'").groupBy(F.col("old_path").alias("path")).agg(F.max("seq").alias("renamed_at"))
    return last.join(renamed, "path", "left").filter(F.col("renamed_at").isNull() | (F.col("seq") > F.col("renamed_at"))).drop("renamed_at")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the cluster names, or of this machine in local tests."""
    return f"{shared_root(spark, 'stream')}/{name}-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over all that there is and gives its output as a table. State and output lie in the shared folder."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if each is not None:
        query = writer.foreachBatch(each).start()
    elif mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        query = writer.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def plan_batch(pending: int, overflowed: bool, most: int = 2048) -> str:
    """What to do with a batch of watched changes: nothing, an incremental update, or a full scan after lost events."""
    return "rescan" if overflowed or pending > most else "update" if pending else "idle"


def staged(spark: SparkSession, folder: str, schema: str, types: list[str]) -> DataFrame:
    """Envelopes dropped as JSON files into a folder, of known types only; files are deleted once they are read."""
    stream = spark.readStream.schema(schema).option("cleanSource", "delete").json(folder)
    return stream.filter(F.col("event_type").isin(*types))


def apply_batch(current: Callable[[], DataFrame], publish: Callable[[DataFrame], None], key: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that replaces the slices of a table which a batch of rows holds and publishes the whole result at once."""
    from graphloom.sources.store import replace_slices

    def run(batch: DataFrame, number: int) -> None:
        publish(replace_slices(current(), batch, key))

    return run


def apply_to_buckets(folder: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that replaces the slices which a batch holds in a stored, bucketed table (publish_chains): only their buckets are written again."""
    from graphloom.operators.history import replace_chains

    def run(batch: DataFrame, number: int) -> None:
        replace_chains(batch, batch, folder)

    return run


def build_state(rows: DataFrame) -> DataFrame:
    """Latest state of each build from its transitions (build_id, seq, state): building, built or failed."""
    return rows.groupBy("build_id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))
