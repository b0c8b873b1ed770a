"""Session helpers: how tables are read and where intermediate tables may be written."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle: int = 8) -> SparkSession:
    """Local session for tests and benchmarks. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("graphloom")
        .config("spark.driver.memory", os.environ.get("GRAPHLOOM_DRIVER_MEMORY", "6g"))
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "graphloom-warehouse"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession, purpose: str) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. A folder of this machine is taken only in local mode; elsewhere its absence is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"graphloom-{purpose}-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder. With spark.cleaner.referenceTracking.cleanCheckpoints the files go when nothing refers to them any more."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_root(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy for its bytes: rows over all cores if the scan has fewer parts than there are cores.

    Scans of large inputs have more, and are left as they are, without a shuffle. So is what comes out of a shuffle, whose
    parts aren't known before it runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    planned = df._jdf.queryExecution()
    if planned.executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return df
    return df if planned.toRdd().getNumPartitions() >= cores else df.repartition(cores)


#: Bytes of planned input for each part of an explicit repartitioning.
PART_BYTES = 128 << 20


def parts_for(df: DataFrame) -> int | None:
    """Parts for a shuffle of df where the session's number would make them too large for a task; None leaves the number to the session and its adaptive planning."""
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = -(-planned // PART_BYTES)
    return wanted if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) and planned < 1 << 62 else None
