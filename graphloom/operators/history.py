"""History of changing entity attributes, kept by rebuilding the chains that an update touches.

A chain is the list of versions of one entity. Late or corrected reports name the entities whose chains may change;
only the raw rows of those are read again, all their versions are rebuilt and the old chains are replaced together.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.session import cut_lineage

#: valid_to of a version that no later report has ended.
OPEN_END = 253402300799
#: Seconds after as_of up to which a report counts as delivered on time.
ON_TIME_SECS = 2 * 86400
#: Reports in one block of the two-level run search; a hot entity is split over its blocks.
BLOCK_REPORTS = 512
#: Buckets of entities in a stored history, of which only the touched ones are written again.
STORE_BUCKETS = 256

KEY = ["repo_id", "qualified_name"]


def commit_key(sha: Column) -> Column:
    """Commit ids compare by their first 12 characters, ignoring case."""
    return F.lower(F.substring(sha, 1, 12))


def attributes() -> Column:
    """The four attributes in the form in which they compare."""
    return F.struct(
        commit_key(F.col("first_commit_sha")).alias("first_commit"),
        commit_key(F.col("last_commit_sha")).alias("last_commit"),
        F.col("lifetime_snapshots"),
        F.coalesce(F.array_sort(F.array_distinct(F.array_compact("current_file_paths"))), F.array().cast("array<string>")).alias("paths"),
    )


def fingerprint(ver: Column) -> Column:
    """128 bits by which versions are compared; null differs from every value."""
    parts = [x for c in ("first_commit", "last_commit", "lifetime_snapshots", "paths") for x in (ver[c].isNull(), ver[c])]
    return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(31), *parts).alias("h2"))


def raw_versions(churn: DataFrame) -> DataFrame:
    """The rows of the reports with their attributes (ver) and a fingerprint of those (fp)."""
    return (
        churn.filter(F.col("repo_id").isNotNull() & F.col("qualified_name").isNotNull() & F.col("as_of").isNotNull())
        .select("repo_id", "qualified_name", "as_of", "ingested_at", attributes().alias("ver"))
        .withColumn("fp", fingerprint(F.col("ver")))
    )


def report_calendar(churn: DataFrame) -> DataFrame:
    """repo_id, as_of, pos and the as_of of the report after it."""
    order = Window.partitionBy("repo_id").orderBy("as_of")
    return (
        churn.filter(F.col("repo_id").isNotNull() & F.col("as_of").isNotNull())
        .select("repo_id", "as_of")
        .distinct()
        .select("repo_id", "as_of", F.row_number().over(order).alias("pos"), F.lead("as_of").over(order).alias("next_as_of"))
    )


def _runs(rows: DataFrame, by: list[str]) -> DataFrame:
    """Neighbouring runs with equal fingerprints made one. rows: as_of, lo, hi (first and last report), ends (as_of after hi), ver, fp.

    Everything happens in the order (by, as_of), so that all windows share one shuffle and one sort.
    """
    order = Window.partitionBy(*by).orderBy("as_of")
    continues = F.lag("fp").over(order).eqNullSafe(F.col("fp")) & (F.lag("hi").over(order) == F.col("lo") - 1)
    first = F.col("first")
    return (
        rows.withColumn("first", ~F.coalesce(continues, F.lit(False)))
        .withColumn("last", F.coalesce(F.lead("first").over(order), F.lit(True)))
        .filter(first | F.col("last"))  # of longer runs only both ends are left, next to each other
        .withColumn("hi", F.when(F.col("last"), F.col("hi")).otherwise(F.lead("hi").over(order)))
        .withColumn("ends", F.when(F.col("last"), F.col("ends")).otherwise(F.lead("ends").over(order)))
        .filter(first)
        .drop("first", "last")
    )


def build_chains(versions: DataFrame, calendar: DataFrame, block_reports: int = BLOCK_REPORTS) -> DataFrame:
    """Longest runs of consecutive reports with equal values: repo_id, qualified_name, valid_from, valid_to, ver.

    Of several rows of an entity in a report the last ingested_at counts, at equal times the greatest values. Runs are
    found inside blocks of reports first and neighbouring runs are joined after that, so an entity that is in every report
    is never sorted as a whole.
    """
    placed = versions.join(calendar, ["repo_id", "as_of"]).withColumn("block", F.floor(F.col("pos") / block_reports))
    block = [*KEY, "block"]
    last_word = Window.partitionBy(*block).orderBy("as_of", F.col("ingested_at").asc_nulls_first(), "ver")
    newest = placed.withColumn("newer", F.lead("as_of").over(last_word)).filter(~F.col("newer").eqNullSafe(F.col("as_of")))
    rows = newest.select(*block, "as_of", F.col("pos").alias("lo"), F.col("pos").alias("hi"), F.coalesce("next_as_of", F.lit(OPEN_END)).alias("ends"), "ver", "fp")
    return _runs(_runs(rows, block).drop("block"), KEY).select(*KEY, F.col("as_of").alias("valid_from"), F.col("ends").alias("valid_to"), "ver")


def touched_entities(base: DataFrame, late: DataFrame, new_reports: DataFrame) -> DataFrame:
    """Entities named by late rows, and those with a version that a newly known report falls into."""
    named = late.select(*KEY)
    # one row per repository on the right side, so that a repository with many chains can be split among tasks
    times = new_reports.groupBy("repo_id").agg(F.collect_list("as_of").alias("reports"))
    inside = F.exists("reports", lambda at: (at > F.col("valid_from")) & (at < F.col("valid_to")))
    fell = base.join(times, "repo_id").filter(inside).select(*KEY)
    return named.union(fell).filter(F.col("repo_id").isNotNull() & F.col("qualified_name").isNotNull()).distinct()


def rebuilt_chains(churn: DataFrame, touched: DataFrame) -> DataFrame:
    """All versions of the touched entities, from all their raw rows."""
    return build_chains(raw_versions(churn.join(touched, KEY, "left_semi")), report_calendar(churn))


def apply_updates(base: DataFrame, churn: DataFrame, late: DataFrame, base_calendar: DataFrame) -> DataFrame:
    """History after the late rows: untouched chains as they were, touched ones rebuilt."""
    new_reports = report_calendar(churn).join(base_calendar, ["repo_id", "as_of"], "left_anti")
    touched = cut_lineage(touched_entities(base, late, new_reports))  # read twice
    return base.join(touched, KEY, "left_anti").unionByName(rebuilt_chains(churn, touched))


def entity_history(churn: DataFrame, on_time_secs: int = ON_TIME_SECS) -> DataFrame:
    """Full history from periodic reports: repo_id, qualified_name, valid_from, valid_to, ver (first_commit, last_commit,
    lifetime_snapshots and paths as they compare).

    Reports delivered within on_time_secs of as_of make the base history; all later rows are applied to it by
    rebuilding the chains they touch. The result doesn't depend on where that line is drawn. Rows with a null
    repository, name or as_of take no part; a null ingested_at counts as on time and as the earliest. Null commit ids
    equal only null, null paths are the empty set. Empty tables give an empty history.
    """
    is_late = F.coalesce(F.unix_timestamp(F.col("ingested_at").cast("timestamp")) - F.col("as_of") > on_time_secs, F.lit(False))
    on_time, late = churn.filter(~is_late), churn.filter(is_late)
    calendar = report_calendar(on_time)
    base = cut_lineage(build_chains(raw_versions(on_time), calendar))  # as a stored history would be
    return apply_updates(base, churn, late, calendar)


def _swap(spark: SparkSession, folder: str, name: str, content: dict) -> None:
    """Puts a small file in place of an older one in one rename."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, staged = fs_path(f"{folder}/{name}"), fs_path(f"{folder}/{name}.{uuid.uuid4().hex}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), conf)
    overwrite = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(staged), fs.makeQualified(target), overwrite)


def _pointer(spark: SparkSession, folder: str, name: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(f"{folder}/{name}").collect()))


def publish_history(history: DataFrame, folder: str) -> str:
    """Replace a stored table as a whole: a new version is written, then one pointer file is renamed over the old one."""
    version = f"v-{uuid.uuid4().hex}"
    history.write.parquet(f"{folder}/{version}")
    _swap(history.sparkSession, folder, "CURRENT", {"version": version})
    return f"{folder}/{version}"


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """The version that the pointer names."""
    return spark.read.parquet(f"{folder}/{_pointer(spark, folder, 'CURRENT')['version']}")


def _bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.hash(*key), F.lit(buckets))


def _write_buckets(chains: DataFrame, folder: str, key: list[str], buckets: int) -> str:
    version = f"v-{uuid.uuid4().hex}"
    chains.withColumn("bucket", _bucket_of(key, buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{folder}/{version}")
    return version


def _buckets_in(spark: SparkSession, folder: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    return [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]


def publish_chains(history: DataFrame, folder: str, buckets: int = STORE_BUCKETS, key: list[str] | None = None) -> None:
    """Store a history, or another table of slices by key, in buckets under a manifest that names the version of every bucket."""
    spark, key = history.sparkSession, key or KEY
    version = _write_buckets(history, folder, key, buckets)
    _swap(spark, folder, "MANIFEST", {"buckets": buckets, "key": key, "schema": history.schema.jsonValue(), "at": {str(k): version for k in _buckets_in(spark, f"{folder}/{version}")}})


def read_chains(spark: SparkSession, folder: str, only: set[int] | None = None) -> DataFrame:
    """The stored history, or some of its buckets, as the manifest names them."""
    manifest = _pointer(spark, folder, "MANIFEST")
    schema = StructType.fromJson(manifest["schema"])
    paths = [f"{folder}/{version}/bucket={k}" for k, version in manifest["at"].items() if only is None or int(k) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def replace_chains(touched: DataFrame, rebuilt: DataFrame, folder: str) -> int:
    """Put the rebuilt versions in place of all stored ones of the touched entities, in one step for readers.

    Only the buckets that hold touched entities are read and written again; the manifest is then swapped by one rename. A
    touched entity without rebuilt versions is gone. Gives the number of buckets written.
    """
    spark = touched.sparkSession
    manifest = _pointer(spark, folder, "MANIFEST")
    key, buckets = manifest["key"], manifest["buckets"]
    hit = {r.bucket for r in touched.select(_bucket_of(key, buckets).alias("bucket")).distinct().collect()}  # at most as many as there are buckets
    if not hit:
        return 0
    kept = read_chains(spark, folder, hit).join(touched.select(*key), key, "left_anti")
    version = _write_buckets(kept.unionByName(rebuilt.select(*kept.columns)), folder, key, buckets)
    at = {k: v for k, v in manifest["at"].items() if int(k) not in hit} | {str(k): version for k in _buckets_in(spark, f"{folder}/{version}")}
    _swap(spark, folder, "MANIFEST", manifest | {"at": at})
    return len(hit)


def update_chains(churn: DataFrame, late: DataFrame, known_reports: DataFrame, folder: str) -> int:
    """A stored history brought up to date with late rows (already part of churn); known_reports: repo_id, as_of of the stored history."""
    base = read_chains(churn.sparkSession, folder)
    new_reports = report_calendar(churn).join(known_reports, ["repo_id", "as_of"], "left_anti")
    touched = cut_lineage(touched_entities(base, late, new_reports))
    return replace_chains(touched, rebuilt_chains(churn, touched), folder)
