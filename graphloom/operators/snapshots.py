"""What changed between consecutive full snapshots of a file listing.

The rows are first cut down to compact arrays (two 64-bit hashes of the path, one of the content sets, one of the
file hash). Each hash bucket of paths is sorted once in numpy; searchsorted then yields the set differences
of every pair of neighbouring snapshots together. Paths are fetched again only for keys that differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Listing rows that one numpy bucket should hold on average.
BUCKET_ROWS = 400_000
_KINDS = np.array(["added", "removed", "changed"], dtype=object)


def canonical_path(path: Column) -> Column:
    """Paths compare without any leading ./"""
    return F.regexp_replace(path, r"^(\./)+", "")


def _set_hash(values: Column) -> Column:
    """Equal for arrays with the same set of non-null elements; null and empty arrays are equal."""
    return F.xxhash64(F.coalesce(F.array_sort(F.array_distinct(F.array_compact(values))), F.array()))


def ordered_snapshots(snapshots: DataFrame, commits: DataFrame) -> DataFrame:
    """Complete snapshots with their position by author time: repo_id, snapshot_id, pos, next_id and the last position of the repository."""
    snap = (
        snapshots.filter(F.col("completeness") == 1.0)
        .groupBy("repo_id", "snapshot_id")
        .agg(F.min("commit_sha").alias("commit_sha"))
    )
    when = commits.groupBy("repo_id", "commit_sha").agg(F.min("author_time").alias("author_time"))
    order = Window.partitionBy("repo_id").orderBy("author_time", "snapshot_id")
    return (
        snap.join(when, ["repo_id", "commit_sha"])
        .select("repo_id", "snapshot_id", F.row_number().over(order).cast("long").alias("pos"), F.lead("snapshot_id").over(order).alias("next_id"), F.count(F.lit(1)).over(Window.partitionBy("repo_id")).alias("last"))
    )


def difference_kernel(last: np.ndarray, pos: np.ndarray, key: np.ndarray, content: np.ndarray, fhash: np.ndarray, has_hash: np.ndarray):
    """Differences inside one bucket of distinct (snapshot, path) cells: arrays (row, kind), kind 0 added in the row's snapshot, 1 removed in the next, 2 changed in the row's.

    pos: number of the snapshot in its repository, from 1; last: the last such number; key: code of repository and path.
    """
    width = int(key.max()) + 1 if len(key) else 1
    cell = pos.astype(np.int64) * width + key  # one integer per (snapshot, path)
    by_cell = np.argsort(cell, kind="stable")
    cells = cell[by_cell]

    def look(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(cells, targets), len(cells) - 1)
        return cells[at] == targets, by_cell[at]

    before, prev = look(cell - width)
    after, _ = look(cell + width)
    differs = before & ((content != content[prev]) | (has_hash & has_hash[prev] & (fhash != fhash[prev])))
    # the first listing has nothing before it, the last nothing after it
    rows = [np.flatnonzero(~before & (pos > 1)), np.flatnonzero(~after & (pos < last)), np.flatnonzero(differs)]
    return np.concatenate(rows), np.repeat(np.arange(3), [len(r) for r in rows])


def _bucket(table: pa.Table) -> pa.Table:
    take = lambda name: table[name].to_numpy()
    repo, pos, last, k1, k2, at, content = (take(c) for c in ("repo_id", "pos", "last", "k1", "k2", "at", "content"))
    has = ~np.asarray(table["fhash"].is_null())
    fhash = table["fhash"].fill_null(0).to_numpy()
    # of several rows of a cell the last one counts
    order = np.lexsort((np.where(has, fhash, -1), has, content, at, pos, k2, k1, repo))
    new = lambda *columns: np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)]
    path = np.cumsum(new(repo, k1, k2))
    final = np.r_[new(repo, k1, k2, pos)[1:], True]
    order, path = order[final], path[final]
    row, kind = difference_kernel(last[order], pos[order], path, content[order], fhash[order], has[order])
    took = order[row]
    return pa.table(
        {"repo_id": repo[took], "pos": pos[took] + (kind == 1), "k1": k1[took], "k2": k2[took], "change": pa.array(_KINDS[kind], pa.string())}
    )


def snapshot_changes(membership: DataFrame, snapshots: DataFrame, commits: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """repo_id, snapshot_id, file_path, change (added, removed or changed) against the complete snapshot before.

    Snapshots with completeness 1.0 are ordered by the author time of their commit, then by id; one whose commit is
    unknown takes no part. Of several rows of a path in a snapshot the last ingested_at counts, null coming first;
    at equal times the greater content hash does, so that a rerun gives the same rows. Rows with a null repository,
    snapshot or path are left out. Null arrays are empty sets, null elements are ignored, a null file hash equals
    every other. A snapshot without rows is an empty listing. Empty tables give an empty result.
    """
    order = ordered_snapshots(snapshots, commits)
    path = canonical_path(F.col("file_path"))
    named = membership.filter(F.col("file_path").isNotNull() & F.col("repo_id").isNotNull() & F.col("snapshot_id").isNotNull())
    key = [F.xxhash64(path).alias("k1"), F.xxhash64(F.lit(7), path).alias("k2")]
    compact = named.select(
        "repo_id",
        "snapshot_id",
        *key,
        F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(-(2**63))).alias("at"),
        F.xxhash64(_set_hash(F.col("qualified_names")), _set_hash(F.col("edge_keys"))).alias("content"),
        F.when(F.col("file_hash").isNotNull(), F.xxhash64(F.lower("file_hash"))).alias("fhash"),
    )
    # a bucket holds paths of any repositories, so large and small ones need no different treatment
    buckets = max(1, -(-membership.count() // bucket_rows))
    placed = compact.join(order.drop("next_id"), ["repo_id", "snapshot_id"]).drop("snapshot_id")
    differing = (
        placed.withColumn("bucket", F.pmod(F.hash("repo_id", "k2"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInArrow(_bucket, "repo_id long, pos long, k1 long, k2 long, change string")
    )
    # every path once, and of those only the ones that differ
    paths = named.select("repo_id", *key, path.alias("file_path")).distinct()
    return (
        differing.join(order.select("repo_id", "pos", "snapshot_id"), ["repo_id", "pos"])
        .join(paths, ["repo_id", "k1", "k2"])
        .select("repo_id", "snapshot_id", "file_path", "change")
    )
