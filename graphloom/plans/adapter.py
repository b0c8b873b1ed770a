"""Property graph, text corpus and event ledger over the given tables, once for Spark and once as SQL.

The graph of a repository is the listing of its last complete snapshot. Names and paths are made unique over all
repositories by a prefix "<repo>#". Attributes that the tables don't hold (lines, visibility, parameters, tests,
confidence) are computed from the names, alike in both forms.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.snapshots import canonical_path, ordered_snapshots
from graphloom.session import shared_root, table


#: Tables from which the graph is made; it is made again when one of their files changes.
_SOURCES = ("snapshot_membership", "graph_snapshots", "commits")
#: Rows of the listing for each stored bucket.
_BUCKET_ROWS = 2_000_000
_STORED: dict[tuple, str] = {}


def _stamp(graph: Graph) -> tuple:
    """Files of the source tables with their sizes and times."""
    jvm = graph.spark.sparkContext._jvm
    conf = graph.spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in _SOURCES:
        path = jvm.org.apache.hadoop.fs.Path(f"{graph.sf_dir}/{name}.parquet")
        fs = path.getFileSystem(conf)
        files = fs.listStatus(path) if fs.exists(path) else []
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return (graph.spark.sparkContext.applicationId, graph.sf_dir, *sorted(out))


def stored(graph: Graph, name: str, make, key: str) -> DataFrame:
    """A table of the graph, written once for each state of its sources into the shared folder, in buckets of a key, and read from there by every query of the application.

    As the index of a prebuilt graph does, this spares queries the listing of the snapshots, and joins on the key a shuffle.
    """
    at = (*_stamp(graph), name)
    if at not in _STORED:
        rows = make()
        buckets = max(graph.spark.sparkContext.defaultParallelism, -(-graph.t("snapshot_membership").count() // _BUCKET_ROWS))
        table_name = f"graphloom_{name}_{uuid.uuid4().hex}"
        root = shared_root(graph.spark, "graph")
        placed = rows.repartition(buckets, key)
        try:
            placed.write.bucketBy(buckets, key).sortBy(key).option("path", f"{root}/{table_name}").saveAsTable(table_name)
            _STORED[at] = table_name
        except Py4JJavaError:  # a catalog without a place of its own: the same files, without their buckets
            placed.sortWithinPartitions(key).write.parquet(f"{root}/{table_name}-files")
            _STORED[at] = f"{root}/{table_name}-files"
    name = _STORED[at]
    return graph.spark.read.parquet(name) if "/" in name else graph.spark.table(name)


@dataclass
class Graph:
    """DataFrames of one data folder, built when first used."""

    spark: SparkSession
    sf_dir: str

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def order(self) -> DataFrame:
        """repo_id, snapshot_id, pos, next_id of complete snapshots in commit order."""
        return ordered_snapshots(self.t("graph_snapshots"), self.t("commits")).drop("last")

    @cached_property
    def listing(self) -> DataFrame:
        """Every complete snapshot's files: repo_id, pos, snapshot_id, path, file_hash, language, size, qualified_names, edge_keys."""
        path = canonical_path(F.col("file_path"))
        value = F.struct("ingested_at", F.lower("file_hash").alias("file_hash"), "language", "size", "qualified_names", "edge_keys")
        rows = (
            self.t("snapshot_membership")
            .withColumn("path", path)
            .groupBy("repo_id", "snapshot_id", "path")
            .agg(F.max_by(value, F.struct("ingested_at", F.lower("file_hash"))).alias("v"))
        )
        return rows.join(self.order, ["repo_id", "snapshot_id"]).select(
            "repo_id", "pos", "snapshot_id", F.concat_ws("#", "repo_id", "path").alias("path"), "v.file_hash", "v.language", "v.size", "v.qualified_names", "v.edge_keys"
        )

    @cached_property
    def last(self) -> DataFrame:
        return self.listing.join(self.order.filter(F.col("next_id").isNull()).select("repo_id", "pos"), ["repo_id", "pos"])

    @cached_property
    def files(self) -> DataFrame:
        return self.last.select("repo_id", "path", F.col("file_hash").alias("hash"), "language", "size")

    @staticmethod
    def node_rows(listing: DataFrame, *keep: str) -> DataFrame:
        qn = F.explode(F.array_distinct(F.coalesce("qualified_names", F.array().cast("array<string>"))))
        rows = listing.select("repo_id", *keep, "path", "file_hash", "language", qn.alias("local")).filter(F.col("local").isNotNull())
        short = F.split_part("local", F.lit("::"), F.lit(2))
        return rows.select(
            "repo_id",
            *keep,
            F.concat_ws("#", "repo_id", "local").alias("qn"),
            F.split_part("local", F.lit("::"), F.lit(3)).alias("name"),
            F.when(short == "fn", "function").when(short == "const", "constant").otherwise(short).alias("kind"),
            F.col("path").alias("file_path"),
            F.col("file_hash").alias("hash"),
            "language",
        )

    @cached_property
    def nodes(self) -> DataFrame:
        return stored(self, "nodes", self._nodes, "qn")

    @cached_property
    def edges(self) -> DataFrame:
        return stored(self, "edges", self._edges, "source")

    def _nodes(self) -> DataFrame:
        n = F.length("name")
        start = F.length("qn") * 3 % 400 + 1
        callables = F.col("kind").isin("function", "method")
        return self.node_rows(self.last).select(
            "*",
            start.cast("int").alias("line_start"),
            (start + n * 7 % 90 + 2).cast("int").alias("line_end"),
            F.when(n % 3 == 0, "pub").when(n % 3 == 1, "private").alias("modifiers"),
            F.when(n % 4 == 0, "()").when(n % 4 == 1, "(a)").when(n % 4 == 2, "(a, b)").alias("params"),
            F.when(n % 5 == 0, "usize").alias("return_type"),
            (callables & (n % 7 == 0)).alias("is_test"),
        )

    @staticmethod
    def edge_rows(listing: DataFrame, *keep: str) -> DataFrame:
        e = F.explode(F.array_distinct("edge_keys"))
        rows = listing.select("repo_id", *keep, "path", e.alias("e")).select("repo_id", *keep, "path", "e.*").filter(F.col("source_qn").isNotNull() & F.col("target_qn").isNotNull())
        return rows.select("repo_id", *keep, F.concat_ws("#", "repo_id", "source_qn").alias("source"), F.concat_ws("#", "repo_id", "target_qn").alias("target"), "kind", F.col("path").alias("file_path"))

    def _edges(self) -> DataFrame:
        confidence = F.round(0.3 + (F.length("source") * 3 + F.length("target")) % 8 / 10, 1)
        return self.edge_rows(self.last).select(
            "*", confidence.alias("confidence"), F.when(confidence < 0.5, "low").when(confidence < 0.8, "medium").otherwise("high").alias("tier")
        )

    @cached_property
    def ledger(self) -> DataFrame:
        """Session events: id, session_id, event_type, priority, payload, event_hash, created_at."""
        rank = F.col("event_type")
        priority = F.when(rank == "error", 80).when(rank == "purchase", 60).when(rank == "signup", 50).when(rank == "click", 30).otherwise(10)
        return self.t("events").select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
            "event_type",
            priority.alias("priority"),
            F.col("props").alias("payload"),
            F.sha2(F.concat_ws(":", "event_type", "props"), 256).alias("event_hash"),
            F.col("ts").alias("created_at"),
            "value",
        )

    @cached_property
    def chunks(self) -> DataFrame:
        """Text chunks: id, source, title, content, content_type, lang."""
        return self.t("documents").filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), "source", "title", F.col("text").alias("content"), "content_type", "lang", "created_at", "repo_id", "chunk_index")


#: Common table expressions for DuckDB: snap_order, listing, last_listing, files, nodes, edges, hnodes, hedges, ledger, chunks.
CTES = """
s0 AS (SELECT repo_id, snapshot_id, min(commit_sha) AS commit_sha FROM graph_snapshots WHERE completeness = 1.0 GROUP BY 1, 2),
c0 AS (SELECT repo_id, commit_sha, min(author_time) AS author_time FROM commits GROUP BY 1, 2),
snap_order AS (SELECT repo_id, snapshot_id, row_number() OVER w AS pos, lead(snapshot_id) OVER w AS next_id, author_time, commit_sha
  FROM s0 JOIN c0 USING (repo_id, commit_sha) WINDOW w AS (PARTITION BY repo_id ORDER BY author_time, snapshot_id)),
m0 AS (SELECT *, repo_id || '#' || regexp_replace(file_path, '^(\\./)+', '') AS path FROM snapshot_membership
  QUALIFY row_number() OVER (PARTITION BY repo_id, snapshot_id, regexp_replace(file_path, '^(\\./)+', '') ORDER BY ingested_at DESC NULLS LAST) = 1),
listing AS (SELECT m0.repo_id, o.pos, m0.snapshot_id, path, lower(file_hash) AS file_hash, language, size, qualified_names, edge_keys
  FROM m0 JOIN snap_order o USING (repo_id, snapshot_id)),
last_listing AS (SELECT l.* FROM listing l JOIN snap_order o ON o.repo_id = l.repo_id AND o.pos = l.pos WHERE o.next_id IS NULL),
files AS (SELECT repo_id, path, file_hash AS hash, language, size FROM last_listing),
hn0 AS (SELECT DISTINCT repo_id, pos, snapshot_id, path, file_hash, language, unnest(qualified_names) AS loc FROM listing),
hnodes AS (SELECT repo_id, pos, snapshot_id, repo_id || '#' || loc AS qn, split_part(loc, '::', 3) AS name,
  CASE split_part(loc, '::', 2) WHEN 'fn' THEN 'function' WHEN 'const' THEN 'constant' ELSE split_part(loc, '::', 2) END AS kind,
  path AS file_path, file_hash AS hash, language FROM hn0 WHERE loc IS NOT NULL),
nodes AS (SELECT n.repo_id, qn, name, kind, file_path, hash, language,
  (length(qn) * 3 % 400 + 1)::INTEGER AS line_start, (length(qn) * 3 % 400 + 1 + length(name) * 7 % 90 + 2)::INTEGER AS line_end,
  CASE length(name) % 3 WHEN 0 THEN 'pub' WHEN 1 THEN 'private' END AS modifiers,
  CASE length(name) % 4 WHEN 0 THEN '()' WHEN 1 THEN '(a)' WHEN 2 THEN '(a, b)' END AS params,
  CASE length(name) % 5 WHEN 0 THEN 'usize' END AS return_type,
  kind IN ('function', 'method') AND length(name) % 7 = 0 AS is_test
  FROM hnodes n JOIN snap_order o ON o.repo_id = n.repo_id AND o.pos = n.pos WHERE o.next_id IS NULL),
he0 AS (SELECT DISTINCT repo_id, pos, snapshot_id, path, unnest(edge_keys) AS e FROM listing),
hedges AS (SELECT repo_id, pos, snapshot_id, repo_id || '#' || e.source_qn AS source, repo_id || '#' || e.target_qn AS target, e.kind AS kind, path AS file_path
  FROM he0 WHERE e.source_qn IS NOT NULL AND e.target_qn IS NOT NULL),
edges AS (SELECT x.*, CASE WHEN confidence < 0.5 THEN 'low' WHEN confidence < 0.8 THEN 'medium' ELSE 'high' END AS tier FROM (
  SELECT h.repo_id, source, target, kind, file_path, round(0.3 + ((length(source) * 3 + length(target)) % 8) / 10.0::DOUBLE, 1)::DOUBLE AS confidence
  FROM hedges h JOIN snap_order o ON o.repo_id = h.repo_id AND o.pos = h.pos WHERE o.next_id IS NULL) x),
ledger AS (SELECT event_id AS id, 's' || user_id AS session_id, event_type,
  CASE event_type WHEN 'error' THEN 80 WHEN 'purchase' THEN 60 WHEN 'signup' THEN 50 WHEN 'click' THEN 30 ELSE 10 END AS priority,
  props AS payload, sha256(event_type || ':' || props) AS event_hash, ts AS created_at, value FROM events),
chunks AS (SELECT doc_id AS id, source, title, text AS content, content_type, lang, created_at, repo_id, chunk_index FROM documents WHERE text IS NOT NULL)
"""


def sql(query: str, *ctes: str, recursive: bool = False) -> str:
    """The query with the common table expressions above and further ones before it."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([CTES.strip(), *ctes]) + "\n" + query
