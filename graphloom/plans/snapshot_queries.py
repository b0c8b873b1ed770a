"""Queries on snapshots and entity history, with their SQL."""

from __future__ import annotations

from graphloom.operators.history import entity_history
from graphloom.operators.snapshots import snapshot_changes
from graphloom.session import table


def p2_found(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    return snapshot_changes(t("snapshot_membership"), t("graph_snapshots"), t("commits"))


def p3_found(spark, sf_dir):
    return entity_history(table(spark, sf_dir, "symbol_churn")).select("repo_id", "qualified_name", "valid_from", "valid_to")


def p3_versions(spark, sf_dir):
    """The versions with the values that held in them."""
    return entity_history(table(spark, sf_dir, "symbol_churn")).selectExpr(
        "repo_id", "qualified_name", "valid_from", "valid_to", "ver.first_commit", "ver.last_commit", "ver.lifetime_snapshots", "array_join(ver.paths, ',') AS paths"
    )


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_versions": p3_versions}

_HISTORY = """
WITH d AS (
  SELECT * EXCLUDE rn FROM (
    SELECT repo_id, qualified_name, as_of, lower(left(first_commit_sha, 12)) AS a, lower(left(last_commit_sha, 12)) AS b,
      lifetime_snapshots AS c, coalesce(list_sort(list_distinct(current_file_paths)), []) AS p,
      row_number() OVER (PARTITION BY repo_id, qualified_name, as_of ORDER BY ingested_at DESC NULLS LAST) AS rn
    FROM symbol_churn) WHERE rn = 1),
r AS (
  SELECT repo_id, as_of, row_number() OVER (PARTITION BY repo_id ORDER BY as_of) AS pos,
    lead(as_of) OVER (PARTITION BY repo_id ORDER BY as_of) AS nxt
  FROM (SELECT DISTINCT repo_id, as_of FROM symbol_churn)),
x AS (SELECT d.*, r.pos, r.nxt FROM d JOIN r USING (repo_id, as_of)),
y AS (
  SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(a) OVER w IS NOT DISTINCT FROM a AND lag(b) OVER w IS NOT DISTINCT FROM b
    AND lag(c) OVER w IS NOT DISTINCT FROM c AND lag(p) OVER w IS NOT DISTINCT FROM p THEN 0 ELSE 1 END AS st
  FROM x WINDOW w AS (PARTITION BY repo_id, qualified_name ORDER BY pos)),
z AS (SELECT *, sum(st) OVER (PARTITION BY repo_id, qualified_name ORDER BY pos) AS run FROM y)
"""

ORACLE = {
    "p2_found": """
WITH s AS (
  SELECT repo_id, snapshot_id, min(commit_sha) AS commit_sha FROM graph_snapshots WHERE completeness = 1.0 GROUP BY 1, 2),
c AS (SELECT repo_id, commit_sha, min(author_time) AS author_time FROM commits GROUP BY 1, 2),
o AS (
  SELECT repo_id, snapshot_id, row_number() OVER (PARTITION BY repo_id ORDER BY author_time, snapshot_id) AS pos
  FROM s JOIN c USING (repo_id, commit_sha)),
m AS (
  SELECT repo_id, snapshot_id, regexp_replace(file_path, '^(\\./)+', '') AS file_path, lower(file_hash) AS fh,
    coalesce(list_sort(list_distinct(qualified_names)), []) AS q,
    coalesce(list_sort(list_distinct(edge_keys)), []) AS e, ingested_at
  FROM snapshot_membership),
l AS (
  SELECT * EXCLUDE rn FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, snapshot_id, file_path ORDER BY ingested_at DESC NULLS LAST) AS rn FROM m)
  WHERE rn = 1),
x AS (SELECT l.*, o.pos FROM l JOIN o USING (repo_id, snapshot_id))
SELECT repo_id, snapshot_id, file_path, change FROM (
  SELECT n.repo_id, n.snapshot_id, n.file_path,
    CASE WHEN p.file_path IS NULL THEN 'added' ELSE 'changed' END AS change
  FROM x n LEFT JOIN x p ON p.repo_id = n.repo_id AND p.pos = n.pos - 1 AND p.file_path = n.file_path
  WHERE n.pos > 1 AND (p.file_path IS NULL OR n.q <> p.q OR n.e <> p.e OR n.fh <> p.fh)
  UNION ALL
  SELECT p.repo_id, o.snapshot_id, p.file_path, 'removed' AS change
  FROM x p JOIN o ON o.repo_id = p.repo_id AND o.pos = p.pos + 1
  LEFT JOIN x n ON n.repo_id = p.repo_id AND n.pos = p.pos + 1 AND n.file_path = p.file_path
  WHERE n.file_path IS NULL)
""",
    "p3_found": _HISTORY
    + """
SELECT repo_id, qualified_name, min(as_of) AS valid_from, coalesce(arg_max(coalesce(nxt, 253402300799), pos), 253402300799) AS valid_to
FROM z GROUP BY repo_id, qualified_name, run
""",
    "p3_versions": _HISTORY
    + """
SELECT repo_id, qualified_name, min(as_of) AS valid_from, coalesce(arg_max(coalesce(nxt, 253402300799), pos), 253402300799) AS valid_to,
  any_value(a) AS first_commit, any_value(b) AS last_commit, any_value(c) AS lifetime_snapshots, array_to_string(any_value(p), ',') AS paths
FROM z GROUP BY repo_id, qualified_name, run
""",
}
