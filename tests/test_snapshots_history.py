"""Snapshot differences and entity history against hand-made cases and brute force."""

import random
from datetime import datetime, timedelta

import pytest

from graphloom.operators import history, snapshots
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
MEMBER = (
    "snapshot_id long, repo_id long, file_path string, file_hash string, qualified_names array<string>, "
    "edge_keys array<struct<source_qn string, target_qn string, kind string>>, ingested_at timestamp_ntz, path string, change string"
)
SNAP = "snapshot_id long, repo_id long, commit_sha string, completeness double"
COMMIT = "commit_sha string, repo_id long, author_time long"
CHURN = (
    "repo_id long, qualified_name string, as_of long, first_commit_sha string, last_commit_sha string, lifetime_snapshots long, "
    "current_file_paths array<string>, ingested_at timestamp_ntz, pos long, block long"
)


def tables(spark, member, snaps, commits):
    return spark.createDataFrame(member, MEMBER), spark.createDataFrame(snaps, SNAP), spark.createDataFrame(commits, COMMIT)


def at(n):
    return T0 + timedelta(hours=n)


def test_changes_of_every_kind(spark):
    member = [
        (9, 1, "./a.py", "AA", ["x", "y", "x"], None, at(0), "clash", "clash"),
        (9, 1, "b.py", "bb", None, [], at(0), None, None),
        (9, 1, "gone.py", None, [], None, at(0), None, None),
        (3, 1, "a.py", "aa", ["y", "x"], [], at(1), None, None),  # equal: sets, case and ./ don't count
        (3, 1, "b.py", "old", ["q"], None, at(1), None, None),  # superseded
        (3, 1, "b.py", "bc", [], None, at(2), None, None),  # hash differs
        (3, 1, "new.py", None, None, None, at(1), None, None),
        (5, 1, None, "zz", None, None, at(1), None, None),
    ]
    snaps = [(9, 1, "c1", 1.0), (3, 1, "c2", 1.0), (3, 1, "c2", 1.0), (5, 1, "c3", 1.0), (4, 1, "c4", 0.5), (8, 2, "c1", 1.0)]
    commits = [("c1", 1, 10), ("c2", 1, 20), ("c2", 1, 20), ("c3", 1, 30), ("c4", 1, 15), ("c1", 2, 1)]
    got = rows(snapshots.snapshot_changes(*tables(spark, member, snaps, commits), bucket_rows=2))
    assert got == sorted(
        [
            (1, 3, "b.py", "changed"),
            (1, 3, "gone.py", "removed"),
            (1, 3, "new.py", "added"),
            (1, 5, "a.py", "removed"),
            (1, 5, "b.py", "removed"),
            (1, 5, "new.py", "removed"),
        ],
        key=repr,
    )


def test_null_hash_equals_every_other(spark):
    member = [(1, 1, "a", None, None, None, at(0), None, None), (2, 1, "a", "h", None, None, at(0), None, None)]
    got = rows(snapshots.snapshot_changes(*tables(spark, member, [(1, 1, "a", 1.0), (2, 1, "b", 1.0)], [("a", 1, 1), ("b", 1, 2)])))
    assert got == []


def test_empty_tables(spark):
    assert rows(snapshots.snapshot_changes(*tables(spark, [], [], []))) == []
    assert rows(history.entity_history(spark.createDataFrame([], CHURN))) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    member, listing = [], {}
    for snap in range(6):
        for k in range(rnd.randint(0, 9)):
            value = rnd.choice("pqr")
            path = f"f{rnd.randint(0, 9)}"
            member.append((snap, 1, path, value, None, None, at(len(member)), None, None))
            listing.setdefault(snap, {})[path] = value
    rnd.shuffle(member)
    want = []
    for snap in range(1, 6):
        a, b = listing.get(snap - 1, {}), listing.get(snap, {})
        want += [(1, snap, p, "added") for p in b.keys() - a.keys()] + [(1, snap, p, "removed") for p in a.keys() - b.keys()]
        want += [(1, snap, p, "changed") for p in a.keys() & b.keys() if a[p] != b[p]]
    frames = tables(spark, member, [(s, 1, f"c{s}", 1.0) for s in range(6)], [(f"c{s}", 1, s) for s in range(6)])
    assert rows(snapshots.snapshot_changes(*frames, bucket_rows=3)) == sorted(want, key=repr)


def churn_row(name, as_of, first="a" * 40, life=1, paths=("p",), late=0, repo=1):
    return (repo, name, as_of, first, None, life, list(paths) if paths is not None else None, datetime(1970, 1, 1) + timedelta(seconds=as_of + 60 + late), None, None)


def brute_history(data):
    last = {}
    for r in sorted(data, key=lambda r: r[7]):
        key = (r[0], r[1], r[2])
        last[key] = (r[3] and r[3][:12].lower(), r[4] and r[4][:12].lower(), r[5], tuple(sorted(set(r[6] or ()))))
    out = []
    for repo, name in {(k[0], k[1]) for k in last}:
        reports = sorted({r[2] for r in data if r[0] == repo})
        start, current = None, None
        for k in [*reports, None]:
            value = last.get((repo, name, k)) if k is not None else None
            if current is not None and value != current:
                out.append((repo, name, start, k if k is not None else history.OPEN_END))
                current = None
            if value is not None and current is None:
                start, current = k, value
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_history_against_brute_force_with_late_rows(spark, seed):
    rnd = random.Random(seed)
    data, n = [], 0
    for repo in (1, 2):
        for report in range(1, 13):
            for name in "uvw":
                if rnd.random() < 0.75:
                    for _ in range(rnd.choice([1, 1, 1, 2])):
                        n += 1
                        late = n if rnd.random() < 0.7 else 5 * 86400 + n
                        data.append(churn_row(name, report * 100_000, rnd.choice(["A" * 40, "a" * 12, "b" * 40, None]), rnd.randint(1, 2), rnd.choice([["p", "q"], ["q", "p", "p"], None]), late, repo))
    rnd.shuffle(data)
    frame = spark.createDataFrame(data, CHURN)
    got = history.entity_history(frame).select("repo_id", "qualified_name", "valid_from", "valid_to")
    assert rows(got) == brute_history(data)


def test_long_runs_cross_blocks(spark):
    frame = spark.createDataFrame([churn_row("s", k) for k in range(1, 40)] + [churn_row("t", k) for k in range(1, 40) if k != 20], CHURN)
    got = history.build_chains(history.raw_versions(frame), history.report_calendar(frame), block_reports=8).select("qualified_name", "valid_from", "valid_to")
    assert rows(got) == [("s", 1, history.OPEN_END), ("t", 1, 20), ("t", 21, history.OPEN_END)]


def test_publish_replaces_whole_history(spark, tmp_path):
    one = history.entity_history(spark.createDataFrame([churn_row("s", 1)], CHURN))
    two = history.entity_history(spark.createDataFrame([churn_row("s", 1), churn_row("t", 1)], CHURN))
    folder = f"file://{tmp_path}/history"
    history.publish_history(one, folder)
    assert history.read_history(spark, folder).count() == 1
    history.publish_history(two, folder)
    assert history.read_history(spark, folder).count() == 2


def test_update_replaces_only_touched_chains(spark, tmp_path):
    folder = f"file://{tmp_path}/chains"
    day = 86400
    first = [churn_row(name, k * day, life=k // 2) for name in ("s", "t", "u") for k in range(1, 6)]
    late = [churn_row("s", 3 * day, life=9, late=9 * day), churn_row("v", 2 * day, late=9 * day)]
    base = spark.createDataFrame(first, CHURN)
    history.publish_chains(history.build_chains(history.raw_versions(base), history.report_calendar(base)), folder, buckets=64)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "chains").rglob("*.parquet")}
    before, reader = files(), history.read_chains(spark, folder)
    both = spark.createDataFrame(first + late, CHURN)
    written = history.update_chains(both, spark.createDataFrame(late, CHURN), history.report_calendar(base), folder)
    assert written <= 2 and all(files()[p] == t for p, t in before.items())  # old files stay for readers that began before
    flat = ["repo_id", "qualified_name", "valid_from", "valid_to", "ver"]
    assert rows(history.read_chains(spark, folder).select(flat)) == rows(history.entity_history(both).select(flat))
    assert reader.count() == 9
    gone = spark.createDataFrame([(1, "t")], "repo_id long, qualified_name string")
    assert history.replace_chains(gone, history.read_chains(spark, folder).limit(0), folder) == 1
    assert {r[0] for r in history.read_chains(spark, folder).select("qualified_name").collect()} == {"s", "u", "v"}


def test_versions_keep_their_values(spark):
    frame = spark.createDataFrame([churn_row("s", 1, "A" * 40, 1, ["q", "p"]), churn_row("s", 2, "a" * 12, 1, ["p", "q", None]), churn_row("s", 3, None, None, None)], CHURN)
    got = history.entity_history(frame).selectExpr("valid_from", "valid_to", "ver.first_commit", "ver.lifetime_snapshots", "ver.paths")
    assert rows(got) == [(1, 3, "a" * 12, 1, ["p", "q"]), (3, history.OPEN_END, None, None, [])]
