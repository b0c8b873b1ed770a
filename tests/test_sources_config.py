"""Commit source, budgets, search compositions and batch updates."""

import subprocess

import pytest

from graphloom import config
from graphloom.operators import duplicates, search
from graphloom.sources import commits, store
from graphloom.streaming import events
from tests.conftest import rows


def test_commit_source(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for k in range(3):
        git("commit", "-q", "--allow-empty", "-m", f"change {k}")
    got = commits.read_commits(spark, str(tmp_path)).collect()
    assert sorted(r.subject for r in got) == ["change 0", "change 1", "change 2"]
    assert {r.parent_sha for r in got} - {r.commit_sha for r in got} == {None}
    assert commits.read_commits(spark, str(tmp_path), "HEAD~1..HEAD").count() == 1


def test_budgets(spark):
    assert config.resolve("depth", 99).limit == 10 and config.resolve("depth", 99).status == "clamped"
    assert config.resolve("nodes", None).limit == 1000 and config.resolve("nodes", 5).status == "within"
    df, report = config.limited(spark.range(8), config.resolve("nodes", 5))
    assert df.count() == 5 and report.status == "partial"
    with pytest.raises(ValueError):
        config.Capabilities().check("hybrid")
    assert config.accepted(0.7, 0.5, 0.8, 110, 100) and not config.accepted(0.69, 0.5, 0.8, 100, 100)


def test_fallback_search(spark):
    docs = spark.createDataFrame([(1, "alpha ledger"), (2, "preledgers"), (3, "gamma"), (4, None)], "id long, content string")
    assert [r.id for r in search.with_fallback(docs, "id", {"content": 1.0}, "ledger", 5).collect()][0] == 1
    assert {r.id for r in search.with_fallback(docs, "id", {"content": 1.0}, "ledger", 5).collect()} == {1, 2}
    assert [r.id for r in search.with_fallback(docs, "id", {"content": 1.0}, "gamna", 5).collect()] == [3]


def test_expanded_search_and_embedding(spark):
    nodes = spark.createDataFrame([("a::fn::load_cache", "load_cache"), ("a::fn::evict_lease", "evict_lease"), ("a::fn::other", "other")], "qn string, name string")
    edges = spark.createDataFrame([("a::fn::load_cache", "a::fn::evict_lease")], "source string, target string")
    assert {r.qn for r in search.expanded(nodes, edges, "cache", 5).collect()} == {"a::fn::load_cache", "a::fn::evict_lease"}
    texts = spark.createDataFrame([(1, "ab"), (2, None)], "id long, t string")
    assert rows(search.embed(texts, "id", "t", lambda ts: [[float(len(t))] for t in ts])) == [(1, [2.0]), (2, None)]


def test_batches_and_states(spark, tmp_path):
    assert [events.plan_batch(*a) for a in ((0, False), (3, False), (3, True), (5000, False))] == ["idle", "update", "rescan", "rescan"]
    folder = f"file://{tmp_path}/t"
    store.publish(spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int"), folder)
    run = events.apply_batch(lambda: store.current(spark, folder), lambda df: store.publish(df, folder), "path")
    run(spark.createDataFrame([("b", 7), ("c", 8)], "path string, v int"), 0)
    assert rows(store.current(spark, folder)) == [("a", 1), ("b", 7), ("c", 8)]
    states = spark.createDataFrame([("x", 1, "building"), ("x", 2, "built"), ("y", 1, "failed")], "build_id string, seq long, state string")
    assert rows(events.build_state(states)) == [("x", "built", 2), ("y", "failed", 1)]


@pytest.mark.parametrize("seed", range(3))
def test_near_pairs_against_brute_force(spark, seed):
    import random

    rnd = random.Random(seed)
    base = [rnd.sample(range(60), 20) for _ in range(4)]
    sets = {k: sorted({x if rnd.random() > 0.06 else rnd.randint(100, 200) for x in base[k % 4]}) for k in range(24)}
    got = rows(duplicates.near_pairs(spark.createDataFrame([(k, v) for k, v in sets.items()], "id long, items array<long>"), "id", 0.8).select("a", "b"))
    want = [(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.8]
    assert got == sorted(want, key=repr)


def test_near_classes(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"w{k}" for k in range(60))
    data = [(1, text), (2, text), (3, text.replace("w30", "zz")), (4, "other words entirely here now ok"), (5, "")]
    frame = spark.createDataFrame(data, "id long, t string")
    got = rows(duplicates.near_classes(frame, "id", F.filter(F.split("t", " "), lambda x: x != "")).select("id", "class_id", "links"))
    assert got == [(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0), (5, 5, 0)]


def test_near_classes_store_neither_tokens_nor_shingles(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(1)
    base = [[f"w{rnd.randrange(500)}" for _ in range(80)] for _ in range(5)]
    data = []
    for k in range(30):
        own = list(base[k % 5])
        for _ in range(k % 3):
            own[rnd.randrange(80)] = "zz"
        data.append((k, " ".join(own)))
    stored, real = [], duplicates.cut_lineage
    monkeypatch.setattr(duplicates, "cut_lineage", lambda df: stored.append(df.dtypes) or real(df))
    frame = spark.createDataFrame([*data, (30, "a b"), (31, "a b"), (32, "a b c")], "id long, t string").repartition(3)
    got = rows(duplicates.near_classes(frame, "id", F.split("t", " ")).select("id", "class_id", "links"))
    sets = {k: frozenset(tuple(t.split()[i : i + 5]) for i in range(76)) for k, t in data}
    reps = {k: min(x for x in sets if sets[x] == sets[k]) for k in sets}
    links = {k: {r for r in reps.values() if r != reps[k] and len(sets[k] & sets[r]) / len(sets[k] | sets[r]) >= 0.8} for k in sets}
    found = {}
    for k in sets:
        seen, todo = {reps[k]}, [reps[k]]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        found[k] = (k, min(seen), len(links[k]))
    assert got == sorted([*found.values(), (30, 30, 0), (31, 30, 0), (32, 32, 0)], key=repr)
    assert stored and not [kind for of in stored for _, kind in of if kind.startswith("array")]


def test_query_terms_and_modes(spark):
    assert search.query_terms("parseHTTPRequest in load_cache, load") == ["parsehttprequest", "parse", "http", "request", "in", "load", "cache"]
    assert search.relaxed_prefixes("cache of snapshots") == ["ca", "sna"]
    nodes = spark.createDataFrame([("a::fn::load_cache", "load_cache", "function", "pub"), ("a::fn::other", "other", "function", None)], "qn string, name string, kind string, modifiers string")
    edges = spark.createDataFrame([], "source string, target string")
    assert [r.qn for r in search.execute(nodes, edges, "load_cache").collect()] == ["a::fn::load_cache"]
    assert [r.qn for r in search.execute(nodes, edges, "", regex="^oth").collect()] == ["a::fn::other"]
    assert search.execute(nodes, edges, " ").count() == 0
    assert [r.qn for r in search.execute(nodes, edges, "cache", semantic=True).collect()] == ["a::fn::load_cache"]
