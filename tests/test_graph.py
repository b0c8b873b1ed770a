"""Graph operators on hand-made graphs and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import joins, metrics, scan, traverse
from tests.conftest import rows

NODE = "repo_id long, qn string, name string, kind string, file_path string, hash string, language string, line_start int, line_end int, modifiers string, params string, return_type string, is_test boolean"
EDGE = "repo_id long, source string, target string, kind string, file_path string, confidence double, tier string"


def node(qn, kind="function", path="m/a.rs", modifiers=None, test=False, params=None):
    return (1, qn, qn, kind, path, "h", "rust", 1, 10, modifiers, params, None, test)


def edge(a, b, kind="calls", confidence=1.0, tier="high", path="m/a.rs"):
    return (1, a, b, kind, path, confidence, tier)


@pytest.fixture(scope="module")
def make(spark):
    return lambda n, e: (spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE))


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "qn string")


def test_one_hop_cycle_and_depth(spark, make):
    _, e = make([], [edge("a", "b"), edge("b", "c"), edge("c", "a"), edge("x", "y"), edge("c", "d")])
    assert rows(traverse.impact_radius(seeds(spark, "a"), e, 1)) == [("a", 0), ("b", 1), ("c", 1)]
    assert rows(traverse.bfs(seeds(spark, "a"), e.select(F.col("source").alias("src"), F.col("target").alias("dst")), 10)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(traverse.impact_radius(seeds(spark, "x"), e, 5)) == [("x", 0), ("y", 1)]


def test_empty_inputs(spark, make):
    n, e = make([], [])
    assert rows(traverse.impact_radius(seeds(spark), e, 3)) == []
    assert rows(traverse.components(e)) == [] and rows(traverse.strong_components(e)) == []
    assert rows(joins.dead_code(n, e)) == [] and rows(joins.dangling(n, e)) == [] and rows(metrics.node_metrics(n, e)) == []


def test_first_cause_prefers_confidence(spark, make):
    _, e = make([], [edge("u", "t", "references", 0.4), edge("u", "t", "calls", 0.9), edge("v", "u", "contains", 1.0)])
    assert rows(traverse.first_cause(seeds(spark, "t"), e, 5)) == [("t", 0, None), ("u", 1, "calls"), ("v", 2, "contains")]


@pytest.mark.parametrize("seed", range(3))
def test_components_and_cycles_against_brute_force(spark, make, seed):
    rnd = random.Random(seed)
    pairs = {(f"n{rnd.randint(0, 24)}", f"n{rnd.randint(0, 24)}") for _ in range(22)}
    _, e = make([], [edge(a, b) for a, b in pairs])
    names = {x for p in pairs for x in p}

    def reach(start, step):
        seen, todo = set(), [start]
        while todo:
            for y in step.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    both, out = {}, {}
    for a, b in pairs:
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
        out.setdefault(a, set()).add(b)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert rows(traverse.components(e)) == sorted(((x, min(reach(x, both) | {x})) for x in linked), key=repr)
    mutual = {x: {y for y in reach(x, out) if x in reach(y, out)} for x in names if x in reach(x, out)}
    assert rows(traverse.strong_components(e)) == sorted(((x, min(s), len(s)) for x, s in mutual.items()), key=repr)


def test_star_and_long_chain_are_one_component(spark, make):
    _, e = make([], [edge("hub", f"s{k:03d}") for k in range(200)] + [edge(f"c{k:03d}", f"c{k + 1:03d}") for k in range(60)])
    got = dict(rows(traverse.components(e)))
    assert {got[f"s{k:03d}"] for k in range(200)} == {"hub"} and {got[f"c{k:03d}"] for k in range(61)} == {"c000"}


def test_paths(spark, make):
    _, e = make([], [edge("a", "b"), edge("b", "c"), edge("c", "d"), edge("a", "d"), edge("d", "d")])
    assert rows(traverse.longest_depths(e)) == [("a", 3), ("b", 2), ("c", 1), ("d", 0)]
    assert rows(traverse.call_chains(e, 3).select(F.array_join("path", "").alias("p"))) == [("abc",), ("bcd",)]
    chain = spark.createDataFrame([("v1", "v2"), ("v2", "v3"), ("w1", "w2")], "old_path string, path string")
    assert rows(traverse.rename_chain(chain)) == [("v2", "v1", 1), ("v3", "v1", 2), ("w2", "w1", 1)]
    _, loop = make([], [edge("p", "q"), edge("q", "p"), edge("q", "r"), edge("r", "p")])
    assert rows(traverse.shortest_cycles(loop, 3)) == [("p", 2, "p > q"), ("q", 2, "q > p"), ("r", 3, "r > p > q")]


def test_propagation_takes_the_best_path(spark, make):
    _, e = make([], [edge("a", "b", "calls", 1.0), edge("b", "c", "contains", 0.5)])
    start = spark.createDataFrame([("a", 1.0)], "qn string, score double")
    assert rows(traverse.propagate(start, e)) == [("a", 1.0), ("b", 0.75), ("c", 0.09375)]


def test_joins_on_a_small_graph(make):
    n, e = make(
        [node("f"), node("g"), node("t", test=True, path="m/t.rs"), node("p", modifiers="pub", path="k/p.rs"), node("lone", path="k/p.rs")],
        [edge("f", "g", confidence=0.4, tier="low"), edge("t", "f"), edge("f", "p", "imports"), edge("g", "gone")],
    )
    assert rows(joins.direct_callers(n, e, 5).select("seed", "qn", "rank")) == [("f", "t", 1), ("g", "f", 1), ("gone", "g", 1)]
    assert rows(joins.dangling(n, e).select("target", "side")) == [("gone", "target")]
    assert rows(joins.orphans(n, e).select("qn")) == [("lone",)]
    assert rows(joins.dead_code(n, e).select("qn")) == [("lone",)]
    assert rows(joins.either_way(n, e, ["imports"]).select("seed", "qn", "direction")) == [("f", "p", "out"), ("p", "f", "in")]
    changed = n.filter("qn = 'p'").select(F.col("file_path").alias("path"))
    assert rows(joins.dependents(n, e, changed)) == [("m/a.rs",)]
    assert {r.qn: r.coverage for r in metrics.coverage(n, e).collect()} == {"f": "direct", "g": "through_callers", "p": "none", "lone": "none"}
    risk = {r.qn: r.points for r in metrics.change_risk(n, e).collect()}
    assert risk["p"] == 3 + 2 + 2 and risk["lone"] == 2
    kept = {r.qn: (r.fan_in, r.fan_out, r.tests) for r in metrics.node_metrics(n, e).collect()}
    assert kept["f"] == (1, 2, 1) and kept["lone"] == (0, 0, 0)


def test_call_resolution_needs_a_single_candidate(make):
    n, e = make(
        [node("m/a.rs::fn::f", path="m/a.rs"), node("m/b.rs::fn::h", path="m/b.rs"), node("k/c.rs::fn::h", path="k/c.rs"), node("k/c.rs::fn::w", path="k/c.rs")],
        [edge("m/a.rs::fn::f", "?::fn::h"), edge("m/a.rs::fn::f", "k/c.rs::fn::w", "imports")],
    )
    n = n.withColumn("name", F.element_at(F.split("qn", "::"), -1))
    assert rows(joins.resolve_calls(e, n)) == [("m/a.rs::fn::f", "?::fn::h", "k/c.rs::fn::h", 0.75)]


def test_predicates(spark):
    frame = spark.createDataFrame([("./a//b/../c.rs", None), ("a\\b", "PUB(crate)"), ("x/y", "private"), (None, "export")], "p string, m string")
    assert [r[0] for r in frame.select(scan.canonicalise(F.col("p"))).collect()] == ["a/c.rs", "a/b", "x/y", None]
    assert [r[0] for r in frame.select(scan.noncanonical("p")).collect()] == [True, True, False, None]
    assert [r[0] for r in frame.select(scan.is_public(F.col("m"))).collect()] == [False, True, False, True]
    assert frame.filter(scan.regex_match("(?i)^A", "p", "m")).count() == 1
    assert rows(scan.composed(spark.createDataFrame([("e\u0301/x",), ("a",), (None,)], "p string"), "p")) == sorted([("\u00e9/x",), ("a",), (None,)], key=repr)
    for bad in ("", r"(a)\1"):
        with pytest.raises(ValueError):
            scan.regex_match(bad, "p")
    assert frame.filter(scan.ignored(F.col("p"), ["x", "*.rs"])).count() == 2


def test_percentiles(spark):
    frame = spark.createDataFrame([("k", v) for v in (1, 2, 3, 4, 100)], "g string, v long")
    d = metrics.distribution(frame, "v", ["g"]).first()
    assert (d.least, d.greatest, d.p50, d.p90) == (1, 100, 3.0, 61.6)
    assert rows(metrics.nearest_rank(frame, "v", ["g"], 0.9)) == [("k", 100)]
    assert rows(metrics.nearest_rank(frame, "v", ["g"], 0.5)) == [("k", 3)]
    assert rows(metrics.outliers(frame, "v", ["g"], 50, 0.5).select("v")) == [(100,)]


def test_long_cycles_and_rename_chains(spark):
    ring = spark.createDataFrame([(f"m{k:03}", f"m{(k + 1) % 150:03}") for k in range(150)], "source string, target string")
    assert rows(traverse.strong_components(ring)) == [(f"m{k:03}", "m000", 150) for k in range(150)]
    chain = spark.createDataFrame([(f"v{k}", f"v{k + 1}") for k in range(40)], "old_path string, path string")
    assert rows(traverse.rename_chain(chain)) == sorted(((f"v{k}", "v0", k) for k in range(1, 41)), key=repr)
    with pytest.raises(ValueError):
        traverse.rename_chain(spark.createDataFrame([("a", "b"), ("b", "a")], "old_path string, path string"))


def test_long_cycles_chains_and_paths(spark):
    ring = [(f"r{k:03}", f"r{(k + 1) % 140:03}") for k in range(140)]
    chain = [(f"c{k:02}", f"c{k + 1:02}") for k in range(30)]
    more = [("c30", "r000"), ("x", "y"), ("y", "x"), ("y", "z"), ("z", "x"), ("s", "s"), ("r005", "c99")]
    e = spark.createDataFrame(ring + chain + more, "source string, target string")
    found = {r.qn: (r.component, r.size) for r in traverse.strong_components(e).collect()}
    assert found["r007"] == ("r000", 140) and found["z"] == ("x", 3) and found["s"] == ("s", 1) and "c00" not in found
    depth = {r.qn: r.depth for r in traverse.longest_depths(e).collect()}
    assert depth["c00"] == 32 and depth["c30"] == 2 and depth["r000"] == 1 and depth["c99"] == 0 and depth["x"] == 0
    assert {r.qn: r.depth for r in traverse.longest_depths(e, 5).collect()}["c00"] == 5
    small = spark.createDataFrame([(f"r{k:02}", f"r{(k + 1) % 14:02}") for k in range(14)] + more, "source string, target string")
    cycles = {r.component: (r.size, r.cycle) for r in traverse.cycle_paths(small).collect()}
    assert cycles["x"] == (2, "x > y") and cycles["r00"][0] == 14 and set(cycles) == {"x", "r00"}
    path = {r.qn: r.path for r in traverse.longest_paths(spark.createDataFrame(chain + [("c03", "c05"), ("b", "c29")], "source string, target string")).collect()}
    assert path["c00"] == [f"c{k:02}" for k in range(31)] and path["b"] == ["b", "c29", "c30"] and path["c30"] == ["c30"]
    assert traverse.cycle_paths(e.limit(0)).count() == 0 and traverse.longest_depths(e.limit(0)).count() == 0


def test_names_are_taken_literally(spark):
    from graphloom.operators import context

    t = spark.createDataFrame([(1, "a.b(c) $x\naXb(c)\n\\Ea.b(c)")], "id long, text string")
    got = {r.line: r.after for r in context.rename_edits(t, "id", "text", "a.b(c)", "n$1\\").collect()}
    assert got[1] == "n$1\\ $x" and 2 not in got


def test_scores_of_the_published_formulas(spark):
    from graphloom.operators import metrics

    nodes = spark.createDataFrame(
        [(1, q, q, "function", f, m, t, 1, n) for q, f, m, t, n in [("a", "m1/x", "pub", False, 40), ("b", "m1/x", None, False, 10), ("c", "m2/y", None, False, 10), ("t", "m2/t", None, True, 5)]],
        "repo_id long, qn string, name string, kind string, file_path string, modifiers string, is_test boolean, line_start int, line_end int",
    )
    edges = spark.createDataFrame([("b", "a", "calls", 0.9, "high"), ("c", "a", "calls", 0.9, "high"), ("t", "a", "calls", 0.4, "low"), ("a", "c", "calls", 0.9, "high")], "source string, target string, kind string, confidence double, tier string")
    safe = {r.qn: r.score for r in metrics.safety(nodes, edges).collect()}
    # a: public 0.25, three callers 0.12, two of them from other files 0.10, one test, one low edge 0.03
    assert safe["a"] == 0.5 and safe["b"] == 0.85
    f = {(r.qn, r.factor): (r.normalized, r.weight) for r in metrics.risk_factors(nodes, edges).collect()}
    assert f["a", "tests"] == (pytest.approx(1 / 3), -1.0) and f["a", "large"] == (0.5, 0.5) and f["a", "cycle"] == (1.0, 1.0) and f["a", "cross_module"][0] == pytest.approx(1 / 15)
    want = (1.5 + 3 / 20 * 1.25 + 1 / 10 * 0.75 + 1 / 15 + 1.0 * 0.75 + 1 / 3 * 1.25 + 0.5 * 1.25 + 1.0 - 1 / 3) / 11.5 * 100
    assert {r.qn: r.score for r in metrics.weighted_risk(metrics.risk_factors(nodes, edges)).collect()}["a"] == pytest.approx(want, abs=1e-3)
