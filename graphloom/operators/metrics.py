"""Aggregations and scores over nodes, edges, files and modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.traverse import longest_depths, strong_components
from graphloom.schema import REFERENCE_KINDS

#: Thresholds of findings, and weights of the factors of risk. Fixed values.
THRESHOLDS = {"loc": 80, "fan_in": 20, "fan_out": 10, "coupling": 15, "depth": 6, "cyclomatic": 15, "cognitive": 20, "nesting": 4}
RISK_WEIGHTS = {
    "public_api": 1.5, "fan_in": 1.25, "fan_out": 0.75, "cross_module": 1.0, "depth": 0.75, "unresolved": 1.25, "large": 0.5, "loc": 0.75,
    "cyclomatic": 1.0, "cognitive": 1.0, "nesting": 0.75, "cycle": 1.0,
}
#: Weight by which tests lessen the risk, and how much each way of being tested counts. Fixed values.
TEST_WEIGHT, TEST_SHARE = 1.0, {"direct": 1.0, "through_callers": 0.75, "same_file": 0.5, "none": 0.0}
RISK_BANDS = (35.0, 70.0)


def folder(column: str) -> Column:
    return F.regexp_extract(column, r"^(.*)/[^/]*$", 1)


def degrees(edges: DataFrame) -> DataFrame:
    """qn, fan_in, fan_out over reference edges: one pass that counts both ends of every edge, combined before the shuffle."""
    used = edges.filter(F.col("kind").isin(*REFERENCE_KINDS))
    ends = used.select(F.explode(F.array(F.struct(F.col("source").alias("qn"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("qn"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    return ends.groupBy("qn").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with its degrees, lines, module and the number of tests that call it."""
    tests = edges.join(nodes.filter("is_test").select(F.col("qn").alias("source")), "source", "left_semi").groupBy(F.col("target").alias("qn")).agg(F.count_distinct("source").alias("tests"))
    return (
        nodes.join(degrees(edges), "qn", "left")
        .join(tests, "qn", "left")
        .select(
            "repo_id",
            "qn",
            "name",
            "kind",
            "file_path",
            "modifiers",
            "is_test",
            folder("file_path").alias("module"),
            *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fan_in", "fan_out", "tests")),
            F.when(F.col("kind").isin("function", "method"), F.col("line_end") - F.col("line_start") + 1).otherwise(0).cast("long").alias("loc"),
        )
    )


def file_metrics(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file: nodes, average degrees, share of tests (null without callables), edges and imports that leave it."""
    own = edges.groupBy("file_path").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("kind") == "imports").alias("imports"))
    calls = F.count_if(F.col("kind").isin("function", "method"))
    per = metrics.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.round(F.avg("fan_in"), 6).alias("avg_fan_in"),
        F.round(F.avg("fan_out"), 6).alias("avg_fan_out"),
        F.round(F.try_divide(F.count_if("is_test"), calls), 6).alias("test_share"),
    )
    return per.join(own, "file_path", "left").fillna(0, ["edges", "imports"])


def located(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the modules of both ends."""
    m = nodes.select("qn", folder("file_path").alias("m"))
    return edges.join(m.select(F.col("qn").alias("source"), F.col("m").alias("source_module")), "source").join(m.select(F.col("qn").alias("target"), F.col("m").alias("target_module")), "target")


def module_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependencies between different modules, counted, with the kinds that make them."""
    return (
        located(nodes, edges)
        .filter("source_module <> target_module")
        .groupBy("source_module", "target_module")
        .agg(F.count(F.lit(1)).alias("edges"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    )


def module_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per module: nodes, internal, outgoing and incoming edges, cohesion min(1, internal/(n(n-1))) and coupling out + in."""
    at = located(nodes, edges)
    inner = F.col("source_module") == F.col("target_module")
    sides = F.array(
        F.struct(F.col("source_module").alias("module"), inner.cast("int").alias("i"), (~inner).cast("int").alias("o"), F.lit(0).alias("n")),
        F.struct(F.col("target_module").alias("module"), F.lit(0).alias("i"), F.lit(0).alias("o"), (~inner).cast("int").alias("n")),
    )
    counts = at.select(F.explode(sides).alias("s")).select("s.*").groupBy("module").agg(F.sum("i").alias("internal"), F.sum("o").alias("outbound"), F.sum("n").alias("inbound"))
    size = nodes.groupBy(folder("file_path").alias("module")).agg(F.count(F.lit(1)).alias("nodes"))
    full = size.join(counts, "module", "left").fillna(0)
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return full.select(
        "module",
        "nodes",
        "internal",
        "outbound",
        "inbound",
        F.when(pairs > 0, F.least(F.lit(1.0), F.round(F.col("internal") / pairs, 6))).otherwise(0.0).alias("cohesion"),
        (F.col("outbound") + F.col("inbound")).alias("coupling"),
    )


def module_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    pairs = located(nodes, edges).filter("source_module <> target_module").select("source_module", "target_module").distinct()
    return pairs.select(F.explode(F.array("source_module", "target_module")).alias("module")).groupBy("module").agg(F.count(F.lit(1)).alias("degree"))


def distribution(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Least, greatest, mean and linearly interpolated percentiles of a column."""
    p = lambda q: F.round(F.percentile(column, F.lit(q)), 6)
    return values.groupBy(*by).agg(
        F.min(column).alias("least"), F.max(column).alias("greatest"), F.round(F.avg(column), 6).alias("mean"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95")
    )


def outliers(values: DataFrame, column: str, by: list[str], threshold: float, percentile: float = 0.95) -> DataFrame:
    """Rows above the larger of the threshold and the percentile of their group."""
    cut = values.groupBy(*by).agg(F.greatest(F.lit(float(threshold)), F.percentile(column, F.lit(percentile))).alias("cutoff"))
    return values.join(cut, by).filter(F.col(column) > F.col("cutoff"))


def nearest_rank(values: DataFrame, column: str, by: list[str], p: float) -> DataFrame:
    """Nearest-rank percentile: the value at place round(p (n - 1)), found over counts of equal values, not sorted rows."""
    from pyspark.sql import Window

    counts = values.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by).orderBy(column)
    every = Window.partitionBy(*by)
    placed = counts.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(every))
    return placed.filter(F.col("upto") > F.round((F.col("total") - 1) * p)).groupBy(*by).agg(F.min(column).alias("value"))


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How each callable is tested: direct, through callers, in the same file, or none."""
    called = edges.filter(F.col("kind") == "calls")
    tests = nodes.filter("is_test")
    direct = called.join(tests.select(F.col("qn").alias("source")), "source", "left_semi").select(F.col("target").alias("qn"), F.lit(3).alias("level"))
    through = called.join(direct.select(F.col("qn").alias("source")).distinct(), "source", "left_semi").select(F.col("target").alias("qn"), F.lit(2).alias("level"))
    mine = nodes.filter(F.col("kind").isin("function", "method") & ~F.col("is_test")).select("qn", "file_path")
    beside = mine.join(tests.select("file_path").distinct(), "file_path", "left_semi").select("qn", F.lit(1).alias("level"))
    best = direct.unionByName(through).unionByName(beside).groupBy("qn").agg(F.max("level").alias("level"))
    level = F.coalesce("level", F.lit(0))
    return mine.join(best, "qn", "left").select("qn", F.when(level == 3, "direct").when(level == 2, "through_callers").when(level == 1, "same_file").otherwise("none").alias("coverage"))


def crossings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of each symbol that cross a module boundary."""
    return (
        located(nodes, edges)
        .filter("source_module <> target_module")
        .select(F.explode(F.array("source", "target")).alias("qn"))
        .groupBy("qn")
        .agg(F.count(F.lit(1)).alias("crossings"))
    )


def unresolved(edges: DataFrame) -> DataFrame:
    """Low-confidence edges at each symbol."""
    low = edges.filter((F.col("tier") == "low") | (F.col("confidence") < 0.5))
    return low.select(F.explode(F.array("source", "target")).alias("qn")).groupBy("qn").agg(F.count(F.lit(1)).alias("unresolved"))


def outside_callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges into each symbol from symbols of other files."""
    at = nodes.select("qn", "file_path")
    return (
        edges.select("source", "target")
        .join(at.select(F.col("qn").alias("source"), F.col("file_path").alias("from_file")), "source")
        .join(at.select(F.col("qn").alias("target"), F.col("file_path").alias("to_file")), "target")
        .filter("from_file <> to_file")
        .groupBy(F.col("target").alias("qn"))
        .agg(F.count(F.lit(1)).alias("outside"))
    )


def neighbour_modules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many other modules the neighbours of each symbol, in either direction, are in."""
    at = located(nodes, edges).filter("source_module <> target_module")
    ends = F.array(F.struct(F.col("source").alias("qn"), F.col("target_module").alias("module")), F.struct(F.col("target").alias("qn"), F.col("source_module").alias("module")))
    return at.select(F.explode(ends).alias("e")).select("e.*").distinct().groupBy("qn").agg(F.count(F.lit(1)).alias("modules"))


def safety(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Safety of changing a symbol: 1 less a penalty for each risk, and its band (safe from 0.7, caution from 0.4, risky).

    Only callers from other files count as users across modules.
    """
    m = node_metrics(nodes, edges).join(unresolved(edges), "qn", "left").join(outside_callers(nodes, edges), "qn", "left").fillna(0, ["unresolved", "outside"])
    public = F.coalesce(F.col("modifiers").rlike("pub|export"), F.lit(False))
    loss = (
        F.when(public, 0.25).otherwise(0.0)
        + F.least(F.col("fan_in") * 0.04, F.lit(0.3))
        + F.least(F.col("outside") * 0.05, F.lit(0.25))
        + F.when(F.col("fan_out") > 10, 0.1).otherwise(0.0)
        + F.when(F.col("tests") == 0, 0.15).when(F.col("tests") >= 3, -0.05).otherwise(0.0)
        + F.least(F.col("unresolved") * 0.03, F.lit(0.2))
    )
    score = F.round(F.least(F.greatest(1.0 - loss, F.lit(0.0)), F.lit(1.0)), 6)
    return m.select("qn", score.alias("score"), F.when(score >= 0.7, "safe").when(score >= 0.4, "caution").otherwise("risky").alias("band"))


def change_risk(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Points for what makes a change risky: public 3, untested 2, over modules 2, many callers 1 or 2, unresolved 1; high from 8, medium from 5, low from 2."""
    m = node_metrics(nodes, edges).join(unresolved(edges), "qn", "left").join(crossings(nodes, edges), "qn", "left").fillna(0, ["unresolved", "crossings"])
    public = F.coalesce(F.col("modifiers").rlike("pub|export"), F.lit(False))
    points = (
        F.when(public, 3).otherwise(0)
        + F.when(F.col("tests") == 0, 2).otherwise(0)
        + F.when(F.col("crossings") > 0, 2).otherwise(0)
        + F.when(F.col("fan_in") > 10, 2).when(F.col("fan_in") > 3, 1).otherwise(0)
        + F.when(F.col("unresolved") > 0, 1).otherwise(0)
    )
    return m.select("qn", points.cast("long").alias("points"), F.when(points >= 8, "critical").when(points >= 5, "high").when(points >= 2, "medium").otherwise("low").alias("risk"))


def risk_factors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Long form of the risk of each symbol: qn, factor, normalized (0 to 1), weight (negative for tests, which lessen it).

    The depth counts steps of references away from the symbol, up to the threshold, beyond which it makes no difference. A
    symbol takes part in a cycle if its module does. Complexities are taken from the columns cyclomatic, cognitive and nesting
    of nodes where there are such; their weights count in the total all the same.
    """
    used = edges.filter(F.col("kind").isin(*REFERENCE_KINDS))
    depths = longest_depths(used, THRESHOLDS["depth"])
    cycles = strong_components(module_edges(nodes, edges).select(F.col("source_module").alias("source"), F.col("target_module").alias("target"))).select(F.col("qn").alias("module"), F.lit(True).alias("cyclic"))
    known = [c for c in ("cyclomatic", "cognitive", "nesting") if c in nodes.columns]
    beside = nodes.filter("is_test").groupBy("file_path").agg(F.count(F.lit(1)).alias("file_tests"))
    m = node_metrics(nodes, edges)
    for side, by in ((unresolved(edges), "qn"), (neighbour_modules(nodes, edges), "qn"), (depths, "qn"), (coverage(nodes, edges), "qn"), (beside, "file_path"), (cycles, "module")):
        m = m.join(side, by, "left")
    if known:
        m = m.join(nodes.select("qn", *known), "qn", "left")
    m = m.fillna(0, ["unresolved", "modules", "depth", "file_tests", *known]).fillna("none", ["coverage"])
    ratio = lambda c, top: F.least(F.col(c) / float(top), F.lit(1.0))
    share = F.create_map(*(F.lit(x) for kv in TEST_SHARE.items() for x in kv))[F.col("coverage")]
    tests = F.when(F.col("tests") > 0, F.col("tests")).otherwise(F.col("file_tests"))
    factors = {
        "public_api": F.when(F.coalesce(F.col("modifiers").rlike("pub|export"), F.lit(False)), 1.0).otherwise(0.0),
        "fan_in": ratio("fan_in", THRESHOLDS["fan_in"]),
        "fan_out": ratio("fan_out", THRESHOLDS["fan_out"]),
        "cross_module": ratio("modules", THRESHOLDS["coupling"]),
        "depth": ratio("depth", THRESHOLDS["depth"]),
        "unresolved": ratio("unresolved", 3),
        "large": ratio("loc", THRESHOLDS["loc"]),
        "loc": ratio("loc", THRESHOLDS["loc"]),
        "cycle": F.when(F.col("cyclic"), 1.0).otherwise(0.0),
        **{c: ratio(c, THRESHOLDS[c]) for c in known},
    }
    rows = [F.struct(F.lit(k).alias("factor"), v.alias("normalized"), F.lit(RISK_WEIGHTS[k]).alias("weight")) for k, v in factors.items()]
    rows.append(F.struct(F.lit("tests").alias("factor"), (share * F.least(tests / 3.0, F.lit(1.0))).alias("normalized"), F.lit(-TEST_WEIGHT).alias("weight")))
    return m.select("qn", F.explode(F.array(*rows)).alias("f")).select("qn", "f.*")


def weighted_risk(factors: DataFrame) -> DataFrame:
    """Score of 0 to 100 from the weighted factors, of the total weight of all that raise it, and its class."""
    raw = F.sum(F.col("normalized") * F.col("weight")) / sum(RISK_WEIGHTS.values()) * 100
    score = F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 4)
    return factors.groupBy("qn").agg(score.alias("score")).withColumn("risk", F.when(F.col("score") >= RISK_BANDS[1], "high").when(F.col("score") >= RISK_BANDS[0], "medium").otherwise("low"))


def rename_radius(nodes: DataFrame, edges: DataFrame, new_name: Column) -> DataFrame:
    """Renaming each symbol to new_name: references by scope, whether the name is taken in its file, and the risk."""
    at = nodes.select(F.col("qn").alias("source"), F.col("file_path").alias("from_file"))
    refs = (
        edges.join(at, "source")
        .join(nodes.select(F.col("qn").alias("target"), F.col("file_path").alias("to_file")), "target")
        .groupBy(F.col("target").alias("qn"))
        .agg(F.count_if(F.col("from_file") == F.col("to_file")).alias("same_file"), F.count_if(F.col("from_file") != F.col("to_file")).alias("other_files"), F.count_if(F.col("tier") == "low").alias("manual"))
    )
    taken = nodes.select("file_path", F.col("name").alias("new_name")).distinct().withColumn("collides", F.lit(True))
    m = nodes.withColumn("new_name", new_name).join(refs, "qn", "left").join(taken, ["file_path", "new_name"], "left").fillna(0, ["same_file", "other_files", "manual"]).fillna(False, ["collides"])
    public = F.coalesce(F.col("modifiers").rlike("pub|export"), F.lit(False))
    total = F.col("same_file") + F.col("other_files")
    risk = F.when(F.col("collides") | (public & (total > 20)), "high").when((F.col("manual") > 0) | (total > 10) | public, "medium").otherwise("low")
    return m.select("qn", "same_file", "other_files", "collides", risk.alias("risk"))
