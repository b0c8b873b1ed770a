"""Text functions, search, sessions, stores, parsers and streams on small cases."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import ledger, search, temporal
from graphloom.sources import docs, files, store
from graphloom.streaming import events
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


def one(spark, column, **values):
    return spark.range(1).select(column(*(F.lit(v) for v in values.values()))).first()[0]


def test_names_and_sets(spark):
    f = spark.createDataFrame([("parseHTTPRequest_v2", "(a, b)"), ("", None), (None, "()")], "s string, p string")
    assert [r[0] for r in f.select(T.split_camel(F.col("s"))).collect()] == [["parse", "http", "request", "v2"], [], None]
    assert [r[0] for r in f.select(T.arity(F.col("p"))).collect()] == [2, 0, 0]
    g = spark.createDataFrame([(["a", "b", "c", "a", "b"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in g.select(T.shingles(F.col("t"), 2)).collect()] == [["a b", "b c", "c a"], ["a"], []]
    h = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [round(r[0], 4) for r in h.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [0.3333, 0.0]


def test_vectors(spark):
    f = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 4) for r in f.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, 0.0, 0.0]


def test_redaction(spark):
    f = spark.createDataFrame([("token = abc123, x",), ("id 0123456789abcdef0123456789abcdef ok",), ("plain",)], "s string")
    assert [r[0] for r in f.select(T.redact(F.col("s"))).collect()] == ["token = [redacted], x", "id [redacted] ok", "plain"]


TEXTS = {
    1: "Prüfung: token = abc123é, weiter\u00a0 ",
    2: "\u2003\u00a0élan snapshot\u3000\n\u2028",
    3: f"é{'a' * 32} {'a' * 32}– password=x\u00a0y",
    4: "snapshoté snapshots _snapshot ésnapshot\nder snapshot – “snapshot”\r\nende",
    5: "plain snapshot",
    6: None,
    7: "",
    8: "   \u0085",
}


def test_texts_outside_ascii_take_part(spark, tmp_path):
    import hashlib
    import re

    import __spark_entry__

    from pyspark.sql import types as ty

    at = "doc_id long, text string, lang string, source string, n_chars long, title string, content_type string, chunk_index int, repo_id long, created_at timestamp_ntz, ingested_at timestamp_ntz"
    data = [(k, t, None, "sé", None, None, "x", 0, 1, None, None) for k, t in TEXTS.items()]
    spark.createDataFrame(data, ty._parse_datatype_string(at)).write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: rows(__spark_entry__.queries()[name](spark, str(tmp_path)))
    full = {k: t for k, t in TEXTS.items() if t is not None}

    def redacted(t):
        t = re.sub(r"\b(password|passwd|secret|token|api[_-]?key)(\s*[=:]\s*)[^\s,;]+", r"\1\2[redacted]", t, flags=re.I)
        return re.sub(r"\b[0-9a-fA-F]{32,}\b", "[redacted]", t)

    assert run("redaction") == sorted(((k, redacted(t)) for k, t in full.items()), key=repr)
    assert run("chunk_ids") == sorted(((k, hashlib.sha256("sé".encode() + b"\0" + t.strip().encode()).hexdigest()) for k, t in full.items()), key=repr)
    name = re.compile(r"\bsnapshot\b", re.A)
    edits = [(k, i, line, name.sub("capture", line)) for k, t in full.items() for i, line in enumerate(t.split("\n"), 1) if name.search(line)]
    assert len(edits) == 4 and run("rename_edits") == sorted(edits, key=repr)


def test_code_in_any_encoding_is_grouped(spark, tmp_path):
    import __spark_entry__

    code = "x = f('é', 1)\n# größer\ny = x + 2\n"
    other = code.replace("x", "zeta").replace("1", "77")
    files = [code.encode(), other.encode(), b"\xef\xbb\xbf" + code.encode(), code.encode("utf-16"), code.encode("latin-1"), b"a = b(1, 2)\n", b"q = r(3, 4)\n", "ü = v(3, 4)\n".encode(), None, b""]
    data = [(k, 1, f"a{k}.py", raw) for k, raw in enumerate(files)]
    spark.createDataFrame(data, "work_id long, repo_id long, rel_path string, bytes binary").write.parquet(f"{tmp_path}/parse_work.parquet")
    got = rows(__spark_entry__.queries()["exact_code_groups"](spark, str(tmp_path)))
    assert [(k, n) for k, _, n in got] == [(0, 5), (1, 5), (2, 5), (3, 5), (4, 5), (5, 2), (6, 2)] and len({s for _, s, _ in got}) == 2


def test_bm25_ranks_rare_terms_first(spark):
    data = spark.createDataFrame([(1, "common words here"), (2, "common rare"), (3, "common common"), (4, None)], "id long, content string")
    asked = spark.createDataFrame([(7, "rare"), (7, "common")], "query_id long, term string")
    got = search.bm25(search.postings(data, "id", {"content": 1}), data, "id", asked, 2).select("id", "rank")
    assert [r.id for r in got.orderBy("rank").collect()][0] == 2
    assert rows(search.bm25(search.postings(data.limit(0), "id", {"content": 1}), data.limit(0), "id", asked, 2)) == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("abcd", min_size=3, max_size=7), min_size=1, max_size=8, unique=True), st.text("abcd", min_size=3, max_size=7))
def test_corrections_against_brute_force(spark, terms, word):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    voc = spark.createDataFrame([(t, k + 1) for k, t in enumerate(terms)], "term string, df long")
    got = rows(search.corrections(voc, spark.createDataFrame([(word,)], "word string")).select("term", "distance"))
    near = sorted((distance(word, t), -(k + 1), t) for k, t in enumerate(terms) if distance(word, t) <= 2)
    assert got == ([(near[0][2], near[0][0])] if near else [])


def test_sections_skip_fences(spark):
    f = spark.createDataFrame([(1, "# A\ntext\n```\n# no\n```\n## B\r\n"), (2, None), (3, "")], "id long, content string")
    assert rows(search.headings(f, "id", "content").select("id", "line", "level", "title")) == [(1, 1, 1, "A"), (1, 6, 2, "B")]
    assert rows(search.grep(f, "id", "content", "^text$", 1).select("line", "hit")) == [(0, False), (1, True), (2, False)]


LEDGER = "id long, session_id string, event_type string, priority int, payload string, event_hash string, created_at timestamp_ntz"


def event(i, kind, k, minutes, session="s", h=None):
    return (i, session, kind, 10, f'{{"k": {k}}}' if k is not None else None, h or f"{kind}{k}", T0 + timedelta(minutes=minutes))


def test_ledger(spark):
    data = [event(1, "view", 1, 0), event(2, "view", 1, 1), event(3, "view", 1, 2), event(4, "view", 1, 3), event(5, "error", 2, 4), event(6, "error", 2, 5), event(7, "click", None, 6), event(8, "signup", 9, 7)]
    f = spark.createDataFrame(data, LEDGER)
    assert rows(ledger.dedup(f).select("id")) == [(1,), (5,), (7,), (8,)]
    assert rows(ledger.dedup_within(f, 60).select("id")) == [(1,), (5,), (7,), (8,)]
    assert rows(ledger.dedup_within(f, 59).select("id")) == [(k,) for k in range(1, 9)]
    assert {r.id: r.fate for r in ledger.compact(f).collect()} == {1: "decay", 2: "keep", 3: "keep", 4: "keep", 5: "keep", 6: "promote", 7: "keep", 8: "keep"}
    state = ledger.resume(f).first()
    assert (state.events, state.errors, state.intent) == (8, 2, "9")
    page = ledger.page_after(f.select("created_at", "id"), ["created_at", "id"], [T0 + timedelta(minutes=4), 5], 2)
    assert [r.id for r in page.collect()] == [4, 3]
    assert rows(ledger.compact(f.limit(0))) == []


def test_windows(spark):
    spans = spark.createDataFrame([("f", 1, 3), ("f", 4, 6), ("f", 9, 12), ("f", 10, 11), ("g", 1, 1)], "k string, start int, end int")
    assert rows(temporal.merge_spans(spans, "k")) == [("f", 1, 6, 2), ("f", 9, 12, 2), ("g", 1, 1, 1)]
    seen = spark.createDataFrame([(1, "x", 1, "h"), (1, "x", 2, "i"), (1, "x", 4, "i"), (1, "y", 5, "h")], "repo_id long, qn string, pos long, hash string")
    last = spark.createDataFrame([(1, 5)], "repo_id long, last long")
    got = {r.qn: (r.introductions, r.removals, r.changes, r.lifetime) for r in temporal.presence(seen, ["qn"], last, F.col("hash")).collect()}
    assert got == {"x": (2, 2, 4, 4), "y": (1, 0, 0, 1)}


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "path string, v int")
    new = spark.createDataFrame([("a", 9)], "path string, v int")
    assert rows(store.replace_slices(old, new, "path")) == [("a", 9), ("b", 3)]
    gone = spark.createDataFrame([("b",), ("c",)], "path string")
    assert rows(store.replace_slices(old, new, "path", gone)) == [("a", 9)]
    assert rows(store.upsert(old, spark.createDataFrame([("b", 2), ("c", 1)], "path string, v int"), ["path"], "v")) == [("a", 2), ("b", 3), ("c", 1)]
    moved = spark.createDataFrame([("b", "z")], "old_path string, new_path string")
    assert rows(store.rename_paths(old, moved, "path")) == [("a", 1), ("a", 2), ("z", 3)]
    folder = f"file://{tmp_path}/t"
    store.publish(old, folder)
    store.publish(new, folder)
    assert rows(store.current(spark, folder)) == [("a", 9)]


def test_files_and_parsers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_text("import os\nclass A:\n    def f(self):\n        g()\n")
    (tmp_path / "sub" / "b.bin").write_bytes(b"x\0y")
    found = files.inventory(spark, str(tmp_path), ignore=["nothing"])
    assert {r.path.rsplit("/", 1)[-1]: r.binary for r in found.collect()} == {"a.py": False, "b.bin": True}
    assert files.inventory(spark, str(tmp_path), ignore=["sub"]).count() == 1
    kinds = {(k, n, p) for k, n, p, _ in files.parse_text((tmp_path / "a.py").read_bytes(), "python")}
    assert kinds == {("import", "os", ""), ("class", "A", ""), ("method", "f", "A"), ("call", "g", "f")}
    assert files.parse_text(b"def (", "python") == [] and files.parse_text(b"\xff", "json") == []
    assert [r[:3] for r in files.parse_text(b'<p><a href="u">x</a><img src="i"></p>', "html")] == [("module", "p[0]", "document"), ("module", "a[0]", "p[0]"), ("import", "u", "a[0]"), ("module", "img[0]", "p[0]"), ("import", "i", "img[0]")]
    pairs = spark.createDataFrame([("f", "a\nb\n", "a\nc\n"), ("g", None, None), ("h", None, "n\n")], "path string, old string, new string")
    got = {r.path: r.patch for r in files.patches(pairs).collect()}
    assert set(got) == {"f", "h"} and "-b\n+c\n" in got["f"]
    page = docs.file_docs(spark.createDataFrame([("f", "n", "function")], "file_path string, name string, kind string")).first()
    assert page.page == "# f\n\n- `n` (function)"


def test_coalesced_changes(spark):
    data = [(1, "a", "modified", None), (2, "a", "deleted", None), (3, "b", "modified", None), (4, "c", "renamed", "b"), (5, "b", "added", None)]
    f = spark.createDataFrame(data, "seq long, path string, change string, old_path string")
    assert rows(events.coalesce_changes(f).select("path", "change")) == [("a", "deleted"), ("b", "added"), ("c", "renamed")]
    assert rows(events.coalesce_changes(f.filter("seq < 5")).select("path", "change")) == [("a", "deleted"), ("c", "renamed")]


def test_streams_equal_batches(spark, tmp_path):
    rnd = random.Random(1)
    data = [(k, T0 + timedelta(minutes=rnd.randint(0, 300)), rnd.choice("xy"), rnd.randint(0, 5)) for k in range(120)]
    batch = spark.createDataFrame(data, "id long, ts timestamp_ntz, event_type string, k long")
    batch.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = events.read_events(spark, f"{tmp_path}/in", batch.schema, max_files=1)
    got = rows(events.run_once(events.dedup_stream(stream, ["event_type", "k"], "1 day")).select("event_type", "k"))
    assert got == rows(batch.select("event_type", "k").distinct())


@pytest.mark.parametrize("limit", [1, 3])
def test_fusion(spark, limit):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank long")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank long")
    assert [r.id for r in search.reciprocal_rank([a, b], "id", limit).orderBy("fused_rank").collect()] == [11, 10, 12][:limit]


def test_bounded_sessions_over_many_batches(spark, tmp_path):
    from pyspark.sql import Window

    from graphloom.streaming import state

    rnd = random.Random(4)
    data = [(k, f"s{rnd.randint(0, 2)}", rnd.choice([10, 30, 80]), rnd.randint(0, 1000)) for k in range(90)]
    frame = spark.createDataFrame(data, "id long, session_id string, priority long, at long")
    for part in range(3):
        frame.filter(f"id % 3 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = events.run_once(state.bounded_sessions(stream, 7), "update")
    latest = out.withColumn("n", F.row_number().over(Window.partitionBy("session_id", "id").orderBy(F.col("batch").desc()))).filter("n = 1 and kept")
    w = Window.partitionBy("session_id").orderBy(F.col("priority").desc(), F.col("at").desc(), F.col("id").desc())
    want = frame.withColumn("n", F.row_number().over(w)).filter("n <= 7")
    assert out.select("batch").distinct().count() == 3
    assert rows(latest.select("session_id", "id")) == rows(want.select("session_id", "id"))


def test_parts_follow_the_planned_size(spark, monkeypatch):
    from graphloom import session

    rows_ = spark.range(1000)
    assert session.parts_for(rows_) is None
    monkeypatch.setattr(session, "PART_BYTES", 100)
    assert session.parts_for(rows_) == 80


def test_near_words_and_renames(spark):
    from graphloom.operators import joins, search

    far = "x " * 60
    docs = spark.createDataFrame([(1, "T", "Stale a cache"), (2, "stale", f"stale {far}cache"), (3, None, None), (4, "Cache", ""), (5, "t", "stale stale cachette")], "id long, title string, content string")
    assert rows(search.proximity(docs, "id", "content", "title", ["stale", "cache"])) == [(1, 1), (2, 5), (3, 0), (4, 5), (5, 2)]
    now = spark.createDataFrame([(1, "b", "h"), (1, "c", "h"), (1, "same", "h"), (1, "n", None), (2, "x", "h")], "repo_id long, path string, file_hash string")
    old = spark.createDataFrame([(1, "a", "h"), (1, "same", "h"), (1, "o", None)], "repo_id long, path string, file_hash string")
    assert rows(joins.renames(now, old)) == [("a", "b")]


def test_similar_functions_drop_pairs_as_they_are_joined(spark):
    from itertools import combinations

    size = 300
    data = [(f"r#f{k}::fn::get_{k}", f"get_{k}", "function", f"d{k}/f.py", "python", k, k + 4, "(left)" if k < 2 else "()") for k in range(size)]
    data += [("r#x::fn::get_0", "get_0", "function", "y/x.py", "python", 1, 5, "(left)"), ("r#x::fn::some", "some", "function", "y/x.py", "python", 1, 5, "()"), ("r#z::fn::else", "else", "function", "y/z.py", "python", 1, 5, "()")]
    nodes = spark.createDataFrame(data, "qn string, name string, kind string, file_path string, language string, line_start int, line_end int, params string")
    edges = spark.createDataFrame([("r#x::fn::some", "r#f1::fn::get_1"), ("r#z::fn::else", "r#f1::fn::get_1")], "source string, target string")

    def jaccard(x, y):
        return len(x & y) / len(x | y) if x and y else 0

    of = {d[0]: (set(d[1].split("_")), {w for w in [d[7].strip("()")] if w}, d[3].rpartition("/")[0], d[3]) for d in data}
    near = {q: set() for q in of}
    for s, t in (("r#x::fn::some", "r#f1::fn::get_1"), ("r#z::fn::else", "r#f1::fn::get_1")):
        near[s].add(t.split("::")[-1])
        near[t].add(s.split("::")[-1])
    want = set()
    for x, y in combinations(of, 2):
        a, b = of[x], of[y]
        jn, js, jr = jaccard(a[0], b[0]), jaccard(a[1], b[1]), jaccard(near[x], near[y])
        if a[3] != b[3] and abs(len(a[1]) - len(b[1])) <= 1 and round(0.18 * jn + 0.2 * js + 0.18 * jr + 0.05 * (a[2] == b[2]) + 0.05, 6) >= 0.35 and (js >= 0.3 or jr >= 0.15):
            want |= {(x, y), (y, x)}
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway

    def written():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = written()
    got = {(r.qn, r.match_qn) for r in search.similar_functions(nodes, edges, 0.35, size).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert got == want and want
    assert written() - before < size * (size - 1) / 2 / 4
