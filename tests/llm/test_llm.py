"""Training-data operators against hand-made cases and brute force."""

import collections
import itertools
import random
from datetime import datetime

import numpy as np
import pytest

from graphloom.llm import cooccur, encode, grammars, handwritten, leakage, parsecheck, stuffing, topn
from tests.conftest import rows
from tests.llm import snippets

# ---------------------------------------------------------------- items that appear together

LINKS = "repo_id long, from_file string, to_file string, via_symbols array<string>, symbol string, n long"


def brute_pairs(data):
    records, out = {}, {}
    for repo, a, b, symbols, *_ in data:
        if repo is not None:
            records.setdefault((repo, a, b), set()).update(s.strip(" \t") for s in symbols or () if s is not None and s.strip(" \t"))
    total = collections.Counter(k[0] for k in records)
    single = collections.Counter((k[0], s) for k, v in records.items() for s in v)
    for k, v in records.items():
        for a, b in itertools.combinations(sorted(v), 2):
            out[k[0], a, b] = out.get((k[0], a, b), 0) + 1
    return {(*k, n, single[k[0], k[1]], single[k[0], k[2]], total[k[0]]) for k, n in out.items()}


@pytest.mark.parametrize("seed, share, block", [(1, 64, 65536), (2, 4, 5), (3, 1, 7), (4, 2, 65536)])
def test_pairs_against_brute_force(spark, seed, share, block):
    rnd = random.Random(seed)
    names = ["  all\t", "all", "b", "c", " d", "e", "f", "g", None, " ", ""]
    data = [(rnd.choice([1, 1, 1, 2, None]), f"f{rnd.randint(0, 20)}", rnd.choice(["t", None]), rnd.choice([None, [rnd.choice(names) for _ in range(rnd.randint(0, 6))]]), "x", 1) for _ in range(150)]
    held = cooccur.records([(spark.createDataFrame(data, LINKS), ["from_file", "to_file"], "via_symbols")])
    got = cooccur.pair_counts(held, heavy_share=share, block_records=block).select("repo_id", "symbol_a", "symbol_b", "n_ab", "n_a", "n_b", "n_records")
    assert set(rows(got)) == brute_pairs(data)
    strict = cooccur.pair_counts(held, 3, 1.2, block, share).select("repo_id", "symbol_a", "symbol_b", "n_ab", "n_a", "n_b", "n_records")
    assert set(rows(strict)) == {r for r in brute_pairs(data) if r[3] >= 3 and r[3] * r[6] >= 1.2 * r[4] * r[5]}


def test_pairs_of_nothing(spark):
    empty = cooccur.records([(spark.createDataFrame([], LINKS), ["from_file", "to_file"], "via_symbols")])
    assert rows(cooccur.pair_counts(empty, 6, 3)) == []


def test_pair_buffer_is_merged():
    rec = np.repeat(np.arange(30), 8)
    item = np.tile(np.arange(8), 30)
    lo, hi, n = cooccur.count_block(rec, item, np.zeros(8, dtype=bool), pair_buffer=10)
    assert len(lo) == 28 and set(n.tolist()) == {30}


def test_a_full_block_stays_small():
    import tracemalloc

    rnd = np.random.default_rng(5)
    records, heavy, light = 262_144, 400, 2_000
    rec = np.concatenate([rnd.choice(records, 8_000, replace=False) for _ in range(heavy)] + [rnd.choice(records, 20, replace=False) for _ in range(light)])
    item = np.concatenate([np.repeat(np.arange(heavy), 8_000), np.repeat(np.arange(heavy, heavy + light), 20)])
    tracemalloc.start()
    lo, hi, both = cooccur.count_block(rec, item, np.arange(heavy + light) < heavy)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6
    sets = {k: set(rec[item == k].tolist()) for k in (0, 7, heavy + 3, heavy + 4)}
    got = {(a, b): n for a, b, n in zip(lo.tolist(), hi.tolist(), both.tolist())}
    for a, b in itertools.combinations(sets, 2):
        assert got.get((a, b), 0) == len(sets[a] & sets[b])


# ---------------------------------------------------------------- top items

RESULT = "result_id long, query_id long, score double, qualified_name string, kind string, file_path string, rank_no int, bucket int, run int"


def brute_top(data, top=5):
    best = {}
    for rid, q, s, name, kind, path, *_ in data:
        if kind is None or s is None or s != s:
            continue
        key = (-s, path is None, path or "", rid)
        group = best.setdefault((q, kind.strip().lower()), {})
        if name not in group or key < group[name]:
            group[name] = key
    out = []
    for (q, kind), items in best.items():
        order = sorted(items.items(), key=lambda x: (x[1][:3], x[0] is None, x[0] or ""))
        out += [(q, kind, k + 1, key[3]) for k, (_, key) in enumerate(order[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_top_items_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    data = [
        (k, rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([1.0, 2.0, 3.5, float("nan"), None, -0.0, 0.0]), rnd.choice([*"abcdefghij", None]), rnd.choice(["Fn", " fn ", "struct", None]), rnd.choice(["a/é", "b", None]), 7, 7, 7)
        for k in range(400)
    ]
    frame = spark.createDataFrame(data, RESULT).repartition(6)
    assert rows(topn.top_items(frame)) == brute_top(data)


def test_top_of_nothing_and_of_one_hot_group(spark):
    assert rows(topn.top_items(spark.createDataFrame([], RESULT))) == []
    data = [(k, 1, float(k % 50), f"n{k % 700}", "fn", None, 0, 0, 0) for k in range(30_000)]
    assert rows(topn.top_items(spark.createDataFrame(data, RESULT))) == brute_top(data)


def test_loser_tree_sorts():
    rnd = random.Random(5)
    for runs in (1, 2, 3, 7, 10):
        data = [sorted(rnd.randint(0, 30) for _ in range(rnd.randint(1, 9))) for _ in range(runs)]
        at, out = [0] * runs, []
        tree = topn.LoserTree([(r[0], i) for i, r in enumerate(data)])
        while tree.heads[run := tree.winner] is not None:
            out.append(data[run][at[run]])
            at[run] += 1
            tree.replace((data[run][at[run]], run) if at[run] < len(data[run]) else None)
        assert out == sorted(sum(data, []))


# ---------------------------------------------------------------- source files


VALID = {
    "c": b'#include <stdio.h>\n/* { */ static int f(const char *s, int n) {\n  for (int i = 0; i < n; i++) { g(i, s[i]); }\n  char c = \'}\'; if (n > 1) { return -1; } else return n ? 2 : 3;\n}\nstruct A { const char *x; int y[3]; };\nint t[] = {1, 2, 3,};\n',
    "java": b'package a.b;\nimport java.util.List;\n@Deprecated public class A<T extends B> implements C {\n  private static final int X = 3;\n  public List<String> f(String a, int... b) throws E { for (String s : a.split(",")) { x.put(s, y -> y + 1); }\n    try { g(); } catch (E e) { throw new F("{", e); } finally { } return List.of("(", "b"); }\n}\n',
    "javascript": b"#!/usr/bin/env node\nimport { a } from './b.js';\nconst c = require('d');\nexport class E extends F { constructor(x) { super(x); this.x = x }\n get y() { return `${this.x}: {` } }\nexport function g(a, { b = 1, ...r }) {\n  const re = /[{(]+\\d*/g, t = `${a.map((x) => `<${x}>`).join(', ')} }`\n  for (const k of a) { h(k, { depth: 1 }) }\n  return a ? b / 2 : c\n}\n",
    "typescript": b"import { A } from './b';\nexport interface C<T> { a: string; b?: number[]; f(x: T): Promise<void> }\ntype D = 'x' | 'y';\nenum G { P, Q = 2 }\nexport async function g<T>(a: string[], b?: number): Promise<Map<string, Array<number>>> {\n  const m: Map<string, number> = new Map<string, number>();\n  for (const x of a) { h(x as string, { d: 1 }); }\n  return m!;\n}\n",
    "go": b'package a\n\nimport (\n\t"fmt"\n)\n\ntype S struct {\n\tx string\n\ty []int\n}\n\nfunc (s *S) F(a string, b int) (int, error) {\n\tv := `raw { "x\n[`\n\tfor i := 0; i < b; i++ {\n\t\tfmt.Println(v, S{x: a})\n\t}\n\tif err := g(); err != nil {\n\t\treturn 0, err\n\t}\n\treturn b + 1, nil\n}\n',
    "rust": b'use std::collections::{BTreeMap, HashMap};\n#[derive(Debug)]\npub struct A<\'a> { pub x: &\'a str, y: Vec<u32> }\nimpl<\'a> A<\'a> { pub fn f(&self, n: usize) -> Option<usize> {\n let c = \'{\'; let r = r#"{ "a": ["#; /* a /* b */ c */\n let v: Vec<_> = self.y.iter().map(|x| x + 1).collect();\n match n { Some(x) if x > 3 => log("("), _ => {} }\n for i in 0..3 { g(i)?; }\n if n > 1 { return None; }\n Some(n + 1) } }\n',
    "python": b"# -*- coding: latin-1 -*-\nx = '\xe9'\ndef f(a, *b):\n    return [i for i in b if i]\n",
    "json": b'\xef\xbb\xbf{"a": [1, 2.5e3, null], "b": "x"}\n',
    "toml": b'[a]\r\nb = "x [y"\r\nc = { d = 1 }\r\n',
}
BROKEN = {
    "c": [b"int f(int a { return a; }\n", b"int f(void) { return 1; \n", b"int f(void) {\n<<<<<<< HEAD\n  return 1;\n}\n", b'char *s = "open;\n', b"int f(void) { return 1 }\n"],
    "java": [b"class A { int f() { return 1 } }", b"class A { void f() { g(1, (2); } }", b"import os\n\ndef f(x):\n    return x\n", b"class A { void f() { } } }"],
    "javascript": [b"const a: number = 1;\n", b"function f( {\n", b"const s = 'open\n", b"const t = `${a;\n", b"f([1, 2);\n", b"interface A { x: string }\n"],
    "typescript": [b"export function f(a: string[], n: ): number { return 1; }\n", b"const a = [1, 2;\n", b"from . import x\n"],
    "go": [b"package a\n\nfunc f() int {\n\treturn 1\n", b"package a\n\nfunc f( {\n}\n", b"func f() {}\n", b"package a\n\nx = 1\n"],
    "rust": [b"fn f() -> usize { 1 \n", b"fn f(a: usize { a }\n", b"let x = 1;\n", b"/* /* */ fn f() {}\n", b"fn f() { let = 3; }\n", b"struct A { x str }\n"],
    "python": [b"print 'x'\n", b"def f(:\n  pass\n", b"x = '\xe9'\n"],
    "json": [b"", b"{'a': 1}", b'{"a": NaN}', b'{"a": 1,}'],
    "toml": [b"a = [1\n", b"[a]\nb = 1\nb = 2\n"],
}


@pytest.mark.parametrize("language", grammars.LANGUAGES)
def test_grammars(language):
    assert grammars.is_valid(VALID[language], language)
    assert grammars.is_valid(b"", language) == (language != "json")
    assert not grammars.is_valid("fn f() {}".encode("utf-16"), language)
    for raw in BROKEN[language]:
        assert not grammars.is_valid(raw, language), raw


@pytest.mark.parametrize("language", ["c", "java", "rust", "go", "javascript", "typescript"])
def test_cut_files_do_not_parse(language):
    raw = VALID[language].rstrip()
    assert sum(grammars.is_valid(raw[:k], language) for k in range(len(raw) // 2, len(raw) - 2)) < len(raw) // 10


FILES = "work_id long, repo_id long, rel_path string, bytes binary, orig_language string, language string, verdict string, prints string"


def test_verdicts(spark):
    data = [
        (1, 1, "a.rs", VALID["go"], None, None, "clash", None),
        (2, 1, "a.py", b"def f(:\n", None, None, None, None),
        (3, 1, "a.py", VALID["rust"], "rust", None, None, None),
        (4, 1, "a.json", b"", None, None, None, None),
        (5, 1, "x.unknown", b"?", None, None, None, None),
        (6, None, None, None, None, None, None, None),
        (7, 2, "big.c", VALID["c"] * 200, None, None, None, None),
    ]
    frame = spark.createDataFrame(data, FILES)
    got = {r.work_id: (r.verdict, r.parses_as) for r in parsecheck.check_files(frame).collect()}
    assert got == {1: ("wrong_language", "go"), 2: ("corrupt", None), 3: ("valid", "rust"), 4: ("corrupt", None), 5: ("unknown", None), 6: ("unknown", None), 7: ("valid", "c")}
    assert rows(parsecheck.unparsable(frame).select("work_id")) == [(1,), (2,), (4,)]
    rates = {(r.repo_id, r.language): (r.files, r.invalid, r.rate) for r in parsecheck.rates(frame).collect()}
    assert rates[1, "python"] == (1, 1, 1.0) and rates[2, "c"] == (1, 0, 0.0)
    assert rows(parsecheck.check_files(frame.limit(0))) == []


@pytest.mark.parametrize("language", sorted(snippets.GOOD))
def test_snippets(language):
    assert [x for x in snippets.GOOD[language] if not grammars.is_valid(x.encode(), language)] == []
    assert [x for x in snippets.BAD[language] if grammars.is_valid(x.encode(), language)] == []


def test_every_grammar_and_means_that_run_out():
    assert parsecheck.verdict(b"const a = 1;\n", "javascript") == ("valid", ["javascript", "typescript"])
    assert parsecheck.verdict(b"let x = 1\n", "rust")[0] == "wrong_language"
    deep = b"[" * 200_000 + b'{"a": [1, {"b": null}]}' + b"]" * 200_000
    assert grammars.check(deep, "json") is True and grammars.check(deep[:-1], "json") is False
    assert grammars.check(b"[" * 200_000 + b"1,]" + b"]" * 199_999, "json") is False
    for text, good in (('{"a":1,"b":[]}', True), ('{"a" 1}', False), ("[1 2]", False), ('{1:2}', False), ("[,]", False), ('{"a":}', False), ("1 2", False), ("{}", True), ("[01]", False)):
        assert grammars._deep_json(text) == good, text
    assert grammars.check(b"x = " + b"-" * 2_000_000 + b"1\n", "python") is None


def test_texts_are_read_at_once():
    js = grammars.grammar("javascript")
    for text, flat in {
        "a.instanceof.if / b.c / 2": "i.i.ioi.io0",
        "x = `a\\`${b.of}` + /[/]`/g.test(y)": "i=s(i.i)+s.i(i)",
        "a\n/b/g": "ioioi",
        "a = {b: /c/, d: `${{e: 1}.e}`}": "i={i:s,i:s({i:0}.i)}",
        "x\n\n/* a\n */ y 1a": None,
        "f(`${'`'}`": "i(s(s)",
    }.items():
        assert js.tokens(text) == flat, text
    assert grammars.grammar("rust").tokens("union U { a: u8 } union(r#\"\"#, 'a, 'b')") == "Si{i:i}i(s,l,s)"
    for language, text, flat in (("c", "a /* \n */ += L'x' .5f;", "ias0;"), ("go", "a &^= `b\n` <- 'c'", "itshs;"), ("java", "a >>= $b instanceof C", "i>oiwi")):
        assert grammars.grammar(language).tokens(text) == flat, language
    deep = "(" * 5000 + ")" * 5000
    assert len(js.reduce(deep)) == 1 and js.reduce(deep[:-1]) is None and len(js.reduce("f" + deep[4990:5010] + "s")) == 3


def test_what_no_python_file_begins_with(monkeypatch):
    read = []
    monkeypatch.setattr(grammars, "compile", lambda *a, **k: read.append(a[0]) or compile(*a, **k), raising=False)
    for text in ("package main\n", "// a\nx = 1\n", "# a\n\n  # b\nimport {a} from 'b'\n", "pub use std::fmt;\nx = 1\n"):
        assert grammars.check(text.encode(), "python", text) is False
    assert not read
    for text in ("match x:\n case y: pass\n", "type X = int\n", "import os\n", "a in b\n", "not a\n", "# coding: latin-1\nx\n", "''\n", "print\n"):
        assert grammars.check(text.encode(), "python", text) is True
    assert len(read) == 8


def test_toml_and_json_under_other_extensions():
    day = b"day = 1979-05-27T07:32:00Z\n"  # no other grammar reads that
    for raw in (day, b"# a list\n[[p]]\n" + day, b"\xef\xbb\xbfa.b = {c = 'x'}\n" + day):
        assert parsecheck.verdict(raw, "rust") == ("wrong_language", ["toml"]), raw
    assert not parsecheck._tells(b"# only words\n", "toml") and not parsecheck._tells(b"12", "json") and parsecheck._tells(b'\xef\xbb\xbf{"a": null}', "json")



HAND = [
    (b"// the code generator in x calls this\nconst a = 1;\n" * 9, "src/generated_ids/a.js", "javascript"),
    (b"# DO NOT EDIT the order of this list without asking\nx = [1, 2, 3]\n" * 5, "src/vendors/a.py", "python"),
    (b"/*\n * Part of the x work tree.\n * Use, copying and change are allowed as long as\n * this notice stays in place.\n */\nint a;\n" * 3, "lib/a_min.c", "c"),
    (b'{"a": 1, "b": {"c": "d", "e": [1, 2, 3]}, "text": "hello"}' * 1, "a.json", "json"),
]
TOOL = [
    (b"// Code generated by x. DO NOT EDIT.\npackage a\n", "a.go", "go", "generated"),
    (b"package a\n", "x/a.pb.go", "go", "generated"),
    (b"/* \xc2\xa9 */\nint a;\n", "third_party/lib/a.c", "c", "vendored"),
    (b"/*\n * lib v1.2.3\n * (c) the lib contributors\n */\nint a;\n", "src/a.c", "c", "vendored"),
    (b"!function(e,t){" + b"e.push(n[i]);" * 80 + b"}", "static/a.js", "javascript", "minified"),
    (b"[[" + b"0.123456, " * 100 + b"1]]", "a.json", "json", "data"),
    (b'DATA = "' + b"aGVsbG8gd29ybGQ+" * 80 + b'"\n', "a.py", "python", "data"),
    (b'{\n "lockfileVersion": 3,\n "packages": {' + b" " * 200 + b"}}", "x.json", "json", "lock"),
    (b"".join(b"def op_%04d(c):\n    return c.d(%d, 0x%08x)\n\n" % (k, k, k * 7919) for k in range(30)), "a.py", "python", "generated"),
]


def test_evidence():
    for raw, path, language in HAND:
        assert handwritten.evidence(raw, path, language) is None, path
    for raw, path, language, kind in TOOL:
        assert handwritten.evidence(raw, path, language) == kind, path


CODE = {"go": b"package a\n" + b"func f() int { return 1 }\n" * 90, "python": b"import a\n" + b"def f(x):\n    return x\n" * 90, "c": b"int f(void);\n" * 150}


def test_banners_anywhere():
    go, py, c = CODE["go"], CODE["python"], CODE["c"]
    for raw, language in [
        (go + b"\n// Code generated by lexmill. DO NOT EDIT.\n", "go"),
        (b"// Code generated by lexmill. DO NOT EDIT.\n".join((go, go[10:])), "go"),
        (py + b"# @generated by graphgen v6.22.2\n", "python"),
        (c + b"/* <auto-generated>\n * Output of ormkit\n * </auto-generated> */\n\n", "c"),
        (b"// what this is\n" * 200 + b"// Code generated by lexmill. DO NOT EDIT.\n" + go, "go"),
        (c + b"// Generated file - manual edits are overwritten (wirec)\n", None),
        (py + b"# @generated by graphgen v6.22.2\n", "rust"),
    ]:
        assert handwritten.evidence(raw, "src/a", language) == "generated", raw[-80:]
    assert handwritten.evidence(c + b"// imported unchanged from x/y\n", "src/a.c", "c") == "vendored"
    for raw, language in [
        (go + b"// values are generated by the caller\n", "go"),
        (go + b"// the code generator in scope calls this\n", "go"),
        (go + b"// DO NOT EDIT\nvar x = 1\n", "go"),
        (go + b"// Generated by the caller below.\nvar x = 1\n", "go"),
        (go + b"var t = `\n// Code generated by x. DO NOT EDIT.\n`\n", "go"),
        (py + b'T = """\n# @generated by x\n"""\n', "python"),
        (py + b"x = 1  # Code generated by x. DO NOT EDIT.\n", "python"),
        (c + b'const char *s = "\\\n// @generated\\\n";\nint x;\n', "c"),
    ]:
        assert handwritten.evidence(raw, "src/a", language) is None, raw[-80:]


def test_copies_by_fingerprint(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    shared = " ".join(f"{word()}({word()}, {word()});" for _ in range(60))
    data = [(k, k, f"m{k}.c", f"// {word()}\n{shared}\n{word()};".encode(), "c", None, None, None) for k in range(6)]
    data += [(100 + k, k, f"o{k}.c", " ".join(f"{word()}({word()});" for _ in range(60)).encode(), "c", None, None, None) for k in range(6)]
    data += [(200, 1, "e.c", b"", "c", None, None, None), (201, 1, None, None, None, None, None, None)]
    frame = spark.createDataFrame(data, FILES)
    assert rows(handwritten.not_handwritten(frame)) == [(k, "vendored") for k in range(6)]
    assert rows(handwritten.not_handwritten(frame.limit(0))) == []


def test_unmarked_copies_of_marked_files(spark):
    rnd = random.Random(4)
    text = lambda: " ".join(f"{''.join(rnd.choice('abcdefgh') for _ in range(5))}({rnd.choice('xyz')});" for _ in range(80))
    lib, wide, own = text(), text(), text()
    data = [(1, 1, "node_modules/l/a.js", lib), (2, 2, "src/a.js", f"// mine\n{lib}"), (3, 3, "src/b.js", f"{own} {lib[:400]}")]
    data += [(10 + k, k, "a.pb.go" if k else "a.go", wide) for k in range(5)]  # written by a tool in four repositories, unmarked in a fifth
    data += [(20 + k, k, "o.js", own) for k in range(4)]  # forks of hand-written code
    data = [(w, r, path, body.encode(), None, None, None, None) for w, r, path, body in data]
    data += [(4, 4, "src/c.js", ("\ufeff" + lib).encode("utf-16-le"), None, None, None, None)]
    found = dict(rows(handwritten.not_handwritten(spark.createDataFrame(data, FILES))))
    assert found == {1: "vendored", 2: "vendored", 4: "vendored", 10: "vendored", **{10 + k: "generated" for k in range(1, 5)}}


def test_dumps_are_decided_by_fingerprints(spark):
    rnd = random.Random(9)
    numbers = lambda n: ", ".join(str(rnd.randint(0, 9999)) for _ in range(n))
    table = lambda n: "id,label text,weight g\n" + "".join(f"{k},{rnd.choice('abcdef') * 4} {rnd.choice('xyz') * 5},{rnd.randint(0, 99)} g\n" for k in range(n))
    data = [(k, k, f"t{k}.js", f"var data = [{numbers(200)}];") for k in range(2)]
    data += [(10 + k, k, f"t{k}.py", table(40)) for k in range(2)]
    data += [(20, 5, "b.py", f'DATA = "{"aGVsbG8gd29ybGQ" * 60}"'), (21, 5, "c.py", f"steps = [{numbers(20)}]\ndef f(x):\n    return steps[x]\n")]
    data += [(22, 5, "only.c", "M(" + numbers(400).replace(", ", "); M(") + ");")]  # no other repository holds such text
    frame = spark.createDataFrame([(w, r, path, body.encode(), None, None, None, None) for w, r, path, body in data], FILES)
    assert rows(handwritten.not_handwritten(frame)) == [(k, "data") for k in (0, 1, 10, 11, 20)]
    assert rows(handwritten.not_handwritten(frame, dump_repos=4)) == [(20, "data")]
    assert handwritten.form_of(table(40).encode(), "python") == "data"
    assert handwritten.form_of(b"path,kind,score\n" + b"a.go,fn name,3 pts\n" * 40, "python") is None


def test_winnowing_by_doubling_and_short_runs():
    rnd = random.Random(2)
    for n in (0, 15, 16, 17, 31, 32, 33, 200):
        words = [rnd.choice("abcdefgh") for _ in range(n)]
        raw = "  # note\n#x\n" + " /* c */ ".join(words) + "\n  # end\n\t#include\n// z"
        tokens = [*words, "#", "include"]
        codes = [handwritten._CODES[w.encode()] for w in tokens]
        power, mod = 0x9E3779B97F4A7C15, 1 << 64
        grams = []
        for i in range(len(codes) - handwritten.K + 1):
            h = sum(c * pow(power, j, mod) for j, c in enumerate(codes[i : i + handwritten.K])) % mod
            grams.append((h ^ h >> 31) * 0xBF58476D1CE4E5B9 % mod)
        width = min(handwritten.WINDOW, len(grams))
        least = collections.Counter(min(grams[i : i + width]) for i in range(len(grams) - width + 1)) if grams else collections.Counter()
        prints, windows = handwritten.winnow(raw.encode())
        assert dict(zip(prints.view(np.uint64).tolist(), windows.tolist())) == least and len(prints) == len(least)
    # a run that is too short is not tried again from each of its characters
    assert handwritten._LONG_STRING.findall(b"ab cd" + rb"\x41" * 12 + b"E" * 40) == [b"", b"", rb"\x41" * 12, b"E" * 40]


def test_winnowing_guarantee():
    rnd = random.Random(2)
    text = lambda n: b" ".join(b"w%d" % rnd.randint(0, 10**6) for _ in range(n))
    for _ in range(20):
        copied = text(handwritten.K + handwritten.WINDOW - 1)
        a = handwritten.fingerprints(text(rnd.randint(0, 50)) + b" " + copied + b" " + text(rnd.randint(0, 50)))
        b = handwritten.fingerprints(text(rnd.randint(0, 50)) + b" " + copied + b" " + text(rnd.randint(0, 50)))
        assert len(np.intersect1d(a, b))


# ---------------------------------------------------------------- tokenizer


def test_ids_equal_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    texts = [None, "", "   ", "Hello <|endoftext|> world's\r\n\r\n  x", "naïve 日本語 😀 z̃", "a" * 5000, "x " * 3000, "1234567890 ٣٤", "ſ'S don't", "­​\x00"]
    frame = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(1, "", "x")], "doc_id long, text string, ids string")
    got = rows(encode.encode_texts(frame))
    want = [(k, public.encode(t, add_special_tokens=False).ids if t else []) for k, t in enumerate(texts)] + [(1, [])]
    assert got == sorted(want, key=repr)
    assert rows(encode.encode_texts(frame.limit(0))) == []


def test_cuts_lie_in_no_token_and_round_trip():
    coder = encode.Encoder(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken")
    raw = "Ünïcödé/\\x00::zz".encode() + bytes(range(256))
    parts = coder.cuts(raw)
    assert b"".join(parts) == raw and len(parts) > 1
    assert [i for p in parts for i in coder.bpe(p)] == list(coder.bpe(raw))
    text = "word " * 30 + "\n\n end  "
    assert [i for w in encode.windows(text, 11) for i in coder.encode(w)] == coder.encode(text)


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(encode, "CACHE_ENTRIES", 500)
    coder = encode.Encoder(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken")
    rnd = random.Random(6)
    for _ in range(60):  # no blanks, so that every piece is longer than those remembered
        text = "".join(rnd.choice("äö日本語абвαβγ가나") + rnd.choice("xyzw") * rnd.randint(1, 5) for _ in range(120))
        assert coder.encode(text) == coder.public(text) or len(coder.pieces(text)) > 1
        assert len(coder.fragments) <= 500 and len(coder) <= 500


# ---------------------------------------------------------------- leaks


def brute_leaks(docs, items, run=leakage.RUN_WORDS):
    out = []
    for doc, text in docs:
        w = leakage.words(text or "")
        grams = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for item, t in items:
            v = leakage.words(t)
            if any(tuple(v[k : k + run]) in grams for k in range(len(v) - run + 1)):
                out.append((doc, item))
            elif v and len(w):
                code = {x: i for i, x in enumerate({*v, *w})}
                if leakage.distance(np.array([code[x] for x in v]), np.array([code[x] for x in w])) <= len(v) // leakage.WORDS_PER_EDIT and len(v) >= leakage.SEED_WORDS:
                    out.append((doc, item))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_leaks_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    text = lambda n: [f"w{rnd.randint(0, 60)}" for _ in range(n)]
    items = [(k, " ".join(text(rnd.randint(30, 60)))) for k in range(8)]
    docs = []
    for k in range(40):
        words = items[rnd.randrange(8)][1].split()
        kind = k % 4
        if kind == 0:
            size = rnd.choice([20, 23, 24, 26])
            lo = rnd.randint(0, len(words) - size)
            part = [w.upper() for w in words[lo : lo + size]]
        elif kind == 1:
            part = [rnd.choice([w, w, w, w, w, w, w, w, w, w, "zz", f"{w} yy"]) for w in words]
        elif kind == 2:
            part = [f"<i>{w}</i>" if rnd.random() < 0.3 else f"**{w}**" for w in words]
        else:
            part = [w for w in words if rnd.random() > 0.3]
        docs.append((k, " ".join(text(30) + part + text(30))))
    docs += [(90, None), (91, ""), (92, "w1"), (93, items[0][1] + " ...")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id long")
    held = spark.createDataFrame([*items, (None, "x y z"), (50, None)], "item_id long, text string")
    want = brute_leaks(docs, items)
    assert rows(leakage.find_leaks(frame, held)) == want
    assert rows(leakage.find_leaks(frame, held, automaton_words=100)) == want  # several automata
    assert rows(leakage.find_leaks(frame.limit(0), held)) == [] and rows(leakage.find_leaks(frame, held.limit(0))) == []


def test_markup_of_any_length_is_no_word():
    body = [f"w{k}" for k in range(40)]
    item = [(7, " ".join(body))]
    auto = leakage.Automaton(item)
    href = "https://a.example/" + "x/y?" * 1500
    for mark in (f'<a href="{href}" title="two words">', f"<{href}>", "<br\n class='a b' />", f"[x]({href})"):
        text = " ".join(body[:20]) + f" {mark} " + " ".join(body[20:])
        assert leakage.words(text) == body[:20] + (["x"] if mark.startswith("[") else []) + body[20:], mark[:20]
    assert auto.leaks(" ".join(body[:20]) + f' <a href="{href}">' + " ".join(body[20:])).tolist() == [0]
    for text in ("<a " * 60_000, "<a b=" * 60_000, "](" * 90_000, "<" * 200_000, "<a b='" * 50_000):
        leakage.words(text)  # in proportion to the length
    assert leakage.words("if a < b and c > d") == "if a b and c d".split()


def test_spans_are_removed(spark):
    rnd = random.Random(12)
    item = [f"w{rnd.randint(0, 10**6)}" for _ in range(60)]
    changed = list(item)
    for k in (5, 17, 29, 41, 53):
        changed[k] = "other"
    docs = {
        1: "Before it. " + " ".join(item[10:40]).title() + ", and after it.",
        2: "One <b>" + " ".join(changed) + "</b> two.",
        3: " ".join(item[:20]) + " is too short.",
        4: None,
        5: "",
        6: " ".join(item) + " x " + " ".join(item),
    }
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    held = spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.removed) for r in leakage.remove_leaks(frame, held).collect()}
    assert got == {1: ("Before it.  and after it.", 30), 2: ("One <b></b> two.", 60), 3: (docs[3], 0), 4: (None, 0), 5: ("", 0), 6: (" x ", 120)}
    assert leakage.find_leaks(leakage.remove_leaks(frame, held), held).count() == 0
    assert leakage.remove_leaks(frame.limit(0), held).count() == 0
    for text in ("caf&eacute; ½ x\u00ady AT&amp;T <i>a</i> [b](c)", "日本語 e\u0301t"):
        assert leakage.located(text)[0] == leakage.words(text)


# ---------------------------------------------------------------- stuffing

PROSE = "The {} keeps a list of all names, so that it can be read again when the {} is rebuilt. We have not seen why the {} fails. "


def test_stuffed_pages(spark):
    prose = "".join(PROSE.format(a, b, c) for a, b, c in [("index", "store", "cache"), ("queue", "graph", "lease"), ("node", "edge", "page")])
    kw = ["cheap code review", "best graph tool", "fast static check", "buy merge bot"]
    rnd = random.Random(3)
    bad = {
        1: ", ".join(rnd.choice(kw) for _ in range(60)),
        2: " ".join(f"#{rnd.choice(['rust', 'ide', 'sale', 'ci'])}" for _ in range(50)),
        3: "\n".join(f"https://a.example/{k}" for k in range(30)),
        4: "\n".join(f"- [{rnd.choice(kw)} {k}](https://a.example/x/{k})" for k in range(30)),
        5: PROSE.format("a1", "b1", "c1") + " | ".join(rnd.choice(kw) for _ in range(60)).upper(),
        6: "\n".join(f"{rnd.choice(kw).title()} - SKU {rnd.randint(1, 99999)} - {rnd.randint(1, 99)},99 - {rnd.choice(kw)}, {rnd.choice(kw)}" for _ in range(20)),
    }
    good = {
        11: prose,
        12: prose + "\n\nTags: #rust #ide\n\n## See also\n\n- [x](https://a.example/1)\n",
        13: "\n".join(f"* [item {k}](https://a.example/{k}): The {k} item was read before we could see which of the lists is old." for k in range(12)),
        14: "```\n" + "buy merge bot\n" * 40 + "```\n",
        15: "| a | b |\n|---|---|\n" + "| run | 12 |\n" * 40,
        16: "\n".join(f"1748492{k} INFO src/a.c::f score={k}" for k in range(100, 140)),
        17: None,
        18: "",
        19: "  \n ",
    }
    frame = spark.createDataFrame([(k, t, 0.1) for k, t in {**bad, **good}.items()] + [(1, bad[1], 0.2), (None, bad[1], 0.3)], "doc_id long, text string, share double")
    assert rows(stuffing.find_stuffed(frame).select("doc_id")) == sorted([(k,) for k in bad], key=repr)
    assert rows(stuffing.find_stuffed(frame.limit(0))) == []


def test_salad_and_single_keywords(spark):
    rnd = random.Random(8)
    talo = "Vanha talo seisoi joen rannalla jo ennen kuin kylä rakennettiin. Kukaan ei enää muista miksi se {} jätettiin tyhjäksi sodan jälkeen. "
    names = ["mylly", "tupa", "sauna", "aitta", "navetta", "kirkko"]
    salad = ["review", "cheap", "static", "merge"]
    shuffled = lambda: " ".join(rnd.choice(salad) for _ in range(9)).capitalize() + ". "
    docs = {k: talo.format(n) + "Ei {}.".format(n) for k, n in enumerate(names)}
    docs |= {10: "".join(shuffled() for _ in range(12)), 11: "\n".join(rnd.choice(salad) for _ in range(60)), 12: talo.format("mylly") * 3}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert rows(stuffing.find_stuffed(frame).select("doc_id")) == [(10,), (11,)]


def test_salad_of_many_words(spark):
    rnd = random.Random(5)
    words = [a + b for a in ("code", "graph", "merge", "lint", "cloud", "agile") for b in ("pro", "bot", "hub", "fast", "buy", "top")]
    prose = lambda: "".join(PROSE.format(*(rnd.choice(words) for _ in range(3))) for _ in range(40)).replace(". ", ".\n")
    long, in_order = prose(), [" ".join(words[k : k + 12]) for k in range(0, 36, 12)]
    salads = {1: 24, 2: 36}
    docs = {k: " ".join(rnd.choice(words[:n]) for _ in range(8 * n)) for k, n in salads.items()}
    for text in docs.values():
        page = stuffing.read_page(text)
        often = stuffing._marked(page, None)
        _, first, second = page.neighbours()
        times = np.unique(stuffing.unordered(first, second), return_counts=True)[1]
        assert often.mean() > 0.9 and times[times >= stuffing.REPEATS].sum() < 0.3 * len(often)  # hardly a pair is repeated, but no word is cleared unseen
    docs |= {10: long, 11: "".join(f"{PROSE.format('a', x, 'b')}Then {in_order[k % 3]} came. " for k, x in enumerate(words)), 12: prose()}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert rows(stuffing.find_stuffed(frame).select("doc_id")) == [(1,), (2,)]


def test_mutual_information_of_the_corpus(spark):
    frame = spark.createDataFrame([(k, " ".join("abcd"[(k + j) % 4] for j in range(4001))) for k in range(4)], "doc_id long, text string")
    got = stuffing.corpus_totals(stuffing.corpus_counts(stuffing.read_corpus(frame, 0.5))).first()
    assert (got.words, got.pairs) == (16004, 16000) and abs(got.mutual - np.log(4)) < 1e-3  # every word tells the next of four


def test_links_of_any_length(spark):
    long = "x" * 9000
    page = stuffing.read_page(f'<a href="https://a.example/{long}">a b</a>\n[{"word " * 900}](https://a.example/{long})')
    assert [line.links for line in page.lines] == [1, 1] and not len(page.codes)
    assert [len(x) for x in page.labels] == [2, 900]
    for text in ("[" * 200_000, "<a " * 60_000, "](" * 90_000, "![" * 90_000 + "https://"):
        stuffing.read_page(text)  # in proportion to the length


def test_corpus_counts_are_whole(spark):
    data = [(k, f"alpha beta gamma{k % 3}. Beta alpha beta", datetime(2024, 1, 1)) for k in range(50)]
    frame = spark.createDataFrame(data, "doc_id long, text string, created_at timestamp")
    counts = stuffing.corpus_counts(stuffing.read_corpus(frame.repartition(5), 0.5)).collect()
    words = {r.code: r.up for r in counts if r.down is None}
    assert words[stuffing.hashes(["alpha"]).view(np.int64)[0]] == 100 and sum(words.values()) == 300
    assert sum(r.up + r.down for r in counts if r.down is not None) == 50 * 5
