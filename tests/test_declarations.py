"""Declarations, imports and calls of every language, and the graph made of them."""

from graphloom.sources import declarations, files
from tests.conftest import rows

TEXTS = {
    "rust": ("use a::b;\npub struct S { x: u8 }\nimpl S {\n    pub fn m(&self) -> u8 {\n        help(1)\n    }\n}\nfn help(x: u8) -> u8 { x }\n", {("import", "a::b", ""), ("struct", "S", ""), ("impl", "S", ""), ("method", "m", "S"), ("call", "help", "m"), ("function", "help", "")}),
    "go": ('package a\nimport (\n\t"fmt"\n)\ntype S struct {\n}\nfunc (s *S) M() {\n\tfmt.Println(f())\n}\n', {("import", "fmt", ""), ("struct", "S", ""), ("call", "Println", "M"), ("call", "f", "M")}),
    "typescript": ("import { a } from './b';\nexport class C {\n  m(x: number): void {\n    g(x);\n  }\n}\nexport const h = async (x) => x;\ninterface I {\n}\n", {("import", "./b", ""), ("class", "C", ""), ("method", "m", "C"), ("call", "g", "m"), ("function", "h", ""), ("interface", "I", "")}),
    "java": ("package a.b;\nimport c.D;\npublic class E {\n  int f(int x) {\n    return g(x);\n  }\n}\n", {("import", "c.D", ""), ("class", "E", ""), ("method", "f", "E"), ("call", "g", "f")}),
    "ruby": ("require 'x'\nclass A\n  def b\n    c(1)\n  end\nend\n", {("import", "x", ""), ("class", "A", ""), ("method", "b", "A"), ("call", "c", "b")}),
    "css": ("@import 'a.css';\n.x .y {\n  --c: red;\n}\n", {("import", "a.css", ""), ("rule", ".x .y", ""), ("constant", "--c", ".x .y")}),
    "markdown": ("# A b\ntext [x](y.md)\n## C\n```py\n# no heading\n```\n", {("heading", "a-b", ""), ("import", "y.md", "a-b"), ("heading", "c", "a-b"), ("code", "py", "c")}),
    "bash": ("source lib.sh\nrun() {\n  echo x\n}\n", {("import", "lib.sh", ""), ("function", "run", "")}),
    "c": ("#include <a.h>\nstatic int f(int x) {\n    return g(x);\n}\n", {("import", "a.h", ""), ("function", "f", ""), ("call", "g", "f")}),
}


def test_lines_of_every_language():
    assert len(declarations.languages()) >= 18
    for language, (text, want) in TEXTS.items():
        got = {row[:3] for row in files.parse_text(text.encode(), language)}
        assert want <= got, (language, want - got)
    assert declarations.language_of("a/b.PY") == "python" and declarations.language_of("Makefile") is None
    assert files.parse_text(b"\xff\xfe", "rust") == [] and files.parse_text(b"x", "unknown") == [] and files.parse_text(b"", "css") == []
    deep = b'{"a":' * 60 + b"1" + b"}" * 60
    assert len(files.parse_text(deep, "json")) == 60


def test_registered_handlers():
    declarations.register("ini", lambda text: [("section", x[1:-1], "", n) for n, x in enumerate(text.split("\n"), 1) if x.startswith("[")], ["ini"])
    assert files.parse_text(b"[a]\nx=1\n[b]", "ini") == [("section", "a", "", 1), ("section", "b", "", 3)] and declarations.language_of("x.ini") == "ini"


def test_graph_of_files(spark):
    data = [("a.py", "python", b"import os\ndef f():\n    g()\n    h()\n\nclass K:\n    def m(self):\n        f()\n", "clash"), ("b.py", "python", b"def h():\n    nowhere()\n", "clash"), ("c.py", "python", None, None)]
    nodes, edges = files.parse_graph(spark.createDataFrame(data, "file string, language string, content binary, name string"))
    assert {r.qn for r in nodes.collect()} == {"a.py", "b.py", "c.py", "a.py::function::f", "a.py::class::K", "a.py::method::m", "b.py::function::h"}
    got = {(r.source, r.target, r.kind, r.tier) for r in edges.collect()}
    assert got == {
        ("a.py", "a.py::function::f", "contains", "high"),
        ("a.py", "a.py::class::K", "contains", "high"),
        ("a.py::class::K", "a.py::method::m", "contains", "high"),
        ("b.py", "b.py::function::h", "contains", "high"),
        ("a.py", "os", "imports", "high"),
        ("a.py::function::f", "g", "calls", "low"),
        ("a.py::function::f", "b.py::function::h", "calls", "medium"),
        ("a.py::method::m", "a.py::function::f", "calls", "high"),
        ("b.py::function::h", "nowhere", "calls", "low"),
    }
    none = spark.createDataFrame([], "file string, language string, content binary")
    assert rows(files.parse_graph(none)[0]) == [] and rows(files.parse_graph(none)[1]) == []
