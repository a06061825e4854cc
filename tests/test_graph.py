"""Operators on small inputs: weights, terms, roles, resolution, a sample project, slices, sync."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relgraph import build, sinks
from relgraph.extract import extract
from relgraph.functions import text as tx
from relgraph.functions import weights as wt
from relgraph.operators import graph, propagate, resolve, slicing, sync
from relgraph.sources.tree import read_tree
from relgraph.streaming.sync import SCHEMA, follow

PROJECT = {
    "main.py": '"""Starts the shop."""\nfrom settings import PORT\nfrom routes import ROUTES\n\n\ndef run():\n    return ROUTES, PORT\n',
    "settings.py": '"""Values that everything needs."""\nPORT = 80\nNAME = "shop"\n',
    "routes.py": '"""Maps addresses to pages."""\nfrom login import sign_in, sign_out\n\nROUTES = {"/in": sign_in, "/out": sign_out}\n\n\n@app.get("/users/{id}")\ndef user_page(id):\n    return id\n',
    "login.py": '"""Signs people in. And out."""\nimport hashlib\nfrom store.base import Table\n\n\nclass Users(Table):\n    pass\n\n\ndef sign_in(name):\n    return Users().find(name) or Table.find(name)\n\n\ndef sign_out(name):\n    return None\n',
    "store/__init__.py": "",
    "store/base.py": "class Table:\n    def find(self, name):\n        return name\n",
    "web/app.ts": "import { call } from './net';\nexport function show() { return fetch('/users/7/orders'); }\n",
    "web/net.ts": "// network\nexport const call = 1;\n",
    "config.json": "{}",
    "notes.md": "# notes",
}


@pytest.fixture
def project(tmp_path):
    for name, content in PROJECT.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    return tmp_path


@pytest.mark.parametrize(
    ("facts", "expected"),
    [((0, 0, 0, 0, 0), 3), ((0, 0, 0, 1, 0), 4), ((1, 0, 0, 0, 0), 4), ((2, 0, 0, 0, 0), 4), ((1, 1, 0, 0, 0), 5), ((2, 2, 0, 0, 0), 6), ((1, 0, 1, 0, 0), 8), ((2, 5, 1, 0, 0), 10), ((5, 9, 0, 0, 1), 6)],
)
def test_weight(spark, facts, expected):
    args = [F.lit(v) for v in facts[:2]] + [F.lit(bool(v)) for v in facts[2:]]
    row = spark.range(1).select(wt.weight(*args).alias("w"), wt.package_cap(wt.weight(*args), F.lit("a/__init__.py"), F.lit("b.py")).alias("c")).first()
    assert (row["w"], row["c"]) == (expected, 1)


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(tx.terms(F.lit("HTTPServer snake_case X1"))) == ["httpserver", "http", "server", "snake", "snake", "case", "case", "x1", "x1"]
    assert one(tx.query_terms(F.lit("what is the"))) == ["what", "is", "the"]
    assert [one(tx.normal_route(F.lit(r))) for r in ("/users/{id}", "/u/:id/x", "/v/12/", "/", "/a/1/2/3")] == ["/users/*", "/u/*/x", "/v/*", "/", "/a/*/*/*"]
    assert one(tx.route_matches(F.lit("/users/*"), F.lit("/users/7/orders"))) and not one(tx.route_matches(F.lit("/users/*"), F.lit("/users")))
    assert [round(one(tx.adaptive_cutoff(F.lit(n))), 6) for n in (200, 800, 10**9)] == [0.12, 0.19, 0.28]
    assert one(tx.first_sentence(F.lit("One  two.\nThree."))) == "One two." and len(one(tx.first_sentence(F.lit("x" * 200)))) == 140
    assert [one(tx.without_extension(F.lit(p))) for p in ("a/b.tar.gz", ".env", "x")] == ["a/b.tar", ".env", "x"]


@pytest.mark.parametrize(
    ("path", "kind", "always"),
    [("a/config.json", "config", True), ("config.py", "config", False), ("tests/test_x.py", "test", False), ("src/user_controller.py", "controller", False), ("adblock.py", "database", False), ("prototype.py", "types", False), ("main.py", "entrypoint", False), ("readme.md", "doc", False), ("views/home.py", "view", False), ("x.py", "other", False)],
)
def test_role(spark, path, kind, always):
    k, a = tx.role(F.lit(path))
    assert tuple(spark.range(1).select(k, a).first()) == (kind, always)


RESOLUTION = [
    ("a/b/x.py", "python", "m", 2, ["f"], ["a/m.py"], {"a/m.py"}, True),
    ("a/x.py", "python", "", 1, ["y"], ["a/y.py"], {"a/y.py"}, True),
    ("x.py", "python", "json", 0, [], ["json.py"], set(), True),
    ("x.py", "python", "pkg", 0, ["s"], ["pkg/s.py"], {"pkg/s.py"}, True),
    ("src/a.ts", "typescript", "../lib/u", 2, [], ["lib/u.ts"], {"lib/u.ts"}, True),
    ("src/a.ts", "typescript", "./d", 1, [], ["src/d/index.tsx"], {"src/d/index.tsx"}, True),
    ("src/a.ts", "typescript", "react", 0, [], ["react.ts"], set(), True),
    ("src/a.ts", "typescript", "lib/u", 0, [], ["lib/u.ts"], {"lib/u.ts"}, False),
    ("m.go", "go", "x.io/p/internal/auth", 0, [], ["internal/auth/a.go", "internal/auth/b.go"], {"internal/auth/a.go", "internal/auth/b.go"}, False),
    ("A.java", "java", "com.x.Foo", 0, [], ["src/com/x/Foo.java"], {"src/com/x/Foo.java"}, True),
    ("A.java", "java", "com.x.*", 0, [], ["src/com/x/Foo.java", "src/com/x/Bar.java"], {"src/com/x/Foo.java", "src/com/x/Bar.java"}, True),
    ("a.rs", "rust", "n", 0, [], ["n/mod.rs"], {"n/mod.rs"}, True),
    ("a.rs", "rust", "crate::n::T", 0, [], ["n.rs"], {"n.rs"}, False),
    ("d/a.c", "c", "../h/z.h", 0, [], ["h/z.h"], {"h/z.h"}, True),
    ("d/a.c", "c", "q/z.h", 0, [], ["other/z.h"], {"other/z.h"}, False),
]


def test_resolution(spark):
    for path, language, module, level, symbols, tree, expected, exact in RESOLUTION:
        nodes = spark.createDataFrame([(p,) for p in [path, *tree]], "path string").select("path", tx.language(F.col("path")).alias("language"))
        imports = spark.createDataFrame([(path, language, 0, module, level, symbols, level > 0 and language == "python")], "path string, language string, import_seq int, module string, level int, symbols array<string>, is_relative boolean")
        rows = resolve.resolve(imports, nodes).collect()
        assert {r["target"] for r in rows} == expected, (path, module)
        assert all(r["exact"] == exact for r in rows)


def test_extractors():
    js = extract("javascript", "/** Doc. */\nimport A, { b as c } from './m';\nimport './side';\nconst { d } = require('x/y');\nexport * from '../z';\nexport class K extends A {}\nc(); c();\naxios.get('/api/u');")
    assert [i.module for i in js.imports] == ["./m", "./side", "x/y", "../z"] and js.imports[0].local_names == ["c", "A"]
    assert js.has_inheritance and js.usage_counts["c"] == 2 and js.http_calls == ["/api/u"] and js.docstring == "Doc." and js.defined_symbols == ["K"]
    go = extract("go", '// Doc\npackage m\nimport (\n\tu "x/util"\n\t"fmt"\n)\nimport "net/http"\nfunc (s *T) Run() {}\ntype T struct {}\n')
    assert [i.module for i in go.imports] == ["x/util", "fmt", "net/http"] and go.defined_symbols == ["Run", "T"]
    rust = extract("rust", "//! Doc\npub mod n;\nuse crate::a::B;\nuse std::io;\npub async fn f() {}\nstruct S;\n")
    assert [i.module for i in rust.imports] == ["n", "crate::a::B"] and rust.defined_symbols == ["f", "S"]
    java = extract("java", "/** D. */\nimport java.util.List;\nimport com.x.Base;\nimport com.y.*;\npublic class A extends Base {}\n")
    assert [i.module for i in java.imports] == ["com.x.Base", "com.y.*"] and java.has_inheritance
    c = extract("c", '// Doc\n#include <stdio.h>\n#include "a.h"\nstruct P { int x; };\nint f(int a) {\n if (a) { return 1; }\n}\nint g(int);\n')
    assert [i.module for i in c.imports] == ["a.h"] and c.defined_symbols == ["P", "f"]
    assert extract("python", "def (").error.startswith("syntax") and extract("python", " ").imports == []
    counted = extract("python", "from m import db\ndb.a\ndb.a.b\ndb\n")
    assert counted.usage_counts == {"db": 2 + 3 + 1}


def test_hidden_names(spark, tmp_path):
    for name in ["a.py", "pkg/__init__.py", "pkg/_util.py", "_priv/m.py", "pkg/c.json", ".env", "pkg/.hid/h.py", "node_modules/x.js", "b.min.js"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / "bin.py").write_bytes(b"a\0b")
    assert [r["path"] for r in read_tree(spark, str(tmp_path)).orderBy("path").collect()] == ["_priv/m.py", "a.py", "pkg/__init__.py", "pkg/_util.py", "pkg/c.json"]


def test_project(spark, project):
    g = build.build_tree(spark, str(project))
    nodes = {r["path"]: r for r in g.nodes.collect()}
    assert set(nodes) == set(PROJECT) - {"notes.md"}
    assert nodes["login.py"]["description"] == "Signs people in." and nodes["config.json"]["always_include"]
    edges = {(r["src"], r["dst"]): r for r in g.edges.collect()}
    assert {k: e["weight"] for k, e in edges.items()} == {("main.py", "settings.py"): 5, ("main.py", "routes.py"): 5, ("routes.py", "login.py"): 6, ("login.py", "store/base.py"): 9, ("web/app.ts", "web/net.ts"): 4, ("web/app.ts", "routes.py"): 4}
    assert edges["login.py", "store/base.py"]["relations"] == ["inherits", "calls", "imports"] and edges["web/app.ts", "routes.py"]["relations"] == ["http"]
    text = build.answer(g, "fix the login bug")
    assert "1. login.py (1.0)" in text and "direct metadata match" in text and "## login.py [whole]" in text
    assert "Nothing here matches" in build.answer(g, "zebra quantum") and "general question" in build.answer(g, "what is zebra")
    assert "Hubs" in sinks.repo_map(g) and "Most linked" in sinks.report(g) and "login.py" in sinks.viewer(g, "<x>")
    assert sinks.node_link(g).count() == len(nodes) + len(edges)


def test_update_equals_build(spark, project):
    old = build.build_tree(spark, str(project))
    same, told = build.update(spark, old, str(project))
    assert same is old and told.first()["nodes_changed"] == 0
    (project / "login.py").write_text("from settings import NAME\n\n\ndef sign_in(x):\n    return NAME\n\n\ndef sign_out(x):\n    return x\n")
    (project / "new.py").write_text("import login\n")
    os.remove(project / "web" / "net.ts")
    os.utime(project / "settings.py", (1, 1))
    now, told = build.update(spark, old, str(project))
    whole = build.build_tree(spark, str(project))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(now.nodes.select(*whole.nodes.columns)) == key(whole.nodes) and key(now.edges) == key(whole.edges)
    report = told.first()
    assert (report["nodes_added"], report["nodes_changed"], report["nodes_deleted"], report["nodes_touched"]) == (1, 1, 1, 1)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(1, 10)), min_size=1, max_size=20), st.sampled_from([0.066, 0.2]))
def test_spread_is_best_path(spark, links, cutoff):
    edges = {(f"n{a}", f"n{b}"): w for a, b, w in links if a != b}
    rows = spark.createDataFrame([(a, b, w, ["imports"]) for (a, b), w in edges.items()], "src string, dst string, weight int, relations array<string>")
    seeds = spark.createDataFrame([(1, "n0", 1.0), (1, "n1", 0.4)], "query_id int, path string, relevance double")
    got = {r["path"]: r["relevance"] for r in propagate.spread(rows, seeds, spark.createDataFrame([(1, cutoff)], "query_id int, cutoff double")).collect()}
    best, todo = {"n0": 1.0, "n1": 0.4}, ["n0", "n1"]
    while todo:
        n = todo.pop(0)
        for (a, b), w in edges.items():
            for x, y in ((a, b), (b, a)):
                v = best[n] * min(0.95, w / 10)
                if x == n and v >= cutoff and v > best.get(y, 0) + 1e-9:
                    best[y] = v
                    todo.append(y)
    assert got == pytest.approx(best)


def test_slices():
    body = "\n".join(f"    x{i} = {i}" for i in range(60))
    text = f"import os\n\n\ndef alpha_beta():\n{body}\n\n\n@wrap\nclass Other:\n{body}\n"
    out, n, mode = slicing.slice_text("a.py", text, "the alpha", 280)
    assert mode == "sliced" and n <= 340 and "alpha_beta✓[4-64]" in out and "Other[67-128]" in out and "class Other [" not in out
    assert slicing.slice_text("a.py", text, "q", 10**6)[2] == "whole" and slicing.slice_text("a.txt", text, "q", 10) is None
    found = slicing.brace_symbols("// c\nfunction run(a) {\n  if (a) { b(); }\n}\nconst go = () => {\n};\nfunc (s *T) Method() {\n}\nif (x) {\n}\n")
    assert [(s.name, s.start, s.end) for s in found] == [("run", 2, 4), ("go", 5, 6), ("Method", 7, 8)]


def test_snapshot_changes(spark):
    schema = "path string, size bigint, mtime double, sha256 string"
    old = spark.createDataFrame([("same", 1, 1.0, "a"), ("edit", 1, 1.0, "a"), ("touch", 1, 1.0, "a"), ("gone", 1, 1.0, "a")], schema)
    new = spark.createDataFrame([("same", 1, 1.0, "a"), ("edit", 1, 2.0, "b"), ("touch", 1, 2.0, "a"), ("fresh", 1, 1.0, "c")], schema)
    assert {r["path"]: r["change"] for r in sync.changes(old, new).collect()} == {"edit": "changed", "touch": "touched", "gone": "deleted", "fresh": "added"}


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1.0, "x", False), ("a", 2, 2.0, "y", False), ("b", 1, 1.0, "z", True)], SCHEMA)
    rows.write.parquet(str(tmp_path / "in"))
    follow(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r["path"], r["size"]) for r in spark.read.parquet(str(tmp_path / "out" / "v0")).collect()] == [("a", 2)]


def test_routes_and_degrees(spark):
    nodes = spark.createDataFrame([("s", ["/users/{id}", "/x"], []), ("c", [], ["/users/7/orders", "/users/8", "/y"])], "path string, http_routes array<string>, http_calls array<string>")
    links = graph.route_links(nodes)
    assert [tuple(r) for r in links.collect()] == [("c", "s", 2)]
    empty = spark.createDataFrame([], "src string, dst string, weight int, relations array<string>, confidence string, symbol_count int, usage int")
    assert graph.with_routes(empty, links).first()["weight"] == 5
