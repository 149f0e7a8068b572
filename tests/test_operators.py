"""Graph, search, parsers and row operators on small graphs, with golden values and a property test."""

import random

import pytest

from graphloom.errors import CodedError
from graphloom.functions import parsers, text
from graphloom.operators import extract, graph, rows, search
from graphloom.sources import changes

NODES = [(1, "function:root", "pkg/root.py"), (2, "function:middle", "pkg/middle.py"), (3, "function:leaf", "pkg/leaf.py"), (4, "function:other", "other.py")]
EDGES = [(1, 1, 2, "calls"), (2, 2, 3, "contains"), (3, 1, 4, "imports")]


@pytest.fixture(scope="module")
def g(spark):
    return spark.createDataFrame(NODES, "node_id long, canonical_key string, file_path string"), spark.createDataFrame(EDGES, "edge_id long, from_node_id long, to_node_id long, edge_type string")


@pytest.mark.parametrize(
    ("seeds", "options", "paths", "coverage", "truncated"),
    [
        ([1], {"depth": 2, "edge_types": ("calls",)}, [[1, 2]], {"nodes": 2, "edges": 1}, False),
        ([3], {"depth": 2, "direction": "in"}, [[3, 2], [3, 2, 1]], {"nodes": 3, "edges": 2}, False),
        ([2], {"depth": 1, "direction": "both"}, [[2, 1], [2, 3]], {"nodes": 3, "edges": 2}, False),
        ([1], {"depth": 2, "scope": {"canonical_keys": ["function:middle"], "file_paths": ["pkg/middle.py"]}}, [[1, 2]], {"nodes": 2, "edges": 1}, False),
        ([1], {"depth": 2, "node_budget": 2}, [[1, 2]], {"nodes": 2, "edges": 1}, True),
        ([1], {"depth": 1, "edge_budget": 1}, [[1, 2]], {"nodes": 2, "edges": 1}, True),
        ([1], {"depth": 1, "edge_budget": 0}, [], {"nodes": 1, "edges": 0}, True),
        ([99], {"depth": 1}, [], {"nodes": 1, "edges": 0}, False),
    ],
)
def test_expand(g, seeds, options, paths, coverage, truncated):
    out = graph.expand(*g, seeds, **options)
    assert (out.paths, out.coverage, out.truncated) == (paths, coverage, truncated)


def naive(edges, seeds, depth, node_budget, edge_budget, direction, scope):
    """The rules of the traversal, edge by edge."""
    seen, frontier, out, before = list(dict.fromkeys(seeds)), list(dict.fromkeys(seeds)), [], {}
    for _ in range(depth):
        following = []
        for e, a, b, _ in sorted(edges):
            if direction in ("out", "both") and a in frontier:
                current, other = a, b
            elif direction in ("in", "both") and b in frontier:
                current, other = b, a
            else:
                continue
            if len(out) >= edge_budget:
                return out, seen, True
            if other not in seen:
                if scope and other not in scope:
                    continue
                if len(seen) >= node_budget:
                    return out, seen, True
                seen.append(other)
                following.append(other)
            out.append(e)
        frontier = following
    del before
    return out, seen, False


def test_expand_against_the_rules(spark):
    rng = random.Random(8)
    for _ in range(6):
        edges = [(i, rng.randint(1, 9), rng.randint(1, 9), "t") for i in range(1, 16)]
        scope = rng.choice([None, [1, 2, 3, 4, 5, 6]])
        options = {"depth": rng.randint(1, 3), "node_budget": rng.randint(1, 9), "edge_budget": rng.randint(0, 12), "direction": rng.choice(graph.DIRECTIONS)}
        nodes = spark.createDataFrame([(i, f"k{i}", f"f{i}") for i in range(1, 10)], "node_id long, canonical_key string, file_path string")
        df = spark.createDataFrame(edges, "edge_id long, from_node_id long, to_node_id long, edge_type string")
        found = graph.expand(nodes, df, [1, 2], scope={"canonical_keys": [f"k{i}" for i in scope]} if scope else None, **options)
        ids, seen, truncated = naive(edges, [1, 2], scope=scope, **options)
        assert ([e["edge_id"] for e in found.edges], found.nodes, found.truncated) == (ids, len(seen), truncated)


def test_closure_and_errors(spark, g):
    seeds = spark.createDataFrame([(3,)], "node_id long")
    assert sorted(r.node_id for r in graph.closure(g[1], seeds).collect()) == [1, 2, 3, 4]
    with pytest.raises(CodedError, match="INVALID_DIRECTION"):
        graph.expand(*g, [1], direction="sideways")


@pytest.mark.parametrize(
    ("query", "expected"),
    [("order", [1, 2]), ("lookup_order", [1]), ('"service.run"', [3]), ("ord*", [1, 2, 4]), ("order NOT lookup", [2]), ("lookup OR run", [1, 3]), ("name : order", [1, 2]), ("file_path : order", []), ("cafe", [4]), ("order AND (lookup OR cafe)", [1]), ("NEAR(lookup order, 0)", [1]), ("NEAR(order lookup, 0)", [1]), ("lookup py", [1]), ('"order lookup"', []), ("^order", [2]), ("lookup + order", [1]), ("name : lookup + ord*", [1]), ("{name file_path} : order", [1, 2]), ("- name : run", [3]), ("-{name qualified_name file_path} : run", []), ("name : (file_path : lookup)", []), ("^ lookup", [1])],
)
def test_search(spark, query, expected):
    nodes = spark.createDataFrame([(1, "lookup_order", "lookup_order", "a/lookup.py", ""), (2, "order", "x.order", "b.py", None), (3, "run", "service.run", "c.py", ""), (4, "Café ordinal", None, "d", "")], "node_id long, name string, qualified_name string, file_path string, content_hash string")
    found = search.search(nodes, search.index(nodes), query)
    assert [r.node_id for r in found.collect()] == expected


@pytest.mark.parametrize("query", ["", "service.run", "a-b", "(a", "a OR", "nothing : x", "NEAR(a, b", "NOT a", "- a", "{name : x", "a +", "^", "{nothing} : x"])
def test_search_syntax(query):
    with pytest.raises(CodedError, match="QUERY_SYNTAX_INVALID"):
        search.parse(query)


def test_index_unavailable(spark):
    nodes = spark.createDataFrame([], "node_id long, name string, qualified_name string, file_path string, content_hash string")
    with pytest.raises(CodedError, match="INDEX_UNAVAILABLE"):
        search.search_or_fail(nodes, search.index(nodes), "x")


def test_change_lines(spark):
    lines = ["M\tsrc/a.py", "A\tb.py", "D\tc.py", "R100\told.py\tnew.py", "broken", "C75\tx\ty"]
    found = changes.parsed(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in found] == [("M", "src/a.py", None), ("A", "b.py", None), ("D", "c.py", None), ("R", "new.py", "old.py"), ("C", "y", "x")]


def parsed(path, source):
    return parsers.Registry.default().parse(path, source)


def relations(found):
    return {(e["edge_type"], e["source_key"], e["target_key"]) for e in found.edges}


def test_python_scopes():
    found = parsed("pkg/service.py", "import os as o\nfrom .tools import helper as h\nfrom . import near\nclass A:\n    def run(self):\n        return h(run())\n    def other(self):\n        def inner():\n            inner2()\n        return inner()\ndef go():\n    import json\n    return [A() for _ in x], (lambda: go())\n")
    got = relations(found)
    assert {("imports", "module:pkg.service", "module:os"), ("imports", "module:pkg.service", "module:pkg.tools"), ("imports", "module:pkg.service", "module:pkg.near"), ("imports", "function:pkg.service.go", "module:json")} <= got
    assert ("calls", "function:pkg.service.A.run", "import:pkg.tools.helper") in got and ("calls", "function:pkg.service.A.run", "unresolved:run") in got
    assert ("calls", "function:pkg.service.A.other", "function:pkg.service.A.other.inner") in got and ("calls", "function:pkg.service.go", "class:pkg.service.A") in got
    assert ("calls", "function:pkg.service.go", "function:pkg.service.go") not in got
    assert parsed("pkg/__init__.py", "").nodes[0]["canonical_key"] == "module:pkg"


def test_pattern_languages():
    java = parsed("Hello.java", "package demo;\nimport java.util.List;\n// class No {}\npublic class Hello extends Base implements Runs {\n  public void run() { new Thing(); obj[method](); }\n}\ninterface Runs {}\n")
    got = relations(java)
    root = "demo@Hello.java"
    assert {("contains", f"class:{root}.Hello", f"method:{root}.Hello.run"), ("extends", f"class:{root}.Hello", "external:Base"), ("implements", f"class:{root}.Hello", f"interface:{root}.Runs"), ("imports", f"package:{root}", f"import:{root}.java.util.List"), ("calls", f"method:{root}.Hello.run", "external:Thing"), ("calls", f"method:{root}.Hello.run", "unresolved:obj[method]")} <= got
    assert not any("No" in n["name"] for n in java.nodes)
    go = parsed("main.go", 'package main\nimport (\n "fmt"\n h "net/http"\n)\ntype S struct {}\ntype I interface {}\nfunc (s S) M() { F() }\nfunc F() {}\n')
    assert {n["name"] for n in go.nodes if n["kind"] == "import"} == {"fmt", "net/http"}
    assert {n["kind"] for n in go.nodes} == {"package", "struct", "interface", "method", "function", "import"} and ("calls", "method:main@main.go.M", "function:main@main.go.F") in relations(go)
    ts = parsed("app.ts", "import { a as b } from './x'\nexport class A { run() { b() } }\nexport function f() {}\n")
    assert {n["kind"] for n in ts.nodes} == {"module", "class", "method", "function", "import", "export"}
    assert all(n["payload"]["language"] == "typescript" for n in ts.nodes)


def test_diagnostics_and_registry():
    assert parsed("a.txt", "x").diagnostics[0]["code"] == "UNSUPPORTED_FILE_SUFFIX"
    assert parsed("a.py", "def (").diagnostics[0]["code"] == "PYTHON_SYNTAX_ERROR"
    assert parsed("a.java", "class A {").diagnostics[0]["code"] == "HEURISTIC_PARSE_PARTIAL" and not parsed("a.java", "  ").nodes
    twice = parsed("a.java", "class A {}\nclass A {}\n")
    assert len({n["canonical_key"] for n in twice.nodes}) == 3
    registry = parsers.Registry.default()
    with pytest.raises(ValueError, match=r"\.py"):
        registry.register(type("P", (), {"suffixes": ("zig", "py")})())
    assert registry.detect("a.zig") is None and registry.summary()["go"] == "go-heuristic-1"
    assert parsers.masked('a = "// no" # yes\nb', False) == 'a = "// no"      \nb' and parsers.masked("'x' /* y\n */ z", True) == "             z".replace("             ", "        \n    ", 1)


def test_extraction_frame(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    g()\n"), ("b.txt", None)], "path string, source string")
    found = extract.parsed(files)
    assert extract.nodes(found).count() == 2 and extract.edges(found).where("symbol = 'g' and resolution = 'unresolved'").count() == 1 and extract.diagnostics(found).count() == 1


def test_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n"), (None, 2, "m")], "k string, i int, v string")
    assert [tuple(r) for r in rows.duplicate_keys(df, "k").collect()] == [("a", 2)]
    assert {r.v for r in rows.latest(df, ["k"], "i").collect()} == {"y", "z", "m"}
    requests = spark.createDataFrame([(1, 5, 9), (2, None, 9)], "request_id int, expected_parent int, snapshot_id int")
    none, some = spark.createDataFrame([], "active int"), spark.createDataFrame([(5,)], "active int")
    assert [r.accepted for r in rows.swapped(none, requests).orderBy("request_id").collect()] == [True, True]
    assert [r.accepted for r in rows.swapped(some, requests).orderBy("request_id").collect()] == [True, False]


def test_text():
    assert text.fold("Café_au LAIT2") == ["cafe", "au", "lait2"]
    assert text.script_targets("web/a.ts", "./b")[0] == "web/b.js" and text.script_targets("web/a.ts", "../c.ts") == ["c.ts"]
    assert text.canonical_json({"b": 1, "a": "é"}) == '{"a": "\\u00e9", "b": 1}'


def test_stream(spark, tmp_path, g):
    from graphloom.streaming import changes as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("M\tpkg/leaf.py\nR100\tother.py\tnew.py\n")
    run = stream.affected(stream.lines(spark, str(tmp_path / "in")), g[0]).writeStream.format("memory").queryName("hit").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    run.awaitTermination(60)
    assert sorted(r.node_id for r in spark.table("hit").collect()) == [3, 4]


def test_a_cluster_names_its_checkpoint_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda name, usual: usual)})()

    with pytest.raises(CodedError) as refused:
        graph.shared_folder(Session())
    assert refused.value.code == "CHECKPOINT_DIR_REQUIRED"
    assert graph.shared_folder(spark)


def test_documents_and_gates_of_no_rows(spark):
    none = spark.createDataFrame([], "kind string, n long, at long")
    line = none["n"].cast("string")
    assert [tuple(r) for r in rows.document(none, [], line, "n", "at").collect()] == [("", [])] and rows.document(none, ["kind"], line, "n").isEmpty()
    assert tuple(rows.keyless(none, "kind").first()) == (0, 0)
    some = spark.createDataFrame([("a", 2, 7), ("a", 1, 7), (None, 3, None)], "kind string, n long, at long")
    assert [tuple(r) for r in rows.document(some, [], some["n"].cast("string"), "n", "at").collect()] == [("1\n2\n3", [7])]
    assert tuple(rows.keyless(some, "kind").first()) == (1, 3) and tuple(rows.keyless(some, "kind", some["n"] < 3).first()) == (0, 2)
    assert tuple(rows.diagnostic_counts(spark.createDataFrame([(True,), (False,), (True,)], "supported boolean")).first()) == (3, 1, 2)
