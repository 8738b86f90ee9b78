import pytest

from loomspan.operators import graph
from loomspan.operators.graph import Graph

NODE = "id string, type string, name string, file_path string, line int, exported boolean"


def make(spark, edges, nodes=None):
    ids = sorted({x for e in edges for x in e[:2]}) if nodes is None else nodes
    n = spark.createDataFrame([(i, "class", i.capitalize(), None, None, True) for i in ids], NODE)
    e = spark.createDataFrame([(f"e{k + 1}", *x) for k, x in enumerate(edges)], "id string, source string, target string, type string")
    return Graph(n, e)


def ids(df):
    return {r.id for r in df.collect()}


def test_find(spark):
    rows = [("1", "class", "UserService", "src/user.ts", 1, True), ("2", "function", "getUser", "src/user.ts", 9, False), ("3", "class", "AuthService", "src/auth.ts", 1, True)]
    g = Graph(spark.createDataFrame(rows, NODE), spark.createDataFrame([], "id string, source string, target string, type string"))
    assert [g.find(kind="class").count(), g.find(path="src/user.ts").count(), g.find(name="service").count(), g.find(pattern="^User").count(), g.find(exported=True).count()] == [2, 2, 2, 1, 2]
    assert g.file_symbols("src/user.ts", include_private=False).count() == 1


def test_related(spark):
    g = make(spark, [("a", "b", "extends"), ("b", "c", "extends"), ("a", "d", "implements")])
    assert ids(g.related("a", 1, "outgoing")) == {"a", "b", "d"}
    assert ids(g.related("a", 2, "outgoing")) == {"a", "b", "c", "d"}
    assert ids(g.related("a", 1, "outgoing", ["extends"])) == {"a", "b"}
    assert ids(g.related("b", 1, "incoming")) == {"a", "b"}
    assert g.related_edges(g.related("a", 1, "outgoing")).count() == 2


def test_breadth_first_where_depth_first_would_miss(spark):
    g = make(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("a", "c", "calls"), ("c", "d", "calls")])
    assert ids(g.related("a", 2, "outgoing")) == {"a", "b", "c", "d"}


def test_path(spark):
    g = make(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls")], ["a", "b", "c", "d", "e"])
    assert g.path("a", "d").head().path == ["a", "b", "c", "d"] and g.path("d", "a").head().path == ["d", "c", "b", "a"]
    assert g.path("a", "e").isEmpty() and g.path("a", "d", 2).isEmpty() and g.path("x", "x").isEmpty() and g.path("a", "a").head().path == ["a"]


def test_calls_and_inheritance(spark):
    g = make(spark, [("main", "helper", "calls"), ("helper", "util", "calls"), ("dog", "mammal", "extends"), ("mammal", "animal", "extends")])
    assert ids(g.callers("helper")) == {"main"} and ids(g.callees("main")) == {"helper"} and ids(g.callers("main")) == set()
    assert ids(g.inheritance("dog")) == {"mammal", "animal"} and ids(g.inheritance("animal", "down")) == {"mammal", "dog"}


def test_upkeep(spark, tmp_path):
    g = make(spark, [("a", "b", "calls")])
    assert g.remove_node("a").edges.count() == 0 and g.remove_node("zz").nodes.count() == 2 and g.clear().nodes.count() == 0
    g.save(str(tmp_path / "g"))
    again = Graph.load(spark, str(tmp_path / "g"))
    more = again.upsert_edges(spark.createDataFrame([("b", "a", "calls")], "source string, target string, type string"))
    assert more.edges.count() == 2  # nothing is overwritten
    assert again.upsert_nodes(spark.createDataFrame([("a", "class", "New", None, None, True)], NODE)).node("a").head().name == "New"


def test_cycles(spark):
    g = make(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("a", "c", "calls"), ("c", "d", "calls"), ("d", "a", "calls"), ("b", "b", "references"), ("x", "x", "calls"), ("d", "y", "calls")])
    found = {tuple(r.members): (r.edge_types, r.self_loop) for r in g.cycles().collect()}
    assert found == {("a", "b", "c", "d"): (["calls", "references"], False), ("x",): (["calls"], True)}
    assert ids(g.cyclic_nodes()) == {"a", "b", "c", "d", "x"} and g.minimal_cycle().head().members == ["x"] and g.cycle_of("y").isEmpty()
    assert [(r.size, r.source) for r in g.edges_to_break().collect()] == [(1, "x"), (4, "a")]
    assert g.has_path("a", "y") and not g.has_path("y", "a") and g.would_create_cycle("y", "a") and not g.would_create_cycle("a", "y")


def test_components_against_brute_force(spark):
    import random

    random.seed(5)
    pairs = sorted({(f"n{random.randint(0, 14)}", f"n{random.randint(0, 14)}") for _ in range(24)})
    nodes = [f"n{i}" for i in range(15)]
    reach = {a: {a} for a in nodes}
    for _ in nodes:
        for a in nodes:
            reach[a] |= {y for x, y in pairs if x in reach[a]}
    want = {frozenset(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}
    rows = graph.strong_components(spark.createDataFrame(pairs, "source string, target string"), spark.createDataFrame([(n,) for n in nodes], "id string")).collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r.scc, set()).add(r.id)
    assert {frozenset(v) for v in got.values()} == want


def test_stats_and_exports(spark):
    g = make(spark, [("a", "b", "extends"), ("a", "c", "calls")])
    got = {(r.what, r.name): r.n for r in g.stats().collect()}
    assert got[("nodes", "")] == 3 and got[("edge type", "calls")] == 1
    assert '"a" -> "b" [label="extends"];' in g.to_dot().head().dot and "a -->|calls| c" in g.to_mermaid().head().mermaid
    import json

    assert len(json.loads(g.to_json().head().json)["edges"]) == 2
    assert {r.id: r.degree for r in g.degrees().collect()} == {"a": 2, "b": 1, "c": 1}


SYMBOL = "file_path string, name string, kind string, line int, exported boolean, parent string, extends array<string>, implements array<string>"


def test_build(spark):
    s = spark.createDataFrame([("a.ts", "Child", "class", 1, True, None, ["Parent"], []), ("a.ts", "run", "method", 2, True, "Child", [], []), ("b.ts", "Parent", "class", 1, True, None, ["Gone"], []), ("b.ts", "go", "function", 9, False, None, [], [])], SYMBOL)
    c = spark.createDataFrame([("b.ts", "go", "Child.run")], "file_path string, caller string, callee string")
    i = spark.createDataFrame([("a.ts", "./b")], "file_path string, source string")
    d = spark.createDataFrame([("a.ts", "b.ts")], "from string, to string")
    g = graph.build(s, i, c, d)
    got = {(r.source, r.type, r.target) for r in g.edges.collect()}
    assert ("class:a.ts:Child:1", "extends", "class:b.ts:Parent:1") in got and ("class:b.ts:Parent:1", "extends", "type:Gone") in got
    assert ("function:b.ts:go:9", "calls", "method:a.ts:run:2") in got and ("class:a.ts:Child:1", "contains", "method:a.ts:run:2") in got
    assert ("file:a.ts", "imports", "module:./b") in got and ids(g.importers("b.ts")) == {"file:a.ts"}


def test_bad_direction(spark):
    with pytest.raises(KeyError):
        make(spark, [("a", "b", "calls")]).related("a", 1, "sideways")


def test_symbol_tracking(spark):
    calls = spark.createDataFrame([("a.ts", "main", "x.run"), ("a.ts", "run", "User"), ("b.ts", "go", "run"), ("b.ts", None, "run")], "file_path string, caller string, callee string")
    got = {r.name: (r.callers, r.callees) for r in graph.call_graph(calls).collect()}
    assert got["run"] == (["go", "main"], ["User"]) and got["main"] == ([], ["run"])
    syms = spark.createDataFrame([("User", "class"), ("run", "function"), ("idle", "function")], "name string, kind string")
    refs = spark.createDataFrame([("b.ts", 3, "User<string>"), ("b.ts", 4, "Other")], "file_path string, line int, type_name string")
    stats = {r.name: (r.calls, r.type_uses, r.instantiations, r.files) for r in graph.usage_stats(syms, calls, refs).collect()}
    assert stats == {"User": (1, 1, 1, 2), "run": (3, 0, 0, 2), "idle": (0, 0, 0, 0)}
    assert [r.line for r in graph.type_users(refs, "User").collect()] == [3]


def test_usage_stats_reads_what_is_parsed_once(spark, tmp_path):
    log = tmp_path / "runs"

    def made(name):
        def run(batches):
            with log.open("a") as f:
                f.write(f"{name}\n")
            yield from batches

        return run

    syms = spark.createDataFrame([("a.ts", "f", "function"), ("a.ts", "C", "class")], "file_path string, name string, kind string").coalesce(1)
    calls = spark.createDataFrame([("a.ts", "x.f", "C"), ("b.ts", "C", "f")], "file_path string, callee string, caller string").coalesce(1)
    refs = spark.createDataFrame([], "file_path string, line int, type_name string")
    got = graph.usage_stats(syms.mapInArrow(made("symbols"), syms.schema), calls.mapInArrow(made("calls"), calls.schema), refs).collect()
    assert {(r.name, r.calls, r.instantiations, r.dependents, r.dependencies) for r in got} == {("f", 1, 0, 1, 1), ("C", 1, 1, 1, 1)}
    assert sorted(log.read_text().split()) == ["calls", "symbols"]
