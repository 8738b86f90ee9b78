import base64
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan import config, report
from loomspan.engine import Engine
from loomspan.operators import analytics, extract, graph, incremental, library, memory, retrieval, sharing, thinking
from loomspan.plans.queries import sources
from loomspan.sources import adapters, ignore, stores
from loomspan.sources.adapters import MemorySource
from loomspan.streaming import streams
from loomspan.tools import TOOLS, Server


@pytest.fixture(scope="module")
def engine(spark):
    files = {r.path: r.content for r in sources(spark).collect()}
    files["src/api.ts"] = "import { User } from './user';\nexport function handle(u: User) {\n  return new User().getName(7);\n}\n" + "// filler\n" * 40
    return Engine(spark, adapters.MemorySource(spark, files)).index()


def test_symbols(engine):
    names = {(r.name, r.kind) for r in engine.symbols.collect()}
    assert {("User", "class"), ("Named", "interface"), ("Id", "type"), ("LIMIT", "constant"), ("load", "function"), ("getName", "method"), ("Store", "class"), ("main", "function"), ("get", "method"), ("MAX_SIZE", "constant")} <= names
    user = engine.symbols.filter("name = 'User'").head()
    assert user.extends == ["Base"] and user.implements == ["Named"] and user.end_line == 10
    assert engine.symbols.filter("name = 'load'").head().is_async


def test_dependencies_and_graph(engine):
    assert {(r["from"], r["to"]) for r in engine.edges.collect()} == {("src/user.ts", "src/base.ts"), ("src/api.ts", "src/user.ts")}
    assert {r.id for r in engine.graph.importers("src/base.ts").collect()} == {"file:src/user.ts"}
    assert {r.name for r in engine.inheritance("User").collect()} == {"Base", "Named"}
    assert engine.usages("getName").count() == 1 and engine.search_symbols("user").count() == 1 and engine.search_all("user").count() == 2
    assert [r.path for r in engine.dependencies("src/user.ts").orderBy("path").collect()] == ["src/api.ts", "src/base.ts"]


def test_keyword_retrieval_is_bounded_by_tokens_alone(spark):
    files = {f"src/f{i:03}.ts": f"export function needle{i}() {{ return {i}; }}\n" for i in range(150)}
    small = Engine(spark, adapters.MemorySource(spark, files)).index()
    rows = small.retrieve("needle function", mode="keyword", max_tokens=8000).collect()
    assert len({r.file_path for r in rows}) == 150 and sum(r.token_count for r in rows) <= 8000
    few = small.retrieve("needle function", mode="keyword", max_tokens=100).collect()
    assert 0 < sum(r.token_count for r in few) <= 100


def test_retrieve_and_ask(engine):
    engine.embed()
    for mode in ("hybrid", "bm25", "keyword"):
        assert engine.retrieve("user name", mode=mode).count() >= 1
    assert engine.retrieve("user", language="python", mode="bm25").count() == 0
    got = engine.ask("user name", lambda p: "It is in the User class.")
    assert got["sources"] and got["confidence"] in ("medium", "high")
    assert engine.ask("user name", lambda p: "I am not sure")["confidence"] == "low"


def test_tools(engine, tmp_path):
    s = Server(engine)
    ok = lambda name, **a: json.loads(s.handle({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})["result"]["content"][0]["text"])
    assert len(TOOLS) >= 34 and len(s.handle({"id": 1, "method": "tools/list"})["result"]["tools"]) == len(TOOLS)
    assert ok("search", query="user")[0]["name"] == "User" and ok("get_callers", symbol="getName") is not None
    assert ok("health")["status"] == "healthy" and ok("graph_stats")["connected"] and ok("detect_smells")["counts"]
    assert ok("get_project_structure")["languages"] and "mermaid" not in ok("export_graph", format="dot")
    assert ok("analyze_complexity")["functions"] and ok("detect_patterns")["patterns"] is not None and ok("get_context", query="user")
    assert ok("export_context", path=str(tmp_path / "b")) and ok("bundle_info", path=str(tmp_path / "b"))
    assert ok("import_context", path=str(tmp_path / "b"), dry_run=True)["conflicts"]["files"] == 4
    assert s.handle("{")["error"]["code"] == -32700 and s.handle({"id": 1, "method": "x"})["error"]["code"] == -32601
    assert s.handle({"id": 1, "method": "tools/call", "params": {"name": "ask", "arguments": {"question": "?"}}})["error"]["code"] == -32603
    assert s.handle({"id": 1, "method": "resources/read", "params": {"uri": "loomspan://stats"}})["result"]["contents"]


def test_report_and_save(engine, spark, tmp_path):
    text = report.markdown(engine)
    assert all(x in text for x in ("## Structure", "`User`", "## Public API", "src/user.ts -> src/base.ts"))
    engine.save(str(tmp_path / "e"))
    assert Engine(spark, None).load(str(tmp_path / "e")).search_symbols("user").count() == 1


def test_chunks(spark):
    long = "\n".join(["import a from './a';", "", "// says", "export function f(x) {", *[f"  const value{i} = compute(x, {i});" for i in range(120)], "}", "", "tail();"])
    rows = extract.line_chunks(spark.createDataFrame([("f.ts", long)], "path string, content string")).collect()
    assert {r.type for r in rows} == {"module", "function", "mixed"} and all(r.token_count <= 520 for r in rows)
    covered = sorted((r.start_line, r.end_line) for r in rows)
    assert covered[0][0] == 1 and any(r.start_line == 3 for r in rows)
    cast = extract.cast_chunks(spark.createDataFrame([("f.ts", long), ("g.ts", None)], "path string, content string")).collect()
    assert cast and all(0 < len("".join(r.content.split())) <= 1600 for r in cast)
    small = extract.cast_chunks(spark.createDataFrame([("s.ts", "export function f(x) {\n  return x;\n}\n")], "path string, content string")).collect()
    assert [(r.start_line, r.symbols) for r in small] == [(1, ["f"])]  # a small file isn't lost


def test_rows_go_on_in_bounded_pieces(spark):
    """What a Python worker holds doesn't grow with the Arrow batch."""
    text = "some plain words\n" * 6000  # some 100,000 characters
    batch = pa.RecordBatch.from_pydict({"path": [f"f{i}.ts" for i in range(50)], "content": [text] * 49 + [None], "language": ["typescript"] * 50})
    for make in (extract.line_chunks_of, extract.cast_chunks_of):
        got = list(extract._in_pieces(lambda p, c, lang, make=make: make(p, c or "", lang), 1, extract.CHUNKS)(iter([batch])))
        assert max(sum(map(len, b["content"].to_pylist())) for b in got if b.num_rows) <= extract.PIECE_CHARS + len(text)
        assert [r for b in got for r in b.to_pylist()] == [r for p, c, lang in zip(*batch.to_pydict().values()) for r in make(p, c or "", lang)]


def test_descriptions_and_entry_points(spark):
    d = spark.createDataFrame([("// Says hello\nx",), ("x",)], "c string").select(extract.description(F.col("c")).alias("d")).collect()
    assert [r.d for r in d] == ["Says hello", None]
    f = spark.createDataFrame([("src/index.ts",), ("x.ts",)], "path string")
    assert {r.path for r in extract.entry_points(f, '{"main": "./lib/a.js", "bin": {"x": "b.js"}}').collect()} == {"src/index.ts", "lib/a.js", "b.js"}


def test_api_entries(spark):
    dts = "/**\n * Adds.\n * @returns the sum\n * @since 1.2\n * @example add(1, 2)\n */\nexport function add(a: number, b?: number): number;\nexport interface Opts { x: number }\nexport declare const VERSION: string;\nexport function _hidden(): void;\n"
    e = extract.api_entries(spark.createDataFrame([("lib", "1.0", dts)], "library string, version string, content string"))
    got = {r.name: r for r in e.collect()}
    assert set(got) == {"add", "Opts", "VERSION"} and got["add"].description == "Adds." and got["add"].since == "1.2" and got["add"].params[1].optional
    assert library.search_api(e, "adds").head().name == "add"
    s = library.extract_summary(e).head()
    assert (s.entries, s.functions, s.interfaces) == (3, 1, 1)
    p = spark.createDataFrame([('{"dependencies": {"@types/x": "1", "eslint-y": "1", "zod": "3"}, "types": "./t.d.ts"}',)], "content string")
    assert [r.library for r in library.prewarm_list(p).collect()] == ["zod"]
    assert p.select(library.declaration_paths(F.col("content")).alias("d")).head().d[0] == "t.d.ts"
    f = spark.createDataFrame([("a/node_modules/@s/p/package.json", '{"version": "2"}')], "path string, content string")
    assert library.installed(f).head().library == "@s/p"
    cache = e.withColumn("cached_at", F.current_timestamp())
    wanted = spark.createDataFrame([("lib", "1.0"), ("new", "1")], "library string, version string")
    docs = library.get_docs(cache, wanted, lambda m: m.withColumn("name", F.lit("n")), F.current_timestamp())
    assert docs.count() == 4


def test_folder_source(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("ignored/\n*.gen.ts\n!keep.gen.ts\n")
    for p, c in (("src/a.ts", "x"), ("ignored/b.ts", "x"), ("c.gen.ts", "x"), ("keep.gen.ts", "x"), ("m.min.js", "x"), ("big.ts", "x" * 1_000_001), ("i.png", "x")):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(c)
    s = adapters.FolderSource(spark, str(tmp_path))
    assert {r.path for r in s.list().collect()} == {"src/a.ts", "keep.gen.ts"}
    old = s.list().select("path", "hash").toPandas()
    (tmp_path / "src/a.ts").write_text("y")
    (tmp_path / "keep.gen.ts").unlink()
    (tmp_path / "n.ts").write_text("n")
    got = {r.path: r.status for r in s.changes(spark.createDataFrame(old)).collect()}
    assert got == {"src/a.ts": "modified", "keep.gen.ts": "removed", "n.ts": "added"}
    with pytest.raises(KeyError):
        s.fetch(["none.ts"])


def test_ignore_rules():
    p = ignore.parse("/root.ts\n# c\nlogs/**\n*.log\n!keep.log\ndir/")
    assert [ignore.is_ignored(x, p) for x in ("root.ts", "a/root.ts", "logs/x/y", "a/b.log", "keep.log", "a/dir/x", "dir.ts")] == [True, False, True, True, False, True, False]


def test_http_source(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps({"tree": [{"path": "a.ts", "type": "blob"}, {"path": "d", "type": "tree"}]}))
    (tmp_path / "a.ts").write_text(json.dumps({"path": "a.ts", "encoding": "base64", "content": base64.b64encode(b"hi").decode()}))
    s = adapters.git_hosting_source(spark, f"file://{tmp_path}/list.json", f"file://{tmp_path}/{{id}}")
    assert [(r.path, r.content, r.language) for r in s.list().collect()] == [("a.ts", "hi", "typescript")]
    (tmp_path / "list.json").unlink()  # fetching needs no list
    assert [r.content for r in s.fetch(["a.ts"]).collect()] == ["hi"]
    with pytest.raises(Exception, match="gone.ts"):
        s.fetch(["a.ts", "gone.ts"]).collect()


def test_memory_source_and_registry(spark):
    m, heard = adapters.MemorySource(spark), []
    m.on_change(lambda kind, path: heard.append((kind, path)))
    m.add("a.py", "1")
    m.update("a.py", "2")
    assert m.has("a.py") and m.count() == 1 and m.fetch(["a.py"]).head().content == "2" and m.remove("a.py") and not m.remove("a.py")
    assert heard == [("added", "a.py"), ("modified", "a.py"), ("removed", "a.py")]
    r = adapters.Registry()
    r.register("m", m)
    with pytest.raises(ValueError):
        r.register("m", m)
    assert r.by_type(adapters.MemorySource) == [m] and r.unregister("m") and r.get("m") is None


def test_git(tmp_path):
    g = tmp_path / ".git"
    (g / "refs/heads").mkdir(parents=True)
    (g / "HEAD").write_text("ref: refs/heads/main\n")
    (g / "refs/heads/main").write_text("abc\n")
    assert adapters.git_branch(str(tmp_path)) == {"branch": "main", "commit": "abc", "detached": False, "dirty": False}
    (g / "HEAD").write_text("abc")
    assert adapters.git_branch(str(tmp_path))["detached"]


def test_stores(spark, tmp_path):
    s = stores.IndexStore(spark, str(tmp_path / "i"))
    f = spark.createDataFrame([("a", "h")], "path string, hash string")
    s.save(f, "u", "main")
    s.save(f.withColumn("path", F.lit("b")), "u", "dev")
    assert [r.path for r in s.load("u", "main").collect()] == ["a"] and s.load("u", "none") is None and s.meta().count() == 2
    stores.save_json(f, str(tmp_path / "j"))
    assert stores.load_json(spark, str(tmp_path / "j"), "path string, hash string").count() == 1
    assert stores.state_hashes(stores.state(f, ".", 1)).head().hash == "h" and not stores.same_major("1.0.0")
    now = F.lit("2024-02-01").cast("timestamp")
    c = stores.CacheTable(spark.createDataFrame([("a", "2024-01-31 10:00:00", 60), ("b", "2024-01-31 09:00:00", 60), ("c", "2023-01-01 00:00:00", 1)], "k string, cached_at string, n int").withColumn("cached_at", F.col("cached_at").cast("timestamp")), ["k"])
    assert {r.k for r in c.evict(now, 30, 100, F.col("n")).rows.collect()} == {"a"} and c.stats(now, 30).head().expired == 1
    assert c.get(spark.createDataFrame([("a",), ("c",)], "k string"), now, 30).count() == 1


def test_incremental(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, hash string")
    new = spark.createDataFrame([("a", "2"), ("c", None), ("d", "1")], "path string, hash string")
    assert {r.path: r.status for r in incremental.snapshot_diff(old, new).collect()} == {"a": "modified", "b": "removed", "c": "cached", "d": "added"}
    edges = spark.createDataFrame([("c", "a"), ("a", "c"), ("x", "c")], "from string, to string")
    got = incremental.invalidated(edges, spark.createDataFrame([("a",)], "id string"))
    assert {r.id: r.depth for r in got.collect()} == {"a": 0, "c": 1, "x": 2}
    index = streams.incremental_index(old.withColumn("generation", F.lit(1)), new, lambda f: f, 2, edges)
    assert {r.path: r.generation for r in index.collect()} == {"a": 2, "c": 2, "d": 2}


def test_analytics(spark):
    body = "function f(a, b, c, d, e, g) {\n" + "  if (a) {\n" * 5 + "  x = a && b ? 1 : 42;\n" + "}\n" * 6
    f = spark.createDataFrame([("a.ts", "f", 1, 13, 6, body)], "file_path string, name string, line int, end_line int, n_params int, body string")
    c = analytics.function_complexity(f).head()
    assert c.cyclomatic == 8 and c.cognitive == sum(1 + i for i in range(1, 6)) + 1
    cls = spark.createDataFrame([("a.ts", "C", 1, 9, [f"m{i}" for i in range(25)])], "file_path string, name string, line int, end_line int, methods array<string>")
    block = "\n".join(f"const value{i} = other{i};" for i in range(6))
    files = spark.createDataFrame([("a.ts", f"{block}\n{block}\nend\nend")], "path string, content string")
    got = {r.type: r for r in analytics.smells(f, cls, files).collect()}
    assert set(got) == {"long-parameter-list", "deep-nesting", "magic-number", "god-class", "duplicate-code"} and got["god-class"].severity == "medium"
    report_ = {(r.kind, r.name): r.n for r in analytics.smell_report(analytics.smells(f, cls, files)).collect()}
    assert report_[("type", "dead-code")] == 0 and report_[("type", "god-class")] == 1
    v = analytics.validate(spark.createDataFrame([("a", "x\0y", True), ("b", "", False), ("c", "fine", True), ("d.png", "x", True), ("e", None, True)], "path string, content string, ok boolean"), "ok")
    assert {r.path: (r.confidence, r.action) for r in v.collect()} == {"a": ("low", "skip"), "b": ("medium", "partial"), "c": ("high", "index"), "d.png": ("low", "skip"), "e": ("low", "skip")}


def history(spark):
    rows = [(1, 1, "q1", "2024-01-01", "How does AuthService login work?", "The main issue is the token expiry logic. ok.", ["src/auth/service.ts"], ["getUserHandler"], True), (1, 2, "q2", "2024-01-02", "db?", "no", [], [], False)]
    return spark.createDataFrame(rows, "session_id int, ord int, id string, ts string, question string, response string, files array<string>, symbols array<string>, successful boolean").withColumn("ts", F.col("ts").cast("timestamp"))


def test_memory(spark):
    h = history(spark)
    s = memory.summarize(h.filter("ord = 1")).head()
    assert set(s.topics) == {"auth", "auth service", "user"} and s.key_findings == ["The main issue is the token expiry logic"]
    assert s.compression_ratio == pytest.approx(1.051948051948052)
    assert [r.id for r in memory.search(h, "LOGIN").collect()] == ["q1"] and memory.search(h, "", symbols=["Handler"]).count() == 1 and memory.search(h, "", symbols=["none"]).count() == 0
    assert memory.file_history(h, "src/auth/service.ts").count() == 1 and memory.recent(h, 1).head().id == "q2"
    merged = memory.merge_summaries(memory.summarize(h.filter("ord = 1")), memory.summarize(h.filter("ord = 2")), spark.createDataFrame([(1, 5)], "session_id int, original int")).head()
    assert merged.query_count == 2 and "db" in merged.topics


def test_thinking(spark):
    rows = [("a", 1, "main", 1, "analysis", "x", 0.9, None, ["f"]), ("b", 1, "main", 2, "conclusion", "so", 0.6, None, ["g"]), ("c", 1, "alt", 3, "hypothesis", "y", 0.2, "a", [])]
    t = spark.createDataFrame(rows, "id string, session_id int, branch string, number int, type string, content string, confidence double, revises string, files array<string>")
    p = thinking.with_parents(t, spark.createDataFrame([(1, "alt", "a")], "session_id int, branch string, point string"))
    assert {r.id: r.parent_id for r in p.collect()} == {"a": None, "b": "a", "c": "a"}
    assert {r.id for r in thinking.lineage(p, "c").collect()} == {"a", "c"} and {r.id for r in thinking.descendants(p, "a").collect()} == {"b", "c"}
    f = thinking.finalize(t).head()
    assert f.conclusion == "so" and f.confidence == pytest.approx((0.9 + 1.5 * 0.6 + 2 * 0.2) / 4.5) and f.files == ["f", "g"]
    n = thinking.next_steps(t).head()
    assert n.go_on and n.revise == 3 and n.suggested == "verification" and thinking.may_branch(t).head().may and thinking.tree_stats(t).head().revisions == 1
    assert "a --> b" in thinking.to_mermaid(p).head().mermaid


def test_sharing(spark, tmp_path):
    files = spark.createDataFrame([("src/a.ts",), ("secret/b.ts",)], "path string")
    nodes = spark.createDataFrame([("1", "src/a.ts"), ("2", "secret/b.ts")], "id string, file_path string")
    edges = spark.createDataFrame([("1", "2", "calls")], "source string, target string, type string")
    t = sharing.prepared({"files": files, "nodes": nodes, "edges": edges}, sharing.components(), ["secret/*"], anonymous=True)
    assert t["files"].count() == 1 and t["edges"].count() == 0 and len(t["files"].head().path) == 12
    sharing.export(spark, str(tmp_path / "b"), {"files": files})
    loaded = sharing.load(spark, str(tmp_path / "b"))
    assert loaded["files"].count() == 2 and sharing.components(exclude=["files"], private=True) == ["nodes", "edges"]
    mine = {"files": spark.createDataFrame([("src/a.ts",), ("x.ts",)], "path string")}
    assert sharing.import_bundle(mine, loaded)["files"].count() == 3 and sharing.import_bundle(mine, loaded, overwrite=True)["files"].count() == 2


def test_config(tmp_path):
    (tmp_path / "package.json").write_text(json.dumps({"loomspan": {"retrieval": {"mode": "bm25", "max_tokens": None}, "state": {"enabled": False}}}))
    c = config.load(str(tmp_path))
    assert c["retrieval"]["mode"] == "bm25" and c["retrieval"]["max_tokens"] == 8000 and not c["state"]["enabled"] and config.problems(c) == []
    assert config.problems({"x": {}, "retrieval": {"mode": "y"}})


def test_streams(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "in")
    e.repartition(3).write.parquet(src)
    raw = streams.file_stream(spark, src, e.schema, files_per_batch=1)
    timed = streams.event_time(raw.withColumnsRenamed({"event_type": "type"}))
    w = streams.tumbling(timed.withColumnRenamed("type", "event_type"), ["event_type"], "value")
    q = w.writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = streams.tumbling(e, ["event_type"], "value").count()
    assert spark.table("tumbling").count() == batch and not streams.status(q)["active"]
    d = streams.debounced(timed.withColumn("path", F.col("user_id")), gap="30 minutes")
    q = d.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("sessions").count() > 0
    due = streams.summaries_every(raw.select(F.col("user_id").alias("session_id")), 5)
    q = due.writeStream.format("memory").queryName("due").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sum(r["count"] // 5 for r in e.groupBy("user_id").count().collect())
    assert spark.table("due").count() == want
    seen = []
    edges = spark.createDataFrame([("x", "8")], "from string, to string")
    changes = raw.select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("type"), F.col("ts").cast("timestamp").alias("ts"))
    q = streams.cascade(changes, lambda: edges, lambda df, epoch: seen.extend(r.id for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(180)
    assert "x" in seen and "8" in seen
    only = streams.watched(spark.createDataFrame([("a.ts",), ("b.png",), ("node_modules/c.ts",)], "path string"), [".ts"], "^node_modules/")
    assert [r.path for r in only.collect()] == ["a.ts"]


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_refresh_equals_a_new_index(spark):
    """What refresh makes of a changed snapshot is what indexing it from scratch makes; vectors follow."""
    text = lambda n, extra="": f"import {{ b }} from './b';\nexport class A{n} extends B {{\n  run{n}(x: number): number {{\n    return b(x) + {n};\n  }}\n}}\n{extra}"
    source = MemorySource(spark)
    for i in range(6):
        source.add(f"src/f{i}.ts", text(i))
    source.add("src/b.ts", "export function b(x: number): number {\n  return x;\n}\n")
    heard = []
    e = Engine(spark, source).index(progress=lambda stage, at, of: heard.append((stage, at, of))).embed()
    exported, first = e.state(), e.generation
    assert heard[-1] == ("done", 6, 6) and {r.status for r in e.refresh().collect()} == {"cached"} and e.generation == first
    source.update("src/f1.ts", text(1, "export const NEW = 1;\n"))
    source.remove("src/f2.ts")
    source.add("src/f9.ts", text(9))
    assert {(r.path, r.status) for r in e.restore(exported).collect() if r.status != "cached"} == {("src/f1.ts", "modified"), ("src/f2.ts", "removed"), ("src/f9.ts", "added")}
    part = e.refresh(["src/f9.ts"])
    assert [(r.path, r.status) for r in part.collect()] == [("src/f9.ts", "added")] and e.files.count() == 8
    e.refresh()
    new = Engine(spark, source).index()
    for name in ("symbols", "imports", "calls", "chunks", "edges"):
        assert rows_of(getattr(e, name)) == rows_of(getattr(new, name).select(*getattr(e, name).columns)), name
    for name in ("nodes", "edges"):
        assert rows_of(getattr(e.graph, name)) == rows_of(getattr(new.graph, name))
    assert rows_of(e.inverted.search("return number b", 50)) == rows_of(new.inverted.search("return number b", 50))
    assert {r.id for r in e.vectors.rows.collect()} == {r.id for r in e.chunks.collect()}
    assert e.retrieve("number", files=["f9"], mode="bm25").select("file_path").distinct().collect()[0].file_path == "src/f9.ts"


def test_saved_vectors_providers_and_cache(spark, tmp_path):
    source = MemorySource(spark)
    source.add("a.ts", "export function alpha(x: number): number {\n  return x;\n}\n")
    source.add("b.ts", "export const beta = 'text of a constant';\n")
    e = Engine(spark, source).index().embed()
    e.save(f"file://{tmp_path}/e")
    again = Engine(spark, source).load(f"file://{tmp_path}/e")
    assert again.embedder.vocabulary == e.embedder.vocabulary and rows_of(again.vectors.rows) == rows_of(e.vectors.rows)
    assert rows_of(again.retrieve("alpha number", mode="hybrid").select("id")) == rows_of(e.retrieve("alpha number", mode="hybrid").select("id"))
    calls = retrieval.CallbackProvider("host", "len", lambda texts: [[float(len(x)), 1.0] for x in texts], batch=1, per_second=1000)
    known = e.chunks.filter("file_path = 'a.ts'").select(retrieval.cache_key(F.col("content"), calls).alias("cache_key"), F.array(F.lit(-1.0), F.lit(0.0)).alias("embedding"))
    rows = {r.file_path: list(r.embedding) for r in Engine(spark, source).index().embed(calls, known).vectors.rows.collect()}
    assert rows["a.ts"] == [-1.0, 0.0] and rows["b.ts"][1] == 1.0 and rows["b.ts"][0] > 10
    assert Engine.clear(spark, f"file://{tmp_path}/e") and not (tmp_path / "e").exists()


def test_query_cache():
    at = [0.0]
    c = stores.QueryCache(capacity=2, ttl=10, now=lambda: at[0])
    assert c.get_or_compute("a|n1", lambda: 1) == 1 and c.get_or_compute("a|n1", lambda: 2) == 1
    c.put("b|n2", 5)
    c.get("a|n1")
    c.put("c|n3,n1", 6)  # the least used goes
    assert c.get("b|n2") is None and c.stats()["size"] == 2 and c.invalidate_node("n1") == 2 and c.stats()["hits"] == 2 and c.stats()["misses"] == 2
    c.put("x", 1)
    at[0] = 11
    assert c.prune() == 1 and c.get("x") is None and c.invalidate() == 0


def test_components_and_hops_against_brute_force(spark):
    import random

    random.seed(12)
    edges = {(f"v{random.randint(0, 29)}", f"v{random.randint(0, 29)}") for _ in range(45)}
    df = spark.createDataFrame(sorted(edges), "source string, target string")
    ids = sorted({x for e in edges for x in e})
    reach = {x: {x} for x in ids}
    for _ in ids:
        for a, b in edges:
            for x in ids:
                if a in reach[x]:
                    reach[x].add(b)
    want = {x: min(y for y in ids if y in reach[x] and x in reach[y]) for x in ids}
    got = {r.id: r.scc for r in graph.strong_components(df).collect()}
    assert got == want
    far = {r.id: r.scc for r in graph.strong_components(df, local_edges=0).collect()}  # by colouring
    assert {frozenset(y for y in ids if far[y] == far[x]) for x in ids} == {frozenset(y for y in ids if want[y] == want[x]) for x in ids}
    depth, at, d = {ids[0]: 0}, {ids[0]}, 0
    while at:
        d += 1
        at = {b for a, b in edges if a in at} - set(depth)
        depth |= dict.fromkeys(at, d)
    pairs = df.select(F.col("source").alias("from"), F.col("target").alias("to"))
    for most in (None, 0, 1, 5):
        rows = graph.khop(pairs, spark.createDataFrame([(ids[0],)], "id string"), most).collect()
        assert {r.id: r.depth for r in rows} == {k: v for k, v in depth.items() if most is None or v <= most} and len(rows) == len({r.id for r in rows})


def test_functions_are_joined_without_broadcast(spark):
    """Sizes of parsed rows and of texts are misjudged, so neither side may be broadcast by its estimate."""
    files = spark.createDataFrame([("f.ts", "export function f(x) {\n  return x;\n}\n")], "path string, content string")
    rows = extract.function_rows(extract.symbols(files), files)
    assert [(r.name, r.body) for r in rows.collect()] == [("f", "export function f(x) {\n  return x;\n}")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
