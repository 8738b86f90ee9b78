"""More queries over the driver's tables: lookups, code made of every part, upkeep of stores, and what sessions and thoughts hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import scoring
from ..functions import text as tx
from ..operators import analytics, budget, extract, graph, incremental, library, memory, retrieval, sharing, thinking
from ..sources import stores
from .queries import _BM25, _COS, _DEP, _HIST, _Q, _REACH, _TH, _W, SEARCH, _edges, _probe, docs, files, history, query, t, thoughts, world

# --- code made of every part: one file each ---

_CODE = """import {{ dep{k} }} from './mod{k}';
import os{k} from 'lib{k}';

/** Doc {i}. */
export class C{i} extends B{k} {{
  run{i}(a: number): number {{
    return dep{k}(a);
  }}
}}

export async function f{i}(x: string, y: number): Promise<void> {{
  if (x) {{ run{i}(y); }}
}}

export const LIMIT{i} = 42;
export interface I{i} {{ name: string; }}
export type T{i} = string;
"""


def sources(spark, sf) -> DataFrame:
    """A TypeScript file for each part: src/mod<key>.ts, which imports that of key modulo 50."""
    i, k = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 50).cast("string")
    code = F.replace(F.replace(F.lit(_CODE.format(i="@i", k="@k")), F.lit("@i"), i), F.lit("@k"), k)
    return t(spark, sf, "part").select(F.format_string("src/mod%d.ts", "p_partkey").alias("path"), code.alias("content"), F.lit("typescript").alias("language"))


_SRC = "src as (select p_partkey as i, p_partkey % 50 as k, 'src/mod' || p_partkey || '.ts' as path from part)"
_ROWS = [("'C' || i", "class", 5, 9, "null"), ("'run' || i", "method", 6, 8, "'C' || i"), ("'f' || i", "function", 11, 13, "null"), ("'LIMIT' || i", "constant", 15, 15, "null"), ("'I' || i", "interface", 16, 16, "null"), ("'T' || i", "type", 17, 17, "null")]
_SYM = f"{_SRC}, sym as (" + " union all ".join(f"select path as file_path, {n} as name, '{kind}' as kind, {a} as line, {b} as end_line, {p} as parent, i, k from src" for n, kind, a, b, p in _ROWS) + ")"
_CALLS = f"{_SYM}, calls as (select path as file_path, 'run' || i as caller, 'dep' || k as callee, 7 as line, i, k from src union all select path, 'f' || i, 'run' || i, 12, i, k from src)"


def engine(spark, sf, *names: str) -> Engine:
    """An engine over the sources with the tables that a query needs."""
    e, src = Engine(spark, None), sources(spark, sf)
    e.files = src
    for name in names:
        setattr(e, name, {"symbols": extract.symbols, "imports": extract.imports, "calls": extract.calls}[name](src))
    return e


@query(f"with {_SYM} select file_path, name, kind, line, end_line, parent from sym")
def symbols_of_parts(spark, sf):
    return engine(spark, sf, "symbols").symbols.select("file_path", "name", "kind", "line", "end_line", "parent")


@query(f"with {_SRC} select path as file_path, './mod' || k as source, 'dep' || k as names, false as is_default, 1 as line from src union all select path, 'lib' || k, 'os' || k, true, 2 from src")
def imports_of_parts(spark, sf):
    return extract.imports(sources(spark, sf)).select("file_path", "source", F.array_join("names", ",").alias("names"), "is_default", "line")


@query(f"with {_CALLS} select file_path, caller, callee, line from calls")
def calls_of_parts(spark, sf):
    return extract.calls(sources(spark, sf)).select("file_path", "caller", "callee", "line")


@query(f"with {_SYM} select file_path, name, kind, line from sym where contains(lower(name), 'c1') and kind in ('class', 'constant') order by file_path, line, name limit 20")
def search_symbols(spark, sf):
    return engine(spark, sf, "symbols").search_symbols("c1", ["class", "constant"]).select("file_path", "name", "kind", "line")


@query(f"with {_SYM} select 'file' as what, path as name, path as file_path from src where contains(path, 'mod19') union all select kind, name, file_path from sym where contains(lower(name), 'mod19') or contains(lower(name), 'run19') and contains(lower(name), 'mod19')")
def search_all(spark, sf):
    return engine(spark, sf, "symbols").search_all("Mod19")


@query(f"with {_CALLS} select file_path, caller, callee, line from calls where callee = 'dep7' or callee like '%.dep7' order by file_path, line limit 20")
def usages(spark, sf):
    return engine(spark, sf, "calls").usages("dep7").select("file_path", "caller", "callee", "line")


@query(f"with {_SYM} select type, count(*) as n from (select 'defines' as type from sym union all select 'exports' from sym union all select 'contains' from src union all select 'extends' from src union all select 'calls' from src union all select 'calls' from src union all select 'imports' from src union all select 'imports' from src) group by 1")
def built_edges(spark, sf):
    """Edges of the graph of all sources, by type."""
    e = engine(spark, sf, "symbols", "imports", "calls")
    return graph.build(e.symbols, e.imports, e.calls).edges.groupBy("type").agg(F.count("*").alias("n"))


@query(f"with {_SRC} select 'class:' || path || ':C' || i || ':5' as source, 'method:' || path || ':run' || i || ':6' as target from src")
def contained_members(spark, sf):
    e = engine(spark, sf, "symbols")
    return graph.build(e.symbols).edges.filter("type = 'contains'").select("source", "target")


@query(f"with {_CALLS}, p as (select distinct caller, callee from calls), n as (select caller as name from p union select callee from p) select name, coalesce((select string_agg(caller, ',' order by caller) from p where callee = n.name), '') as callers, coalesce((select string_agg(callee, ',' order by callee) from p where caller = n.name), '') as callees from n")
def call_graph(spark, sf):
    got = graph.call_graph(engine(spark, sf, "calls").calls)
    return got.select("name", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@query(f"with {_SRC}, b as (select i, 'B' || k as name, path from src) select name, i as line, path as file_path from b where name = 'B7'")
def type_users(spark, sf):
    refs = t(spark, sf, "part").select(F.format_string("B%d<T[]>", F.col("p_partkey") % 50).alias("type_name"), F.format_string("src/mod%d.ts", "p_partkey").alias("file_path"), F.col("p_partkey").alias("line"))
    return graph.type_users(refs, "B7").select(F.lit("B7").alias("name"), "line", "file_path")


@query(f"with {_SRC} select path as file_path, 'C' || (i % 30) as callee, i as line from src where i % 30 in (select i from src) and i % 3 = 0")
def instantiations(spark, sf):
    e = engine(spark, sf, "symbols")
    calls = t(spark, sf, "part").select(F.format_string("src/mod%d.ts", "p_partkey").alias("file_path"), F.when(F.col("p_partkey") % 3 == 0, F.format_string("C%d", F.col("p_partkey") % 30)).otherwise("make").alias("callee"), F.col("p_partkey").alias("line"))
    return graph.instantiations(calls, e.symbols).select("file_path", "callee", "line")


@query(f"""with {_CALLS}, u as (select callee as name, count(*) as calls, count(distinct file_path) as files, count(distinct caller) as dependents from calls group by 1), o as (select caller as name, count(distinct callee) as dependencies from calls group by 1)
select name, coalesce(calls, 0) as calls, 0 as instantiations, coalesce(files, 0) as files, coalesce(dependents, 0) as dependents, coalesce(dependencies, 0) as dependencies from (select distinct name from sym) left join u using (name) left join o using (name)""")
def usage_stats(spark, sf):
    e = engine(spark, sf, "symbols", "calls")
    none = spark.createDataFrame([], "file_path string, line int, type_name string")
    return graph.usage_stats(e.symbols, e.calls, none).select("name", "calls", "instantiations", "files", "dependents", "dependencies")


@query(f"with {_SRC} select path as file_path, 'run' || i as name, 1 as n_params, 3 as lines from src union all select path, 'f' || i, 2, 3 from src")
def function_rows(spark, sf):
    e = engine(spark, sf, "symbols")
    return extract.function_rows(e.symbols, e.files).select("file_path", "name", "n_params", F.size(F.split("body", "\n")).alias("lines"))


@query(f"with {_SRC} select path as file_path, 'C' || i as name, 'run' || i as methods from src")
def class_rows(spark, sf):
    return extract.class_rows(engine(spark, sf, "symbols").symbols).select("file_path", "name", F.array_join("methods", ",").alias("methods"))


@query(f"with {_SRC} select path as file_path, 1 as start_line, 2 as end_line, 'module' as type from src union all select path, 3, 18, 'mixed' from src")
def line_chunks_of_parts(spark, sf):
    """The imports, and the rest: symbols below 50 tokens have no chunk of their own."""
    return extract.line_chunks(sources(spark, sf)).select("file_path", "start_line", "end_line", "type")


@query(f"with {_SRC} select path as file_path, min(1) as start_line, 'dep' || any_value(k) as used from src group by path, k")
def syntax_chunks_of_parts(spark, sf):
    """Small files are one chunk each, which uses what it imports by name."""
    got = extract.cast_chunks(sources(spark, sf)).groupBy("file_path").agg(F.min("start_line").alias("start_line"), F.max(F.get("imports", F.lit(0))).alias("used"))
    return got


@query("select 'src/' || source || '/doc' || doc_id || '.ts' as file_path, 1 as start_line, len(string_split(text, chr(10))) as end_line, cast(ceil(length(text) / 4.0) as integer) as token_count from documents where regexp_matches(text, '[^\\s]')")
def mixed_chunks(spark, sf):
    """Texts without symbols are one chunk each, whatever their length."""
    return extract.line_chunks(files(spark, sf)).select("file_path", "start_line", F.col("end_line").cast("long").alias("end_line"), "token_count")


@query(f"with {_SRC}, x as (select 'Singleton' as name, 5 as k, count(*) as n from src where i % 40 = 0 union all select 'Strategy', 5, count(*) from src where i % 25 = 0 union all select 'Factory', 10, count(*) from src where i % 90 = 0) select name, round(least(n / k, 1), 6) as confidence, n from x where n > 0")
def design_patterns(spark, sf):
    p = F.col("p_partkey")
    s = t(spark, sf, "part").select(F.format_string("src/mod%d.ts", p).alias("file_path"), F.explode(F.array_compact(F.array(
        F.when(p % 40 == 0, F.struct(F.lit("getInstance").alias("name"), F.lit("method").alias("kind"))), F.when(p % 25 == 0, F.struct(F.lit("PriceStrategy").alias("name"), F.lit("class").alias("kind"))),
        F.when(p % 90 == 0, F.struct(F.lit("createPart").alias("name"), F.lit("function").alias("kind")))))).alias("x")).select("file_path", "x.name", "x.kind", F.lit(None).cast("string").alias("parent"))
    bare = sources(spark, sf).withColumn("content", F.lit("nothing"))
    return analytics.patterns(bare, s, ["design"]).select("name", F.round("confidence", 6).alias("confidence"), F.size("files").cast("long").alias("n"))


@query("""with x as (select doc_id, 'a/b' || doc_id || case doc_id % 4 when 0 then '.png' else '.ts' end as path, text, quality from documents left join labels using (doc_id))
select path, doc_id % 4 <> 0 as valid, case when doc_id % 4 = 0 then 'low' when quality is not null and length(text) > 50 then 'high' else 'medium' end as confidence, case when doc_id % 4 = 0 then 'skip' when quality is null then 'partial' else 'index' end as action from x""")
def validated_files(spark, sf):
    x = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    f = x.select(F.concat(F.lit("a/b"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".png").otherwise(".ts")).alias("path"), F.col("text").alias("content"), F.col("quality").isNotNull().alias("parsed"), F.when(F.length("text") > 50, 1).otherwise(0).alias("n"))
    return analytics.validate(f, "parsed", "n").select("path", "valid", "confidence", "action")


@query("select kind, name, cast(n as bigint) as n from (select 'type' as kind, 'god-class' as name, count(*) as n from (select source from documents group by 1 having count(*) > 20) union all select 'type', 'duplicate-code', 2 * count(*) from (select 1 from documents where length(text) > 60))")
def smells_of_classes_and_copies(spark, sf):
    """God classes (a class for each source, with its documents as methods) and blocks that stand twice (each text over 60 characters thrice, seven lines apart)."""
    d = t(spark, sf, "documents")
    c = d.groupBy("source").agg(F.sort_array(F.collect_list(F.col("doc_id").cast("string"))).alias("methods")).select(F.lit("f").alias("file_path"), F.col("source").alias("name"), F.lit(1).alias("line"), F.lit(9).alias("end_line"), "methods")
    one = F.concat(F.substring(F.md5("text"), 1, 20), F.lit("abcdefghij" * 4))
    line = lambda n: F.concat_ws("\n", one, *[F.lit(f"line {n}{i}") for i in range(5)])
    copies = F.concat_ws("\n", line(1), F.lit("x"), line(1), F.lit("y"), line(1), F.lit("end"))
    f = d.filter(F.length("text") > 60).select(F.col("doc_id").cast("string").alias("path"), copies.alias("content"))
    none = spark.createDataFrame([], "file_path string, name string, line int, end_line int, n_params int, body string")
    return analytics.smell_report(analytics.smells(none, c, f)).filter(F.col("name").isin("god-class", "duplicate-code"))


# --- graph ---


@query(f"with {_W} select id, type, name from nodes where type = 'class' and regexp_matches(name, '_1') and contains(lower(name), 'nation')")
def nodes_by_pattern(spark, sf):
    return world(spark, sf).find(kind="class", name="nation", pattern="_1", exported=True).select("id", "type", "name")


@query(f"with {_W} select id, name from nodes where id = 'n7'")
def node_by_id(spark, sf):
    return world(spark, sf).node("n7").select("id", "name")


@query(f"with {_W} select id, name from nodes where id in (select target from edges where source = 'n3' and type = 'calls')")
def callees(spark, sf):
    return world(spark, sf).callees("n3").select("id", "name")


@query(f"with recursive {_REACH} select 'n3' as a, n.id as b, n.id in (select b from reach where a = 'n3') as path from nat n where n.id in ('n0', 'n3', 'n9', 'n24')")
def has_path(spark, sf):
    g = world(spark, sf)
    g = graph.Graph(g.nodes, g.edges.filter("type = 'calls'"))
    return spark.createDataFrame([("n3", b, g.would_create_cycle(b, "n3")) for b in ("n0", "n3", "n9", "n24")], "a string, b string, path boolean")


@query(f"with {_W}, s as (select id, type, name from nodes where id <> 'n1' union all select 'x1', 'class', 'new'), e as (select source, target, type from edges where source <> 'n1' and target <> 'n1' union select 'x1', 'n2', 'calls') select 'nodes' as what, count(*) as n from s union all select 'edges', count(*) from e")
def graph_upkeep(spark, sf):
    g = world(spark, sf).remove_node("n1")
    g = g.upsert_nodes(spark.createDataFrame([("x1", "class", "new")], "id string, type string, name string")).upsert_edges(spark.createDataFrame([("x1", "n2", "calls")], "source string, target string, type string"))
    return g.nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n").unionByName(g.edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n"))


@query(f"with recursive {_REACH}, big as (select scc, count(*) as size from scc group by 1) select s.id from scc s join big using (scc) where size > 1 or s.id in (select source from calls where source = target)")
def cyclic_nodes(spark, sf):
    g = world(spark, sf)
    return graph.Graph(g.nodes.filter("type = 'class'"), g.edges.filter("type = 'calls'")).cyclic_nodes()


@query(f"with recursive {_REACH}, big as (select scc, count(*) as size, string_agg(id, ',' order by id) as members from scc group by 1) select size, members from big where size > 1 or scc in (select source from calls where source = target) order by size, members limit 1")
def minimal_cycle(spark, sf):
    g = world(spark, sf)
    return graph.Graph(g.nodes.filter("type = 'class'"), g.edges.filter("type = 'calls'")).minimal_cycle().select("size", F.array_join("members", ",").alias("members"))


@query(f"""with recursive {_REACH}, big as (select scc, count(*) as size from scc group by 1), ins as (select a.scc, size, c.source, c.target, row_number() over (partition by a.scc order by substr(sha256(c.source || '|' || c.target || '|calls'), 1, 16)) as r from calls c join scc a on c.source = a.id join scc b on c.target = b.id and a.scc = b.scc join big g on g.scc = a.scc where size > 1 or c.source = c.target)
select size, source, target from ins where r = 1""")
def edges_to_break(spark, sf):
    g = world(spark, sf)
    return graph.Graph(g.nodes.filter("type = 'class'"), g.edges.filter("type = 'calls'")).edges_to_break().select("size", "source", "target")


@query(f"with {_W}, k as (select id, name from nodes where type in ('class', 'interface')) select 'graph LR' || chr(10) || (select string_agg('  ' || id || '[\"' || name || '\"]', chr(10) order by '  ' || id || '[\"' || name || '\"]') from k) || chr(10) || (select string_agg(x, chr(10) order by x) from (select '  ' || source || ' -->|' || type || '| ' || target as x from edges where source in (select id from k) and target in (select id from k))) as mermaid")
def mermaid(spark, sf):
    return world(spark, sf).induced(["class", "interface"]).to_mermaid()


@query(f"with {_W} select id, count(*) as degree from (select source as id from edges union all select target from edges where source <> target) group by 1")
def graph_saved_and_loaded(spark, sf):
    path = f"{graph.shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    world(spark, sf).save(path)
    return graph.cut(graph.Graph.load(spark, path).degrees())


@query(f"""with {_DEP} select "to" as path, 'imports' as direction from dep where "from" = 'src/src3/doc3.ts' and "from" <> "to" union all select "from", 'imported_by' from dep where "to" = 'src/src3/doc3.ts' and "from" <> "to" """)
def file_dependencies(spark, sf):
    return incremental.dependencies(_edges(spark, sf), "src/src3/doc3.ts")


@query(f"""with {_DEP} select "from" as path, string_agg(distinct "to", ',' order by "to") as imports from dep where "from" <> "to" group by 1""")
def imports_by_file(spark, sf):
    return incremental.by_source(_edges(spark, sf)).select("path", F.array_join("imports", ",").alias("imports"))


# --- retrieval ---


@query(f"with {_BM25} select id, round(score, 6) as score from bm order by round(score, 6) desc, id limit 20")
def stored_index_search(spark, sf):
    path = f"{graph.shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    retrieval.InvertedIndex.build(docs(spark, sf)).save(path)
    return retrieval.InvertedIndex.load(spark, path).search(SEARCH, 20).select("id", F.round("score", 6).alias("score"))


@query(f"with {_BM25} select id, round(score, 6) as score from bm where id % 7 = 3 order by round(score, 6) desc, id limit 20")
def search_within(spark, sf):
    """The filter comes before the cut; corpus counts are those of all documents."""
    d = docs(spark, sf)
    return retrieval.InvertedIndex.build(d).search(SEARCH, 20, d.filter("id % 7 = 3").select("id")).select("id", F.round("score", 6).alias("score"))


@query(f"with {_Q}, e as (select vec_id, embedding, label from embeddings where vec_id % 3 <> 0 and label <> 2) select vec_id as id, round({_COS}, 6) as score, (select count(*) from e) as size from e, probe order by round({_COS}, 6) desc, vec_id limit 20")
def vector_store_upkeep(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("file_path"))
    store = retrieval.VectorStore(e.filter("id % 2 = 0")).add(e.filter("id % 2 = 1")).delete_by_file("2")
    store = retrieval.VectorStore(store.rows.filter("id % 3 <> 0"))
    path = f"{graph.shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    store.save(path)
    store = retrieval.VectorStore.load(spark, path)
    return retrieval.vector_search(store.rows, _probe(spark, sf), 20).select("id", F.round("score", 6).alias("score"), F.lit(store.count()).alias("size"))


@query(f"""with {_BM25}, {_Q}, s as (select id, row_number() over (order by round(score, 6) desc, id) - 1 as r from bm order by r limit 24), v as (select vec_id as id, row_number() over (order by round({_COS}, 6) desc, vec_id) - 1 as r from embeddings, probe order by r limit 24)
select id, round(sum(w / (60 + r + 1)), 9) as score from (select id, r, 0.4 as w from s union all select id, r, 0.6 from v) group by 1 order by sum(w / (60 + r + 1)) desc, id limit 8""")
def hybrid_of_a_few(spark, sf):
    """Eight of min(3 * 8, 100) from each side."""
    n = retrieval.fetch_size(8)
    sparse, dense = retrieval.bm25_search(docs(spark, sf), SEARCH, n), retrieval.vector_search(t(spark, sf, "embeddings"), _probe(spark, sf), n, "vec_id")
    got = retrieval.hybrid_search(sparse.withColumn("score", F.round("score", 6)), dense.withColumn("score", F.round("score", 6)), 8)
    return got.select("id", F.round("score", 9).alias("score"))


@query("select 'local:tf-idf:' || sha256(text) as cache_key, case when bool_or(doc_id % 2 = 0) then 'cached' else 'new' end as how from documents group by 1")
def embeddings_missing(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    key = F.concat(F.lit("local:tf-idf:"), F.sha2("content", 256))
    cache = d.filter("doc_id % 2 = 0").select(key.alias("cache_key"), F.lit("cached").alias("embedding")).distinct()
    return retrieval.embed_missing(d.drop("doc_id"), cache, lambda rows: rows.withColumn("embedding", F.lit("new"))).withColumnRenamed("embedding", "how")


@query("""with tok as (select doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda w: len(w) > 1 and len(w) < 50)) as term from documents), n as (select count(*) as n from documents),
f as (select term, count(distinct doc_id) as df from tok group by 1 order by df desc, term limit 16), i as (select term, case when ln(n / (df + 1.0)) = 0 then 1 else ln(n / (df + 1.0)) end as idf from f, n),
tf as (select doc_id, term, count(*) as c from tok group by 1, 2), m as (select doc_id, max(c) as m from tf group by 1), raw as (select doc_id, c / m::double * idf as x from tf join i using (term) join m using (doc_id)), s as (select doc_id, sqrt(sum(x * x)) as norm, sum(x) as x from raw group by 1)
select doc_id, round(coalesce(case when norm = 0 then 0 else x / norm end, 0), 6) as total from documents left join s using (doc_id)""")
def tfidf_vectors(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    made = retrieval.TfIdfEmbedder.fit(d, dimensions=16)
    return d.select("doc_id", F.round(F.aggregate(made.embed(F.col("content")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("with s as (select doc_id as id, cast(contains(lower(text), 'the') as int) + cast(contains(lower(text), 'a') as int) + case when contains(lower(source), 'the') then 3 else 0 end + case when contains(lower(source), 'a') then 3 else 0 end + case when doc_id % 2 = 0 then 1 else 0 end as score from documents) select id, cast(score as double) as score from s where score > 0")
def tool_keyword_score(spark, sf):
    s = retrieval.keyword_score("the a", F.col("content"), F.array("source"), F.col("id") % 2 == 0, tool=True)
    return docs(spark, sf).select("id", s.cast("double").alias("score")).filter("score > 0")


@query("with x as (select source, row_number() over (order by n_chars desc, doc_id) as r, cast(ceil(n_chars / 4.0) as integer) as n from documents) select coalesce(sum(n), 0) as total_tokens, 5500 - coalesce(sum(n), 0) as remaining, count(*) as selected, count(distinct source) as files from x where r <= 5")
def budget_totals(spark, sf):
    top = docs(spark, sf).orderBy(F.desc("n_chars"), "id").limit(5).select(F.ceil(F.col("n_chars") / 4).cast("int").alias("token_count"), F.col("source").alias("file_path"), F.lit(1.0).alias("score"))
    return budget.budget_summary(top).drop("avg_score")


@query("""with recursive c as (select row_number() over (order by n_chars desc, doc_id) as i, doc_id, source, cast(n_chars % 700 + 1 as integer) as n, (doc_id * 37 % 101) / 101.0 as score from documents qualify i <= 40),
g(step, picked, files, room) as (select 0, []::bigint[], []::varchar[], 5500 union all select step + 1, list_append(picked, best.doc_id), list_append(files, best.source), cast(room - best.n as integer) from g, lateral (select doc_id, source, n from c where n <= room and score >= 0.1 and not list_contains(picked, c.doc_id) order by score::double + (case when list_contains(files, c.source) then 0.0 else 0.3 end)::double + 0.1::double * score::double / greatest(n, 1) desc, doc_id limit 1) best),
l as (select picked from g order by step desc limit 1) select unnest(picked) as id, generate_subscripts(picked, 1) as pick from l""")
def greedy_choice(spark, sf):
    top = docs(spark, sf).orderBy(F.desc("n_chars"), "id").limit(40)
    rows = top.select(F.col("id"), F.col("source").alias("file_path"), (F.col("n_chars") % 700 + 1).cast("int").alias("token_count"), (F.pmod(F.col("id") * 37, F.lit(101)) / 101.0).cast("double").alias("score"), F.col("id").alias("ord"))
    return budget.greedy_budget(rows, 8000).select("id", F.col("pick").cast("long").alias("pick"))


# --- text ---

_NAME = "concat('load', replace(p_name, ' ', '_'), '_', p_brand)"


@query("select p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(p_name || '_' || p_size), '_'), lambda w: w <> ''), ' ') as snake, array_to_string(list_filter(string_split(lower(replace(p_name, ' ', '-')), '-'), lambda w: w <> ''), ' ') as kebab, regexp_matches(replace(p_name, ' ', case when p_partkey % 2 = 0 then '_' else '-' end), '^[A-Za-z_$][A-Za-z0-9_$]*$') as identifier from part")
def split_names(spark, sf):
    sign = F.when(F.col("p_partkey") % 2 == 0, F.lit("_")).otherwise(F.lit("-"))
    return t(spark, sf, "part").select("p_partkey", F.array_join(tx.split_snake(F.concat_ws("_", "p_name", "p_size")), " ").alias("snake"), F.array_join(tx.split_kebab(F.replace("p_name", F.lit(" "), F.lit("-"))), " ").alias("kebab"), tx.is_identifier(F.replace("p_name", F.lit(" "), sign)).alias("identifier"))


@query("select doc_id, strlen(array_to_string(string_split(text, chr(10))[1:2], chr(10))) + 1 as at from documents where len(string_split(text, chr(10))) > 2")
def byte_offsets(spark, sf):
    """Where each third line begins, in bytes."""
    d = t(spark, sf, "documents").filter(F.size(F.split("text", "\n")) > 2)
    return d.select("doc_id", tx.byte_offset("text", F.lit(3), F.lit(0)).cast("long").alias("at"))


@query("""with recursive s as (select doc_id, substr(regexp_replace(text, '[^ -~]', '', 'g'), 1, 40) as x from documents), h(doc_id, x, i, h) as (select doc_id, x, 0, 0::bigint from s union all select doc_id, x, i + 1, (h * 31 + ascii(substr(x, i + 1, 1))) % 4294967296 from h where i < length(x))
select doc_id, abs(case when h >= 2147483648 then h - 4294967296 else h end) as h from h where i = length(x)""")
def rolling_hash(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.hash32(F.substring(F.regexp_replace("text", "[^ -~]", ""), 1, 40)).cast("long").alias("h"))


@query(f"with {_TH} select number, case when c >= 0.8 then 'high' when c >= 0.5 then 'medium' else 'low' end as level, case when c >= 0.8 then '[GREEN]' when c >= 0.5 then '[YELLOW]' else '[RED]' end as icon from th")
def confidence_labels(spark, sf):
    rows = thoughts(spark, sf).withColumn("level", scoring.confidence_level(F.col("confidence")))
    return rows.select("number", "level", scoring.confidence_icon(F.col("level")).alias("icon"))


# --- history ---

_H7 = f"{_HIST}, hh as (select *, 'src/mod' || (session_id % 7) || '/a.ts' as file, timestamp '2024-01-01' + session_id * interval 1 day as ts, session_id || '-' || ord as id from h)"


@query(f"with {_H7} select session_id, ord, case when contains(lower(question), 'a') then 2 else 0 end + case when contains(lower(response), 'a') then 1 else 0 end + case when ord % 4 = 0 then 1 else 0 end as score from hh where ts between timestamp '2024-01-05' and timestamp '2024-02-20' and file in ('src/mod2/a.ts', 'src/mod5/a.ts') qualify row_number() over (order by session_id, ord) <= 50")
def history_search_filtered(spark, sf):
    h = history(spark, sf)
    got = memory.search(h, "A", 50, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-02-20").cast("timestamp"), ["src/mod2/a.ts", "src/mod5/a.ts"], ["UserHandler"])
    return got.select("session_id", "ord", "score")


@query(f"with {_H7} select id, session_id from hh where file = 'src/mod3/a.ts' order by ts desc, id limit 10")
def file_history(spark, sf):
    return memory.recent(memory.file_history(history(spark, sf), "src/mod3/a.ts"), 10).select("id", "session_id")


@query(f"with {_H7} select id from hh where session_id % 2 = 1 or session_id >= 40")
def since_last_summary(spark, sf):
    h = history(spark, sf)
    s = h.filter("session_id % 2 = 0 and session_id < 40").select("session_id", "ts").distinct().select("session_id", F.col("ts").alias("generated_at"))
    return memory.since_last_summary(h, s).select("id")


@query(f"with {_H7}, s as (select distinct session_id, ts from hh) select session_id from s where ts between timestamp '2024-01-10' and timestamp '2024-01-20' order by ts desc")
def summaries_by_date(spark, sf):
    s = history(spark, sf).select("session_id", F.col("ts").alias("generated_at")).distinct()
    return memory.summaries_between(s, F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")).select("session_id")


@query(f"with {_H7} select session_id, count(*) as query_count, any_value('src/mod' || (session_id % 7) || '/a.ts') as files from hh group by 1")
def summarized_sessions(spark, sf):
    return memory.summarize(history(spark, sf)).select("session_id", "query_count", F.array_join("files_mentioned", ",").alias("files"))


@query(f"with {_H7} select session_id, 'x,' || any_value('mod' || (session_id % 7)) as topics, 2 * count(*) as query_count from hh group by 1")
def merged_summaries(spark, sf):
    h = history(spark, sf)
    one = lambda topic: h.groupBy("session_id").agg(F.count("*").alias("query_count"), F.min(F.concat(F.lit("mod"), (F.col("session_id") % 7).cast("string"))).alias("m")).select("session_id", "query_count", topic.alias("topics"), *[F.array().cast("array<string>").alias(c) for c in ("key_findings", "files_mentioned", "symbols_mentioned")])
    got = memory.merge_summaries(one(F.array(F.lit("x"))), one(F.array(F.lit("x"), F.col("m"))), h.groupBy("session_id").agg(F.sum(F.length("question")).alias("original")))
    return got.select("session_id", F.array_join("topics", ",").alias("topics"), "query_count")


@query("with s as (select user_id, min(ts) as t from events group by 1) select cast(user_id as varchar) as session_id, false as open from s union all select 'new', true")
def sessions_upkeep(spark, sf):
    """All sessions end when another begins; they are saved and read again."""
    s = t(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.min("ts").cast("timestamp").alias("started_at")).withColumn("ended_at", F.lit(None).cast("timestamp"))
    q = spark.createDataFrame([("1", "new")], "id string, session_id string")
    made = memory.Sessions(s, q.limit(0)).create("new", F.lit("2025-01-01").cast("timestamp")).append(q)
    path = f"{graph.shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    made.save(path)
    got = memory.Sessions.load(spark, path, "id string, session_id string")
    return got.sessions.select("session_id", F.col("ended_at").isNull().alias("open"))


# --- thoughts ---


@query("select user_id as session_id, count(*) as thoughts, 0 as revisions, 1 as branches, count(*) - 1 as max_depth from events group by 1")
def thought_trees(spark, sf):
    return thinking.tree_stats(thoughts(spark, sf)).select("session_id", "thoughts", "revisions", "branches", "max_depth")


@query("select user_id as session_id, 'main' as branch, max(event_id) + 1 as next, true as may from events group by 1")
def next_thoughts(spark, sf):
    th = thoughts(spark, sf)
    return thinking.next_number(th).join(thinking.may_branch(th), "session_id")


@query("with recursive p as (select event_id, user_id, lag(event_id) over (partition by user_id order by event_id) as parent from events), first as (select min(event_id) as id from events where user_id = (select min(user_id) from events)), k(id, depth) as (select id, 0 from first union all select event_id, depth + 1 from k join p on parent = id) select cast(id as varchar) as id, depth from k where depth > 0")
def thought_descendants(spark, sf):
    th = thinking.with_parents(thoughts(spark, sf))
    low = t(spark, sf, "events").agg(F.min_by("event_id", F.struct("user_id", "event_id")).alias("id")).head().id
    return thinking.descendants(th, str(low))


@query("with e as (select user_id, event_id, event_type, props from events) select user_id as session_id, arg_max(props, event_id) as conclusion, count(*) as thoughts, (select string_agg(x, ',' order by x) from (select distinct event_type as x from e z where z.user_id = e.user_id)) as files from e group by 1")
def thoughts_concluded(spark, sf):
    return thinking.finalize(thoughts(spark, sf)).select("session_id", "conclusion", "thoughts", F.array_join("files", ",").alias("files"))


@query("select cast(event_id as varchar) as id from events where contains(lower(props), '6') and event_type = 'view'")
def thoughts_found(spark, sf):
    return thinking.find(thoughts(spark, sf), "6", "hypothesis").select("id")


# --- stores, libraries, bundles ---


@query("select path, status from (select 'd' || doc_id as path, case when doc_id % 5 = 0 then 'removed' when doc_id % 7 = 0 then 'modified' when doc_id % 3 = 0 then 'added' else 'cached' end as status from documents) where status <> 'removed'")
def index_after_changes(spark, sf):
    """A file index after its diff is the index of the new snapshot; the status is read from the generation and hash."""
    d = t(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id")
    is_ = lambda n: F.col("doc_id") % n == 0
    old = d.filter(is_(5) | is_(7) | ~is_(3)).select("path", F.lit("a").alias("hash"), F.lit(1).alias("generation"))
    new = d.filter(~is_(5)).select("path", F.when(is_(7), "b").otherwise("a").alias("hash"))
    diff = incremental.snapshot_diff(old, new)
    parsed = new.join(diff.filter(F.col("status").isin("added", "modified")).select("path"), "path", "left_semi")
    got = incremental.apply_changes(old, diff, parsed, 2)
    return got.select("path", F.when(F.col("generation") == 1, "cached").when(F.col("hash") == "b", "modified").otherwise("added").alias("status"))


@query("select 'src/' || source || '/doc' || doc_id || '.ts' as path, sha256(text) as hash from documents")
def state_exported_and_read(spark, sf):
    return stores.state_hashes(stores.state(files(spark, sf).withColumn("hash", F.sha2("content", 256)), ".", 3))


@query("select doc_id, source from documents where lang = 'fr'")
def branch_of_an_index(spark, sf):
    path = f"{graph.shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    store = stores.IndexStore(spark, path)
    d = t(spark, sf, "documents").select("doc_id", "source", "lang")
    for branch in ("en", "fr"):
        store.save(d.filter(F.col("lang") == branch), "me", branch)
    return incremental.keep_branch(store.load("me", "fr").unionByName(store.load("me", "en")), "me", "fr").select("doc_id", "source")


@query("select doc_id, n_chars from documents where doc_id % 3 <> 1")
def json_store(spark, sf):
    path = f"{graph.shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    stores.save_json(t(spark, sf, "documents").filter("doc_id % 3 <> 1").select("doc_id", "n_chars"), path)
    return stores.load_json(spark, path, "doc_id long, n_chars long")


@query("""with m as (select max(ts) as now from events), y as (select event_id, ts, sum(100) over (order by cast(ts as date) desc, ts desc, event_id) as total from events, m where now - ts <= interval 20 days) select event_id from y where total <= 50000""")
def cache_evicted(spark, sf):
    e = t(spark, sf, "events")
    now = F.lit(e.agg(F.max("ts")).head()[0])
    return stores.CacheTable(e.select("event_id", F.col("ts").alias("cached_at")), ["event_id"]).evict(now, 20, 50000, F.lit(100)).rows.select("event_id")


@query("with m as (select max(ts) as now from events) select event_type as library, count(*) as entries from events, m where now - ts <= interval 7 days group by 1")
def library_fresh(spark, sf):
    e = t(spark, sf, "events")
    now = F.lit(e.agg(F.max("ts")).head()[0])
    return library.fresh(e.select(F.col("event_type").alias("library"), F.col("ts").alias("cached_at")), now).groupBy("library").agg(F.count("*").alias("entries"))


@query("select 'lib-' || replace(p_name, ' ', '-') || p_partkey as library, '1.' || p_size as version from part where p_partkey % 3 = 0 order by 1 limit 50")
def library_prewarm(spark, sf):
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "lib-").when(F.col("p_partkey") % 3 == 1, "@types/").otherwise("eslint-"), F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_partkey").cast("string"))
    return library.prewarm_list(t(spark, sf, "part").select(F.to_json(F.struct(F.create_map(name, F.concat(F.lit("1."), F.col("p_size").cast("string"))).alias("dependencies"))).alias("content")))


@query("select substr(sha256('src/' || source || '/doc' || doc_id || '.ts'), 1, 12) as path from documents where source not in ('src1', 'src3') and doc_id <> 8")
def bundle_prepared(spark, sf):
    got = sharing.prepared({"files": files(spark, sf)}, sharing.components(["files", "queries"], private=True), ["src/src1/*", "src/src3/**"], ["src/src8/doc8.ts"], anonymous=True)
    return got["files"].select("path")


@query("select 'file' as kind, count(*) as n from documents union all select 'page', count(*) from pages")
def bundle_counts(spark, sf):
    return sharing.info({"file": t(spark, sf, "documents"), "page": t(spark, sf, "pages")}).select(F.col("component").alias("kind"), F.col("rows").alias("n"))


@query("with m as (select count(*) as n, max(ts) as t from events) select case when n = 0 then 'unhealthy' else 'degraded' end as health from m")
def index_health(spark, sf):
    m = t(spark, sf, "events").agg(F.count("*").alias("n"), F.max("ts").cast("timestamp").alias("t"))
    return m.select(incremental.health(F.col("n"), F.col("t"), F.col("t") + F.expr("interval 2 hours")).alias("health"))
