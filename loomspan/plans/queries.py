"""Queries over the driver's tables for each group of operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import text as tx
from ..operators import analytics, budget, extract, graph, incremental, library, memory, retrieval, sharing, thinking
from ..operators.layout import spread
from ..streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEARCH = "the erin whst tion that la"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts are costly to work on."""
    return spread(t(spark, sf_dir, name))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", "lang", "n_chars")


TOK = "list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: len(w) between 2 and 50 and not regexp_matches(w, '^[0-9]+$'))"
_BM25 = f"""
d as (select doc_id as id, {TOK} as tok from documents), corpus as (select count(*) as n, avg(len(tok)) as mean from d),
post as (select id, dl, term, count(*) as tf from (select id, len(tok) as dl, unnest(tok) as term from d) group by 1, 2, 3),
q as (select term, count(*) as qtf from (select unnest(string_split('{SEARCH}', ' ')) as term) group by 1),
dfs as (select term, count(*) as df from post group by 1),
bm as (select id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) as score from q join post using (term) join dfs using (term), corpus group by 1)"""


@query(f"""with {_BM25}, top as (select id, score from bm order by round(score, 6) desc, id limit 20)
select id, round(score, 6) as score, token_count, used from (select id, score, cast(ceil(n_chars / 4.0) as integer) as token_count,
  sum(cast(ceil(n_chars / 4.0) as integer)) over (order by round(score, 6) desc, id) as used from top join documents on id = doc_id) where used <= 4000""")
def bm25_search(spark, sf):
    """Flagship: BM25 top 20, joined to the texts for the winners only, cut to 4,000 tokens."""
    d = docs(spark, sf)
    top = retrieval.bm25_search(d, SEARCH, 20)
    rows = top.join(d.select("id", F.ceil(F.col("n_chars") / 4).cast("int").alias("token_count")), "id")
    return budget.prefix_budget(rows, 4000, [F.desc(F.round("score", 6)), "id"]).select("id", F.round("score", 6).alias("score"), "token_count", "used")


@query(f"with {_BM25} select id, round(score, 6) as score from bm order by round(score, 6) desc, id limit 50")
def bm25_index_search(spark, sf):
    got = retrieval.InvertedIndex.build(docs(spark, sf)).search(SEARCH, 50)
    return got.select("id", F.round("score", 6).alias("score"))


@query(f"with {_BM25} select term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from dfs, corpus order by df desc, term limit 200")
def bm25_term_stats(spark, sf):
    s = retrieval.InvertedIndex.build(docs(spark, sf)).term_stats()
    return s.orderBy(F.desc("df"), "term").limit(200).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {_BM25} select term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from dfs, corpus where df <= case when n <= 10 then n else floor(0.9 * n) end and df >= 1 order by df desc, term limit 100")
def bm25_bounded_terms(spark, sf):
    s = retrieval.InvertedIndex.build(docs(spark, sf)).term_stats(bounded=True)
    return s.orderBy(F.desc("df"), "term").limit(100).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {_BM25} select n as size, round(mean, 6) as mean_length, (select count(distinct term) from post) as vocabulary from corpus")
def bm25_corpus_stats(spark, sf):
    return retrieval.InvertedIndex.build(docs(spark, sf)).corpus_stats().withColumn("mean_length", F.round("mean_length", 6))


@query(f"""with docs2 as (select * from documents where doc_id % 5 <> 0), {_BM25.replace("from documents)", "from docs2)", 1)}
select id, round(score, 6) as score from bm order by round(score, 6) desc, id limit 20""")
def bm25_after_removal(spark, sf):
    index = retrieval.InvertedIndex.build(docs(spark, sf)).remove(docs(spark, sf).filter("id % 5 = 0").select("id"))
    return index.search(SEARCH, 20).select("id", F.round("score", 6).alias("score"))


@query(f"select term, count(*) as n from (select unnest({TOK}) as term from documents) group by 1 order by n desc, term limit 500")
def tokenize_freq(spark, sf):
    return docs(spark, sf).select(F.explode(tx.bm25_tokens("content")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(500)


_IDENT = "concat('get', replace(p_name, ' ', 'Of'), 'XMLHttp', p_size)"
_SPLIT = "list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([[:upper:]]+)([[:upper:]][[:lower:]])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')), ' '), lambda w: w <> '')"


@query(f"select p_partkey, array_to_string({_SPLIT.format(_IDENT)}, ' ') as words, array_to_string({_SPLIT.format(_IDENT)}, '_') as snake, array_to_string({_SPLIT.format(_IDENT)}, '-') as kebab from part")
def identifier_split(spark, sf):
    name = F.concat(F.lit("get"), F.replace("p_name", F.lit(" "), F.lit("Of")), F.lit("XMLHttp"), F.col("p_size").cast("string"))
    return t(spark, sf, "part").select("p_partkey", F.array_join(tx.split_camel(name), " ").alias("words"), tx.snake_case(name).alias("snake"), tx.kebab_case(name).alias("kebab"))


@query("""select source, sum(cast(ceil(length(text) / 4.0) as integer)) as tokens, sum(length(text) - length(replace(text, chr(10), ''))) as newlines, sum(length(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]', '', 'g'))) as ink,
max(case when length(text) > 40 then substr(text, 1, 37) || '...' else text end) as longest_head from documents group by 1""")
def text_measures(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.sum(tx.estimate_tokens("content")).alias("tokens"), F.sum(tx.newline_count("content")).alias("newlines"), F.sum(tx.non_space_count("content")).alias("ink"), F.max(tx.truncate("content", 40)).alias("longest_head"))


# --- dense ---

_Q = "probe as (select embedding::double[] as q from embeddings where vec_id = 0)"
_COS = "coalesce(list_cosine_similarity(embedding::double[], q), 0)"


def _probe(spark, sf):
    return t(spark, sf, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("q"))


@query(f"with {_Q} select vec_id as id, round({_COS}, 6) as score from embeddings, probe order by round({_COS}, 6) desc, vec_id limit 20")
def vector_topk(spark, sf):
    return retrieval.vector_search(t(spark, sf, "embeddings"), _probe(spark, sf), 20, "vec_id").select("id", F.round("score", 6).alias("score"))


@query(f"with {_Q} select vec_id as id, round({_COS}, 6) as score from embeddings, probe where label in (1, 3) order by round({_COS}, 6) desc, vec_id limit 20")
def vector_topk_filtered(spark, sf):
    rows = t(spark, sf, "embeddings").filter(F.col("label").isin(1, 3))
    return retrieval.vector_search(rows, _probe(spark, sf), 20, "vec_id").select("id", F.round("score", 6).alias("score"))


@query(f"with {_Q}, c as (select vec_id as id, label, round({_COS}, 6) as score from embeddings, probe order by 3 desc, 1 limit 40) select id, score from c where label = 2 order by score desc, id limit 20")
def overfetch_then_filter(spark, sf):
    e = t(spark, sf, "embeddings")
    top = retrieval.vector_search(e, _probe(spark, sf), 40, "vec_id")
    return retrieval.kept_after(top, e.select(F.col("vec_id").alias("id"), "label"), F.col("label") == 2, 20).select("id", F.round("score", 6).alias("score"))


@query("""with d as (select list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda w: len(w) > 1 and len(w) < 50)) as tok from documents),
f as (select term, count(*) as df from (select unnest(tok) as term from d) group by 1 order by df desc, term limit 512)
select term, round(case when ln((select count(*) from documents) / (df + 1.0)) = 0 then 1 else ln((select count(*) from documents) / (df + 1.0)) end, 6) as idf from f""")
def tfidf_vocabulary(spark, sf):
    made = retrieval.TfIdfEmbedder.fit(docs(spark, sf))
    return spark.createDataFrame(made.vocabulary, "term string, idf double").withColumn("idf", F.round("idf", 6))


_LISTS = f"""{_BM25}, {_Q}, s as (select id, score, row_number() over (order by round(score, 6) desc, id) - 1 as r from bm order by r limit 50),
v as (select vec_id as id, {_COS} as score, row_number() over (order by round({_COS}, 6) desc, vec_id) - 1 as r from embeddings, probe order by r limit 50)"""


def _lists(spark, sf):
    sparse = retrieval.bm25_search(docs(spark, sf), SEARCH, 50)
    dense = retrieval.vector_search(t(spark, sf, "embeddings"), _probe(spark, sf), 50, "vec_id")
    return sparse.withColumn("score", F.round("score", 6)), dense.withColumn("score", F.round("score", 6))


@query(f"with {_LISTS} select id, round(sum(1.0 / (60 + r + 1)), 9) as score from (select id, r from s union all select id, r from v) group by 1")
def rrf_fusion(spark, sf):
    return retrieval.rrf(list(_lists(spark, sf))).withColumn("score", F.round("score", 9))


@query(f"with {_LISTS} select id, round(sum(w / (60 + r + 1)), 9) as score from (select id, r, 0.4 as w from s union all select id, r, 0.6 from v) group by 1")
def weighted_rrf(spark, sf):
    return retrieval.rrf(list(_lists(spark, sf)), [0.4, 0.6]).withColumn("score", F.round("score", 9))


@query(f"""with {_LISTS}, f as (select id, sum(w / (60 + r + 1)) as score from (select id, r, 0.4 as w from s union all select id, r, 0.6 from v) group by 1)
select id, round(f.score, 9) as score, round(coalesce(s.score, 0), 6) as sparse_score, round(coalesce(v.score, 0), 6) as dense_score from f left join s using (id) left join v using (id) order by f.score desc, id limit 30""")
def hybrid_search(spark, sf):
    got = retrieval.hybrid_search(*_lists(spark, sf), limit=30)
    return got.select("id", F.round("score", 9).alias("score"), F.round("sparse_score", 6).alias("sparse_score"), F.round("dense_score", 6).alias("dense_score"))


@query("""with s as (select doc_id as id, cast(contains(lower(text), 'the') as int) + cast(contains(lower(text), 'erin') as int) + cast(contains(lower(text), 'whst') as int) + case when doc_id % 2 = 0 then 0.5 else 0 end as score from documents)
select id, cast(score as double) as score from s where score > 0 order by score desc, id limit 100""")
def keyword_score(spark, sf):
    s = retrieval.keyword_score("the erin whst a", F.col("content"), exported=F.col("id") % 2 == 0)
    return docs(spark, sf).select("id", s.cast("double").alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(100)


@query("""select id, source, token_count, cast(used as bigint) as used from (select doc_id as id, source, cast(ceil(n_chars / 4.0) as integer) as token_count, sum(cast(ceil(n_chars / 4.0) as integer)) over (partition by source order by n_chars, doc_id) as used from documents) where used <= 2000""")
def prefix_budget(spark, sf):
    rows = docs(spark, sf).withColumn("token_count", F.ceil(F.col("n_chars") / 4).cast("int"))
    return budget.prefix_budget(rows, 2000, ["n_chars", "id"], partition=["source"]).select("id", "source", "token_count", "used")


def _chunks(spark, sf):
    d = docs(spark, sf)
    top = retrieval.bm25_search(d, SEARCH, 100)
    return top.join(d, "id").select(F.col("id").cast("string").alias("id"), F.round("score", 6).alias("score"), F.col("source").alias("file_path"), F.ceil(F.col("n_chars") / 4).cast("int").alias("token_count"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "content", F.col("id").alias("ord"))


@query()
def greedy_budget(spark, sf):
    return budget.greedy_budget(_chunks(spark, sf), 8000).drop("content")


@query()
def priority_budget(spark, sf):
    return budget.greedy_budget(_chunks(spark, sf), 8000, priority=["src3", "src7"]).drop("content")


@query()
def retrieve_context(spark, sf):
    return budget.format_context(budget.greedy_budget(_chunks(spark, sf), 6000))


# --- graph ---


def world(spark, sf) -> graph.Graph:
    """Customer -> nation -> region as inheritance; nation -> nation as calls, by the number of all items traded: pairs where it is
    1 modulo 4, and back to a lower nation where it is 1 modulo 64."""
    r, n, c, s = (t(spark, sf, x) for x in ("region", "nation", "customer", "supplier"))
    rid, nid, cid = (F.concat(F.lit(p), F.col(k).cast("string")) for p, k in (("r", "r_regionkey"), ("n", "n_nationkey"), ("c", "c_custkey")))
    node = lambda df, i, kind, name: df.select(i.alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line"), F.lit(True).alias("exported"))
    nodes = node(r, rid, "interface", "r_name").unionByName(node(n, nid, "class", "n_name")).unionByName(node(c, cid, "function", "c_name"))
    up = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = n.select(nid.alias("source"), up("r", "n_regionkey").alias("target"), F.lit("implements").alias("type"))
    edges = edges.unionByName(c.select(cid.alias("source"), up("n", "c_nationkey").alias("target"), F.lit("extends").alias("type")))
    o, li = t(spark, sf, "orders").select("o_orderkey", "o_custkey"), t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    trade = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    traded = trade.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n")).filter(F.when(F.col("c_nationkey") < F.col("s_nationkey"), F.col("n") % 4).otherwise(F.col("n") % 64) == 1)
    calls = traded.select(up("n", "c_nationkey").alias("source"), up("n", "s_nationkey").alias("target"), F.lit("calls").alias("type"))
    edges = edges.unionByName(calls).withColumn("id", graph.edge_id(F.col("source"), F.col("target"), F.col("type")))
    return graph.Graph(nodes, graph.cut(edges))


_W = """nodes as (select 'r' || r_regionkey as id, 'interface' as type, r_name as name from region union all select 'n' || n_nationkey, 'class', n_name from nation union all select 'c' || c_custkey, 'function', c_name from customer),
calls as (select 'n' || c_nationkey as source, 'n' || s_nationkey as target from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by c_nationkey, s_nationkey having case when c_nationkey < s_nationkey then count(*) % 4 else count(*) % 64 end = 1),
edges as (select 'n' || n_nationkey as source, 'r' || n_regionkey as target, 'implements' as type from nation union all select 'c' || c_custkey, 'n' || c_nationkey, 'extends' from customer union all select source, target, 'calls' from calls)"""
_BOTH = "both_ways as (select source as a, target as b from edges union all select target, source from edges)"


@query(f"with recursive {_W}, {_BOTH}, k(id, depth) as (select 'n3', 0 union select b, depth + 1 from k join both_ways on id = a where depth < 2) select id, min(depth) as depth from k group by 1")
def neighborhood_khop(spark, sf):
    return world(spark, sf).related("n3", 2)


@query(f"with recursive {_W}, k(id, depth) as (select 'n3', 0 union select target, depth + 1 from k join calls on id = source where depth < 3) select id, min(depth) as depth from k group by 1")
def neighborhood_calls(spark, sf):
    return world(spark, sf).related("n3", 3, "outgoing", ["calls"])


@query(f"""with recursive {_W}, {_BOTH}, k(id, path, depth) as (select 'c1', ['c1'], 0 union all select b, list_append(path, b), depth + 1 from k join (select distinct a, b from both_ways) on id = a where depth < 4 and not list_contains(path, b) and (b[1] <> 'c' or b = 'c7'))
select array_to_string(path, '>') as path from k where id = 'c7' order by depth, path limit 1""")
def shortest_path(spark, sf):
    return world(spark, sf).path("c1", "c7", 4).select(F.array_join("path", ">").alias("path"))


@query(f"with recursive {_W}, k(id, depth) as (select 'c5', 0 union select target, depth + 1 from k join edges on id = source where type in ('extends', 'implements')) select id, depth from k where depth > 0")
def inheritance_up(spark, sf):
    return world(spark, sf).inheritance("c5", "up")


@query(f"with recursive {_W}, k(id, depth) as (select 'r2', 0 union select source, depth + 1 from k join edges on id = target where type in ('extends', 'implements')) select id, depth from k where depth > 0")
def inheritance_down(spark, sf):
    return world(spark, sf).inheritance("r2", "down")


_REACH = f"{_W}, nat as (select 'n' || n_nationkey as id from nation), reach(a, b) as (select id, id from nat union select a, target from reach join calls on b = source), scc as (select x.a as id, min(x.b) as scc from reach x join reach y on x.a = y.b and x.b = y.a group by 1)"


@query(f"with recursive {_REACH} select id, scc from scc")
def scc_components(spark, sf):
    g = world(spark, sf)
    c = graph.strong_components(g.edges.filter("type = 'calls'"), g.nodes.filter("type = 'class'").select("id"))
    least = F.min("id").over(Window.partitionBy("scc"))
    return c.select("id", least.alias("scc"))


@query(f"""with recursive {_REACH}, big as (select scc, string_agg(id, ',' order by id) as members, count(*) as size from scc group by 1)
select members, size, size = 1 as self_loop from big where size > 1 or scc in (select source from calls where source = target)""")
def scc_cycles(spark, sf):
    g = world(spark, sf)
    return graph.Graph(g.nodes.filter("type = 'class'"), g.edges.filter("type = 'calls'")).cycles().select(F.array_join("members", ",").alias("members"), "size", "self_loop")


@query(f"with recursive {_REACH} select b as id from reach where a = 'n3'")
def reachability(spark, sf):
    return world(spark, sf).related("n3", None, "outgoing", ["calls"]).select("id")


@query()
def break_edges(spark, sf):
    g = world(spark, sf)
    return graph.Graph(g.nodes.filter("type = 'class'"), g.edges.filter("type = 'calls'")).edges_to_break()


@query(f"with {_W}, ends as (select source as id from edges union all select target from edges where source <> target) select id, count(*) as degree from ends group by 1 order by degree desc, id limit 10")
def degree_top(spark, sf):
    return world(spark, sf).degrees().orderBy(F.desc("degree"), "id").limit(10)


@query(f"with {_W} select 'nodes' as what, '' as name, count(*) as n from nodes union all select 'edges', '', count(*) from edges union all select 'node type', type, count(*) from nodes group by type union all select 'edge type', type, count(*) from edges group by type")
def graph_stats(spark, sf):
    return world(spark, sf).stats()


@query(f"with {_W} select target as id, count(*) as calls from calls group by 1 having count(*) >= 2")
def hotspots(spark, sf):
    return world(spark, sf).hotspots(2)


@query(f"with {_W} select distinct source as id from calls where source not in (select target from calls)")
def orphans(spark, sf):
    return world(spark, sf).orphans()


@query(f"with {_W} select id, name from nodes where id in (select source from calls where target = (select target from calls group by 1 order by count(*) desc, target limit 1))")
def callers(spark, sf):
    g = world(spark, sf)
    top = g.edges.filter("type = 'calls'").groupBy("target").count().orderBy(F.desc("count"), "target").limit(1).select("target")
    return g.callers(top.head().target).select("id", "name")


@query(f"with {_W} select id, type, name from nodes where type = 'class' and regexp_matches(name, '^[A-N].*_1') and contains(lower(name), 'i')")
def find_nodes(spark, sf):
    return world(spark, sf).find(kind="class", name="I", pattern="^[A-N].*_1").select("id", "type", "name")


@query(f"with {_W}, keep as (select id from nodes where type in ('class', 'interface')) select source, target, type from edges where source in (select id from keep) and target in (select id from keep)")
def induced_subgraph(spark, sf):
    return world(spark, sf).induced(["class", "interface"]).edges.select("source", "target", "type")


# --- files, dependencies, snapshots ---


def files(spark, sf):
    return t(spark, sf, "documents").select(F.format_string("src/%s/doc%d.ts", "source", "doc_id").alias("path"), F.col("text").alias("content"), F.col("lang").alias("language"), F.col("n_chars").alias("size"), "doc_id", "source")


def imports(spark, sf):
    k = F.pmod(F.col("doc_id") * 7 + 3, F.lit(1000))
    return files(spark, sf).select(F.col("path").alias("file_path"), F.format_string("../src%d/doc%d", k % 20, k).alias("source"), "doc_id")


_DEP = """f as (select 'src/' || source || '/doc' || doc_id || '.ts' as path, *, (doc_id * 7 + 3) % 1000 as k from documents),
dep as (select distinct a.path as "from", b.path as "to", '../src' || (a.k % 20) || '/doc' || a.k as specifier from f a join f b on b.path = 'src/src' || (a.k % 20) || '/doc' || a.k || '.ts')"""


@query(f'with {_DEP} select "from", specifier, "to" from dep')
def import_resolution(spark, sf):
    return incremental.resolve_imports(imports(spark, sf), files(spark, sf))


def _edges(spark, sf):
    return incremental.dependency_edges(incremental.resolve_imports(imports(spark, sf), files(spark, sf)))


@query(f"""with {_DEP} select "to" as path, string_agg(distinct "from", ',' order by "from") as imported_by from dep where "from" <> "to" group by 1""")
def importers(spark, sf):
    return incremental.imported_by(_edges(spark, sf)).select("path", F.array_join("imported_by", ",").alias("imported_by"))


@query(f"""with recursive {_DEP}, k(id, depth) as (select path, 0 from f where doc_id in (3, 10, 24) union select "from", depth + 1 from k join dep on id = "to" where "from" <> "to" and depth < 40) select id, min(depth) as depth from k group by 1""")
def transitive_dependents(spark, sf):
    seeds = files(spark, sf).filter("doc_id in (3, 10, 24)").select(F.col("path").alias("id"))
    return incremental.invalidated(_edges(spark, sf), seeds, 40)


@query(f"""with recursive {_DEP}, k(id, depth) as (select path, 0 from f where doc_id = 5 union select "to", depth + 1 from k join dep on id = "from" where "from" <> "to" and depth < 5) select id, min(depth) as depth from k group by 1""")
def dependency_chain(spark, sf):
    return incremental.dependency_chain(_edges(spark, sf), files(spark, sf).filter("doc_id = 5").select(F.col("path").alias("id")))


@query(f"""with {_DEP}, s as (select "to" as path, 2 as s from dep where "from" <> "to" union all select path, 1 from f where doc_id % 3 = 0) select path, sum(s) as score from s group by 1 order by score desc, path limit 20""")
def file_importance(spark, sf):
    sym = files(spark, sf).select(F.col("path").alias("file_path"), (F.col("doc_id") % 3 == 0).alias("exported"))
    return incremental.file_importance(_edges(spark, sf), sym)


@query("""with o as (select o_orderkey, sha256(o_orderstatus || o_orderpriority) as h from orders where o_orderkey % 7 <> 0), n as (select o_orderkey, sha256(case when o_orderkey % 11 = 0 then 'X' else o_orderstatus end || o_orderpriority) as h from orders where o_orderkey % 5 <> 0)
select coalesce(o.o_orderkey, n.o_orderkey) as path, case when o.h is null then 'added' when n.h is null then 'removed' when o.h = n.h then 'cached' else 'modified' end as status from o full join n on o.o_orderkey = n.o_orderkey""")
def snapshot_diff(spark, sf):
    o = t(spark, sf, "orders")
    h = lambda s: F.sha2(F.concat(s, F.col("o_orderpriority")), 256).alias("hash")
    old = o.filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("path"), h(F.col("o_orderstatus")))
    new = o.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("path"), h(F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus"))))
    return incremental.snapshot_diff(old, new)


@query("select lang as language, count(*) as files, sum(case when doc_id % 2 = 0 then 2 else 0 end) as symbols from documents group by 1")
def language_stats(spark, sf):
    f = files(spark, sf)
    sym = f.filter("doc_id % 2 = 0").select(F.col("path").alias("file_path"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name"))
    return incremental.language_stats(f, sym)


@query("select l_returnflag || l_linestatus as kind, count(*) as n from lineitem group by 1 order by n desc")
def kind_counts(spark, sf):
    return incremental.kind_counts(t(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("kind")))


@query("with x as (select 'src/' || source || '/doc' || doc_id || '.ts' as path from documents) select regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, count(*) as files, min(regexp_extract(path, '[^/]*$')) as first, max(regexp_extract(path, '\\.[^.]*$')) as extension from x group by 1")
def files_by_folder(spark, sf):
    return incremental.folders(files(spark, sf))


@query("""with x as (select doc_id, 'src/' || source || '/doc' || doc_id || case doc_id % 4 when 0 then '.ts' when 1 then '.py' when 2 then '.min.js' else '.md' end as path from documents)
select doc_id, path from x where regexp_matches(path, '^(?:.*/)?[^/]*\\.py$') or regexp_matches(path, '^src/src1[^/]*/[^/]*$')""")
def glob_filter(spark, sf):
    ext = F.element_at(F.array(F.lit(".ts"), F.lit(".py"), F.lit(".min.js"), F.lit(".md")), (F.col("doc_id") % 4 + 1).cast("int"))
    x = t(spark, sf, "documents").select("doc_id", F.concat(F.lit("src/"), "source", F.lit("/doc"), F.col("doc_id").cast("string"), ext).alias("path"))
    return x.filter(tx.matches_any_glob("path", ["**/*.py", "src/src1*/*"]))


@query("select doc_id, case doc_id % 4 when 0 then 'typescript' when 1 then 'python' when 2 then 'cpp' else null end as language from documents")
def language_by_extension(spark, sf):
    ext = F.element_at(F.array(F.lit(".ts"), F.lit(".py"), F.lit(".h"), F.lit(".unknown")), (F.col("doc_id") % 4 + 1).cast("int"))
    return t(spark, sf, "documents").select("doc_id", tx.language_of(F.concat(F.lit("a/b"), ext)).alias("language"))


# --- bundles ---


@query("""with a as (select c_custkey as id, c_name as name from customer where c_custkey % 3 <> 0), b as (select c_custkey as id, upper(c_name) || '!' as name from customer where c_custkey % 2 = 0) select coalesce(b.id, a.id) as id, coalesce(b.name, a.name) as name from a full join b on a.id = b.id""")
def bundle_merge(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return sharing.merge(c.filter("id % 3 <> 0"), c.filter("id % 2 = 0").withColumn("name", F.concat(F.upper("name"), F.lit("!"))), ["id"])


@query("""select 'files' as component, (select count(*) from documents where doc_id % 3 = 0) as rows_a, (select count(*) from documents where doc_id % 2 = 0) as rows_b, (select count(*) from documents where doc_id % 2 = 0) - (select count(*) from documents where doc_id % 3 = 0) as difference
union all select 'nodes', (select count(*) from nation), 0, -(select count(*) from nation)""")
def bundle_diff(spark, sf):
    f = files(spark, sf)
    return sharing.diff({"files": f.filter("doc_id % 3 = 0"), "nodes": t(spark, sf, "nation")}, {"files": f.filter("doc_id % 2 = 0")})


@query("select c_custkey as id, 'skipped' as resolution from customer where c_custkey % 6 = 0")
def bundle_conflicts(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return sharing.conflicts(c.filter("id % 3 = 0"), c.filter("id % 2 = 0"), ["id"])


@query("select c_custkey, substr(sha256(c_name), 1, 12) as who, substr(sha256(cast(c_custkey as varchar)), 1, 16) as short from customer")
def anonymize_hash(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", sharing.anonymize("c_name").alias("who"), tx.short_sha("c_custkey", 16).alias("short"))


# --- code analytics: documents read as code ---

_CODE = "replace(replace(replace(replace(replace(replace(text, ' the ', ' if (x) '), ' and ', ' && '), ' of ', ' { '), ' in ', ' } '), ' with ', ' return '), ' to ', ' 42 ')"
_N = lambda pattern, c="code": f"len(regexp_extract_all({c}, '{pattern}'))"


def code(spark, sf):
    c = F.col("text")
    for word, sign in ((" the ", " if (x) "), (" and ", " && "), (" of ", " { "), (" in ", " } "), (" with ", " return "), (" to ", " 42 ")):
        c = F.replace(c, F.lit(word), F.lit(sign))
    return texts(spark, sf).select("doc_id", "source", c.alias("code"))


def functions(spark, sf):
    return code(spark, sf).select(F.format_string("src/%s.ts", "source").alias("file_path"), F.format_string("f%d", "doc_id").alias("name"), F.lit(1).alias("line"), F.size(F.split("code", "\n")).alias("end_line"), (F.col("doc_id") % 9).cast("int").alias("n_params"), F.col("code").alias("body"))


_CYC = f"1 + {_N('\\b(?:if|while|for|catch)\\s*\\(')} + {_N('\\bcase\\b')} + {_N('\\?\\s*[^:]+:')} + {_N('&&')} + {_N('\\|\\|')}"


@query(f"with c as (select doc_id, {_CODE} as code from documents), x as (select doc_id, {_CYC} as cyclomatic from c) select doc_id, cyclomatic, case when cyclomatic <= 5 then 'low' when cyclomatic <= 10 then 'medium' when cyclomatic <= 20 then 'high' else 'very-high' end as rating from x")
def cyclomatic_ratings(spark, sf):
    c = code(spark, sf).select("doc_id", scoring.cyclomatic(F.col("code")).alias("cyclomatic"))
    return c.withColumn("rating", scoring.complexity_rating(F.col("cyclomatic")))


_LINES = f"""c as (select doc_id, source, {_CODE} as code from documents), l as (select doc_id, source, unnest(string_split(code, chr(10))) as text, generate_subscripts(string_split(code, chr(10)), 1) as line from c),
ch as (select *, {_N('\\{', 'text')} - {_N('\\}', 'text')} as change from l), s as (select *, sum(change) over (partition by doc_id order by line) as s from ch),
m as (select *, s - least(0, min(s) over (partition by doc_id order by line)) as after from s), b as (select *, coalesce(lag(after) over (partition by doc_id order by line), 0) as before from m)"""
_COGN = f"""sum(case when regexp_matches(text, '\\b(?:if|while|for|switch|catch)\\s*\\(') then 1 + before else 0 end + {_N('&&|\\|\\|', 'text')} + case when regexp_matches(text, '\\b(?:break|continue|return)\\b') then 1 else 0 end)"""


@query(f"with {_LINES} select doc_id, cast(greatest(max(before + change), 0) as integer) as nesting from b group by 1")
def nesting_depth(spark, sf):
    lines = extract.explode_lines(code(spark, sf), "doc_id", "code")
    return analytics.max_nesting(lines, ["doc_id"])


@query(f"with {_LINES}, g as (select doc_id, {_COGN} as cognitive from b group by 1), y as (select doc_id, {_CYC} as cyclomatic from c) select doc_id, cyclomatic, cast(cognitive as integer) as cognitive, case when greatest(cyclomatic, cognitive) <= 5 then 'low' when greatest(cyclomatic, cognitive) <= 10 then 'medium' when greatest(cyclomatic, cognitive) <= 20 then 'high' else 'very-high' end as rating from g join y using (doc_id)")
def function_complexity(spark, sf):
    got = analytics.function_complexity(functions(spark, sf))
    return got.select(F.substr("name", F.lit(2)).cast("long").alias("doc_id"), "cyclomatic", "cognitive", "rating")


@query(f"""with {_LINES}, g as (select doc_id, any_value(source) as source, {_COGN} as cog from b group by 1), y as (select doc_id, {_CYC} as cyc from c), f as (select source, count(*) as n, avg(cyc) as a, avg(cog) as b from g join y using (doc_id) group by 1)
select count(*) as files, sum(n) as functions, round(sum(a * n) / sum(n), 6) as avg_cyclomatic, round(sum(b * n) / sum(n), 6) as avg_cognitive, count(*) filter (where greatest(a, b) > 10) as high_files, (select count(*) from g join y using (doc_id) where greatest(cyc, cog) > 20) as critical_functions from f""")
def project_complexity(spark, sf):
    got = analytics.project_complexity(analytics.function_complexity(functions(spark, sf)))
    return got.withColumns({c: F.round(c, 6) for c in ("avg_cyclomatic", "avg_cognitive")})


_SMELL = f"""{_LINES}, fn as (select doc_id, source, code, len(string_split(code, chr(10))) as n, doc_id % 9 as p from c), deep as (select doc_id, greatest(max(before + change), 0) as d from b group by 1),
nums as (select doc_id, len(list_filter(regexp_extract_all(code, '\\s+(-?\\d+\\.?\\d*)', 1), lambda x: try_cast(x as double) not in (0, 1, -1))) as k from c),
sm as (select 'long-method' as type, case when n <= 100 then 'medium' when n <= 200 then 'high' else 'critical' end as severity, doc_id from fn where n > 50
union all select 'long-parameter-list', case when p <= 7 then 'medium' when p <= 10 then 'high' else 'critical' end, doc_id from fn where p > 5
union all select 'deep-nesting', case when d <= 6 then 'medium' when d <= 8 then 'high' else 'critical' end, doc_id from deep where d > 4 union all select 'magic-number', 'low', doc_id from nums where k > 0)"""


@query(f"""with {_SMELL}, dom as (select 'type' as kind, unnest(['long-method', 'long-parameter-list', 'god-class', 'deep-nesting', 'duplicate-code', 'magic-number', 'complex-conditional', 'dead-code']) as name union all select 'severity', unnest(string_split('low medium high critical', ' '))),
cnt as (select 'type' as kind, type as name, count(*) as n from sm group by 2 union all select 'severity', severity, count(*) from sm group by 2) select kind, name, coalesce(n, 0) as n from dom left join cnt using (kind, name)""")
def smell_report(spark, sf):
    none = spark.createDataFrame([], "file_path string, name string, line int, end_line int, methods array<string>")
    empty = spark.createDataFrame([], "path string, content string")
    return analytics.smell_report(analytics.smells(functions(spark, sf), none, empty))


@query(f"with {_SMELL} select type, severity, 'f' || doc_id as name from sm where severity in ('high', 'critical')")
def smells_severe(spark, sf):
    none = spark.createDataFrame([], "file_path string, name string, line int, end_line int, methods array<string>")
    empty = spark.createDataFrame([], "path string, content string")
    return analytics.at_least(analytics.smells(functions(spark, sf), none, empty), "high").select("type", "severity", "name")


@query("""with l as (select doc_id, string_split(regexp_replace(text, '[.] ', chr(10), 'g'), chr(10)) as l from documents), b as (select doc_id, i as line, regexp_replace(array_to_string(l[i : i + 5], chr(10)), '^\\s+|\\s+$', '', 'g') as block from (select doc_id, l, unnest(range(1, len(l) - 5)) as i from l where len(l) > 6)),
k as (select * from b where length(block) >= 50) select distinct a.doc_id, a.line from k a join k z on a.doc_id = z.doc_id and a.block = z.block and z.line >= a.line + 6""")
def duplicate_blocks(spark, sf):
    d = texts(spark, sf).select("doc_id", F.regexp_replace("text", "[.] ", "\n").alias("content"))
    return analytics.duplicate_blocks(d, "doc_id").select(F.col("file_path").alias("doc_id"), "line")


@query("select min(doc_id) as first, count(*) as copies from documents group by sha256(text) having count(*) > 1")
def exact_duplicates(spark, sf):
    return t(spark, sf, "documents").groupBy(incremental.content_hash("text").alias("h")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("h")


_PATS = " union all ".join(f"select path, '{n}' as name, '{c}' as category, {k} as k from x where " + " or ".join(f"contains(low, '{w}')" for w in words.split()) for n, (c, k, words) in analytics.CONTENT_PATTERNS.items())


@query(f"with x as (select url as path, lower(html) || ' ' || case page_id % 17 when 0 then 'redis' when 1 then 'jwt' when 2 then 'graphql' else '' end as low from pages), p as ({_PATS}) select name, category, round(least(count(*) / max(k)::double, 1), 6) as confidence, count(*) as n from p group by 1, 2")
def pattern_confidence(spark, sf):
    hint = F.element_at(F.array(F.lit("redis"), F.lit("JWT"), F.lit("GraphQL"), *[F.lit("")] * 14), (F.col("page_id") % 17 + 1).cast("int"))
    p = texts(spark, sf, "pages").select(F.col("url").alias("path"), F.concat("html", F.lit(" "), hint).alias("content"))
    return analytics.patterns(p).select("name", "category", F.round("confidence", 6).alias("confidence"), F.size("files").cast("long").alias("n"))


_ARCH = "case doc_id % 10 when 0 then 'controllers/a' when 1 then 'models/b' when 2 then 'api/service' when 3 then 'events/q' else 'lib/x' end"


@query(f"""with p as (select {_ARCH} as path from documents), c as (select count(*) as n, count(*) filter (where contains(path, 'controller') or contains(path, 'view') or contains(path, 'model')) as mvc, count(*) filter (where contains(path, 'service') and contains(path, 'api')) as micro, count(*) filter (where contains(path, 'event')) as ev from p)
select case when greatest(mvc, micro, ev) = 0 then null when mvc >= greatest(micro, ev) and mvc > n * 0.15 then 'mvc' when micro >= greatest(mvc, ev) and micro > 5 then 'microservices' when ev >= greatest(mvc, micro) and ev > 5 then 'event-driven' else 'monolith' end as architecture from c""")
def architecture_vote(spark, sf):
    names = F.array(*[F.lit(x) for x in ("controllers/a", "models/b", "api/service", "events/q", *["lib/x"] * 6)])
    return analytics.architecture(t(spark, sf, "documents").select(F.element_at(names, (F.col("doc_id") % 10 + 1).cast("int")).alias("path")))


@query("with c as (select case when quality is null then 'low' when quality = 1 then 'high' else 'medium' end as c from documents left join labels using (doc_id)), s as (select count(*) as total, count(*) filter (where c = 'high') as high, count(*) filter (where c = 'medium') as medium, count(*) filter (where c = 'low') as low from c) select *, case when total = 0 or low > 0.5 * total then 'unhealthy' when high < 0.7 * total then 'degraded' else 'healthy' end as health from s")
def health_summary(spark, sf):
    rows = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left").select(F.when(F.col("quality").isNull(), "low").when(F.col("quality") == 1, "high").otherwise("medium").alias("confidence"))
    return analytics.confidence_health(rows)


# --- extraction ---


@query("select doc_id, line, text from (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)")
def chunk_lines(spark, sf):
    return extract.explode_lines(t(spark, sf, "documents"), "doc_id", "text").withColumn("line", F.col("line").cast("long"))


@query("""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as line from documents), f as (select *, line - row_number() over (partition by doc_id order by line) as g from l where (line * 7 + doc_id) % 4 <> 0)
select cast(doc_id as varchar) as file_path, min(line) as start_line, max(line) as end_line from f group by doc_id, g""")
def orphan_islands(spark, sf):
    lines = extract.explode_lines(t(spark, sf, "documents"), "doc_id", "text").select(F.col("doc_id").cast("string").alias("file_path"), "line", "doc_id")
    return extract.orphan_runs(lines.select("file_path", "line"), lines.filter((F.col("line") * 7 + F.col("doc_id")) % 4 == 0))


@query("select page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) as href from pages")
def page_links(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("href"))


def sources(spark) -> DataFrame:
    """A few files of source code."""
    ts = "import { Base, helper as h } from './base';\n\n/** A user. */\nexport class User extends Base implements Named {\n  private name: string;\n  getName(id: number): string {\n    if (id > 5) { return h(this.name); }\n    return new Cache(id).get(42);\n  }\n}\n\nexport interface Named { name: string; }\nexport type Id = string | number;\nexport const LIMIT = 10;\n\nexport async function load(path: string, depth = 2): Promise<User> {\n  const u = await fetch(path);\n  return u ? u : make();\n}\n"
    base = "export class Base {\n  getName(id: number): string {\n    return '';\n  }\n}\nexport const helper = (x: string) => x;\n"
    py = "import os\nfrom .base import thing, other\n\nMAX_SIZE = 5\n\nclass Store:\n    def get(self, key):\n        return os.environ[key]\n\nasync def main(argv):\n    Store().get('a')\n"
    return spark.createDataFrame([("src/user.ts", ts), ("src/base.ts", base), ("src/store.py", py)], "path string, content string")


@query()
def extract_symbols(spark, sf):
    return extract.symbols(sources(spark))


@query()
def extract_imports(spark, sf):
    return extract.imports(sources(spark))


@query()
def extract_calls(spark, sf):
    return extract.calls(sources(spark))


@query()
def chunks_by_line(spark, sf):
    return extract.line_chunks(files(spark, sf))


@query()
def chunks_by_syntax(spark, sf):
    return extract.cast_chunks(files(spark, sf))


@query()
def built_graph(spark, sf):
    src = sources(spark)
    return graph.build(extract.symbols(src), extract.imports(src), extract.calls(src), incremental.dependency_edges(incremental.resolve_imports(extract.imports(src), src))).edges


@query("""with u as (select 'src' || (l_orderkey % 20) as file_path, 'part' || (l_partkey % 300) as name, l_orderkey, l_linenumber from lineitem), s as (select 'src' || (p_partkey % 20) as file_path, 'part' || p_partkey as name, p_partkey as line, 's' || p_partkey as id from part where p_partkey % 3 <> 0)
select u.l_orderkey, u.l_linenumber, u.name, coalesce(a.id, b.id, 'type:' || u.name) as target, coalesce(a.id, b.id) is not null as known from u left join s a on a.file_path = u.file_path and a.name = u.name left join s b on b.name = u.name""")
def symbol_resolution(spark, sf):
    u = t(spark, sf, "lineitem").select(F.concat(F.lit("src"), (F.col("l_orderkey") % 20).cast("string")).alias("file_path"), F.concat(F.lit("part"), (F.col("l_partkey") % 300).cast("string")).alias("name"), "l_orderkey", "l_linenumber")
    s = t(spark, sf, "part").filter("p_partkey % 3 <> 0").select(F.concat(F.lit("src"), (F.col("p_partkey") % 20).cast("string")).alias("file_path"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("line"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("id"))
    return graph.resolve(u, s).select("l_orderkey", "l_linenumber", "name", "target", "known")


@query("""with cls as (select 'C' || p_partkey as child, 'C' || (p_partkey // 10) as parent from part where p_partkey >= 10), m as (select 'C' || p_partkey as owner, 'm' || (p_size % 5) as method from part)
select distinct child, parent, a.method from cls join m a on a.owner = child join m b on b.owner = parent and a.method = b.method""")
def override_join(spark, sf):
    p = t(spark, sf, "part")
    name = F.concat(F.lit("C"), F.col("p_partkey").cast("string"))
    c = p.select(name.alias("name"), F.lit("class").alias("kind"), F.lit(None).cast("string").alias("parent"), F.when(F.col("p_partkey") >= 10, F.array(F.concat(F.lit("C"), F.floor(F.col("p_partkey") / 10).cast("string")))).otherwise(F.array().cast("array<string>")).alias("extends"))
    m = p.select(F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string")).alias("name"), F.lit("method").alias("kind"), name.alias("parent"), F.array().cast("array<string>").alias("extends"))
    return graph.overrides(c.unionByName(m))


@query("""with s as (select doc_id, generate_series as line from documents, generate_series(1, 30)), c as (select doc_id, k * 8 + 1 as a, k * 8 + 8 as b from (select doc_id from documents), (select generate_series as k from generate_series(0, 2)))
select cast(c.doc_id as varchar) || ':' || a as id, s.line from c join s on s.doc_id = c.doc_id and s.line between a and b""")
def symbols_in_range(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_path"))
    s = d.select("file_path", F.lit("x").alias("name"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("line"))
    k = d.select("file_path", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    c = k.select(F.concat("file_path", F.lit(":"), (F.col("k") * 8 + 1).cast("string")).alias("id"), "file_path", (F.col("k") * 8 + 1).alias("start_line"), (F.col("k") * 8 + 8).alias("end_line"))
    return extract.symbols_in_chunks(c, s).select("id", "line")


# --- memory ---


def history(spark, sf):
    q = memory.pair_turns(t(spark, sf, "conversations"))
    empty = F.array().cast("array<string>")
    return q.select("session_id", "ord", F.concat_ws("-", "session_id", "ord").alias("id"), "question", "response", F.array(F.concat(F.lit("src/mod"), (F.col("session_id") % 7).cast("string"), F.lit("/a.ts"))).alias("files"), F.when(F.col("ord") % 4 == 0, F.array(F.lit("getUserHandler"))).otherwise(empty).alias("symbols"), (F.col("ord") % 3 != 1).alias("successful"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("session_id").cast("int"))).alias("ts"))


_HIST = """h as (select conv_id as session_id, turn as ord, text as question, nt as response from (select *, lead(text) over (partition by conv_id order by turn) as nt, lead(role) over (partition by conv_id order by turn) as nr from conversations) where role = 'user' and nr = 'assistant')"""


@query(f"with {_HIST} select session_id, ord, question, response from h")
def turn_pairs(spark, sf):
    return memory.pair_turns(t(spark, sf, "conversations"))


@query(f"""with {_HIST}, s as (select session_id, ord, case when contains(lower(question), 'erin') then 2 else 0 end + case when contains(lower(response), 'erin') then 1 else 0 end as score from h), k as (select * from s where score > 0 order by session_id, ord limit 50) select session_id, ord, score from k""")
def history_search(spark, sf):
    return memory.search(history(spark, sf), "Erin").select("session_id", "ord", "score")


_TOPICS = " union all ".join(f"select session_id, ord, {i} as i, lower(regexp_extract(question, '(?i)({'|'.join(words)})', 1)) as topic from h" for i, words in enumerate(memory.CONCERNS))


@query(f"""with {_HIST}, raw as ({_TOPICS}), one as (select session_id, ord, topic, min(i) as i from raw where topic <> '' group by 1, 2, 3), top as (select *, row_number() over (partition by session_id, ord order by i) as n from one),
w as (select session_id, ord, topic, 2 as w from top where n <= 5 union all select session_id, ord, 'mod' || (session_id % 7), 1 from h union all select session_id, ord, 'user', 1 from h where ord % 4 = 0), s as (select session_id, topic, sum(w) as score, min(ord) as first from w group by 1, 2)
select session_id, topic, cast(score as bigint) as score, cast(rank as integer) as rank from (select *, row_number() over (partition by session_id order by score desc, first, topic) as rank from s) where rank <= 10""")
def topics(spark, sf):
    return memory.top_topics(history(spark, sf), ["session_id"]).select("session_id", "topic", "score", "rank")


_KS = memory.KEY_SENTENCE.replace("'", "''")


@query(f"""with {_HIST}, p as (select session_id, ord, list_transform(regexp_split_to_array(replace(response, ' the ', ' because '), '[.!?]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')) as s from h)
select session_id, ord, array_to_string(list_filter(s, lambda x: length(x) > 20 and length(x) < 200 and regexp_matches(x, '{_KS}'))[1:3], '|') as sentences from p""")
def key_sentences(spark, sf):
    said = memory.key_sentences(F.replace("response", F.lit(" the "), F.lit(" because ")))
    return history(spark, sf).select("session_id", "ord", F.array_join(said, "|").alias("sentences"))


@query()
def session_summaries(spark, sf):
    return memory.summarize(history(spark, sf))


@query(f"with {_HIST} select (select count(distinct conv_id) from conversations) as sessions, (select count(distinct conv_id) from conversations where conv_id % 5 = 0) as active, count(*) as queries, count(*) filter (where ord % 3 <> 1) as successful, count(distinct session_id % 7) as files, (select count(*) from (select 1 from h where ord % 4 = 0 limit 1)) as symbols from h")
def memory_stats(spark, sf):
    s = t(spark, sf, "conversations").select(F.col("conv_id").alias("session_id")).distinct().withColumn("ended_at", F.when(F.col("session_id") % 5 != 0, F.lit("x")))
    return memory.stats(s, history(spark, sf))


@query("with s as (select user_id, cast(ts as date) as day, min(ts) as started_at from events group by 1, 2), m as (select max(ts) as now from events) select user_id || '-' || day as session_id, started_at from s, m where started_at >= now - interval 10 days order by started_at desc, session_id limit 100")
def retention(spark, sf):
    e = t(spark, sf, "events")
    s = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("started_at")).select(F.concat_ws("-", "user_id", "day").alias("session_id"), "started_at")
    now = e.agg(F.max("ts").alias("now"))
    return memory.retained(s.crossJoin(F.broadcast(now)), F.col("now"), 10).select("session_id", "started_at")  # one row


@query("select user_id as session_id, event_id as ord, n from (select *, row_number() over (partition by user_id order by event_id) as n from events) where n % 10 = 0")
def due_summaries(spark, sf):
    return memory.due_summaries(t(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"))).withColumn("n", F.col("n").cast("long"))


# --- thinking ---


def thoughts(spark, sf):
    e = t(spark, sf, "events")
    kind = F.create_map(*[F.lit(x) for x in ("click", "analysis", "view", "hypothesis", "purchase", "verification", "signup", "question", "error", "revision")])[F.col("event_type")]
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("session_id"), F.lit("main").alias("branch"), F.col("event_id").alias("number"), kind.alias("type"), F.col("props").alias("content"), (F.pmod(F.col("event_id") * 37, F.lit(101)) / 100).alias("confidence"), F.lit(None).cast("string").alias("revises"), F.array("event_type").alias("files"))


_TH = "th as (select user_id as session_id, event_id as number, case event_type when 'click' then 'analysis' when 'view' then 'hypothesis' when 'purchase' then 'verification' when 'signup' then 'question' else 'revision' end as type, (event_id * 37 % 101) / 100.0 as c from events)"


@query(f"with {_TH}, w as (select *, 1 + 0.5 * (row_number() over (partition by session_id order by number) - 1) as w from th), s as (select session_id, sum(w * c) / sum(w) as confidence from w group by 1) select session_id, round(confidence, 6) as confidence, case when confidence >= 0.8 then 'high' when confidence >= 0.5 then 'medium' else 'low' end as level from s")
def thought_confidence(spark, sf):
    return thinking.confidence(thoughts(spark, sf), ["session_id"], ["number"]).withColumn("confidence", F.round("confidence", 6))


@query(f"""with {_TH}, l as (select session_id, count(*) as n, arg_max(type, number) as type, arg_max(c, number) as c, min(case when c < 0.5 and type <> 'revision' then number end) as weak from th group by 1)
select session_id, n < 10 and not (type = 'verification' and c >= 0.7) as go_on, case when n >= 2 then weak end as revise, case when type = 'analysis' then case when n < 3 then 'analysis' else 'hypothesis' end
when type = 'hypothesis' then 'verification' when type = 'verification' and c >= 0.7 then 'conclusion' when type = 'revision' then 'analysis' when n >= 9 then 'conclusion' else 'analysis' end as suggested from l""")
def next_step(spark, sf):
    return thinking.next_steps(thoughts(spark, sf))


@query("select cast(event_id as varchar) as id, cast(lag(event_id) over (partition by user_id order by event_id) as varchar) as parent_id from events")
def thought_parents(spark, sf):
    return thinking.with_parents(thoughts(spark, sf)).select("id", "parent_id")


@query("""with recursive p as (select event_id, lag(event_id) over (partition by user_id order by event_id) as parent from events), k(id, depth) as (select 900, 0 union all select parent, depth + 1 from k join p on event_id = id where parent is not null) select cast(id as varchar) as id, depth from k""")
def thought_lineage(spark, sf):
    return thinking.lineage(thinking.with_parents(thoughts(spark, sf)), "900")


@query()
def thinking_final(spark, sf):
    return thinking.finalize(thoughts(spark, sf))


# --- libraries ---


@query("select p_partkey, p_name || ' ' || p_partkey as name from part where (contains(p_name || ' ' || p_partkey, '12') or contains(lower(p_type), '12') or contains(lower(p_brand), '12')) and p_brand in ('Brand#11', 'Brand#12', 'Brand#13') order by p_brand, p_name || ' ' || p_partkey limit 20")
def api_search(spark, sf):
    e = t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("library"), F.concat_ws(" ", "p_name", "p_partkey").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("signature"), F.col("p_brand").alias("type"))
    return library.search_api(e, "12", ["Brand#11", "Brand#12", "Brand#13"]).select("p_partkey", "name")


# --- streams, in batch form ---


@query("""with g as (select user_id, ts, event_type, event_id, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id as path, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) as events from s group by user_id, s""")
def session_debounce(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("type"), "ts")
    return streams.debounced(e, gap="30 minutes").drop("last")


@query("select time_bucket(interval 1 hour, ts) as start, time_bucket(interval 1 hour, ts) + interval 1 hour as \"end\", event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3")
def tumbling(spark, sf):
    return streams.tumbling(t(spark, sf, "events"), ["event_type"], "value")


@query("""with w as (select *, unnest([time_bucket(interval 30 minutes, ts), time_bucket(interval 30 minutes, ts) - interval 30 minutes]) as start from events) select start, start + interval 1 hour as "end", event_type, count(*) as n, round(sum(value), 4) as total from w group by 1, 2, 3""")
def sliding(spark, sf):
    return streams.sliding(t(spark, sf, "events"), ["event_type"], "value")


@query("select user_id as path, event_type as type, ts from (select *, row_number() over (partition by user_id order by ts desc) as r from events) where r = 1")
def latest_changes(spark, sf):
    return streams.latest_per_key(t(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("type"), "ts"))


from . import lookups  # noqa: E402, F401 - adds its queries to QUERIES and SQL
