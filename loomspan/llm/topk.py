"""Exact top-k search by a three-phase uniform threshold over term-partitioned score lists."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SpanHash, chunks, equal_spans, small_batches, text_bytes, words, written

K1, B = 1.2, 0.75
#: Partial scores are sums of doubles in any order: cutoffs are lowered by this much.
SLACK = 1e-5
#: Queries scored at once, and scores and weights (8 bytes each) that a worker holds for that; they bound memory, not the work.
TOGETHER, HELD = 256, 4_000_000
_NOT_WORD = "[\\x00-/:-@\\[-`{-\\x7f]+"


def query_terms(queries: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(row, query_id, term, qtf): the words of each query row (runs of ASCII letters, digits and non-ASCII characters, lower-cased)."""
    rows = queries.filter(F.col(key).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("query_id"), F.col(text).alias("t"))
    return rows.select("row", "query_id", F.explode(F.split(F.lower("t"), _NOT_WORD)).alias("term")).filter("term <> ''").groupBy("row", "query_id", "term").agg(F.count("*").alias("qtf"))


def postings(docs: DataFrame, vocabulary: list[str], nodes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, doc_id, dl, terms, tfs): the score list entries of each document on each node. Node -1 has every document's length.

    Term t of the vocabulary lies on node t % nodes, as in a term-partitioned index.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema({"node": pa.int32(), "doc_id": pa.int64(), "dl": pa.int64(), "terms": pa.list_(pa.int32()), "tfs": pa.list_(pa.int32())})

    def index(batches):
        terms = [t.encode() for t in held.value]
        joined, term_ends = np.frombuffer(b"".join(terms), np.uint8), np.cumsum([len(t) for t in terms], dtype=np.int64)
        term_starts, tries = np.concatenate([[0], term_ends[:-1]]).astype(np.int64) if terms else term_ends, iter(range(99))
        while True:  # until no two terms share a hash
            hashed = SpanHash(next(tries))
            known = hashed(joined, term_starts, term_ends)
            if len(np.unique(known)) == len(known):
                break
        order = np.argsort(known)
        known = known[order]
        for batch in batches:
            for part in chunks(batch, "text"):
                data, starts = text_bytes(part.column("text"))
                begin, end, n = words(data, starts)
                h, doc = hashed(data, begin, end), np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                maybe = np.flatnonzero(hit)
                hit[maybe] = equal_spans(data, begin[maybe], end[maybe], joined, term_starts[order[at[maybe]]], term_ends[order[at[maybe]]])
                pair, tf = np.unique(doc[hit] * np.int64(len(terms)) + order[at[hit]], return_counts=True)
                doc, term = (pair // max(1, len(terms)), pair % max(1, len(terms))) if len(pair) else (pair, pair)
                keys = part.column("key")
                yield pa.record_batch([pa.array(np.full(len(n), -1, np.int32)), keys, pa.array(n.astype(np.int64)), *[pa.array([[]] * len(n), pa.list_(pa.int32()))] * 2], schema=schema)
                for node in range(nodes):
                    mine = term % nodes == node
                    d, begins = np.unique(doc[mine], return_index=True)
                    ends_ = pa.array(np.append(begins, mine.sum()).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(ends_, pa.array(x[mine].astype(np.int32))) for x in (term, tf)]
                    yield pa.record_batch([pa.array(np.full(len(d), node, np.int32)), keys.take(pa.array(d)), pa.array(n[d].astype(np.int64)), *lists], schema=schema)

    rows = small_batches(docs).filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.lower(F.col(text)).alias("text"))
    return rows.mapInArrow(index, "node int, doc_id long, dl long, terms array<int>, tfs array<int>")


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, nodes: int = 4, key: str = "doc_id", query_key: str = "item_id", text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): for every row of queries the k documents with the highest BM25 score, exactly.

    A document's score is the sum, over the nodes that hold the query's terms, of its partial scores there. Phase 1: each
    node gives its k best partial scores for each query; the k-th best sum of these is a lower bound t1 of the k-th score.
    Phase 2: the cutoff t1 / nodes is sent to all nodes, which give every entry at or above it; a document below it on
    every node can't reach t1. The k-th best sum is now t2; of the documents seen, those stay whose sum plus the cutoff for
    each node that didn't give them reaches t2. Phase 3: these documents' partial scores are looked up and summed in full.

    Scores are rounded to 6 digits; ties go to the lower doc_id. Documents that share no word with a query aren't found, so
    a query may have fewer than k rows; a null or empty query has none, and a row with a null query id isn't one. Rows that
    repeat a query id are queries each, with ranks of their own under the same id. Null texts count as documents of no
    words; rows with a null doc_id can't be returned and don't count. Rows that repeat a doc_id are one document with the
    words of all of them. Whole texts are read, however long. No documents or no queries: no rows. Extra columns are ignored.

    How it runs: texts are read once, into score lists of the queries' vocabulary written to the shared folder by node. What
    is sent to the workers follows the queries' words, and one cutoff for each query. Workers score TOGETHER queries at a
    time against blocks of entries of bounded size. Terms are matched by hash and compared byte by byte.
    """
    if k < 1 or nodes < 1:
        raise ValueError("k and nodes must be 1 at least")
    spark = docs.sparkSession
    q = query_terms(queries, query_key, text)
    wanted = q.collect()  # the size of the query table's words
    kind = dict(q.dtypes)["query_id"]
    result = f"query_id {kind}, rank int, doc_id long, score double"
    vocabulary = sorted({r.term for r in wanted})
    query_of = {r.row: r.query_id for r in wanted}
    column = {r: j for j, r in enumerate(sorted(query_of))}
    ids = [query_of[r] for r in sorted(query_of)]
    if not wanted:
        return spark.createDataFrame([], result)
    lists = written(postings(docs, vocabulary, nodes, key, text), "postings")
    whole = lists.filter("node = -1").groupBy("doc_id").agg(F.sum("dl").alias("dl"))
    size = whole.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).head()
    if not size.n or not size.mean:
        return spark.createDataFrame([], result)
    repeated = lists.filter("node = -1").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    entries = lists.filter("node >= 0")
    if not repeated.isEmpty():
        twice = entries.join(repeated, "doc_id", "left_semi").select("node", "doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("e"))
        summed = twice.groupBy("node", "doc_id", "e.terms").agg(F.sum("e.tfs").cast("int").alias("tfs"))
        again = summed.groupBy("node", "doc_id").agg(F.collect_list(F.struct("terms", "tfs")).alias("e")).join(whole, "doc_id").select("node", "doc_id", "dl", "e.terms", "e.tfs")
        entries = written(entries.join(repeated, "doc_id", "left_anti").select("node", "doc_id", "dl", "terms", "tfs").unionByName(again), "postings")

    df = np.zeros(len(vocabulary), np.int64)
    for r in entries.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r.t] = r["count"]
    idf = np.log(1 + (size.n - df + 0.5) / (df + 0.5))
    row = {t: i for i, t in enumerate(vocabulary)}
    entry_q, entry_t = np.array([column[r.row] for r in wanted], np.int64), np.array([row[r.term] for r in wanted], np.int64)
    entry_w = np.array([r.qtf for r in wanted], np.float64) * idf[entry_t]
    by_query = np.argsort(entry_q, kind="stable")
    held, mean = spark.sparkContext.broadcast((entry_q[by_query], entry_t[by_query], entry_w[by_query])), float(size.mean)

    def blocks_of(node):
        """(first query, terms, weights) of TOGETHER queries each: their terms on the node, and terms x queries."""
        q_, t_, w_ = held.value
        for low in range(0, len(ids), TOGETHER):
            a, z = np.searchsorted(q_, [low, low + TOGETHER])
            mine = a + np.flatnonzero(t_[a:z] % nodes == node)
            terms, at = np.unique(t_[mine], return_inverse=True)
            w = np.zeros((len(terms), min(TOGETHER, len(ids) - low)))
            w[at, q_[mine] - low] = w_[mine]
            yield low, terms, w

    def partial(batches, pick):
        """Partial scores (documents x queries) of as many entries and queries as HELD allows; `pick` chooses what is given."""
        made = {}
        for batch in batches:
            node, counts = batch.column("node").to_numpy(), np.diff(batch.column("terms").offsets.to_numpy())
            keys, dl = batch.column("doc_id").to_numpy(), batch.column("dl").to_numpy()
            term, tf = batch.column("terms").flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
            at = np.repeat(np.arange(len(keys)), counts)
            impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[at] / mean))
            for j in np.unique(node).tolist():
                mine = np.flatnonzero(node == j)
                local = np.full(len(keys), -1)
                local[mine] = np.arange(len(mine))
                use = node[at] == j
                doc, of, x = local[at[use]], term[use], impact[use]
                if len(ids) <= TOGETHER and j not in made:
                    made[j] = list(blocks_of(j))
                for low, terms, w in made.get(j) or blocks_of(j):
                    if not len(terms):
                        continue
                    place = np.minimum(np.searchsorted(terms, of), len(terms) - 1)
                    asked = terms[place] == of
                    d, p, y = doc[asked], place[asked], x[asked]
                    step = max(1, HELD // (len(terms) + w.shape[1]))
                    for a in range(0, len(mine), step):
                        b, z = np.searchsorted(d, [a, a + step])
                        dense = np.zeros((min(step, len(mine) - a), len(terms)))
                        dense[d[b:z] - a, p[b:z]] = y[b:z]
                        yield from pick(j, low, keys[mine[a : a + step]], dense @ w)

    rows = pa.schema({"node": pa.int32(), "q": pa.int32(), "doc_id": pa.int64(), "score": pa.float64()})
    flat = "node int, q int, doc_id long, score double"

    def as_batch(node, q_, docs_, scores):
        return pa.record_batch([pa.array(np.full(len(q_), node, np.int32)), pa.array(q_.astype(np.int32)), pa.array(docs_), pa.array(scores)], schema=rows)

    def first(batches):
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def keep(node, low, keys, scores):
            old = best.get((node, low))
            s = scores.T if old is None else np.concatenate([old[0], scores.T], 1)
            d = np.broadcast_to(keys, scores.T.shape) if old is None else np.concatenate([old[1], np.broadcast_to(keys, scores.T.shape)], 1)
            if s.shape[1] > k:
                top = np.argpartition(-s, k - 1, 1)[:, :k]
                s, d = np.take_along_axis(s, top, 1), np.take_along_axis(d, top, 1)
            best[node, low] = s, d
            return ()

        for _ in partial(batches, keep):
            pass
        for (node, low), (s, d) in best.items():
            q_, i = np.nonzero(s > 0)
            yield as_batch(node, q_ + low, d[q_, i], s[q_, i])

    local = entries.mapInArrow(first, flat)
    in_node = Window.partitionBy("node", "q").orderBy(F.desc("score"), "doc_id")
    phase1 = local.withColumn("r", F.row_number().over(in_node)).filter(F.col("r") <= k).groupBy("q", "doc_id").agg(F.sum("score").alias("score"))
    cut = np.zeros(len(ids))
    for r in _kth(phase1, k).collect():
        cut[r.q] = max(0.0, r.score - SLACK) / nodes
    cuts = spark.sparkContext.broadcast(cut)

    def second(batches):
        def keep(node, low, keys, scores):
            q_, i = np.nonzero((scores.T >= cuts.value[low : low + TOGETHER, None]) & (scores.T > 0))
            yield as_batch(node, q_ + low, keys[i], scores[i, q_])

        yield from partial(batches, keep)

    limits = spark.createDataFrame([(j, float(c)) for j, c in enumerate(cut)], "q int, cut double")
    seen = written(entries.mapInArrow(second, flat).groupBy("q", "doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("given")), "seen")
    bounds = _kth(seen, k).select("q", F.col("score").alias("t2"))
    stay = seen.join(F.broadcast(bounds), "q", "left").join(F.broadcast(limits), "q")  # one row for each query
    stay = stay.filter(F.col("score") + (nodes - F.col("given")) * F.col("cut") >= F.coalesce(F.col("t2"), F.lit(0.0)) - SLACK).select("q", "doc_id")

    term_weights = spark.createDataFrame(pa.table({"t": entry_t.astype(np.int32), "q": entry_q.astype(np.int32), "w": entry_w}))
    found = entries.join(stay.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("e"))
    scored = stay.join(found, "doc_id").select("q", "doc_id", "dl", F.col("e.terms").alias("t"), F.col("e.tfs").alias("tf")).join(term_weights, ["q", "t"])
    impact = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    scored = scored.groupBy("q", "doc_id").agg(F.round(F.sum(impact), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(ids)), f"q int, query_id {kind}")
    return ranked.join(F.broadcast(names), "q").select("query_id", "rank", "doc_id", "score")


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """(q, score): the k-th highest score of each query that has k."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("q", "score")


def brute_words(text: str | None) -> list[str]:
    return [w for w in re.split("[\x00-/:-@\\[-`{-\x7f]+", (text or "").lower()) if w]


def oracle(k: int) -> str:
    split = r"'[\x00-/:-@\[-`{-\x7f]+'"
    return f"""
with qt as (select item_id as q, unnest(regexp_split_to_array(lower(text), {split})) as term from benchmark),
qw as (select q, term, count(*) as qtf from qt where term <> '' group by 1, 2),
dt as (select doc_id, unnest(regexp_split_to_array(lower(text), {split})) as term from documents),
tf as (select doc_id, term, count(*) as tf from dt where term <> '' group by 1, 2),
dl as (select d.doc_id, coalesce(sum(tf), 0) as dl from documents d left join tf using (doc_id) group by 1),
corpus as (select count(*) as n, avg(dl) as mean from dl),
df as (select term, count(*) as df from tf group by 1),
scored as (select q, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / mean))), 6) as score
  from qw join tf using (term) join df using (term) join dl using (doc_id), corpus group by 1, 2),
ranked as (select *, row_number() over (partition by q order by score desc, doc_id) as rank from scored)
select q as query_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= {k}"""
