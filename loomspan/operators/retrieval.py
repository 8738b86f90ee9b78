"""Sparse, dense and fused retrieval."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.scoring import let
from ..functions.text import bm25_count, bm25_length, bm25_normal, bm25_tokens, embedding_tokens
from .graph import cut
from .layout import spread


@dataclass
class InvertedIndex:
    """postings (term, id, tf, len) and lengths (id, len); what depends on the corpus is derived when it is asked for."""

    postings: DataFrame
    lengths: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, key: str = "id", content: str = "content") -> InvertedIndex:
        tokens = spread(docs.select(key, content)).select(F.col(key).alias("id"), F.coalesce(bm25_tokens(content), F.array().cast("array<string>")).alias("tokens"))
        postings = tokens.select("id", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy("term", "id", "len").agg(F.count("*").alias("tf"))
        return cls(postings, tokens.select("id", F.size("tokens").alias("len")))

    def add(self, docs: DataFrame, key: str = "id", content: str = "content") -> InvertedIndex:
        """Documents replace those of the same id."""
        new = InvertedIndex.build(docs, key, content)
        kept = self.remove(new.lengths.select("id"))
        return InvertedIndex(kept.postings.unionByName(new.postings), kept.lengths.unionByName(new.lengths))

    def remove(self, ids: DataFrame) -> InvertedIndex:
        return InvertedIndex(self.postings.join(ids, "id", "left_anti"), self.lengths.join(ids, "id", "left_anti"))

    def term_stats(self, bounded: bool = False) -> DataFrame:
        """(term, df, idf); bounded leaves out terms outside the document-frequency bounds."""
        n = self.lengths.agg(F.count("*").alias("n"))
        stats = self.postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # one row
        if bounded:
            most = F.when(F.col("n") <= 10, F.col("n")).otherwise(F.floor(F.col("n") * 0.9))
            stats = stats.filter((F.col("df") <= most) & (F.col("df") >= 1))
        return stats.select("term", "df", scoring.idf(F.col("n"), F.col("df")).alias("idf"))

    def corpus_stats(self) -> DataFrame:
        """(size, mean_length, vocabulary)"""
        return self.lengths.agg(F.count("*").alias("size"), F.avg("len").alias("mean_length")).crossJoin(self.postings.agg(F.countDistinct("term").alias("vocabulary")))

    def search(self, query: str, k: int = 10, within: DataFrame | None = None) -> DataFrame:
        """(id, score): the k best, of the documents `within` (id) if given; a word that the query repeats counts as often;
        ties go to the lower id. Only postings of the query's words are counted, shuffled or, if stored, read."""
        spark = self.postings.sparkSession
        words = query_tokens(spark, query)
        hits = self.postings.filter(F.col("term").isin(sorted(set(words))))
        df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each word of the query
        times = F.create_map(*[F.lit(x) for w in sorted(set(words)) for x in (w, words.count(w))])[F.col("term")] if words else F.lit(0)
        corpus = self.lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
        if within is not None:
            hits = hits.join(within.select("id"), "id", "left_semi")
        scored = hits.withColumn("qtf", times).join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus))
        term = scoring.bm25_term(scoring.idf(F.col("n"), F.col("df")), F.col("tf"), F.col("len"), F.col("mean"))
        return scored.groupBy("id").agg(F.sum(F.col("qtf") * term).alias("score")).orderBy(F.desc(F.round("score", 6)), "id").limit(k)

    def save(self, path: str) -> None:
        # Sorted by term: a search reads the row groups of its words alone.
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> InvertedIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))


def bm25_search(docs: DataFrame, query: str, k: int = 10, key: str = "id", content: str = "content") -> DataFrame:
    """(id, score): BM25 over documents without a stored index. No row is shuffled: term counts are taken in each row and, narrow
    as they are, written to the shared folder, so that texts are read once; corpus counts are one row, and the k best are
    kept by a bounded heap."""
    words: dict[str, int] = {}
    for w in query_tokens(docs.sparkSession, query):
        words[w] = words.get(w, 0) + 1
    terms = list(words)
    empty = docs.select(F.col(key).alias("id"), F.lit(0.0).alias("score")).limit(0)
    if not terms:
        return empty
    rows = spread(docs.select(key, content)).select(F.col(key).alias("id"), F.coalesce(bm25_normal(content), F.lit(" ")).alias("t"))
    rows = rows.select("id", bm25_length(F.col("t")).alias("len"), *[bm25_count(F.col("t"), w).alias(f"tf{i}") for i, w in enumerate(terms)])
    rows = cut(rows)
    corpus = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i, w in enumerate(terms):
        score = score + words[w] * scoring.bm25_term(scoring.idf(F.col("n"), F.col(f"df{i}")), F.col(f"tf{i}"), F.col("len"), F.col("mean"))
    scored = rows.crossJoin(F.broadcast(corpus)).select("id", score.alias("score")).filter("score > 0")
    return scored.orderBy(F.desc(F.round("score", 6)), "id").limit(k)


def query_tokens(spark: SparkSession, query: str) -> list[str]:
    return spark.range(1).select(bm25_tokens(F.lit(query)).alias("t")).head().t


# --- dense ---


@dataclass
class VectorStore:
    """Embedded chunks (id, embedding, file_path, language ...) as a table."""

    rows: DataFrame

    def add(self, more: DataFrame) -> VectorStore:
        return VectorStore(self.rows.join(more.select("id"), "id", "left_anti").unionByName(more, allowMissingColumns=True))

    def delete(self, ids: list) -> VectorStore:
        return VectorStore(self.rows.filter(~F.col("id").isin(ids)))

    def delete_by_file(self, path: str) -> VectorStore:
        return VectorStore(self.rows.filter(~F.col("file_path").eqNullSafe(path)))

    def count(self) -> int:
        return self.rows.count()

    def clear(self) -> VectorStore:
        return VectorStore(self.rows.limit(0))

    def search(self, vector: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
        return vector_search(self.rows if where is None else self.rows.filter(where), vector, k)

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorStore:
        return cls(spark.read.parquet(path))


def vector_search(rows: DataFrame, vector: list[float] | DataFrame, k: int = 10, key: str = "id", column: str = "embedding") -> DataFrame:
    """(id, score): the k nearest by cosine; a filter belongs before. vector: numbers, or a DataFrame of one row (q)."""
    if isinstance(vector, DataFrame):
        rows, q = rows.crossJoin(F.broadcast(vector.limit(1))), F.col("q")
    else:
        q = F.array(*[F.lit(float(x)) for x in vector])
    scored = rows.select(F.col(key).alias("id"), scoring.cosine(F.col(column), q).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 6)), "id").limit(k)


def _runs(ordered: Column) -> Column:
    """(t, n): each value of a sorted array and how often it stands there."""
    n = F.size(ordered)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (n > 0) & ((i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))))
    return let(starts, lambda s: F.transform(s, lambda a, j: F.struct(F.get(ordered, a).alias("t"), (F.coalesce(F.get(s, j + 1), n) - a).alias("n"))))


class EmbeddingProvider(Protocol):
    """What turns texts into vectors: a name and a model, which cached vectors are kept by, and an expression."""

    name: str
    model: str

    def embed(self, content: Column) -> Column: ...


@dataclass
class CallbackProvider:
    """A provider that a host gives: `call` takes a list of texts and returns as many vectors. It is called with up to `batch`
    texts at a time, and in each of Spark's tasks no more than `per_second` times a second."""

    name: str
    model: str
    call: Callable[[list[str]], list[list[float]]]
    batch: int = 50
    per_second: float | None = None

    def embed(self, content: Column) -> Column:
        call, batch, wait = self.call, self.batch, 1 / self.per_second if self.per_second else 0.0

        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            last = 0.0
            for part in parts:
                out: list[list[float]] = []
                for low in range(0, len(part), batch):
                    time.sleep(max(0.0, last + wait - time.monotonic()))
                    last = time.monotonic()
                    out += call([x or "" for x in part[low : low + batch]])
                yield pd.Series(out)

        return F.pandas_udf(run, "array<double>")(content)


@dataclass
class TfIdfEmbedder:
    """Vocabulary of the `dimensions` terms with the highest document frequency, fitted once over the corpus."""

    vocabulary: list[tuple[str, float]]
    dimensions: int = 512
    name: str = "local"
    model: str = "tf-idf"

    def embed(self, content: Column) -> Column:
        return self.transform(content)

    @classmethod
    def fit(cls, docs: DataFrame, content: str = "content", dimensions: int = 512) -> TfIdfEmbedder:
        tokens = docs.select(F.array_distinct(embedding_tokens(content)).alias("t"))
        n = docs.count()
        # explode would be preceded by a filter on the list's size, which tokenizes each text again.
        top = tokens.select(F.explode_outer("t").alias("term")).filter("term is not null").groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(dimensions)
        got = top.select("term", F.log(F.lit(n) / (F.col("df") + 1)).alias("idf")).collect()
        return cls([(r.term, r.idf if r.idf else 1.0) for r in got], dimensions)

    def transform(self, content: Column) -> Column:
        """Counts over the greatest count, times idf, of length 1 (all zeros if no term is known)."""
        tokens = F.coalesce(embedding_tokens(content), F.array().cast("array<string>"))
        known = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(float(i)).alias("i")) for t, i in self.vocabulary])
        raw = let(F.array_sort(tokens), lambda o: let(_runs(o), lambda runs: let(F.map_from_entries(runs), lambda held: let(
            F.array_max(F.transform(runs, lambda r: r["n"])).cast("double"),
            lambda most: F.transform(known, lambda v: F.coalesce(F.try_divide(F.try_element_at(held, v["t"]).cast("double"), most), F.lit(0.0)) * v["i"]),
        ))))
        padded = F.concat(raw, F.array_repeat(F.lit(0.0), self.dimensions - len(self.vocabulary))) if self.vocabulary else F.array_repeat(F.lit(0.0), self.dimensions)
        return scoring.l2_normalize(padded)


def cache_key(content: Column, provider: EmbeddingProvider) -> Column:
    return F.concat_ws(":", F.lit(provider.name), F.lit(provider.model), F.sha2(content, 256))


def embed_missing(chunks: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], provider: str = "local", model: str = "tf-idf") -> DataFrame:
    """(cache key, embedding) of all chunks: those whose content the cache knows from there, the others embedded once."""
    key = F.concat_ws(":", F.lit(provider), F.lit(model), F.sha2("content", 256))
    keyed = chunks.select(key.alias("cache_key"), "content").dropDuplicates(["cache_key"])
    missing = embed(keyed.join(cache.select("cache_key"), "cache_key", "left_anti"))
    return cache.join(keyed.select("cache_key"), "cache_key", "left_semi").select("cache_key", "embedding").unionByName(missing.select("cache_key", "embedding"))


# --- fusion ---


def ranked(scores: DataFrame, by: str = "score", tie: str = "id") -> DataFrame:
    """Adds `rank`, from 0. Meant for lists that a top-k has cut: it sorts them in one place."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), tie)) - 1)


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: int = scoring.RRF_K) -> DataFrame:
    """(id, score): reciprocal rank fusion of (id, score) lists; weighted if weights are given."""
    terms = None
    for part, w in zip(lists, weights or [1.0] * len(lists)):
        one = ranked(part).select("id", scoring.rrf_term(F.col("rank"), w, k).alias("term"))
        terms = one if terms is None else terms.unionByName(one)
    return terms.groupBy("id").agg(F.sum("term").alias("score"))


def hybrid_search(sparse: DataFrame, dense: DataFrame, limit: int = 10, weights: tuple[float, float] = (0.4, 0.6), min_score: float = 0.0) -> DataFrame:
    """(id, score, sparse_score, dense_score): weighted fusion of two cut lists; a missing score counts as 0. With one list
    empty the other decides alone. min_score applies to the fused score over the greatest possible."""
    top = sum(weights) / (scoring.RRF_K + 1)
    fused = rrf([sparse, dense], list(weights))
    both = sparse.select("id", F.col("score").alias("sparse_score")).join(dense.select("id", F.col("score").alias("dense_score")), "id", "full_outer")
    rows = fused.join(both, "id").select("id", "score", F.coalesce("sparse_score", F.lit(0.0)).alias("sparse_score"), F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"))
    return rows.filter(F.col("score") / top >= min_score).orderBy(F.desc("score"), "id").limit(limit)


def kept_after(top: DataFrame, attributes: DataFrame, where: Column, limit: int) -> DataFrame:
    """The rows of a cut list (id, score) that hold a condition on their attributes (id, ...): the filter comes after the cut,
    and may leave fewer than `limit`."""
    return top.join(attributes, "id").filter(where).orderBy(F.desc("score"), "id").limit(limit)


def fetch_size(limit: int) -> int:
    """How many of each list a fused search of `limit` takes."""
    return min(3 * limit, 100)


# --- keyword scores ---


def _holding(names: Column, word: str) -> Column:
    return F.size(F.filter(names, lambda s: F.lower(s).contains(word)))


def keyword_score(query: str, content: Column, symbols: Column | None = None, exported: Column | None = None, tool: bool = False) -> Column:
    """Words in the content +1, in the first symbol +3, in any symbol +2 each; exported +0.5 (tool: first symbol +3, exported +1,
    short words count too)."""
    words = [w for w in query.lower().split() if tool or len(w) >= 2]
    low, score = F.lower(content), F.lit(0.0)
    for w in words:
        score = score + F.when(low.contains(w), 1).otherwise(0)
        if symbols is not None:
            first = F.lower(F.coalesce(F.try_element_at(symbols, F.lit(1)), F.lit("")))
            score = score + F.when(first.contains(w), 3).otherwise(0)
            if not tool:
                score = score + 2 * _holding(symbols, w)
    if exported is not None:
        score = score + F.when(exported, 1.0 if tool else 0.5).otherwise(0)
    return score
