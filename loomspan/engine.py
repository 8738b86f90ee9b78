"""The engine: one object that indexes a source and answers."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as conf
from .functions.text import estimate_tokens
from .operators import analytics, budget, extract, graph, incremental, retrieval
from .sources.stores import state, state_hashes

PROMPT = "Answer from the context only.\n\nContext:\n{context}\n\nQuestion: {question}\n"
UNSURE = ("not sure", "unclear", "cannot determine", "no information", "don't know")


class Engine:
    """Tables: files, symbols, imports, calls, chunks, edges (file dependencies), graph, inverted index, vectors. All lazy."""

    def __init__(self, spark: SparkSession, source, config: dict | None = None):
        self.spark, self.source, self.config = spark, source, conf.merge(conf.DEFAULTS, config or {})
        self.generation, self.ready = 0, False

    def index(self, progress: Callable[[str, int, int], None] = lambda stage, at, of: None) -> Engine:
        """Indexes the whole source; progress hears of each stage."""
        self.files = graph.cut(self.source.list())
        for at, (name, rows) in enumerate(_parsed(self.files).items()):
            progress(name, at, 6)
            setattr(self, name, graph.cut(rows))
        progress("search index", 4, 6)
        built = retrieval.InvertedIndex.build(self.chunks)
        self.inverted = retrieval.InvertedIndex(graph.cut(built.postings), graph.cut(built.lengths))
        progress("graph", 5, 6)
        self._link()
        self.embedder, self.vectors = None, None
        self.generation += 1
        self.ready = True
        progress("done", 6, 6)
        return self

    def _link(self) -> None:
        self.edges = graph.cut(incremental.dependency_edges(incremental.resolve_imports(self.imports, self.files)))
        g = graph.build(self.symbols, self.imports, self.calls, self.edges)
        self.graph = graph.Graph(graph.cut(g.nodes), graph.cut(g.edges))

    def refresh(self, paths: list[str] | None = None) -> DataFrame:
        """(path, status): what changed since the last index, in the files `paths` if given; what changed is indexed anew.

        Only files that were added or modified are parsed. Rows, chunks, postings and vectors of those that were modified
        or removed go; what depends on names across files (dependencies, graph) is linked again from the narrow tables.
        """
        now = self.source.list()
        diff = incremental.snapshot_diff(self.files.select("path", "hash"), now.select("path", "hash"))
        diff = graph.cut(diff if paths is None else diff.filter(F.col("path").isin(paths)))
        gone = diff.filter(F.col("status").isin("removed", "modified")).select("path")
        come = graph.cut(now.join(diff.filter(F.col("status").isin("added", "modified")).select("path"), "path", "left_semi"))
        if diff.filter("status <> 'cached'").isEmpty():
            return diff
        old = self.chunks.join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("id")
        kept = self.inverted.remove(old)
        parsed = {name: graph.cut(rows) for name, rows in _parsed(come).items()}
        new = retrieval.InvertedIndex.build(parsed["chunks"])
        self.inverted = retrieval.InvertedIndex(graph.cut(kept.postings.unionByName(new.postings)), graph.cut(kept.lengths.unionByName(new.lengths)))
        if self.vectors is not None:
            self.vectors = retrieval.VectorStore(graph.cut(self.vectors.rows.join(old, "id", "left_anti").unionByName(self._vectors(parsed["chunks"]))))
        for name, rows in parsed.items():
            setattr(self, name, graph.cut(getattr(self, name).join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_anti").unionByName(rows)))
        self.files = graph.cut(self.files.join(gone, "path", "left_anti").unionByName(come))
        self._link()
        self.generation += 1
        return diff

    def embed(self, provider: retrieval.EmbeddingProvider | None = None, cache: DataFrame | None = None) -> Engine:
        """Vectors of all chunks, by the local TF-IDF embedder or a given provider; contents that the cache (cache_key, embedding) knows aren't embedded."""
        self.embedder = provider or retrieval.TfIdfEmbedder.fit(self.chunks, dimensions=self.config["embeddings"]["dimensions"])
        self.vectors = retrieval.VectorStore(graph.cut(self._vectors(self.chunks, cache)))
        return self

    def _vectors(self, chunks: DataFrame, cache: DataFrame | None = None) -> DataFrame:
        if cache is None:
            return chunks.select("id", "file_path", "language", self.embedder.embed(F.col("content")).alias("embedding"))
        key = retrieval.cache_key(F.col("content"), self.embedder)
        known = retrieval.embed_missing(chunks, cache, lambda rows: rows.withColumn("embedding", self.embedder.embed(F.col("content"))), self.embedder.name, self.embedder.model)
        return chunks.select("id", "file_path", "language", key.alias("cache_key")).join(known, "cache_key").drop("cache_key")

    # --- retrieval ---

    def retrieve(self, question: str, max_tokens: int | None = None, min_score: float | None = None, files: list[str] | None = None, language: str | None = None, mode: str | None = None, priority: list[str] | None = None) -> DataFrame:
        """The chosen chunks. hybrid needs vectors (embed), bm25 an index; without, the next simpler mode answers."""
        r = self.config["retrieval"]
        mode, tokens = mode or r["mode"], max_tokens or r["max_tokens"]
        low = r["min_score"] if min_score is None else min_score
        where = F.lit(True)
        if files:
            where = where & F.greatest(*[F.col("file_path").contains(f) for f in files], F.lit(False))
        if language:
            where = where & (F.col("language") == language)
        if mode == "keyword":
            return self._keyword(question, tokens, where)
        # Filters come before the lists are cut: a match isn't lost to better ones that don't count.
        within = self.chunks.filter(where).select("id") if files or language else None
        if mode == "hybrid" and self.vectors is not None:
            sparse = self.inverted.search(question, r["sparse_limit"], within)
            q = self.spark.range(1).select(self.embedder.embed(F.lit(question)).alias("q"))
            dense = retrieval.vector_search(self.vectors.rows if within is None else self.vectors.rows.filter(where), q, r["dense_limit"])
            ranked = retrieval.rrf([sparse, dense], k=r["rrf_k"]).withColumn("score", F.col("score") / (2 / (r["rrf_k"] + 1)))
        else:  # BM25 scores have no greatest value that the configured share would be of
            low = min_score or 0.0
            ranked = self.inverted.search(question, 2 * r["sparse_limit"], within)
        rows = ranked.join(self.chunks, "id").filter(F.col("score") >= low).withColumn("ord", F.col("id"))
        return budget.greedy_budget(rows, tokens, min_score=low, priority=priority)

    def _keyword(self, question: str, tokens: int, where: Column) -> DataFrame:
        score = retrieval.keyword_score(question, F.col("content"), F.col("symbols"))
        rows = self.chunks.filter(where).withColumn("score", score).filter("score > 0").filter("token_count > 0").orderBy(F.desc("score"), "id").limit(max(tokens, 0))  # each costs one token at least: no more fit
        return budget.prefix_budget(rows, tokens, [F.desc("score"), "id"])

    def context(self, question: str, **how) -> str:
        row = budget.format_context(self.retrieve(question, **how)).head()
        return row.context if row else ""

    def ask(self, question: str, llm: Callable[[str], str]) -> dict:
        """The answer of a given language model over what retrieve finds; sources are the rows that were shown."""
        shown = self.retrieve(question, max_tokens=self.config["qa"]["max_tokens"])
        rows = shown.select("file_path", "start_line", "end_line").collect()
        row = budget.format_context(shown).head()
        answer = llm(PROMPT.format(context=row.context if row else "", question=question))
        unsure = any(u in answer.lower() for u in UNSURE)
        level = "low" if unsure or not rows else "high" if len(rows) >= 3 else "medium"
        return {"answer": answer, "sources": [r.asDict() for r in rows], "confidence": level}

    # --- lookups ---

    def search_symbols(self, text: str, kinds: list[str] | None = None, limit: int = 20) -> DataFrame:
        rows = self.symbols.filter(F.lower("name").contains(text.lower()))
        return (rows if kinds is None else rows.filter(F.col("kind").isin(kinds))).orderBy("file_path", "line", "name").limit(limit)

    def search_all(self, text: str) -> DataFrame:
        """(what, name, file_path): files and symbols whose name holds the text."""
        f = self.files.filter(F.lower("path").contains(text.lower())).select(F.lit("file").alias("what"), F.col("path").alias("name"), F.col("path").alias("file_path"))
        return f.unionByName(self.symbols.filter(F.lower("name").contains(text.lower())).select(F.col("kind").alias("what"), "name", "file_path"))

    def usages(self, symbol: str, file: str | None = None, limit: int = 20) -> DataFrame:
        rows = self.calls.filter((F.col("callee") == symbol) | F.col("callee").endswith(f".{symbol}"))
        return (rows if file is None else rows.filter(F.col("file_path").contains(file))).orderBy("file_path", "line").limit(limit)

    def _seed(self, name: str) -> str | None:
        row = self.graph.find(name=name).orderBy("id").head()
        return row.id if row else None

    def related(self, name: str, depth: int = 2, direction: str = "both", edge_types: list[str] | None = None) -> DataFrame:
        seed = self._seed(name)
        return self.graph.related(seed or "", depth, direction, edge_types).join(self.graph.nodes, "id")

    def callers(self, name: str) -> DataFrame:
        return self.graph.callers(self._seed(name) or "")

    def callees(self, name: str) -> DataFrame:
        return self.graph.callees(self._seed(name) or "")

    def inheritance(self, name: str, direction: str = "up") -> DataFrame:
        return self.graph.inheritance(self._seed(name) or "", direction).join(self.graph.nodes, "id")

    def dependencies(self, path: str, direction: str = "both") -> DataFrame:
        return incremental.dependencies(self.edges, path, direction)

    def stats(self) -> DataFrame:
        return incremental.language_stats(self.files, self.symbols)

    def structure(self) -> dict:
        entry = self.files.filter(F.col("path").rlike("(?:index|main|app)\\.")).orderBy("path").limit(10)
        return {"entry_points": [r.path for r in entry.select("path").collect()], "important": [r.asDict() for r in incremental.file_importance(self.edges, self.symbols).collect()], "languages": [r.asDict() for r in self.stats().collect()]}

    # --- analytics, state ---

    def functions(self) -> DataFrame:
        return extract.function_rows(self.symbols, self.files)

    def complexity(self) -> DataFrame:
        return analytics.function_complexity(self.functions())

    def smells(self) -> DataFrame:
        return analytics.smells(self.functions(), extract.class_rows(self.symbols), self.files)

    def patterns(self, categories: list[str] | None = None) -> DataFrame:
        return analytics.patterns(self.files, self.symbols, categories)

    def state(self, root: str = ".") -> DataFrame:
        return state(self.files, root, self.generation)

    def restore(self, state_: DataFrame) -> DataFrame:
        """Takes over an exported state (state): its generation, and (path, status) of the source since then."""
        self.generation = state_.head().generation
        return incremental.snapshot_diff(state_hashes(state_), self.source.list().select("path", "hash"))

    def health(self) -> str:
        row = self.files.agg(F.count("*").alias("n"), F.max("last_modified").alias("t")).select(incremental.health(F.col("n"), F.col("t"), F.current_timestamp()).alias("h")).head()
        return row.h if self.ready else "unhealthy"

    def save(self, path: str) -> None:
        for name in ("files", "symbols", "imports", "calls", "chunks", "edges"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        self.graph.save(f"{path}/graph")
        self.inverted.save(f"{path}/inverted")
        if self.vectors is not None and isinstance(self.embedder, retrieval.TfIdfEmbedder):
            self.vectors.save(f"{path}/vectors")
            self.spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(self.embedder.vocabulary)], "place int, term string, idf double").withColumn("dimensions", F.lit(self.embedder.dimensions)).write.mode("overwrite").parquet(f"{path}/vocabulary")

    def load(self, path: str) -> Engine:
        for name in ("files", "symbols", "imports", "calls", "chunks", "edges"):
            setattr(self, name, self.spark.read.parquet(f"{path}/{name}"))
        self.graph, self.inverted = graph.Graph.load(self.spark, f"{path}/graph"), retrieval.InvertedIndex.load(self.spark, f"{path}/inverted")
        self.embedder, self.vectors, self.ready = None, None, True
        try:
            rows = self.spark.read.parquet(f"{path}/vocabulary").orderBy("place").collect()
        except AnalysisException:  # it was saved without vectors
            return self
        self.embedder = retrieval.TfIdfEmbedder([(r.term, r.idf) for r in rows], rows[0].dimensions if rows else 512)
        self.vectors = retrieval.VectorStore.load(self.spark, f"{path}/vectors")
        return self

    @staticmethod
    def clear(spark: SparkSession, path: str) -> bool:
        """Deletes what save wrote."""
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def size(self) -> dict:
        return {"tokens": self.chunks.agg(F.sum(estimate_tokens("content")).alias("t")).head().t or 0, "files": self.files.count()}

    def as_json(self, df: DataFrame, most: int = 1000) -> list[dict]:
        """Rows for a tool's answer, which is bounded."""
        return [json.loads(r.j) for r in df.limit(most).select(F.to_json(F.struct(*df.columns)).alias("j")).collect()]


def _parsed(files: DataFrame) -> dict[str, DataFrame]:
    """The tables that are made of each file alone."""
    chunks = extract.line_chunks(files).join(files.select(F.col("path").alias("file_path"), "language"), "file_path")
    return {"symbols": extract.symbols(files), "imports": extract.imports(files), "calls": extract.calls(files), "chunks": chunks}
