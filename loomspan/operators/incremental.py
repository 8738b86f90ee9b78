"""Files, snapshots, dependencies and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, dirname, extname, normalize_path
from .graph import khop

SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.js", "/__init__.py")


def content_hash(c: Column | str) -> Column:
    return F.sha2(c if isinstance(c, Column) else F.col(c), 256)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", hash_: str = "hash") -> DataFrame:
    """(path, status): added, modified, removed or cached, by one full outer join on the key."""
    o = old.select(F.col(key).alias("path"), F.col(hash_).alias("was"), F.lit(True).alias("in_old"))
    n = new.select(F.col(key).alias("path"), F.col(hash_).alias("now"), F.lit(True).alias("in_new"))
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "cached").otherwise("modified")
    return o.join(n, "path", "full_outer").select("path", status.alias("status"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(from, specifier, to): relative specifiers against the file's folder, with suffixes tried in order; others have no row."""
    relative = imports.filter(F.col("source").startswith(".")).select("file_path", "source")
    base = normalize_path(F.concat_ws("/", F.nullif(dirname("file_path"), F.lit("")), "source"))
    tried = relative.select("file_path", "source", F.posexplode(F.array(*[F.concat(base, F.lit(s)) for s in SUFFIXES[1:]], base)).alias("ord", "to"))
    hits = tried.join(files.select(F.col("path").alias("to")), "to")
    first = Window.partitionBy("file_path", "source").orderBy("ord")
    return hits.withColumn("r", F.row_number().over(first)).filter("r = 1").select(F.col("file_path").alias("from"), F.col("source").alias("specifier"), "to")


def dependency_edges(resolved: DataFrame) -> DataFrame:
    return resolved.select("from", "to").filter(F.col("from") != F.col("to")).distinct()


def imported_by(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("to").alias("path")).agg(F.sort_array(F.collect_set("from")).alias("imported_by"))


def dependencies(edges: DataFrame, path: str, direction: str = "both") -> DataFrame:
    """(path, direction): direct imports of a file, direct importers, or both."""
    parts = {"imports": edges.filter(F.col("from") == path).select(F.col("to").alias("path"), F.lit("imports").alias("direction")), "imported_by": edges.filter(F.col("to") == path).select(F.col("from").alias("path"), F.lit("imported_by").alias("direction"))}
    return parts["imports"].unionByName(parts["imported_by"]) if direction == "both" else parts[direction]


def invalidated(edges: DataFrame, changed: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, depth): all that depends on the changed files (id), itself at depth 0; cycles are no trouble."""
    return khop(edges.select(F.col("to").alias("from"), F.col("from").alias("to")), changed, depth)


def dependency_chain(edges: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    return khop(edges.select("from", "to"), start, depth)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of the same keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def apply_changes(index: DataFrame, diff: DataFrame, parsed: DataFrame, generation: int) -> DataFrame:
    """The file index after a diff: removed and modified rows go, parsed rows come with the new generation."""
    gone = diff.filter(F.col("status").isin("removed", "modified")).select("path")
    return upsert(index.join(gone, "path", "left_anti"), parsed.withColumn("generation", F.lit(generation)), ["path"])


def keep_branch(index: DataFrame, user: str, branch: str) -> DataFrame:
    """The partition of one user and branch: another branch never sees it."""
    return index.filter((F.col("user_id") == user) & (F.col("branch") == branch))


def language_stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(language, files, symbols)"""
    n = symbols.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n"))
    return files.join(n, "path", "left").groupBy("language").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"))


def kind_counts(symbols: DataFrame) -> DataFrame:
    """(kind, n), the commonest first."""
    return symbols.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def folders(files: DataFrame) -> DataFrame:
    """(folder, files, first, extension): files by folder, with the first name and the last extension."""
    return files.groupBy(dirname("path").alias("folder")).agg(F.count("*").alias("files"), F.min(basename("path")).alias("first"), F.max(extname("path")).alias("extension"))


def by_source(edges: DataFrame) -> DataFrame:
    """(path, imports): what each file imports."""
    return edges.groupBy(F.col("from").alias("path")).agg(F.sort_array(F.collect_set("to")).alias("imports"))


def file_importance(edges: DataFrame, symbols: DataFrame, k: int = 20) -> DataFrame:
    """(path, score): twice the importers plus exported symbols; the k greatest."""
    importers = edges.groupBy(F.col("to").alias("path")).agg((2 * F.count("*")).alias("s"))
    exported = symbols.filter("exported").groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("s"))
    return importers.unionByName(exported).groupBy("path").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "path").limit(k)


def health(total: Column, updated: Column, now: Column) -> Column:
    """unhealthy without files, degraded if the index is older than an hour, else healthy."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, "unhealthy").when(now - updated > F.expr("interval 1 hour"), "degraded").otherwise("healthy")
