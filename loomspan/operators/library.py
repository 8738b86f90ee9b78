"""Documentation of libraries: a cache table, lookups, search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_DAYS, MOST_ENTRIES, MAIN_EXPORTS = 7, 500, 20
TOOLING = ("eslint", "prettier", "typescript", "vitest", "jest", "webpack", "vite", "rollup", "babel", "husky")


def search_api(entries: DataFrame, text: str, types: list[str] | None = None, most: int = 20) -> DataFrame:
    low = text.lower()
    hit = F.greatest(*[F.lower(F.coalesce(F.col(c), F.lit(""))).contains(low) for c in ("name", "description", "signature")])
    rows = entries.filter(hit)
    return (rows if types is None else rows.filter(F.col("type").isin(*types))).orderBy("library", "name").limit(most)


def fresh(cache: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """Rows of the cache that haven't expired: library, version, cached_at, ..."""
    return cache.filter(now - F.col("cached_at") <= F.expr(f"interval {days} days"))


def get_docs(cache: DataFrame, wanted: DataFrame, extract: Callable[[DataFrame], DataFrame], now: Column) -> DataFrame:
    """Entries of the wanted (library, version): from the cache if fresh, else extracted."""
    keys = ["library", "version"]
    held = fresh(cache, now).join(wanted, keys, "left_semi")
    missing = wanted.join(held.select(*keys).distinct(), keys, "left_anti")
    return held.unionByName(extract(missing).withColumn("cached_at", now), allowMissingColumns=True)


def cache_stats(cache: DataFrame, now: Column) -> DataFrame:
    return cache.agg(F.countDistinct("library", "version").alias("libraries"), F.count("*").alias("entries"), F.count_if(now - F.col("cached_at") > F.expr(f"interval {TTL_DAYS} days")).alias("expired"))


def extract_summary(entries: DataFrame) -> DataFrame:
    """(library, version, entries, functions, classes, interfaces, main_exports) over the first 500 entries of each."""
    w = Window.partitionBy("library", "version").orderBy("name", "type")
    rows = entries.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= MOST_ENTRIES)
    return rows.groupBy("library", "version").agg(
        F.count("*").alias("entries"), *[F.count_if(F.col("type") == k).alias(n) for k, n in (("function", "functions"), ("class", "classes"), ("interface", "interfaces"))],
        F.slice(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("n", "name"))), lambda x: x["name"])), 1, MAIN_EXPORTS).alias("main_exports"),
    )


def prewarm_list(packages: DataFrame, most: int = 50) -> DataFrame:
    """packages (text of a package.json) -> (library, version): dependencies but for types and tooling."""
    deps = packages.select(F.explode(F.from_json(F.get_json_object("content", "$.dependencies"), "map<string,string>")).alias("library", "version"))
    tooling = F.greatest(*[F.col("library").contains(t) for t in TOOLING])
    return deps.filter(~F.col("library").startswith("@types/") & ~tooling).orderBy("library").limit(most)


def installed(files: DataFrame) -> DataFrame:
    """(library, version): from paths and contents of node_modules/**/package.json, scoped ones too."""
    name = F.regexp_extract("path", "node_modules/((?:@[^/]+/)?[^/]+)/package\\.json$", 1)
    return files.select(name.alias("library"), F.get_json_object("content", "$.version").alias("version")).filter("library <> ''").distinct()


def declaration_paths(package: Column) -> Column:
    """Where a package.json may say its declarations are: types, typings, exports, then index.d.ts and dist."""
    named = F.array(F.get_json_object(package, "$.types"), F.get_json_object(package, "$.typings"), F.lit("index.d.ts"), F.lit("dist/index.d.ts"))
    nested = F.regexp_extract_all(F.coalesce(F.get_json_object(package, "$.exports"), F.lit("")), F.lit('"types"\\s*:\\s*"([^"]+)"'), F.lit(1))
    return F.array_distinct(F.transform(F.filter(F.concat(F.slice(named, 1, 2), nested, F.slice(named, 3, 2)), lambda x: x.isNotNull()), lambda x: F.regexp_replace(x, "^\\./", "")))
