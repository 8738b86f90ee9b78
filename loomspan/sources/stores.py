"""Tables that outlive a session: index, state, sessions, caches."""

from __future__ import annotations

import json
import re
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = "2.0.0"


def same_major(version: str | None, expected: str = SCHEMA_VERSION) -> bool:
    return bool(version) and version.split(".")[0] == expected.split(".")[0]


class IndexStore:
    """One table for all users and branches, partitioned by both: a branch is read by pruning, and writing it replaces it alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, index: DataFrame, user: str, branch: str) -> None:
        rows = index.drop("user_id", "branch", "schema_version").withColumns({"user_id": F.lit(user), "branch": F.lit(branch), "schema_version": F.lit(SCHEMA_VERSION)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user_id", "branch").parquet(self.path)

    def load(self, user: str, branch: str) -> DataFrame | None:
        rows = self.spark.read.parquet(self.path).filter((F.col("user_id") == user) & (F.col("branch") == branch))
        version = rows.select("schema_version").head()
        return rows if version and same_major(version[0]) else None

    def meta(self) -> DataFrame:
        return self.spark.read.parquet(self.path).groupBy("user_id", "branch").agg(F.count("*").alias("files"), F.max("schema_version").alias("schema_version"))


def save_json(df: DataFrame, path: str) -> None:
    df.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").option("compression", "gzip").json(path)


def load_json(spark: SparkSession, path: str, schema) -> DataFrame:
    rows = spark.read.schema(f"{schema}, schema_version string").json(path)
    version = rows.select("schema_version").head()
    if version and not same_major(version[0]):
        raise ValueError(f"version {version[0]} can't be read")
    return rows.drop("schema_version")


def state(files: DataFrame, root: str, generation: int) -> DataFrame:
    """The engine's state as one row: hashes by path."""
    return files.agg(F.map_from_entries(F.collect_list(F.struct("path", "hash"))).alias("file_hashes"), F.count("*").alias("files")).select(F.lit(root).alias("root"), F.lit(SCHEMA_VERSION).alias("version"), F.lit(generation).alias("generation"), "files", "file_hashes")


def state_hashes(state_: DataFrame) -> DataFrame:
    return state_.select(F.explode("file_hashes").alias("path", "hash"))


class CacheTable:
    """Rows by key with cached_at: fresh ones are found, old ones and the oldest beyond a size are cleaned up."""

    def __init__(self, rows: DataFrame, keys: list[str]):
        self.rows, self.keys = rows, keys

    def get(self, wanted: DataFrame, now: Column, days: int) -> DataFrame:
        return self.rows.filter(now - F.col("cached_at") <= F.expr(f"interval {days} days")).join(wanted, self.keys, "left_semi")

    def put(self, more: DataFrame) -> CacheTable:
        return CacheTable(self.rows.join(more.select(*self.keys), self.keys, "left_anti").unionByName(more), self.keys)

    def delete(self, gone: DataFrame) -> CacheTable:
        return CacheTable(self.rows.join(gone, self.keys, "left_anti"), self.keys)

    def evict(self, now: Column, days: int = 30, most_bytes: int = 100_000_000, size: Column | None = None) -> CacheTable:
        """Drops what is too old, then the oldest until the newest fit; sizes are added up newest first within days, so no one task sorts the cache."""
        young = self.rows.filter(now - F.col("cached_at") <= F.expr(f"interval {days} days")).withColumn("__size", F.lit(1) if size is None else size).withColumn("__day", F.to_date("cached_at"))
        by_day = young.groupBy("__day").agg(F.sum("__size").alias("__n"))
        newer = by_day.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # a row for each day
        inside = Window.partitionBy("__day").orderBy(F.desc("cached_at"), *self.keys).rowsBetween(Window.unboundedPreceding, 0)
        kept = young.join(newer, "__day").withColumn("__total", F.col("__before") + F.sum("__size").over(inside)).filter(F.col("__total") <= most_bytes)
        return CacheTable(kept.drop("__size", "__day", "__before", "__total"), self.keys)

    def stats(self, now: Column, days: int) -> DataFrame:
        return self.rows.agg(F.count("*").alias("entries"), F.count_if(now - F.col("cached_at") > F.expr(f"interval {days} days")).alias("expired"))


class QueryCache:
    """Results by name on the driver: plans, or small values. Entries age, the least used go beyond a capacity, and names that a
    pattern matches, or all, can be dropped. now: a clock in seconds."""

    def __init__(self, capacity: int = 1000, ttl: float = 300.0, now: Callable[[], float] = time.monotonic):
        self.capacity, self.ttl, self.now = capacity, ttl, now
        self.entries: OrderedDict[str, tuple[float, object]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, name: str):
        held = self.entries.get(name)
        if held is None or self.now() - held[0] > self.ttl:
            self.entries.pop(name, None)
            self.misses += 1
            return None
        self.entries.move_to_end(name)
        self.hits += 1
        return held[1]

    def put(self, name: str, value) -> None:
        self.entries[name] = self.now(), value
        self.entries.move_to_end(name)
        while len(self.entries) > self.capacity:
            self.entries.popitem(last=False)

    def get_or_compute(self, name: str, compute: Callable[[], object]):
        value = self.get(name)
        if value is None:
            value = compute()
            self.put(name, value)
        return value

    def invalidate(self, pattern: str | None = None) -> int:
        """How many entries go: those whose name the regular expression finds something in, or all."""
        gone = [n for n in self.entries if pattern is None or re.search(pattern, n)]
        for n in gone:
            del self.entries[n]
        return len(gone)

    def invalidate_node(self, node: str) -> int:
        return self.invalidate(rf"(^|[:|,]){re.escape(node)}($|[:|,])")

    def prune(self) -> int:
        old = [n for n, (t, _) in self.entries.items() if self.now() - t > self.ttl]
        for n in old:
            del self.entries[n]
        return len(old)

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"size": len(self.entries), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}


def hit_rate(hits: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(hits, total), F.lit(0.0))


def save_manifest(path: str, meta: dict) -> None:
    with open(path, "w") as f:
        json.dump(meta | {"schema_version": SCHEMA_VERSION}, f)
