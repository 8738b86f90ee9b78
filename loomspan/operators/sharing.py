"""Bundles: export with privacy, preview, import, diff. A bundle is a folder of Parquet tables and a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import matches_any_glob, short_sha

COMPONENTS = ("files", "nodes", "edges", "queries")
VERSION = "1.0.0"
KEYS = {"files": ["path"], "nodes": ["id"], "edges": ["source", "target", "type"], "queries": ["id"]}


def components(include: list[str] | None = None, exclude: list[str] | None = None, private: bool = False) -> list[str]:
    """Included but not excluded; a private bundle has no queries."""
    chosen = [c for c in (include or COMPONENTS) if c not in (exclude or [])]
    return [c for c in chosen if not (private and c == "queries")]


def anonymize(c: Column | str, length: int = 12) -> Column:
    return short_sha(c if isinstance(c, Column) else F.col(c), length)


def prepared(tables: dict[str, DataFrame], chosen: list[str], exclude_globs: list[str] | None = None, exclude_files: list[str] | None = None, anonymous: bool = False) -> dict[str, DataFrame]:
    """The tables as they are exported: files that globs or names exclude are gone, and with them their nodes and the edges at those."""
    out = {c: tables[c] for c in chosen if c in tables}
    hidden = lambda p: matches_any_glob(p, exclude_globs or []) | F.col(p).isin(exclude_files or [])
    if "files" in out:
        out["files"] = out["files"].filter(~hidden("path"))
    if "nodes" in out:
        out["nodes"] = out["nodes"].filter(F.col("file_path").isNull() | ~hidden("file_path"))
        if "edges" in out:
            ids = out["nodes"].select("id")
            out["edges"] = out["edges"].join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    if anonymous:
        for name, column in (("files", "path"), ("nodes", "file_path")):
            if name in out:
                out[name] = out[name].withColumn(column, anonymize(column))
    return out


def info(tables: dict[str, DataFrame]) -> DataFrame:
    """(component, rows)"""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("component"), "rows") for n, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export(spark: SparkSession, path: str, tables: dict[str, DataFrame], name: str = "bundle") -> DataFrame:
    for n, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{n}")
    manifest = info(tables).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("component", "rows")))).alias("counts")).select(F.lit(name).alias("name"), F.lit(VERSION).alias("version"), F.current_timestamp().alias("created"), "counts")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    version = spark.read.json(f"{path}/manifest").head()["version"]
    if int(version.split(".")[0]) > 1:
        raise ValueError(f"bundle version {version} is not supported")
    found = spark.read.json(f"{path}/manifest").select("counts.*").columns
    return {c: spark.read.parquet(f"{path}/{c}") for c in found}


def merge(mine: DataFrame, theirs: DataFrame, keys: list[str], keep_mine: bool = False) -> DataFrame:
    """The union by key; the bundle wins, or mine with keep_mine."""
    first, second = (mine, theirs) if keep_mine else (theirs, mine)
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def conflicts(mine: DataFrame, theirs: DataFrame, keys: list[str], merge_: bool = False, overwrite: bool = False) -> DataFrame:
    """(keys, resolution) of keys on both sides: overwritten, merged or skipped."""
    resolution = "overwritten" if overwrite else "merged" if merge_ else "skipped"
    return mine.select(*keys).join(theirs.select(*keys), keys).distinct().withColumn("resolution", F.lit(resolution))


def import_bundle(mine: dict[str, DataFrame], theirs: dict[str, DataFrame], merge_: bool = False, overwrite: bool = False) -> dict[str, DataFrame]:
    """What is new comes in; rows that conflict are skipped unless merging or overwriting; overwriting replaces whole tables."""
    out = dict(mine)
    for n, df in theirs.items():
        out[n] = df if n not in mine or (overwrite and not merge_) else merge(mine[n], df, KEYS[n], keep_mine=not (merge_ or overwrite))
    return out


def diff(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """(component, rows_a, rows_b, difference)"""
    x, y = info(a).withColumnRenamed("rows", "rows_a"), info(b).withColumnRenamed("rows", "rows_b")
    return x.join(y, "component", "full_outer").fillna(0).withColumn("difference", F.col("rows_b") - F.col("rows_a"))
