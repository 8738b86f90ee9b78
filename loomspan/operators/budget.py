"""Choosing chunks under a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYSTEM_RESERVE, RESPONSE_RESERVE = 500, 2000


def prefix_budget(chunks: DataFrame, budget: int, order: list, tokens: str = "token_count", partition: list[str] | None = None) -> DataFrame:
    """Rows in order until the first that would overflow; adds `used`. For the whole table, cut it to a top-k first."""
    w = (Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(1))).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("used", F.sum(tokens).over(w)).filter(F.col("used") <= budget)


def greedy_budget(
    chunks: DataFrame, max_tokens: int = 8000, system: int = SYSTEM_RESERVE, response: int = RESPONSE_RESERVE, min_score: float = 0.1,
    diversity: float = 0.3, priority: list[str] | None = None, candidates: int = 100,
) -> DataFrame:
    """The chunks that a greedy choice takes; adds `pick` (order of choice).

    Available are max_tokens - system - response. Again and again the chunk is taken that fits and has the greatest
    score + (diversity if its file has none yet) + 0.1 * score / tokens; ties go to the lower ord. With priority files,
    their chunks by score come first, up to 60 % of what is available. The choice depends on what was chosen, so it runs
    in one task over the best `candidates` of the list, which retrieval has cut anyway, and of the priority files over as
    many more as could fit.
    """
    available = max_tokens - system - response
    wanted = set(priority or [])
    names = chunks.columns
    if "ord" not in names:
        raise ValueError("chunks need a column ord: the order of ties")

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        rows = rows.sort_values("ord", kind="stable").reset_index(drop=True)
        chosen, files, left = [], set(), available
        if wanted:
            cap = int(available * 0.6)
            first = rows[rows["file_path"].isin(wanted)].sort_values("score", ascending=False, kind="stable")
            used = 0
            for i, r in first.iterrows():
                if used + r["token_count"] <= cap:
                    chosen.append(i)
                    files.add(r["file_path"])
                    used += r["token_count"]
            left -= used
        free = [i for i in rows.index if i not in set(chosen) and rows.at[i, "score"] >= min_score]
        while True:
            best, gain = None, None
            for i in free:
                n, s = rows.at[i, "token_count"], rows.at[i, "score"]
                if n > left:
                    continue
                g = s + (diversity if rows.at[i, "file_path"] not in files else 0.0) + 0.1 * s / max(n, 1)
                if gain is None or g > gain:
                    best, gain = i, g
            if best is None:
                break
            free.remove(best)
            chosen.append(best)
            files.add(rows.at[best, "file_path"])
            left -= rows.at[best, "token_count"]
        out = rows.loc[chosen, names].copy()
        out["pick"] = range(1, len(chosen) + 1)
        yield out

    cut = chunks.orderBy(F.desc("score"), "ord").limit(candidates)
    if wanted:  # each chunk costs a token at least: no more of them fit
        first = chunks.filter(F.col("file_path").isin(sorted(wanted)) & (F.col("token_count") > 0)).orderBy(F.desc("score"), "ord").limit(max(available, 0))
        cut = chunks.filter(~F.col("file_path").isin(sorted(wanted)) | F.col("file_path").isNull()).orderBy(F.desc("score"), "ord").limit(candidates).unionByName(first)
    return cut.coalesce(1).mapInPandas(choose, T.StructType([*chunks.schema.fields, T.StructField("pick", T.IntegerType())]))


def budget_summary(selected: DataFrame, max_tokens: int = 8000, system: int = SYSTEM_RESERVE, response: int = RESPONSE_RESERVE) -> DataFrame:
    return selected.agg(
        F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"),
        (F.lit(max_tokens - system - response) - F.coalesce(F.sum("token_count"), F.lit(0))).alias("remaining"),
        F.count("*").alias("selected"), F.countDistinct("file_path").alias("files"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"),
    )


def format_context(selected: DataFrame) -> DataFrame:
    """One row: the chunks by file (in language order) and line, each under a head that names file, lines and symbols."""
    head = F.concat(F.lit("// File: "), F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    parts = F.sort_array(F.collect_list(F.struct(F.collate("file_path", "UNICODE").alias("f"), "start_line", F.concat(head, F.lit("\n"), F.col("content")).alias("text"))))
    return selected.agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("context"))


def context_sources(contexts: DataFrame, column: str = "context") -> DataFrame:
    """(file_path, start_line, end_line) of every head that format_context has written."""
    heads = F.explode(F.regexp_extract_all(column, F.lit("(?m)^// File: (.+:\\d+-\\d+)$"), F.lit(1))).alias("h")
    at = lambda g: F.regexp_extract("h", "^(.+):(\\d+)-(\\d+)$", g)
    return contexts.select(heads).select(at(1).alias("file_path"), at(2).cast("int").alias("start_line"), at(3).cast("int").alias("end_line")).distinct()
