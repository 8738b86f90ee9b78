"""Trees of thoughts. thoughts: id, session_id, branch, number, type, content, confidence, parent_id, revises, files (list)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import confidence_level
from .graph import khop

MAX_BRANCHES = 3
MOST_THOUGHTS, SURE, WEAK = 10, 0.7, 0.5


def with_parents(thoughts: DataFrame, branch_points: DataFrame | None = None) -> DataFrame:
    """Adds parent_id: the thought before it in its branch; for a branch's first, its branch point (session_id, branch, point)."""
    w = Window.partitionBy("session_id", "branch").orderBy("number")
    rows = thoughts.withColumn("before", F.lag("id").over(w))
    if branch_points is None:
        return rows.withColumnRenamed("before", "parent_id")
    return rows.join(branch_points, ["session_id", "branch"], "left").withColumn("parent_id", F.coalesce("before", "point")).drop("before", "point")


def next_number(thoughts: DataFrame) -> DataFrame:
    return thoughts.groupBy("session_id", "branch").agg((F.max("number") + 1).alias("next"))


def may_branch(thoughts: DataFrame, most: int = MAX_BRANCHES) -> DataFrame:
    """(session_id, may): whether another branch is allowed; main counts."""
    return thoughts.groupBy("session_id").agg((F.countDistinct("branch") < most).alias("may"))


def lineage(thoughts: DataFrame, thought: str) -> DataFrame:
    """(id, depth): the thought, its parent and so on to the root."""
    seed = thoughts.sparkSession.createDataFrame([(thought,)], "id string")
    return khop(thoughts.filter("parent_id is not null").select(F.col("id").alias("from"), F.col("parent_id").alias("to")), seed, None)


def descendants(thoughts: DataFrame, thought: str) -> DataFrame:
    seed = thoughts.sparkSession.createDataFrame([(thought,)], "id string")
    return khop(thoughts.filter("parent_id is not null").select(F.col("parent_id").alias("from"), F.col("id").alias("to")), seed, None).filter("depth > 0")


def tree_stats(thoughts: DataFrame) -> DataFrame:
    """(session_id, thoughts, revisions, branches, max_depth, by_type). Thoughts of a branch follow each other, so its depth is
    their number, and one more than its point's for each branch (parent_id of its first, if there is that column)."""
    kinds = thoughts.groupBy("session_id", "type").agg(F.count("*").alias("n")).groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    whole = thoughts.groupBy("session_id").agg(F.count("*").alias("thoughts"), F.count_if(F.col("revises").isNotNull()).alias("revisions"), F.countDistinct("branch").alias("branches"))
    place = F.row_number().over(Window.partitionBy("session_id", "branch").orderBy("number")) - 1
    rows = thoughts.withColumn("__at", place).select("session_id", "branch", "id", "__at", *([] if "parent_id" not in thoughts.columns else ["parent_id"]))
    if "parent_id" in thoughts.columns:  # branches start from main
        first = rows.filter((F.col("__at") == 0) & F.col("parent_id").isNotNull()).select("session_id", "branch", F.col("parent_id").alias("id"))
        base = first.join(rows.select("session_id", "id", F.col("__at").alias("__p")), ["session_id", "id"]).select("session_id", "branch", (F.col("__p") + 1).alias("__base"))
        rows = rows.join(base, ["session_id", "branch"], "left").withColumn("__at", F.col("__at") + F.coalesce("__base", F.lit(0)))
    return whole.join(rows.groupBy("session_id").agg(F.max("__at").alias("max_depth")), "session_id").join(kinds, "session_id")


def with_context(thoughts: DataFrame, retriever: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds `context`: what the host's retriever, a function of (id, content) rows to (id, context), finds for each thought."""
    return thoughts.join(retriever(thoughts.select("id", "content")), "id", "left")


def switched(thoughts: DataFrame, session: str, branch: str) -> DataFrame:
    """The thoughts of the branch that a session goes on in; ValueError if it has none of that name."""
    rows = thoughts.filter((F.col("session_id") == session) & (F.col("branch") == branch))
    if rows.isEmpty():
        raise ValueError(f"there is no branch {branch}")
    return rows


def find(thoughts: DataFrame, text: str = "", kind: str | None = None) -> DataFrame:
    """Thoughts that hold a text, of a type if given."""
    rows = thoughts.filter(F.lower("content").contains(text.lower()))
    return rows if kind is None else rows.filter(F.col("type") == kind)


def confidence(thoughts: DataFrame, by: list[str], order: list[str], value: str = "confidence") -> DataFrame:
    """(by, confidence, level): mean weighted by 1 + i / 2, i being the position from 0."""
    w = 1 + 0.5 * (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    rows = thoughts.withColumn("__w", w).groupBy(*by).agg(F.try_divide(F.sum(F.col("__w") * F.col(value)), F.sum("__w")).alias("confidence"))
    return rows.withColumn("level", confidence_level(F.col("confidence")))


def next_steps(thoughts: DataFrame, most: int = MOST_THOUGHTS, sure: float = SURE) -> DataFrame:
    """(session_id, go_on, revise, suggested) of each session.

    It goes on until it has `most` thoughts, or the last is a conclusion or a verification that is sure. revise is the number
    of the first weak thought that is neither a revision nor a conclusion, in a session of two thoughts or more.
    """
    weak = (F.col("confidence") < WEAK) & ~F.col("type").isin("revision", "conclusion")
    rows = thoughts.groupBy("session_id").agg(F.max_by(F.struct("type", "confidence"), "number").alias("last"), F.count("*").alias("n"), F.min(F.when(weak, F.col("number"))).alias("weak"))
    kind, is_sure = F.col("last.type"), F.col("last.confidence") >= sure
    stop = (F.col("n") >= most) | (kind == "conclusion") | ((kind == "verification") & is_sure)
    after = F.when(kind == "analysis", F.when(F.col("n") < 3, "analysis").otherwise("hypothesis")).when(kind == "hypothesis", "verification")
    after = after.when((kind == "verification") & is_sure, "conclusion").when(kind == "revision", "analysis").when(F.col("n") >= most - 1, "conclusion").otherwise("analysis")
    return rows.select("session_id", (~stop).alias("go_on"), F.when(F.col("n") >= 2, F.col("weak")).alias("revise"), after.alias("suggested"))


def finalize(thoughts: DataFrame) -> DataFrame:
    """(session_id, conclusion, confidence, level, thoughts, files): the last conclusion, or else the last thought."""
    last = F.coalesce(F.max_by(F.when(F.col("type") == "conclusion", F.col("content")), F.when(F.col("type") == "conclusion", F.col("number"))), F.max_by("content", "number"))
    rows = thoughts.groupBy("session_id").agg(last.alias("conclusion"), F.count("*").alias("thoughts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"))
    return rows.join(confidence(thoughts, ["session_id"], ["number"]), "session_id")


def to_mermaid(thoughts: DataFrame) -> DataFrame:
    node = F.format_string('  %s["%s: %s"]', "id", "type", F.regexp_replace(F.substring("content", 1, 40), '"', "'"))
    edge = F.when(F.col("parent_id").isNotNull(), F.format_string("  %s --> %s", "parent_id", "id"))
    return thoughts.agg(F.concat_ws("\n", F.lit("graph TD"), F.array_join(F.sort_array(F.collect_list(node)), "\n"), F.array_join(F.sort_array(F.collect_list(edge)), "\n")).alias("mermaid"))
