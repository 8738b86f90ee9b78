"""Change streams: watching, debouncing, windows, cascades and stateful summaries, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import apply_changes, invalidated, snapshot_diff


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def event_time(df: DataFrame, column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Event time with a watermark; timestamps without zone are read as UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def watched(changes: DataFrame, extensions: list[str], ignore: str | None = None) -> DataFrame:
    """Changes (path, type, ts) of files that count."""
    kept = changes.filter(F.lower("path").rlike(f"({'|'.join(e.replace('.', chr(92) + '.') for e in extensions)})$"))
    return kept if ignore is None else kept.filter(~F.col("path").rlike(ignore))


def debounced(changes: DataFrame, key: str = "path", column: str = "ts", gap: str = "300 milliseconds") -> DataFrame:
    """(key, start, end, events, last): bursts of changes with less than `gap` between them, and the last change of each; batch or stream."""
    w = F.session_window(column, gap)
    got = changes.groupBy(F.col(key), w.alias("w")).agg(F.count("*").alias("events"), F.max_by("type", F.struct(column, "type")).alias("last"))
    return got.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "last")


def tumbling(events: DataFrame, by: list[str], value: str, column: str = "ts", width: str = "1 hour") -> DataFrame:
    return _windowed(events, F.window(column, width), by, value)


def sliding(events: DataFrame, by: list[str], value: str, column: str = "ts", width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    return _windowed(events, F.window(column, width, step), by, value)


def _windowed(events: DataFrame, window, by: list[str], value: str) -> DataFrame:
    got = events.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def latest_per_key(batch: DataFrame, key: str = "path", column: str = "ts") -> DataFrame:
    """The last row of each key; of several at one time the greatest by all other columns."""
    w = Window.partitionBy(key).orderBy(F.desc(column), *[F.desc(c) for c in batch.columns if c not in (key, column)])
    return batch.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def cascade(stream: DataFrame, edges: Callable[[], DataFrame], reindex: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch's latest changes, and all that depends on them, go to `reindex`; batches run one after another."""

    def step(batch: DataFrame, epoch: int) -> None:
        changed = latest_per_key(batch).select(F.col("path").alias("id"))
        reindex(invalidated(edges(), changed), epoch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def incremental_index(index: DataFrame, files: DataFrame, parse: Callable[[DataFrame], DataFrame], generation: int, edges: DataFrame | None = None) -> DataFrame:
    """One pass of the incremental indexer: diff by hash, what depends on modified files, parse those, apply."""
    diff = snapshot_diff(index, files)
    todo = diff.filter(F.col("status").isin("added", "modified")).select("path")
    if edges is not None:
        seeds = diff.filter(F.col("status") == "modified").select(F.col("path").alias("id"))
        todo = todo.unionByName(invalidated(edges, seeds).select(F.col("id").alias("path"))).distinct()
    return apply_changes(index, diff, parse(files.join(todo, "path", "left_semi")), generation)


def summaries_every(stream: DataFrame, every: int = 10, key: str = "session_id") -> DataFrame:
    """(session_id, n): a row whenever a session has had another `every` queries; the count is the state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = dict(stream.dtypes)[key]

    def count(keys, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        now = before + sum(len(f) for f in frames)
        state.update((now,))
        due = [n for n in range(before // every * every + every, now + 1, every)]
        yield pd.DataFrame({key: [keys[0]] * len(due), "n": due})

    return stream.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, n long", "n long", "append", GroupStateTimeout.NoTimeout)


def status(query: StreamingQuery) -> dict:
    last = query.lastProgress
    return {"id": str(query.id), "active": query.isActive, "status": query.status["message"], "batches": last["batchId"] + 1 if last else 0, "rows": last["numInputRows"] if last else 0}
