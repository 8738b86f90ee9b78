"""Packing documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKENIZER_DIR, chunks, encoder, small_batches, text_bytes, written


class CapacityTree:
    """A segment tree over remaining capacities 0..window: for each capacity, the runs of open windows that have it."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.open = np.zeros(2 * self.size, bool)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _set(self, capacity: int, value: bool) -> None:
        at = capacity + self.size
        self.open[at] = value
        while at > 1:
            at >>= 1
            value = bool(self.open[2 * at] or self.open[2 * at + 1])
            if self.open[at] == value:
                return
            self.open[at] = value

    def add(self, capacity: int, first: int, count: int) -> None:
        if count:
            self.runs[capacity].append((first, count))
            self._set(capacity, True)

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """Up to `most` windows, of the run opened last, out of those with this capacity."""
        first, count = self.runs[capacity].pop()
        if count > most:
            self.runs[capacity].append((first + most, count - most))
        if not self.runs[capacity]:
            self._set(capacity, False)
        return first, min(count, most)

    def tightest(self, need: int) -> int:
        """The least capacity >= need that an open window has, or -1."""
        at = need + self.size
        if self.open[at]:
            return need
        while at > 1:  # up until a right sibling holds something, then down its left side
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(counts: dict[int, int], window: int) -> tuple[np.ndarray, int]:
    """Places counts[length] pieces of each length; returns segments and the number of windows.

    A segment (length, first, pieces, window0, per, offset) says: pieces first, first + 1, ... of that length go into
    windows window0, window0 + 1, ..., `per` in each, end to end from `offset`. This is best-fit decreasing exactly: after
    a piece goes into the tightest open window with remaining capacity R, that window, with R - length, is the tightest
    for the next piece if it still has room; so each window of the run with capacity R takes R div length pieces in turn.
    Pieces of one length are interchangeable, which lets whole runs move at once: the work follows the number of
    distinct lengths, not of documents.
    """
    tree, segments, opened = CapacityTree(window), [], 0
    for length in sorted(counts, reverse=True):
        placed, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity < 0:
                per = window // length
                full, rest = divmod(left, per)
                first, fresh = opened, full + bool(rest)
                opened += fresh
                capacity = window
            else:
                per = capacity // length
                first, fresh = tree.take(capacity, -(-left // per))
                full, rest = (fresh, 0) if left >= fresh * per else divmod(left, per)
            offset = window - capacity
            if full:
                segments.append((length, placed, full * per, first, per, offset))
                tree.add(capacity - per * length, first, full)
            if rest:
                segments.append((length, placed + full * per, rest, first + full, per, offset))
                tree.add(capacity - rest * length, first + full, 1)
            placed, left = placed + full * per + rest, left - full * per - rest
    return np.array(segments, np.int64).reshape(-1, 6), opened


def token_lengths(docs: DataFrame, tokenizer: str = f"{TOKENIZER_DIR}/byte_bpe_multi_50k.tiktoken", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) of every row: BPE tokens of the whole text and one end-of-text token. Null and empty texts have 1."""
    schema = docs.select(F.col(key), F.lit(0).cast("int").alias("n_tokens")).schema

    def count(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                data, starts = text_bytes(part.column("text"))
                yield pa.record_batch([part.column("key"), pa.array(encoder(tokenizer).count(data, starts) + 1, pa.int32())], [key, "n_tokens"])

    return small_batches(docs).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(count, schema)


def token_pieces(docs: DataFrame, window: int, tokenizer: str = f"{TOKENIZER_DIR}/byte_bpe_multi_50k.tiktoken", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, start, len, ids): the tokens of every row and an end-of-text token, cut into full windows and a rest.

    ids are little-endian, of the encoder's width; start is the piece's place in its text. A null or empty text is the
    end-of-text token alone.
    """
    schema = docs.select(F.col(key).alias("k"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("len"), F.lit(b"").alias("ids")).schema

    def cut(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                e = encoder(tokenizer)
                ids, n = e.encode(*text_bytes(part.column("text")))
                ids, n = np.insert(ids, np.cumsum(n), e.end).astype(e.dtype), n + 1
                pieces = -(-n // window)
                of = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                size = np.minimum(window, n[of] - start)
                ends = np.concatenate([[0], np.cumsum(size)]) * e.dtype().itemsize
                flat = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                for low in range(0, len(of), PIECES):  # a batch of a long text's pieces stays small
                    mine = slice(low, low + PIECES)
                    yield pa.record_batch([part.column("key").take(pa.array(of[mine])), pa.array(start[mine]), pa.array(size[mine]), flat.slice(low, PIECES)], ["k", "start", "len", "ids"])

    return small_batches(docs).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(cut, schema)


#: Pieces of an Arrow batch, and about as many of one length as a task ranks at once.
PIECES, RANKED = 1000, 2000


def pack_windows(lengths: DataFrame, window: int, key: str = "doc_id", length: str = "n_tokens", ranked: int = RANKED) -> DataFrame:
    """Packs rows of the given length into windows of `window` tokens; one result row for each window.

    Rows longer than the window are first cut into full windows; the rest of each goes to best-fit decreasing with the
    shorter rows. Result: window_id, used, and the lists doc_ids, doc_starts (where the piece begins in its document),
    piece_lengths and offsets (where it stands in the window), in the order of offsets. No window holds more than
    `window`; every token of every row is in one window once.

    Null or non-positive lengths have nothing to pack and appear in no window. Null keys are packed as null. Ties of
    length are ordered by key, then by place; repeated rows are packed each. No rows: no windows. Extra columns are ignored.

    How it runs: pieces are written once to the shared folder. Best-fit decreasing needs only how many pieces have each
    length, at most `window` numbers, which the driver places exactly (best_fit_decreasing). Each piece then finds its
    segment by its rank among pieces of its length; ranks come from windows over (length, hash bucket), with a bucket for
    each `ranked` pieces of the length, so that a common length doesn't make a large task. The segment and bucket tables
    sent to the workers follow the distinct lengths, not the rows.
    """
    if window < 1:
        raise ValueError("window must be 1 at least")
    n, at = F.col(length).cast("long"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / window)))
    pieces = lengths.select(F.col(key).alias("k"), n.alias("n")).filter("n > 0").select("k", "n", at.alias("i"))
    pieces = pieces.select("k", (F.col("i") * window).alias("start"), "n").select("k", "start", F.least(F.col("n") - F.col("start"), F.lit(window).cast("long")).alias("len"))
    return _packed(written(pieces, "pieces"), window, ranked)


def pack_tokens(docs: DataFrame, window: int, tokenizer: str = f"{TOKENIZER_DIR}/byte_bpe_multi_50k.tiktoken", key: str = "doc_id", text: str = "text", ranked: int = RANKED) -> DataFrame:
    """Packs the tokens of texts (token_pieces) as pack_windows does; its columns, and token_ids: the window's ids in order,
    little-endian, of two bytes each (four if the vocabulary has more than 65,536).

    Every row has one token at least, its end of text; so null and empty texts are packed too. Whole texts are packed,
    however long. All else as in pack_windows.

    How it runs: texts are tokenised once, into pieces written to the shared folder. Ids move twice, to be ranked among
    pieces of their length and to meet their window; full windows move once.
    """
    if window < 1:
        raise ValueError("window must be 1 at least")
    packed = _packed(written(token_pieces(docs, window, tokenizer, key, text), "pieces"), window, ranked)
    width, names = encoder(tokenizer).dtype().itemsize, [c for c in packed.columns if c != "ids"]

    def join(batches):
        for batch in batches:
            data, _ = text_bytes(batch.column("ids").flatten())
            ends = np.concatenate([[0], np.cumsum(batch.column("used").to_numpy())]) * width
            ids = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])
            yield pa.record_batch([*[batch.column(c) for c in names], ids], [*names, "token_ids"])

    return packed.mapInArrow(join, packed.select(*names, F.lit(b"").alias("token_ids")).schema)


def _packed(pieces: DataFrame, window: int, ranked: int) -> DataFrame:
    """Windows of (k, start, len[, ids]); `ids` lists the pieces' ids."""
    spark, carried = pieces.sparkSession, [c for c in pieces.columns if c == "ids"]
    counts = {r.len: r.c for r in pieces.groupBy("len").agg(F.count("*").alias("c")).collect()}
    segments, _ = best_fit_decreasing(counts, window)
    buckets = F.broadcast(spark.createDataFrame([(n, 1 + c // ranked) for n, c in counts.items()], "len long, buckets long"))  # `window` rows at most
    pieces = pieces.join(buckets, "len").withColumn("b", F.pmod(F.xxhash64("k", "start"), F.col("buckets"))).drop("buckets")
    counted = pieces.groupBy("len", "b").agg(F.count("*").alias("c"))
    firsts = counted.select("len", "b", F.coalesce(F.sum("c").over(Window.partitionBy("len").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    placer = _placer(spark, segments)

    def placed(some: DataFrame) -> DataFrame:
        placed_ = some.withColumn("r", F.row_number().over(Window.partitionBy("len", "b").orderBy("k", "start")) - 1).join(firsts, ["len", "b"])
        placed_ = placed_.select("k", "start", "len", *carried, (F.col("r") + F.col("first")).alias("rank"))
        return placed_.mapInArrow(placer, placed_.drop("rank").withColumns({"window_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema)

    names = {"k": "doc_ids", "start": "doc_starts", "len": "piece_lengths", "offset": "offsets", "ids": "ids"}
    lists = [c for c in names if c != "ids" or carried]
    full = placed(pieces.filter(F.col("len") == window)).select("window_id", F.col("len").alias("used"), *[F.array(c).alias(names[c]) for c in lists])
    joined = placed(pieces.filter(F.col("len") < window)).groupBy("window_id").agg(F.sum("len").alias("used"), F.sort_array(F.collect_list(F.struct("offset", *[c for c in lists if c != "offset"]))).alias("p"))
    return full.unionByName(joined.select("window_id", "used", *[F.col(f"p.{c}").alias(names[c]) for c in lists]))


def _placer(spark, segments: np.ndarray):
    order = np.lexsort((segments[:, 1], segments[:, 0]))
    held = spark.sparkContext.broadcast(segments[order])

    def place(batches):
        seg = held.value
        lengths, begins = np.unique(seg[:, 0], return_index=True)
        stops = np.append(begins[1:], len(seg))
        for batch in batches:
            n, rank, at = batch.column("len").to_numpy(), batch.column("rank").to_numpy(), np.zeros(batch.num_rows, np.int64)
            group = np.searchsorted(lengths, n)
            for g in np.unique(group):
                mine = group == g
                at[mine] = begins[g] + np.searchsorted(seg[begins[g] : stops[g], 1], rank[mine], "right") - 1
            s = seg[at]
            i = rank - s[:, 1]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.record_batch([*[batch.column(c) for c in kept], pa.array(s[:, 3] + i // s[:, 4]), pa.array(s[:, 5] + (i % s[:, 4]) * n)], [*kept, "window_id", "offset"])

    return place
