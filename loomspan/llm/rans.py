"""Token ids as binary blocks, coded by a static range asymmetric numeral system (rANS)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZER_DIR, chunks, encoder, small_batches, text_bytes, written

LOW = 1 << 31  # states stay in [2^31, 2^63); words of 32 bits leave and enter

BLOCKS = "kind string, part long, seq long, n_tokens int, lanes int, payload binary, checkpoint_words array<int>, checkpoint_states binary, checkpoint_crcs array<long>, payload_crc long, tokens_crc long, doc_ids array<long>, doc_positions array<int>, doc_offsets array<long>"


def frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Scales counts to a sum of 2^bits; whatever occurs keeps 1 at least."""
    seen = np.flatnonzero(counts)
    if len(seen) > 1 << bits:
        raise ValueError("more symbols than the table has room for: raise bits")
    freq = np.zeros(len(counts), np.int64)
    if not len(seen):
        return freq
    exact = counts[seen].astype(np.float64) * ((1 << bits) / counts[seen].sum())
    got = np.maximum(1, np.floor(exact).astype(np.int64))
    over = int(got.sum()) - (1 << bits)
    order = np.argsort(-got, kind="stable")
    while over:  # the commonest lose or gain least by a change
        step = got[order] - 1 if over > 0 else np.full(len(order), -over)
        change = np.minimum(step, max(1, abs(over) // len(order)))
        total = np.minimum(np.cumsum(change), abs(over))
        change = np.diff(np.concatenate([[0], total]))
        got[order] -= change if over > 0 else -change
        over = int(got.sum()) - (1 << bits)
    freq[seen] = got
    return freq


def encode_blocks(tokens: np.ndarray, freq: np.ndarray, bits: int, lanes: int, every: int) -> list[dict]:
    """Encodes blocks (rows of `tokens`, all of one length) at once; each is independent of the others.

    Lane j of a block codes its tokens j, j + lanes, ...; all lanes share one stream of words. The last step is filled up
    with the commonest token. A checkpoint is kept every `every` steps: the lanes' states, the words read before it, and
    the checksum of the tokens from it to the next.
    """
    blocks, n = tokens.shape
    steps = -(-n // lanes)
    filled = np.full((blocks, steps * lanes), int(np.argmax(freq)), np.int64)
    filled[:, :n] = tokens
    grid = np.ascontiguousarray(filled.reshape(blocks, steps, lanes).transpose(1, 0, 2).reshape(steps, -1))
    f64, cum = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    state = np.full(blocks * lanes, LOW, np.uint64)
    wide, low32, shift = np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(bits)
    out, sent = np.zeros((steps, blocks * lanes), np.uint32), np.zeros((steps, blocks * lanes), bool)
    kept = {}
    limit = np.uint64((LOW >> bits) << 32)
    for s in range(steps - 1, -1, -1):
        f = f64[grid[s]]
        full = state >= limit * f
        out[s], sent[s] = state & low32, full
        state = np.where(full, state >> wide, state)
        q = state // f
        state = (q << shift) + (state - q * f) + cum[grid[s]]
        if s % every == 0:
            kept[s] = state
    result = []
    out, sent = out.reshape(steps, blocks, lanes), sent.reshape(steps, blocks, lanes)
    for b in range(blocks):
        mask = sent[:, b]
        payload = out[:, b][mask].astype("<u4").tobytes()
        before = np.concatenate([[0], np.cumsum(mask.sum(1))])
        marks = sorted(kept)
        result.append({
            "n_tokens": n, "lanes": lanes, "payload": payload, "payload_crc": zlib.crc32(payload), "tokens_crc": zlib.crc32(tokens[b].astype("<u4").tobytes()),
            "checkpoint_words": [int(before[s]) for s in marks],
            "checkpoint_crcs": [zlib.crc32(tokens[b, s * lanes : (s + every) * lanes].astype("<u4").tobytes()) for s in marks],
            "checkpoint_states": np.stack([kept[s].reshape(blocks, lanes)[b] for s in marks]).astype("<u8").tobytes(),
        })
    return result


def decode_block(block: dict, freq: np.ndarray, bits: int, every: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Tokens start..stop of a block, from the checkpoint before `start` to the one after `stop`. Raises ValueError if the
    payload's checksum or that of any of these tokens is wrong."""
    n, lanes = block["n_tokens"], block["lanes"]
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.int64)
    payload = bytes(block["payload"])
    if zlib.crc32(payload) != block["payload_crc"]:
        raise ValueError("the payload's checksum is wrong")
    stream = np.frombuffer(payload, "<u4").astype(np.uint64)
    states = np.frombuffer(bytes(block["checkpoint_states"]), "<u8").reshape(-1, lanes)
    mark, last = start // lanes // every, (stop - 1) // lanes // every
    state, word, step = states[mark].copy(), block["checkpoint_words"][mark], mark * every
    slots = np.repeat(np.arange(len(freq)), freq)
    f64, cum = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    low, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    got = []
    for _ in range(step, min(-(-n // lanes), (last + 1) * every)):
        slot = state & low
        token = slots[slot]
        got.append(token)
        state = f64[token] * (state >> shift) + slot - cum[token]
        need = np.flatnonzero(state < np.uint64(LOW))
        if word + len(need) > len(stream):
            raise ValueError("the payload ends early")
        state[need] = (state[need] << np.uint64(32)) | stream[word : word + len(need)]
        word += len(need)
    tokens = np.concatenate(got)[: n - step * lanes]
    for i in range(mark, last + 1):
        if zlib.crc32(tokens[(i - mark) * every * lanes : (i - mark + 1) * every * lanes].astype("<u4").tobytes()) != block["checkpoint_crcs"][i]:
            raise ValueError("the tokens' checksum is wrong")
    if start == 0 and stop == n and zlib.crc32(tokens.astype("<u4").tobytes()) != block["tokens_crc"]:
        raise ValueError("the tokens' checksum is wrong")
    return tokens[start - step * lanes : stop - step * lanes]


def tokenized(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens): little-endian ids of the whole text, then the end-of-text id. A null text counts as empty."""

    def encode(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                e = encoder(tokenizer)
                ids, n = e.encode(*text_bytes(part.column("text")))
                ids = np.insert(ids, np.cumsum(n), e.end).astype(e.dtype)
                ends = np.concatenate([[0], np.cumsum(n + 1)]) * e.dtype().itemsize
                flat = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.record_batch([part.column("key").cast(pa.int64()), flat], ["key", "tokens"])

    return small_batches(docs).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(encode, "key long, tokens binary")


def encode_corpus(
    docs: DataFrame, tokenizer: str = f"{TOKENIZER_DIR}/byte_bpe_multi_50k.tiktoken", block_tokens: int = 65536, lanes: int = 32, every: int = 512, bits: int = 20,
    together: int = 64, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Encodes every document's token ids into rANS blocks that share one frequency table.

    One row has kind 'table' (payload: the vocabulary's frequencies, little-endian uint32, summing to 2^bits); each other
    row is a block of up to block_tokens ids: payload, checkpoints every `every` steps of `lanes` tokens, checksums of
    payload and ids, and the documents in it (doc_ids, doc_positions in the block, and doc_offsets: how many of the
    document's ids earlier blocks hold). Documents stand one after another, each ended by the end-of-text id, and may run
    over several blocks of one part. decode_block decodes a whole block or, from a checkpoint, a part of it.

    The blocks depend on the data and the parameters alone, however rows lie and whatever runs them: documents are dealt
    out to parts of about `together` blocks by a hash of key and ids, and stand there in the order of key, then ids.

    Null and empty texts are the end-of-text id alone; null keys stay null in doc_ids; repeated rows are encoded each, and
    stand together. Whole texts are encoded, however long. No rows: a table of zeros and no block. Extra columns are ignored.

    How it runs: texts are tokenised once into a table in the shared folder; counts are summed within each task, then by
    id (one row for each id of the vocabulary reaches the driver and, as the shared table, the workers; neither grows with
    the data). Ids, at two bytes each, move once, to their parts. All lanes of up to `together` blocks advance in one
    vectorised step.
    """
    e = encoder(tokenizer)
    width, dtype = e.size, e.dtype
    tokens = written(tokenized(docs, tokenizer, key, text), "tokens")

    def count(batches):
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column("tokens"), dtype)[0], minlength=width)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = np.zeros(width, np.int64)
    for r in tokens.mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    freq = frequencies(counts, bits)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(freq)

    parts = 1 + int(counts.sum()) // (block_tokens * together)

    def encode(batches):
        part, seq = None, 0
        ids, docs_in = np.zeros(0, dtype), []  # docs_in: (doc_id, first position, offset in document)

        def blocks(block: np.ndarray):
            nonlocal seq, docs_in
            rows = encode_blocks(block, held.value, bits, lanes, every)
            size = block.shape[1]
            begins = np.array([p for _, p, _ in docs_in], np.int64)
            for b, row in enumerate(rows):
                low, high = b * size, (b + 1) * size
                i, j = max(0, int(np.searchsorted(begins, low, "right")) - 1), int(np.searchsorted(begins, high, "left"))
                mine = [(k, max(p, low) - low, o + max(0, low - p)) for k, p, o in docs_in[i:j]]
                yield row | {"kind": "block", "part": part, "seq": seq, "doc_ids": [m[0] for m in mine], "doc_positions": [m[1] for m in mine], "doc_offsets": [m[2] for m in mine]}
                seq += 1
            done, last = block.size, [d for d in docs_in if d[1] <= block.size][-1:]
            docs_in = [(k, 0, o + done - p) for k, p, o in last if p < done] + [(k, p - done, o) for k, p, o in docs_in if p >= done]

        def rows_of(more):
            return pa.RecordBatch.from_pylist(list(more), schema=_schema())

        def rest():
            nonlocal ids, docs_in, seq
            whole = len(ids) // block_tokens
            if whole:
                now, ids = ids[: whole * block_tokens], ids[whole * block_tokens :]
                yield rows_of(blocks(now.reshape(whole, block_tokens)))
            if len(ids):
                yield rows_of(blocks(ids.reshape(1, -1)))
            ids, docs_in, seq = np.zeros(0, dtype), [], 0

        for batch in batches:
            of = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                if of[low] != part:
                    yield from rest()
                    part = int(of[low])
                mine = batch.slice(low, high - low)
                flat, starts = _flat(mine.column("tokens"), dtype)
                docs_in += zip(mine.column("key").to_pylist(), (starts[:-1] + len(ids)).tolist(), [0] * mine.num_rows)
                ids = np.concatenate([ids, flat])
                while len(ids) >= block_tokens * together:
                    now, ids = ids[: block_tokens * together], ids[block_tokens * together :]
                    yield rows_of(blocks(now.reshape(together, block_tokens)))
        yield from rest()

    head = spark.createDataFrame([("table", -1, -1, 0, 0, bytearray(freq.astype("<u4").tobytes()), [], bytearray(), [], zlib.crc32(freq.astype("<u4").tobytes()), 0, [], [], [])], BLOCKS)
    dealt = tokens.select(F.pmod(F.xxhash64("key", "tokens"), F.lit(parts)).alias("part"), "key", "tokens").repartition("part").sortWithinPartitions("part", "key", "tokens")
    return head.unionByName(dealt.mapInArrow(encode, BLOCKS))


def decode_corpus(blocks: DataFrame, every: int = 512, bits: int = 20) -> DataFrame:
    """(doc_id, offset, tokens) for each part of a document in a block; checks all checksums."""
    freq = np.frombuffer(bytes(blocks.filter("kind = 'table'").head().payload), "<u4").astype(np.int64)
    held = blocks.sparkSession.sparkContext.broadcast(freq)

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row, held.value, bits, every)
                ends = row["doc_positions"][1:] + [len(ids)]
                yield pa.RecordBatch.from_pylist([{"doc_id": d, "offset": o, "tokens": ids[p:q].tolist()} for d, p, q, o in zip(row["doc_ids"], row["doc_positions"], ends, row["doc_offsets"])], schema=pa.schema({"doc_id": pa.int64(), "offset": pa.int64(), "tokens": pa.list_(pa.int32())}))

    return blocks.filter("kind = 'block'").mapInArrow(decode, "doc_id long, offset long, tokens array<int>")


def _flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column end to end, and where each row begins."""
    wide = pa.types.is_large_binary(column.type)
    starts = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[starts[0] : starts[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), dtype), (starts - starts[0]) // np.dtype(dtype).itemsize


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in BLOCKS.split(", "))])
