"""Helpers shared by the corpus operators: shared storage, seeded hashing, vectorised text work."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import spread

TOKENIZER_DIR = "/opt/tokenizers"
#: Bytes of text that a Python worker handles at once; it bounds memory, not the work.
CHUNK_BYTES = 1_000_000

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, or one of our own in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = f"file://{tempfile.mkdtemp(prefix='loomspan-')}"
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def _forget() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


atexit.register(_forget)


#: Rows and bytes of an Arrow batch of texts; they bound what a Python worker and its task hold, not the work.
BATCH_ROWS, BATCH_BYTES = 1000, 4_000_000


def small_batches(df: DataFrame) -> DataFrame:
    """df, dealt out over all cores (spread), in a copy of its session whose Arrow batches are small enough for long texts.

    What the session has set itself stays, and the session stays as it is: only plans that are made of df are run in the copy.
    """
    spark = df.sparkSession
    ours = {f"spark.sql.execution.arrow.{n}": str(most) for n, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES))}
    ours = {k: v for k, v in ours.items() if spark.conf.get(k, None) is None}
    if not ours:
        return spread(df)
    copy = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, v in ours.items():
        copy.conf.set(k, v)
    return spread(DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(copy._jsparkSession, df._jdf.logicalPlan()), copy))


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomspan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of the largest Bloom filter that is sent to the workers: 32 MB. With more keys it passes more, and stays right.
BLOOM_BITS = 2**28


class Bloom:
    """A Bloom filter of `keys` (one column): wide rows can be told apart where they are read. Among the rows within are all
    whose key is there, and a few percent of the others; a join with the keys makes it exact."""

    def __init__(self, keys: DataFrame):
        name, spark = keys.columns[0], keys.sparkSession
        self.bits = min(BLOOM_BITS, 1 << max(10, int(16 * keys.count()).bit_length()))
        ones = keys.select(F.explode(F.array(*self._places(F.col(name)))).alias("p"))
        words = np.zeros(self.bits // 64, np.int64)
        got = ones.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(self._bit(F.col("p"))).alias("b")).toArrow()  # two columns of numbers, BLOOM_BITS / 64 rows at most
        words[got["w"].to_numpy()] = got["b"].to_numpy()
        self.row = spark.createDataFrame(pa.table({"__bloom": pa.array([words], pa.list_(pa.int64()))}))  # one row of at most BLOOM_BITS

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(i), key.cast("long")), F.lit(self.bits)) for i in range(3)]

    @staticmethod
    def _bit(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))

    def _split(self, rows: DataFrame, key: str, within: bool) -> DataFrame:
        held, hit = fresh(rows, "__bloom"), F.lit(True)
        for p in self._places(F.col(key)):
            hit = hit & (F.get(F.col(held), F.floor(p / 64).cast("int")).bitwiseAND(self._bit(p)) != 0)
        return rows.crossJoin(F.broadcast(self.row.withColumnRenamed("__bloom", held))).filter(hit if within else ~hit).drop(held)

    def within(self, rows: DataFrame, key: str) -> DataFrame:
        return self._split(rows, key, True)

    def outside(self, rows: DataFrame, key: str) -> DataFrame:
        return self._split(rows, key, False)


def seeded_hex(seed: int | str, *cols: Column) -> Column:
    """md5 of the seed and the columns, as hex: the same in any engine. A null counts as '~'."""
    parts = [F.lit(str(seed))] + [F.coalesce(c.cast("string"), F.lit("~")) for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def seeded_unit(seed: int | str, *cols: Column) -> Column:
    """Uniform in [0, 1): the first 52 bits of seeded_hex, exact as a double."""
    return F.conv(F.substring(seeded_hex(seed, *cols), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# --- texts of an Arrow batch as one byte array ---


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes (UTF-8) of all texts, or of binary values, end to end, and where each begins (one more entry than texts). Null is empty."""
    column = column.fill_null("") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    starts = np.frombuffer(column.buffers()[1], width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[starts[0] : starts[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, starts - starts[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Slices of the batch that hold about limit bytes of text each, and one row at least."""
    if not batch.num_rows:
        return
    at = batch.schema.get_field_index(column)
    _, starts = text_bytes(batch.column(at))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words: ASCII letters and digits, and all of non-ASCII characters.
WORD = np.zeros(256, bool)
WORD[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


HASH_A, HASH_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Spans of more bytes are hashed and compared one by one.
LONG_SPAN = 64
_BELOW = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a little-endian number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))


class SpanHash:
    """Keyed 64-bit hashes of spans of a byte array: a chain over 8 bytes at a time in two mixed halves; blake2b of long spans.

    Unlike a polynomial it has no pairs of texts that collide whatever the key. Where a collision would give a wrong
    result, spans of one hash are compared by `equal_spans`.
    """

    def __init__(self, key: int = 0):
        self.key = hashlib.blake2b(f"spans {key}".encode(), digest_size=32).digest()
        self.a, self.b, self.c, self.d = (np.uint64(x | 1) for x in np.frombuffer(self.key, "<u8").tolist())

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = ends - starts
        x = mix(n.astype(np.uint64) * self.a + self.b)
        y = x ^ self.c
        eights, at = _eights(data), np.flatnonzero((n > 0) & (n <= LONG_SPAN))
        whole = len(at) == len(n)
        i = 0
        while len(at):
            left = n[at] - 8 * i
            w = eights[starts[at] + 8 * i] & _BELOW[np.minimum(left, 8)]
            if whole and not i:
                x, y = mix((x ^ w) * self.c + y), y * self.d + w
            else:
                x[at], y[at] = mix((x[at] ^ w) * self.c + y[at]), y[at] * self.d + w
            at, i = at[left > 8], i + 1
        for j in np.flatnonzero(n > LONG_SPAN):
            x[j] = int.from_bytes(hashlib.blake2b(data[starts[j] : ends[j]], digest_size=8, key=self.key).digest(), "little")
        return mix(x + y * self.a)


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Which spans have the bytes of the other span beside them."""
    n = ends - starts
    same = n == other_ends - other_starts
    a, b = _eights(data), _eights(other)
    at, i = np.flatnonzero(same & (n > 0) & (n <= LONG_SPAN)), 0
    if data is other:
        at = at[starts[at] != other_starts[at]]
    while len(at):
        left = n[at] - 8 * i
        differ = ((a[starts[at] + 8 * i] ^ b[other_starts[at] + 8 * i]) & _BELOW[np.minimum(left, 8)]) != 0
        same[at[differ]] = False
        at, i = at[(left > 8) & ~differ], i + 1
    for j in np.flatnonzero(same & (n > LONG_SPAN)):
        same[j] = (data is other and starts[j] == other_starts[j]) or np.array_equal(data[starts[j] : ends[j]], other[other_starts[j] : other_ends[j]])
    return same


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of WORD bytes within one text), and how many words each text has."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.concatenate([[False], inside[:-1]])
    begin = np.flatnonzero(inside & (~before | edge))
    end = np.flatnonzero(before & (~inside | edge))
    return begin, end, np.diff(np.searchsorted(begin, starts))


def ragged(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[s : s + n] for each start and count, end to end."""
    total = int(counts.sum())
    if not total:
        return values[:0]
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return values[np.arange(total) + shift]


class TokenEncoder:
    """A tiktoken vocabulary, applied to whole batches of texts.

    The pattern that cuts texts before BPE always cuts between a character that isn't white space and white space. So
    each distinct piece between such cuts is encoded once, and its ids are copied to every place where it stands: the ids
    are those of encoding each text whole. Equal pieces are found by a hash and compared byte by byte; one that differs
    from another of its hash is encoded by itself. Up to `remember` pieces of at most LONG_SPAN bytes are remembered from
    batch to batch; this saves time only.
    """

    def __init__(self, path: str = f"{TOKENIZER_DIR}/byte_bpe_multi_50k.tiktoken", remember: int = 100_000):
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1  # an id that the vocabulary leaves free: end of a text
        self.lengths = np.zeros(self.size, np.int64)
        self.lengths[list(ranks.values())] = [len(x) for x in ranks]
        self.dtype = np.uint16 if self.size <= 65536 else np.uint32
        self.hash, self.remember = SpanHash(), remember
        self.known = self._nothing()

    def _nothing(self):
        """Of the pieces remembered, by hash: hash, where each begins and ends in their bytes, how many ids it has, and where; the bytes; the ids."""
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint8), np.zeros(0, self.dtype)

    def pieces(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where pieces begin, ascending."""
        space = _SPACE[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = space[1:] & ~space[:-1]
        if len(data) > 2:  # white space outside ASCII: C2 85, C2 A0, E1 9A 80, E2 80 80..AF, E2 81 9F, E3 80 80
            last, lead = data[1:-1], data[:-2]
            wide = (lead == 0xC2) & ((last == 0x85) | (last == 0xA0)) | np.isin(lead, (0x80, 0x81, 0x9A)) & (last >= 0x80)
            cut[2:] &= ~wide
        cut[starts[:-1][starts[:-1] < len(data)]] = True
        return np.flatnonzero(cut)

    def _encode_new(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece end to end, and how many each has."""
        # Pieces that start with white space and don't end with it may be encoded end to end.
        plain = _SPACE[data[begin]] & ~_SPACE[data[end - 1]] & (data[end - 1] < 0x80)
        counts, ids = np.zeros(len(begin), np.int64), [None, None]
        joined = ragged(data, begin[plain], (end - begin)[plain])
        got = np.asarray(self.encoding.encode_to_numpy(joined.tobytes().decode(), disallowed_special=()), np.int64) if len(joined) else np.zeros(0, np.int64)
        ends = np.cumsum(self.lengths[got])
        bounds = np.searchsorted(ends, np.cumsum((end - begin)[plain]), "left") + 1 if plain.any() else np.zeros(0, np.int64)
        counts[plain] = np.diff(np.concatenate([[0], bounds]))
        ids[0] = got
        rest = [self.encoding.encode_ordinary(data[b:e].tobytes().decode()) for b, e in zip(begin[~plain], end[~plain])]
        counts[~plain] = [len(x) for x in rest]
        ids[1] = np.array([i for x in rest for i in x], np.int64)
        flat = np.concatenate(ids)
        at = np.zeros(len(begin), np.int64)
        at[plain] = np.cumsum(counts[plain]) - counts[plain]
        at[~plain] = len(got) + np.cumsum(counts[~plain]) - counts[~plain]
        return ragged(flat, at, counts).astype(self.dtype), counts

    def _lookup(self, data, starts):
        """For each piece its entry in a table of counts and starts in flat ids; and how many pieces each text has."""
        begin = self.pieces(data, starts)
        end = np.concatenate([begin[1:], [len(data)]]).astype(np.int64) if len(begin) else begin
        distinct, index, inverse = np.unique(self.hash(data, begin, end), return_index=True, return_inverse=True)
        odd = np.flatnonzero(~equal_spans(data, begin, end, data, begin[index][inverse], end[index][inverse]))  # another piece has their hash
        kh, kb, ke, kn, ks, kdata, kids = self.known
        n, s, new, taken = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), np.ones(len(distinct), bool), np.zeros(len(distinct), bool)
        if len(kh):
            at = np.minimum(np.searchsorted(kh, distinct), len(kh) - 1)
            taken = kh[at] == distinct
            hit = np.flatnonzero(taken)
            hit = hit[equal_spans(data, begin[index[hit]], end[index[hit]], kdata, kb[at[hit]], ke[at[hit]])]
            n[hit], s[hit], new[hit] = kn[at[hit]], ks[at[hit]], False
        new = np.flatnonzero(new)
        keep = ~taken[new] & (end[index[new]] - begin[index[new]] <= LONG_SPAN)
        keep &= len(kh) + int(keep.sum()) <= self.remember
        new = np.concatenate([new[keep], new[~keep]])  # what is remembered comes first
        held, todo = int(keep.sum()), np.concatenate([index[new], odd])
        ids, counts = self._encode_new(data, begin[todo], end[todo]) if len(todo) else (kids[:0], kn[:0])
        places, flat = len(kids) + np.cumsum(counts) - counts, np.concatenate([kids, ids])
        n[new], s[new] = counts[: len(new)], places[: len(new)]
        if held:
            b, e = begin[index[new[:held]]], end[index[new[:held]]]
            stop = len(kdata) + np.cumsum(e - b)
            parts = (kh, distinct[new[:held]]), (kb, stop - (e - b)), (ke, stop), (kn, counts[:held]), (ks, places[:held])
            order = np.argsort(np.concatenate(parts[0]), kind="stable")
            self.known = *[np.concatenate(x)[order] for x in parts], np.concatenate([kdata, ragged(data, b, e - b)]), flat[: len(kids) + int(counts[:held].sum())]
        n, s = n[inverse], s[inverse]
        n[odd], s[odd] = counts[len(new) :], places[len(new) :]
        return n, s, flat, np.diff(np.searchsorted(begin, starts))

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        n, s, flat, pieces = self._lookup(data, starts)
        total = np.concatenate([[0], np.cumsum(n)])
        at = np.concatenate([[0], np.cumsum(pieces)])
        return ragged(flat, s, n), np.diff(total[at])

    def count(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n, _, _, pieces = self._lookup(data, starts)
        total = np.concatenate([[0], np.cumsum(n)])
        return np.diff(total[np.concatenate([[0], np.cumsum(pieces)])])


_encoders: dict[str, TokenEncoder] = {}


def encoder(path: str) -> TokenEncoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = TokenEncoder(path)
    return _encoders[path]
