"""Near-duplicate groups by SetSketch registers: banding, joint likelihood, verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HASH_B, Bloom, SpanHash, chunks, fresh, mix, ragged, small_batches, text_bytes, words, written

#: Registers are max(floor(1 - log_b h)) clipped to 0..Q+1, h being exponential with rate A: 16 bits each.
REGISTERS, BASE, RATE, Q = 160, 1.001, 20.0, 2**16 - 2
BAND = 4  # registers of a band
SHINGLE = 3  # words of a shingle


def shingles(data: np.ndarray, starts: np.ndarray, width: int = SHINGLE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of `width` words of each text, and how many each text has (a shorter text has one run, of all its words).

    They are keyed by `seed`: who writes a text and doesn't know it can't make two runs collide but by chance, 1 in 2^64.
    """
    return _runs(data, *words(data, starts), width, seed)


def _runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, n: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    h = SpanHash(seed)(data, begin, end)
    first = np.cumsum(n) - n
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = ragged_index(first, counts)
    size = np.repeat(np.minimum(n, width), counts)
    out = np.zeros(len(at), np.uint64)
    for i in range(width):
        there = i < size
        out[there] = mix(out[there] * np.uint64(HASH_B) + h[at[there] + i])
    return out, counts


def contents(data: np.ndarray, begin: np.ndarray, end: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """128 bits of blake2b of each text's words with a blank between; None for a text without words."""
    size = end - begin + 1
    line = ragged(np.append(data, np.uint8(32)), begin, size)
    stops = np.cumsum(size)
    line[stops - 1] = 32
    cuts = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(n)])].tolist()
    held = memoryview(line)
    return [hashlib.blake2b(held[a:b], digest_size=16).digest() if b > a else None for a, b in zip(cuts[:-1], cuts[1:])]


def ragged_index(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def registers(hashes: np.ndarray, counts: np.ndarray, m: int = REGISTERS, seed: int = 0) -> np.ndarray:
    """SetSketch registers (texts x m) of sets of hashes that stand end to end; sets may not be empty.

    The exponentials of an element's hash are -log(1 - u) / A for uniforms u, one for each register; as that rises with u,
    the least exponential of a set comes from its least u, and registers of unions are maxima of registers.
    """
    rng = np.random.default_rng(seed + 12345)
    a, b = rng.integers(0, 2**63, m, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, m, np.uint64)
    least = np.zeros((len(counts), m), np.uint32)
    first = np.cumsum(counts) - counts
    i = 0
    while i < len(counts):  # runs of sets that fit the processor's cache
        j = max(i + 1, int(np.searchsorted(first, first[i] + 32768)))
        x, at = hashes[first[i] : first[j - 1] + counts[j - 1]], first[i:j] - first[i]
        for r in range(m):
            least[i:j, r] = np.minimum.reduceat(((x * a[r] + b[r]) >> np.uint64(32)).astype(np.uint32), at)
        i = j
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def cardinality(k: np.ndarray) -> np.ndarray:
    return k.shape[1] * (1 - 1 / BASE) / (RATE * np.log(BASE) * np.sum(BASE ** -k.astype(np.float64), 1))


def joint_jaccard(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of greatest likelihood, for pairs of rows of registers.

    With n_u and n_v estimated from the registers, a register of u is above that of v with probability p(x - y J), where
    x = n_u / (n_u + n_v), y = 1 - x and p(z) = -log_b(1 - z (b - 1) / b); likewise below; else they are equal. The log
    likelihood is concave in J: golden section.
    """
    nu, nv = cardinality(u), cardinality(v)
    x, y = nu / (nu + nv), nv / (nu + nv)
    above, below = (u > v).sum(1), (u < v).sum(1)
    equal = u.shape[1] - above - below
    p = lambda z: -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        more, less = p(x - y * j), p(y - x * j)
        return above * np.log(np.maximum(more, 1e-300)) + below * np.log(np.maximum(less, 1e-300)) + equal * np.log(np.maximum(1 - more - less, 1e-300))

    low, high, g = np.zeros(len(x)), np.minimum(x / y, y / x), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = high - g * (high - low), low + g * (high - low)
        left = likelihood(c) >= likelihood(d)
        low, high = np.where(left, low, c), np.where(left, d, high)
    return (low + high) / 2


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, content, sketch): content is 128 bits of blake2b of the sequence of words; both are null for texts without words."""
    schema = pa.schema({"doc_id": pa.int64(), "content": pa.binary(), "sketch": pa.binary()})

    def sketch(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                data, starts = text_bytes(part.column("text"))
                begin, end, count = words(data, starts)
                h, n = _runs(data, begin, end, count, SHINGLE, seed)
                some = np.flatnonzero(n)
                k = registers(h, n[some], seed=seed).astype("<u2").tobytes() if len(some) else b""
                rows = np.full(len(n), -1)
                rows[some] = np.arange(len(some))
                pick = pa.array(rows, mask=rows < 0)
                take = lambda raw, w: pa.Array.from_buffers(pa.binary(w), len(some), [None, pa.py_buffer(raw)]).cast(pa.binary()).take(pick)
                yield pa.record_batch([part.column("key"), pa.array(contents(data, begin, end, count), pa.binary()), take(k, 2 * REGISTERS)], schema=schema)

    rows = small_batches(docs).filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.lower(F.col(text)).alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, content binary, sketch binary")


def near_pairs(docs: DataFrame, sketched: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(links, heads): verified links (a, b) that connect what is similar, and the document that stands for each content.

    Documents of one content are represented by the least doc_id. Heads that share a band of registers form a bucket.
    First all of a bucket are compared with a leader; those that don't match it then choose a leader of their own, and are
    compared with it; what is left is compared in full. Two heads that both match a leader are connected through it. One
    that matches it (similarity s) and one that doesn't (r) can be near only if s - r <= 1 - threshold, as 1 - Jaccard is
    a metric: such pairs are compared too. So the components are those of comparing all pairs of the bucket, and close
    copies cost one comparison each, even beside an outlying leader.
    """
    heads = written(sketched.filter("content is not null").groupBy("content").agg(F.min(F.struct("doc_id", "sketch")).alias("h")).select("content", "h.doc_id", "h.sketch"), "heads")
    bands = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 2 * BAND * i + 1, 2 * BAND)) for i in range(REGISTERS // BAND)]))
    left = heads.select("doc_id", bands.alias("bucket"))
    verified = lambda pairs: _verified(pairs, heads, docs, threshold, key, text, seed)
    tried, more = None, []
    for first in (F.col("doc_id"), F.struct(F.xxhash64("bucket", "doc_id"), F.col("doc_id"))):
        in_bucket = Window.partitionBy("bucket")
        led = left.withColumns({"leader": F.min(first).over(in_bucket), "n": F.count("*").over(in_bucket)}).filter("n > 1")
        leader = F.col("leader") if first._jc.toString() == "doc_id" else F.col("leader.doc_id")
        led = written(led.select("bucket", "doc_id", leader.alias("leader")), "buckets")
        ends = [F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")]
        pairs = led.filter("doc_id <> leader").select(*ends).distinct()
        new = verified(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = new if tried is None else tried.unionByName(new)
        said = led.filter("doc_id <> leader").select("bucket", "doc_id", *ends).join(tried, ["a", "b"]).select("bucket", "doc_id", "near", "jaccard")
        said = written(said, "said")
        loose, matched = said.filter("not near"), said.filter("near")
        most = loose.groupBy("bucket").agg(F.max("jaccard").alias("most"))
        far = matched.join(most, "bucket").filter(F.col("jaccard") <= F.col("most") + 1 - threshold)
        across = far.select("bucket", F.col("doc_id").alias("y"), F.col("jaccard").alias("s")).join(loose.select("bucket", F.col("doc_id").alias("x"), F.col("jaccard").alias("r")), "bucket")
        more.append(across.filter(F.col("s") - F.col("r") <= 1 - threshold).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        left = loose.select("doc_id", "bucket")
    more.append(left.select(F.col("doc_id").alias("a"), "bucket").join(left.select(F.col("doc_id").alias("b"), "bucket"), "bucket").filter("a < b").select("a", "b"))
    rest = more[0].unionByName(more[1]).unionByName(more[2]).distinct().join(tried, ["a", "b"], "left_anti")
    return tried.unionByName(verified(rest)).filter("near").select("a", "b"), heads


def _verified(pairs: DataFrame, heads: DataFrame, docs: DataFrame, threshold: float, key: str, text: str, seed: int) -> DataFrame:
    """(a, b, near, jaccard): near if the sets of shingles have a Jaccard similarity of `threshold`; written to the shared folder.

    Pairs whose joint estimate is more than four standard errors below the threshold are settled by it, and `jaccard` is
    the estimate and four standard errors; all others are verified on the shingles themselves.
    """
    error = 4 * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    least = threshold - error

    def estimate(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pair in parts:
            yield pa.array(joint_jaccard(*[text_bytes(x)[0].view("<u2").reshape(-1, REGISTERS) for x in pair]))

    pairs = written(pairs, "pairs")
    s = Bloom(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()).within(heads.select("doc_id", "sketch"), "doc_id")
    with_sketches = pairs.join(s.withColumnsRenamed({"doc_id": "a", "sketch": "u"}).hint("merge"), "a").join(s.withColumnsRenamed({"doc_id": "b", "sketch": "v"}).hint("merge"), "b")
    scored = with_sketches.select("a", "b", F.arrow_udf(estimate, "double")("u", "v").alias("j"))
    estimated = written(scored.groupBy("a", "b").agg(F.max("j").alias("j")), "estimated")  # a repeated doc_id may have several heads
    hopeful = estimated.filter(F.col("j") >= least).select("a", "b")

    ids = hopeful.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = small_batches(docs).filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = Bloom(ids).within(texts, "doc_id").select("doc_id", F.lower("text").alias("text"))

    def as_sets(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                h, n = shingles(*text_bytes(part.column("text")), seed=seed)
                cuts = np.split(h.astype(np.uint64), np.cumsum(n)[:-1])
                yield pa.record_batch([part.column("doc_id"), pa.array([np.unique(x).astype("<u8").tobytes() for x in cuts], pa.binary())], ["doc_id", "hashes"])

    sets = written(sets.mapInArrow(as_sets, "doc_id long, hashes binary"), "sets")

    def compare(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pair in parts:
            (u, i), (v, j) = (text_bytes(x) for x in pair)
            sets = ((u[i[r] : i[r + 1]].view("<u8"), v[j[r] : j[r + 1]].view("<u8")) for r in range(len(pair[0])))
            yield pa.array([_jaccard(x, y) for x, y in sets], pa.float64())

    both = hopeful.join(sets.withColumnsRenamed({"doc_id": "b", "hashes": "v"}).hint("merge"), "b").join(sets.withColumnsRenamed({"doc_id": "a", "hashes": "u"}).hint("merge"), "a")
    # A repeated doc_id is one document here: the nearest of its texts counts.
    exact = both.select("a", "b", F.arrow_udf(compare, "double")("u", "v").alias("jaccard")).groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))
    hopeless = estimated.filter(F.col("j") < least).select("a", "b", F.lit(False).alias("near"), (F.col("j") + error).alias("jaccard"))
    return written(exact.select("a", "b", (F.col("jaccard") >= threshold).alias("near"), "jaccard").unionByName(hopeless), "tried")


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, True))
    return both / max(1, len(x) + len(y) - both)


def components(links: DataFrame) -> DataFrame:
    """(doc_id, root): the least doc_id that links connect each to, by alternating large and small stars."""
    edges = written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct(), "edges")

    def large(e: DataFrame) -> DataFrame:
        """Every neighbour greater than v gets v's least neighbour."""
        around = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        m = F.least(F.min("u").over(Window.partitionBy("v")), F.col("v"))
        return around.select(F.col("u").alias("x"), "v", m.alias("m")).filter("x > v").select(F.col("x").alias("v"), F.col("m").alias("u"))

    def small(e: DataFrame) -> DataFrame:
        """v and all lesser neighbours get the least of them."""
        m = F.min("u").over(Window.partitionBy("v"))
        linked = e.select("v", "u", m.alias("m"))
        return linked.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(linked.select("v", F.col("m").alias("u"))).distinct()

    mark = None
    while True:
        edges = written(small(large(edges).distinct()), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).head()
        if (now.n, now.h) == mark:
            return edges.select(F.col("v").alias("doc_id"), F.col("u").alias("root"))
        mark = (now.n, now.h)


def near_groups(docs: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, members): one row for each group of near duplicates; doc_id is the least of its members, the one that stays.

    Two documents are near if their sets of word triples (words: runs of ASCII letters, digits and other characters,
    lower-cased; a text of fewer words is one shingle) have a Jaccard similarity of `threshold`; groups are what such pairs
    connect. Candidates share one of 40 bands of 4 registers; a pair at similarity 0.57 is found with probability 0.99, and
    almost surely where a group links it in several ways. Documents without a near duplicate are groups of one.

    Texts that are null or have no words resemble nothing and are groups of one. Whole texts are sketched and verified,
    however long. Rows that repeat a doc_id are one document, listed once, and near what any of its texts is near; rows
    with a null doc_id are left out. Equally near documents are all in the group. Extra columns are ignored. No rows: no
    groups. The members of a group stand in one row; near_roots gives the same groups as narrow rows, for groups too large
    for that.

    How it runs: one map-only pass over the texts gives 160 registers of 16 bits each; equal contents are collapsed before
    anything is compared, and only texts of hopeful candidates are read again. Every result that is used twice is written
    to the shared folder. Bloom filters of bounded size drop texts and sketches that no pair needs where they are read; joins
    are sort-merge at any size. Nothing else reaches the driver but counts.
    """
    roots = near_roots(docs, threshold, key, text, seed)
    return roots.groupBy(F.col("root")).agg(F.sort_array(F.collect_list("doc_id")).alias("members")).select(F.col("root").alias("doc_id"), "members")


def near_roots(docs: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, root): for each document the least doc_id of its group (near_groups). Groups of any size."""
    sketched = written(sketches(docs, key, text, seed), "sketches")
    roots = _linked(docs, sketched, threshold, key, text, seed)
    return sketched.select("doc_id").distinct().join(roots, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))


def _linked(docs: DataFrame, sketched: DataFrame, threshold: float, key: str, text: str, seed: int) -> DataFrame:
    """(doc_id, root) of all documents but those that stand for their group, or are alone."""
    links, heads = near_pairs(docs, sketched, threshold, key, text, seed)
    same = sketched.select("content", "doc_id").join(heads.select("content", F.col("doc_id").alias("head")), "content").filter("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    return components(links.unionByName(same))


def drop_near(docs: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """The rows of docs without those that near_groups would remove; all columns stay.

    Rows with a null key stay. Of rows that repeat a key that stays, the one with the least text (then the least other
    columns) stays.
    """
    sketched = written(sketches(docs, key, text, seed), "sketches")
    id_ = fresh(docs, "__removed")
    removed = written(_linked(docs, sketched, threshold, key, text, seed).select(F.col("doc_id").alias(id_)), "removed")
    some = Bloom(removed)  # only rows that may be removed move
    kept = some.outside(docs, key).unionByName(some.within(docs, key).join(removed.hint("merge"), F.col(key).cast("long") == F.col(id_), "left_anti"))
    twice = sketched.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(id_))
    if twice.isEmpty():
        return kept
    twice = written(twice, "repeated")
    n = fresh(docs, "__n")
    order = [F.col(text)] + [F.col(f"`{c}`") for c, kind in docs.dtypes if c != text and "map<" not in kind and kind != "variant"]
    one = kept.join(twice, F.col(key).cast("long") == F.col(id_), "left_semi").withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(n) == 1).drop(n)
    return kept.join(twice, F.col(key).cast("long") == F.col(id_), "left_anti").unionByName(one)


def oracle(threshold: float) -> str:
    """All pairs that share a shingle, and the components of those that are near."""
    return f"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x00-/:-@\\[-`{{-\\x7f]+'), lambda x: x <> '') as w from documents),
g as (select distinct doc_id, md5(array_to_string(w[i : i + 2], ' ')) as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where c::double / (x.n + y.n - c) >= {threshold}),
both_ways as (select a, b from e union all select b, a from e),
reached(a, b) as (select doc_id, doc_id from documents union select r.a, s.b from reached r join both_ways s on r.b = s.a),
roots as (select a as doc_id, min(b) as root from reached group by 1)
select root as doc_id, list(doc_id order by doc_id) as members from roots group by root"""
