"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, seeded_hex


def interleave_shards(docs: DataFrame, shards: int, seed: int = 0, source: str = "source", key: str = "doc_id", buckets: int = 4096) -> DataFrame:
    """Adds `shard` (0-based) and `position` to every row, so that every shard holds the mixture of the whole.

    Rows of a source are shuffled by a seeded hash of `key` and ranked r = 0, 1, ...; their fractional rank is
    (r + 1/2) / n, n being the rows of the source. `position` is the place of a row among all rows sorted by fractional
    rank, then source; shard = position * shards div rows. Over any run of positions, and so in any shard, each source has
    its share but for less than two rows.

    A null source is a source of its own (it sorts first). Ties of the hash, repeated keys and null keys are ordered by
    key, then by all other columns; wholly equal rows are interchangeable. No rows: no rows. If docs already has columns
    `shard` or `position`, the new ones are called `_shard` or `_position`. `shards` must be 1 at least; with fewer rows
    than shards some shards stay empty.

    How it runs: the hash is uniform, so its leading bits cut the rows of each source into `buckets` runs of known order
    without sampling. One pass over `key` and `source` alone counts rows by run and source; the ranks before each run are
    running sums of these counts. Whole rows move once, by run. As the rank in a source is closely followed by the hash,
    a run spans neighbouring shards only. The position needs no second sort: of another source with m rows, those before
    fractional rank f are ceil(f * m - 1/2).
    """
    if shards < 1 or not 1 <= buckets <= 65536:
        raise ValueError("shards must be 1 at least, buckets 1 to 65536")
    h, run, rank, first, sizes, total = (fresh(docs, f"__{x}") for x in ("h", "run", "rank", "first", "sizes", "total"))
    src, n = fresh(docs, "__src"), fresh(docs, "__n")
    shard, position = fresh(docs, "shard"), fresh(docs, "position")
    hashed = seeded_hex(seed, F.col(key))
    bucket = F.floor(F.conv(F.substring(F.col(h), 1, 4), 16, 10).cast("int") * buckets / 65536).cast("int")
    label = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))  # null first, distinct from ''

    counts = docs.select(hashed.alias(h), label.alias(src)).groupBy(src, bucket.alias(run)).agg(F.count("*").alias(n))
    before = Window.partitionBy(src).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(src, run, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    mixture = counts.groupBy(src).agg(F.sum(n).alias(n)).agg(F.sort_array(F.collect_list(F.struct(F.col(src).alias("s"), F.col(n).alias("n")))).alias(sizes), F.sum(n).alias(total))

    others = [F.col(c) for c, kind in docs.dtypes if c not in (key,) and "map<" not in kind and kind != "variant"]
    order = Window.partitionBy(run, src).orderBy(F.col(h), F.col(key), *others)
    ranked = (
        docs.withColumns({h: hashed, src: label}).withColumn(run, bucket)
        .withColumn(rank, F.row_number().over(order) - 1)
        .join(firsts, [run, src]).withColumn(rank, F.col(rank) + F.col(first))
        .crossJoin(F.broadcast(mixture))  # one row; it grows with the number of sources only
    )
    placed = ranked.withColumn(position, _position(F.col(rank), F.col(src), F.col(sizes)))
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], F.expr(f"cast((cast({position} as decimal(20,0)) * {int(shards)}) div {total} as int)").alias(shard), position)


def _position(rank: Column, src: Column, sizes: Column) -> Column:
    """Rows of all sources before (rank + 1/2) / n, and at it those of sources that sort before, in whole numbers."""
    dec = lambda c: c.cast("decimal(19,0)")
    own = F.element_at(F.filter(sizes, lambda x: x["s"] == src), 1)["n"]

    def before(total: Column, x: Column) -> Column:
        # (2j+1) * own < (2r+1) * n, or <= for sources that sort before; j = 0, 1, ...
        room = dec(2 * rank + 1) * dec(x["n"]) + dec(own) - F.when(x["s"] < src, F.lit(0)).otherwise(F.lit(1))
        return total + F.floor(room / dec(2 * own)).cast("long")

    return F.when(F.size(sizes) == 1, rank).otherwise(F.aggregate(F.filter(sizes, lambda x: x["s"] != src), rank.cast("long"), before))


def oracle(shards: int, seed: int) -> str:
    return f"""
with a as (select *, md5(concat('{seed}', '|', coalesce(cast(doc_id as varchar), '~'))) as h from documents),
b as (select *, row_number() over (partition by source order by h, doc_id, text) - 1 as r, count(*) over (partition by source) as n from a),
c as (select *, row_number() over (order by (2 * r + 1)::double / (2 * n), source) - 1 as position, count(*) over () as total from b)
select doc_id, text, lang, source, n_chars, cast(position * {shards} // total as integer) as shard, cast(position as bigint) as position from c"""
