"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, seeded_unit


def water_fill(sizes: Mapping[str, float], weights: Mapping[str, float], budget: float, max_epochs: float) -> dict[str, float]:
    """Epochs of each source: shares of the budget in proportion to weight, none above max_epochs times its size.

    Sources whose share is above their cap are clamped to it; what is left of the budget goes to the others in proportion
    to weight, again and again until no share is above its cap. If all are clamped the budget isn't used up.
    """
    caps = {s: max_epochs * n for s, n in sizes.items() if n > 0 and weights.get(s, 0) > 0}
    free, left, share = set(caps), budget, {}
    while free:
        total = sum(weights[s] for s in sorted(free))
        over = {s for s in free if left * weights[s] / total > caps[s]}
        if not over:
            share |= {s: left * weights[s] / total for s in free}
            break
        for s in sorted(over):
            share[s] = caps[s]
            left -= caps[s]
        free -= over
    return {s: share.get(s, 0.0) / n if n > 0 else 0.0 for s, n in sizes.items()}


def mix_sources(
    docs: DataFrame, weights: Mapping[str | None, float], max_epochs: float = 4.0, budget: float | None = None, seed: int = 0,
    source: str = "source", key: str = "doc_id", size: str = "n_chars", text: str = "text",
) -> DataFrame:
    """Repeats or samples the rows of each source so that their sizes come near the target weights; adds `copy`.

    weights: target weight by source. Sources that it doesn't name share what it leaves of 1 in proportion to their size;
    if it leaves nothing, or if a weight is 0, such a source gets nothing. budget: the size of the whole result; by
    default the size of docs. max_epochs: no source is repeated more than this many times; what it can't fill goes to the
    others (water_fill). A source that gets e epochs has each row floor(e) times (copy 0, 1, ...), and once more where a
    seeded hash of `key` is below the fraction of e: the draw is the same however rows are ordered or partitioned.

    A null source is a source of its own, named None in weights, and another than ''. Size is `size`, or the length of `text` if that is null or
    docs has no such column; below 0 counts as 0. A source of total size 0 has nothing to weigh and stays as it is (one
    copy). Rows with a null key, and repeated keys, are drawn together; null, empty and very long texts are like others. No
    rows: no rows. Other columns stay as they are. If docs has a column `copy`, the
    new one is `_copy`.

    How it runs: one aggregation by source over two narrow columns (one row for each source reaches the driver); then one
    pass over the rows without a shuffle.
    """
    label = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))
    weights = {"" if s is None else f"s{s}": w for s, w in weights.items()}
    measure = F.length(text) if size not in docs.columns else F.coalesce(F.col(size), F.length(text))
    sums = docs.groupBy(label.alias("s")).agg(F.sum(F.greatest(F.coalesce(measure, F.lit(0)), F.lit(0))).cast("double").alias("n"))
    sizes = {r.s: r.n for r in sums.collect()}
    epochs = water_fill(sizes, target(sizes, weights), sum(sizes.values()) if budget is None else budget, max_epochs)
    copy = fresh(docs, "copy")
    if not sizes:
        return docs.withColumn(copy, F.lit(0))
    plan = {s: (1.0 if sizes[s] <= 0 else e) for s, e in epochs.items()}
    got = F.create_map(*[F.lit(x) for s in sorted(plan) for x in (s, plan[s])])[label]
    times = F.floor(got) + (seeded_unit(seed, F.col(key)) < got - F.floor(got)).cast("long")
    n = fresh(docs, "__times")
    return docs.withColumn(n, times).filter(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))).drop(n)


def target(sizes: Mapping[str, float], weights: Mapping[str, float]) -> dict[str, float]:
    """Weights of all sources: those named, and the rest of 1 shared among the others by size."""
    others = {s: n for s, n in sizes.items() if s not in weights}
    rest = max(0.0, 1.0 - float(sum(Fraction(str(w)) for s, w in weights.items() if s in sizes)))
    total = sum(others.values())
    return {s: weights[s] if s in weights else (rest * sizes[s] / total if total else 0.0) for s in sizes}


def oracle(docs: str, weights: Mapping[str, float], max_epochs: float, seed: int, columns: str) -> str:
    """The same in SQL. Clamped sources are those with the least cap for their weight; level is what the others get for weight 1."""
    named = ", ".join(f"('{s}', {w}::double)" for s, w in sorted(weights.items()))
    return f"""
with docs as ({docs}), named(s, w) as (values {named}),
sized as (select source as s, sum(greatest(n_chars, 0))::double as n from docs group by 1),
whole as (select sum(n) as budget from sized),
rest as (select 1 - coalesce(sum(w), 0) as w from named join sized using (s)),
weighed as (select s, n, coalesce(named.w, greatest((select w from rest), 0) * n / sum(n) filter (where named.w is null) over ()) as w from sized left join named using (s)),
ordered as (select *, {max_epochs} * n as cap, row_number() over (order by {max_epochs} * n / w, s) as k from weighed where w > 0 and n > 0),
levels as (select *, (budget - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by k rows between current row and unbounded following) as level from ordered, whole),
chosen as (select min(k) as k from levels where level * w <= cap),
shares as (select s, case when k < coalesce((select k from chosen), 1e18) then {max_epochs} else (select level from levels join chosen using (k)) * w / n end as e from levels),
drawn as (select d.*, e, floor(e) + (case when ('0x' || substr(md5(concat('{seed}', '|', cast(doc_id as varchar))), 1, 13))::bigint / 4503599627370496.0 < e - floor(e) then 1 else 0 end) as times from docs d join shares on d.source = shares.s)
select {columns}, cast(unnest(range(cast(times as bigint))) as integer) as copy from drawn where times > 0"""
