"""Language identification by compression against per-language dictionaries."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, seeded_unit, small_batches

#: Bounds of the sample that dictionaries are made of: rows of each language, and bytes of each dictionary.
SAMPLE_ROWS, DICTIONARY_BYTES, PIECE_BYTES = 400, 65536, 4096


def train_dictionaries(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES, seed: int = 0, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Raw-content dictionaries from a seeded sample of at most `rows` labelled rows for each language.

    Rows without label, key or text give nothing. Each sampled text gives an equal part of the `size` bytes, or the whole
    of itself if it is shorter; what short texts leave is dealt out to the longer ones. So the part is at least size / the
    rows really sampled of that language, and grows as they get fewer. It lies at a seeded offset, uniform over the whole
    text, so that common openings don't fill the dictionaries. A language with no usable row has no dictionary.
    """
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    counts = {r[lang]: r["n"] for r in docs.filter(F.col(lang).isNotNull()).groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k in sorted(counts) for x in (k, min(1.0, 2.0 * rows / counts[k]))])[F.col(lang)]
    u, lowered = seeded_unit(seed, F.col(key)), F.lower(F.col(text))
    drawn = usable.filter((u < share) & F.col(text).rlike(r"\S")).select(F.col(lang).alias("l"), u.alias("u"), lowered.alias("t"), F.char_length(lowered).alias("chars"), F.octet_length(lowered).alias("bytes"), seeded_unit(f"{seed}|offset", F.col(key)).alias("v"))
    found = drawn.select("l", "u", "bytes").collect()
    most, last = {}, {}
    for name in sorted(counts):
        taken = sorted((r.u, r.bytes) for r in found if r.l == name)[:rows]
        if taken:
            most[name], last[name] = _equal_part([n for _, n in taken], size), taken[-1][0]
    if not most:
        return {}
    each, upto = (F.create_map(*[F.lit(x) for k in most for x in (k, of[k])])[F.col("l")] for of in (most, last))
    part = F.least(F.col("chars"), F.ceil(each.cast("double") * F.col("chars") / F.col("bytes")).cast("int"))  # in characters
    start = (F.floor(F.col("v") * (F.col("chars") - part + 1)) + 1).cast("int")
    sample = drawn.filter(F.col("u") <= upto).select("l", "u", F.substring("t", start, part).alias("t")).collect()
    made = {}
    for name in most:
        texts = [r.t for r in sorted((r for r in sample if r.l == name), key=lambda r: (r.u, r.t))[:rows]]
        made[name] = b"\n".join(t.encode()[: most[name]] for t in texts)[:size]
    return made


def _equal_part(sizes: list[int], total: int) -> int:
    """The part p for which the sum of min(size, p) comes up to `total`; the largest size if all fit."""
    sizes = sorted(sizes)
    for i, n in enumerate(sizes):
        if n * (len(sizes) - i) >= total:
            return max(1, total // (len(sizes) - i))
        total -= n
    return max(1, sizes[-1])


def identify(docs: DataFrame, dictionaries: Mapping[str, bytes], margin: float = 0.005, level: int = 5, piece: int = PIECE_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(all columns of docs, detected, margin): the language whose dictionary makes the text smallest.

    The whole lower-cased text is compressed in pieces of `piece` bytes, so that in a long text too the dictionary, not
    the text itself, is what it is compared with; sizes are summed over the pieces. margin = (second - least) / second.
    `detected` is null (rejected) if margin is below the parameter: so for null and empty texts, ties, and anything that
    no dictionary tells apart, and for everything if there is no dictionary. With one dictionary the second size is that
    without any. Null keys and repeated rows are judged like others, each by itself. No rows: no rows. Columns of docs
    called `detected` or `margin` stay, and the new ones get a leading underscore. Map-only.
    """
    names = sorted(dictionaries)
    held = docs.sparkSession.sparkContext.broadcast([dictionaries[n] for n in names])

    def classify(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = [_compressor(d, level) for d in held.value]
        if len(made) == 1:
            made.append(_compressor(b"", level))
        for column in texts:
            best, gap = [], []
            for t in column.cast(pa.binary()):
                data = t.as_py() or b""
                cuts = [data[i : i + piece] for i in range(0, len(data), piece)]
                sizes = [sum(len(c.compress(x)) for x in cuts) for c in made]
                order = np.argsort(sizes, kind="stable")
                low, second = sizes[order[0]], sizes[order[1]]
                m = (second - low) / second if second else 0.0
                keep = m >= margin and bool(data) and order[0] < len(names)
                best.append(names[order[0]] if keep else None)
                gap.append(m)
            yield pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(gap, pa.float64())], ["detected", "margin"])

    found = F.arrow_udf(classify, "struct<detected:string,margin:double>").asNondeterministic()  # a filter on it mustn't run it again
    got, detected, gap = fresh(docs, "__got"), fresh(docs, "detected"), fresh(docs, "margin")
    none = F.struct(F.lit(None).cast("string").alias("detected"), F.lit(0.0).alias("margin"))
    scored = small_batches(docs).withColumn(got, found(F.lower(F.col(text))) if names else none)
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(got)["detected"].alias(detected), F.col(got)["margin"].alias(gap))


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(level=level, **options)
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=d, **options)
