"""One query for each corpus operator, over its whole table with production parameters, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, flac, html, langid, mixing, neardup, packing, rans, sharding, topk
from .common import table

SEED = 17
SHARDS = 64
WINDOW = 2048
TOP_K = 10
NEAR = 0.5
MARGIN = 0.005
#: Target weights; the other sources share the rest by size.
WEIGHTS = {"src0": 0.12, "src1": 0.10, "src2": 0.20}
MAX_EPOCHS = 4.0


def op1_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave_shards(table(spark, sf_dir, "documents"), SHARDS, SEED)


def op2_rans_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.encode_corpus(table(spark, sf_dir, "documents"))


def op3_flac_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.decode_column(flac.vectors_as_media(table(spark, sf_dir, "embeddings")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "lang", "text"), langid.train_dictionaries(docs, seed=SEED), MARGIN)
    return found.select("doc_id", "lang", "detected", "margin", F.col("detected").isNotNull().alias("kept"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), TOP_K)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), whole=True).drop("html")


def op7_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), WEIGHTS, MAX_EPOCHS, seed=SEED)


def op8_near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents"), NEAR)


def op9_packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(table(spark, sf_dir, "documents"), WINDOW)


def op10_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_interleaved_shards, op2_rans_blocks, op3_flac_blocks, op4_language_id, op5_exact_top_k, op6_main_text, op7_mixed_sources, op8_near_groups, op9_packed_windows, op10_chat_masks, pipeline]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_interleaved_shards": sharding.oracle(SHARDS, SEED),
        "op5_exact_top_k": topk.oracle(TOP_K),
        "op7_mixed_sources": mixing.oracle("select * from documents", WEIGHTS, MAX_EPOCHS, SEED, "doc_id, text, lang, source, n_chars"),
        "op8_near_groups": neardup.oracle(NEAR),
    }
