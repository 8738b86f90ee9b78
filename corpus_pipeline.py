"""The corpus pipeline: language identification, near-dedup, mixing, packing. Each stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import langid, mixing, neardup, packing, queries
from loomspan.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the dictionaries tell; `lang` becomes what they say (langid.identify).

    Null and empty texts, texts of a few words, ties and, where no row has a label, all rows go. Null keys and repeated rows are
    judged like others, each by itself; whole texts are read. Columns called detected or margin stay. No rows: no rows.
    """
    found = langid.identify(docs, langid.train_dictionaries(docs, seed=queries.SEED), queries.MARGIN)
    detected = found.columns[-2]
    return found.filter(F.col(detected).isNotNull()).select(*[F.col(detected).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id (neardup.drop_near).

    Texts without words resemble nothing and stay; whole texts are compared. Rows with a null doc_id stay; of rows that
    repeat a doc_id one stays. All columns stay as they are. No rows: no rows.
    """
    return neardup.drop_near(docs, queries.NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers of copies that bring their sources to the target weights (mixing.mix_sources).

    A null source is one of its own. Size is n_chars, or the text's length where that is null; sources of no size stay as
    they are. Rows that repeat a doc_id, or have none, are drawn together. The columns are those of docs. No rows: no rows.
    """
    mixed = mixing.mix_sources(docs, queries.WEIGHTS, queries.MAX_EPOCHS, seed=queries.SEED)
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of token ids and the pieces of documents in them (packing.pack_tokens).

    Null and empty texts are an end-of-text token each; very long texts are cut into full windows. Ties are ordered by
    doc_id, repeated rows and null doc_ids are packed each, other columns are dropped. No rows: no windows.
    """
    return packing.pack_tokens(docs, queries.WINDOW)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Compression sizes, sketches and best-fit decreasing aren't SQL: the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table documents of sf_dir, each to all that the one before kept; the last one's result.

    What each stage does with nulls, ties, repeated rows and empty tables is said there; extra columns are carried along.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
