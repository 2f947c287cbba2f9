"""From raw documents to packed training sequences, in five stages.

Each stage takes all rows that its predecessor kept and, but for the last, returns the columns of
its input. Between stages tables are written to the shared folder and read again.

Defined results: documents without text have no language and go in the second stage; equal texts and
near copies leave the one of the smallest id; an empty table gives no rows; texts of any length are
read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import language_id, packing, secret_scan, shingle_join, toxicity
from corpusloom.llm.queries import tokenizer_text
from corpusloom.sources.shared import materialise
from corpusloom.sources.tables import read_table

# Word shingles and least similarity, in per cent, of near duplicates.
NEAR_DUPLICATES = shingle_join.Rule(words=5, percent=80)
# Least share of the best language; even a text of two words has more.
LEAST_LANGUAGE_SCORE = 0.3
# Text and units that a packing task holds; its workers have run the other stages before.
PACKING_CHUNK_BYTES, PACKING_KEPT_UNITS = 1 << 20, 150_000

# Models, similarity and packing have no SQL form: the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs, ~F.coalesce(language_id.held_out(), F.lit(True)))
    return language_id.keep_identified(docs, model, LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.keep_first(docs, NEAR_DUPLICATES)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    counted = packing.token_counts(
        docs, tokenizer_text(), chunk_bytes=PACKING_CHUNK_BYTES, kept_units=PACKING_KEPT_UNITS
    )
    return packing.pack(counted)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
