"""Tab-separated dictionaries and word-form lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows with exactly the expected number of columns; quotes have no meaning."""
    schema = ", ".join(f"{c} string" for c in columns)
    return (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("quote", "")
        .option("mode", "DROPMALFORMED")
        .option("enforceSchema", True)
        # all columns are read, so that a row of the wrong length is seen whatever is selected
        .option("columnPruning", False)
        .csv(path)
    )


def read_dictionary_tsv(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, ["source_lemma", "pos", "target_text"])


def read_noun_forms(spark: SparkSession, path: str) -> DataFrame:
    rows = _tsv(spark, path, ["word", "gender", "plural"])
    return rows.withColumn("plural", F.nullif("plural", F.lit("")))


def _filled(*columns: str):
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def read_adjective_forms(spark: SparkSession, path: str) -> DataFrame:
    """Missing forms fall back: feminine and plural to the masculine, plural to singular."""
    rows = _tsv(spark, path, ["ms", "fs", "mp", "fp"])
    return rows.select(
        F.col("ms").alias("word"),
        "ms",
        _filled("fs", "ms").alias("fs"),
        _filled("mp", "ms").alias("mp"),
        _filled("fp", "fs", "ms").alias("fp"),
    )


VERB_SLOTS = ["p1s", "p2s", "p3s", "p1p", "p2p", "p3p"]


def read_verb_forms(spark: SparkSession, path: str) -> DataFrame:
    """Missing forms fall back to the infinitive."""
    rows = _tsv(spark, path, ["infinitive", *VERB_SLOTS])
    return rows.select(
        F.col("infinitive").alias("word"), *[_filled(s, "infinitive").alias(s) for s in VERB_SLOTS]
    )
