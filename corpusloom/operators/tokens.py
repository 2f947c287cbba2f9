"""Texts to long-form token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import text as T
from corpusloom.operators.skew import lookup_join


def word_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, pos, term)``: every word of every text with its zero-based position."""
    return docs.select(key, F.posexplode(T.words(F.col(text))).alias("pos", "term"))


def words_only(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``(*keep, term)`` without positions."""
    return docs.select(*keep, F.explode(T.words(F.col(text))).alias("term"))


def lemma_terms(
    tokens: DataFrame,
    stop_words: DataFrame,
    form_lemma: DataFrame,
) -> DataFrame:
    """Drop stop words and replace forms by lower-cased lemmas, per language.

    ``tokens`` carries ``lang`` and ``term``; ``stop_words`` is ``(lang, term)`` and
    ``form_lemma`` is ``(lang, term, lemma)``. An unknown form is its own lemma.
    """
    spread = [c for c in tokens.columns if c not in ("lang", "term")]
    kept = lookup_join(tokens, stop_words, ["lang", "term"], spread, how="left_anti")
    mapped = lookup_join(kept, form_lemma, ["lang", "term"], spread)
    return mapped.withColumn("term", F.lower(F.coalesce("lemma", "term"))).drop("lemma")


def char_ngrams(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5) -> DataFrame:
    return docs.select(key, F.explode(T.char_ngrams(F.col(text), n)).alias("gram"))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(
        key, F.posexplode(T.sentences(F.col(text))).alias("sent", "sentence")
    )


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(
        key, F.posexplode(T.paragraphs(F.col(text))).alias("para", "paragraph")
    )


def sentence_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences with document offset, paragraph offset, and both lengths."""
    from pyspark.sql import Window

    # lists are made before they are unrolled, so that no row carries the text it was cut from
    paras = docs.select(
        key,
        F.length(text).alias("doc_length"),
        T.located_paragraphs(F.col(text)).alias("paragraphs"),
    ).select(key, "doc_length", F.posexplode("paragraphs").alias("para", "p"))
    pieces = paras.select(
        key,
        "doc_length",
        "para",
        F.col("p.start").alias("para_start"),
        F.length("p.text").alias("paragraph_length"),
        # marks before the first sentence belong to none but shift the offsets
        F.length(F.regexp_extract("p.text", r"^[.!?]*", 0)).alias("lead"),
        T.raw_sentences(F.col("p.text")).alias("raws"),
    ).select(
        key, "doc_length", "para", "para_start", "paragraph_length", "lead",
        F.posexplode("raws").alias("piece", "raw"),
    )
    before = Window.partitionBy(key, "para").orderBy("piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = pieces.withColumn(
        "paragraph_start",
        F.col("lead") + F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)),
    ).withColumn("sentence", T.strip(F.col("raw"))).filter("sentence <> ''")
    by_doc = Window.partitionBy(key).orderBy("para", "piece")
    return placed.select(
        key,
        (F.row_number().over(by_doc) - 1).alias("sent"),
        "sentence",
        (F.col("para_start") + F.col("paragraph_start")).alias("doc_start"),
        "paragraph_start",
        "paragraph_length",
        "doc_length",
    )


def chunks(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target: int = T.CHUNK_WORDS,
    overlap: int = T.CHUNK_OVERLAP,
) -> DataFrame:
    return docs.select(
        key, F.posexplode(T.chunks(F.col(text), target, overlap)).alias("chunk_index", "chunk")
    )


def letter_frequencies(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``(*keep, letter, n, freq)``; texts without letters give no rows."""
    counts = docs.select(*keep, F.explode(T.letters(F.col(text))).alias("letter"))
    counts = counts.groupBy(*keep, "letter").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    total = F.sum("n").over(Window.partitionBy(*keep))
    return counts.withColumn("freq", F.col("n") / total)
