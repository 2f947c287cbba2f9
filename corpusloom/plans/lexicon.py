"""Word lists standing in for the lexical resources that are input tables elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.operators.tokens import words_only
from corpusloom.sources.shared import materialise

# Common function words per language.
STOP_WORDS = {
    "de": "als am auf aus bei das dem den der des die ein eine er es für im in ist mit nicht "
    "sich und von zu",
    "en": "a an and are as at be but by for from has have in is it not of on or that the this "
    "to was were with",
    "es": "al con de del el en es la las lo los no para por que se su un una y",
    "fr": "au aux avec ce dans de des du elle en est et il la le les par pas pour que qui sur "
    "un une",
}

STOP_SQL = "stop_words(lang, term) AS (VALUES " + ", ".join(
    f"('{lang}', '{word}')" for lang, text in STOP_WORDS.items() for word in text.split()
) + ")"

# A form ending in s belongs to the form without it when that one occurs in the same language.
LEMMA_SQL = (
    "vocab AS (SELECT DISTINCT lang, term FROM tokens)",
    "form_lemma AS (SELECT f.lang, f.term, b.term AS lemma FROM vocab f JOIN vocab b "
    "ON f.lang = b.lang AND f.term = b.term || 's' WHERE length(f.term) >= 4)",
    "lemmas AS (SELECT doc_id, lang, coalesce(lemma, term) AS term FROM tokens "
    "ANTI JOIN stop_words USING (lang, term) LEFT JOIN form_lemma USING (lang, term))",
)


def stop_words(spark: SparkSession) -> DataFrame:
    rows = [(lang, word) for lang, text in STOP_WORDS.items() for word in text.split()]
    return spark.createDataFrame(rows, "lang string, term string")


def form_lemma(docs: DataFrame) -> DataFrame:
    """``(lang, term, lemma)`` derived from the vocabulary, written once and read back."""
    vocab = words_only(docs, "lang").distinct()
    forms = vocab.filter("term like '%s' and length(term) >= 4").select(
        "lang", "term", F.expr("left(term, length(term) - 1)").alias("lemma")
    )
    base = vocab.withColumnRenamed("term", "lemma")
    found = forms.join(base, ["lang", "lemma"]).select("lang", "term", "lemma")
    return materialise(found, "form-lemma")
