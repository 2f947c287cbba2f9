"""Language profiles, distances to them, identification, and classifier evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.operators.skew import lookup_join, position_in_group
from corpusloom.operators.tokens import letter_frequencies, words_only
from corpusloom.sources.shared import materialise

# Profile length, which is also the penalty of an absent word.
TOP_N = 300


def word_profiles(texts: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """``(lang, term, rank)``: the most frequent words per language, ranks from 0."""
    counts = words_only(texts, "lang").groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
    return (
        counts.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= top_n)
        .select("lang", "term", (F.col("rank") - 1).alias("rank"))
    )


def alphabet_profiles(texts: DataFrame) -> DataFrame:
    """``(lang, letter, freq)``: relative letter frequencies per language."""
    return letter_frequencies(texts, "lang").select("lang", "letter", "freq")


def _sizes(profiles: DataFrame, value: Column) -> Column:
    """All languages with one total each, as a scalar: languages are few."""
    per_lang = profiles.groupBy("lang").agg(value.alias("total"))
    return per_lang.agg(F.sort_array(F.collect_list(F.struct("lang", "total"))).alias("a")).scalar()


def out_of_place_distances(
    docs: DataFrame, profiles: DataFrame, penalty: int = TOP_N
) -> DataFrame:
    """``(doc_id, lang, distance)`` of every document to every profile.

    An absent word costs ``penalty``, so the sum starts at ``penalty`` for the whole profile and
    only the words a document shares with it have to be joined.
    """
    counts = words_only(docs, "doc_id").groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "term")
    ranks = counts.select("doc_id", "term", (F.row_number().over(w) - 1).alias("doc_rank"))
    by_term = profiles.groupBy("term").agg(F.collect_list(F.struct("lang", "rank")).alias("in"))
    # profiles hold at most top_n words per language, but languages may be many
    gains = (
        lookup_join(ranks, by_term, ["term"], ["doc_id"], "inner")
        .select("doc_id", "doc_rank", F.inline("in"))
        .groupBy("doc_id", "lang")
        .agg(F.sum(F.abs(F.col("rank") - F.col("doc_rank")) - penalty).alias("gain"))
    )
    return _complete(docs, _sizes(profiles, F.count(F.lit(1)) * F.lit(penalty)), gains)


def alphabet_distances(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Manhattan distance of letter frequencies over the union of letters."""
    letters = letter_frequencies(docs, "doc_id").select("doc_id", "letter", "freq")
    by_letter = profiles.groupBy("letter").agg(
        F.collect_list(F.struct("lang", F.col("freq").alias("expected"))).alias("in")
    )
    gains = (
        lookup_join(letters, by_letter, ["letter"], ["doc_id"])
        .select("doc_id", "freq", F.inline_outer("in"))
        .groupBy("doc_id", "lang")
        .agg(
            F.sum(
                F.abs(F.col("expected") - F.col("freq")) - F.col("expected") - F.col("freq")
            ).alias("shared"),
            F.sum("freq").alias("mass"),
        )
    )
    # every document with letters has frequencies adding up to 1
    known = gains.filter("lang is not null").select("doc_id", "lang", F.col("shared").alias("gain"))
    masses = gains.groupBy("doc_id").agg(F.lit(1.0).alias("own"))
    base = _complete(docs, _sizes(profiles, F.sum("freq")), known)
    return base.join(masses, "doc_id", "left").select(
        "doc_id", "lang", (F.col("distance") + F.coalesce("own", F.lit(0.0))).alias("distance")
    )


def _complete(docs: DataFrame, sizes: Column, gains: DataFrame) -> DataFrame:
    every = docs.select("doc_id", F.inline(sizes))
    return every.join(gains, ["doc_id", "lang"], "left").select(
        "doc_id",
        "lang",
        (F.col("total") + F.coalesce("gain", F.lit(0))).cast("double").alias("distance"),
    )


def identify(distances: DataFrame) -> DataFrame:
    """The nearest language of each document (ties by name) and all its distances.

    Needs at least two profiles.
    """
    rounded = distances.withColumn("distance", F.round("distance", 6))
    nearest = rounded.groupBy("doc_id").agg(
        F.min(F.struct("distance", "lang")).alias("best"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "distance")))).alias(
            "distances"
        ),
    )
    checked = F.when(F.size("distances") >= 2, F.col("best.lang")).otherwise(
        F.raise_error(F.lit("identification needs profiles of at least two languages"))
    )
    return nearest.select(
        "doc_id", checked.alias("predicted"), F.col("best.distance").alias("distance"), "distances"
    )


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def label_scores(confusion: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every label that occurs as actual or predicted."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    as_actual = confusion.groupBy(F.col("actual").alias("label")).agg(
        F.sum("n").alias("actual_n"), F.sum(hit).alias("tp")
    )
    as_predicted = confusion.groupBy(F.col("predicted").alias("label")).agg(
        F.sum("n").alias("predicted_n")
    )
    zero = F.lit(0.0)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.coalesce(a, F.lit(0)), b), zero)
    scored = as_actual.join(as_predicted, "label", "outer").select(
        "label",
        ratio(F.col("tp"), F.col("predicted_n")).alias("precision"),
        ratio(F.col("tp"), F.col("actual_n")).alias("recall"),
    )
    return scored.withColumn(
        "f1",
        F.coalesce(
            F.try_divide(
                2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
            zero,
        ),
    )


def macro_scores(confusion: DataFrame) -> DataFrame:
    return label_scores(confusion).agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """One row for results ``(actual, predicted, elapsed_ms)``: counts, accuracy, macro scores."""
    totals = results.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(
            F.try_divide(
                F.count_if(F.col("actual") == F.col("predicted")), F.count(F.lit(1))
            ),
            F.lit(0.0),
        ).alias("accuracy"),
        F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)).alias("mean_elapsed_ms"),
    )
    macro = macro_scores(confusion_matrix(results)).agg(F.first(F.struct("*")).alias("m")).scalar()
    return totals.withColumn("m", macro).select(
        "documents",
        "accuracy",
        *[F.coalesce(f"m.{c}", F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
        "mean_elapsed_ms",
    )


def stratified_split(docs: DataFrame, test_ratio: float, seed: int = 0) -> DataFrame:
    """Assign ``split`` to documents without one so that each language reaches its test share.

    The target is ``clamp(half-even round(total * ratio), 1, total - 1)`` and counts documents
    already assigned; languages with fewer than two documents go to training. Instead of a
    shuffle, documents are taken in md5 order: only ids and languages are numbered, block by
    block, to find the last mark to take per language. The documents themselves never move.
    """
    if not 0 < test_ratio < 1:
        raise ValueError("test_ratio must be between 0 and 1")
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id")))
    totals = docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("split") == "test").alias("has_test"),
        F.count_if(F.col("split").isNull()).alias("fresh"),
    )
    target = F.greatest(
        F.lit(1),
        F.least(
            F.bround(F.col("total").cast("double") * test_ratio).cast("bigint"),
            F.col("total") - 1,
        ),
    )
    missing = F.least(F.greatest(F.lit(0), target - F.col("has_test")), F.col("fresh"))
    need = totals.select("lang", F.when(F.col("total") < 2, F.lit(0)).otherwise(missing).alias("need"))
    marks = docs.filter("split is null").select("lang", mark.alias("_mark"))
    numbered = position_in_group(
        marks, ["lang"], F.substring("_mark", 1, 3), [F.col("_mark")], "_at"
    )
    # both tables hold a row per language
    need = materialise(need, "split-needs")
    last = lookup_join(numbered, need, ["lang"], ["_mark"], "inner").filter("_at = need")
    limits = materialise(last.select("lang", F.col("_mark").alias("_last")), "split-marks")
    placed = lookup_join(docs, limits, ["lang"], ["doc_id"])
    fresh = F.when(mark <= F.col("_last"), F.lit("test")).otherwise(F.lit("train"))
    return placed.withColumn("split", F.coalesce("split", fresh)).select(docs.columns)


def split_counts(docs: DataFrame) -> DataFrame:
    """Documents per language and split, wide, with the labelled share of each language."""
    return docs.groupBy("lang").agg(
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "test").alias("test"),
        F.count_if(F.col("split").isNull()).alias("unassigned"),
    )


def label_progress(docs: DataFrame) -> DataFrame:
    """Confirmed and open documents per language."""
    return docs.groupBy("lang").agg(
        F.count("confirmed").alias("confirmed"),
        F.count_if(F.col("confirmed").isNull()).alias("unlabelled"),
    )


def selection(docs: DataFrame, which: str) -> DataFrame:
    """Training, test or unlabelled documents."""
    rules = {
        "training": "confirmed is not null and split = 'train'",
        "test": "confirmed is not null and split = 'test'",
        "unlabelled": "confirmed is null",
    }
    return docs.filter(rules[which])


def newest_per_method(runs: DataFrame) -> DataFrame:
    """The newest completed run of each method; methods without one are left out."""
    return (
        runs.filter("status = 'completed'")
        .groupBy("method")
        .agg(F.max("run_id").alias("run_id"))
    )


# Identification by method name: (documents, profiles) -> distances
METHODS = {"frequent_words": out_of_place_distances, "alphabetic": alphabet_distances}
