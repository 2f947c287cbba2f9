"""Ranks per query: top k by a pruned window, full rankings by counted ranges of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.operators.skew import fits
from corpusloom.sources.shared import materialise

# Bounds of the result size.
DEFAULT_TOP_K, MAX_TOP_K = 10, 100


def score6(score: Column) -> Column:
    return F.round(score, 6)


def top_k(scores: DataFrame, k: int = DEFAULT_TOP_K, group: str = "query_id") -> DataFrame:
    """The best ``k`` documents per query, ranks from 1, ties by document id.

    Spark prunes each input partition to ``k`` rows per query before the shuffle.
    """
    if not 1 <= k <= MAX_TOP_K:
        raise ValueError(f"k must be between 1 and {MAX_TOP_K}")
    w = Window.partitionBy(group).orderBy(F.desc("score"), "doc_id")
    return (
        scores.withColumn("score", score6(F.col("score")))
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
    )


def full_ranking(
    scores: DataFrame, group: str = "query_id", rows_per_block: int = 1 << 20
) -> DataFrame:
    """Every document of every query with its exact rank, whatever a query matches.

    Rows are sorted in ranges of about ``rows_per_block`` rows by query, rounded score and document,
    so a query's rows, and even one tied score, are split over tasks. They are moved once: a row's id
    holds its range and its place in it, and the ranks follow from the rows of a query in each range.
    The scores are written first, since they are counted and then sorted.
    """
    rounded = materialise(scores.withColumn("score", score6(F.col("score"))), "scores")
    cores = rounded.sparkSession.sparkContext.defaultParallelism
    ranges = max(-(-rounded.count() // rows_per_block), cores)
    order = [F.col(group), F.desc("score"), F.col("doc_id")]
    placed = materialise(
        rounded.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id()),
        "placed",
    )
    number = F.shiftright("_id", 33).alias("_range")
    here = placed.groupBy(group, number).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")
    )
    w = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(w), F.lit(0))
    shifts = materialise(
        here.select(group, "_range", (before - F.col("_first") + 1).alias("_shift")), "shifts"
    )
    shifts = F.broadcast(shifts) if fits(shifts) else shifts
    return (
        placed.withColumn("_range", number)
        .join(shifts, [group, "_range"])
        .withColumn("rank", (F.col("_id") + F.col("_shift")).cast("int"))
        .select(*scores.columns, "rank")
    )
