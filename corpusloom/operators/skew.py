"""Joins and numbering that hold when one key carries a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.sources.shared import materialise

# Largest lookup that may be sent whole to every executor.
BROADCAST_ROWS = 200_000
SALTS = 64


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than it must to decide."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join facts to a lookup table without letting a hot key land in one task.

    The lookup is broadcast when it is counted to be small. Otherwise both sides shuffle, and
    keys of more than a thousandth of the facts, of which there are at most a thousand, and missing
    keys, which find nothing, are spread: their facts over ``salts`` by the columns named in ``spread``, their lookup rows
    repeated once per salt. No other lookup row is repeated.
    """
    if fits(lookup, rows):
        return facts.join(F.broadcast(lookup), list(on), how)
    share = facts.count() / 1000
    hot = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > share)
    hot = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
    dealt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    missing = reduce(or_, [F.col(c).isNull() for c in on])
    salted = facts.join(hot, list(on), "left").withColumn(
        "_salt", F.when(F.col("_hot") | missing, dealt).otherwise(0)
    )
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    copies = lookup.join(hot, list(on), "left").withColumn("_salt", F.explode(every))
    return salted.drop("_hot").join(copies.drop("_hot"), [*on, "_salt"], how).drop("_salt")


def frequent_lookup_join(
    facts: DataFrame, lookup: DataFrame, key: str, rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Left-join a lookup of one row per key onto stored facts, of which only the rare keys move.

    A small lookup is broadcast. Otherwise what is known of the most frequent keys, at most ``rows`` of
    them, is broadcast, and their facts and those without a key stay where they are; the others, none
    of which is frequent, meet the lookup in a shuffle. The facts are read twice and should be stored.
    """
    if fits(lookup, rows):
        return facts.join(F.broadcast(lookup), key, "left")
    values = [c for c in lookup.columns if c != key]
    counts = materialise(
        facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("df")), "counts"
    )
    frequent = counts.filter(F.col("df") >= _least_frequency(counts, rows)).select(key)
    known = lookup.select(key, F.struct(*values).alias("_found"))
    hot = frequent.join(known, key, "left").select(key, F.struct("_found").alias("_hot"))
    tagged = facts.join(F.broadcast(hot), key, "left")
    stays = F.col("_hot").isNotNull() | F.col(key).isNull()
    near = tagged.filter(stays).select(
        *facts.columns, *[F.col(f"_hot._found.{v}").alias(v) for v in values]
    )
    far = tagged.filter(~stays).select(*facts.columns).join(lookup, key, "left")
    return near.unionByName(far.select(*facts.columns, *values))


def join_term_stats(
    postings: DataFrame, stats: DataFrame, total: Column, term: str = "term",
    share: float = 1e-5, rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left-join per-term statistics (with a ``df`` column) onto postings.

    The most frequent terms, at most ``rows`` of them and found in at least ``share`` of the documents,
    hold most of the postings. Their statistics are broadcast, and their postings stay where they are. The postings of the others, none of which is
    frequent, meet their statistics in a shuffle. The statistics are written once, since they are
    counted before they are sent; the postings are read twice and should be stored.
    """
    values = [c for c in stats.columns if c != term]
    stats = materialise(stats, "term-stats")
    frequent = F.col("df") >= F.greatest(F.lit(_least_frequency(stats, rows)), total * share)
    hot = F.broadcast(stats.filter(frequent).select(term, F.struct(*values).alias("_hot")))
    # hashed into the build side: the postings, by far the longer side, are never sorted
    cold = stats.filter(~frequent).hint("shuffle_hash")
    tagged = postings.join(hot, term, "left")
    near = tagged.filter("_hot is not null").select(
        *postings.columns, *[F.col(f"_hot.{v}").alias(v) for v in values]
    )
    far = tagged.filter("_hot is null").drop("_hot").join(cold, term, "left")
    return near.unionByName(far.select(*postings.columns, *values))


def _least_frequency(stats: DataFrame, rows: int) -> int:
    """The least power of two such that at most ``rows`` terms are at least as frequent."""
    power = F.floor(F.log2("df")).cast("int").alias("power")
    counts = stats.groupBy(power).agg(F.count(F.lit(1)).alias("n")).collect()
    least, held = 63, 0
    for row in sorted(counts, key=lambda r: -r["power"]):
        held += row["n"]
        if held > rows:
            break
        least = row["power"]
    return 1 << least if least < 63 else (1 << 63) - 1


def position_in_group(
    df: DataFrame,
    group: Sequence[str],
    block: Column,
    order: Sequence[Column],
    name: str = "position",
    coarse: Column | None = None,
) -> DataFrame:
    """Exact 1-based position of every row in its group, without sorting a group in one task.

    ``block`` must not decrease along ``order``. Rows are counted per block, the counts become
    offsets, and rows are numbered inside their block only. Where a group may have very many
    blocks, ``coarse`` bundles them (it must not decrease either): offsets are then summed inside
    each bundle and over the few bundles, never over all blocks of a group at once.
    """
    keyed = df.withColumn("_block", block).withColumn(
        "_coarse", F.lit(0) if coarse is None else coarse
    )
    keys = [*group, "_coarse", "_block"]
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(counts, [*group, "_coarse"], "_block")
    if coarse is not None:
        bundles = counts.groupBy(*group, "_coarse").agg(F.sum("_n").alias("_n"))
        above = _offsets(bundles, list(group), "_coarse").withColumnRenamed("_offset", "_above")
        offsets = offsets.join(above, [*group, "_coarse"]).withColumn(
            "_offset", F.col("_offset") + F.col("_above")
        ).drop("_above")
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        keyed.withColumn("_in_block", F.row_number().over(inside))
        .join(offsets, keys)
        .withColumn(name, F.col("_offset") + F.col("_in_block"))
        .select(*df.columns, name)
    )


def _offsets(counts: DataFrame, group: list[str], along: str) -> DataFrame:
    """Rows counted before each step of ``along`` in its group."""
    before = Window.partitionBy(*group).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *group, along, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key by ``order``: a partial aggregate, so a hot key costs nothing."""
    rest = [c for c in df.columns if c not in key and c not in order]
    best = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return best.select(*key, "_row.*").select(*df.columns)


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key and c not in order]
    best = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return best.select(*key, "_row.*").select(*df.columns)
