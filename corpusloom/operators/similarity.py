"""Sparse vector similarity over long-form ``(id, term, weight)`` tables."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpusloom.operators import weighting as wt
from corpusloom.operators.skew import fits, lookup_join

# Most rows of query vectors that may be sent whole to every executor.
QUERY_ROWS = 500_000
# Stored postings for each place of documents, and rows of a batch of results.
HELD_POSTINGS, BATCH_ROWS = 2_000_000, 200_000


def _join_on_term(queries: DataFrame, docs: DataFrame, rows: int = QUERY_ROWS) -> DataFrame:
    """Meet query and document weights on the term.

    With few query terms the document table is not moved at all. Otherwise both sides shuffle on
    the term, and only terms of very many documents are spread.
    """
    return lookup_join(docs, queries, ["term"], ["doc_id"], "inner", rows=rows)


def dot_products(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``(query_id, doc_id, dot, shared)`` for every pair that shares a term."""
    q = queries.select("query_id", "term", F.col("weight").alias("q_weight"))
    pairs = _join_on_term(q, docs.select("doc_id", "term", "weight"))
    return pairs.groupBy("query_id", "doc_id").agg(
        F.sum(F.col("weight") * F.col("q_weight")).alias("dot"),
        F.count(F.lit(1)).alias("shared"),
    )


def norms(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.groupBy(key).agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")
    )


def block_products(
    queries: DataFrame, docs: DataFrame, k: int | None = None, held: int = HELD_POSTINGS
) -> DataFrame:
    """``(query_id, doc_id, dot)`` for every pair that shares a term; pairs are never shuffled.

    Documents are dealt to places of about ``held`` postings, of which those with a query's term are
    kept; every query visits every place. A task holds the postings of one place by term and sums a
    query's products over them. With ``k``, a place passes on its ``k`` best documents per query by
    the product in six decimals and the smaller id, among which are all of the final ones.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    n = docs.count()
    places = max(-(-n // held), min(cores, -(-n // 50_000)), 1)
    packed = F.collect_list(F.struct("term", "weight")).alias("p")
    lists = (F.col("p.term").alias("terms"), F.col("p.weight").alias("weights"))
    asked = queries.select("term").distinct()
    held_rows = (
        docs.select("doc_id", "term", "weight")
        .join(F.broadcast(asked) if fits(asked) else asked, "term", "left_semi")
        .groupBy("doc_id").agg(packed)
        .select(F.pmod(F.xxhash64("doc_id"), F.lit(places)).cast("int").alias("place"),
                F.lit(0).alias("role"), F.col("doc_id").cast("long").alias("id"), *lists)
    )
    query_rows = (
        queries.select("query_id", "term", "weight").groupBy("query_id").agg(packed)
        .select(F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("place"),
                F.lit(1).alias("role"), F.col("query_id").cast("long").alias("id"), *lists)
    )
    ordered = (
        held_rows.unionByName(query_rows)
        .repartition(places, "place")
        .sortWithinPartitions("place", "role", "id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, ready = None, [], None
        for batch in batches:
            place, role = np.asarray(batch.column("place")), np.asarray(batch.column("role"))
            change = (place[1:] != place[:-1]) | (role[1:] != role[:-1])
            bounds = np.flatnonzero(np.concatenate([[True], change, [True]]))
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if low == high:
                    continue
                if place[low] != here:
                    here, parts, ready = place[low], [], None
                part = batch.slice(low, high - low)
                if role[low] == 0:
                    parts.append(_unrolled(part))
                elif parts:
                    ready = ready or _by_term(parts)
                    yield from _products(*_unrolled(part), *ready, k)

    return ordered.mapInArrow(run, "query_id bigint, doc_id bigint, dot double")


def _unrolled(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Ids, numbers of terms, terms and weights of rows."""
    terms, weights = part.column("terms"), part.column("weights")
    sizes = np.asarray(pc.list_value_length(terms))
    return np.asarray(part.column("id")), sizes, terms.flatten(), np.asarray(weights.flatten())


def _by_term(parts: list) -> tuple:
    """Ids of documents, distinct terms, where the postings of each begin, and the postings."""
    ids, sizes, _, weights = (
        np.concatenate([p[i] for p in parts]) if i != 2 else None for i in range(4)
    )
    coded = pa.concat_arrays([p[2] for p in parts]).dictionary_encode()
    codes = np.asarray(coded.indices)
    order = np.argsort(codes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))])
    owners = np.repeat(np.arange(len(ids)), sizes)
    return ids, coded.dictionary, starts, owners[order], weights[order]


def _products(
    query_ids, sizes, terms, query_weights, doc_ids, vocabulary, starts, owners, weights, k
) -> Iterator[pa.RecordBatch]:
    codes = np.asarray(pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1))
    ends = np.cumsum(sizes)
    out, rows = [], 0
    for query, low, high in zip(query_ids.tolist(), (ends - sizes).tolist(), ends.tolist()):
        known = [(c, w) for c, w in zip(codes[low:high], query_weights[low:high]) if c >= 0]
        if not known:
            continue
        at = np.concatenate([owners[starts[c] : starts[c + 1]] for c, _ in known])
        values = np.concatenate([weights[starts[c] : starts[c + 1]] * w for c, w in known])
        dots = np.bincount(at, weights=values, minlength=len(doc_ids))
        met = np.zeros(len(doc_ids), dtype=bool)
        met[at] = True
        found = np.flatnonzero(met)
        if k is not None and k < len(found):
            score = rounded6(dots[found])
            able = np.flatnonzero(score >= np.partition(score, -k)[-k])
            # documents are in ascending order, so a stable sort breaks ties by id
            found = found[able[np.argsort(-score[able], kind="stable")[:k]]]
        out.append((np.full(len(found), query), doc_ids[found], dots[found]))
        rows += len(found)
        if rows >= BATCH_ROWS:
            yield _batch(out)
            out, rows = [], 0
    if out:
        yield _batch(out)


def _batch(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(column)) for column in zip(*out)],
        names=["query_id", "doc_id", "dot"],
    )


def rounded6(values: np.ndarray) -> np.ndarray:
    """Six decimals as ``F.round`` gives them: halves of the decimal form go away from zero."""
    scaled = values * 1e6
    whole = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4).tolist():
        exact = Decimal(repr(float(values[i]))).scaleb(6)
        whole[i] = int(exact.to_integral_value(ROUND_HALF_UP))
    return whole / 1e6


def cosine_similarities(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Cosine of every pair that shares a term; 0 when a norm is 0.

    Both sides are brought to unit length first, so no pair has to meet a norm.
    """
    unit = lambda df, key: wt.normalise(df.select(key, "term", "weight"), key)
    return block_products(unit(queries, "query_id"), unit(docs, "doc_id")).select(
        "query_id", "doc_id", F.col("dot").alias("score")
    )


def manhattan_distances(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sum of absolute differences over the union of keys, for the given ``(left_id, right_id)``.

    Over the union, ``sum|a-b| = sum a + sum b + sum over shared (|a-b| - |a| - |b|)`` in absolute
    values, so only shared terms have to meet in a join.
    """
    a = left.groupBy("left_id").agg(F.sum(F.abs("weight")).alias("a_total"))
    b = right.groupBy("right_id").agg(F.sum(F.abs("weight")).alias("b_total"))
    shared = (
        pairs.join(left.withColumnRenamed("weight", "a"), "left_id")
        .join(right.withColumnRenamed("weight", "b"), ["right_id", "term"])
        .groupBy("left_id", "right_id")
        .agg(F.sum(F.abs(F.col("a") - F.col("b")) - F.abs("a") - F.abs("b")).alias("change"))
    )
    zero = F.lit(0.0)
    return (
        pairs.join(a, "left_id", "left")
        .join(b, "right_id", "left")
        .join(shared, ["left_id", "right_id"], "left")
        .select(
            "left_id",
            "right_id",
            (
                F.coalesce("a_total", zero)
                + F.coalesce("b_total", zero)
                + F.coalesce("change", zero)
            ).alias("distance"),
        )
    )
