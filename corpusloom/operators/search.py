"""Sparse and dense search, hits, and the bookkeeping of queries and runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import text as T
from corpusloom.operators import similarity, weighting
from corpusloom.operators.ranking import DEFAULT_TOP_K, full_ranking, top_k
from corpusloom.operators.skew import first_per_key, fits, last_per_key, lookup_join

# Most products (queries x chunk vectors) computed at once, and chunk vectors held by a task.
MATRIX_CELLS = 4_000_000
HELD_VECTORS = 20_000


def query_vectors(query_tokens: DataFrame, dfs: DataFrame, total) -> DataFrame:
    """TF-IDF vectors of queries over the known vocabulary with live statistics.

    Terms in every document weigh 0 and drop out. When the terms of the queries are counted to be
    few, they thin out the postings before these are counted.
    """
    tf = weighting.term_frequencies(query_tokens, "query_id")
    asked = _few(tf.select("term").distinct())
    idfs = weighting.inverse_document_frequencies(dfs.join(asked, "term", "left_semi"), total)
    # a term of all queries would meet in one task
    raw = lookup_join(tf, idfs, ["term"], ["query_id"], "inner").select(
        "query_id", "term", (F.col("tf") * F.col("idf")).alias("weight")
    )
    return weighting.normalise(raw, "query_id").filter(F.col("weight") != 0)


def tfidf_search(vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score)`` for documents sharing a weighted term with the query."""
    dots = similarity.dot_products(vectors, weights)
    return dots.select("query_id", "doc_id", F.col("dot").alias("score"))


def tfidf_scores(vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """``tfidf_search`` by places of documents: no pair is shuffled, or kept in a hash table."""
    pairs = similarity.block_products(vectors, weights)
    return pairs.select("query_id", "doc_id", F.col("dot").alias("score"))


def tfidf_best(vectors: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """``tfidf_search`` cut down, place by place, to documents that can be among the ``k`` best."""
    best = similarity.block_products(vectors, weights, k)
    return best.select("query_id", "doc_id", F.col("dot").alias("score"))


def rank_candidates(vectors: DataFrame, docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cosine for every candidate pair, zeros included.

    Documents keep the weights of terms that some query has, meet their candidates, and then the
    weights of those queries, so no pair that was not asked for is ever scored.
    """
    asked = vectors.select("query_id", "term", F.col("weight").alias("q_weight"))
    pairs = candidates.select("query_id", "doc_id")
    # the weights stay with their document; those without a query's term go first
    known = docs.select("doc_id", "term", "weight").join(
        _few(asked.select("term").distinct()), "term", "left_semi"
    )
    dots = (
        known.join(pairs, "doc_id")
        .join(_few(asked), ["query_id", "term"])
        .groupBy("query_id", "doc_id")
        .agg(F.sum(F.col("weight") * F.col("q_weight")).alias("dot"))
    )
    own = _few(similarity.norms(vectors, "query_id").withColumnRenamed("norm", "q_norm"))
    size = F.col("q_norm") * F.col("d_norm")
    found = (
        dots.join(similarity.norms(docs, "doc_id").withColumnRenamed("norm", "d_norm"), "doc_id")
        .join(own, "query_id")
        .select("query_id", "doc_id", F.try_divide("dot", size).alias("score"))
    )
    return pairs.join(found, ["query_id", "doc_id"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )


def _few(df: DataFrame) -> DataFrame:
    """The table, broadcast where it is counted to be small."""
    return F.broadcast(df) if fits(df) else df


def dense_scores(
    queries: DataFrame,
    chunk_vectors: DataFrame,
    k: int | None = None,
    cells: int = MATRIX_CELLS,
    held: int = HELD_VECTORS,
) -> DataFrame:
    """``(query_id, doc_id, score)``: the cosine of a document's best chunk, for every pair.

    Chunk vectors are dealt to places of about ``held`` of them, a document's chunks together;
    every query visits every place. A task holds the vectors of a place and multiplies them with
    batches of queries of at most ``cells`` products. With ``k``, a place passes on its ``k`` best
    documents per query, among which are all of the final ones.
    """
    cores = chunk_vectors.sparkSession.sparkContext.defaultParallelism
    n = chunk_vectors.count()
    places = max(-(-n // held), min(cores, -(-n // 1000)), 1)
    as_double = F.col("vector").cast("array<double>").alias("vector")
    docs = chunk_vectors.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(places)).cast("int").alias("place"),
        F.lit(0).alias("role"), F.col("doc_id").cast("long").alias("id"), as_double,
    )
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("place"),
        F.lit(1).alias("role"), F.col("query_id").cast("long").alias("id"), as_double,
    )
    ordered = (
        docs.unionByName(asked)
        .filter("vector is not null")
        .repartition("place")
        .sortWithinPartitions("place", "role", "id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, rows, ready = None, [], [], None
        for batch in batches:
            place, role = np.asarray(batch.column("place")), np.asarray(batch.column("role"))
            change = (place[1:] != place[:-1]) | (role[1:] != role[:-1])
            bounds = np.flatnonzero(np.concatenate([[True], change, [True]]))
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if place[low] != here:
                    here, ids, rows, ready = place[low], [], [], None
                names, matrix = np.asarray(part.column("id")), _unit_rows(part.column("vector"))
                if role[low] == 0:
                    ids.append(names)
                    rows.append(matrix)
                elif ids:
                    # ids come sorted, so a document's chunks stand next to each other
                    ready = ready or (np.concatenate(ids), np.concatenate(rows))
                    step = max(1, cells // len(ready[0]))
                    for at in range(0, len(names), step):
                        yield _best_chunks(names[at : at + step], matrix[at : at + step], *ready, k)

    return ordered.mapInArrow(run, "query_id bigint, doc_id bigint, score double")


def _unit_rows(column: pa.Array) -> np.ndarray:
    matrix = np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _best_chunks(query_ids, queries, doc_ids, chunks, k: int | None) -> pa.RecordBatch:
    starts = np.flatnonzero(np.concatenate([[True], doc_ids[1:] != doc_ids[:-1]]))
    score = np.maximum.reduceat(np.round(queries @ chunks.T, 6), starts, axis=1)
    docs = np.broadcast_to(doc_ids[starts], score.shape)
    if k is not None and k < score.shape[1]:
        # documents are in ascending order, so a stable sort breaks ties by id
        keep = np.argsort(-score, axis=1, kind="stable")[:, :k]
        docs, score = np.take_along_axis(docs, keep, 1), np.take_along_axis(score, keep, 1)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(query_ids, score.shape[1])), pa.array(docs.ravel()),
         pa.array(score.ravel())],
        names=["query_id", "doc_id", "score"],
    )


def dense_search(
    queries: DataFrame, chunk_vectors: DataFrame, k: int, cells: int = MATRIX_CELLS
) -> DataFrame:
    """Exact top ``k`` documents per query by the cosine of their best chunk."""
    return top_k(dense_scores(queries, chunk_vectors, k, cells), k)


def first_chunk_vectors(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vector of each document's first chunk; null where it is missing."""
    first = vectors.filter(F.col("chunk_index") == 0).select("doc_id", "vector")
    return docs.select("doc_id").join(first, "doc_id", "left")


def missing_vectors(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents without a first-chunk vector."""
    first = vectors.filter(F.col("chunk_index") == 0).select("doc_id")
    return docs.select("doc_id").join(first, "doc_id", "left_anti")


def require_first_chunk_vectors(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``first_chunk_vectors``, or an error that tells how many are missing."""
    missing = missing_vectors(docs, vectors).count()
    if missing:
        raise ValueError(f"{missing} documents have no vector for their first chunk")
    return first_chunk_vectors(docs, vectors)


def matched_terms(hits: DataFrame, query_terms: DataFrame, weights: DataFrame) -> DataFrame:
    """Sorted query terms present in the stored vector of each hit.

    Hits are few next to the index, which stays where it is when they are counted to be.
    """
    wanted = hits.select("query_id", "doc_id").join(
        query_terms.select("query_id", "term").distinct(), "query_id"
    )
    found = weights.select("doc_id", "term")
    if fits(wanted):
        found = found.join(F.broadcast(wanted), ["doc_id", "term"])
    else:
        # the documents of the hits thin out the index before any term moves
        documents = _few(hits.select("doc_id").distinct())
        found = found.join(documents, "doc_id", "left_semi").join(wanted, ["doc_id", "term"])
    return found.groupBy("query_id", "doc_id").agg(
        F.sort_array(F.collect_set("term")).alias("matched_terms")
    )


def with_snippets(
    hits: DataFrame, docs: DataFrame, matched: DataFrame, queries: DataFrame
) -> DataFrame:
    """Hits with their matched terms, and a snippet around the words of the query as typed."""
    none = F.array().cast("array<string>")
    focus = queries.select("query_id", T.words(F.col("text")).alias("_focus"))
    found = (
        hits.join(matched, ["query_id", "doc_id"], "left")
        .join(focus, "query_id", "left")
        .withColumn("matched_terms", F.coalesce("matched_terms", none))
    )
    # broadcast hits leave the texts where they are
    return (
        docs.select("doc_id", "text")
        .join(_few(found), "doc_id")
        .withColumn("snippet", T.snippet(F.col("text"), F.coalesce("_focus", none)))
        .select(*hits.columns, "matched_terms", "snippet")
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each query and model."""
    return runs.groupBy("query_id", "model").agg(F.max("run_id").alias("run_id"))


def register_queries(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing queries and the new texts, each text once per collection, lowest id kept."""
    fresh = first_per_key(incoming, ["collection", "text"], ["query_id"]).join(
        existing, ["collection", "text"], "left_anti"
    )
    return existing.unionByName(fresh)


def upsert_judgments(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Later judgments win; ``seq`` orders them."""
    return last_per_key(existing.unionByName(incoming), ["query_id", "doc_id"], ["seq"])


def clear_judgments(existing: DataFrame, cleared: DataFrame) -> DataFrame:
    return existing.join(cleared.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")


@dataclass(frozen=True)
class Model:
    """What a kind of search looks queries up in: term weights, or chunk vectors."""

    kind: str
    index: DataFrame


# Scores by model kind: (queries, index, documents wanted per query or None for all)
BACKENDS: dict[str, Callable[[DataFrame, DataFrame, int | None], DataFrame]] = {
    "tfidf": lambda queries, weights, k: (
        tfidf_scores(queries, weights) if k is None else tfidf_best(queries, weights, k)
    ),
    "dense_embedding": dense_scores,
}


def _backend(model: Model):
    if model.kind not in BACKENDS:
        raise ValueError(f"no search for model kind {model.kind!r}; known: {sorted(BACKENDS)}")
    return BACKENDS[model.kind]


def search(queries: DataFrame, model: Model, k: int = DEFAULT_TOP_K) -> DataFrame:
    """The best ``k`` documents of each query vector by the model."""
    return top_k(_backend(model)(queries, model.index, k), k)


def ranking_of(queries: DataFrame, model: Model) -> DataFrame:
    """The full ranking of each query vector by the model, as a run stores it."""
    return full_ranking(_backend(model)(queries, model.index, None))
