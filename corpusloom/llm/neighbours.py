"""Approximate nearest neighbours by shifted Hilbert curves.

Each curve projects the vectors on random directions, cuts every direction into cells at shifted
quantiles, and orders the cells along a Hilbert curve. The curve is cut into blocks of equal
numbers of vectors; a query is compared with all vectors of its own block and the two beside it.
Its best finds on all curves are merged and ranked by cosine on the original vectors.

Directions, cells and block bounds are fitted on a bounded sample; every vector is filed. Equal
vectors are filed once with their smallest ids, which is exact: no other copy can be in a result.

Defined results: rows whose id, vector or a component is null, whose vector is zero, not finite
or of another length than most take no part; repeated rows count once; queries without any
candidate give no rows; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.sources.shared import materialise

CURVES = 48
BLOCKS = 160
LEAST_IN_BLOCK = 16
DIRECTIONS = 12
CELL_BITS = 3
SAMPLE = 20_000
# Vectors that a task holds while queries stream past them.
HELD_VECTORS = 20_000
SEED = 20_240_607


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of every row of cell numbers (Skilling 2004)."""
    axes = [column.copy() for column in cells.astype(np.int64).T]
    top = 1 << (bits - 1)
    step = top
    while step > 1:
        low = step - 1
        for i, axis in enumerate(axes):
            beyond = (axis & step) != 0
            swap = np.where(beyond, 0, (axes[0] ^ axis) & low)
            axes[0] ^= np.where(beyond, low, swap)
            if i:
                axis ^= swap
        step >>= 1
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    flip = np.zeros_like(axes[0])
    step = top
    while step > 1:
        flip ^= np.where((axes[-1] & step) != 0, step - 1, 0)
        step >>= 1
    keys = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            keys = keys << 1 | ((axis ^ flip) >> bit & 1)
    return keys


@dataclass
class Index:
    """Directions, cell bounds and block bounds of every curve."""

    directions: list[np.ndarray]
    cells: list[np.ndarray]
    bounds: list[np.ndarray]

    def blocks(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        """Block number of every vector on one curve."""
        keys = _keys(vectors, self.directions[curve], self.cells[curve])
        return np.searchsorted(self.bounds[curve], keys, side="right")


def _keys(vectors: np.ndarray, directions: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    projected = vectors @ directions
    cells = np.stack(
        [np.searchsorted(cuts[d], projected[:, d]) for d in range(projected.shape[1])], axis=1
    )
    return hilbert_keys(cells, CELL_BITS)


def fit(sample: np.ndarray, blocks: int) -> Index:
    """Curves from unit vectors of the sample."""
    rng = np.random.default_rng(SEED)
    width = sample.shape[1]
    index = Index([], [], [])
    for _ in range(CURVES):
        turned, _ = np.linalg.qr(rng.standard_normal((width, width)))
        directions = turned[:, : min(DIRECTIONS, width)]
        projected = sample @ directions
        count = 1 << CELL_BITS
        shift = rng.uniform(-0.5, 0.5, projected.shape[1])
        cuts = np.stack(
            [
                np.quantile(projected[:, d], np.clip((np.arange(1, count) + shift[d]) / count, 0, 1))
                for d in range(projected.shape[1])
            ]
        )
        keys = np.sort(_keys(sample, directions, cuts))
        bounds = keys[(np.arange(1, blocks) * len(keys)) // blocks]
        index.directions.append(directions)
        index.cells.append(cuts)
        index.bounds.append(bounds)
    return index


# How far a cosine from a product of matrices may be from the one of its pair.
_ROUNDING = 1e-11


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that squares neither vanish nor grow beyond all bounds.

    Only exponents change, so cosines of ordinary vectors stay the same to the last bit.
    """
    largest = np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    return np.ldexp(vectors, -np.frexp(largest)[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(vector_column).alias("v"),
    ).filter(
        F.col("vec_id").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("v").alias("length")).count()
    most = lengths.orderBy(F.desc("count"), "length").first()
    return rows.filter(F.size("v") == (most["length"] if most else 0))


def nearest(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    # one row per different vector; of its copies the k + 1 smallest ids can be in a result
    kept = Window.partitionBy("v").orderBy("vec_id")
    members = (
        rows.distinct()
        .withColumn("r", F.row_number().over(kept))
        .filter(F.col("r") <= k + 1)
    )
    groups = members.groupBy("v").agg(
        F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("ids")
    )
    asked = rows.filter(F.col("vec_id") % every == 0).select("v").distinct()
    filed = materialise(
        groups.join(asked.withColumn("asked", F.lit(True)), "v", "left").select(
            "id", "ids", "v", F.coalesce("asked", F.lit(False)).alias("asked")
        ),
        "vectors",
    )
    total = filed.count()
    sample = np.array(
        [r["v"] for r in filed.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()],
        float,
    )
    if not len(sample):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    blocks = max(1, min(BLOCKS, total // LEAST_IN_BLOCK))
    salts = -(-total // (blocks * HELD_VECTORS))
    index = spark.sparkContext.broadcast(fit(_unit(sample), blocks))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every vector to its block on each curve, every query to three blocks."""
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, asked = np.asarray(part.column("id")), np.asarray(part.column("asked"))
                raw = _matrix(part.column("v"))
                unit = _unit(raw)
                data = [v.tobytes() for v in raw]
                salt = ids % salts
                place, role, who = [], [], []
                for curve in range(CURVES):
                    block = index.value.blocks(unit, curve)
                    place.append((curve * blocks + block) * salts + salt)
                    role.append(np.zeros(len(ids), np.int32))
                    who.append(np.arange(len(ids)))
                    found = np.flatnonzero(asked)
                    for near in (-1, 0, 1):
                        beside = block[found] + near
                        inside = (beside >= 0) & (beside < blocks)
                        for s in range(salts):
                            spot = (curve * blocks + beside[inside]) * salts + s
                            place.append(spot)
                            role.append(np.ones(len(spot), np.int32))
                            who.append(found[inside])
                who = np.concatenate(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(place).astype(np.int64)),
                     pa.array(np.concatenate(role)), pa.array(ids[who]),
                     pa.array([data[i] for i in who.tolist()], pa.binary())],
                    names=["place", "role", "id", "data"],
                )

    spread = (
        filed.select("id", "v", "asked")
        .mapInArrow(file, "place bigint, role int, id bigint, data binary")
        .repartition("place")
        .sortWithinPartitions("place", "role", "id")
    )
    limit = k + 1  # a query may find itself
    found = spread.mapInArrow(
        lambda batches: _compare(batches, limit), "query bigint, found bigint, score double"
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    merged = (
        found.withColumn("r", F.dense_rank().over(best))
        .filter(F.col("r") <= limit)
        .select("query", "found", "score")
        .distinct()
    )
    # back to the ids of all copies
    names = filed.select(F.col("id").alias("found"), "ids")
    listed = merged.join(names, "found").select(
        F.col("query").alias("id"), "score", F.explode("ids").alias("vec_id")
    )
    reps = filed.filter("asked").select("id", "v")
    queries = rows.filter(F.col("vec_id") % every == 0).distinct().join(reps, "v")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.select(F.col("vec_id").alias("query_id"), "id")
        .distinct()
        .join(listed, "id")
        .filter("query_id != vec_id")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1).astype(float)


def _compare(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Within a place vectors come first and are held; queries stream past them."""
    place, held_ids, held = None, [], []
    matrix = ids = norms = None
    for batch in batches:
        places, roles = np.asarray(batch.column("place")), np.asarray(batch.column("role"))
        bounds = np.flatnonzero(
            np.concatenate([[True], (places[1:] != places[:-1]) | (roles[1:] != roles[:-1]), [True]])
        )
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if places[low] != place:
                place, held_ids, held, matrix = places[low], [], [], None
            part = batch.slice(low, high - low)
            rows = np.frombuffer(b"".join(part.column("data").to_pylist())).reshape(high - low, -1)
            rows = _scaled(rows)
            if roles[low] == 0:
                held.append(rows)
                held_ids.append(np.asarray(part.column("id")))
                matrix = None
                continue
            if not held:
                continue
            if matrix is None:
                matrix, ids = np.concatenate(held), np.concatenate(held_ids)
                norms = np.sqrt((matrix * matrix).sum(axis=1))
            yield _best(rows, np.asarray(part.column("id")), matrix, ids, norms, limit)


def _best(queries, query_ids, matrix, ids, norms, limit) -> pa.RecordBatch:
    lengths = np.sqrt((queries * queries).sum(axis=1))
    out = [[], [], []]
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        rough = (part @ matrix.T) / norms
        # all that the rounding of the products leaves open, ties among them, are scored pair by
        # pair, so that no block size shows
        take = min(limit, len(ids))
        least = -np.partition(-rough, take - 1, axis=1)[:, take - 1]
        for i in range(len(part)):
            rows = np.flatnonzero(rough[i] >= least[i] - _ROUNDING * lengths[at + i])
            score = (matrix[rows] * part[i]).sum(axis=1) / (norms[rows] * lengths[at + i])
            order = np.lexsort((ids[rows], -score))[:limit]
            out[0].append(np.full(len(order), query_ids[at + i]))
            out[1].append(ids[rows][order])
            out[2].append(score[order])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c)) for c in out], names=["query", "found", "score"]
    )
