"""SimHash fingerprints, and all pairs of fingerprints within a Hamming radius.

Terms are runs of three words (a shorter text is one term). Each term votes on every bit of its
text's fingerprint with the sign of the bit in the term's hash and the weight of its letters.

Defined results: a null or empty text has the fingerprint of no votes (zeros); equal texts have
equal fingerprints; rows without an id come last in the order of documents, repeated ids are
ordered by a hash of their text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.arrow import chunks, distinct_units, ragged

BITS = 128
WORDS = 3
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def fingerprints(texts: pa.Array) -> np.ndarray:
    """A row of ``BITS / 8`` bytes per text."""
    words, index, sizes = distinct_units(
        pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    )
    hashes = pd.util.hash_array(np.array(words, object), categorize=False)
    letters = np.fromiter(map(len, words), np.int64, len(words))
    # the split of an empty text is one empty word; blanks at the ends give empty words too
    keep = letters[index] > 0
    text_of = np.repeat(np.arange(len(sizes)), sizes)[keep]
    index, sizes = index[keep], np.bincount(text_of, minlength=len(sizes))
    word, weight = hashes[index], letters[index]
    starts = np.cumsum(sizes) - sizes
    n_terms = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
    at = ragged(starts, n_terms)
    owner = np.repeat(np.arange(len(sizes)), n_terms)
    term, votes = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    for k, factor in enumerate(_MULTIPLIERS):
        there = at + k < (starts + sizes)[owner]
        place = np.minimum(at + k, max(len(word) - 1, 0))
        if len(at):
            term += np.where(there, _mix(word[place] + np.uint64(k)), np.uint64(k)) * np.uint64(factor)
            votes += np.where(there, weight[place], 0)
    out = np.zeros((len(sizes), BITS // 8), np.uint8)
    lanes = np.stack([_mix(term + np.uint64(i)) for i in range(1, BITS // 64 + 1)], axis=1)
    raw = lanes.astype("<u8").view(np.uint8).reshape(len(at), BITS // 8)
    votes = votes.astype(np.float32)
    ends = np.cumsum(n_terms)
    for i, (end, n) in enumerate(zip(ends.tolist(), n_terms.tolist())):
        if n:
            w = votes[end - n : end]
            ones = w @ np.unpackbits(raw[end - n : end], axis=1).astype(np.float32)
            out[i] = np.packbits(2 * ones > w.sum(dtype=np.float64))
    return out


_POPULATION = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits of two arrays of fingerprints."""
    return 1.0 - _POPULATION[a ^ b].sum(axis=1) / (8 * a.shape[1])


def fingerprint_texts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint as lowercase hex) without any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            prints = [bytes(p).hex() for p in fingerprints(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"]
            )

    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    ).mapInArrow(run, "doc_id bigint, fingerprint string")


def with_edited_texts(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is replaced by the
    beginning of the next document in descending order of ids (after the last: the first).

    Documents are dealt by ranges of ids and meet their successor inside a range; the first
    document of each range is sent to the range above as well. What the driver holds is a bound
    and a first document per range.
    """
    spark = docs.sparkSession
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(ids.approxQuantile("doc_id", shares, 0.1 / ranges)))
    # a document's range: how many bounds lie below its id; rows without id end the lowest range
    part = F.lit(0)
    if bounds:
        part = _range_number(F.col("doc_id"), bounds)
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"part": part, "h": F.xxhash64("text")})
    heads = (
        keyed.groupBy("part")
        .agg(F.max(F.struct(F.coalesce("doc_id", F.lit(_LEAST)).alias("k"), "h")).alias("head"))
        .orderBy("part")
        .collect()
    )
    extra = [
        (row["head"]["k"], row["head"]["h"], above["part"])
        for row, above in zip(heads, heads[1:] + heads[:1])
    ]
    sentinels = spark.createDataFrame(extra, "k bigint, h bigint, to int")
    key = F.coalesce("doc_id", F.lit(_LEAST))
    copies = keyed.join(
        F.broadcast(sentinels), (key == F.col("k")) & (keyed["h"] == sentinels["h"]), "left"
    ).select(
        "doc_id", "text", keyed["h"],
        F.explode(
            F.when(
                F.col("to").isNull(),
                F.array(F.struct(F.col("part"), F.lit(0).alias("sentinel"))),
            ).otherwise(
                F.array(
                    F.struct(F.col("part"), F.lit(0).alias("sentinel")),
                    F.struct(F.col("to").alias("part"), F.lit(1).alias("sentinel")),
                )
            )
        ).alias("place"),
    )
    ordered = (
        copies.select("place.*", "doc_id", "text", "h")
        .repartition("part")
        .sortWithinPartitions("part", "sentinel", F.desc_nulls_last("doc_id"), F.desc("h"))
        .select("part", "sentinel", "doc_id", "text")
    )
    return ordered.mapInArrow(
        _edited_pairs,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


_LEAST = -(1 << 63)


def _range_number(column, bounds: list[float]):
    """Index of the range of a value, by halving: an expression of logarithmic depth would be
    large, so the bounds are an array and the place is counted in it."""
    from pyspark.sql import Column

    array = F.array(*[F.lit(float(b)) for b in bounds])
    count: Column = F.size(F.filter(array, lambda b: b < column.cast("double")))
    return F.when(column.isNull(), 0).otherwise(count).cast("int")


def _edited_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range, each range ended by its sentinel, the document after it."""
    rest = None
    for batch in chunks(batches, "text", 1 << 20):
        if rest is not None:
            batch = pa.concat_batches([rest, batch.cast(rest.schema)])
        if batch.num_rows == 1:
            rest = batch
            continue
        rest = batch.slice(batch.num_rows - 1)
        yield _edited(batch)


def _edited(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Results for all rows but the last, each with the row after it as its successor."""
    texts = batch.column("text").to_pylist()
    parts = batch.column("part").to_numpy()
    sentinel = batch.column("sentinel").to_numpy()
    own = np.flatnonzero(sentinel[:-1] == 0)
    if not len(own):
        return _RESULT_EMPTY
    assert (parts[own] == parts[own + 1]).all()
    sizes = [len(texts[i]) for i in own]
    edited = []
    for i, n in zip(own.tolist(), sizes):
        half = n // 2
        edited.append(texts[i][: n - half] + texts[i + 1][:half])
    prints = fingerprints(batch.column("text"))
    edited_prints = fingerprints(pa.array(edited, pa.string()))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").take(pa.array(own)),
            pa.array(sizes, pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array([bytes(p).hex() for p in prints[own]]),
            pa.array([bytes(p).hex() for p in edited_prints]),
            pa.array(likeness(prints[own], edited_prints)),
            pa.array(likeness(prints[own], prints[own + 1])),
        ],
        schema=_RESULT,
    )


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
     ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
     ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_RESULT_EMPTY = pa.RecordBatch.from_pylist([], schema=_RESULT)


def within_radius(
    prints: DataFrame, radius: int = 6, column: str = "fingerprint", crowd: int = 1000
) -> DataFrame:
    """All pairs (a, b, distance) of different fingerprints at most ``radius`` bits apart.

    Fingerprints are cut into ``radius + 2`` blocks. Two within the radius agree in at least two
    blocks, so each is filed under every pair of its blocks, one permuted table per pair, and
    met only by those that agree there. Where more than ``crowd`` fingerprints share a place in a
    table, they are filed by the blocks of their other bits as well, of which one must agree too.
    Equal fingerprints are one class: join the members back by the fingerprint.
    """
    width = BITS // 4
    blocks = radius + 2
    cuts = [width * i // blocks for i in range(blocks + 1)]

    def block(value, i: int):
        return F.substring(value, cuts[i] + 1, cuts[i + 1] - cuts[i])

    tables = list(combinations(range(blocks), 2))
    distinct = prints.select(F.col(column).alias("p")).filter("p is not null").distinct()
    filed = distinct.select(
        "p",
        F.explode(
            F.array(*[
                F.struct(F.lit(t).alias("t"), F.concat(block("p", i), block("p", j)).alias("key"))
                for t, (i, j) in enumerate(tables)
            ])
        ).alias("f"),
    ).select("p", "f.t", "f.key")
    crowds = filed.groupBy("t", "key").count().filter(F.col("count") > crowd).select("t", "key")
    crowds = crowds.withColumn("crowded", F.lit(True))
    filed = filed.join(crowds, ["t", "key"], "left")
    # the other blocks, one by one: radius differing bits leave one of radius + 1 untouched
    masked = F.coalesce(
        *[
            F.when(
                F.col("t") == t,
                F.concat(*[F.lit("") if b in (i, j) else block("p", b) for b in range(blocks)]),
            )
            for t, (i, j) in enumerate(tables)
        ]
    )
    rest_width = [width - sum(cuts[b + 1] - cuts[b] for b in pair) for pair in tables]
    finer = [min(rest_width) * i // (radius + 1) for i in range(radius + 1)] + [width]
    others = F.array(*[
        F.concat_ws(":", F.lit(i), F.substring("rest", finer[i] + 1, finer[i + 1] - finer[i]))
        for i in range(radius + 1)
    ])
    filed = filed.withColumn("rest", masked).select(
        "p", "t", "key",
        F.explode(F.when(F.col("crowded"), others).otherwise(F.array(F.lit("")))).alias("more"),
    )
    a, b = filed.alias("a"), filed.alias("b")
    halves = [(1, width // 2), (width // 2 + 1, width // 2)]
    distance = sum(
        F.bit_count(
            F.conv(F.substring("a.p", s, n), 16, -10).cast("long").bitwiseXOR(
                F.conv(F.substring("b.p", s, n), 16, -10).cast("long")
            )
        )
        for s, n in halves
    )
    return (
        a.join(b, ["t", "key", "more"])
        .filter(F.col("a.p") < F.col("b.p"))
        .select(F.col("a.p").alias("a"), F.col("b.p").alias("b"), distance.alias("distance"))
        .filter(F.col("distance") <= radius)
        .distinct()
    )
