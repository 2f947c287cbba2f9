"""Language identification by string kernels.

The kernel of two texts is blended over n-gram lengths 1 to 4: the number of n-grams present in
both, over the geometric mean of the numbers present in each. A Nystroem map on landmark texts and
ridge regression of one language against the rest give a score per language. Since the kernel is
a product of presence vectors, landmarks and weights fold into one matrix per n-gram length, and a
batch of texts is scored by multiplying its presence matrix with it.

Defined results: a null text, or one without any letter, has the language ``und`` and score 0;
rows are kept as they are, repeated ones and those without an id too; an empty table gives no rows;
without any labelled text every text is ``und``; other columns of the input are not read, or kept
by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.arrow import chunks

LENGTHS = (1, 2, 3, 4)
BUCKETS = 1 << 14  # hashed n-grams per length
UNKNOWN = "und"
# Bounds of the training sample: texts per language, languages, landmarks.
TEXTS_PER_LANGUAGE = 500
MAX_LANGUAGES = 64
LANDMARKS = 240
RIDGE = 1e-3
_SCORED_BYTES = 1 << 20


def presence(texts: pa.Array) -> list[np.ndarray]:
    """For each n-gram length a 0/1 matrix: texts x buckets, over the UTF-8 of lower-cased texts."""
    lowered = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.binary())
    data = np.frombuffer(b"\0".join(lowered.to_pylist()) + b"\0\0\0\0", np.uint8)
    # digits say nothing about a language
    codes = np.where((data >= 48) & (data <= 57), 48, data).astype(np.uint32)
    sizes = np.asarray(pc.binary_length(lowered), dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    left = np.repeat(np.cumsum(sizes + 1), sizes + 1) - np.arange(len(owner))  # with the end mark
    out = []
    rolled = np.zeros(len(owner), np.uint32)
    for n in LENGTHS:
        rolled = rolled * np.uint32(257) + codes[n - 1 : n - 1 + len(owner)] + np.uint32(1)
        bucket = (rolled * np.uint32(2654435761)) >> np.uint32(18)
        there = left > n
        matrix = np.zeros((len(sizes), BUCKETS), np.float32)
        matrix[owner[there], bucket[there]] = 1
        out.append(matrix)
    return out


def _scaled(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt(np.maximum(matrix.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    """Languages, and per n-gram length a matrix buckets x languages."""

    languages: list[str]
    weights: list[np.ndarray]

    def scores(self, texts: pa.Array) -> np.ndarray:
        total = np.zeros((len(texts), len(self.languages)), np.float32)
        for matrix, weight in zip(presence(texts), self.weights):
            total += (matrix @ weight) / np.sqrt(np.maximum(matrix.sum(axis=1, keepdims=True), 1))
        return total

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Best language of each text, and its share of the positive part of all scores."""
        letters = np.asarray(pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}"))
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        margin = np.clip((self.scores(texts) + 1) / 2, 1e-6, 1)
        best = margin.argmax(axis=1)
        share = margin[np.arange(len(best)), best] / margin.sum(axis=1)
        names = [self.languages[b] if known else UNKNOWN for b, known in zip(best, letters)]
        return names, np.where(letters, share, 0.0).astype(float)


def training_rows(docs: DataFrame, usable: Column) -> DataFrame:
    """At most ``TEXTS_PER_LANGUAGE`` usable texts of each language, by a hash of their id.

    Only ids are ranked; ranks are cut before their shuffle.
    """
    known = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keyed = known.select("doc_id", "lang", F.xxhash64("doc_id", F.lit("langid")).alias("h"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = (
        keyed.withColumn("r", F.row_number().over(order))
        .filter(F.col("r") <= TEXTS_PER_LANGUAGE)
        .select("doc_id", "lang")
        .distinct()
    )
    return known.select("doc_id", "lang", "text").join(
        F.broadcast(chosen), ["doc_id", "lang"], "left_semi"
    )


def fit(docs: DataFrame, usable: Column) -> Model:
    """Trains on a bounded sample; presence bits, not texts, come to the driver."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", _SCORED_BYTES):
            packed = np.concatenate(
                [np.packbits(m.astype(bool), axis=1) for m in presence(batch.column("text"))], axis=1
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"),
                 pa.array([row.tobytes() for row in packed], pa.binary())],
                ["doc_id", "lang", "bits"],
            )

    sample = training_rows(docs, usable).mapInArrow(bits, "doc_id bigint, lang string, bits binary")
    rows = sample.collect()
    # ordered, and each text once, so that the fit does not depend on how Spark read the table
    rows = sorted(rows, key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["bits"]))
    names = sorted({r["lang"] for r in rows})
    if len(names) > MAX_LANGUAGES:
        counts = {n: 0 for n in names}
        for r in rows:
            counts[r["lang"]] += 1
        names = sorted(sorted(names, key=lambda n: (-counts[n], n))[:MAX_LANGUAGES])
        rows = [r for r in rows if r["lang"] in set(names)]
    if not rows:
        return Model([], [])
    target = np.array([names.index(r["lang"]) for r in rows])
    raw = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1)
    width = BUCKETS // 8

    def features(index: np.ndarray, n: int) -> np.ndarray:
        part = raw[index, n * width : (n + 1) * width]
        return _scaled(np.unpackbits(part, axis=1).astype(np.float32))

    # landmarks: every language in turn
    place = np.zeros(len(rows), np.int64)
    for c in range(len(names)):
        members = np.flatnonzero(target == c)
        place[members] = np.arange(len(members))
    marks = np.sort(np.lexsort((target, place))[:LANDMARKS])
    kernel = np.zeros((len(rows), len(marks)))
    for n in range(len(LENGTHS)):
        landmark = features(marks, n)
        for at in range(0, len(rows), 256):
            index = np.arange(at, min(at + 256, len(rows)))
            kernel[index] += features(index, n) @ landmark.T
    values, vectors = np.linalg.eigh(kernel[marks])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel @ root
    y = np.where(target[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = np.bincount(target, minlength=len(names))
    weight = (1.0 / share)[target]  # languages count alike
    gram = phi.T @ (phi * weight[:, None])
    ridge = RIDGE * np.trace(gram) / len(gram)
    solution = np.linalg.solve(gram + ridge * np.eye(len(gram)), phi.T @ (y * weight[:, None]))
    folded = root @ solution
    return Model(
        names,
        [(features(marks, n).T @ folded).astype(np.float32) for n in range(len(LENGTHS))],
    )


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every text, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", _SCORED_BYTES):
            names, score = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names), pa.array(score)],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, lang_pred string, score double"
    )


def held_out() -> Column:
    """Documents that no model is trained on."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def fit_and_identify(docs: DataFrame) -> DataFrame:
    """Trains on the documents that are not held out and identifies all."""
    model = fit(docs, ~F.coalesce(held_out(), F.lit(True)))
    return identify(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), "lang_pred", "score"
    )


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.4) -> DataFrame:
    """Rows, with all their columns, whose text has a language with at least ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", _SCORED_BYTES):
            names, score = shared.value.predict(batch.column("text"))
            keep = (np.array(names) != UNKNOWN) & (score >= min_score)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
