"""Toxicity by weak supervision.

Many voters look at a text: word lists and patterns written by hand, and word beginnings learned
from labelled texts. A generative label model estimates how accurate each voter is and how far
voters depend on each other, and turns votes into a posterior label per text. A linear classifier
over the word beginnings is trained on the posteriors and scores all texts.

Features are the distinct words of a text and their first three to eight letters, hashed.

Defined results: a null or empty text has no features and gets the score of the intercept, as any
text without a known feature; rows are kept as they are, repeated ones and those without an id too;
repeated label rows of a document count once, as toxic if any says so; without labelled rows only
the hand-written voters speak; an empty table gives no rows; other columns of the input are not
read, or kept by ``keep_clean``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.arrow import chunks, ragged, release_memory
from corpusloom.sources.shared import materialise

BUCKETS = 1 << 22
PREFIXES = (3, 4, 5, 6, 7, 8)
# Bounds: labelled texts of each kind that the model is fitted on, and features it may use.
TEXTS_PER_LABEL = 4000
MAX_FEATURES = 1500
VOTERS = 48
THRESHOLD = 0.7
# Weight of a word from a list before any text is seen.
LISTED_WEIGHT = 5.0

# Word lists of the hand-written voters.
LEXICONS = {
    "insults_en": "idiot idiots moron morons stupid dumb loser losers pathetic worthless scum "
    "trash garbage clown fool freak imbecile",
    "contempt_en": "disgusting hate despise vile filthy ugly useless shut",
    "insults_de": "idiot dumm dummkopf trottel depp abschaum versager wertlos ekelhaft arschloch",
    "insults_fr": "idiot imbécile stupide crétin débile ordure minable dégoûtant connard abruti",
    "insults_es": "idiota estúpido imbécil basura asqueroso patético inútil payaso escoria tonto",
}


def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


# How often a feature occurs in a text is told by further features, from these counts on.
LEVELS = (1, 2, 4)
_LISTED = {
    word: _hash(f"list {name}") for name, words in LEXICONS.items() for word in words.split()
}


def word_features(word: str) -> list[int]:
    """The word as a whole, its beginnings, and the list that holds it."""
    out = [_hash(word + "$")]
    out += [_hash(word[:n]) for n in PREFIXES if len(word) >= n]
    if word in _LISTED:
        out.append(_LISTED[word])
    return out


def at_level(features: np.ndarray, level: int) -> np.ndarray:
    """The features that stand for ``level`` occurrences."""
    if level == 1:
        return features
    return (features * np.int64(2654435761) + level) & np.int64(BUCKETS - 1)


def text_features(
    texts: pa.Array, wanted: set[int] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, feature) for all distinct features, optionally of wanted words only."""
    words, index, sizes = words_of(texts)
    found: list[int] = []
    runs = np.zeros(len(words), np.int64)
    for i, word in enumerate(words):
        if word:
            mine = word_features(word)
            if wanted is not None:
                mine = [f for f in mine if f in wanted]
            found += mine
            runs[i] = len(mine)
    feature = np.array(found, np.int64)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    if wanted is not None:
        known = runs[index] > 0
        text_of, index = text_of[known], index[known]
    place = ragged((np.cumsum(runs) - runs)[index], runs[index])
    pairs, counts = np.unique(
        np.repeat(text_of, runs[index]) * np.int64(BUCKETS) + feature[place], return_counts=True
    )
    owner, kept = [], []
    for level in LEVELS:
        often = pairs[counts >= level]
        owner.append(often // BUCKETS)
        kept.append(at_level(often % BUCKETS, level))
    return np.concatenate(owner), np.concatenate(kept)


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, word numbers of all texts end to end, number of words of each text)."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    lists = pc.split_pattern_regex(lowered, r"[^\p{L}\p{M}]+")
    sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64), sizes


def patterns_of(texts: pa.Array) -> np.ndarray:
    """Votes of the hand-written patterns, texts x patterns: shouting and runs of marks."""
    filled = pc.fill_null(texts, "")
    return np.stack(
        [
            np.asarray(pc.match_substring_regex(filled, r"[!?]{4,}")),
            np.asarray(pc.match_substring_regex(filled, r"(?:\b\p{Lu}{4,}\b\W+){4}")),
            np.asarray(pc.match_substring_regex(filled, r"(?i)\byou\W+(?:are|re)\W+(?:an?\W+)?\w+\W*!")),
        ],
        axis=1,
    )


@dataclass
class Model:
    """Weights of hashed features, the word features they are made of, and an intercept."""

    weights: dict[int, float] = field(default_factory=dict)
    words: set[int] = field(default_factory=set)
    intercept: float = -3.0
    accuracies: dict[str, float] = field(default_factory=dict)
    correlations: dict[tuple[str, str], float] = field(default_factory=dict)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1."""
        owner, feature = text_features(texts, self.words)
        known = self.weights
        value = np.array([known.get(f, 0.0) for f in feature.tolist()])
        total = self.intercept + np.bincount(owner, value, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def held_out() -> Column:
    """Documents whose labels no model sees."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, features, patterns) of a bounded sample of labelled documents.

    Documents are taken by a hash of their id, as many as ``TEXTS_PER_LABEL`` of each label; at
    most twice as many ids are broadcast. Features come as distinct hashes, so a row has a bound.
    """
    marks = (
        labels.filter(~F.coalesce(held_out(), F.lit(True)) & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    chosen = None
    for label in (0, 1):
        part = marks.filter(F.col("toxic") == label).orderBy(order, "doc_id").limit(TEXTS_PER_LABEL)
        chosen = part if chosen is None else chosen.unionByName(part)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in chunks(batches, "text"):
            owner, feature = text_features(batch.column("text"))
            order = np.argsort(owner, kind="stable")
            ends = np.cumsum(np.bincount(owner, minlength=batch.num_rows))
            parts = np.split(feature[order].astype(np.int32), ends[:-1])
            rows = [np.unique(part).tobytes() for part in parts]
            votes = patterns_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.binary()),
                 pa.array([v.astype(np.uint8).tobytes() for v in votes], pa.binary())],
                ["doc_id", "toxic", "features", "patterns"],
            )

    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(chosen), "doc_id")
        .mapInArrow(extract, "doc_id bigint, toxic int, features binary, patterns binary")
    )


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains voters, label model and classifier on the bounded sample.

    The sample's features stay with the executors: they count them by label, and the driver gets the
    chosen features and, per text, one bit for each of these.
    """
    sample = materialise(training_sample(docs, labels), "toxicity-sample")
    texts = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    if not texts:
        return _hand_written_only()
    chosen = _associated(sample, texts.get(0, 0), texts.get(1, 0))
    rows = sorted(_marked(sample, chosen).collect())
    gold = np.array([toxic for _, toxic, _, _ in rows])
    packed = np.stack([np.frombuffer(bits, np.uint8) for _, _, bits, _ in rows])
    matrix = np.unpackbits(packed, axis=1, count=len(chosen)).astype(np.float32)
    patterns = np.stack([np.frombuffer(votes, np.uint8) for *_, votes in rows]).astype(bool)
    del rows, packed
    names, votes = _votes(chosen, patterns, matrix)
    posterior, accuracies, correlations = label_model(votes, gold)
    names_of = {(names[i], names[j]): c for (i, j), c in correlations.items()}
    listed = np.where(np.isin(chosen, list(_LISTED.values())), LISTED_WEIGHT, 0.0)
    weights, intercept = train_linear(matrix, posterior, listed)
    kept = {int(f): float(w) for f, w in zip(chosen, weights) if abs(w) > 1e-4}
    return Model(
        kept,
        _word_features_of(kept, sample),
        intercept,
        dict(zip(names, accuracies.tolist())),
        names_of,
    )


def _hand_written_only() -> Model:
    weights = {f: 4.5 for f in _LISTED.values()}
    return Model(weights, set(weights), -3.0)


def _word_features_of(kept: dict[int, float], sample: DataFrame) -> set[int]:
    """Word features that stand behind the kept ones, at any level: at most one for each level."""
    wanted = np.array(sorted(kept), np.int64)

    def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.unique(np.concatenate(_features_of(batch))).astype(np.int64)
            found = np.zeros(len(seen), bool)
            for level in LEVELS:
                found |= np.isin(at_level(seen, level), wanted)
            yield pa.RecordBatch.from_arrays([pa.array(seen[found])], ["feature"])

    rows = sample.select("features").mapInArrow(behind, "feature bigint").distinct().collect()
    return {row["feature"] for row in rows}


def _features_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Distinct features of every text; never an empty list, so that they can be joined."""
    rows = [np.frombuffer(row, np.int32) for row in batch.column("features").to_pylist()]
    return [*rows, np.zeros(0, np.int32)]


def _associated(sample: DataFrame, n_clean: int, n_toxic: int) -> np.ndarray:
    """Features that tell for label 1, best first by the lower end of their log odds, and the lists."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gold = np.asarray(batch.column("toxic"))
            for label in (0, 1):
                part = _features_of(batch.filter(pa.array(gold == label)))
                feature, n = np.unique(np.concatenate(part), return_counts=True)
                counts = [n, np.zeros(len(n), np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(feature), pa.array(counts[label]), pa.array(counts[1 - label])],
                    ["feature", "clean", "toxic"],
                )

    counts = (
        sample.select("toxic", "features")
        .mapInArrow(tally, "feature int, clean bigint, toxic bigint")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter("clean + toxic >= 3")
    )
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    rest_a, rest_b = max(1, n_toxic) + 1 - a, max(1, n_clean) + 1 - b
    odds = F.log(a / rest_a) - F.log(b / rest_b)
    spread = F.sqrt(1 / a + 1 / rest_a + 1 / b + 1 / rest_b)
    rows = (
        counts.select("feature", (odds - 1.5 * spread).alias("firm"))
        .filter("firm > 0")
        .orderBy(F.desc("firm"), "feature")
        .limit(MAX_FEATURES)
        .collect()
    )
    best = np.array([row["feature"] for row in rows], np.int64)
    return np.concatenate([best, np.setdiff1d(list(_LISTED.values()), best)])


def _marked(sample: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(doc_id, toxic, bits, patterns): one bit for each chosen feature that a text has."""
    order = np.argsort(chosen)
    ranked = chosen[order]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for row in _features_of(batch)[: batch.num_rows]:
                has = np.zeros(len(chosen), np.uint8)
                at = np.searchsorted(ranked, row)
                at[at == len(ranked)] = 0
                has[order[at[ranked[at] == row]]] = 1
                bits.append(np.packbits(has).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(bits, pa.binary()),
                 batch.column("patterns")],
                ["doc_id", "toxic", "bits", "patterns"],
            )

    return sample.mapInArrow(mark, "doc_id bigint, toxic int, bits binary, patterns binary")


def _votes(
    chosen: np.ndarray, patterns: np.ndarray, matrix: np.ndarray
) -> tuple[list[str], np.ndarray]:
    """Votes 1 (toxic), -1 (clean) or 0 (none) of every voter, texts x voters."""
    names, columns = [], []
    for name in LEXICONS:
        listed = chosen == _hash(f"list {name}")
        columns.append((matrix[:, listed].sum(axis=1) > 0).astype(np.int8))
        names.append(name)
    for k, name in enumerate(("marks", "shouting", "address")):
        columns.append(patterns[:, k].astype(np.int8))
        names.append(name)
    # learned lists: chosen features are dealt to voters in turn, so every voter has strong ones
    for v in range(min(VOTERS, matrix.shape[1])):
        columns.append((matrix[:, v::VOTERS].sum(axis=1) > 0).astype(np.int8))
        names.append(f"beginnings_{v}")
    nothing = sum(c.astype(int) for c in columns) == 0
    columns.append(np.where(nothing, -1, 0).astype(np.int8))
    names.append("nothing_found")
    return names, np.stack(columns, axis=1)


def label_model(
    votes: np.ndarray, gold: np.ndarray, rounds: int = 20, trust: float = 0.97
) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], float]]:
    """(posterior of label 1, accuracy per voter, correlated pairs) by expectation maximisation.

    A voter has a chance of each vote under each label. What voters share beyond the label is
    measured by the correlation of their residuals; a voter that repeats others counts the less,
    by one over the sum of its correlations. The given label is one more voter of fixed accuracy
    ``trust``.
    """
    values = (-1, 0, 1)
    seen = [(votes == v).astype(float) for v in values]
    prior = np.log(trust / (1 - trust)) * np.where(gold == 1, 1.0, -1.0)
    posterior = 1 / (1 + np.exp(-prior))
    base = float(np.clip(posterior.mean(), 0.01, 0.99))
    correlations: dict[tuple[int, int], float] = {}
    discount = np.ones(votes.shape[1])
    accuracy = np.full(votes.shape[1], 0.5)
    for _ in range(rounds):
        tables = []
        for q in (1 - posterior, posterior):
            counts = np.stack([q @ s for s in seen]) + 0.5
            tables.append(counts / counts.sum(axis=0))
        residual = votes.astype(float)
        for label, q in ((0, 1 - posterior), (1, posterior)):
            mean = tables[label][2] - tables[label][0]
            residual = residual - q[:, None] * mean
        deviation = residual.std(axis=0) + 1e-9
        shared = np.abs((residual / deviation).T @ (residual / deviation) / len(votes))
        np.fill_diagonal(shared, 0)
        shared[shared < 0.1] = 0
        discount = 1 / (1 + shared.sum(axis=1))
        odds = sum(
            s @ ((np.log(tables[1][k]) - np.log(tables[0][k])) * discount)
            for k, s in enumerate(seen)
        )
        new = 1 / (1 + np.exp(-np.clip(odds + prior + np.log(base / (1 - base)), -30, 30)))
        moved = np.abs(new - posterior).max()
        posterior = new
        said = np.maximum((votes != 0).sum(axis=0), 1)
        right = (votes == 1).T @ posterior + (votes == -1).T @ (1 - posterior)
        accuracy = right / said
        pairs = np.argwhere(np.triu(shared) > 0)
        correlations = {(int(i), int(j)): float(shared[i, j]) for i, j in pairs}
        if moved < 1e-4:
            break
    return posterior, accuracy, correlations


def train_linear(
    matrix: np.ndarray,
    target: np.ndarray,
    prior: np.ndarray,
    ridge: float = 1e-3,
    firm: float = 2e-2,
    steps: int = 25,
) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on soft labels by Newton steps; classes count alike.

    Weights are drawn to ``prior``, more firmly where it is not zero.
    """
    n, d = matrix.shape
    share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    weight = target * 0.5 / share + (1 - target) * 0.5 / (1 - share)
    weight /= weight.sum()
    # texts without any feature are one row; the last column is the intercept
    some = matrix.any(axis=1)
    rows = np.zeros((int(some.sum()) + 1, d + 1), np.float32)
    rows[:-1, :-1] = matrix[some]
    rows[:, -1] = 1
    rest = weight[~some].sum()
    mean = (weight[~some] @ target[~some]) / rest if rest else 0.5
    goal = np.append(target[some], mean)
    share_of = np.append(weight[some], rest)
    penalty = np.append(np.where(prior != 0, firm, ridge), 1e-6)
    centre = np.append(prior, 0.0)
    w = centre.copy()

    def loss(w: np.ndarray) -> float:
        z = np.clip(rows @ w, -30, 30)
        return float(share_of @ (np.logaddexp(0, z) - goal * z) + penalty @ (w - centre) ** 2 / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (share_of * (p - goal)) + penalty * (w - centre)
        curve = (share_of * p * (1 - p)).astype(np.float32)
        hessian = np.diag(penalty + 1e-9)
        for at in range(0, len(rows), 1000):  # no second matrix of all texts
            part = rows[at : at + 1000]
            hessian += part.T @ (part * curve[at : at + 1000, None])
        move = np.linalg.solve(hessian, slope)
        scale = 1.0
        while (after := loss(w - scale * move)) > now and scale > 1e-4:
            scale /= 2
        w -= scale * move
        if now - after < 1e-7:
            break
        now = after
    return w[:-1], float(w[-1])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every text, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            score = shared.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score)], ["doc_id", "score"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, score double"
    )


def fit_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows, with all their columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            score = shared.value.score(batch.column("text"))
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
