"""Alignment of two tokenizers over the same texts, and how often their tokens are linked.

Both token sequences of a text spell the same bytes. Where a token of each ends at the same byte, the
sequences are cut into groups. The aligner keeps the shift between the positions of both sequences:
while tokens correspond one to one the ends at (i, i + shift) are equal, so stretches of 1, 2, 4, ...
ends are compared at once and the first difference is found by halving the stretch that has it. The
irregular group found there is walked end by end, which gives the new shift.

A pair of tokens is linked where both stand in one group. A text's pairs are kept once, with the
number of their links; counts over the corpus say how many texts link a pair. The most frequent
pairs, whose number is bounded by arithmetic, meet the texts by broadcast and are summed where they
lie; only the texts' rare pairs are shuffled.

Defined results: a null or empty text, or one that either tokenizer does not spell exactly, has no
tokens: zeros and an empty digest. Rows are kept as they are, equal ones and those without an id
too, and each row counts as a text of its own; other columns of the input are not read; an empty
table gives no rows; very long texts are aligned whole, a chunk of their own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm import sentence_pieces
from corpusloom.llm.arrow import chunks, ragged, sums_by_run
from corpusloom.sources.shared import materialise

# Pairs that are broadcast with their counts: at most so many, or those found in more than one of
# so many links, of which there cannot be more.
BROADCAST_PAIRS = 400_000
# Links of a group beyond which its tokens are reduced to distinct ones before they are paired.
_LARGE_GROUP = 4096
# A pair is coded in one number: the second id in the lower bits. Both ids have less than 20 bits.
SECOND_BITS = 20
# Text handled at once: a text has many more numbers here (tokens, ends, links) than where it is
# only encoded.
_CHUNK_BYTES = 1 << 20
# Units kept (their words are kept as well, so a unit is soon put together anew).
_KEPT_UNITS = 300_000

ALIGNED = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, links array<struct<pair:bigint,times:bigint>>"
)


# tokenizers


def byte_ranks(spec: str) -> dict[bytes, int]:
    """Token bytes to id of a byte-level tokenizer file, without its added tokens.

    The file writes bytes as visible characters: printable Latin-1 letters stand for themselves,
    the others are numbered from 256 on in the order of the bytes.
    """
    file = json.loads(spec)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = (b for b in range(256) if b not in set(shown))
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
    added = {t["content"] for t in file.get("added_tokens", ())}
    return {
        bytes(map(byte_of.__getitem__, token)): i
        for token, i in file["model"]["vocab"].items()
        if token not in added
    }


class ByteTokens:
    """The first tokenizer: the tiktoken library's byte-level merges on a space and the text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding(
            "alignment", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, self.size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids per text, bytes, bytes per id)."""
        found = [self.encoding.encode_ordinary(f" {text}") for text in texts.to_pylist()]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
        lengths = self.lengths[ids]
        return ids, counts, self.bytes[ragged(self.starts[ids], lengths)], lengths


class PieceTokens(sentence_pieces.Encoder):
    """The second tokenizer: pieces of the text, before which the model sets a space.

    Words that begin with a space are what the sentencepiece library takes as whole texts, so it
    encodes those that are new; words without one are left to the encoder of this package.
    """

    def __init__(self, data: bytes, model: sentence_pieces.Model, merges: sentence_pieces.Merges):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        super().__init__(model, merges)
        self.size = len(model.pieces)

    def _encode_words(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        mark = sentence_pieces.SPACE
        plain = [i for i, unit in enumerate(units) if unit.rfind(mark) == 0 and len(unit) > 1]
        coded = self.library.encode([units[i][1:] for i in plain], num_threads=1)
        by_place = dict(zip(plain, coded))
        found = [by_place[i] if i in by_place else self._ids(u) for i, u in enumerate(units)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def encode_bytes(self, texts: pa.Array):
        """(ids, ids per text, bytes, bytes per id)."""
        ids, counts = self.encode(texts)
        return ids.astype(np.int64), counts, *self.spelling(ids)


# one text


def runs(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Groups of two ascending sequences of ends, as runs (i, j, k).

    A run says that the groups end at (i, j), (i + 1, j + 1), ..., (i + k - 1, j + k - 1). Both
    sequences must end at the same byte.
    """
    out = []
    note = out.append
    n, m = len(a), len(b)
    i = j = 0  # the current shift is j - i
    while i < n:
        x, y = a[i], b[j]
        if x == y:
            known = 1
            if i + 1 < n and a[i + 1] == b[j + 1]:
                known = _agreeing(a, b, i, j, n, m)
            note((i, j, known))
            i += known
            j += known
            continue
        # irregular: walk to the next common end, which gives the new shift
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        note((i, j, 1))
        i += 1
        j += 1
    return out


def _agreeing(a: list[int], b: list[int], i: int, j: int, n: int, m: int) -> int:
    """How many ends from i and j on agree: the stretch is doubled while all its ends do, and the
    first difference is found by halving the stretch that failed."""
    known = step = 2
    while i + known < n and a[i + known : i + known + step] == b[j + known : j + known + step]:
        known += min(step, n - i - known)
        step *= 2
    low, high = known, min(known + step - 1, n - i, m - j)
    while low < high:
        half = (low + high + 1) // 2
        if a[i + low : i + half] == b[j + low : j + half]:
            low = half
        else:
            high = half - 1
    return low


# a chunk of texts


def _ends(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Byte at which every token ends in its text."""
    total = np.cumsum(lengths)
    before = np.concatenate([[0], total])[np.cumsum(counts) - counts]
    return total - np.repeat(before, counts)


class Aligner:
    """Encodes, aligns and links the texts of a chunk."""

    def __init__(self, first: ByteTokens, second: PieceTokens):
        self.first, self.second = first, second
        self.size = max(first.size, second.size)
        if self.size > 1 << SECOND_BITS:
            raise ValueError("vocabularies of more than a million tokens are not supported")
        second.units.limit = _KEPT_UNITS
        self.numbers = sentence_pieces.NumberTexts(self.size, ",|;")

    def __call__(self, texts: pa.Array) -> dict[str, pa.Array]:
        texts = pc.fill_null(texts, "")
        a, n_a, b, n_b, length_a, length_b = self._encoded(texts)
        end_a, end_b = _ends(length_a, n_a), _ends(length_b, n_b)
        end_a, end_b = end_a.tolist(), end_b.tolist()
        found, n_runs = [], np.zeros(len(texts), np.int64)
        at = bt = 0
        for row, (n, m) in enumerate(zip(n_a.tolist(), n_b.tolist())):
            if n:
                part = runs(end_a[at : at + n], end_b[bt : bt + m])
                n_runs[row] = len(part)
                found += part
            at, bt = at + n, bt + m
        found = np.fromiter(chain.from_iterable(found), np.int64, 3 * len(found)).reshape(-1, 3)
        return self._linked(a, n_a, b, n_b, found, n_runs)

    def _encoded(self, texts: pa.Array):
        """Ids and lengths of both, without the texts that are not spelt exactly by both."""
        a, n_a, bytes_a, length_a = self.first.encode(texts)
        b, n_b, bytes_b, length_b = self.second.encode_bytes(texts)
        size_a, size_b = sums_by_run(length_a, n_a), sums_by_run(length_b, n_b)
        want = pc.binary_join_element_wise(" ", texts, "")
        size = np.asarray(pc.binary_length(want), dtype=np.int64)
        same = (size_a == size) & (size_b == size) & (size > 1)
        text, raw_a, raw_b = (memoryview(x) for x in (_flat(want), bytes_a, bytes_b))
        if not (same.all() and text == raw_a == raw_b):
            ends, ends_a, ends_b = np.cumsum(size), np.cumsum(size_a), np.cumsum(size_b)
            for row in np.flatnonzero(same).tolist():
                k = int(size[row])
                own = text[ends[row] - k : ends[row]]
                same[row] = (
                    own == raw_a[ends_a[row] - k : ends_a[row]]
                    and own == raw_b[ends_b[row] - k : ends_b[row]]
                )
            keep_a, keep_b = np.repeat(same, n_a), np.repeat(same, n_b)
            a, length_a, n_a = a[keep_a], length_a[keep_a], np.where(same, n_a, 0)
            b, length_b, n_b = b[keep_b], length_b[keep_b], np.where(same, n_b, 0)
        return a, n_a, b, n_b, length_a, length_b

    def _linked(self, a, n_a, b, n_b, found, n_runs) -> dict[str, pa.Array]:
        rows = np.arange(len(n_a))
        run_row = np.repeat(rows, n_runs)
        n_groups = np.bincount(run_row, found[:, 2], len(rows)).astype(np.int64)
        # groups end at these tokens, counted over the chunk
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        last_a = ragged(found[:, 0] + first_a[run_row], found[:, 2])
        last_b = ragged(found[:, 1] + first_b[run_row], found[:, 2])
        in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        group_row = np.repeat(rows, n_groups)
        n_links = np.zeros(len(rows), np.int64)
        np.add.at(n_links, group_row, in_a * in_b)
        # written out, the tokens of a group follow each other: those of a, then those of b
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 2
        listed = np.empty(len(a) + len(b), np.int64)
        place_a = np.arange(len(a)) + np.repeat(last_b + 1 - in_b, in_a)
        place_b = np.arange(len(b)) + np.repeat(last_a + 1, in_b)
        listed[place_a], listed[place_b] = a + mark_a * self.size, b + mark_b * self.size
        digests = [
            hashlib.sha256(text).hexdigest() if len(text) else ""
            for text in self.numbers.joined(listed, n_a + n_b)
        ]
        row, pair, times = self._pairs(a, b, last_a, last_b, in_a, in_b, group_row)
        per_row = np.bincount(row, minlength=len(rows))
        links = pa.ListArray.from_arrays(
            np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32),
            pa.StructArray.from_arrays([pa.array(pair), pa.array(times)], ["pair", "times"]),
        )
        return {
            "n_a": pa.array(n_a),
            "n_b": pa.array(n_b),
            "n_groups": pa.array(n_groups),
            "n_links": pa.array(n_links),
            "groups_sha256": pa.array(digests),
            "links": links,
        }

    def _pairs(self, a, b, last_a, last_b, in_a, in_b, group_row):
        """(row, pair, links) of every pair of every text, in order."""
        small = np.flatnonzero(in_a * in_b <= _LARGE_GROUP)
        # each token of a small group beside all of b in its group
        token_a = ragged(last_a[small] + 1 - in_a[small], in_a[small])
        beside = np.repeat(in_b[small], in_a[small])
        begin_b = np.repeat(last_b[small] + 1 - in_b[small], in_a[small])
        token_b = ragged(begin_b, beside)
        rows = [np.repeat(np.repeat(group_row[small], in_a[small]), beside)]
        pairs = [np.repeat(a[token_a], beside) << SECOND_BITS | b[token_b]]
        times = [np.ones(len(token_b), np.int64)]
        for g in np.flatnonzero(in_a * in_b > _LARGE_GROUP).tolist():
            ids_a, k_a = np.unique(a[last_a[g] + 1 - in_a[g] : last_a[g] + 1], return_counts=True)
            ids_b, k_b = np.unique(b[last_b[g] + 1 - in_b[g] : last_b[g] + 1], return_counts=True)
            pairs.append((ids_a[:, None] << SECOND_BITS | ids_b).ravel())
            times.append((k_a[:, None] * k_b).ravel())
            rows.append(np.full(len(pairs[-1]), group_row[g]))
        row, pair = map(np.concatenate, (rows, pairs))
        key = row << 2 * SECOND_BITS | pair
        if len(times) == 1:  # a link each: equal keys are counted
            key.sort()
            begins = np.flatnonzero(np.diff(key, prepend=-1))
            times = np.diff(begins, append=len(key))
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
            begins = np.flatnonzero(np.diff(key, prepend=-1))
            times = np.add.reduceat(np.concatenate(times)[order], begins)
        key = key[begins]
        return key >> 2 * SECOND_BITS, key & ((1 << 2 * SECOND_BITS) - 1), times


def _flat(texts: pa.Array) -> np.ndarray:
    """Bytes of a string array end to end."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, bounds, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8)
    offsets = np.frombuffer(bounds, kind, len(texts) + 1, texts.offset * kind().itemsize)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]


# whole tables


def align(
    docs: DataFrame,
    byte_spec: str,
    pattern: str,
    piece_model: bytes,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row its tokens, groups, links and linked pairs (``ALIGNED``). No shuffle.

    ``row`` numbers the rows of the table; it holds for the table that one run of the job writes.
    """
    model = sentence_pieces.read_model(piece_model)
    shared = docs.sparkSession.sparkContext.broadcast(
        (byte_ranks(byte_spec), piece_model, model, sentence_pieces.Merges(model))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, at = None, TaskContext.get().partitionId() << 40
        for batch in chunks(batches, "text", _CHUNK_BYTES):
            if aligner is None:
                ranks, *pieces = shared.value
                aligner = Aligner(ByteTokens(ranks, pattern), PieceTokens(*pieces))
            made = aligner(batch.column("text"))
            row = pa.array(np.arange(at, at + batch.num_rows))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [row, batch.column("doc_id"), *made.values()], names=["row", "doc_id", *made]
            )

    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    ).mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, first, count, best): how many texts link a pair, and whether no pair of its first id
    is linked by more. An id has at most as many pairs as the other vocabulary has ids."""
    counts = (
        aligned.select(F.explode("links.pair").alias("pair"))
        .groupBy("pair")
        .agg(F.count(F.lit(1)).alias("count"))
        .select("pair", F.shiftright("pair", SECOND_BITS).alias("first"), "count")
    )
    most = F.max("count").over(Window.partitionBy("first"))
    return counts.withColumn("best", F.col("count") == most)


def with_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of every row with links.

    ``aligned`` and ``counts`` are written tables. Frequent pairs are summed beside the texts; if
    there are more pairs than can be broadcast, the rare ones meet their counts in a shuffle and
    none of them is frequent enough to weigh on a task.
    """
    pairs, facts = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    least = 0 if pairs <= BROADCAST_PAIRS else facts / BROADCAST_PAIRS
    known = counts.select("pair", "count", "best")
    links = aligned.select("row", F.inline("links"))
    frequent = F.broadcast(known.filter(F.col("count") > least))

    def summed(joined: DataFrame) -> DataFrame:
        return joined.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("count")).alias("count_sum"),
        )

    out = summed(links.join(frequent, "pair"))
    if least == 0:
        return out
    rare = links.join(frequent, "pair", "left_anti")
    rare = summed(rare.join(known.filter(F.col("count") <= least).hint("shuffle_hash"), "pair"))
    both = out.unionByName(rare)
    return both.groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )


def align_documents(
    docs: DataFrame, byte_spec: str, pattern: str, piece_model: bytes
) -> DataFrame:
    """Per document its tokens, groups and links, with the corpus-wide counts of its pairs."""
    aligned = materialise(align(docs, byte_spec, pattern, piece_model), "aligned")
    counts = materialise(pair_counts(aligned), "pair-counts")
    sums = with_counts(aligned, counts)
    found = aligned.drop("links").join(sums, "row", "left")
    return found.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )
