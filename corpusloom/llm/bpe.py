"""Byte-level BPE with numpy: encoding by merge ranks, and decoding.

Texts are cut into pieces by the vocabulary's pattern. Pieces not met before are put, by length,
into padded matrices of ids; each round merges the leftmost pair of least rank in every row and
closes the gap, until no row has a known pair. Pairs are looked up in a hash table of numpy arrays.
Pieces too long for a matrix take whole stretches of one rank per round, with the same result.

Defined results: a null or empty text has no ids; rows are kept as they are, repeated ones and
those without an id too; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.arrow import (
    UnitCache,
    chunks,
    distinct_units,
    ragged,
    spliced,
    sums_by_run,
)

_NONE = np.int64(1 << 40)  # rank of a pair that is not in the vocabulary
_LONGEST_ROW = 64
_BLANK = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
    r"\x{3000}]"
)
_ODD_BLANKS = rf"^$|^ | $| {_BLANK}|{_BLANK} "


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to id, from lines of base64 and rank."""
    lines = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


class PairTable:
    """(left id, right id) -> id of both together, by open addressing with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, _NONE, np.int64)
        key = np.array(keys, np.int64)
        value = np.array(values, np.int64)
        slot = self._slot(key)
        self.probes = 1
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]  # of several for one slot the last stays
            placed = self.keys[slot] == key
            self.values[slot[placed]] = value[placed]
            key, value, slot = key[~placed], value[~placed], (slot[~placed] + 1) % size
            self.probes += bool(len(key))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; negative ids are padding and never match."""
        key = left << 32 | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where((found == key) & (right >= 0), self.values[slot], _NONE)
        missed = np.flatnonzero((found != key) & (found != -1) & (right >= 0))
        for _ in range(self.probes):
            if not len(missed):
                break
            slot[missed] = (slot[missed] + 1) % len(self.keys)
            found = self.keys[slot[missed]]
            hit = found == key[missed]
            out[missed[hit]] = self.values[slot[missed[hit]]]
            missed = missed[~hit & (found != -1)]
        return out


class Encoder:
    """Encodes and decodes by a vocabulary of byte ranks and its pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.find = regex.compile(pattern).findall
        self.pieces = UnitCache(self._merge)
        self.units = UnitCache(self._cut)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each.

        A single space between two other characters always begins a piece, so texts are cut
        there and equal units are encoded once. Texts with other blanks next to a space are cut
        by the pattern as a whole.
        """
        self.units.trim()
        self.pieces.trim()
        texts = pc.fill_null(texts, "")
        odd = np.asarray(pc.match_substring_regex(texts, _ODD_BLANKS))
        plain = texts.filter(pa.array(~odd))
        units, index, sizes = distinct_units(pc.split_pattern(plain, " "))
        codes = self.units.codes_of([" " + unit for unit in units])[index]
        heads = (np.cumsum(sizes) - sizes).tolist()  # the first unit of a text has no space
        codes[heads] = self.units.codes_of([units[i] for i in index[heads].tolist()])
        ids, lengths = self.units.ids_of(codes)
        counts = sums_by_run(lengths, sizes)
        if not odd.any():
            return ids, counts
        whole = self._cut(texts.filter(pa.array(odd)).to_pylist())
        return spliced(
            len(texts), [(np.flatnonzero(~odd), ids, counts), (np.flatnonzero(odd), *whole)]
        )

    def _cut(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.find(unit) for unit in units]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        pieces = list(chain.from_iterable(found))
        ids, lengths = self.pieces.ids_of(self.pieces.codes_of(pieces))
        return ids, sums_by_run(lengths, sizes)

    def _merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every piece: its own token if it is one, else merged by rank."""
        data = [piece.encode("utf-8", "surrogatepass") for piece in pieces]
        own = [self.ranks.get(piece, -1) for piece in data]
        results: list = [None] * len(data)
        buckets: dict[int, list[int]] = {}
        for i, (piece, rank) in enumerate(zip(data, own)):
            if rank >= 0:
                results[i] = (rank,)
            elif len(piece) > _LONGEST_ROW:
                results[i] = self._merge_long(piece)
            else:
                buckets.setdefault(-(-len(piece) // 8) * 8, []).append(i)
        for width, rows in buckets.items():
            for at in range(0, len(rows), 65_536):
                part = rows[at : at + 65_536]
                for i, ids in zip(part, self._merge_rows([data[r] for r in part], width)):
                    results[i] = ids
        lengths = np.fromiter(map(len, results), np.int64, len(results))
        flat = np.fromiter(
            (i for ids in results for i in ids), np.uint32, int(lengths.sum())
        )
        return flat, lengths

    def _merge_rows(self, rows: list[bytes], width: int) -> list[list[int]]:
        """Rounds over a padded matrix: each live row merges its leftmost pair of least rank."""
        n = len(rows)
        raw = np.frombuffer(b"".join(row.ljust(width, b"\0") for row in rows), np.uint8)
        length = np.fromiter(map(len, rows), np.int64, n)
        ids = self.byte_ids[raw.reshape(n, width)]
        columns = np.arange(width)
        ids[columns >= length[:, None]] = -1
        rank = np.full((n, width), _NONE, np.int64)  # of the pair that begins in the column
        rank[:, :-1] = self.pairs.rank(
            ids[:, :-1].ravel(), ids[:, 1:].ravel()
        ).reshape(n, width - 1)
        live = np.arange(n)
        done = np.full((n, width), -1, np.int64)
        while True:
            place = rank.argmin(axis=1)  # the first of equal ranks
            row = np.arange(len(live))
            best = rank[row, place]
            stop = best == _NONE
            if stop.any():
                done[live[stop], : ids.shape[1]] = ids[stop]
                keep = ~stop
                live, ids, rank = live[keep], ids[keep], rank[keep]
                place, best = place[keep], best[keep]
                row = np.arange(len(live))
            if not len(live):
                break
            # close the gap: columns after the pair move one to the left
            w = ids.shape[1]
            after = columns[: w - 1] > place[:, None]
            ids = np.where(after, ids[:, 1:], ids[:, :-1])
            rank = np.where(after, rank[:, 1:], rank[:, :-1])
            ids[row, place] = best
            left = np.where(place > 0, ids[row, place - 1], 0)
            before = self.pairs.rank(left, ids[row, place])
            has_left = place > 0
            rank[row[has_left], place[has_left] - 1] = before[has_left]
            last = place + 1 >= w - 1
            right = np.where(last, -1, ids[row, np.minimum(place + 1, w - 2)])
            rank[row, place] = np.where(
                right >= 0, self.pairs.rank(ids[row, place], np.maximum(right, 0)), _NONE
            )
        lengths = (done >= 0).sum(axis=1)
        return [line[:k] for line, k in zip(done.tolist(), lengths.tolist())]

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """All leftmost pairs of the least rank in one round, if none of them makes a lower one."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.rank(ids[:-1], ids[1:])
        while len(ids) > 1 and (best := rank.min()) != _NONE:
            places = np.flatnonzero(rank == best)
            places = _not_overlapping(places)
            # what each merge would meet: merges before it are done, those after it are not
            joined = np.concatenate([[False], np.diff(places) == 2])
            left = np.where(joined, best, ids[np.maximum(places - 1, 0)])
            lower_left = np.where(places > 0, self.pairs.rank(left, np.full_like(left, best)), _NONE)
            has_right = places + 2 < len(ids)
            right = ids[np.minimum(places + 2, len(ids) - 1)]
            lower_right = np.where(
                has_right, self.pairs.rank(np.full_like(right, best), right), _NONE
            )
            broken = np.flatnonzero(np.minimum(lower_left, lower_right) <= best)
            if len(broken):
                places = places[: broken[0] + 1]
            ids[places] = best
            ids = np.delete(ids, places + 1)
            rank = self.pairs.rank(ids[:-1], ids[1:])
        return ids

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all texts end to end, and the number of bytes of each text."""
        ids = ids.astype(np.int64)
        lengths = self.token_lengths[ids]
        data = self.token_bytes[ragged(self.token_starts[ids], lengths)]
        return data.tobytes(), sums_by_run(lengths, counts)


def _not_overlapping(places: np.ndarray) -> np.ndarray:
    """Every other place of each stretch of neighbouring places, from its left end."""
    if len(places) < 2:
        return places
    begins = np.concatenate([[True], np.diff(places) > 1])
    first = np.maximum.accumulate(np.where(begins, places, 0))
    return places[(places - first) % 2 == 0]


def encode_documents(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per document its ids, their decoded bytes and sha256 of both.

    No shuffle: every task encodes its part of the table, a few megabytes of text at once. The
    rank file is broadcast; its size is fixed by the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in chunks(batches, "text"):
            encoder = encoder or Encoder(parse_ranks(shared.value), pattern)
            ids, counts = encoder.encode(batch.column("text"))
            data, sizes = encoder.decode(ids, counts)
            raw = memoryview(ids.astype("<u4").tobytes())
            text = memoryview(data)
            ends, byte_ends = np.cumsum(counts) * 4, np.cumsum(sizes)
            id_hash = [
                hashlib.sha256(raw[e - 4 * n : e]).hexdigest()
                for e, n in zip(ends.tolist(), counts.tolist())
            ]
            text_hash = [
                hashlib.sha256(text[e - n : e]).hexdigest()
                for e, n in zip(byte_ends.tolist(), sizes.tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.array(id_hash), pa.array(text_hash)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    ).mapInArrow(
        encode, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def tokens(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The ids themselves: (doc_id, ids array<int>)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in chunks(batches, "text"):
            encoder = encoder or Encoder(parse_ranks(shared.value), pattern)
            ids, counts = encoder.encode(batch.column("text"))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    ).mapInArrow(encode, "doc_id bigint, ids array<int>")
