"""SentencePiece models of the merge type: exact encoding by backtracking, and decoding.

Instead of merging pairs of symbols, the encoder walks over a text with the longest pieces. An
Aho-Corasick automaton over the reversed pieces gives the longest piece that begins at each place. A
piece may follow another only if merging both spellings anew would give these two and nothing across
their border; that is tried by undoing merges on both sides of the border, the later one first. If
no piece, however short, can follow, the place is marked as failed in a bit field, the last piece is
taken back and a shorter one is tried. A sequence whose neighbours are all compatible is the one
that merging the whole text would give, and there is only one.

Where no piece of the model has a space mark behind another letter, no merge crosses the place
before a space mark, so texts are cut there and equal units are encoded once per worker.

Models: pieces of type BPE with the identity normaliser and byte fallback; others are refused.

Defined results: a null or empty text has the end id alone; rows are kept as they are, repeated ones
and those without an id too; other columns of the input are not read; an empty table gives no rows;
very long texts are encoded whole, a chunk of their own.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

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

SPACE = "▁"
# Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_BPE = 2

# Texts that need their blanks looked at one by one.
_ODD_BLANKS = rf"^$|^ | $|  |{SPACE}"
# Ids of units kept by a worker before its table is emptied.
_KEPT_IDS = 4 << 20
# Words (parts of units) kept; they are few beside the units, and costly to encode.
_KEPT_WORDS = 600_000
_PLAIN_SIGNS = frozenset(".,;:!?")


class Model(NamedTuple):
    """What a model file says."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool


def _numbers(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a serialised message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = 8 if kind == 1 else 4
            if kind == 2:
                size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_model(data: bytes) -> Model:
    """Pieces, scores and kinds of a model file (fields 1 to 3 of its pieces, 2 and 3 of itself)."""
    pieces, scores, kinds = [], [], []
    trainer, normaliser = {}, {}
    for field, value in _numbers(data):
        if field == 1:
            piece = dict(_numbers(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif field == 2:
            trainer = dict(_numbers(value))
        elif field == 3:
            normaliser = dict(_numbers(value))
    if trainer.get(3, 1) != _BPE or not trainer.get(35, 0):
        raise ValueError("only merge-type models with byte fallback are supported")
    if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or trainer.get(24, 0):
        raise ValueError("only the identity normaliser with marked spaces is supported")
    if {USER_DEFINED, UNUSED} & set(kinds):
        raise ValueError("user-defined and unused pieces are not supported")
    return Model(pieces, scores, kinds, bool(normaliser.get(3, 1)))


class Merges:
    """The merges of a model: what each piece was merged from, and which piece a pair gives.

    Symbols are ids of pieces; letters of pieces that are no piece themselves get ids beyond them,
    and the last symbol stands for any letter that no piece has. ``rank`` orders merges as the
    model does (highest score first, of equal scores the leftmost place first); letters have -1.
    """

    def __init__(self, model: Model):
        normal = [i for i, kind in enumerate(model.kinds) if kind == NORMAL]
        self.symbols = {model.pieces[i]: i for i in normal}
        letters = sorted({c for i in normal for c in model.pieces[i]})
        for letter in letters:
            if letter not in self.symbols:
                self.symbols[letter] = len(model.pieces) + len(self.symbols) - len(normal)
        self.other = len(model.pieces) + len(self.symbols) - len(normal)
        size = self.other + 1
        self.rank, self.head, self.tail = [-1] * size, [-1] * size, [-1] * size
        self.shorter, self.length = [-1] * size, [1] * size
        self.pairs: dict[tuple[int, int], int] = {}
        by_score = {s: r for r, s in enumerate(sorted({-model.scores[i] for i in normal}))}
        words = [i for i in normal if len(model.pieces[i]) > 1]
        words.sort(key=lambda i: (by_score[-model.scores[i]], len(model.pieces[i])))
        unreached = []
        for i in words:
            piece, rank = model.pieces[i], by_score[-model.scores[i]]
            found = self._split(piece, rank)
            if found is None:
                unreached.append(piece)
                continue
            self.head[i], self.tail[i] = found
            self.rank[i], self.length[i] = rank, len(piece)
            self.pairs[found] = i
        for piece in unreached:  # merging never gives them
            del self.symbols[piece]
        for piece, i in self.symbols.items():
            for end in range(len(piece) - 1, 0, -1):
                if (prefix := self.symbols.get(piece[:end])) is not None:
                    self.shorter[i] = prefix
                    break

    def _split(self, piece: str, rank: int) -> tuple[int, int] | None:
        """The two parts whose merge gives the piece when it is merged from its letters."""
        for cut in range(1, len(piece)):
            left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
            if left is None or right is None:
                continue
            made = all(
                self.length[s] == len(p) and self.rank[s] <= rank
                for s, p in ((left, piece[:cut]), (right, piece[cut:]))
            )
            if made and self.compatible(left, right):
                return left, right
        return None

    def compatible(self, left: int, right: int) -> bool:
        """True if merging anew what both symbols spell gives exactly these two."""
        rank, pairs = self.rank, self.pairs
        limit = 1 << 60
        while True:
            across = pairs.get((left, right))
            if across is not None and rank[across] < limit:
                return False  # this merge would have come before the ones undone so far
            if rank[left] > rank[right]:
                limit = rank[left]
                left = self.tail[left]
            elif rank[right] >= 0:
                limit = rank[right] + 1  # of equal ranks the merge across is further left
                right = self.head[right]
            else:
                return True


class Encoder:
    """Encodes and decodes by a model; ``merges`` may be given to save computing them again."""

    def __init__(self, model: Model, merges: Merges | None = None):
        import ahocorasick
        import regex

        self.model = model
        self.merges = merges = merges or Merges(model)
        self.reversed = ahocorasick.Automaton()
        for piece, i in merges.symbols.items():
            self.reversed.add_word(piece[::-1], i)
        self.reversed.make_automaton()
        self.byte_ids = [model.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        self.letters = {c: i for c, i in merges.symbols.items() if i >= len(model.pieces)}
        self.spelt = {i: c for c, i in self.letters.items()}
        # a space mark behind another letter in no piece: cuts before such marks are exact
        self.cuttable = not any(regex.search(f"[^{SPACE}]{SPACE}", p) for p in merges.symbols)
        self.find_units = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        # likewise between letters and other signs, if no piece has one beside the other
        word = r"\p{L}\p{M}"
        beside = regex.search if self.cuttable else lambda *_: True
        edge = f"[{word}][^{word}{SPACE}]|[^{word}{SPACE}][{word}]"
        self.divisible = not any(beside(edge, p) for p in merges.symbols)
        self.find_words = regex.compile(
            f"{SPACE}*[{word}]+|{SPACE}*[^{word}{SPACE}]+|{SPACE}+"
        ).findall
        self.units = UnitCache(self._encode_units)
        self.words = UnitCache(self._encode_words, _KEPT_WORDS)
        self.known: dict[int, bool] = {}
        self._decoding_tables()

    def _decoding_tables(self) -> None:
        data, kinds = [], self.model.kinds
        for piece, kind in zip(self.model.pieces, kinds):
            if kind == BYTE:
                data.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                data.append(b"")
            elif kind == UNKNOWN:
                data.append(" ⁇ ".encode())
            else:
                data.append(piece.replace(SPACE, " ").encode())
        self.piece_lengths = np.fromiter(map(len, data), np.int64, len(data))
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths
        self.piece_bytes = np.frombuffer(b"".join(data), np.uint8)
        self.is_control = np.array([k == CONTROL for k in kinds])
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.leads = np.array([p.startswith(SPACE) for p in self.model.pieces])

    # encoding

    def symbols_of(self, text: str) -> list[int]:
        """Symbols of a text with marked spaces, by backtracking."""
        merges, known = self.merges, self.known
        other, size = merges.other, merges.other + 1
        n = len(text)
        # the longest piece that begins at each place: of all that end at a place of the reversed
        # text, which come from long to short, the first
        longest = [other] * n
        for end, symbol in self.reversed.iter(text[::-1]):
            if longest[~end] == other:
                longest[~end] = symbol
        failed, any_failed = bytearray(n // 8 + 1), False
        length, shorter, compatible = merges.length, merges.shorter, merges.compatible
        out: list[int] = []
        at, last, symbol = 0, -1, longest[0] if n else -1
        while at < n:
            while symbol >= 0:
                end = at + length[symbol]
                if not any_failed or not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    pair = last * size + symbol
                    fits = known.get(pair)
                    if fits is None:
                        fits = known[pair] = compatible(last, symbol)
                    if fits:
                        break
                symbol = shorter[symbol]
            if symbol >= 0:
                out.append(symbol)
                at, last = end, symbol
                if at < n:
                    symbol = longest[at]
            else:
                # nothing can follow here: take the last piece back and try a shorter one
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                symbol = out.pop()
                at -= length[symbol]
                last = out[-1] if out else -1
        if len(known) > 1 << 20:
            known.clear()
        return out

    def _ids(self, text: str) -> list[int]:
        """Ids of a text with marked spaces; letters without a piece are spelt in bytes."""
        whole = self.merges.symbols.get(text, self.merges.other)
        if whole < len(self.model.pieces):
            return [whole]
        symbols = self.symbols_of(text)
        if max(symbols, default=0) < len(self.model.pieces):
            return symbols
        out, at = [], 0
        for symbol in symbols:
            end = at + self.merges.length[symbol]
            if symbol < len(self.model.pieces):
                out.append(symbol)
            else:
                out += [self.byte_ids[b] for b in text[at:end].encode("utf-8", "surrogatepass")]
            at = end
        return out

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.divisible:
            return self._encode_words(units)
        cut = [self._words_of(unit) for unit in units]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        ids, lengths = self.words.ids_of(self.words.codes_of(list(chain.from_iterable(cut))))
        return ids, sums_by_run(lengths, sizes)

    def _words_of(self, unit: str) -> list[str] | tuple[str, ...]:
        """The unit cut between letters and other signs; the plainest ones without a pattern."""
        if unit[:1] == SPACE:
            if unit[1:].isalpha():
                return (unit,)
            if unit[-1] in _PLAIN_SIGNS and unit[1:-1].isalpha():
                return unit[:-1], unit[-1]
        return self.find_words(unit)

    def _encode_words(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self._ids(unit) for unit in units]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts with blanks of any kind."""
        mark = SPACE if self.model.dummy_prefix else ""
        marked = [mark + t.replace(" ", SPACE) if t else "" for t in texts]
        if not self.cuttable:
            return self._encode_units(marked)
        cut = [self.find_units(t) for t in marked]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        codes = self.units.codes_of(list(chain.from_iterable(cut)))
        ids, lengths = self.units.ids_of(codes)
        return ids, sums_by_run(lengths, sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each."""
        for cache in (self.units, self.words):
            if len(cache.ids) > _KEPT_IDS:
                cache.codes = dict.fromkeys(range(cache.limit + 1))  # full, whatever it holds
            cache.trim()
        texts = pc.fill_null(texts, "")
        if self.cuttable and self.model.dummy_prefix:
            odd = np.asarray(pc.match_substring_regex(texts, _ODD_BLANKS))
        else:
            odd = np.ones(len(texts), bool)
        plain = texts.filter(pa.array(~odd))
        units, index, sizes = distinct_units(pc.split_pattern(plain, " "))
        # every unit of such a text, the first one too, begins with a space mark
        codes = self.units.codes_of([SPACE + unit for unit in units])
        ids, lengths = self.units.ids_of(codes[index])
        counts = sums_by_run(lengths, sizes)
        if not odd.any():
            return ids, counts
        whole = self._whole(texts.filter(pa.array(odd)).to_pylist())
        return spliced(
            len(texts), [(np.flatnonzero(~odd), ids, counts), (np.flatnonzero(odd), *whole)]
        )

    # decoding

    def spelling(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that the ids spell, end to end, and the number of bytes of each id."""
        ids = ids.astype(np.int64)
        lengths = self.piece_lengths[ids]
        return self.piece_bytes[ragged(self.piece_starts[ids], lengths)], lengths

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The text of each run of ids, in UTF-8.

        The first piece loses its leading space; bytes that form no letter become U+FFFD each.
        """
        data, lengths = self.spelling(ids)
        raw = data.tobytes()
        sizes = sums_by_run(lengths, counts)
        ends, id_ends = np.cumsum(sizes).tolist(), np.cumsum(counts).tolist()
        out = []
        ids = ids.astype(np.int64)
        for end, size, id_end, count in zip(ends, sizes.tolist(), id_ends, counts.tolist()):
            text = raw[end - size : end]
            run = ids[id_end - count : id_end]
            try:
                text.decode()
                broken = self.is_control[run[:-1]].any()  # a letter's bytes may lie around it
            except UnicodeDecodeError:
                broken = True
            if broken:
                text = self._mended(run)
            out.append(text[self._leading(run) :])
        return out

    def _leading(self, run: np.ndarray) -> int:
        """1 if the first piece that is seen begins with a space mark that the model added."""
        if not self.model.dummy_prefix:
            return 0
        for i in run.tolist():
            if not self.is_control[i]:
                return int(self.leads[i])
        return 0

    def _mended(self, run: np.ndarray) -> bytes:
        out, waiting = [], bytearray()
        for i in run.tolist():
            part = self.piece_bytes[self.piece_starts[i] :][: self.piece_lengths[i]].tobytes()
            if self.is_byte[i]:
                waiting += part
            else:
                out += (_letters(waiting), part)
                waiting.clear()
        return b"".join([*out, _letters(waiting)])


def _letters(data: bytearray) -> bytes:
    """The bytes with every byte that belongs to no letter put as U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            part = bytes(data[at : at + size])
            try:
                part.decode()
            except UnicodeDecodeError:
                continue
            out.append(part)
            at += len(part)
            break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


class NumberTexts:
    """Decimal texts of small numbers, each with a mark behind it, for joining without loops."""

    def __init__(self, size: int, marks: str = " "):
        texts = [f"{i}{mark}".encode() for mark in marks for i in range(size)]
        self.size = size
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def joined(self, numbers: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        """The text of each run of numbers, without its last mark. A number with the mark of place
        k is given as ``number + k * size``."""
        lengths = self.lengths[numbers]
        data = memoryview(self.data[ragged(self.starts[numbers], lengths)].tobytes())
        sizes = sums_by_run(lengths, counts)
        ends = np.cumsum(sizes)
        return [
            data[end - size : max(end - size, end - 1)]
            for end, size in zip(ends.tolist(), sizes.tolist())
        ]


def _shared(docs: DataFrame, model: bytes):
    """The model and its merges for all tasks; their size is fixed by the vocabulary."""
    parsed = read_model(model)
    return docs.sparkSession.sparkContext.broadcast((parsed, Merges(parsed)))


def _columns(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    )


def tokens(
    docs: DataFrame,
    model: bytes,
    end_id: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The ids themselves: (doc_id, ids array<int>). No shuffle."""
    shared = _shared(docs, model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in chunks(batches, "text"):
            ids, counts = _with_end(*encoder.encode(batch.column("text")), end_id)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return _columns(docs, id_column, text_column).mapInArrow(
        encode, "doc_id bigint, ids array<int>"
    )


def texts(coded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) of tables with ``doc_id`` and ``ids``; no ids give an empty text."""
    shared = _shared(coded, model)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            lists = batch.column("ids")
            counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            out = pa.array(encoder.decode(ids, counts), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, text string")


def _with_end(
    ids: np.ndarray, counts: np.ndarray, end_id: int | None
) -> tuple[np.ndarray, np.ndarray]:
    if end_id is None:
        return ids, counts
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def encode_documents(
    docs: DataFrame,
    model: bytes,
    end_id: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per document the number of its ids, and sha256 of the ids and of the text decoded from them.

    No shuffle: every task encodes its part of the table, a few megabytes of text at once.
    """
    shared = _shared(docs, model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in chunks(batches, "text"):
            if encoder is None:
                encoder = Encoder(*shared.value)
                decimals = NumberTexts(len(encoder.model.pieces))
            ids, counts = _with_end(*encoder.encode(batch.column("text")), end_id)
            listed = decimals.joined(ids.astype(np.int64), counts)
            decoded = encoder.decode(ids, counts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts),
                    pa.array([hashlib.sha256(t).hexdigest() for t in listed]),
                    pa.array([hashlib.sha256(t).hexdigest() for t in decoded]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _columns(docs, id_column, text_column).mapInArrow(
        encode, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
