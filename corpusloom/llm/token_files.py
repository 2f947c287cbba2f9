"""Token ids of documents in binary files, coded with Simple-8b.

``write_token_files`` tokenizes documents, orders them by id and writes files of whole documents;
``read_token_files`` reads them back. A file holds coded blocks, then per block its words and
escapes, then per document its id and number of tokens, then a footer with the four counts.

Defined results: a null or empty text has the end id alone; rows with equal ids are kept, ordered
by their text; rows without id come first; an empty table gives no files and no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.llm import simple8b
from corpusloom.llm.arrow import UnitCache, chunks, distinct_units, spliced, sums_by_run
from corpusloom.llm.stored_files import OutputFile, new_folder, open_input, tasks_for

_FOOTER = "<8sqqqq"
_MAGIC = b"TOKENS8B"
_NO_ID = np.iinfo(np.int64).min
# Ids coded at once, and after how many coded bytes a task starts its next file.
GROUP_IDS = 1 << 20
FILE_BYTES = 64 << 20

MANIFEST = (
    "part int, seq int, file string, n_docs bigint, n_ids bigint, n_bytes bigint"
)
_TOKENS = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
     ("ids_crc32", pa.int64())]
)

# Within these code points a text is composed already, lower-cases letter by letter, and blanks
# are the same everywhere; other texts go through the tokenizer whole.
_UNCOMMON = r"[^\x00-\x1b\x20-\x{84}\x{86}-\x{12f}\x{131}-\x{24f}]"


class Tokenizer:
    """The tokenizers library behind a table of the blank-separated units met so far.

    ``spec`` is the tokenizer's file. Its splitter never joins what blanks separate, so a unit
    has the same ids wherever it stands.
    """

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library, normalizers

        self.library = Library.from_str(spec)
        # texts that hold an added token's string are left to the library, which gives its id
        self.added = [(t["content"], bool(t["normalized"])) for t in json.loads(spec)["added_tokens"]]
        # for units that are in the normal form already, in which no added token is left
        self.normal = Library.from_str(spec)
        self.normal.encode_special_tokens = True
        self.normal.normalizer = normalizers.Sequence([])
        self.words = UnitCache(lambda units: self._by_library(units, self.normal))
        self.units = UnitCache(self._by_words)

    def _by_library(self, units: list[str], library) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in library.encode_batch_fast(units, add_special_tokens=False)]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.array(list(chain.from_iterable(coded)), np.uint32)
        return flat, lengths

    def _by_words(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A letter word with a plain mark after it is cut there, others stay whole."""
        pieces, sizes = [], np.ones(len(units), np.int64)
        for i, unit in enumerate(units):
            if unit[-1:] in _MARKS and unit[:-1].isalpha():
                pieces += (unit[:-1], unit[-1])
                sizes[i] = 2
            else:
                pieces.append(unit)
        ids, lengths = self.words.ids_of(self.words.codes_of(pieces))
        return ids, sums_by_run(lengths, sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each text."""
        self.units.trim()
        self.words.trim()
        texts = pc.fill_null(texts, "")
        uncommon = np.array(pc.match_substring_regex(texts, _UNCOMMON))
        for content, normalised in self.added:
            uncommon |= np.asarray(pc.match_substring(texts, content, ignore_case=normalised))
        plain = texts.filter(pa.array(~uncommon))
        units, index, sizes = distinct_units(pc.utf8_split_whitespace(pc.utf8_lower(plain)))
        ids, lengths = self.units.ids_of(self.units.codes_of(units)[index])
        counts = sums_by_run(lengths, sizes)
        if not uncommon.any():
            return ids, counts
        whole = texts.filter(pa.array(uncommon)).to_pylist()
        return spliced(
            len(texts),
            [(np.flatnonzero(~uncommon), ids, counts),
             (np.flatnonzero(uncommon), *self._by_library(whole, self.library))],
        )


_MARKS = frozenset(".,;:!?")


class TokenFile:
    """Writes documents one after another; blocks are coded by groups."""

    def __init__(self, folder: str, encoder: simple8b.Encoder):
        self.file = OutputFile(folder, ".s8b")
        self.encoder = encoder
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.docs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.blocks: list[np.ndarray] = []
        self.n_ids = 0

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.counts.append(counts)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= GROUP_IDS:
            ids = np.concatenate(self.waiting)
            full = len(ids) // simple8b.BLOCK * simple8b.BLOCK
            self._code(ids[:full])
            self.waiting, self.n_waiting = [ids[full:]], len(ids) - full

    def _code(self, ids: np.ndarray) -> None:
        words, n_words, n_escapes = self.encoder.encode(ids.astype(np.uint64))
        self.file.write(words.astype("<u8").tobytes())
        self.blocks.append(np.stack([n_words, n_escapes], axis=1))

    def close(self) -> dict:
        if self.n_waiting:
            self._code(np.concatenate(self.waiting))
        blocks = np.concatenate(self.blocks) if self.blocks else np.zeros((0, 2), np.int64)
        docs, counts = np.concatenate(self.docs), np.concatenate(self.counts)
        for table in (blocks, docs, counts):
            self.file.write(np.ascontiguousarray(table, dtype="<i8").tobytes())
        self.file.write(struct.pack(_FOOTER, _MAGIC, len(blocks), len(docs), self.n_ids, 0))
        self.file.close()
        return {
            "file": self.file.name,
            "n_docs": len(docs),
            "n_ids": self.n_ids,
            "n_bytes": self.file.size,
        }


def read_file(folder: str, name: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, tokens of each, ids of the next stretch) by groups of blocks.

    The documents of a stretch may begin or end in a neighbouring one; counts are those of the
    documents that *begin* in it, so a reader needs no more than one stretch in memory.
    """
    with open_input(folder, name) as file:
        size = file.size()
        file.seek(size - struct.calcsize(_FOOTER))
        magic, n_blocks, n_docs, n_ids, _ = struct.unpack(_FOOTER, file.read(struct.calcsize(_FOOTER)))
        if magic != _MAGIC:
            raise ValueError(f"{name} is not a token file")
        file.seek(size - struct.calcsize(_FOOTER) - 16 * (n_blocks + n_docs))
        blocks = np.frombuffer(file.read(16 * n_blocks), "<i8").reshape(-1, 2)
        docs = np.frombuffer(file.read(8 * n_docs), "<i8")
        counts = np.frombuffer(file.read(8 * n_docs), "<i8")
        starts = np.cumsum(counts) - counts
        file.seek(0)
        group = GROUP_IDS // simple8b.BLOCK
        doc = done = 0
        for b in range(0, n_blocks, group):
            part = blocks[b : b + group]
            words = np.frombuffer(file.read(8 * int(part[:, 0].sum())), "<u8")
            n = min(len(part) * simple8b.BLOCK, n_ids - done)
            ids = simple8b.decode(words, part[:, 0], part[:, 1], n)
            done += n
            to = int(np.searchsorted(starts, done)) if done < n_ids else n_docs
            yield docs[doc:to], counts[doc:to], ids
            doc = to


def write_token_files(
    docs: DataFrame,
    spec: str,
    folder: str,
    end_id: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Writes the files and returns their manifest, itself written beside them.

    Documents are spread by ranges of their id. A task tokenizes its sorted range and holds one
    stretch of ids; the tokenizer's file is the one thing broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, encoder = Tokenizer(shared.value), simple8b.Encoder()
        part, seq, out, rows = TaskContext.get().partitionId(), 0, None, []

        def finish():
            nonlocal seq, out
            rows.append({"part": part, "seq": seq, **out.close()})
            seq, out = seq + 1, None

        for batch in chunks(batches, "text"):
            ids, counts = tokenizer.encode(batch.column("text"))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            keys = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            out = out or TokenFile(folder, encoder)
            out.add(keys, counts + 1, ids)
            if out.file.size >= FILE_BYTES:
                finish()
        if out:
            finish()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_MANIFEST)

    ordered = (
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
        )
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}-manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}-manifest")


_MANIFEST = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()),
     ("n_ids", pa.int64()), ("n_bytes", pa.int64())]
)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids of every document, read from the files.

    Only the manifest (a row per file) is numbered in one task; each file is read by one task.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select(
        "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _summaries(folder, row["file"], row["first"])

    return files.repartition(tasks_for(manifest), "file").mapInArrow(
        read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def _summaries(folder: str, name: str, first: int) -> Iterator[pa.RecordBatch]:
    doc = start = total = None  # the document that is open at the end of a stretch
    crc, left = 0, 0
    for docs, counts, ids in read_file(folder, name):
        data = ids.astype("<u4").tobytes()
        at = 0
        rows = []
        if left:
            take = min(left, len(ids))
            crc = zlib.crc32(data[: 4 * take], crc)
            at, left = take, left - take
            if left == 0:
                rows.append((doc, start, total, crc))
        for doc, total in zip(docs.tolist(), counts.tolist()):
            start, first = first, first + total
            take = min(total, len(ids) - at)
            crc = zlib.crc32(data[4 * at : 4 * (at + take)])
            at, left = at + take, total - take
            if left == 0:
                rows.append((doc, start, total, crc))
        if rows:
            key, *rest = zip(*rows)
            keys = pa.array(key, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if k == _NO_ID else k for k in key], pa.int64())
                 if _NO_ID in key else keys, *[pa.array(c, pa.int64()) for c in rest]],
                schema=_TOKENS,
            )


def encode_documents(docs: DataFrame, spec: str, end_id: int = 1) -> DataFrame:
    """Writes token files below the shared folder and reads them back."""
    spark: SparkSession = docs.sparkSession
    folder = new_folder(spark, "tokens")
    return read_token_files(write_token_files(docs, spec, folder, end_id), folder)
