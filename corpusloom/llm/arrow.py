"""Helpers of the operators that run over Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text handled at once by a task, however long single texts are.
CHUNK_BYTES = 4 << 20


def release_memory() -> None:
    """Gives back what earlier tasks of a reused worker have freed but the process still holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK_BYTES):
    """Slices of the batches with about ``size`` bytes of text each (at least one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        total = np.cumsum(np.asarray(lengths, dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts as strings; a null is an empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all elements of the runs ``starts[i] .. starts[i] + lengths[i] - 1``."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


class UnitCache:
    """Ids of text units (words with what surrounds them), kept between chunks of a worker.

    ``encode`` gets new units and returns their ids end to end with the number per unit. ``trim``
    empties the table when it holds ``limit`` units, so its memory is bounded.
    """

    def __init__(self, encode, limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def trim(self) -> None:
        if len(self.codes) > self.limit:
            self._clear()

    def codes_of(self, units: list[str]) -> np.ndarray:
        """The place of every unit in the table, new ones being encoded first."""
        known = self.codes
        codes = np.fromiter(map(known.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(codes < 0)
        if len(new):
            fresh = [units[i] for i in new.tolist()]
            ids, lengths = self.encode(fresh)
            base = len(self.starts)
            known.update(zip(fresh, range(base, base + len(fresh))))
            codes[new] = np.arange(base, base + len(fresh))
            starts = len(self.ids) + np.cumsum(lengths) - lengths
            self.starts = np.concatenate([self.starts, starts])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])
        return codes

    def ids_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the coded units end to end, and the number of ids per unit."""
        lengths = self.lengths[codes]
        return self.ids[ragged(self.starts[codes], lengths)], lengths


def distinct_units(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct units of all texts, index of every unit, units per text) of a list array."""
    sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64), sizes


def spliced(
    n: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray]:
    """Puts ids of several groups of texts in the order of the texts.

    Each part is (numbers of its texts, ids end to end, ids per text).
    """
    counts = np.zeros(n, np.int64)
    for rows, _, sizes in parts:
        counts[rows] = sizes
    starts = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint32)
    for rows, ids, sizes in parts:
        out[ragged(starts[rows], sizes)] = ids
    return out, counts


def sums_by_run(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Sum of each run of ``runs[i]`` consecutive values; empty runs give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(runs)
    return total[ends] - total[ends - runs]
