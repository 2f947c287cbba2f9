"""Fill-in-middle transformation of whole texts.

A text is cut into prefix, middle and suffix, counted in units, and its parts are written in another
order with a mark before each. Units are code points, or the parts of a text that a pattern begins
(words, lines). The UTF-8 bytes of a text lie in blocks of fixed length; a Fenwick tree over the
blocks holds how many units and how many code points begin in each. A descent by halving steps finds
the block of a cut, and only that block is searched for the place. Trees of all texts of a chunk lie
one after another in one array, so that each step of the descent moves every cut at once.

Defined results: a null or empty text is plain, with no units and an empty output; a null id draws as
an empty string would; equal rows give equal results and are all kept; texts of any length are cut
whole; an empty table gives no rows; other columns of the input are kept, and a column whose name is
also a column of the result keeps its place under ``in_`` and its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.llm.arrow import chunks, ragged

BLOCK = 256  # bytes of a block
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"

RESULT = [
    ("n", LongType()),
    ("form", StringType()),
    ("prefix_chars", LongType()),
    ("middle_chars", LongType()),
    ("output", StringType()),
]


class BlockTrees:
    """Fenwick trees over the blocks of many texts.

    ``data`` is the texts' bytes end to end, ``offsets`` their bounds, ``begins`` marks the bytes
    at which a unit begins. Node i of a text (from 1) holds the sums of the blocks
    i - lowbit(i) .. i - 1.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, begins: np.ndarray | None = None):
        self.data, self.offsets = data, offsets
        self.points = (data & 0xC0) != 0x80  # the first byte of a code point
        self.begins = self.points if begins is None else begins
        sizes = np.diff(offsets)
        self.blocks = -(-sizes // BLOCK)
        self.first = np.cumsum(self.blocks) - self.blocks
        self.at = ragged(np.ones(len(sizes), np.int64), self.blocks)  # node number in its text
        starts = np.repeat(offsets[:-1], self.blocks) + (self.at - 1) * BLOCK
        self.char_tree = self._tree(self.points, starts)
        same = self.begins is self.points
        self.unit_tree = self.char_tree if same else self._tree(self.begins, starts)
        self.totals = self._prefix(self.unit_tree, self.blocks)

    def _tree(self, flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.int64)
        tree = np.add.reduceat(flags.astype(np.int64), starts)
        step, top = 1, int(self.blocks.max())
        while 2 * step <= top:
            # the left half below each node of this height is complete
            nodes = np.flatnonzero(self.at % (2 * step) == 0)
            tree[nodes] += tree[nodes - step]
            step *= 2
        return tree

    def _prefix(self, tree: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Sum of the first ``upto`` blocks of each text."""
        total, left = np.zeros(len(upto), np.int64), upto.copy()
        while (live := np.flatnonzero(left)).size:
            total[live] += tree[self.first[live] + left[live] - 1]
            left[live] &= left[live] - 1
        return total

    def cut(self, texts: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, code points) of each text before its unit of the given number.

        The number may be the count of all units: then the cut is the end of the text.
        """
        block = np.zeros(len(texts), np.int64)
        passed, chars = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        size, first = self.blocks[texts], self.first[texts]
        step = 1 << max(0, int(size.max(initial=0)).bit_length() - 1)
        while step and len(self.unit_tree):
            node = first + block + step - 1
            inside = block + step <= size
            node = np.where(inside, node, 0)
            taken = inside & (passed + self.unit_tree[node] <= units)
            passed += np.where(taken, self.unit_tree[node], 0)
            chars += np.where(taken, self.char_tree[node], 0)
            block += np.where(taken, step, 0)
            step >>= 1
        # within the block: the first byte with more units up to it than are still to pass
        start, end = self.offsets[texts] + block * BLOCK, self.offsets[texts + 1]
        place = np.minimum(start, end)
        inner = np.flatnonzero(block < size)
        for at in range(0, len(inner), 4096):
            part = inner[at : at + 4096]
            byte = start[part, None] + np.arange(BLOCK)
            real = byte < end[part, None]
            byte = np.where(real, byte, 0)
            seen = np.cumsum(self.begins[byte] & real, axis=1) + passed[part, None]
            ahead = seen <= units[part, None]  # true up to the place, false from it on
            here = (ahead & real).sum(axis=1)
            place[part] = start[part] + here
            chars[part] += (self.points[byte] & real & ahead).sum(axis=1)
        return place - self.offsets[texts], chars


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes end to end, bounds) of a string array without nulls."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, bounds, data = texts.buffers()
    if len(texts) == 0 or bounds is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(bounds, kind, len(texts) + 1, texts.offset * kind().itemsize)
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _begins(texts: list[bytes], offsets: np.ndarray, pattern: str) -> np.ndarray:
    """Marks the bytes at which a match of the pattern begins; text before the first match of a
    text belongs to the first unit."""
    import regex

    find = regex.compile(pattern).finditer
    out = np.zeros(int(offsets[-1]), bool)
    for text, start in zip(texts, offsets[:-1].tolist()):
        decoded = text.decode("utf-8", "surrogatepass")
        points = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        found = np.array([m.start() for m in find(decoded) if m.end() > m.start()], np.int64)
        if len(text):
            found = np.union1d(found[found > 0], [0])
            out[start + points[found]] = True
    return out


def draws(ids: list) -> np.ndarray:
    """The first four 8-digit groups of sha256('1:' + id) of every id, as a row of numbers."""
    digests = b"".join(
        hashlib.sha256(f"1:{'' if i is None else i}".encode()).digest()[:16] for i in ids
    )
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def _transformed(ids: list, texts: pa.Array, pattern: str | None, shares: tuple) -> list[pa.Array]:
    texts = pc.fill_null(texts, "")
    data, offsets = _bytes_of(texts)
    raw = data.tobytes()
    bounds = offsets.tolist()
    begins = None
    if pattern is not None:
        begins = _begins([raw[a:b] for a, b in zip(bounds, bounds[1:])], offsets, pattern)
    trees = BlockTrees(data, offsets, begins)
    n, h = trees.totals, draws(ids)
    lower = np.minimum(h[:, 0] % (n + 1), h[:, 1] % (n + 1))
    upper = np.maximum(h[:, 0] % (n + 1), h[:, 1] % (n + 1))
    marked = np.asarray(pc.match_substring_regex(texts, _MARKS))
    plain = (n == 0) | marked | (h[:, 2] % 100 >= shares[0])
    moved = np.flatnonzero(~plain)
    suffix_first = h[:, 3] % 100 < shares[1]
    both = np.concatenate([moved, moved])
    place, chars = trees.cut(both, np.concatenate([lower[moved], upper[moved]]))
    k = len(moved)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
    for i, x, y, spm in zip(
        moved.tolist(), place[:k].tolist(), place[k:].tolist(), suffix_first[moved].tolist()
    ):
        text = out[i]
        if spm:
            out[i] = b"".join((s, text[y:], p, text[:x], m, text[x:y]))
        else:
            out[i] = b"".join((p, text[:x], s, text[y:], m, text[x:y]))
    form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
    prefix_chars, middle_chars = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    prefix_chars[moved], middle_chars[moved] = chars[:k], chars[k:] - chars[:k]
    return [
        pa.array(n),
        pa.array(form, pa.string()),
        pa.array(prefix_chars, mask=plain),
        pa.array(middle_chars, mask=plain),
        pa.array(out, pa.binary()).cast(pa.string(), safe=False),
    ]


def _free_names(columns: list[str], taken: list[str]) -> dict[str, str]:
    """A name for every column that is no name of the result in either case."""
    out, used = {}, {c.lower() for c in columns} | set(taken)
    for column in columns:
        name = column
        if name.lower() in taken:
            while name.lower() in used:
                name = f"in_{name}"
            used.add(name.lower())
        out[column] = name
    return out


def transform(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    units: str | None = None,
    moved_percent: int = 90,
    suffix_first_percent: int = 20,
) -> DataFrame:
    """The rows with their number of units, form, code points of prefix and middle, and output.

    The cuts, the form and the order follow sha256 of the id, so a rerun task gives the same rows.
    ``units`` is a pattern whose matches begin the units; without it units are code points. Of the
    texts ``moved_percent`` are cut, and of these ``suffix_first_percent`` begin with the suffix.

    No shuffle: a task holds a few megabytes of text, or one text if it is longer.
    """
    names = [name for name, _ in RESULT]
    source = _free_names(docs.columns, names)
    kept = docs.select(*[F.col(f"`{c}`").alias(source[c]) for c in docs.columns])
    shares = (moved_percent, suffix_first_percent)
    ids, texts = source[id_column], source[text_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, texts):
            made = _transformed(
                batch.column(ids).to_pylist(), batch.column(texts), units, shares
            )
            yield pa.RecordBatch.from_arrays(
                batch.columns + made, names=batch.schema.names + names
            )

    schema = StructType(kept.schema.fields + [StructField(*field) for field in RESULT])
    return kept.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text, rebuilt from an output and its form.

    A cut text holds none of the marks, so the first of each is the one that was set.
    """

    def after(text: Column, mark: str) -> Column:
        return F.substring(text, F.instr(text, mark) + F.lit(len(mark)), F.length(text))

    def before(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    body = after(output, PREFIX)
    tail = after(body, SUFFIX)
    psm = F.concat(before(body, SUFFIX), after(tail, MIDDLE), before(tail, MIDDLE))
    suffix = before(after(output, SUFFIX), PREFIX)
    spm = F.concat(before(body, MIDDLE), after(body, MIDDLE), suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def with_digests(docs: DataFrame) -> DataFrame:
    """Per document the sizes and form of its transformation, sha256 of the output and of the text
    rebuilt from it."""
    rows = transform(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias(
            "restored_sha256"
        ),
    )
