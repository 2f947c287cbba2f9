"""Packing of documents into training sequences of several permitted lengths.

Best fit with bins of variable capacity: pieces are placed longest first, each where it leaves
least room; where nothing fits, the bin is opened whose cost per token that can still fill it is
least; at the end every bin shrinks to the least permitted length that holds its contents. This is
done for every set of permitted lengths that can hold all pieces, and the cheapest packing is kept.

The plan is made on counts per length, of which there are no more than the largest permitted
length however many documents there are: bins with the same contents are planned as one run. Rows
then look up their bin by their place among the pieces of their length. With capacity C the plan
has at most about C * (3 + log2 C) * 3 entries (a bin taken for length l keeps less than half of
its room for shorter ones), so it may be broadcast.

Defined results: documents longer than the largest permitted length are cut into pieces of that
length and a rest; a null length, or one below 1, gives one row without bin (null); rows repeated
under one id are packed each; rows without an id too; an empty table gives no rows; other columns
of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm.arrow import CHUNK_BYTES, chunks, release_memory
from corpusloom.sources.shared import materialise

LENGTHS = (1024, 2048, 4096, 8192)
# Pieces of one length that are numbered in one task.
NUMBERED = 50_000


def sequence_cost(length: int) -> float:
    """Work of a sequence: linear layers, attention, and a fixed share for its handling."""
    return length * (1 + length / 32_768) + 64


@dataclass
class Plan:
    """Runs of pieces: the ``count`` pieces of ``length`` from ``rank`` on (from 0) go to bins
    ``bin``, ``bin`` + 1, ... ``each`` of them to a bin, the first at ``offset``."""

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    # first bin, number of bins and final capacity of every run of equal bins
    bins: list[tuple[int, int, int]] = field(default_factory=list)
    cost: float = 0.0


def pack_counts(counts: dict[int, int], sizes: tuple[int, ...], cost=sequence_cost) -> Plan:
    """Best-fit decreasing over counts of pieces by length, with the permitted sizes given."""
    sizes = tuple(sorted(sizes))
    plan = Plan()
    # open bins by room left: room -> runs of (first bin, bins, filled)
    rooms: dict[int, list[tuple[int, int, int]]] = {}
    order: list[int] = []  # rooms in use, ascending
    next_bin = 0
    left = sum(length * n for length, n in counts.items())

    def place(first: int, bins: int, filled: int, room: int) -> None:
        if room not in rooms or not rooms[room]:
            rooms[room] = []
            at = int(np.searchsorted(order, room))
            if at == len(order) or order[at] != room:
                order.insert(at, room)
        rooms[room].append((first, bins, filled))

    def put(length: int, rank: int, n: int, first: int, bins: int, filled: int, room: int) -> int:
        """Fills bins one after another; returns how many pieces were placed."""
        each = room // length
        placed = min(n, bins * each)
        full, rest = divmod(placed, each)
        plan.length.append(length)
        plan.rank.append(rank)
        plan.count.append(placed)
        plan.bin.append(first)
        plan.each.append(each)
        plan.offset.append(filled)
        if full:
            place(first, full, filled + each * length, room - each * length)
        if rest:
            place(first + full, 1, filled + rest * length, room - rest * length)
        used = full + bool(rest)
        if used < bins:
            place(first + used, bins - used, filled, room)
        return placed

    for length in sorted(counts, reverse=True):
        n, rank = counts[length], 0
        while n:
            at = int(np.searchsorted(order, length))
            while at < len(order) and not rooms[order[at]]:
                order.pop(at)
            if at < len(order):
                room = order[at]
                first, bins, filled = rooms[room].pop()
            else:
                size = _cheapest(length, n, left, sizes, cost)
                bins = -(-n // (size // length))
                first, filled, room = next_bin, 0, size
                next_bin += bins
            placed = put(length, rank, n, first, bins, filled, room)
            n, rank, left = n - placed, rank + placed, left - placed * length
    runs = [run for group in rooms.values() for run in group]
    for first, bins, filled in sorted(runs):
        capacity = sizes[int(np.searchsorted(sizes, filled))]
        plan.bins.append((first, bins, capacity))
        plan.cost += bins * cost(capacity)
    return plan


def _cheapest(length: int, n: int, left: int, sizes: tuple[int, ...], cost) -> int:
    """Size whose cost per token is least, over the pieces at hand and shorter ones to come."""

    def price(size: int) -> tuple[float, int]:
        here = min(size // length, n) * length
        return cost(size) / (here + min(size - here, max(0, left - here))), -size

    return min((size for size in sizes if size >= length), key=price)


def best_plan(counts: dict[int, int], sizes: tuple[int, ...] = LENGTHS, cost=sequence_cost) -> Plan:
    """The cheapest plan over all sets of permitted sizes that hold the longest piece."""
    longest = max(counts, default=0)
    plans = []
    for k in range(1, len(sizes) + 1):
        for chosen in combinations(sorted(sizes), k):
            if chosen[-1] >= longest:
                plan = pack_counts(counts, chosen, cost)
                # bins may shrink to any permitted size, also one not opened
                plans.append(_shrunk(plan, sizes, cost))
    return min(plans, key=lambda p: p.cost)


def _shrunk(plan: Plan, sizes: tuple[int, ...], cost) -> Plan:
    """Capacities by contents over all permitted sizes."""
    if not plan.bins:
        return plan
    filled = np.zeros(max(first + n for first, n, _ in plan.bins), np.int64)
    # contents of the first bin of each run stand for the run
    firsts = np.array([b[0] for b in plan.bins])
    for length, count, first, each, offset in zip(
        plan.length, plan.count, plan.bin, plan.each, plan.offset
    ):
        full, rest = divmod(count, each)
        low, high = np.searchsorted(firsts, (first, first + full + bool(rest)))
        spots = firsts[low:high]
        inside = np.where(spots < first + full, each, rest)
        filled[spots] = np.maximum(filled[spots], offset + inside * length)
    ordered = np.array(sorted(sizes))
    bins, total = [], 0.0
    for first, n, _ in plan.bins:
        capacity = int(ordered[np.searchsorted(ordered, filled[first])])
        bins.append((first, n, capacity))
        total += n * cost(capacity)
    plan.bins, plan.cost = bins, total
    return plan


def pieces(lengths: DataFrame, id_column: str, length_column: str, largest: int) -> DataFrame:
    """doc_id, piece, piece_start, length: documents cut at the largest permitted length."""
    n = F.col(length_column).cast("long")
    count = F.when(n >= 1, F.ceil(n / F.lit(largest))).otherwise(F.lit(1))
    exploded = lengths.select(
        F.col(id_column).alias("doc_id"), n.alias("n"),
        F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"),
    )
    start = F.col("piece") * largest
    return exploded.select(
        "doc_id", "piece", start.alias("piece_start"),
        F.when(F.col("n") >= 1, F.least(F.col("n") - start, F.lit(largest))).alias("length"),
    )


def ranked(cut: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Every piece with its place, from 0, among those of its length, in order of ids.

    A length of many pieces is numbered in shares of them: a share's places follow those of the
    shares before it, counted first.
    """
    crowds = {length: -(-n // NUMBERED) for length, n in counts.items() if n > NUMBERED}
    shares = F.lit(1)
    if crowds:
        table = F.create_map(*[F.lit(x) for pair in crowds.items() for x in pair])
        shares = F.coalesce(F.element_at(table, F.col("length").cast("int")), F.lit(1))
    keyed = cut.withColumn(
        "share", F.pmod(F.xxhash64("doc_id", "piece"), shares.cast("long")).cast("int")
    )
    sizes = keyed.groupBy("length", "share").agg(F.count(F.lit(1)).alias("in_share"))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        "length", "share", F.coalesce(F.sum("in_share").over(before), F.lit(0)).alias("offset")
    ).filter("offset > 0")
    inside = Window.partitionBy("length", "share").orderBy("doc_id", "piece")
    numbered = keyed.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), ["length", "share"], "left").select(
        "doc_id", "piece", "piece_start", "length",
        (F.col("place") + F.coalesce("offset", F.lit(0))).alias("rank"),
    )


def pack(
    lengths: DataFrame,
    id_column: str = "doc_id",
    length_column: str = "n_tokens",
    sizes: tuple[int, ...] = LENGTHS,
    cost=sequence_cost,
) -> DataFrame:
    """doc_id, piece, piece_start, length, bin_id, bin_capacity and bin_offset of every piece."""
    cut = materialise(pieces(lengths, id_column, length_column, max(sizes)), "pieces")
    counts = {
        r["length"]: r["n"]
        for r in cut.filter("length is not null")
        .groupBy("length")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    plan = cut.sparkSession.sparkContext.broadcast(_arrays(best_plan(counts, sizes, cost)) if counts else None)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, rank0, length, first, each, offset, bin_first, capacity = plan.value
            n, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            run = np.searchsorted(key, n << 40 | rank, side="right") - 1
            step, slot = np.divmod(rank - rank0[run], each[run])
            number = first[run] + step
            size = capacity[np.searchsorted(bin_first, number, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(number), pa.array(size),
                 pa.array(offset[run] + slot * n)],
                names=["doc_id", "piece", "piece_start", "length", "bin_id", "bin_capacity",
                       "bin_offset"],
            )

    id_type = dict(cut.dtypes)["doc_id"]
    schema = (
        f"doc_id {id_type}, piece bigint, piece_start bigint, length bigint, bin_id bigint, "
        "bin_capacity bigint, bin_offset bigint"
    )
    placed = ranked(cut.filter("length is not null"), counts).mapInArrow(assign, schema)
    nothing = F.lit(None).cast("bigint")
    unplaced = cut.filter("length is null").select(
        "doc_id", "piece", "piece_start", "length", nothing.alias("bin_id"),
        nothing.alias("bin_capacity"), nothing.alias("bin_offset"),
    )
    return placed.unionByName(unplaced)


def _arrays(plan: Plan) -> tuple[np.ndarray, ...]:
    length, rank = np.array(plan.length), np.array(plan.rank)
    key = length << 40 | rank
    order = np.argsort(key)
    bins = np.array(sorted(plan.bins))
    return (
        key[order], rank[order], length[order], np.array(plan.bin)[order],
        np.array(plan.each)[order], np.array(plan.offset)[order], bins[:, 0], bins[:, 2],
    )


def token_counts(
    docs: DataFrame,
    spec: str,
    end_id: bool = True,
    chunk_bytes: int = CHUNK_BYTES,
    kept_units: int | None = None,
) -> DataFrame:
    """(doc_id, n_tokens) of every text, with the id that ends it; no shuffle.

    A task holds about ``chunk_bytes`` of text and tables of ``kept_units`` units; less of both
    costs time, but leaves room on executors whose workers have had other stages before.
    """
    from corpusloom.llm.token_files import Tokenizer

    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        tokenizer = Tokenizer(shared.value)
        if kept_units is not None:
            tokenizer.units.limit = tokenizer.words.limit = kept_units
        for batch in chunks(batches, "text", chunk_bytes):
            _, counts = tokenizer.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts + int(end_id))], ["doc_id", "n_tokens"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint"
    )
