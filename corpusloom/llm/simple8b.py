"""Simple-8b: ids packed into 64-bit words, coded and decoded by blocks with numpy.

The top four bits of a word select how many ids of how many bits the other sixty hold. Ids of
more than sixty bits are escapes: their word holds selector 0 and the id itself follows the words
of its block. Every block starts at a word of its own, so blocks are decoded independently.
"""

from __future__ import annotations

import numpy as np

from corpusloom.llm.arrow import ragged

BLOCK = 1024
# Fixed values of the coding: selector -> (ids per word, bits per id).
SELECTORS = {
    1: (60, 1),
    2: (30, 2),
    3: (20, 3),
    4: (15, 4),
    5: (12, 5),
    6: (10, 6),
    7: (8, 7),
    8: (7, 8),
    9: (6, 10),
    10: (5, 12),
    11: (4, 15),
    12: (3, 20),
    13: (2, 30),
    14: (1, 60),
}
ESCAPE = 0
_COUNTS = np.array([1] + [SELECTORS[s][0] for s in range(1, 15)], np.int64)
_ID_BITS = np.uint64(60)


class Encoder:
    """Keeps the bit-length table between calls."""

    def __init__(self):
        powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
        self.powers = powers
        self.small = np.searchsorted(
            powers, np.arange(1 << 20, dtype=np.uint64), side="right"
        ).astype(np.uint8)

    def bit_lengths(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and int(ids.max()) < len(self.small):
            return self.small[ids.astype(np.int64)]
        return np.searchsorted(self.powers, ids, side="right").astype(np.uint8)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, words per block, escapes per block); each block's escapes end its words."""
        n = len(ids)
        blocks = -(-n // BLOCK)
        if blocks == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        padded = np.zeros(blocks * BLOCK + 64, np.uint64)
        padded[:n] = ids
        bits = np.zeros((blocks, BLOCK + 64), np.uint8)
        bits[:, :BLOCK] = self.bit_lengths(padded[: blocks * BLOCK]).reshape(blocks, BLOCK)
        choice = _greedy_selectors(bits)
        # every block takes one word per step, all blocks at once
        size = np.full(blocks, BLOCK, np.int64)
        size[-1] = n - (blocks - 1) * BLOCK
        at = np.zeros(blocks, np.int64)
        live = np.arange(blocks)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            here = at[live]
            steps.append((live, here))
            here = here + _COUNTS[choice[live, here]]
            at[live] = here
            live = live[here < size[live]]
        # the word of step t is the t-th of its block
        block = np.concatenate([s[0] for s in steps])
        place = np.concatenate([s[1] for s in steps])
        n_words = np.bincount(block, minlength=blocks).astype(np.int64)
        step = np.repeat(np.arange(len(steps)), [len(s[0]) for s in steps])
        order = np.empty(len(block), np.int64)
        order[(np.cumsum(n_words) - n_words)[block] + step] = np.arange(len(block))
        block, place = block[order], place[order]
        selector = choice[block, place]
        first = block * BLOCK + place
        words = selector.astype(np.uint64) << _ID_BITS
        for s, (count, width) in SELECTORS.items():
            rows = np.flatnonzero(selector == s)
            if len(rows) == 0:
                continue
            # what lies past the end of a block is cut to the width and skipped by the decoder
            mask, index = np.uint64((1 << width) - 1), first[rows]
            packed = words[rows]
            for k in range(count):
                packed |= (padded[index + k] & mask) << np.uint64(k * width)
            words[rows] = packed
        escaped = np.flatnonzero(selector == ESCAPE)
        n_escapes = np.bincount(block[escaped], minlength=blocks).astype(np.int64)
        if len(escaped) == 0:
            return words, n_words, n_escapes
        out = np.zeros(len(words) + len(escaped), np.uint64)
        sizes = n_words + n_escapes
        starts = np.cumsum(sizes) - sizes
        out[ragged(starts, n_words)] = words
        out[ragged(starts + n_words, n_escapes)] = padded[first[escaped]]
        return out, sizes, n_escapes


def _greedy_selectors(bits: np.ndarray) -> np.ndarray:
    """For every position the selector that packs most ids from there on."""
    window = {1: bits}

    def widest(count: int) -> np.ndarray:
        """Most bits among ``count`` ids from each position (padding has none)."""
        if count not in window:
            half = count // 2
            low, high = widest(half), widest(count - half)
            moved = np.zeros_like(high)
            moved[:, :-half] = high[:, half:]
            window[count] = np.maximum(low, moved)
        return window[count]

    choice = np.zeros(bits.shape, np.uint8)
    for s in sorted(SELECTORS, reverse=True):  # fewest ids first, so the most ids win
        count, width = SELECTORS[s]
        np.copyto(choice, s, where=widest(count) <= width)
    return choice


def decode(
    words: np.ndarray, n_words: np.ndarray, n_escapes: np.ndarray, n: int
) -> np.ndarray:
    """The ``n`` ids of consecutive blocks, all of which are full but the last."""
    blocks = len(n_words)
    out = np.zeros(blocks * BLOCK + 64, np.uint64)
    if blocks == 0:
        return out[:0]
    starts = np.cumsum(n_words) - n_words
    packed = n_words - n_escapes
    block = np.repeat(np.arange(blocks), packed)
    raw = np.zeros(0, np.uint64)
    if n_escapes.any():
        raw = words[ragged(starts + packed, n_escapes)]
        words = words[ragged(starts, packed)]
    selector = (words >> _ID_BITS).astype(np.int64)
    counts = _COUNTS[selector]
    run = np.cumsum(counts) - counts
    heads = np.cumsum(packed) - packed
    place = block * BLOCK + run - run[heads[block]]
    for s, (count, width) in SELECTORS.items():
        rows = np.flatnonzero(selector == s)
        if len(rows) == 0:
            continue
        mask = np.uint64((1 << width) - 1)
        room = BLOCK - place[rows] % BLOCK
        for k in range(count):
            inside = room > k
            values = (words[rows] >> np.uint64(k * width)) & mask
            out[place[rows][inside] + k] = values[inside]
    escaped = np.flatnonzero(selector == ESCAPE)
    out[place[escaped]] = raw
    return out[:n]
