"""Words, byte hashes and anchors of many texts at once, as NumPy arrays inside a task.

A slice of a batch is one byte array and the offsets of its texts. Words are found with byte tables and
hashed with prefix sums of a polynomial, so no Python object is made per word. Slices hold about
``SLICE_BYTES`` bytes or one whole text, whichever is more; no text is ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

U64 = np.uint64
#: Odd multipliers of the polynomial hashes and, by position, of their lanes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MASK = (1 << 64) - 1


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags that is true for the bytes of the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: Bytes of ``[^\x20\x09-\x0D]+``.
PLAIN = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = ~byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_HASH = mix(np.arange(1, 257, dtype=U64) * U64(BASES[0]))


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, base, U64)
    down = np.full(size, pow(base, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, at least ``size`` of them."""
    return _powers(base, 1 << max(16, (size - 1).bit_length()))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums from which :func:`span` reads the hash of any run of ``values``."""
    up, _ = powers(base, len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the runs ``[start, end)``: equal for equal runs, wherever they stand."""
    _, down = powers(base, len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, data, offsets)`` of consecutive rows; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    texts = pc.fill_null(texts, "")
    rows = len(texts)
    if not rows:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + rows + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and len(body) else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where each text's words begin among them."""
    inside = table[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span(prefix(BYTE_HASH[data], BASES[0]), starts, ends, BASES[0])


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """For each unit, the number of the text that holds it."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


class Anchors:
    """Content-chosen places that stand for all windows of a length.

    Among the ``gram``-unit runs inside a window, the one with the smallest hash (the first of equal ones) is
    the window's anchor. Equal windows have equal anchors at equal places inside them, so windows can be
    compared group by group of equal anchors; about two anchors stand for ``window - gram + 2`` windows.

    ``at`` holds the anchors' places, ``low`` and ``high`` the first and last window that each stands for,
    ``row`` the text, ``gram`` the run's hash, and ``lane1``/``lane2`` the hash of the anchor's context: all
    units of all its windows together with their places around the anchor.
    """

    def __init__(self, units: np.ndarray, bounds: np.ndarray, window: int, gram: int):
        self.window = window
        self.sums = [prefix(units, base) for base in BASES]
        total = len(units)
        empty = np.zeros(0, np.int64)
        self.at = self.low = self.high = self.row = empty
        self.gram = self.lane1 = self.lane2 = np.zeros(0, U64)
        if total < window:
            return
        place = np.arange(total - gram + 1)
        grams = span(self.sums[0], place, place + gram, BASES[0])
        bits = U64(max(1, int(total).bit_length()))
        order = ((grams >> bits) << bits) | place.astype(U64)
        least = sliding_min(order, window - gram + 1)
        row = rows_of(bounds)
        starts = np.flatnonzero(np.arange(total) + window <= bounds[1:][row])
        if not len(starts):
            return
        anchor = (least[starts] & ((U64(1) << bits) - U64(1))).astype(np.int64)
        change = np.flatnonzero(np.diff(anchor, prepend=-1))
        self.at = anchor[change]
        self.low = starts[change]
        self.high = starts[np.append(change[1:], len(starts)) - 1]
        self.row = row[self.low]
        self.gram = grams[self.at]
        around = (self.at - self.low).astype(U64) << U64(32) | (self.high - self.low).astype(U64)
        self.lane1, self.lane2 = (
            mix(span(sums, self.low, self.high + window, base) ^ mix(around + U64(base)))
            for sums, base in zip(self.sums, BASES))

    def windows(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both hash lanes of the windows that begin at ``start``."""
        return tuple(span(sums, start, start + self.window, base) for sums, base in zip(self.sums, BASES))


def cover(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags of the places that lie in any of the ranges ``[start, end)``."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as the signed numbers Spark stores."""
    return values.view(np.int64)
