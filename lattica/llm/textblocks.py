"""Vectorised words of Arrow text columns.

Works on the UTF-8 bytes of a column, in blocks of whole texts of about BLOCK bytes (one text at least), so memory
follows the block and the longest text, not the batch. A word's identity is a 64-bit hash of its bytes after
lower-casing A-Z: a polynomial with random byte values over 2**64, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACES = (0x20, *range(0x09, 0x0E))


def is_word_table() -> np.ndarray:
    """True for bytes of words: everything but blank and 0x09 to 0x0D."""
    table = np.ones(256, bool)
    table[list(_SPACES)] = False
    return table


def is_letter_table() -> np.ndarray:
    """True for ASCII letters and every byte of a character beyond ASCII."""
    table = np.zeros(256, bool)
    table[65:91] = table[97:123] = table[128:] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def _byte_values() -> np.ndarray:
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    return values[lower_table()]


_VALUES = _byte_values()
_WORD = is_word_table()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            size = max(n, 2 * BLOCK)
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", inverse)):
                    a = np.full(size, base, np.uint64)
                    a[0] = 1
                    setattr(cls, name, np.cumprod(a))
        return cls.up, cls.down


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and UTF-8 bytes of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, data


def blocks(offsets: np.ndarray, data: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets from 0, bytes) of runs of whole texts."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n), offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[min(end, n)]]
        row = end


def word_spans(offsets: np.ndarray, data: np.ndarray, table: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and for each text the number of words before it (n + 1)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = table[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    opened = inside & ~before
    closed = before & ~inside
    joined = cuts[inside[cuts] & before[cuts]]  # a text's last word meets the next one's first
    opened[joined] = closed[joined] = True
    starts = np.flatnonzero(opened)
    return starts, np.flatnonzero(closed), np.searchsorted(starts, offsets)


def word_hashes(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """64-bit hash of each word."""
    up, down = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def hash_words(words: list[str]) -> np.ndarray:
    """word_hashes of given words, each as a text of its own; a word must have no blanks."""
    offsets, data = as_bytes(pa.array(words, pa.string()))
    return np.concatenate([word_hashes(offs[:-1], offs[1:], part) for _, _, offs, part in blocks(offsets, data)]) if words else np.zeros(0, np.uint64)


class Prefixes:
    """Hashes of whole words and of their first k bytes, from one running sum over a block."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray):
        up, self.down = _Powers.upto(len(data) + 1)
        self.starts, self.ends = starts, ends
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[: len(data)], out=self.sums[1:])
        self.base, self.scale = self.sums[starts], self.down[starts]

    def whole(self) -> np.ndarray:
        return mix((self.sums[self.ends] - self.base) * self.scale)

    def first(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words of more than k bytes, and the hashes of their first k; never equal to a whole word's."""
        at = np.flatnonzero(self.ends - self.starts > k)
        return at, mix((self.sums[self.starts[at] + k] - self.base[at]) * self.scale[at] + np.uint64(k))


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Bytes with the accented capitals of Latin-1 (UTF-8: C3 80 to C3 9E) lower-cased."""
    up = np.flatnonzero(data[:-1] == 0xC3) + 1
    up = up[(data[up] >= 0x80) & (data[up] <= 0x9E)]
    if len(up):
        data = data.copy()
        data[up] += 0x20
    return data
