"""Texts of Arrow batches as flat byte arrays, and their words, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# A numpy step works on about this many bytes of text at once; longer texts are a step of their own.
STEP_BYTES = 1 << 20

_MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def lower_table() -> np.ndarray:
    """Maps A-Z to a-z and leaves every other byte."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def letters_and_digits() -> np.ndarray:
    """True for the bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ in lower-cased text."""
    table = np.zeros(256, dtype=bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


def not_space() -> np.ndarray:
    """True for the bytes of words [^\\x20\\x09-\\x0D]+."""
    table = np.ones(256, dtype=bool)
    table[9:14] = table[32] = False
    return table


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    values = (values ^ (values >> _SHIFT)) * _MIX_1
    values = (values ^ (values >> _SHIFT)) * _MIX_2
    return values ^ (values >> _SHIFT)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes, one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


@dataclass
class Words:
    """Words of some rows: `starts` and `ends` in `data`, `rows[i]` the first word of row i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray

    def text(self, word: int, until: int) -> bytes:
        """Words [word, until) joined by single spaces."""
        return b" ".join(
            self.data[s:e].tobytes()
            for s, e in zip(self.starts[word:until], self.ends[word:until], strict=True)
        )


class _Powers:
    """Powers of the base and their inverses, as many as were asked for so far.

    Each process makes its own: functions of this package are pickled by value, and with the tables a
    driver that has read texts would write megabytes for every stage and executor.
    """

    def __init__(self):
        self.powers = self.inverses = np.zeros(0, np.uint64)

    def __reduce__(self):
        return _Powers, ()


_TABLES = _Powers()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.powers) < n:
        _TABLES.powers = np.cumprod(np.full(n, _BASE, np.uint64)) * np.uint64(_INVERSE)
        _TABLES.inverses = np.cumprod(np.full(n, _INVERSE, np.uint64)) * np.uint64(_BASE)
    return _TABLES.powers, _TABLES.inverses


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Words of rows that lie one after the other in `data` (offsets[0] is the first byte).

    A word's 64-bit hash depends on its lower-cased bytes alone.
    """
    base = int(offsets[0])
    text = lower_table()[data[base : int(offsets[-1])]]
    n = len(text)
    bounds = offsets - base
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(text, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    word = inside[text]
    first = word.copy()
    first[1:] &= ~word[:-1]
    # A word never spans two rows.
    cuts = bounds[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = word[cuts]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    before = cuts[cuts > 0] - 1
    last[before] = word[before]
    ends = np.flatnonzero(last) + 1
    powers, inverses = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[text] * powers[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverses[starts])
    return Words(text, starts, ends, np.searchsorted(starts, bounds), hashes)


def shingle_hashes(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a row, and the first run of each row.

    A row of fewer words, but not none, has its whole sequence as one.
    """
    counts = np.diff(words.rows)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    firsts = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(runs, out=firsts[1:])
    at = np.arange(firsts[-1]) + np.repeat(words.rows[:-1] - firsts[:-1], runs)
    length = np.repeat(np.minimum(counts, size), runs)
    total = np.zeros(firsts[-1], np.uint64)
    for k in range(size):
        part = words.hashes[np.minimum(at + k, max(len(words.hashes) - 1, 0))] if len(at) else total
        total = np.where(k < length, mix(total * np.uint64(_BASE) + part + np.uint64(k + 1)), total)
    return total, firsts


def prefix_hashes(words: Words, sizes: tuple[int, ...], whole: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per size: the words longer than that many bytes, and hashes of their first bytes.

    These differ from the hashes of whole words. With `whole` the words of just that many bytes.
    """
    n = len(words.data)
    powers, inverses = _power_tables(max(n, 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[words.data] * powers[:n], out=sums[1:])
    out, lengths = [], words.ends - words.starts
    for size in sizes:
        own = np.flatnonzero(lengths == size if whole else lengths > size)
        starts = words.starts[own]
        part = (sums[starts + size] - sums[starts]) * inverses[starts]
        out.append((own, mix(part + np.uint64(size * 2 + 1))))
    return out
