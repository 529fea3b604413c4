"""Words of Arrow string columns as NumPy arrays, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text makes a slice of its own.
SLICE_BYTES = 1 << 19
_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def byte_table(pattern: str) -> np.ndarray:
    """256 flags: which bytes belong to words. ``pattern``: 'space' or 'alnum'."""
    inside = np.ones(256, bool)
    if pattern == "space":
        inside[[0x20, *range(0x09, 0x0E)]] = False
    elif pattern == "alnum":
        for lo, hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
            inside[lo : hi + 1] = False
    else:
        raise ValueError(pattern)
    return inside


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, from 0) and the UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about ``limit`` bytes of text; every row in one piece."""
    if not batch.num_rows:
        return
    offsets, _ = text_bytes(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """Words of some texts: byte spans ``start``/``end`` in ``raw``; words ``first[d]:first[d+1]`` are of text d."""

    def __init__(self, column: pa.Array, inside: np.ndarray, lower: bool):
        self.offsets, raw = text_bytes(column)
        self.raw = LOWER[raw] if lower else raw
        within = inside[self.raw]
        begin, stop = within.copy(), within.copy()
        if within.size:
            begin[1:] &= ~within[:-1]
            stop[:-1] &= ~within[1:]
            edges = self.offsets[(self.offsets > 0) & (self.offsets < within.size)]
            begin[edges] = within[edges]
            stop[edges - 1] = within[edges - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self._sums: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def joined(self, kept: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words (those of the mask ``kept``) of each text joined by one space, all texts in a row, and the words' spans there."""
        first, start, end = self.first, self.start, self.end
        if kept is not None:
            first = np.concatenate(([0], np.cumsum(kept)))[first]
            start, end = start[kept], end[kept]
        after = np.ones(start.size, np.int64)  # a space follows each word but the last of a text
        after[first[1:][np.diff(first) > 0] - 1] = 0
        inside = np.zeros(self.raw.size + 1, np.int8)
        inside[start] = 1
        inside[end] -= 1
        inside = np.cumsum(inside, dtype=np.int8).view(bool)
        gaps = end[after == 1]
        out = np.append(self.raw, np.uint8(0))
        out[gaps] = 0x20
        inside[gaps] = True
        size = end - start + after
        begin = np.cumsum(size) - size
        return out[inside].tobytes(), begin, begin + end - start

    def hashes(self, beginning: int = 0) -> np.ndarray:
        """A mixed 64-bit hash for each word: the same word, the same hash, in any batch.

        ``beginning``: of so many first bytes instead, where a word has more, and unlike that of a word.
        """
        power, inverse = powers(_BASE, self.raw.size + 1)
        if self._sums is None:
            self._sums = prefix(self.raw.astype(np.uint64) + np.uint64(1), power)
        end = np.minimum(self.start + beginning, self.end) if beginning else self.end
        h = (self._sums[end] - self._sums[self.start]) * inverse[self.start]
        return mix(h ^ ((end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(beginning))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``size`` powers of an odd base and of its inverse modulo 2**64; the longest made so far are kept."""
    if base not in _POWERS or _POWERS[base][0].size < size:
        room = 1 << max(12, (size - 1).bit_length())
        _POWERS[base] = (_power_table(base, room), _power_table(pow(base, -1, 1 << 64), room))
    return _POWERS[base]


def _power_table(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    done = 1
    while done < size:  # doubling: the next powers are the first ones times base**done
        n = min(done, size - done)
        np.multiply(out[:n], np.uint64(pow(base, done, 1 << 64)), out=out[done : done + n])
        done += n
    return out


def prefix(values: np.ndarray, power: np.ndarray) -> np.ndarray:
    sums = np.zeros(values.size + 1, np.uint64)
    np.cumsum(values * power[: values.size], out=sums[1:])
    return sums


class Windows:
    """Hashes of runs of ``size`` consecutive words, from one prefix sum over the words' hashes."""

    def __init__(self, words: np.ndarray, base: int = 0xA0761D6478BD642F):
        self.n, self.power = words.size, powers(base, words.size + 1)
        self.sums = prefix(words, self.power[0])

    def at(self, start: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.power[1][start] + np.uint64(1) * np.asarray(size).astype(np.uint64))


def starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of ``size`` words that stay within one text, and the text of each."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(counts.size), counts)
    begin = np.cumsum(counts) - counts
    return np.arange(text.size) - begin[text] + first[:-1][text], text


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
