"""Whole texts as byte arrays: words, rolling hashes and sliding extrema in numpy, a few megabytes at a time.

An Arrow text column already is one run of UTF-8 bytes with offsets. The helpers here cut such a column into blocks of
whole documents and compute on all bytes of a block at once. A text longer than a block makes a block of its own.

Hashes are 64 bits wide: prefix sums of `TABLE[byte] * BASE**position` give the hash of any byte range by one subtraction
and one multiplication with the inverse power. They depend on the bytes alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = (1 << 20) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class _Powers:
    """Powers of the base and of its inverse, grown on demand and kept by the worker."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << (n - 1).bit_length()
            up, down = np.full(m, BASE, np.uint64), np.full(m, BASE_INVERSE, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


powers = _Powers()


@dataclass
class Block:
    """Whole documents side by side: rows `first` to `last` of a batch, their bytes, and where each one starts."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of whole documents; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield Block(first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return np.where((data - np.uint8(65)) < 26, data | np.uint8(32), data)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums for `range_hash`, with a leading zero."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * up[: len(data)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for every pair."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` bytes."""
    _, down = powers(len(sums))
    return mix((sums[width:] - sums[:-width]) * down[: len(sums) - width])


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Minimum or maximum over every `width` neighbours, in log(width) steps."""
    done, out = 1, values
    while done * 2 <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return best(out[:-rest], out[rest:]) if rest else out


@dataclass
class Words:
    """Words of a block: their byte ranges and, for each document, the range of its words."""

    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray


def words(block: Block, data: np.ndarray | None = None) -> Words:
    """The words `[^\\x20\\x09-\\x0D]+`; a word never crosses documents."""
    data = block.data if data is None else data
    inside = (data != 32) & ((data - np.uint8(9)) >= 5)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = block.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, block.offsets))


def document_of(offsets: np.ndarray) -> np.ndarray:
    """For each element, the number of the document it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


FACTORS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)


def word_windows(values: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` word hashes within a document (the run that starts at word i is entry i) and which are whole."""
    n = len(values)
    out = np.zeros(n, np.uint64)
    if n >= width:
        part = out[: n - width + 1]
        for i in range(width):
            part += values[i : n - width + 1 + i] * np.uint64(FACTORS[i % 5] + 2 * (i // 5))
        out[: n - width + 1] = mix(part)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return out, ends - np.arange(n) >= width


@dataclass
class WordList:
    """Words of any number of texts: hashes, byte ranges in `data`, and the range of words of each text."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray
    data: np.ndarray


def word_list(texts: pa.Array, prepare: Callable[[np.ndarray], np.ndarray]) -> WordList:
    """Words of all texts, block by block, after `prepare` has set what isn't part of a word to spaces."""
    parts, base, first = [], 0, 0
    for block in blocks(texts):
        data = prepare(block.data)
        found = words(block, data)
        hashes = range_hash(prefix_hash(data), found.start, found.end)
        parts.append((hashes, found.start + base, found.end + base, found.offsets[1:] + first, data))
        base, first = base + len(data), first + len(hashes)
    if not parts:
        none = np.zeros(0, np.int64)
        return WordList(none.astype(np.uint64), none, none, np.zeros(1, np.int64), none.astype(np.uint8))
    hashes, start, end, ends, data = (np.concatenate(x) for x in zip(*parts))
    return WordList(hashes, start, end, np.concatenate([[0], ends]), data)
