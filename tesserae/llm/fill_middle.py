"""Fill-in-the-middle: texts are cut in three and put into an order in which a model learns to fill the gap.

Cuts stand between tokens: blanks with the word after them, or blanks at the end of the text. A block of texts becomes one row
of character classes, kept in a wavelet matrix: three bit vectors with counts. The rank of a class up to any place takes three
look-ups, so token ends and characters before a place are sums of ranks, and the end of the k-th token is found by bisection,
for all texts of a block at once. The matrix works on UTF-8 bytes; a character counts at its first byte.

The output is one string. `restored_text` gives the text back from it by string functions alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import textbytes as tb
from tesserae.llm.shared import map_batches, texts_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# character classes
BLANK, BLANK_LAST, SINGLE, SINGLE_LAST, LEAD, FOLLOW, FOLLOW_LAST = range(7)
LEVELS = 3
TOKEN_ENDS = (BLANK_LAST, SINGLE_LAST, FOLLOW_LAST)
FOLLOWERS = (FOLLOW, FOLLOW_LAST)


class Bits:
    """A bit vector with the number of ones before each word of 64 bits."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(packed) // 8 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """Counts of any class before any place, in one look-up per bit of the class."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(levels - 1, -1, -1):
            ones = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(ones), len(ones) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        start, end = np.zeros_like(at), at
        for shift, bits, zeros in self.levels:
            low, high = bits.rank(start), bits.rank(end)
            start, end = (zeros + low, zeros + high) if symbol >> shift & 1 else (start - low, end - high)
        return end - start

    def ranks(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, at) for s in symbols)


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class of each byte of the texts that lie side by side in `data`."""
    blank = (data == 32) | ((data - np.uint8(9)) < 5)
    last = np.zeros(len(data), bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    ends = last.copy()
    ends[:-1] |= ~blank[:-1] & blank[1:]
    follow = (data & 0xC0) == 0x80
    out = np.full(len(data), SINGLE, np.uint8)
    out[data >= 0xC0] = LEAD
    out[follow] = FOLLOW
    out[blank] = BLANK
    return out + ends * (out != LEAD)


def token_cuts(matrix: WaveletMatrix, offsets: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """For each text the place after its first `tokens` tokens."""
    low, high = offsets[:-1].copy(), offsets[1:].copy()
    wanted = matrix.ranks(TOKEN_ENDS, low) + tokens
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        enough = matrix.ranks(TOKEN_ENDS, middle) >= wanted
        high = np.where(open_ & enough, middle, high)
        low = np.where(open_ & ~enough, middle + 1, low)
    return low


def draws(doc_ids: list[int | None], seed: int) -> np.ndarray:
    """Four 32-bit numbers for each id, from a digest of the seed and the id."""
    made = (hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in doc_ids)
    return np.frombuffer(b"".join(made), ">u4").reshape(-1, 4).astype(np.int64)


def _cut_block(block: tb.Block, drawn: np.ndarray, rate: int, spm: int) -> Iterator[tuple]:
    matrix = WaveletMatrix(classes(block.data, block.offsets))
    counts = np.diff(matrix.ranks(TOKEN_ENDS, block.offsets))
    a, b = drawn[:, 0] % (counts + 1), drawn[:, 1] % (counts + 1)
    cuts = np.stack([block.offsets[:-1], *(token_cuts(matrix, block.offsets, k) for k in (np.minimum(a, b), np.maximum(a, b)))])
    prefix, middle = np.diff(cuts - matrix.ranks(FOLLOWERS, cuts), axis=0)
    cuts -= block.offsets[:-1]
    for i, n in enumerate(counts.tolist()):
        text = block.text(i).decode()
        if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or drawn[i, 2] % 100 >= rate:
            yield n, "plain", None, None, text
            continue
        raw = block.text(i)
        head, mid, tail = (raw[x:y].decode() for x, y in ((0, cuts[1, i]), (cuts[1, i], cuts[2, i]), (cuts[2, i], len(raw))))
        form = "spm" if drawn[i, 3] % 100 < spm else "psm"
        first = f"{SUFFIX}{tail}{PREFIX}{head}" if form == "spm" else f"{PREFIX}{head}{SUFFIX}{tail}"
        yield n, form, int(prefix[i]), int(middle[i]), f"{first}{MIDDLE}{mid}"


def fill_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """`(doc_id, n, form, prefix_chars, middle_chars, output)` per row of `docs(doc_id, text)`.

    `n` is the number of tokens. `rate` of 100 texts are cut, `spm` of 100 of these have the suffix first (`spm`), the others
    the prefix (`psm`). The id decides on the form and both cuts, so rows of one id are cut at the same numbers; a missing id
    counts as an empty one. A text stays as it is (`plain`, with null lengths) if it is empty, null or holds one of the three
    marks. Rows keep their number; other columns are not looked at; an empty table gives an empty result.
    """
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id")
        drawn = draws(ids.to_pylist(), seed)
        for block in tb.blocks(batch.column("text")):
            rows = zip(*_cut_block(block, drawn[block.first : block.last], rate, spm))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(values, kind) for values, kind in zip(rows, kinds)]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            yield pa.record_batch([ids.slice(block.first, block.last - block.first), *columns], names)

    return map_batches(texts_of(docs), run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored_text(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text from which `fill_middle` made an output. A text that was cut holds no mark, so the output holds each mark once."""
    whole, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(whole, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    spm, psm = F.concat(parts[2], parts[3], parts[1]), F.concat(parts[1], parts[3], parts[2])
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(whole)
