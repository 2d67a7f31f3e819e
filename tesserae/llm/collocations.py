"""Phrases of two to four words that occur together far more often than their parts explain, by direct-address tiling.

A phrase of k + 1 words is a pair of neighbouring phrases of k words that overlap, and it can be frequent only if both are. So
one step is applied three times: the frequent words (then pairs, then triples) are ranked by frequency, each text becomes a row of
ranks, and pairs of neighbouring ranks are counted. The pairs fall into square tiles of the table of all rank pairs; frequent
ranks are small, so most pairs meet in few tiles. A tile with many pairs is counted as a dense array with `bincount`; the pairs
of all other tiles are sorted and counted by runs. Spark adds up the counts of all tasks, and the frequent pairs are ranked again.

Only the `ranked` most frequent phrases of a step have ranks, so what is broadcast is bounded. If there are more, the others are named by their
hash, and a bitmap of fixed size tells tasks which hashes may be frequent. Their pairs are counted by sorting, and just as
exactly: the bitmap only spares pairs that can't be frequent.

Words and phrases of a language are identified by 63-bit hashes of the language and the words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import textbytes as tb
from tesserae.llm.shared import map_batches, map_partitions, stored

LONGEST = 4
MIN_COUNT = 30
TOP = 2_000
COVERED = 80
SCALE = 2_000_000
RANKED = 1 << 20
BITMAP = 1 << 27
TILE_BITS = 8
DENSE = 1 << 13
PAIRS = 1 << 20
DENSE_AT_ONCE = 32
SLICE_BYTES = 2 << 20
NOT_FREQUENT = -1
STOPS = b".,;:!?\n\x0b\x0c\r"
_stop = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
_breaks = np.zeros(256, bool)
_breaks[list(STOPS)] = True


def _prepare(data: np.ndarray) -> np.ndarray:
    """Lower-cased, with a line feed for every stop."""
    return np.where(_breaks[data], np.uint8(10), tb.lower(data))


def _combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the phrase whose first words have hash a and whose last words have hash b."""
    first, second = (np.uint64(f) for f in tb.FACTORS[:2])
    return (tb.mix(a.astype(np.uint64) * first + b.astype(np.uint64) * second) >> np.uint64(1)).astype(np.int64)


@dataclass
class Sequence:
    """Words of some texts: 63-bit hashes, the piece each one is in, its language, and its bytes."""

    hashes: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    words: tb.WordList

    def phrases(self, length: int) -> np.ndarray:
        """Hashes of all runs of `length` words, also those that cross pieces."""
        found = self.hashes
        for _ in range(length - 1):
            found = _combine(found[:-1], found[1:])
        return found

    def spelled(self, at: np.ndarray) -> pa.Array:
        """The words at some places."""
        ends = np.stack([self.words.start, self.words.end], 1).reshape(-1).astype(np.int64)
        spans = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(self.words.data)])
        return spans.take(pa.array(2 * at)).cast(pa.binary()).cast(pa.string())


def _bounded(langs: list[str], texts: pa.Array) -> Iterator[tuple[list[str], pa.Array]]:
    """Runs of rows of a few megabytes; a longer text is cut after stops, where no phrase reaches across."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(langs):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        if ends[last - 1] - before <= SLICE_BYTES:
            yield langs[first:last], texts.slice(first, last - first)
        else:
            raw, at = texts[first].as_py().encode(), 0
            while at < len(raw):
                stop = _stop.search(raw, at + SLICE_BYTES)
                end = stop.end() if stop else len(raw)
                yield [langs[first]], pa.array([raw[at:end]]).cast(pa.string())
                at = end
        first = last


def sequences(batch: pa.RecordBatch) -> Iterator[tuple[list[str], Sequence]]:
    """The languages and the words of a batch, a few megabytes of text at a time."""
    codes = batch.column("lang").dictionary_encode()
    names = codes.dictionary.to_pylist()
    keys = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], np.uint64)
    for langs, texts in _bounded(codes.indices.to_pylist(), batch.column("text")):
        words = tb.word_list(texts, _prepare)
        doc = tb.document_of(words.offsets)
        lang = np.array(langs, np.int64)[doc]
        stops = np.cumsum(words.data == 10)
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (stops[words.start[1:]] != stops[words.start[:-1]])
        hashes = (tb.mix(words.hashes ^ keys[lang]) >> np.uint64(1)).astype(np.int64)
        yield names, Sequence(hashes, np.cumsum(fresh), lang, words)


@dataclass
class Ranks:
    """Names of the frequent phrases of one length: ranks for the most frequent ones, hashes for the rest."""

    hashes: np.ndarray
    ranks: np.ndarray
    bitmap: np.ndarray
    complete: bool

    def names(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each hash, or `-2 - hash` if it has none but may be frequent, or NOT_FREQUENT."""
        out = np.full(len(hashes), NOT_FREQUENT, np.int64)
        place = hashes & (len(self.bitmap) * 64 - 1)
        maybe = np.flatnonzero(self.bitmap[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1))
        asked = hashes[maybe]
        known = np.zeros(len(asked), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
            known = self.hashes[at] == asked
            out[maybe[known]] = self.ranks[at[known]]
        if not self.complete:
            out[maybe[~known]] = -2 - asked[~known]
        return out


def rank(phrases: DataFrame, ranked: int = RANKED, bits: int = BITMAP) -> Ranks:
    """Ranks by falling count of `phrases(h, a)`. At most `ranked` hashes and `bits` bits reach the driver."""
    top = phrases.orderBy(F.desc("a"), "h").limit(ranked + 1).select("h").toArrow().column("h").to_numpy()
    complete, hashes = len(top) <= ranked, top[:ranked]
    order = np.argsort(hashes)
    if complete:
        size = min(bits, max(1 << 16, 1 << (16 * len(hashes)).bit_length()))
        place = hashes & (size - 1)
        bitmap = np.zeros(size // 64, np.uint64)
        np.bitwise_or.at(bitmap, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    else:
        place = F.col("h").bitwiseAND(F.lit(bits - 1))
        one = F.expr("shiftleft(1L, CAST(h & 63 AS INT))")
        found = phrases.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
        bitmap = np.zeros(bits // 64, np.uint64)
        bitmap[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return Ranks(hashes[order], order.astype(np.int64), bitmap, complete)


def _runs(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal entries in sorted columns."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(fresh)
    return at, np.diff(at, append=len(fresh))


def count_tiles(a: np.ndarray, b: np.ndarray, bits: int = TILE_BITS, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of ranks and their counts; tiles of `dense` or more pairs are counted as arrays, the others by sorting.

    An address is the tile's row, its column and the cell in it; ranks have 31 bits at most.
    """
    low, cells, width = (1 << bits) - 1, 1 << 2 * bits, 31 - bits
    address = (((a >> bits) << width | b >> bits) << 2 * bits) | (a & low) << bits | b & low
    tile = address >> 2 * bits
    ordered = np.sort(tile)
    at, length = _runs([ordered])
    full = ordered[at[length >= dense]]
    found, counts = [], []
    slot = np.searchsorted(full, tile)
    is_dense = full[np.minimum(slot, len(full) - 1)] == tile if len(full) else np.zeros(len(tile), bool)
    for first in range(0, len(full), DENSE_AT_ONCE):
        here = is_dense & (slot >= first) & (slot < first + DENSE_AT_ONCE)
        table = np.bincount((slot[here] - first) * cells + (address[here] & cells - 1))
        filled = np.flatnonzero(table)
        found.append(full[first + filled // cells] << 2 * bits | filled % cells)
        counts.append(table[filled])
    rest = np.sort(address[~is_dense])
    if len(rest):
        at, length = _runs([rest])
        found.append(rest[at])
        counts.append(length)
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    found, counts = np.concatenate(found), np.concatenate(counts)
    high, inside = found >> 2 * bits, found & cells - 1
    return (high >> width) << bits | inside >> bits, (high & (1 << width) - 1) << bits | inside & low, counts


def _count_named(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ranked = (a >= 0) & (b >= 0)
    found = count_tiles(a[ranked], b[ranked])
    if ranked.all():
        return found
    a, b = a[~ranked], b[~ranked]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at, length = _runs([a, b])
    return tuple(np.concatenate(x) for x in zip(found, (a[at], b[at], length)))


def _texts(docs: DataFrame) -> DataFrame:
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    return docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """`(lang, word, h, a)`: all words with their counts, and per language a row without a word: the number of all words."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for names, found in sequences(batch):
            hashes, first, counts = np.unique(found.hashes, return_index=True, return_counts=True)
            if not len(hashes):
                continue
            totals = np.bincount(found.lang, minlength=len(names))
            languages = pa.array(names, pa.string()).take(pa.array(np.concatenate([found.lang[first], np.arange(len(names))])))
            words = pa.concat_arrays([found.spelled(first), pa.nulls(len(names), pa.string())])
            every = np.concatenate([hashes, np.full(len(names), -1)])
            yield pa.record_batch([languages, words, pa.array(every), pa.array(np.concatenate([counts, totals]))], ["lang", "word", "h", "a"])

    found = map_batches(_texts(docs), run, "lang string, word string, h long, a long")
    return found.groupBy("lang", "word", "h").agg(F.sum("a").alias("a"))


def pair_counts(docs: DataFrame, ranks: Broadcast, length: int, pairs: int = PAIRS) -> DataFrame:
    """`(first, second, a)`: counts of neighbouring frequent phrases of `length` words, by name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting, held = ranks.value, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            first, second, counts = _count_named(*(np.concatenate(x) for x in zip(*waiting)))
            for at in range(0, len(first), 1 << 17):
                columns = [pa.array(x[at : at + (1 << 17)]) for x in (first, second, counts)]
                yield pa.record_batch(columns, ["first", "second", "a"])

        for batch in batches:
            for _, found in sequences(batch):
                if len(found.hashes) <= length:
                    continue
                names = own.names(found.phrases(length))
                pair = found.piece[:-length] == found.piece[length:]
                pair &= (names[:-1] != NOT_FREQUENT) & (names[1:] != NOT_FREQUENT)
                waiting.append((names[:-1][pair], names[1:][pair]))
                held += int(pair.sum())
                if held >= pairs:
                    yield from flush()
                    waiting, held = [], 0
        if held:
            yield from flush()

    found = map_partitions(_texts(docs), run, "first long, second long, a long")
    return found.groupBy("first", "second").agg(F.sum("a").alias("a"))


def _with_column(df: DataFrame, name: str, function: Callable[..., np.ndarray], *inputs: str) -> DataFrame:
    """Add a long computed from long columns."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = function(*(batch.column(c).to_numpy(zero_copy_only=False) for c in inputs))
        yield pa.record_batch([*batch.columns, pa.array(made, pa.int64())], [*batch.schema.names, name])

    return map_batches(df, run, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def frequent_phrases(
    docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, ranked: int = RANKED, bits: int = BITMAP
) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language `(lang, n)`, and for each length up to `longest` the phrases found `min_count` times or more:
    `(h, lang, phrase, last, a, heads, tails, first, second)`. `heads` are the counts of its first 1, 2, ... words, `tails` those
    of its last 1, 2, ... words, `first` and `second` the hashes of the phrases without the last and without the first word."""
    counts = stored(word_counts(docs).where((F.col("a") >= min_count) | F.col("word").isNull()), "words")
    totals = counts.where("word is null").select("lang", F.col("a").alias("n"))
    words = counts.where((F.col("a") >= min_count) & F.col("word").isNotNull()).select(
        "h", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", F.array("a").alias("heads"), F.array("a").alias("tails"),
        F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("second"),
    )
    found = [words]
    for length in range(1, longest):
        ranks = docs.sparkSession.sparkContext.broadcast(rank(found[-1], ranked, bits))
        named = stored(_with_column(found[-1], "name", lambda h, ranks=ranks: ranks.value.names(h), "h"), "named")
        pairs = pair_counts(docs, ranks, length).where(F.col("a") >= min_count)
        pairs = stored(pairs.select(F.col("first").alias("x"), F.col("second").alias("y"), "a"), "pairs")
        ranks.destroy()
        left = named.select(F.col("name").alias("x"), F.col("h").alias("first"), "lang", F.col("phrase").alias("begin"), "heads")
        right = named.select(F.col("name").alias("y"), F.col("h").alias("second"), "last", "tails")
        longer = pairs.join(left, "x").join(right, "y")
        longer = _with_column(longer, "h", _combine, "first", "second")
        found.append(stored(longer.select(
            "h", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "a",
            F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"), "first", "second",
        ), "phrases"))
    return totals, found


def weakest_cut(length: int) -> Column:
    """The cut with the lowest score, the first of these: (score, k, l, r)."""
    cuts = []
    for k in range(1, length):
        l, r = F.col("heads")[k - 1], F.col("tails")[length - k - 1]
        ratio = F.expr(f"(CAST(a AS DECIMAL(20, 0)) * {SCALE}) DIV (CAST(heads[{k - 1}] AS DECIMAL(20, 0)) + tails[{length - k - 1}])")
        cuts.append(F.struct(ratio.cast("long").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(
    docs: DataFrame, top: int = TOP, longest: int = LONGEST, min_count: int = MIN_COUNT, covered: int = COVERED, ranked: int = RANKED, bits: int = BITMAP
) -> DataFrame:
    """`(lang, rank, phrase, a, l, r, n, score)`: the `top` phrases of each language in `docs(lang, text)`.

    Words are split at blanks and tabs inside pieces between stops (`.,;:!?` and line ends), with A-Z lower-cased. `a` counts a
    phrase, `l` and `r` the two parts of its weakest cut, `n` all words of the language; `score` is `floor(2000000 a / (l + r))`.
    A phrase is left out if a longer candidate contains it with `covered` of 100 of its occurrences or more: one that is longer
    by a word then does, too, so only those are looked at. Ordered by score and count (falling) and phrase (by bytes), so ties
    have one order. A null text counts as empty, a null language as `und`; repeated rows count each time; other
    columns are not looked at; an empty table gives an empty result.
    """
    totals, found = frequent_phrases(docs, longest, min_count, ranked, bits)
    rows = None
    for length in range(2, longest + 1):
        scored = found[length - 1].withColumn("cut", weakest_cut(length))
        if length < longest:
            longer = found[length]
            around = longer.select(F.col("first").alias("h"), F.col("a").alias("m")).unionAll(longer.select("second", "a"))
            scored = scored.join(around.groupBy("h").agg(F.max("m").alias("m")), "h", "left")
            scored = scored.where(F.col("m").isNull() | (F.col("m") * F.lit(100) < F.col("a") * F.lit(covered)))
        scored = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
        rows = scored if rows is None else rows.unionAll(scored)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
