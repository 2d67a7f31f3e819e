"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Documents and test items are sequences of lower-cased words (runs of letters and digits). Windows of `SEED` words of all
items are the seeds; a document meets an item if they share one. For each such pair the tiles are found: the longest
matches of unmarked words are marked first, then shorter ones, down to `SEED` words, each word at most once on either side.
The share of an item's words under tiles is its coverage, whatever the order of the tiles, so that a passage whose
sentences were shuffled counts as well.

Items are broadcast in blocks of at most `BLOCK_ITEMS_BYTES` of text; each block is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import textbytes as tb
from tesserae.llm.shared import broadcast, filter_rows, map_batches, ship, texts_of
from tesserae.llm.toxicity import letters_and_digits, words_of

SEED = 5
COVERAGE = 0.6
FIRST_LENGTH = 20
BLOCK_ITEMS_BYTES = 16 << 20


def _window_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(max(0, len(tokens) - length + 1), np.uint64)
    power = 1
    for i in range(length):
        out += tokens[i : len(tokens) - length + 1 + i] * np.uint64(power)
        power = power * tb.BASE % (1 << 64)
    return out


def _open_windows(marked: np.ndarray, length: int) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(sums[length:] == sums[:-length])


def tiles(pattern: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in pattern, place in text, length) of two sequences of word hashes, longest first; ties go to
    the smallest places. A zero in `text` matches nothing."""
    marked_p, marked_t = np.zeros(len(pattern), bool), text == 0
    found: list[tuple[int, int, int]] = []
    length = max(least, min(FIRST_LENGTH, len(pattern), len(text)))
    while len(pattern) >= least and len(text) >= least:
        matches = _matches(pattern, text, marked_p, marked_t, length)
        longest = max((m[0] for m in matches), default=0)
        if longest > 2 * length:
            length = longest
            continue
        for size, p, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if marked_p[p : p + size].any() or marked_t[t : t + size].any():
                continue
            marked_p[p : p + size] = marked_t[t : t + size] = True
            found.append((p, t, size))
        if any(size >= length for size, _, _ in _matches(pattern, text, marked_p, marked_t, length)):
            continue  # parts of occluded matches that are still as long as this
        if length == least:
            break
        length = max(least, length // 2)
    return found


def _matches(pattern, text, marked_p, marked_t, length: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, place in pattern, place in text) of at least `length` unmarked words."""
    if len(pattern) < length or len(text) < length:
        return []
    own = _open_windows(marked_p, length)
    other = _open_windows(marked_t, length)
    if not len(own) or not len(other):
        return []
    hp, ht = _window_hashes(pattern, length)[own], _window_hashes(text, length)[other]
    order = np.argsort(hp, kind="stable")
    lo, hi = np.searchsorted(hp[order], ht, "left"), np.searchsorted(hp[order], ht, "right")
    n = hi - lo
    t = np.repeat(other, n)
    p = own[order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]]
    good = (pattern[p] == text[t]) & (pattern[p + length - 1] == text[t + length - 1])
    p, t = p[good], t[good]
    # windows that follow each other on a diagonal are one match
    order = np.lexsort((p, t - p))
    p, t = p[order], t[order]
    starts = np.ones(len(p), bool)
    starts[1:] = ((t - p)[1:] != (t - p)[:-1]) | (np.diff(p) != 1)
    first = np.flatnonzero(starts)
    size = np.diff(np.append(first, len(p))) + length - 1
    return list(zip(size.tolist(), p[first].tolist(), t[first].tolist()))


class Items:
    """A block of test items: their words and the seeds of all of them, sorted."""

    def __init__(self, ids: list[int | None], texts: pa.Array) -> None:
        self.ids = ids
        found = tb.word_list(texts, letters_and_digits)
        self.words, self.offsets = found.hashes, found.offsets
        seeds, whole = tb.word_windows(self.words, self.offsets, SEED)
        pairs = np.unique(np.stack([seeds[whole], tb.document_of(self.offsets)[whole].astype(np.uint64)]), axis=1)
        self.seeds, self.item = pairs[0], pairs[1].astype(np.int64)

    def of(self, i: int) -> np.ndarray:
        return self.words[self.offsets[i] : self.offsets[i + 1]]

    def compare(self, block: tb.Block) -> Iterator[tuple[int, int, int, int]]:
        """(document of the block, item, tiled words, tiles) for each pair that shares a seed."""
        if not len(self.seeds):
            return
        found, words, _ = words_of(block)
        windows, whole = tb.word_windows(words, found.offsets, SEED)
        at = np.minimum(np.searchsorted(self.seeds, windows), len(self.seeds) - 1)
        hit = np.flatnonzero((self.seeds[at] == windows) & whole)
        if not len(hit):
            return
        doc = np.searchsorted(found.offsets, hit, "right") - 1
        for d in np.unique(doc):
            places = hit[doc == d] if len(hit) < 10_000 else hit[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
            lo, hi = np.searchsorted(self.seeds, windows[places], "left"), np.searchsorted(self.seeds, windows[places], "right")
            # only words under seeds can be in a tile; a zero keeps apart what isn't adjacent
            covered = np.unique((places[:, None] + np.arange(SEED)).ravel())
            gaps = np.flatnonzero(np.diff(covered) > 1) + 1
            text = np.insert(words[covered], gaps, 0)
            items = np.unique(np.concatenate([self.item[a:b] for a, b in sorted(set(zip(lo.tolist(), hi.tolist())))]))
            for i in items:
                made = tiles(self.of(i), text)
                yield int(d), int(i), sum(size for _, _, size in made), len(made)


def coverage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`(doc_id, item_id, n_words, n_tiled, n_tiles)` for each row of `docs(doc_id, text)` and each test item of
    `items(item_id, text)` that shares a run of `SEED` words with it.

    Null and empty texts share nothing, nor do items of fewer than `SEED` words. An item without an id counts like any other
    and gives a null `item_id`. Repeated rows give repeated results. Other
    columns are not looked at; an empty table on either side gives an empty result. Hashes of words stand for words.
    """
    docs = texts_of(docs)
    schema = "doc_id long, item_id long, n_words long, n_tiled long, n_tiles long"
    result = None
    for sent in _item_blocks(items):

        def compare(batch: pa.RecordBatch, sent=sent) -> Iterator[pa.RecordBatch]:
            own, ids, rows = sent.value, batch.column("doc_id").to_pylist(), []
            for block in tb.blocks(batch.column("text")):
                for d, i, tiled, n in own.compare(block):
                    rows.append((ids[block.first + d], own.ids[i], len(own.of(i)), tiled, n))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_words", "n_tiled", "n_tiles"])

        found = map_batches(docs, compare, schema)
        result = found if result is None else result.unionByName(found)
    return result


def _item_blocks(items: DataFrame) -> Iterator:
    """Broadcasts of all items, `BLOCK_ITEMS_BYTES` of text or so in each."""
    spark = items.sparkSession
    ship(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("text is not null")
    nbytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-nbytes // BLOCK_ITEMS_BYTES))
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).toArrow().sort_by("item_id")
        yield broadcast(spark, Items(part.column("item_id").to_pylist(), part.column("text").combine_chunks()))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """`(doc_id, item_id, n_tiled, coverage, contaminated)`: for each document that shares a seed with an item, the item it
    covers most (ties: more words, then the smallest id, a null id last), and whether that share reaches `threshold`."""
    share = F.col("n_tiled") / F.col("n_words")
    best = coverage(docs, items).withColumn("coverage", share).groupBy("doc_id").agg(
        F.max(F.struct("coverage", "n_tiled", (-F.col("item_id")).alias("item"))).alias("b")
    )
    return best.select(
        "doc_id", (-F.col("b.item")).alias("item_id"), "b.n_tiled", "b.coverage", (F.col("b.coverage") >= threshold).alias("contaminated")
    )


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """The rows of `docs`, with all columns, that cover no item up to `threshold`; rows and items without an id are judged alike."""
    for sent in _item_blocks(items):

        def keep(texts: pa.Array, sent=sent) -> np.ndarray:
            clean = np.ones(len(texts), bool)
            for block in tb.blocks(texts):
                for d, i, tiled, _ in sent.value.compare(block):
                    if tiled >= threshold * len(sent.value.of(i)):
                        clean[block.first + d] = False
            return clean

        docs = filter_rows(docs, keep)
    return docs
