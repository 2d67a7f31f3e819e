"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent.

A text is the average of the vectors of its subwords, the 2- to 5-byte grams of `<word>`, and a linear layer gives the
languages. Training sees random runs of 3 to 60 words, so that short texts are covered, of at most `TRAIN_ROWS` documents a
language chosen by hash. A fifth of those documents is kept out to fit a temperature and the level under which a
prediction is called doubtful: `REJECT` of the right predictions fall under it.

Since everything before the softmax is linear, scoring adds up one row of class scores per subword, once per distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import textbytes as tb
from tesserae.llm.shared import broadcast, map_batches, texts_of
from tesserae.scale import join_sized
from tesserae.llm.toxicity import Lexicon

TRAIN_ROWS = 800
GRAMS = (2, 3, 4, 5)
BITS, DIM = 16, 16
STEPS, BATCH, RATE = 600, 64, 4.0
REJECT = 0.01
UNKNOWN = "und"


def _letters(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 128) | ((data - np.uint8(97)) < 26), data, np.uint8(32))


def _words(texts: pa.Array) -> tb.WordList:
    """Runs of letters, lower-cased."""
    return tb.word_list(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())), _letters)


def _subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all subwords of the given words, the word of each, and how many a word has."""
    lexicon = Lexicon(data, start, end)
    parts = [lexicon.grams(w) for w in GRAMS]
    bucket = np.concatenate([(g >> np.uint64(64 - BITS)).astype(np.int64) for g, _ in parts])
    owner = np.concatenate([o for _, o in parts])
    return bucket, owner, np.bincount(owner, minlength=len(start))


class Model:
    """Class scores per subword, temperature and level of doubt."""

    def __init__(self, languages: list[str], table: np.ndarray, level: np.ndarray, heat: float = 1.0, doubt: float = 0.0) -> None:
        self.languages, self.table, self.level, self.heat, self.doubt = languages, table.astype(np.float32), level, heat, doubt

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Class scores of each text before the softmax; texts without words get the level alone."""
        found = _words(texts)
        hashes, data = found.hashes, found.data
        n, k = len(found.offsets) - 1, len(self.languages)
        if not len(hashes):
            return np.tile(self.level, (n, 1))
        distinct, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        bucket, owner, many = _subwords(data, found.start[first], found.end[first])
        doc = tb.document_of(found.offsets)
        total = np.maximum(np.bincount(doc, many[word], n), 1)
        out = np.empty((n, k))
        for c in range(k):
            of_word = np.bincount(owner, self.table[bucket, c], len(distinct))
            out[:, c] = np.bincount(doc, of_word[word], n) / total + self.level[c]
        return out

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The best class of each text and its probability."""
        z = self.scores(texts) / self.heat
        z = np.exp(z - z.max(1, keepdims=True))
        p = z / z.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    for block in tb.blocks(texts):
        yield texts.slice(block.first, block.last - block.first)


def train(texts: pa.Array, languages: list[str], label: np.ndarray, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    k = len(languages)
    if k < 2:
        return Model(languages, np.zeros((1 << BITS, max(k, 1))), np.zeros(max(k, 1)))
    held = np.zeros(len(label), bool)
    for c in range(k):
        own = np.flatnonzero(label == c)
        if len(own) >= 5:
            held[rng.permutation(own)[: len(own) // 5]] = True
    found = _words(texts)
    data = found.data
    size = np.diff(found.offsets)
    usable = [np.flatnonzero((label == c) & ~held & (size > 0)) for c in range(k)]
    emb = (rng.standard_normal((1 << BITS, DIM)) * 0.1).astype(np.float32)
    weight, level = (rng.standard_normal((DIM, k)) * 0.1).astype(np.float32), np.zeros(k, np.float32)
    classes = [c for c in range(k) if len(usable[c])]
    for step in range(STEPS if classes else 0):
        y = rng.choice(classes, BATCH)
        doc = np.array([usable[c][rng.integers(len(usable[c]))] for c in y])
        length = np.minimum(rng.integers(3, 61, BATCH), size[doc])
        start = found.offsets[doc] + (rng.random(BATCH) * (size[doc] - length + 1)).astype(np.int64)
        index = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        bucket, owner, many = _subwords(data, found.start[index], found.end[index])
        row = np.repeat(np.arange(BATCH), length)[owner]
        count = np.maximum(np.bincount(row, minlength=BATCH), 1)
        used, at = np.unique(bucket, return_inverse=True)
        flat = row * len(used) + at
        mixed = np.bincount(flat, minlength=BATCH * len(used)).reshape(BATCH, len(used)).astype(np.float32) / count[:, None]
        x = mixed @ emb[used]
        z = x @ weight + level
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(BATCH), y] -= 1
        slope = p / BATCH
        pace = RATE * (1 - step / STEPS)
        emb_slope = mixed.T @ (slope @ weight.T)
        weight -= pace * (x.T @ slope)
        level -= pace * 0.1 * slope.sum(0)
        emb[used] -= pace * 10 * emb_slope
    model = Model(languages, emb @ weight, level.astype(float))
    check = held if held.any() else np.ones(len(label), bool)
    z = np.concatenate([model.scores(part) for part in _pieces(texts.filter(pa.array(check)))])
    y = label[check]

    def loss(heat: float) -> float:
        s = z / heat
        return float(np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(y)), y]))

    model.heat = min(np.geomspace(0.1, 10, 41), key=loss)
    s = z / model.heat
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = p.argmax(1) == y
    model.doubt = float(np.quantile(p.max(1)[right], REJECT)) if right.any() else 0.0
    return model


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Train on `docs(doc_id, text, lang)` rows with a text and a language, at most `rows` ids of each language.

    An id with several languages counts for each; of several texts of an id and language the smallest is taken.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    chosen = chosen.where("text is not null and lang is not null")
    counts = chosen.groupBy("lang").agg(F.count("*").alias("n"))
    order = F.xxhash64("doc_id", "lang")
    # ids are thinned and ranked alone; only the texts of those chosen are fetched, one of each id and language
    thin = join_sized(chosen.select("doc_id", "lang"), counts, "lang").where(F.pmod(order, F.lit(1_000_000)) * F.col("n") < F.lit(1_500_000 * rows))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    sample = thin.select("doc_id", "lang").distinct().withColumn("place", place).where(F.col("place") <= rows).drop("place")
    table = join_sized(chosen, sample, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    names = sorted(set(table.column("lang").to_pylist()))
    label = np.array([names.index(x) for x in table.column("lang").to_pylist()], np.int64)
    return train(table.column("text").combine_chunks(), names, label)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """`(doc_id, lang_pred, score, doubtful)` for every row of `docs(doc_id, text)`.

    Null texts and texts without a letter are `und` with score 0 and doubtful, as is everything if no language was learned.
    `score` is the calibrated probability of the prediction, `doubtful` says that it lies under the level of rejection.
    Repeated rows get equal results; an empty table gives an empty result; other columns are not looked at.
    """
    sent = broadcast(docs.sparkSession, model)

    def predict(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for block in tb.blocks(batch.column("text")):
            part = batch.slice(block.first, block.last - block.first)
            if own.languages:
                best, p = own.predict(part.column("text"))
                names = pa.array(own.languages).take(pa.array(best))
            else:
                names, p = pa.array([UNKNOWN] * part.num_rows), np.zeros(part.num_rows)
            yield pa.record_batch(
                [part.column("doc_id"), part.column("letters"), names.cast(pa.string()), pa.array(p)], ["doc_id", "letters", "lang_pred", "score"]
            )

    rows = texts_of(docs).withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = map_batches(rows, predict, "doc_id long, letters boolean, lang_pred string, score double")
    score = F.when(F.col("letters"), F.col("score")).otherwise(0.0)
    return found.select(
        "doc_id", F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), score.alias("score"),
        (~F.col("letters") | (F.col("score") < model.doubt) | F.lit(not model.languages)).alias("doubtful"),
    )
