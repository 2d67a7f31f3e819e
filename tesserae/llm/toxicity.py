"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A word enters as a learned vector of its own (if the training rows know it), the mean of learned vectors of its hashed
character trigrams, and two statistics of the training rows: how strongly the word, and the strongest of its character
4- to 6-grams, goes with the label. Both directions run over windows of `WINDOW` words that overlap; attention pools each
window; the highest window decides a document, and a logistic curve fitted on whole training documents turns that into a
probability. A document's label says nothing about which window earned it, so each round of training takes the window that
the network finds worst, plus random windows of clean documents. With few labelled rows the learned vectors would hold single
documents; they count in proportion to the rows of label 1, in full from `TRUSTED_ROWS` on.

Training uses at most `TRAIN_ROWS` labelled rows of each class, chosen by hash, with whole texts. Scoring covers all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import textbytes as tb
from tesserae.llm.shared import broadcast, filter_rows, give_back, map_batches, texts_of

TRAIN_ROWS = 1_500
WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 6, 6, 8
GRAMS = (4, 5, 6)
GRAM_BITS, CHAR_BITS = 20, 13
ROUNDS, STEPS, BATCH = 4, 100, 128
WORD_DROPOUT, LEAST_DOCS, TRUSTED_ROWS = 0.5, 5, 1_000
THRESHOLD = 0.7


def letters_and_digits(data: np.ndarray) -> np.ndarray:
    """Lower-cased, with a space for every ASCII character that is neither letter nor digit."""
    data = tb.lower(data)
    keep = (data >= 128) | ((data - np.uint8(97)) < 26) | ((data - np.uint8(48)) < 10)
    return np.where(keep, data, np.uint8(32))


def words_of(block: tb.Block) -> tuple[tb.Words, np.ndarray, np.ndarray]:
    """Runs of letters and digits, lower-cased: ranges, hashes and the bytes they refer to."""
    data = letters_and_digits(block.data)
    found = tb.words(block, data)
    return found, tb.range_hash(tb.prefix_hash(data), found.start, found.end), data


class Lexicon:
    """Distinct words with their character grams."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        size = end - start + 2
        at = np.concatenate([[0], np.cumsum(size)])
        text = np.full(at[-1], 60, np.uint8)
        inner = np.arange(at[-1]) - np.repeat(at[:-1], size)
        body = (inner > 0) & (inner < np.repeat(size, size) - 1)
        text[body] = data[(np.repeat(start, size) + inner - 1)[body]]
        text[at[1:] - 1] = 62
        self.n = len(start)
        self.sums, self.at, self.owner = tb.prefix_hash(text), at, np.repeat(np.arange(self.n), size)

    def grams(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all grams inside words and the word of each, in the order of words."""
        if len(self.owner) < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        whole = self.owner[width - 1 :] == self.owner[: len(self.owner) - width + 1]
        return tb.window_hash(self.sums, width)[whole], self.owner[: len(whole)][whole]


def _strength(positive: np.ndarray, total: np.ndarray, rate: float) -> np.ndarray:
    z = (positive - total * rate) / np.sqrt(total * rate * (1 - rate) + 1)
    return (np.sign(z) * np.sqrt(np.abs(z)) / 3).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """The parameters, with forward and backward passes over windows of word rows."""

    def __init__(self, known: np.ndarray, word_counts: tuple, gram_counts: tuple, rate: float, trust: float = 1.0, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.known, self.word_counts, self.gram_counts, self.rate, self.trust = known, word_counts, gram_counts, rate, trust
        self.word_strength, self.gram_strength = _strength(*word_counts, rate), _strength(*gram_counts, rate)
        d = WORD_DIM + CHAR_DIM + 2

        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"word": draw(len(known) + 1, WORD_DIM) * 0.1, "char": draw(1 << CHAR_BITS, CHAR_DIM) * 10}
        for way in "fb":
            self.p |= {f"W{way}": draw(d, 3 * HIDDEN), f"U{way}": draw(HIDDEN, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": draw(2 * HIDDEN, ATTENTION), "u": draw(ATTENTION, 1), "o": draw(2 * HIDDEN, 1), "k": np.zeros(1, np.float32)}

    def inputs(self, hashes: np.ndarray, lexicon: Lexicon, own: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """A row for each distinct word, and a last row of zeros that stands for padding.

        In training, `own` is the label of the document that a word is read in: its count is left out of the statistics,
        which would otherwise give away the labels of words that few documents have.
        """
        place = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        row = np.where(self.known[place] == hashes, place, len(self.known)) if len(self.known) else np.zeros(len(hashes), int)
        x = np.zeros((lexicon.n + 1, WORD_DIM + CHAR_DIM + 2), np.float32)
        x[:-1, :WORD_DIM] = self.p["word"][row]
        x[:-1, -2] = self.word_strength[row] if own is None else self._without(self.word_counts, row, own)
        grams, owner = lexicon.grams(3)
        bucket = (grams >> np.uint64(64 - CHAR_BITS)).astype(np.int64)
        count = np.maximum(np.bincount(owner, minlength=lexicon.n), 1)
        for c in range(CHAR_DIM):
            x[:-1, WORD_DIM + c] = np.bincount(owner, self.p["char"][bucket, c], lexicon.n) / count
        best = np.full(lexicon.n, -9, np.float32)
        for width in GRAMS:
            g, w = lexicon.grams(width)
            if len(g):
                first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                at = (g >> np.uint64(64 - GRAM_BITS)).astype(np.int64)
                top = np.maximum.reduceat(self.gram_strength[at] if own is None else self._without(self.gram_counts, at, own[w]), first)
                best[w[first]] = np.maximum(best[w[first]], top)
        x[:-1, -1] = np.where(best < -8, 0, best)
        x[:, :-2] *= np.float32(self.trust)
        return x, (row, bucket, owner, count)

    def _without(self, counts: tuple, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        positive, total = counts[0][at], counts[1][at]
        return _strength(np.maximum(positive - own, 0) * (total > 0), np.maximum(total - 1, 0), self.rate)

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. `index[window, step]` names a row of `x`."""
        n, steps = index.shape
        p, tape, states = self.p, [], np.zeros((2, steps, n, HIDDEN), np.float32)
        index, mask = np.ascontiguousarray(index.T), np.ascontiguousarray(mask.T)[:, :, None]
        for d, way in enumerate("fb"):
            gates = x @ p[f"W{way}"] + p[f"c{way}"]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                g, r = gates[index[t]], h @ p[f"U{way}"]
                zr = np.tanh(0.5 * (g[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN]))
                zr *= 0.5
                zr += 0.5
                z, q = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(g[:, 2 * HIDDEN :] + q * r[:, 2 * HIDDEN :])
                step = (1 - z) * mask[t]
                if keep:
                    tape.append((way, t, h, z, q, new, r[:, 2 * HIDDEN :]))
                h = h + step * (new - h)
                states[d, t] = h
        both = np.concatenate([states[0], states[1]], 2)
        inner = np.tanh(both @ p["A"])
        e = np.where(mask[:, :, 0] > 0, (inner @ p["u"])[:, :, 0], -1e9)
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0)
        pooled = (both * weight[:, :, None]).sum(0)
        logit = (pooled @ p["o"])[:, 0] + p["k"][0]
        return (logit, (tape, both, inner, weight, pooled, index, mask)) if keep else logit

    def backward(self, x: np.ndarray, parts: tuple, kept: tuple, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of all parameters for the slopes of the loss by the logits."""
        p = self.p
        tape, both, inner, weight, pooled, index, mask = kept
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        s = slope[:, None]
        g["o"], g["k"] = pooled.T @ s, slope.sum(keepdims=True)
        dpool = s @ p["o"].T
        dboth = weight[:, :, None] * dpool
        dw = (both * dpool).sum(2)
        de = weight * (dw - (weight * dw).sum(0))
        dinner = de[:, :, None] * p["u"][:, 0]
        g["u"] = np.einsum("tna,tn->a", inner, de)[:, None]
        dpre = dinner * (1 - inner**2)
        g["A"] = np.einsum("tnh,tna->ha", both, dpre)
        dboth += dpre @ p["A"].T
        dx = np.zeros_like(x)
        dgates = {way: np.zeros((len(x), 3 * HIDDEN), np.float32) for way in "fb"}
        dh = None
        for way, t, h, z, q, new, rn in reversed(tape):
            if dh is None or t == (index.shape[0] - 1 if way == "f" else 0):
                dh = np.zeros_like(h)
            dh = dh + dboth[t, :, :HIDDEN] if way == "f" else dh + dboth[t, :, HIDDEN:]
            m = mask[t]
            step = (1 - z) * m
            dnew = dh * step * (1 - new**2)
            dz = dh * m * (h - new) * z * (1 - z)
            dq = dnew * rn * q * (1 - q)
            dr = np.concatenate([dz, dq, dnew * q], 1)
            dg = np.concatenate([dz, dq, dnew], 1)
            g[f"U{way}"] += h.T @ dr
            np.add.at(dgates[way], index[t], dg)
            dh = dh * (1 - step) + dr @ p[f"U{way}"].T
        for way in "fb":
            g[f"W{way}"], g[f"c{way}"] = x.T @ dgates[way], dgates[way].sum(0)
            dx += dgates[way] @ p[f"W{way}"].T
        dx[:, :-2] *= np.float32(self.trust)
        row, bucket, owner, count = parts
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], row, dx[:-1, :WORD_DIM])
        np.add.at(g["char"], bucket, (dx[:-1, WORD_DIM:-2] / count[:, None])[owner])
        return g


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all documents: word positions, which of them count, and the document of each window.

    Windows start every `STRIDE` words; the last one ends with the document. Documents without words have none.
    """
    size = np.diff(offsets)
    many = np.where(size > WINDOW, -(-(size - WINDOW) // STRIDE) + 1, np.minimum(size, 1))
    doc = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    start = np.minimum(nth * STRIDE, np.maximum(size[doc] - WINDOW, 0))
    at = start[:, None] + np.arange(WINDOW)
    mask = at < size[doc][:, None]
    return offsets[doc][:, None] + np.where(mask, at, 0), mask, doc


class Scorer:
    """A trained network with its calibration."""

    def __init__(self, network: Network, slope: float, level: float) -> None:
        self.network, self.slope, self.level = network, slope, level
        network.word_counts = network.gram_counts = None  # only training needs them

    def logits(self, block: tb.Block) -> np.ndarray:
        """The highest window of each document of a block; -inf where there are no words."""
        found, hashes, data = words_of(block)
        top = np.full(len(found.offsets) - 1, -np.inf)
        if not len(hashes):
            return top
        distinct, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        x, _ = self.network.inputs(distinct, Lexicon(data, found.start[first], found.end[first]))
        at, mask, doc = windows(found.offsets)
        for lo in range(0, len(at), 4096):
            part = slice(lo, lo + 4096)
            index = np.where(mask[part], word[at[part]], len(distinct))
            np.maximum.at(top, doc[part], self.network.forward(x, index, mask[part].astype(np.float32)))
        return top

    def scores(self, block: tb.Block) -> np.ndarray:
        top = self.logits(block)
        return np.where(np.isfinite(top), _sigmoid(self.slope * np.where(np.isfinite(top), top, 0) + self.level), 0.0)


WORDS_AT_ONCE, PAIRS_AT_ONCE = 50_000, 50_000


def _statistics(offsets, word, label, data, start, end) -> tuple[tuple, tuple]:
    """For each word and each gram bucket, the documents labelled 1 and all documents that have it."""
    n_words = len(start)
    pairs = np.unique((tb.document_of(offsets) << 32) | word)
    pair_doc, pair_word = pairs >> 32, pairs & 0xFFFFFFFF
    total = np.bincount(pair_word, minlength=n_words)
    positive = np.bincount(pair_word, label[pair_doc], n_words)
    buckets, sizes = [], []
    for at in range(0, n_words, WORDS_AT_ONCE):
        some = slice(at, at + WORDS_AT_ONCE)
        lexicon = Lexicon(data, start[some], end[some])
        grams = [lexicon.grams(w) for w in GRAMS]
        owner = np.concatenate([o for _, o in grams])
        bucket = np.concatenate([(g >> np.uint64(64 - GRAM_BITS)).astype(np.int32) for g, _ in grams])
        buckets.append(bucket[np.argsort(owner, kind="stable")])
        sizes.append(np.bincount(owner, minlength=lexicon.n))
    bucket, size = np.concatenate(buckets), np.concatenate(sizes)
    bounds = np.concatenate([[0], np.cumsum(size)])
    gram_total, gram_positive = np.zeros(1 << GRAM_BITS), np.zeros(1 << GRAM_BITS)
    cuts = np.searchsorted(pair_doc, pair_doc[np.arange(0, len(pairs), PAIRS_AT_ONCE)]) if len(pairs) else np.zeros(0, int)
    cuts = np.unique(np.append(cuts, len(pairs)))
    for lo, hi in zip(cuts[:-1], cuts[1:]):  # whole documents
        w = pair_word[lo:hi]
        n = size[w]
        place = np.repeat(bounds[w] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        keys = np.unique((np.repeat(pair_doc[lo:hi], n) << GRAM_BITS) | bucket[place])
        b = keys & ((1 << GRAM_BITS) - 1)
        gram_total += np.bincount(b, minlength=1 << GRAM_BITS)
        gram_positive += np.bincount(b, label[keys >> GRAM_BITS], 1 << GRAM_BITS)
    return (positive, total), (gram_positive, gram_total)


def train(texts: pa.Array, label: np.ndarray, prior: float, seed: int = 7) -> Scorer:
    """Fit the network on whole texts. `prior` is the rate of label 1 among all labelled rows."""
    rng = np.random.default_rng(seed)
    label = np.asarray(label, np.float64)
    if not len(texts) or label.min() == label.max():  # nothing to tell apart
        none = (np.zeros(1), np.zeros(1))
        network = Network(np.zeros(0, np.uint64), none, (np.zeros(1 << GRAM_BITS), np.zeros(1 << GRAM_BITS)), 0.5)
        sure = float(label.mean()) if len(label) else 0.0
        return Scorer(network, 0.0, np.log((sure + 1e-3) / (1 - sure + 1e-3)))
    found = tb.word_list(texts, letters_and_digits)
    data = found.data
    distinct, first, word = np.unique(found.hashes, return_index=True, return_inverse=True)
    start, end = found.start[first], found.end[first]
    (positive, total), gram_counts = _statistics(found.offsets, word, label, data, start, end)
    known = total >= LEAST_DOCS
    rate = min(max(float(label.mean()), 1e-3), 1 - 1e-3)
    network = Network(distinct[known], (np.append(positive[known], 0), np.append(total[known], 0)), gram_counts, rate, min(1.0, label.sum() / TRUSTED_ROWS), seed)
    at, mask, doc = windows(found.offsets)

    def levels(peak_only: bool) -> np.ndarray:
        """The logit of each window, or its strongest word or gram."""
        level = np.empty(len(at))
        for value in (0.0, 1.0):
            parts = []
            for i in range(0, len(distinct), WORDS_AT_ONCE):
                some = slice(i, i + WORDS_AT_ONCE)
                x, _ = network.inputs(distinct[some], Lexicon(data, start[some], end[some]), np.full(len(distinct[some]), value))
                parts.append(x[:-1])
            x = np.concatenate([*parts, x[-1:]])
            peak = x[:, -2] + x[:, -1]
            mine = np.flatnonzero(label[doc] == value)
            for i in range(0, len(mine), 4096):
                some = mine[i : i + 4096]
                index = np.where(mask[some], word[at[some]], len(distinct))
                level[some] = peak[index].max(1) if peak_only else network.forward(x, index, mask[some].astype(np.float32))
        return level

    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items()}
    level, done = levels(peak_only=True), 0
    for _ in range(ROUNDS):
        order = np.lexsort((level, doc))
        worst = order[np.append(np.flatnonzero(doc[order][1:] != doc[order][:-1]), len(order) - 1)]
        clean = np.flatnonzero(label[doc] == 0)
        yes, no = worst[label[doc[worst]] == 1], worst[label[doc[worst]] == 0]
        for _ in range(STEPS):
            pick = np.concatenate([rng.choice(x, BATCH // 2 if i == 0 else BATCH // 4) for i, x in enumerate((yes, no, clean)) if len(x)])
            ids = word[at[pick]] * 2 + label[doc[pick]].astype(np.int64)[:, None]
            used, index = np.unique(np.where(mask[pick], ids, 1 << 62), return_inverse=True)
            used = used[used < 1 << 62]
            index, own = index.reshape(len(pick), WINDOW), used >> 1
            x, parts = network.inputs(distinct[own], Lexicon(data, start[own], end[own]), (used & 1).astype(float))
            x[:-1, :-2] *= rng.random((len(own), 1)) >= WORD_DROPOUT
            logit, kept = network.forward(x, index, mask[pick].astype(np.float32), keep=True)
            slope = ((_sigmoid(logit) - label[doc[pick]]) / len(pick)).astype(np.float32)
            done += 1
            pace = 0.01 * min(1.0, done / 20) * (1 - 0.9 * done / (ROUNDS * STEPS))
            for k, g in network.backward(x, parts, kept, slope).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                network.p[k] -= pace * (0.2 if k in ("word", "char") else 1.0) * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.99**done)) + 1e-6)
        level = levels(peak_only=False)
    top = np.full(len(label), -np.inf)
    np.maximum.at(top, doc, level)
    seen = np.isfinite(top)
    return Scorer(network, *_calibrate(top[seen], label[seen], prior))


def _calibrate(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and level of a logistic curve, with the classes weighted back to their share among all labelled rows."""
    yes, no = max(y.sum(), 1.0), max((1 - y).sum(), 1.0)
    target = np.where(y == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    weight = np.where(y == 1, prior / yes, (1 - prior) / no)
    center, scale = x.mean(), x.std() + 1e-6
    z = np.stack([(x - center) / scale, np.ones_like(x)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(z @ theta)
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        move = np.linalg.solve(curve, z.T @ (weight * (p - target)) + 1e-6 * np.array([theta[0], 0]))
        theta -= move * min(1.0, 2.0 / (np.abs(move).max() + 1e-9))
    slope = max(theta[0], 0.0) / scale
    return slope, theta[1] - slope * center


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> tuple[pa.Array, np.ndarray, float]:
    """Texts and labels of at most `per_class` rows of each class, chosen by hash of the id, and the rate of label 1."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{column}`").cast("int").alias("label"))
    rows = rows.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    rate = rows.agg(F.avg("label")).first()[0] or 0.0
    chosen = None
    for value in (0, 1):
        part = rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = docs.where("text is not null")
    table = found.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").toArrow().sort_by("doc_id")
    return table.column("text").combine_chunks(), table.column("label").to_numpy().astype(float), float(rate)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_ROWS) -> Scorer:
    """Train on the labelled rows of `docs`; nothing but text and `labels.toxic` is looked at."""
    texts, label, prior = labelled(texts_of(docs), labels, "toxic", per_class)
    try:
        return train(texts, label, prior)
    finally:
        give_back()


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """`(doc_id, score)` for every row of `docs(doc_id, text)`: the probability that the text is toxic.

    Null, empty and wordless texts score 0. Repeated rows score alike; an empty table gives an empty result. If training
    saw only one class, or nothing, every text with words gets one constant score. Other columns are not looked at.
    """
    sent = broadcast(docs.sparkSession, scorer)

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batch.column("text")):
            yield pa.record_batch(
                [batch.column("doc_id").slice(block.first, block.last - block.first), pa.array(sent.value.scores(block))], ["doc_id", "score"]
            )

    return map_batches(texts_of(docs), score, "doc_id long, score double")


def without_toxic(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all columns, whose texts score under `threshold`; rows without an id are judged alike."""
    sent = broadcast(docs.sparkSession, scorer)

    def keep(texts: pa.Array) -> np.ndarray:
        parts = [sent.value.scores(block) < threshold for block in tb.blocks(texts)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    return filter_rows(docs, keep)
