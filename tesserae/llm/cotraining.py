"""Quality by co-training: a classifier of text content and one of page metadata teach each other.

The content view is a histogram of hashed byte trigrams with a few ratios of the words. The metadata view is what a crawl knows
of a page without reading it: source, language, length, and the layout of its lines. Each view is a logistic model. In
each round both score all unlabelled documents, and each hands the other the documents it is surest of, as many good and
bad ones as the labelled rows have in proportion. At the end each view is calibrated on labelled rows that neither has
seen, and a logistic model of the two calibrated log odds gives the score.

A round is one pass over the texts with both models broadcast. Only scores are shuffled, and only the `TEACH` documents
chosen for each pupil reach the driver. Equal rows (text, source and language) teach a pupil once. Training takes at most
`TRAIN_ROWS` labelled rows of each class, chosen by hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import textbytes as tb
from tesserae.llm.shared import broadcast, discard, map_batches, stored

TRAIN_ROWS = 1_500
BITS, KNOWN = 11, 64
TEACH = 150
TEACH_ROUNDS, STEPS = 5, 150
SURE = 0.9
KEEP = 0.5


def content(block: tb.Block) -> np.ndarray:
    """The content view of each document of a block; an empty text is a row of zeros."""
    n = len(block.offsets) - 1
    out = np.zeros((n, (1 << BITS) + 3), np.float32)
    if len(block.data) < 3:
        return out
    doc = tb.document_of(block.offsets)
    bucket = (tb.window_hash(tb.prefix_hash(block.data), 3) >> np.uint64(64 - BITS)).astype(np.int64)
    whole = doc[2:] == doc[:-2]
    counts = np.bincount((doc[:-2][whole] << BITS) | bucket[whole], minlength=n << BITS).reshape(n, 1 << BITS)
    out[:, :-3] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    found = tb.words(block)
    hashes = tb.range_hash(tb.prefix_hash(block.data), found.start, found.end)
    words = np.diff(found.offsets)
    owner = tb.document_of(found.offsets)
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=n)
    size = np.maximum(words, 1)
    out[:, -3] = distinct / size
    out[:, -2] = np.log1p(words) / 10
    out[:, -1] = np.bincount(owner, found.end - found.start, n) / size / 10
    return out


def metadata(block: tb.Block, source: list, lang: list, known: dict[str, int]) -> np.ndarray:
    """The metadata view; sources and languages that training didn't see share a column, as nulls do."""
    n = len(block.offsets) - 1
    out = np.zeros((n, 2 * KNOWN + 5), np.float32)
    rows = np.arange(n)
    out[rows, [known.get(f"s{x}", 0) for x in source]] = 1
    out[rows, [KNOWN + known.get(f"l{x}", 0) for x in lang]] = 1
    size = block.lengths
    breaks = np.flatnonzero(block.data == 10)
    lines = np.bincount(np.searchsorted(block.offsets, breaks, "right") - 1, minlength=n) + 1
    log = np.log1p(size)
    out[:, -5], out[:, -4], out[:, -3] = log / 10, log**2 / 100, np.log1p(lines) / 5
    out[:, -2], out[:, -1] = np.log1p(size / lines) / 5, np.log1p(size / lines) ** 2 / 25
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Logistic:
    """A logistic model with an L2 penalty, fitted with Adam on all rows at once."""

    def __init__(self, width: int) -> None:
        self.w, self.b, self.center = np.zeros(width, np.float32), 0.0, np.zeros(width, np.float32)
        self.scale = np.ones(width, np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4) -> Logistic:
        self.center, self.scale = x.mean(0), x.std(0) + np.float32(1e-2)
        x = (x - self.center) / self.scale
        weight = (weight / weight.sum()).astype(np.float32)
        theta = np.zeros(x.shape[1] + 1, np.float32)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            slope = weight * (_sigmoid(x @ theta[:-1] + theta[-1]) - y)
            g = np.append(slope @ x + penalty * theta[:-1], slope.sum()).astype(np.float32)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            theta -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.w, self.b = theta[:-1], float(theta[-1])
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.center) / self.scale) @ self.w + self.b


class Pair:
    """Both views with their calibration and the model that combines them."""

    def __init__(self, known: dict[str, int], views: list[Logistic], curves: list[tuple[float, float]], mixture: np.ndarray, constant: float | None = None) -> None:
        self.known, self.views, self.curves, self.mixture, self.constant = known, views, curves, mixture, constant

    def scores(self, block: tb.Block, source: list, lang: list) -> np.ndarray:
        if self.constant is not None:
            return np.full(block.last - block.first, self.constant)
        inputs = (content(block), metadata(block, source, lang, self.known))
        z = np.stack([a * v.logit(x) + b for v, x, (a, b) in zip(self.views, inputs, self.curves)], 1)
        return _sigmoid(z @ self.mixture[:2] + self.mixture[2])


def _logistic_small(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Newton's method for a few inputs, the last of which is the level; coefficients are pulled toward `penalty`'s center."""
    x = np.concatenate([z, np.ones((len(z), 1))], 1)
    theta = np.append(np.ones(z.shape[1]) / z.shape[1], 0.0)
    start = theta.copy()
    for _ in range(50):
        p = _sigmoid(x @ theta)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(curve, x.T @ (weight * (p - y)) + penalty * (theta - start))
        theta = theta - move * min(1.0, 1.0 / (np.abs(move).max() + 1e-9))
    return theta


def _features(table: pa.Table, known: dict[str, int]) -> list[np.ndarray]:
    """Both views of rows `text, source, lang`."""
    source, lang = table.column("source").to_pylist(), table.column("lang").to_pylist()
    views = [[np.zeros((0, (1 << BITS) + 3), np.float32)], [np.zeros((0, 2 * KNOWN + 5), np.float32)]]
    for block in tb.blocks(table.column("text").combine_chunks()):
        part = slice(block.first, block.last)
        views[0].append(content(block))
        views[1].append(metadata(block, source[part], lang[part], known))
    return [np.concatenate(v) for v in views]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")))


def _known(docs: DataFrame) -> dict[str, int]:
    """Columns of the metadata view for the most frequent sources and languages of all documents."""
    known: dict[str, int] = {}
    for mark, name in (("s", "source"), ("l", "lang")):
        often = docs.where(F.col(name).isNotNull()).groupBy(name).count().orderBy(F.desc("count"), name).limit(KNOWN - 1)
        known |= {f"{mark}{r[0]}": i + 1 for i, r in enumerate(often.collect())}
    return known


def surest(
    docs: DataFrame, given: DataFrame, known: dict[str, int], models: list[Logistic], taught: list[np.ndarray], wanted: tuple[int, int],
) -> dict[tuple[int, int], list[tuple[int | None, int]]]:
    """`(doc_id, key)` of the documents each teacher (0 and 1) is surest of in each class, at most `wanted[class]`.

    All rows of `docs(doc_id, text, source, lang, key)` whose id isn't in `given(doc_id)` are scored. Keys in
    `taught[pupil]` are passed over, and so is what a teacher is less than `SURE` of. Ties go to the smallest key.
    """
    sent = docs.sparkSession.sparkContext.broadcast((known, models, taught))
    least = float(np.log(SURE / (1 - SURE)))

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known, models, taught = sent.value
        source, lang = batch.column("source").to_pylist(), batch.column("lang").to_pylist()
        for block in tb.blocks(batch.column("text"), 1 << 20):
            part = slice(block.first, block.last)
            rows = batch.select(["doc_id", "key"]).slice(block.first, block.last - block.first)
            inputs = (content(block), metadata(block, source[part], lang[part], known))
            # rounded, as the last bits depend on which rows share a batch
            z = [np.round(m.logit(x).astype(float), 4) for m, x in zip(models, inputs)]
            for teacher in (0, 1):
                z[teacher][np.isin(rows.column("key").to_numpy(), taught[1 - teacher])] = 0
            sure = pa.array(np.maximum(np.abs(z[0]), np.abs(z[1])) >= least)
            yield pa.record_batch([*rows.columns, *map(pa.array, z)], ["doc_id", "key", "z0", "z1"]).filter(sure)

    found = map_batches(docs, score, "doc_id long, key long, z0 double, z1 double")
    found = found.join(given.select("doc_id"), "doc_id", "left_anti")
    found = stored(found.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("z0").alias("z0"), F.max("z1").alias("z1")), "surest")
    picks = {}
    for teacher in (0, 1):
        for value in (0, 1):
            z = F.col(f"z{teacher}") * (1 if value else -1)
            best = found.where(z >= least).orderBy(z.desc(), "key").limit(wanted[value])
            picks[teacher, value] = [(r.doc_id, r.key) for r in best.select("doc_id", "key").collect()]
    discard(found)
    sent.destroy()
    return picks


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_ROWS, teach: int = TEACH, seed: int = 3) -> Pair:
    """Co-train on `docs(doc_id, text, source, lang)` and `labels(doc_id, quality)`; rows with null texts aren't used.

    Documents without a label, those without an id among them, are the candidates of every round.
    """
    docs = _columns(docs).where("text is not null")
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    given = given.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    prior = given.agg(F.avg("label")).first()[0]
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = given.where("label = 0").orderBy(*order).limit(per_class).unionByName(given.where("label = 1").orderBy(*order).limit(per_class))
    table = docs.join(F.broadcast(chosen), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    label = table.column("label").to_numpy().astype(np.int64)
    if not (label == 0).any() or not (label == 1).any():
        return Pair({}, [], [], np.zeros(3), float((label == 1).any()) if len(label) else 0.5)
    rng = np.random.default_rng(seed)
    known = _known(docs)
    views = _features(table, known)
    kept_out = np.zeros(len(label), bool)
    for value in (0, 1):
        own = np.flatnonzero(label == value)
        if len(own) >= 4:
            kept_out[rng.permutation(own)[: len(own) // 4]] = True
    rest = np.flatnonzero(~kept_out)
    share = np.array([1 - prior, prior])
    wanted = tuple(int(np.ceil(teach * x)) for x in share)
    inputs, answers = [v[rest] for v in views], [label[rest], label[rest]]
    taught = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def balanced(y: np.ndarray) -> np.ndarray:
        return share[y] / np.bincount(y, minlength=2)[y]

    mark = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in ("source", "lang")]
    keyed = docs.withColumn("key", F.xxhash64("text", *mark))
    for turn in range(TEACH_ROUNDS + 1):
        models = [Logistic(x.shape[1]).fit(x, y, balanced(y)) for x, y in zip(inputs, answers)]
        if turn == TEACH_ROUNDS:
            break
        picks = surest(keyed, given, known, models, taught, wanted)
        ids, keys = (sorted({r[i] for rows in picks.values() for r in rows if r[i] is not None}) for i in (0, 1))
        if not keys:
            break  # the same models would choose nothing again
        rows = keyed.where((F.col("doc_id").isin(ids) | F.col("doc_id").isNull()) & F.col("key").isin(keys))
        rows = rows.dropDuplicates(["key"]).toArrow().sort_by("key")
        new, place = _features(rows, known), {key: i for i, key in enumerate(rows.column("key").to_pylist())}
        for (teacher, value), best in picks.items():
            pupil, own = 1 - teacher, [key for _, key in best]
            inputs[pupil] = np.concatenate([inputs[pupil], new[pupil][[place[key] for key in own]]])
            answers[pupil] = np.append(answers[pupil], np.full(len(own), value))
            taught[pupil] = np.append(taught[pupil], np.array(own, np.int64))
    check = np.flatnonzero(kept_out) if len(np.unique(label[kept_out])) == 2 else rest
    y = label[check]
    weight = balanced(y) * len(y)
    curves, z = [], []
    for model, view in zip(models, views):
        raw = model.logit(view[check])
        a, b = _logistic_small(raw[:, None], y, weight, np.array([1e-1, 1e-3]))
        curves.append((max(a, 0.0), b))
        z.append(curves[-1][0] * raw + b)
    mixture = _logistic_small(np.stack(z, 1), y, weight, np.array([1e-1, 1e-1, 1e-3]))
    return Pair(known, models, curves, mixture)


def scored(docs: DataFrame, pair: Pair, keep: float = KEEP) -> DataFrame:
    """`(doc_id, score, kept)` for every row of `docs(doc_id, text, source, lang)`: the probability of good quality.

    Null texts count as empty and are scored by their metadata and the empty content. Nulls in source and language are
    a value of their own. If training saw one class only, all rows get one constant score. Repeated rows score alike; an
    empty table gives an empty result; other columns are not looked at.
    """
    sent = broadcast(docs.sparkSession, pair)

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        source, lang = batch.column("source").to_pylist(), batch.column("lang").to_pylist()
        for block in tb.blocks(batch.column("text"), 1 << 20):
            part = slice(block.first, block.last)
            found = sent.value.scores(block, source[part], lang[part])
            yield pa.record_batch([batch.column("doc_id").slice(block.first, len(found)), pa.array(found.astype(float))], ["doc_id", "score"])

    return map_batches(_columns(docs), score, "doc_id long, score double").withColumn("kept", F.col("score") >= keep)
