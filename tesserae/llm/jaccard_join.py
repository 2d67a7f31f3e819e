"""Grouped prefix join: documents whose sets of word shingles have a Jaccard similarity above a threshold.

A pair with similarity t or more must share one of the first `n - ceil(t n) + 1` shingles of each set, in any one total
order of all shingles. Frequent shingles come last in the order used here, so prefixes hold rare ones. The steps:

1. Every text becomes its set of shingles. Equal sets form a class. Shingles are counted over all documents; those met less than
   `RARE` times come first, by hash, so a prefix that has enough of them meets few others.
2. Sets with the same size and the same prefix form a group, and only one row per group enters the join on prefix shingles.
3. Group pairs are filtered by size, by the places of the shared shingle in both orders (what precedes it is not shared, if
   it is the first shared one, and each similar pair passes by that one), and by sketches of the sets.
4. Groups are expanded to their classes, whose whole sets are intersected. For components, stars are verified before that, a few
   links for each group; classes that are already connected need no further comparison, so that a large cluster of
   near copies costs a linear number of comparisons and not all pairs. For a table of all links there are no stars.

Shingles are compared as 64-bit hashes of their words, sets as 128-bit sums of mixed hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import textbytes as tb
from tesserae.llm.components import components
from tesserae.llm.shared import broadcast, collect_garbage, discard, map_batches, map_partitions, stored, texts_of
from tesserae.scale import BROADCAST_ROWS

WORDS, PERCENT = 5, 75
RARE = 4
COUNTED_TOGETHER = 1 << 21
SHINGLES_PER_BUCKET = 1 << 21
COUNTS_SENT = 1_000_000
STAR_ROUNDS, HUBS = 2, 2
SKETCH_LONGS, SKETCHED_BUCKET = 8, 8


def shingle_sets(block: tb.Block, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document of a block, one after the other, and their offsets."""
    data = tb.lower(block.data)
    found = tb.words(block, data)
    hashes = tb.range_hash(tb.prefix_hash(data), found.start, found.end)
    windows, whole = tb.word_windows(hashes, found.offsets, width)
    counts = np.diff(found.offsets)
    short = np.flatnonzero((counts > 0) & (counts < width))
    doc = tb.document_of(found.offsets)
    extra = np.zeros(len(short), np.uint64)
    for i, d in enumerate(short):  # the whole sequence as one shingle, told apart by its length
        own = hashes[found.offsets[d] : found.offsets[d + 1]]
        extra[i] = tb.mix((own * tb.mix(np.arange(1, len(own) + 1, dtype=np.uint64))).sum(keepdims=True) + np.uint64(len(own)))[0]
    values = np.concatenate([windows[whole], extra])
    owner = np.concatenate([doc[whole], short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[first], owner[first]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each document's values, modulo 2**64."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _signature(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _sums(tb.mix(values), offsets).view(np.int64), _sums(tb.mix(values ^ np.uint64(FLIP)), offsets).view(np.int64)


FLIP = 0x5851F42D4C957F2D


def _summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values)
    values = values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def shingle_counts(docs: DataFrame, total: int, width: int = WORDS, least: int = RARE) -> DataFrame:
    """`(token, times)`: the shingles that `least` documents or more have. `total` is about the sum of all set sizes.

    Shingles are packed by ranges of their hash, so that a row carries many and a range has about `SHINGLES_PER_BUCKET` of
    them; a task sums one range at a time. A shingle that very many documents have comes once from each two million.
    """
    bits = max(0, -(-total // SHINGLES_PER_BUCKET) - 1).bit_length()

    def pack(seen: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.sort(np.concatenate(seen))
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        values, counts = every[first], np.diff(first, append=len(every)).astype("<u4")
        bucket = (values >> np.uint64(64 - bits) if bits else np.zeros(len(values), np.uint64)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(starts[1:], len(values))
        packed = [[x[a:b].tobytes() for a, b in zip(starts, ends)] for x in (values.astype("<u8"), counts)]
        yield pa.record_batch([pa.array(bucket[starts]), *(pa.array(p, pa.binary()) for p in packed)], ["bucket", "shingles", "counts"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        for batch in batches:
            for block in tb.blocks(batch.column("text")):
                seen.append(shingle_sets(block, width)[0])
                if sum(map(len, seen)) >= COUNTED_TOGETHER:
                    yield from pack(seen)
                    seen = []
        if sum(map(len, seen)):
            yield from pack(seen)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None

        def flush() -> pa.RecordBatch:
            values, counts = (np.concatenate(x) for x in zip(*held))
            values, counts = _summed(values, counts.astype(np.int64))
            often = counts >= least
            return pa.record_batch([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["token", "times"])

        for batch in batches:
            for own, shingles, counts in zip(*(batch.column(c) for c in ("bucket", "shingles", "counts"))):
                if held and own.as_py() != bucket:
                    yield flush()
                    held = []
                bucket = own.as_py()
                held.append((np.frombuffer(shingles.as_buffer(), "<u8").copy(), np.frombuffer(counts.as_buffer(), "<u4").copy()))
        if held:
            yield flush()

    packed = map_partitions(docs, collect, "bucket long, shingles binary, counts binary")
    return map_partitions(packed.repartition("bucket").sortWithinPartitions("bucket"), add, "token long, times long")


def _prefixes(block: tb.Block, ids: pa.Array, width: int, percent: int, hot: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """Size, signature, group, prefix (in order) and sketch of each set. `hot` are the counted shingles, sorted."""
    values, offsets = shingle_sets(block, width)
    sizes = np.diff(offsets)
    a, b = _signature(values, offsets)
    level = np.zeros(len(values), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
        level = np.where(hot[at] == values, times[at], 0)
    doc = tb.document_of(offsets)
    order = np.lexsort((values, level, doc))
    place = np.arange(len(values)) - offsets[:-1][doc]
    keep = place < (sizes - (sizes * percent + 99) // 100 + 1)[doc]
    chosen, owner = values[order][keep], doc[keep]
    bounds = np.searchsorted(owner, np.arange(len(sizes) + 1))
    group = tb.mix(_sums(tb.mix(chosen + np.uint64(FLIP)), bounds) + sizes.astype(np.uint64)).view(np.int64)
    rare = (level[order] == 0)[keep]

    def lists(of: np.ndarray) -> pa.Array:
        at = np.concatenate([[0], np.cumsum(of)])[bounds].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(chosen[of].view(np.int64)))

    n = len(sizes)
    sketch = sketches(values, doc, n)
    return pa.record_batch(
        [ids.slice(block.first, n), pa.array(sizes), pa.array(a), pa.array(b), pa.array(group), lists(rare), lists(~rare),
         *(pa.array(sketch[:, i]) for i in range(SKETCH_LONGS))],
        ["doc_id", "n", "s1", "s2", "g", "rare", "often", *SKETCH],
    )


def prefixes(docs: DataFrame, counts: DataFrame, width: int, percent: int, sent: int | None = None) -> DataFrame:
    """Prefixes of all documents, in the order of `counts(token, times)`.

    Up to `sent` counts are broadcast. More of them are joined to the shingles, and each document gets its own counted
    ones with its text. The order, and so the result, is the same.
    """
    spark = docs.sparkSession
    schema = "doc_id long, n long, s1 long, s2 long, g long, rare array<long>, often array<long>, " + ", ".join(f"{k} long" for k in SKETCH)
    if counts.count() <= (COUNTS_SENT if sent is None else sent):
        listed = counts.toArrow()
        tokens = listed.column("token").to_numpy().view(np.uint64)
        order = np.argsort(tokens)
        known = broadcast(spark, (tokens[order], listed.column("times").to_numpy()[order]))

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for block in tb.blocks(batch.column("text")):
                yield _prefixes(block, batch.column("doc_id"), width, percent, *known.value)

        return map_batches(docs, run, schema)

    def listed_shingles(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batch.column("text")):
            values, offsets = shingle_sets(block, width)
            ids = batch.column("doc_id").slice(block.first, len(offsets) - 1).take(pa.array(tb.document_of(offsets)))
            yield pa.record_batch([ids, pa.array(values.view(np.int64))], ["doc_id", "token"])

    def run_joined(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batch.column("text")):
            found = batch.column("known").slice(block.first, block.last - block.first).flatten()
            tokens = found.field("token").to_numpy(zero_copy_only=False).view(np.uint64)
            tokens, first = np.unique(tokens, return_index=True)
            times = found.field("times").to_numpy(zero_copy_only=False)[first]
            yield _prefixes(block, batch.column("doc_id"), width, percent, tokens, times)

    shingles = map_batches(docs.where("doc_id is not null"), listed_shingles, "doc_id long, token long")
    known = shingles.join(counts, "token").groupBy("doc_id").agg(F.collect_set(F.struct("token", "times")).alias("known"))
    return map_batches(docs.join(known, "doc_id", "left"), run_joined, schema)


SKETCH = [f"k{i}" for i in range(SKETCH_LONGS)]


def sketches(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A bitmap of each set: the bits at which its shingles fall. A bit that only one of two sets has is a shingle that
    the other lacks, which bounds what they have in common."""
    bits = np.zeros((n, SKETCH_LONGS * 64), np.uint8)
    bits[doc, (tb.mix(values ^ np.uint64(FLIP)) % np.uint64(SKETCH_LONGS * 64)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").reshape(n, SKETCH_LONGS)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    for block in tb.blocks(batch.column("text")):
        values, offsets = shingle_sets(block, width)
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
        yield pa.record_batch([batch.column("doc_id").slice(block.first, len(lists)), lists], ["doc_id", "shingles"])


def _few(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of `pairs(x, y)` whose whole sets are similar enough."""
    pairs = stored(pairs, "pairs")
    wanted = stored(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct(), "wanted")
    chosen = docs.join(F.broadcast(wanted) if _few(wanted) else wanted, "doc_id", "left_semi")
    sets = stored(map_batches(chosen, lambda b: _sets(b, width), "doc_id long, shingles array<long>"), "sets")
    left = sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("sx"))
    right = sets.select(F.col("doc_id").alias("y"), F.col("shingles").alias("sy"))
    both = pairs.join(left, "x").join(right, "y")
    common = F.size(F.array_intersect("sx", "sy"))
    both = both.select("x", "y", common.alias("common"), (F.size("sx") + F.size("sy") - common).alias("every"))
    similar = stored(both.where(F.col("common") * 100 >= F.col("every") * percent).select("x", "y"), "similar")
    discard(pairs, wanted, sets)
    return similar


BYTES_PER_SHINGLE = 6
CLASS = ["n", "s1", "s2"]


@dataclass
class _Sets:
    """Documents by set: rows with size and signature; classes in groups; first class of each group; and prefix buckets."""

    rows: DataFrame
    grouped: DataFrame
    first: DataFrame
    shared: DataFrame

    @property
    def members(self) -> DataFrame:
        return self.grouped.select("class_id", "g", "n")

    def classes(self) -> DataFrame:
        return self.rows.join(self.grouped.select(*CLASS, "class_id"), CLASS, "left")


def _collapsed(docs: DataFrame, width: int, percent: int, sent: int | None) -> _Sets:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counts = stored(shingle_counts(docs, size // BYTES_PER_SHINGLE, width), "counts")
    found = stored(prefixes(docs, counts, width, percent, sent), "prefixes")
    rows = stored(found.select("doc_id", *CLASS), "rows")
    grouped = found.where("n > 0 and doc_id is not null").groupBy(*CLASS, "g", "rare", "often", *SKETCH).agg(F.min("doc_id").alias("class_id"))
    grouped = stored(grouped, "grouped")
    discard(counts, found)
    groups = grouped.groupBy("g", "n", "rare", "often").agg(F.min("class_id").alias("y"))
    # a rare shingle is in few documents, so a window over it is small; the others are counted before they are joined
    rare = groups.select("g", "n", F.posexplode("rare").alias("at", "token"))
    rare = rare.withColumn("size", F.count("*").over(Window.partitionBy("token"))).where("size > 1").select("token", "g", "n", "at")
    often = groups.select("g", "n", F.size("rare").alias("before"), F.posexplode("often").alias("at", "token"))
    several = stored(often.groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token"), "several")
    often = often.join(F.broadcast(several) if _few(several) else several, "token", "left_semi")
    shared = stored(rare.unionByName(often.select("token", "g", "n", (F.col("before") + F.col("at")).alias("at"))), "buckets")
    discard(several)
    return _Sets(rows, grouped, stored(groups.select("g", "y"), "first"), shared)


def _candidates(sets: _Sets, buckets: DataFrame, percent: int) -> DataFrame:
    """`(g1, g2)`: group pairs that may hold similar sets, from `buckets(token, g, n, at, lo, hi)`. Groups whose classes all are in
    one and the same component (`lo` to `hi`) need no look at each other."""
    # in fuller buckets, sketches keep apart groups that can't be alike: bits that all sets of a group have, or any
    own = [f"{k}{kind}" for k in SKETCH for kind in ("all", "any")]
    bits = sets.grouped.groupBy("g").agg(*(f(k).alias(f"{k}{kind}") for k in SKETCH for f, kind in ((F.bit_and, "all"), (F.bit_or, "any"))))
    sizes = stored(buckets.groupBy("token").agg(F.count("*").alias("size")).where(F.col("size") >= SKETCHED_BUCKET).select("token"), "full")
    listed = F.broadcast(sizes) if _few(sizes) else sizes
    full = buckets.join(listed, "token", "left_semi").join(bits, "g")
    few = buckets.join(listed, "token", "left_anti").withColumns({c: F.lit(None).cast("long") for c in own})
    sketched = stored(full.unionByName(few), "sketched")
    a = sketched.select("token", *(F.col(c).alias(f"{c}1") for c in ("g", "n", "at", "lo", "hi", *own)))
    b = sketched.select("token", *(F.col(c).alias(f"{c}2") for c in ("g", "n", "at", "lo", "hi", *own)))
    need = F.ceil((F.col("n1") + F.col("n2")) * percent / (100 + percent) - 1e-6)
    fits = (F.col("n1") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n1") * percent)
    fits = fits & (F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) >= need)

    def lacking(one: int, other: int) -> Column:
        parts = [F.bit_count(F.col(f"{k}all{one}").bitwiseAND(F.bitwise_not(F.col(f"{k}any{other}")))).cast("long") for k in SKETCH]
        return F.coalesce(sum(parts[1:], parts[0]), F.lit(0))

    fits = fits & (F.least(F.col("n1") - lacking(1, 2), F.col("n2") - lacking(2, 1)) >= need)
    settled = (F.col("lo1") == F.col("hi1")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo1") == F.col("lo2"))
    pairs = stored(a.join(b, "token").where((F.col("g1") < F.col("g2")) & fits & ~F.coalesce(settled, F.lit(False))).select("g1", "g2").distinct(), "pairs")
    discard(sizes, sketched)
    return pairs


def jaccard_links(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, sent: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All links: `(x, y)` with x < y between the smallest ids of different sets that are similar, and `(doc_id, class_id,
    n_shingles, links)` for every row of `docs`, with the number of other sets that its own is linked with.

    Rows of one class have equal sets; they are linked as well and not listed. Null, empty and blank texts and rows with a
    null id have no links. `docs` is taken as in `jaccard_components`.
    """
    sets = _collapsed(texts_of(docs), width, percent, sent)
    none = {c: F.lit(None).cast("long") for c in ("lo", "hi")}
    pairs = _candidates(sets, sets.shared.withColumns(none), percent)
    several = sets.members.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    itself = several.select(F.col("g").alias("g1"), F.col("g").alias("g2"))
    one, two = (sets.members.select(F.col("g").alias(f"g{i}"), F.col("class_id").alias(c)) for i, c in ((1, "x"), (2, "y")))
    expanded = pairs.unionByName(itself).join(one, "g1").join(two, "g2").where("g1 != g2 OR x < y")
    links = _verified(expanded.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), texts_of(docs), width, percent)
    ends = links.select(F.explode(F.array("x", "y")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    named = sets.classes().join(ends, "class_id", "left")
    return links, named.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("n").alias("n_shingles"), F.coalesce("links", F.lit(0)).alias("links"))


def jaccard_components(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, sent: int | None = None) -> DataFrame:
    """`(doc_id, n_shingles, class_id, component_id)` for every row of `docs(doc_id, text)`.

    `class_id` is the smallest id with the same set, `component_id` the smallest id that links reach. Null, empty and
    blank texts have no shingles, no links and are their own class and component, as are rows with a null id.
    Repeated ids are taken as rows of one document each and share the component of their texts. An empty table gives an
    empty result. Other columns of `docs` are not looked at.
    """
    docs = texts_of(docs)
    sets = _collapsed(docs, width, percent, sent)
    shared, first, members = sets.shared, sets.first, sets.members

    # stars: each class with the first of its group; each group with the one that heads most of its buckets. Head is first the
    # group whose shingles are in the fullest buckets, as an original's are among its copies, then one by hash.
    hubs = [members.join(first, "g").select(F.col("class_id").alias("x"), "y")]
    members = members.withColumn("known", F.col("class_id"))
    stars, buckets = None, shared.select("token", "g", "n")
    for turn in range(STAR_ROUNDS):
        wanted = hubs.pop() if hubs else None
        sizes = buckets.groupBy("token").agg(F.count("*").alias("size"))
        central = buckets.join(sizes, "token").groupBy("g").agg(F.sum("size").alias("weight"))
        weighed = stored(buckets.select("token", "g", "n").join(central, "g"), "weighed")
        for k in range(HUBS):
            order = F.struct("weight", "g") if k == 0 else F.struct(F.xxhash64("g", F.lit(turn * HUBS + k)), "g")
            heads = weighed.groupBy("token").agg(F.max_by("g", order).alias("head"))
            most = weighed.join(heads, "token").where("g != head").groupBy("g", "n", "head").count()
            most = most.where("10 * count >= n").groupBy("g").agg(F.max_by("head", F.struct("count", "head")).alias("h"))  # fewer can't be alike
            across = most.join(first, "g").select("h", F.col("y").alias("x")).join(first.withColumnRenamed("g", "h"), "h").select("x", "y")
            wanted = across if wanted is None else wanted.unionByName(across)
        known = members.select(F.col("class_id").alias("x"), F.col("known").alias("kx"))
        wanted = wanted.where("x != y").distinct().join(known, "x").join(known.toDF("y", "ky"), "y").where("kx != ky").select("x", "y")
        found = _verified(wanted, docs, width, percent)
        discard(weighed)
        stars = found if stars is None else stars.unionByName(found)
        joined = components(stars.select(F.col("x").alias("a"), F.col("y").alias("b")))
        members = members.drop("known").join(joined, F.col("class_id") == F.col("id"), "left")
        members = stored(members.select("class_id", "g", "n", F.coalesce("component", "class_id").alias("known")), "members")
        spans = members.groupBy("g").agg(F.min("known").alias("lo"), F.max("known").alias("hi"))
        spanned = shared.join(spans, "g")
        open_tokens = spanned.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l != h").select("token")
        buckets = stored(spanned.join(open_tokens, "token", "left_semi").select("token", "g", "n", "at", "lo", "hi"), "open")
        collect_garbage(docs.sparkSession)

    pairs = _candidates(sets, buckets, percent)
    itself = spans.where("lo != hi").select(F.col("g").alias("g1"), F.col("g").alias("g2"))
    one = members.select(F.col("g").alias("g1"), F.col("class_id").alias("x"), F.col("known").alias("kx"))
    two = members.select(F.col("g").alias("g2"), F.col("class_id").alias("y"), F.col("known").alias("ky"))
    expanded = pairs.unionByName(itself).join(one, "g1").join(two, "g2").where("kx != ky")
    expanded = expanded.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    links = _verified(expanded, docs, width, percent).unionByName(stars)
    found = stored(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))), "components")
    named = stored(sets.classes(), "classes").join(found, F.col("class_id") == F.col("id"), "left")
    discard(shared, first, pairs, buckets, sets.grouped, sets.rows)
    return named.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component", "class_id", "doc_id").alias("component_id"),
    )


def one_per_component(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, with all columns, without those whose component has a smaller id. Rows without an id stay."""
    found = jaccard_components(docs, width, percent)
    others = stored(found.where("doc_id != component_id").select("doc_id").distinct(), "others")
    others = others.withColumnRenamed("doc_id", "__other")
    same = docs["doc_id"].cast("long") == F.col("__other")
    return docs.join(F.broadcast(others) if _few(others) else others, same, "left_anti")
