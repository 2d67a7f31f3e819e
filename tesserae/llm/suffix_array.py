"""Suffix-array deduplication: byte strings of a least length that occur in several documents.

A suffix array of a whole corpus fits no machine, so the corpus is first cut where equal strings must fall together:

1. Anchors. The anchor of a window of `min_bytes` bytes is the 16-byte gram in it with the smallest hash. Equal windows have
   equal anchors at equal offsets. Consecutive windows with one anchor make a block.
2. Anchors that occur in one document only are dropped: no window of theirs occurs elsewhere. An anchor that repeats within
   a batch of rows is known to be shared there and then, so at most one row per batch and hot anchor is shuffled by anchor.
3. Equal blocks are merged with their smallest document id, by a partial aggregation before the shuffle.
4. The distinct blocks of an anchor meet in one task. There an enhanced suffix array is built over all blocks of a chunk
   (prefix doubling, longest common prefixes), its common-prefix intervals are found with a stack, and each interval whose
   occurrences differ to their left is a maximal repeat: a group with all its occurrences.
   The blocks of an anchor with more than `SPLIT_BLOCKS` of them are taken apart into windows that are grouped by content.
5. Repeats go back to every occurrence of their block. Bytes of a repeat that also occurs in a smaller document id are removed.

A repeat longer than a block is a chain of groups on overlapping blocks; its removed bytes join up to one span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import textbytes as tb
from tesserae.llm.shared import discard, map_batches, map_partitions, stored, texts_of
from tesserae.scale import BROADCAST_ROWS

MIN_BYTES = 50
GRAM = 16
SPLIT_BLOCKS = 50_000
CHUNK_BYTES = 1 << 20
PLACE_BITS = 31


def anchors(block: tb.Block, width: int = MIN_BYTES) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor hash, first window, last window, document."""
    n = len(block.data)
    none = np.zeros(0, np.int64)
    if n < width:
        return none.astype(np.uint64), none, none, none
    hashes = tb.window_hash(tb.prefix_hash(block.data), GRAM)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    keys = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    place = (tb.sliding(keys, width - GRAM + 1, np.minimum) & mask).astype(np.int64)
    doc = tb.document_of(block.offsets)[: len(place)]
    valid = np.flatnonzero(block.offsets[1:][doc] - np.arange(len(place)) >= width)
    place = place[valid]
    starts = np.ones(len(valid), bool)
    starts[1:] = (place[1:] != place[:-1]) | (np.diff(valid) != 1)
    starts = np.flatnonzero(starts)
    last = valid[np.append(starts[1:], len(valid)) - 1] if len(starts) else none
    return hashes[place[starts]], valid[starts], last, doc[valid[starts]]


def _anchor_rows(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """(anchor, route, doc_id, places): one row per document and anchor. Anchors that already repeat here are routed by
    document and marked with place -1 in front; one more row of theirs, without places, tells the other batches."""
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    parts = []
    for block in tb.blocks(batch.column("text")):
        found, first, _, doc = anchors(block, width)
        parts.append((found, first - block.offsets[doc], ids[block.first + doc]))
    hashes, places, owner = (np.concatenate(x) for x in zip(*parts))
    owner = owner.astype(np.int64)
    order = np.lexsort((places, owner, hashes))
    hashes, places, owner = hashes[order], places[order], owner[order]
    if not len(hashes):
        return
    new_hash = np.ones(len(hashes), bool)
    new_hash[1:] = hashes[1:] != hashes[:-1]
    new_row = new_hash.copy()
    new_row[1:] |= owner[1:] != owner[:-1]
    rows = np.flatnonzero(new_row)
    group = np.cumsum(new_hash[rows]) - 1
    local = np.bincount(group)[group] > 1
    bounds = np.append(rows, len(hashes)).astype(np.int32)
    anchor, who = hashes[rows], owner[rows]
    route = np.where(local, tb.mix(anchor ^ tb.mix(who.view(np.uint64))), anchor)
    yield pa.record_batch(
        [pa.array(anchor.view(np.int64)), pa.array(route.view(np.int64)), pa.array(who), pa.array(local),
         pa.ListArray.from_arrays(pa.array(bounds), pa.array(places.astype(np.int32)))],
        ["anchor", "route", "doc_id", "local", "places"],
    )
    told = np.flatnonzero(local & new_hash[rows])
    if len(told):
        yield pa.record_batch(
            [pa.array(anchor[told].view(np.int64)), pa.array(anchor[told].view(np.int64)), pa.array(who[told]),
             pa.array(np.zeros(len(told), bool)), pa.nulls(len(told), pa.list_(pa.int32()))],
            ["anchor", "route", "doc_id", "local", "places"],
        )


def _block_rows(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """One row per document and distinct block with a shared anchor."""
    wanted = batch.column("places")
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    bounds = np.asarray(wanted.offsets)
    shared = np.asarray(wanted.values)
    for block in tb.blocks(batch.column("text")):
        hashes, first, last, doc = anchors(block, width)
        lo, hi = bounds[block.first], bounds[block.last]
        owners = np.repeat(np.arange(block.last - block.first), np.diff(bounds[block.first : block.last + 1]))
        at = np.sort(shared[lo:hi].astype(np.int64) + block.offsets[owners])
        near = np.minimum(np.searchsorted(at, first), max(0, len(at) - 1))
        keep = at[near] == first if len(at) else np.zeros(len(first), bool)
        hashes, first, last, doc = hashes[keep], first[keep], last[keep], doc[keep]
        if not len(hashes):
            continue
        end = last + width
        sums = tb.prefix_hash(block.data)
        one = tb.range_hash(sums, first, end)
        two = tb.mix(hashes ^ (tb.TABLE[block.data[first]] * (end - first).astype(np.uint64)))
        order = np.lexsort((first, two, one, doc))
        hashes, first, end, doc, one, two = (x[order] for x in (hashes, first, end, doc, one, two))
        new = np.ones(len(first), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        rows = np.flatnonzero(new)
        a, b = first[rows], end[rows]
        size = np.concatenate([[0], np.cumsum(b - a)])
        index = np.repeat(a - size[:-1], b - a) + np.arange(size[-1])
        bytes_ = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(size.astype(np.int32)), pa.py_buffer(block.data[index])])
        places = pa.ListArray.from_arrays(pa.array(np.append(rows, len(first)).astype(np.int32)), pa.array((first - block.offsets[doc]).astype(np.int32)))
        yield pa.record_batch(
            [pa.array(hashes[rows].view(np.int64)), pa.array(one[rows].view(np.int64)), pa.array(two[rows].view(np.int64)), bytes_,
             pa.array(ids[block.first + doc[rows]].astype(np.int64)), places],
            ["anchor", "b1", "b2", "bytes", "doc_id", "places"],
        )


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ordered = keys[order]
    steps = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]).astype(np.uint64)
    out = np.empty(len(keys), np.uint64)
    out[order] = steps
    return out


def suffix_array(text: np.ndarray, starts: np.ndarray, room: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at `starts`, and how long a prefix each shares with the one before (0 if under `least`).

    `room` is the number of bytes from each start to the end of its block, where `text` has a zero. Ranks of 8-byte prefixes
    are doubled until they cover the longest suffix; the common prefix is then read off by halving.
    """
    longest = int(room.max(initial=0))

    def ahead(values: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([values[by:], np.zeros(by, values.dtype)])

    v = text.astype(np.uint64)
    for shift in (1, 2, 4):
        v = (v << np.uint64(8 * shift)) | ahead(v, shift)
    levels, length = [(8, _ranks(v))], 8
    while length * 2 < longest:
        rank = levels[-1][1]
        levels.append((2 * length, _ranks((rank << np.uint64(32)) | ahead(rank, length))))
        length *= 2
    rank = levels[-1][1]  # two prefixes that overlap cover the longest suffix
    by_rank = np.argsort((rank[starts] << np.uint64(32)) | rank[np.minimum(starts + max(0, longest - length), len(text) - 1)])
    order, room = starts[by_rank], room[by_rank]
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        i, j = order[:-1], order[1:]
        half = [r for size, r in levels if size * 2 > least][0]
        size = [s for s, _ in levels if s * 2 > least][0]
        near = np.flatnonzero(half[i] == half[j]) if size <= least else np.arange(len(i))
        i, j = i[near], j[near]
        length = np.zeros(len(near), np.int64)
        top = len(text) - 1
        for size, rank in reversed(levels):
            a, b = np.minimum(i + length, top), np.minimum(j + length, top)
            length += np.where((rank[a] == rank[b]) & (length + size <= longest), size, 0)
        for _ in range(8):
            a, b = np.minimum(i + length, top), np.minimum(j + length, top)
            length += (text[a] == text[b]) & (text[a] != 0) & (length < longest)
        common[near + 1] = np.minimum(length, np.minimum(room[near], room[near + 1]))
    return order, np.where(common >= least, common, 0)


def intervals(common: np.ndarray) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of a suffix array, by one scan with a stack."""
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    near = np.flatnonzero(common)
    if not len(near):
        return found
    values = common[near].tolist()
    places = near.tolist()
    before = -2
    for k, length in zip(places, values):
        if k != before + 1:
            while stack:
                top, left = stack.pop()
                found.append((top, left, before))
        left = k - 1
        while stack and stack[-1][0] > length:
            top, left = stack.pop()
            found.append((top, left, k - 1))
        if not stack or stack[-1][0] < length:
            stack.append((length, left))
        before = k
    while stack:
        top, left = stack.pop()
        found.append((top, left, before))
    return found


def maximal_repeats(data: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of maximal repeats over blocks: length of each group, its occurrences (places in `data`), and their offsets.

    A group is a common-prefix interval whose occurrences don't all follow the same byte: an occurrence at the start of a
    block differs from every other. Repeats at least `least` bytes long are found up to the length of a block.
    """
    sizes = np.diff(bounds)
    longest = int(sizes.max(initial=0))
    pad = bounds[:-1] + np.arange(len(sizes))  # a zero after each block
    text = np.zeros(int(bounds[-1]) + len(sizes) + longest + 8, np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data + np.uint8(1)
    counts = np.maximum(sizes - least + 1, 0)
    base = np.concatenate([[0], np.cumsum(counts)])
    starts = np.repeat(pad - base[:-1], counts) + np.arange(base[-1])
    order, common = suffix_array(text, starts, np.repeat(pad + sizes, counts) - starts, least)
    left = np.where(order > 0, text[order - 1], 0).astype(np.int64)
    left = np.where(left == 0, -1 - np.arange(len(left)), left)
    changes = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    kept = [(length, a, b) for length, a, b in intervals(common) if changes[a] != changes[b]]
    if not kept:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(1, np.int64)
    length, first, last = np.array(kept, np.int64).T
    size = last - first + 1
    offsets = np.concatenate([[0], np.cumsum(size)])
    places = order[np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])]
    block = np.searchsorted(pad, places, "right") - 1
    return length, places - block, offsets


def _repeat_rows(anchor: np.ndarray, b1, b2, low, high, column: pa.Array, least: int) -> pa.RecordBatch:
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    alone = np.ones(len(anchor), bool)  # the only block of its anchor meets no other text
    alone[1:] &= anchor[1:] != anchor[:-1]
    alone[:-1] &= anchor[1:] != anchor[:-1]
    some = np.flatnonzero(~alone)
    own = np.concatenate([[0], np.cumsum(np.diff(bounds)[some])])
    met = data[np.repeat(~alone, np.diff(bounds))]
    length, places, offsets = maximal_repeats(met, own, least)
    block = some[np.searchsorted(own, places, "right") - 1]
    places = places - own[np.searchsorted(own, places, "right") - 1]
    group = np.repeat(np.arange(len(length)), np.diff(offsets))
    owner = np.minimum.reduceat(low[block], offsets[:-1]) if len(length) else np.zeros(0, np.int64)
    start, size, first = places, length[group], owner[group]
    names = tb.mix(b1[block[offsets[:-1]]].view(np.uint64) + start[offsets[:-1]].astype(np.uint64)) if len(length) else np.zeros(0, np.uint64)
    whole = np.flatnonzero(low < high)  # equal blocks were merged: a block of several documents repeats as a whole
    block = np.concatenate([block, whole])
    start, size = np.concatenate([start, np.zeros(len(whole), np.int64)]), np.concatenate([size, np.diff(bounds)[whole]])
    first = np.concatenate([first, low[whole]])
    names = np.concatenate([names[group], b1[whole].view(np.uint64)]).view(np.int64)
    keep = high[block] > first
    block = block[keep]
    return pa.record_batch(
        [pa.array(x) for x in (b1[block], b2[block], names[keep], start[keep].astype(np.int32), size[keep].astype(np.int32), first[keep])],
        ["b1", "b2", "group_id", "start", "length", "first_doc"],
    )


def _repeats(distinct: DataFrame, width: int) -> DataFrame:
    """Maximal repeats among the distinct blocks of each anchor; an anchor's blocks never leave their chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done(table: pa.Table) -> pa.RecordBatch:
            columns = [table.column(c).to_numpy() for c in ("anchor", "b1", "b2", "low", "high")]
            return _repeat_rows(*columns, table.column("bytes").combine_chunks(), width)

        for batch in batches:
            held.append(batch)
            size += batch.column("bytes").nbytes
            if size >= CHUNK_BYTES:
                table = pa.Table.from_batches(held)
                anchor = table.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))
                if cut:
                    yield done(table.slice(0, cut))
                    rest = table.slice(cut)
                    held, size = rest.to_batches(), rest.column("bytes").nbytes
        if held and sum(b.num_rows for b in held):
            yield done(pa.Table.from_batches(held))

    ordered = distinct.repartition("anchor").sortWithinPartitions("anchor")
    return map_partitions(ordered, run, "b1 long, b2 long, group_id long, start int, length int, first_doc long")


def _few(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


def repeat_groups(docs: DataFrame, width: int = MIN_BYTES) -> DataFrame:
    """`(group_id, length, first_doc, doc_id, starts)`: occurrences of repeated byte strings in other documents than the
    first, with all places in each document. `docs` needs `doc_id` (not null) and `text` (null counts as empty)."""
    docs = texts_of(docs).where("doc_id is not null")
    schema = "anchor long, route long, doc_id long, local boolean, places array<int>"
    rows = map_batches(docs, lambda b: _anchor_rows(b, width), schema)
    by_route = Window.partitionBy("route").orderBy("doc_id")
    other = F.lag("doc_id").over(by_route).isNotNull() | F.lead("doc_id").over(by_route).isNotNull()
    found = rows.withColumn("other", other).where("places is not null and (local or other)")
    found = found.groupBy("doc_id").agg(F.flatten(F.collect_list("places")).alias("places"))
    found = stored(found, "anchors")
    placed = docs.join(found, "doc_id")
    schema = "anchor long, b1 long, b2 long, bytes binary, doc_id long, places array<int>"
    blocks = stored(map_batches(placed, lambda b: _block_rows(b, width), schema), "blocks")
    discard(found)

    keys = ["anchor", "b1", "b2"]
    distinct = blocks.groupBy(*keys, "bytes").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    distinct = stored(distinct, "distinct")
    crowded = stored(distinct.groupBy("anchor").count().where(F.col("count") > SPLIT_BLOCKS).select("anchor"), "crowded")
    crowded = F.broadcast(crowded) if _few(crowded) else crowded
    repeats = _repeats(distinct.join(crowded, "anchor", "left_anti"), width)

    windows = distinct.join(crowded, "anchor", "left_semi").withColumn("start", F.explode(F.sequence(F.lit(0), F.length("bytes") - width)))
    windows = windows.select("b1", "b2", "low", "high", "start", F.col("bytes").substr(F.col("start") + 1, F.lit(width)).alias("w"))
    least = windows.groupBy("w").agg(F.min("low").alias("first_doc"))
    split = windows.join(least, "w").where("high > first_doc").select(
        "b1", "b2", F.xxhash64("w").alias("group_id"), F.col("start").cast("int").alias("start"), F.lit(width).alias("length"), "first_doc"
    )
    repeats = stored(repeats.unionByName(split), "repeats")
    discard(distinct)
    places = blocks.select("b1", "b2", "doc_id", "places")
    return places.join(repeats, ["b1", "b2"]).where("doc_id > first_doc").select(
        "group_id", "length", "first_doc", "doc_id", F.transform("places", lambda p: p + F.col("start")).alias("starts")
    )


def copies(docs: DataFrame) -> DataFrame:
    """Ids of rows whose whole text occurs under a smaller id, with its bytes; texts are told apart by length and SHA-256."""
    texts = docs.select("doc_id", F.length(F.col("text").cast("binary")).alias("n"), F.sha2("text", 256).alias("digest")).where("n > 0")
    texts = stored(texts.where("doc_id is not null"), "digests")
    first = texts.groupBy("n", "digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1")
    return texts.join(first.drop("times"), ["n", "digest"]).where("doc_id > first").select("doc_id", "n")


def _cut(batch: pa.RecordBatch, with_text: bool) -> Iterator[pa.RecordBatch]:
    import hashlib

    columns = [batch.column(c) for c in ("whole", "starts", "ends")]
    out = []
    for i, text in enumerate(batch.column("text")):  # one text at a time
        data = (text.as_py() or "").encode()
        whole, starts, ends = (c[i].as_py() for c in columns)
        spans = ([(0, len(data))] if data else []) if whole else merged(starts or [], ends or [])
        if with_text:
            spans = [s for s in (character_span(data, *s) for s in spans) if s[0] < s[1]]
        kept, at = [], 0
        for a, b in spans:
            kept.append(data[at:a])
            at = b
        rest = b"".join([*kept, data[at:]])
        out.append((len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8") if with_text else None))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = [pa.array(x, t) for x, t in zip(zip(*out), kinds)]
    yield pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The union of spans as disjoint spans that don't touch, in order."""
    if not starts:
        return []
    a, b = np.asarray(starts), np.asarray(ends)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return list(zip(a[new].tolist(), b[np.append(np.flatnonzero(new)[1:], len(a)) - 1].tolist()))


def character_span(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The part of a span that consists of whole UTF-8 characters."""
    while start < end and data[start] & 0xC0 == 0x80:
        start += 1
    while start < end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def _with_spans(docs: DataFrame, width: int, *carried) -> DataFrame:
    """Ids, texts and carried columns, with the spans to remove and whether the whole text is a copy."""
    texts = texts_of(docs)
    same = stored(copies(texts).where(F.col("n") >= width).select("doc_id").distinct(), "copies")
    whole = F.broadcast(same) if _few(same) else same
    once = texts.join(whole, "doc_id", "left_anti")
    found = repeat_groups(once, width).select("doc_id", "length", F.explode("starts").alias("start"))
    ends = (F.col("start") + F.col("length")).alias("end")
    # spans of one start differ only in length, so the longest will do
    spans = found.select("doc_id", "start", ends).groupBy("doc_id", "start").agg(F.max("end").alias("end"))
    spans = spans.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    return rows.join(stored(spans, "spans"), "doc_id", "left").join(whole.withColumn("whole", F.lit(True)), "doc_id", "left")


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def deduplicated(docs: DataFrame, width: int = MIN_BYTES, with_text: bool = False) -> DataFrame:
    """`(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)` per row of `docs(doc_id, text)`.

    Removed is every byte covered by a string of `width` bytes that also starts in a document with a smaller id, judged on
    the input. Null and empty texts, texts shorter than `width` and rows without an id keep all they have. An id stands for one
    text; repeated rows get the same result each. `kept` is null unless `with_text`: then spans shrink to whole characters,
    so that the kept text stays valid. Other columns are not looked at; an empty table gives an empty result.
    """
    return map_batches(_with_spans(docs, width), lambda b: _cut(b, with_text), CUT)


def without_repeats(docs: DataFrame, width: int = MIN_BYTES) -> DataFrame:
    """The rows of `docs`, with all columns: texts without their repeated parts, and `n_chars`, if there, to match.

    Only whole characters are removed. A null text stays null; a text that is a copy becomes empty.
    """
    carried = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("carried")
    rows = _with_spans(docs, width, carried)

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for done in _cut(batch, True):
            yield pa.record_batch([batch.column("carried"), done.column("kept")], ["carried", "kept"])

    schema = T.StructType([rows.schema["carried"], T.StructField("kept", T.StringType())])
    text = F.when(F.col(f"carried.c{docs.columns.index('text')}").isNotNull(), F.col("kept"))
    own = {"text": text, "n_chars": F.char_length(text).cast("long")}
    names = [own.get(c, F.col(f"carried.c{i}")).alias(c) for i, c in enumerate(docs.columns)]
    return map_batches(rows, cut, schema).select(*names)
