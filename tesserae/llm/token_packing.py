"""Token ids in fixed-width bit packing: each id takes the fewest bits that hold the vocabulary.

File format, little-endian. A file holds consecutive documents in ascending id order:

    magic "TPK1" | u32 bits | u64 documents | u64 ids | u32 ids per block | u32 blocks
    i64 doc_id of each document
    u64 end of each document, counted in ids from the start of the file
    u64 byte offset of each block from the start of the ids
    packed ids: block after block, each starts at a whole byte, the first id in the lowest bits

Blocks make random access cheap: id k lies in block k // ids_per_block, and a block unpacks with a few numpy operations.
`manifest` rows (path, first doc, documents, ids, start) order the files.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import textbytes as tb
from tesserae.llm.shared import map_batches, map_partitions, shared_folder, ship, stored, texts_of

BLOCK_IDS = 4096
HEADER = struct.Struct("<4sIQQII")
END_ID = 1
DOCS_PER_FILE = 10_000
CACHE_WORDS = 900_000
ENCODE_BYTES = 8 << 20
#: one run of these at the end of a word is a token run of its own, if a plain letter or digit stands before it
TAIL = ".,!?;:#$%&*+-/=@^_~"
PLAIN = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Lowest bits first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    raw = np.frombuffer(data, np.uint8)
    raw = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    at = np.arange(n, dtype=np.int64) * bits
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        value |= raw[byte + k] << np.uint64(8 * k)
    return ((value >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def to_bytes(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    parts = [pack(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1].astype("<u8")
    head = HEADER.pack(b"TPK1", bits, len(doc_ids), len(ids), block_ids, len(parts))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), ends.astype("<u8").tobytes(), offsets.tobytes(), *parts])


class Reader:
    """Random access to one file: only the blocks that hold the wanted ids are read."""

    def __init__(self, handle) -> None:
        self.handle = handle
        handle.seek(0)
        magic, self.bits, docs, self.n, self.block_ids, blocks = HEADER.unpack(handle.read(HEADER.size))
        if magic != b"TPK1":
            raise ValueError("This is not a file of packed ids.")
        self.doc_ids = np.frombuffer(handle.read(8 * docs), "<i8")
        self.ends = np.frombuffer(handle.read(8 * docs), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(handle.read(8 * blocks), "<u8").astype(np.int64)
        self.base = HEADER.size + 16 * docs + 8 * blocks

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from `start` to before `end` of the file."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        stop = min(self.n, (last + 1) * self.block_ids)
        tail = ((stop - last * self.block_ids) * self.bits + 7) // 8
        self.handle.seek(self.base + int(self.offsets[first]))
        raw = self.handle.read(int(self.offsets[last] - self.offsets[first]) + tail)
        out = []
        for b in range(first, last + 1):
            at = int(self.offsets[b] - self.offsets[first])
            n = min(self.block_ids, self.n - b * self.block_ids)
            out.append(unpack(raw[at : at + (n * self.bits + 7) // 8], self.bits, n))
        return np.concatenate(out)[start - first * self.block_ids : end - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


class WordEncoder:
    """Encodes with a tokenizer that drops white space: each run between ASCII white space is encoded once and remembered.

    Such a tokenizer never joins text across white space. Lower-casing (ASCII words only, and none that spells an added token
    in any case, as those match raw text) and splitting off a tail of plain
    punctuation, which the tokenizer's own pattern does too, make more runs alike. At most `CACHE_WORDS` are remembered.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.ids, self.ends = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]

    def _learn(self, words: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        lists = [e.ids for e in found]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.ids = [np.concatenate([*self.ids, np.fromiter((i for x in lists for i in x), np.uint32, sizes.sum())])]
        ends = self.ends[0] if len(self.ends) == 1 else np.concatenate(self.ends)
        self.ends = [np.concatenate([ends, ends[-1] + np.cumsum(sizes)])]
        self.row.update(zip(words, range(len(self.row), len(self.row) + len(words))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the end of each text."""
        if len(self.row) > CACHE_WORDS:
            self.clear()
        lists = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        coded = pc.dictionary_encode(lists.flatten())
        words = coded.dictionary.to_pylist()
        tails, heads = [], []
        for w in words:
            head = w.rstrip(TAIL)
            if head and head[-1] not in PLAIN:
                head = w
            tails.append(w[len(head) :])
            low = head.lower() if head.isascii() else head
            heads.append(head if low != head and any(t in low for t in self.added) else low)
        new = dict.fromkeys(x for x in [*heads, *set(tails)] if x not in self.row)
        if new:
            self._learn(list(new))
        get = self.row.__getitem__
        pieces = np.empty((len(words), 2), np.int64)
        pieces[:, 0] = np.fromiter(map(get, heads), np.int64, len(words))
        pieces[:, 1] = np.fromiter(map(get, tails), np.int64, len(words))
        used = pieces[coded.indices.to_numpy()].ravel()
        ends, ids = self.ends[0], self.ids[0]
        start, size = ends[used], ends[used + 1] - ends[used]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = ids[np.repeat(start - total[:-1], size) + np.arange(total[-1])]
        offsets = np.asarray(lists.offsets)
        return flat, total[2 * (offsets[1:] - offsets[0])]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pafs.FileSystem.from_uri(uri if re.match(r"\w+:/", uri) else f"file://{os.path.abspath(uri)}")


def write_packed(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, docs_per_file: int = DOCS_PER_FILE) -> DataFrame:
    """Encode all texts, append `end_id` to each, and write files in ascending doc_id order into `folder`; gives the manifest.

    Ranges of ids are cut by approximate quantiles of the ids alone, so texts are read once and only packed ids are
    shuffled. A task writes a file under another name and renames it, so a repeated task does no harm. Null texts count as
    empty: they hold the end id alone. Rows with a null id come first, repeated ids stay next to each other. `folder` is a
    path or a URI that pyarrow's file systems reach. An empty table gives no file.
    """
    docs = texts_of(docs)
    spark = docs.sparkSession
    ship(spark)
    rows = docs.count()
    parts = -(-rows // docs_per_file)
    cuts = []
    if parts > 1:
        cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    cuts = np.unique(np.asarray(cuts, np.int64))
    bits = bits_for(max(encoder(tokenizer).vocabulary, end_id + 1))

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for block in tb.blocks(batch.column("text"), ENCODE_BYTES):
            part = batch.slice(block.first, block.last - block.first)
            ids, ends = own.encode(part.column("text"))
            starts = np.concatenate([[0], ends[:-1]])
            packed = [pack(np.append(ids[a:b], np.uint32(end_id)), bits) for a, b in zip(starts, ends)]
            keys = part.column("doc_id").fill_null(-(1 << 63)).to_numpy()
            place = np.searchsorted(cuts, keys, "right").astype(np.int32)
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(place), pa.array(ends - starts + 1), pa.array(packed, pa.binary())],
                ["doc_id", "part", "n", "packed"],
            )

    packed = map_batches(docs, encode, "doc_id long, part int, n long, packed binary")
    run = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], None

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            sizes = table.column("n").to_numpy()
            raw = [unpack(p, bits, n) for p, n in zip(table.column("packed").to_pylist(), sizes.tolist())]
            ids = np.concatenate(raw)
            keys = table.column("doc_id").fill_null(-(1 << 63)).to_numpy()
            data = to_bytes(keys, np.cumsum(sizes), ids, bits)
            fs, path = _filesystem(folder)
            fs.create_dir(path, recursive=True)
            name = f"{path}/ids-{part:06d}.tpk"
            own = f"{path}/.{run}-{part:06d}-{uuid.uuid4().hex}"
            with fs.open_output_stream(own) as out:
                out.write(data)
            fs.move(own, name)
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([f"ids-{part:06d}.tpk"]), pa.array([len(keys)]), pa.array([len(ids)])],
                ["part", "name", "documents", "ids"],
            )

        for batch in batches:
            numbers = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if held and numbers[a] != part:
                    yield flush()
                    held = []
                part = int(numbers[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    ordered = packed.repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first())
    return stored(map_partitions(ordered, write, "part int, name string, documents long, ids long"), "manifest")


def read_packed(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """`(doc_id, start, n_tokens, ids_crc32)` of every document, read from the files. `start` counts all ids before it.

    The manifest has a row per file, and its running total is taken on the driver: rows / `docs_per_file` small numbers.
    """
    ship(spark)
    files = manifest.orderBy("part").toArrow().to_pylist()
    total, rows = 0, []
    for f in files:
        rows.append((f["name"], total))
        total += f["ids"]
    listed = spark.createDataFrame(rows, "name string, start long").repartition(max(1, min(len(rows), 10_000)), "name")

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
            with fs.open_input_file(f"{path}/{name}") as handle:
                file = Reader(handle)
                ends = file.ends
                starts = np.concatenate([[0], ends[:-1]])
                sums = np.empty(len(ends), np.int64)
                for lo in range(0, len(ends), 2_000):
                    hi = min(lo + 2_000, len(ends))
                    ids = file.ids(int(starts[lo]), int(ends[hi - 1])).astype("<u4")
                    for i in range(lo, hi):
                        sums[i] = zlib.crc32(ids[starts[i] - starts[lo] : ends[i] - starts[lo]])
                none = file.doc_ids == -(1 << 63)
                yield pa.record_batch(
                    [pa.array(file.doc_ids, pa.int64(), mask=none), pa.array(starts + start), pa.array(ends - starts), pa.array(sums)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return map_batches(listed, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_documents(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write all documents and read them back."""
    folder = folder or shared_folder(docs.sparkSession, "packed")
    return read_packed(docs.sparkSession, folder, write_packed(docs, folder, tokenizer))
