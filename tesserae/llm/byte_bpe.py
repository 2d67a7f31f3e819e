"""Byte-level BPE with the tiktoken library and a local rank file: encoding, and decoding to raw bytes.

Long texts are split before they are encoded, at places where no match of the splitting pattern can reach across: before a
space that follows a character other than white space and is followed by one. A space starts a match there or stands before one, and
white space runs are never cut there. So the ids are those of the whole text, and the regular expression works on short pieces.
A long run of white space matches as one piece, but for its last character if more text follows; it is encoded without the
regular expression, whose memory grows with such runs.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.shared import map_batches, texts_of

PIECE = 1 << 16
LONG_RUN = 1_000
_SAFE = re.compile(r"(?<=\S) (?=\S)")
# white space by Unicode, as the library's pattern takes it
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, piece: int = PIECE) -> np.ndarray:
        if len(text) <= piece:
            return np.asarray(self.encoding.encode_ordinary(text), "<u4")
        ids, at = [], 0
        for run in _RUN.finditer(text):
            ids += self._pieces(text, at, run.start(), piece)
            at = run.end() if run.end() == len(text) else run.end() - 1
            ids.append(self.encoding._encode_single_piece(text[run.start() : at]))
        ids += self._pieces(text, at, len(text), piece)
        return np.concatenate([np.asarray(part, "<u4") for part in ids])

    def _pieces(self, text: str, at: int, stop: int, piece: int) -> Iterator[list[int]]:
        while at < stop:
            cut = _SAFE.search(text, min(at + piece, stop), stop)
            end = cut.start() if cut else stop
            yield self.encoding.encode_ordinary(text[at:end])
            at = end

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of this worker: a rank file is read once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encoded(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """`(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)` per row of `docs(doc_id, text)`.

    Digests are of the ids as little-endian unsigned 32-bit integers and of the bytes decoded from them. `ids` holds those
    integers as bytes if `with_ids`, else null. A null text counts as empty and has no tokens. Rows keep their number and
    ids, repeated or null; other columns are not looked at; an empty table gives an empty result. No special tokens: their
    spelling in a text is ordinary text.
    """
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        counts, digests, decoded, kept = [], [], [], []
        for text in batch.column("text").fill_null("").to_pylist():
            ids = own.encode(text)
            raw = ids.tobytes()
            counts.append(len(ids))
            digests.append(hashlib.sha256(raw).hexdigest())
            decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            kept.append(raw if with_ids else None)
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded), pa.array(kept, pa.binary())]
        yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return map_batches(texts_of(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")


def decoded(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """`(doc_id, bytes)` from `tokens(doc_id, ids)`; null ids give null."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        out = [None if x is None else own.decode(np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return map_batches(tokens.select("doc_id", "ids"), run, "doc_id long, bytes binary")
