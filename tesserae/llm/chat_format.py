"""Chat formatting on token ids: conversations become rows of ids with a loss mask, and can be read back from them.

    user       <s>[INST]text[/INST]
    assistant  text</s>
    system     <<SYS>>text<</SYS>>
    others     [ROLE]role[TEXT]text[/ROLE]

Each text is encoded on its own, so a mark never merges with its neighbours. Marks are spliced in as reserved ids behind the
vocabulary, which no text yields. In the printed form, too, a text can't be taken for a mark: `</s>` in a text is written `<\\/s>`,
and one that already has backslashes there gets one more, so that the step can be undone.

Rows are dealt by ranges of (conversation, turn): a conversation with very many turns is spread over tasks and comes as several
parts, in order. A part ends between turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.byte_bpe import codec
from tesserae.llm.shared import map_partitions

MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]")
# marks before and after the text, by role
FRAMES = {"user": (("<s>", "[INST]"), "[/INST]"), "assistant": ((), "</s>"), "system": (("<<SYS>>",), "<</SYS>>")}
OPEN, BETWEEN, CLOSE = "[ROLE]", "[TEXT]", "[/ROLE]"
LEARNED = "assistant"
PART_IDS = 1 << 20
FORMATTED = "conv_id long, part long, whole boolean, n_turns long, ids binary, mask binary"

_rest = "|".join(re.escape(m[1:]) for m in MARKS)
ESCAPE = rf"([<\[])(\\*)({_rest})"
_escape, _unescape = re.compile(ESCAPE), re.compile(rf"([<\[])\\(\\*)({_rest})")


def escaped(text: str) -> str:
    return _escape.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return _unescape.sub(r"\1\2\3", text)


class Template:
    """Encodes turns and reads them back, with the vocabulary of a rank file."""

    def __init__(self, ranks: str, pattern: str) -> None:
        self.codec = codec(ranks, pattern)
        self.first = self.codec.encoding.n_vocab + 1  # the id behind the vocabulary is left to those who end documents with it
        self.ids = {mark: self.first + i for i, mark in enumerate(MARKS)}
        self.kind = np.dtype("<u2" if self.first + len(MARKS) <= 1 << 16 else "<u4")
        self.closes = {self.ids[close]: role for role, (_, close) in FRAMES.items()} | {self.ids[CLOSE]: None}

    def encode(self, text: str) -> np.ndarray:
        return self.codec.encode(escaped(text)).astype(self.kind)

    def _marks(self, marks: Iterable[str]) -> np.ndarray:
        return np.array([self.ids[m] for m in marks], self.kind)

    def assemble(self, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and loss mask of the turns one after the other, and where each turn ends."""
        pieces = []
        for role, text in zip(roles, texts):
            if role in FRAMES:
                opens, close = FRAMES[role]
                head = self._marks(opens)
            else:
                head, close = np.concatenate([self._marks([OPEN]), self.encode(role), self._marks([BETWEEN])]), CLOSE
            pieces += [head, self.encode(text), self._marks([close])]
        ends = np.cumsum([len(p) for p in pieces]).reshape(-1, 3)
        learned = np.array([r == LEARNED for r in roles])
        step = np.zeros(ends[-1, 2] + 1, np.int8)
        np.add.at(step, ends[learned, 0], 1)
        np.add.at(step, ends[learned, 1], -1)
        return np.concatenate(pieces), np.cumsum(step[:-1], dtype=np.uint8), ends[:, 2]

    def text(self, ids: np.ndarray) -> str:
        return self.codec.decode(ids).decode()

    def turns(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str, str]]:
        """Role, text, printed form and text under the loss mask, of each turn."""
        learned, start, role, begin = mask.astype(bool), 0, None, 0
        printed: list[str] = []
        for at in np.flatnonzero(ids >= self.first).tolist():
            mark = int(ids[at])
            body = self.text(ids[start:at])
            printed += [body, MARKS[mark - self.first]]
            if mark == self.ids[BETWEEN]:
                role = unescaped(body)
            elif mark in self.closes:
                under = ids[begin : at + 1][learned[begin : at + 1]]
                loss = unescaped(self.text(under[under < self.first]))
                yield role if self.closes[mark] is None else self.closes[mark], unescaped(body), "".join(printed), loss
                printed, begin = [], at + 1
            start = at + 1


_templates: dict[tuple[str, str], Template] = {}


def template(ranks: str, pattern: str) -> Template:
    """The template of this worker: a rank file is read once."""
    if (ranks, pattern) not in _templates:
        _templates[ranks, pattern] = Template(ranks, pattern)
    return _templates[ranks, pattern]


@dataclass
class _Part:
    conv_id: int | None
    number: int
    alone: bool
    turns: int = 0
    size: int = 0
    ids: list[np.ndarray] = field(default_factory=list)
    mask: list[np.ndarray] = field(default_factory=list)

    def row(self, whole: bool) -> pa.RecordBatch:
        ids, mask = (b"".join(x.tobytes() for x in xs) for xs in (self.ids, self.mask))
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())
        values = (self.conv_id, self.number, whole, self.turns, ids, mask)
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], ["conv_id", "part", "whole", "n_turns", "ids", "mask"])


def formatted(turns: DataFrame, ranks: str, pattern: str, part_ids: int = PART_IDS) -> DataFrame:
    """`(conv_id, part, whole, n_turns, ids, mask)` from `turns(conv_id, turn, role, text)`.

    `ids` are little-endian integers of 16 bits if the vocabulary allows, else of 32; `mask` has a byte for each of them: 1 for
    the texts of the assistant. Parts of a conversation, in the order of `part`, follow each other; `whole` is true if a part
    is known to be all of its conversation. A part is closed once it has `part_ids` ids; a single turn is never cut. Turns are
    ordered by turn (null first), role and digest of the text; rows alike in these are interchangeable and all kept. A null text
    or role counts as empty. Rows without conv_id are one conversation. Other columns are not looked at; an empty table
    gives an empty result.
    """
    empty = F.lit("")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    ).withColumns({"digest": F.md5(F.col("text").cast("binary")), "spread": F.spark_partition_id()})
    order = ["conv_id", "turn", "role", "digest"]
    dealt = rows.repartitionByRange(*order, "spread").sortWithinPartitions(*order).select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = template(ranks, pattern), TaskContext.get().partitionId() << 32
        part = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, mask, ends = own.assemble(batch.column("role").to_pylist(), batch.column("text").to_pylist())
            at = 0
            for conv_id, end in zip(batch.column("conv_id").to_pylist(), ends.tolist()):
                if part is None or part.conv_id != conv_id:
                    if part is not None:
                        yield part.row(part.alone)
                        number += 1
                    # the first conversation of a task may have begun in the task before
                    part = _Part(conv_id, number, alone=part is not None)
                elif part.size >= part_ids:
                    yield part.row(False)
                    number += 1
                    part = _Part(conv_id, number, alone=False)
                part.ids.append(ids[at:end])
                part.mask.append(mask[at:end])
                part.turns += 1
                part.size += end - at
                at = end
        if part is not None:
            yield part.row(False)

    return map_partitions(dealt, run, FORMATTED)


def read_turns(formats: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """`(conv_id, part, place, role, text, printed, loss)`: the turns, read back from the rows of `formatted`.

    `printed` is the turn with its marks and escapes, `loss` its text under the loss mask. `place` counts turns in a part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = template(ranks, pattern)
        for batch in batches:
            for conv_id, part, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "ids", "mask"))):
                found = own.turns(np.frombuffer(ids, own.kind), np.frombuffer(mask, np.uint8))
                rows = [(conv_id, part, place, *turn) for place, turn in enumerate(found)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4)
                columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
                yield pa.record_batch(columns, ["conv_id", "part", "place", "role", "text", "printed", "loss"])

    schema = "conv_id long, part long, place long, role string, text string, printed string, loss string"
    return map_partitions(formats.select("conv_id", "part", "ids", "mask"), run, schema)


class _Digest:
    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.n, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, printed: str, loss: str) -> None:
        self.n += 1
        self.turns.update(f"{role}\n{text}\n".encode())
        self.loss.update(loss.encode())
        self.loss_chars += len(loss)
        self.chars += len(printed)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(formats: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """`(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)` per conversation, read back from `formatted`.

    Conversations known to be in one part need no shuffle. Parts of the others meet in the order of their numbers; a task reads
    them one after the other and keeps running digests only.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, open_, done = template(ranks, pattern), None, []

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array(values, kind) for values, kind in zip(zip(*done), kinds)], names)

        for batch in batches:
            for conv_id, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "mask"))):
                if open_ is None or open_.conv_id != conv_id:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = _Digest(conv_id)
                for turn in own.turns(np.frombuffer(ids, own.kind), np.frombuffer(mask, np.uint8)):
                    open_.add(*turn)
            if done:
                yield flush()
                done = []
        if open_ is not None:
            done.append(open_.row())
            yield flush()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    parts = formats.select("conv_id", "part", "whole", "ids", "mask")
    split = parts.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return map_partitions(parts.where("whole"), run, schema).unionAll(map_partitions(split, run, schema))
