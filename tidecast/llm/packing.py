"""Sequences of bounded length, packed by vector bin packing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from struct import pack
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import map_arrow, table
from tidecast.llm.tokenizing import encoder

TOKENS, SEGMENTS = 2048, 256
#: Pieces that wait for a place in a task, and sequences that they may fill before more rows are read.
POOL = 2048


@dataclass
class Example:
    """A part of a row's ids, from ``start`` on, of no more than a sequence; the first ``prompt`` of them bear no loss."""

    row: object
    ids: bytes
    prompt: int
    start: int
    row_tokens: int

    @property
    def tokens(self) -> int:
        return len(self.ids) // 4

    def loss(self, length: int) -> int:
        return max(0, length - self.prompt)

    def parts(self, length: int) -> Iterator[Example]:
        """Cut after every ``length`` ids."""
        for i in range(0, self.tokens, length):
            ids = self.ids[4 * i : 4 * (i + length)]
            yield Example(self.row, ids, max(0, min(self.prompt - i, len(ids) // 4)), self.start + i, self.row_tokens)


@dataclass
class Packer:
    """Fills one sequence after the other from a pool of examples.

    A sequence takes the example whose demand has the largest dot product with what is left of the limits, each
    limit as a part of its whole, among those that fit. If none fits, the one of which most fits is cut where a limit
    is reached. So a sequence is closed only when a limit is used up.
    """

    tokens: int
    segments: int
    loss: int
    full: int = POOL
    pool: list = field(default_factory=list)
    demand: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    extent: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    used: int = 0

    def add(self, example: Example) -> None:
        if self.used == len(self.demand):
            self.demand = np.vstack([self.demand, np.zeros((max(64, self.used), 3))])
            self.extent = np.vstack([self.extent, np.zeros((max(64, self.used), 2), np.int64)])
        self.extent[self.used] = example.tokens, example.prompt
        self.demand[self.used] = example.tokens / self.tokens, 1 / self.segments, example.loss(example.tokens) / self.loss
        self.pool.append(example)
        self.used += 1

    def _take(self, i: int) -> Example:
        example, last = self.pool[i], self.pool.pop()
        self.used -= 1
        if i < self.used:
            self.pool[i], self.demand[i], self.extent[i] = last, self.demand[self.used], self.extent[self.used]
        return example

    def sequence(self) -> Iterator[tuple[Example, int]]:
        """The pieces of the next sequence and their offsets."""
        at, segments, loss = 0, 0, 0
        while self.used and at < self.tokens and segments < self.segments:
            left = np.array([1 - at / self.tokens, 1 - segments / self.segments, 1 - loss / self.loss])
            demand = self.demand[: self.used]
            fits = (demand <= left + 1e-9).all(1)
            if fits.any():
                example = self._take(int(np.argmax(np.where(fits, demand @ left, -1.0))))
            else:
                size, prompt = self.extent[: self.used].T
                lengths = np.minimum(size, np.minimum(self.tokens - at, prompt + self.loss - loss))
                i = int(np.argmax(lengths))
                if not (length := int(lengths[i])):
                    return
                whole = self._take(i)
                example = next(whole.parts(length))
                rest = whole.ids[4 * length :]
                self.add(Example(whole.row, rest, max(0, whole.prompt - length), whole.start + length, whole.row_tokens))
            yield example, at
            at, segments, loss = at + example.tokens, segments + 1, loss + example.loss(example.tokens)

    def whole(self, example: Example) -> bool:
        """Whether an example fills a sequence by itself within the other limits."""
        return example.tokens == self.tokens and example.loss(example.tokens) <= self.loss

    def sequences(self, *, end: bool) -> Iterator[list[tuple[Example, int]]]:
        """Sequences while the pool is full; at the end, until it is empty."""
        while self.used > (0 if end else self.full):
            yield list(self.sequence())


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    end_id: int = 1,
    tokens: int = TOKENS,
    segments: int = SEGMENTS,
    loss: int | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: ``<id_col>, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    Limits hold together for each sequence: ``tokens``, ``segments`` (pieces), and ``loss`` (ids that bear loss; as
    many as ``tokens`` unless given). The ids of ``prompt_col``, which come before those of the text, bear none.

    Each task packs the rows that it reads, without a shuffle, from a pool of bounded size; only the last sequence of
    a task is not full where the tokens are the limit. Sequences are numbered within the task, after its number. A
    null text or prompt is empty; every row has its end id, so each has a piece. Repeated rows and ids are packed
    each. Other columns are not read.
    """
    loss = tokens if loss is None else loss
    if min(tokens, segments, loss) < 1:
        raise ValueError("limits must be positive")
    prompt = F.lit("") if prompt_col is None else F.coalesce(F.col(prompt_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), prompt.alias("prompt"))
    kind = df.schema[id_col].dataType.simpleString()
    names = ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
    schema = f"id {kind}, " + ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, end = encoder(tokenizer), Packer(tokens, segments, loss), pack("<I", end_id)
        number, out, id_type = TaskContext.get().partitionId() << 32, [], None

        def placed(sequences: Iterable[list[tuple[Example, int]]]) -> None:
            nonlocal number
            for sequence in sequences:
                for e, offset in sequence:
                    row = (e.row, e.start, e.tokens, crc32(e.ids), e.row_tokens, number, offset)
                    out.append((*row, e.ids) if with_ids else row)
                number += 1

        def made() -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * 6, *([pa.binary()] if with_ids else [])]
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=list(names))

        for batch in batches:
            id_type = batch.column(0).type
            for row, text, lead in zip(*batch.columns, strict=True):
                head = encode.bytes_of(lead.as_py())
                ids = head + encode.bytes_of(text.as_py()) + end
                for part in Example(row.as_py(), ids, len(head) // 4, 0, len(ids) // 4).parts(tokens):
                    if packer.whole(part):
                        placed([[(part, 0)]])
                    else:
                        packer.add(part)
                        placed(packer.sequences(end=False))
                if len(out) >= 10_000:
                    yield made()
        placed(packer.sequences(end=True))
        if out:
            yield made()

    return map_arrow(rows, run, schema).withColumnRenamed("id", id_col)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_stage(spark, table(spark, sf_dir, "documents"), sf_dir)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
