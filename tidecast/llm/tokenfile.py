"""Token ids of a corpus in seekable Zstandard files, and how to read single documents from them."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.common import map_arrow, own_name, schema_of, small, stored, table
from tidecast.llm.files import new_file, open_file
from tidecast.llm.tokenizing import encoder
from tidecast.storage import scratch_path

#: Bytes of ids in a frame before it is closed; a longer document takes several frames.
FRAME_BYTES = 1 << 20
FILE_BYTES = 256 << 20
#: Bytes of ids that one task reads.
READ_BYTES = 64 << 20
#: Fixed values of the public seekable format: a skippable frame at the end, with a row for each frame.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
ROW, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
CHECKSUMS = 0x80


class FrameWriter:
    """Independent frames of ids, then the seek table: size before and after decompression and checksum of each.

    A skippable frame before the seek table holds a checksum of the table itself.
    """

    def __init__(self, stream, level: int = 3) -> None:
        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=level)
        self.buffer, self.rows, self.written = bytearray(), [], 0

    def _frame(self, data: bytes) -> None:
        packed = self.packer.compress(data)
        self.stream.write(packed)
        self.written += len(packed)
        self.rows.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, ids: bytes) -> tuple[int, int]:
        """Frame and byte in it where the ids begin."""
        if self.buffer and len(self.buffer) + len(ids) > FRAME_BYTES:
            self.flush()
        at = len(self.rows), len(self.buffer)
        self.buffer += ids
        while len(self.buffer) > FRAME_BYTES:
            self._frame(bytes(self.buffer[:FRAME_BYTES]))
            del self.buffer[:FRAME_BYTES]
        return at

    def flush(self) -> None:
        if self.buffer:
            self._frame(bytes(self.buffer))
            self.buffer.clear()

    def close(self) -> None:
        self.flush()
        table_ = b"".join(ROW.pack(*r) for r in self.rows)
        self.stream.write(struct.pack("<III", SKIPPABLE, 4, xxhash.xxh32_intdigest(table_)))
        body = table_ + FOOTER.pack(len(self.rows), CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.stream.close()


class FrameReader:
    """Ranges of ids of a file; only the frames that hold them are read and decompressed."""

    def __init__(self, source) -> None:
        self.source, size = source, source.size()
        count, flags, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        length = ROW.size * count
        ends = size - FOOTER.size - length - 20  # the checksum's frame and the head of the table's
        if ends < 0:
            raise ValueError("the seek table is damaged")
        lead, table_ = source.read_at(20, ends), source.read_at(length, size - FOOTER.size - length)
        heads = struct.pack("<III", SKIPPABLE, 4, xxhash.xxh32_intdigest(table_)) + struct.pack("<II", SKIPPABLE, length + FOOTER.size)
        self.rows, at = [], 0
        for packed, plain, check in ROW.iter_unpack(table_):
            self.rows.append((at, packed, plain, check))
            at += packed
        if lead != heads or at != ends:
            raise ValueError("the seek table is damaged")
        self.unpacker, self.last = zstandard.ZstdDecompressor(), (-1, b"")

    def frame(self, n: int) -> bytes:
        if self.last[0] != n:
            at, packed, plain, check = self.rows[n]
            data = self.unpacker.decompress(self.source.read_at(packed, at), max_output_size=plain)
            if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {n} is damaged")
            self.last = n, data
        return self.last[1]

    def read(self, frame: int, at: int, size: int) -> bytes:
        parts = []
        while size > 0:
            part = self.frame(frame)[at : at + size]
            parts.append(part)
            size, frame, at = size - len(part), frame + 1, 0
        return b"".join(parts)


def write_tokens(
    df: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
) -> DataFrame:
    """Write the ids of all texts to files in ``folder``, by ascending id; returns the stored index.

    Index: ``<id_col>, start`` (ids of all documents before it), ``n_tokens`` (with ``end_id``), ``file, frame,
    at`` (the byte in the decompressed frame). A null text is empty and has the end id only. Null ids come first;
    rows with the same id are ordered by a hash of their text. Rows are dealt out by ranges of ids before they are
    encoded; starts follow from a sum for each file.
    """
    spark, tie = df.sparkSession, own_name("tie")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn(tie, F.xxhash64("text")).repartitionByRange("id", tie).sortWithinPartitions("id", tie).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, end, writer, n = TaskContext.get().partitionId(), encoder(tokenizer), struct.pack("<I", end_id), None, 0
        for batch in batches:
            out = {k: [] for k in ("file", "place", "first", "n_tokens", "frame", "at")}
            for text in batch.column(1):
                ids = encode.bytes_of(text.as_py()) + end
                if writer is not None and writer.written > FILE_BYTES:
                    writer.close()
                    writer = None
                if writer is None:
                    stream, uri = new_file(folder, part, "ids.zst")
                    writer, first, n = FrameWriter(stream), 0, n + 1
                frame, at = writer.add(ids)
                for k, v in zip(out, (uri, part << 20 | n, first, len(ids) // 4, frame, at), strict=True):
                    out[k].append(v)
                first += len(ids) // 4
            arrays = [pa.array(v, pa.string() if k == "file" else pa.int64()) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", *out])
        if writer is not None:
            writer.close()

    kind = df.schema[id_col].dataType.simpleString()
    index = stored(map_arrow(rows, run, f"id {kind}, file string, place long, first long, n_tokens long, frame long, at long"), "token-index")
    files = index.groupBy("place").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(files.select("place", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")), "token-files")
    return index.join(small(base), "place").select(
        F.col("id").alias(id_col), (F.col("base") + F.col("first")).alias("start"), "n_tokens", "file", "frame", "at"
    )


def read_tokens(index: DataFrame) -> DataFrame:
    """``index`` with ``ids``, the documents' ids as bytes, from those frames that hold them."""
    names = index.columns
    ids = index.agg(F.sum("n_tokens")).first()[0] or 0
    tasks = max(1, min(index.select("file", "frame").distinct().count(), -(-4 * ids // READ_BYTES)))
    sorted_ = index.repartitionByRange(tasks, "file", "frame").sortWithinPartitions("file", "frame", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            found, size, begin = [], 0, 0
            for i in range(len(batch)):
                uri, frame, at, n = (batch.column(c)[i].as_py() for c in ("file", "frame", "at", "n_tokens"))
                if uri != name:
                    name, reader = uri, FrameReader(open_file(uri))
                found.append(reader.read(frame, at, 4 * n))
                size += 4 * n
                if size > 32 << 20 or i + 1 == len(batch):
                    part = batch.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[*names, "ids"])
                    found, size, begin = [], 0, i + 1

    return map_arrow(sorted_, run, schema_of(index, ids=T.BinaryType()))


def read_checksums(index: DataFrame) -> DataFrame:
    """``index`` with ``ids_crc32``, the checksum of each document's ids as they are in the files."""
    return read_tokens(index).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = write_tokens(docs, scratch_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_checksums(index).select("doc_id", "start", "n_tokens", "ids_crc32")
