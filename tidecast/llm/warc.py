"""Web archives: an index of all records first, then reads of the byte ranges that are asked for."""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import map_arrow, own_name, small, stored, table
from tidecast.llm.files import new_file, open_file
from tidecast.storage import scratch_path

#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 1000
ARCHIVE_BYTES = 512 << 20
#: Ranges of an archive that are no further apart are read as one, up to the second figure.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
FIRST_DATE = datetime(2000, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
INDEX = (
    "page_id {kind}, url string, archive string, offset long, length long, record_type string, payload_bytes long, payload_digest string"
)
INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def record(kind: str, headers: dict[str, object], block: bytes) -> bytes:
    """One record, compressed by itself."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, in lower case, and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a record")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record of the wrong length")
    return headers, rest[:size]


def safe(url: str | None) -> str | None:
    """A URL on one line: blanks and control characters become percent codes."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def name_of(page: object) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'page:{page}')}>"


def write_archives(
    df: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES
) -> DataFrame:
    """Write a record for each row of ``df`` to archives in ``folder``; returns the stored index.

    Index: ``page_id, url, archive, offset, length, record_type, payload_bytes, payload_digest``. The payload is the
    page in UTF-8, empty for a null. Of equal payloads of at least ``least_bytes`` bytes the one with the largest id
    is a response and the others revisit it, without a payload of their own; with no id among them, all are
    responses. Rows repeated with the largest id are responses each; null ids revisit any other.

    Digests are made in the scan; only payloads that occur twice are listed for the join by digest, which may split
    a hot one. A task writes files that no other attempt writes and hands back their index, which is stored as a table.
    """
    payload, digest = own_name("payload"), own_name("digest")
    rows = df.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("string").alias(payload)
    ).withColumn(digest, F.sha1(F.encode(payload, "UTF-8")))
    first = stored(
        rows.where(F.octet_length(payload) >= least_bytes)
        .groupBy(digest)
        .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and refers_to is not null")
        .select(digest, "refers_to"),
        "payloads",
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to"))
    joined = rows.join(small(first), digest, "left").select("page_id", "url", payload, digest, refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stream, uri = TaskContext.get().partitionId(), None, ""
        for batch in batches:
            out = []
            for page, url, text, sha1, to in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns)), strict=True):
                if stream is not None and stream.tell() > ARCHIVE_BYTES:
                    stream.close()
                    stream = None
                if stream is None:
                    stream, uri = new_file(folder, part, "warc.gz")
                    about = {"WARC-Date": FIRST_DATE, "WARC-Record-ID": name_of(uri), "Content-Type": "application/warc-fields"}
                    stream.write(record("warcinfo", about, b"format: WARC File Format 1.1\r\n"))
                body = text.as_py().encode()
                headers = {
                    "WARC-Record-ID": name_of(page),
                    "WARC-Date": FIRST_DATE,
                    "WARC-Target-URI": safe(url),
                    "WARC-Payload-Digest": f"sha1:{sha1}",
                    "WARC-Page-ID": page,
                    "WARC-Payload-Length": len(body),
                    "Content-Type": "application/http; msgtype=response",
                }
                if to is not None:
                    headers |= {
                        "WARC-Refers-To": name_of(to),
                        "WARC-Refers-To-Page-ID": to,
                        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                    }
                kind, size = "response" if to is None else "revisit", len(body)
                data = record(kind, headers, HTTP.format(size).encode() + (body if to is None else b""))
                at = stream.tell()
                stream.write(data)
                out.append((page, url, uri, at, len(data), kind, size, sha1))
            if out:
                types = [batch.column(0).type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=INDEX_NAMES)
        if stream is not None:
            stream.close()

    kind = df.schema[id_col].dataType.simpleString()
    return stored(map_arrow(joined, run, INDEX.format(kind=kind)), "archive-index")


def coalesced(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Reads for sorted ranges (offset, length): begin, end, and which ranges lie in each."""
    begin = end = None
    held: list[int] = []
    for i, (at, size) in enumerate(ranges):
        if held and (at - end > GAP_BYTES or at + size - begin > READ_BYTES):
            yield begin, end, held
            held = []
        if not held:
            begin, end = at, at
        held.append(i)
        end = max(end, at + size)
    if held:
        yield begin, end, held


def read_archives(index: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` lists, read from their archives in a few large reads for each.

    Returns ``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` as the records have them, and the
    ``payload`` (null for a revisit). A payload that does not have its digest is an error.
    """
    kind = index.schema["page_id"].dataType
    order = index.select("page_id", "archive", "offset", "length").repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")

    def found(page, data: bytes) -> tuple:
        headers, block = parse(zlib.decompress(data, wbits=31))
        sha1, size, to = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["warc-payload-length"]), headers.get("warc-refers-to-page-id")
        body = None
        if headers["warc-type"] == "response":
            body = block.partition(b"\r\n\r\n")[2]
            if len(body) != size or hashlib.sha1(body).hexdigest() != sha1:
                raise ValueError(f"damaged payload of page {page}")
        if headers.get("warc-page-id") != (None if page is None else str(page)):
            raise ValueError(f"not the record of page {page}")
        return page, headers.get("warc-target-uri"), size, sha1, headers["warc-type"], to, body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            pages, archives, offsets, lengths = (c.to_pylist() for c in batch.columns)
            begin = 0
            while begin < len(batch):
                end = begin
                while end < len(batch) and archives[end] == archives[begin]:
                    end += 1
                if archives[begin] != name:
                    name, source = archives[begin], open_file(archives[begin])
                for start, stop, held in coalesced(list(zip(offsets[begin:end], lengths[begin:end], strict=True))):
                    data = source.read_at(stop - start, start)
                    out = []
                    for i in held:
                        at = offsets[begin + i] - start
                        out.append(found(pages[begin + i], data[at : at + lengths[begin + i]]))
                    types = [batch.column(0).type, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                    arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                    n = len(names) if with_payload else -1
                    yield pa.RecordBatch.from_arrays(arrays[:n], names=names[:n])
                begin = end

    schema = f"page_id {kind.simpleString()}, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    out = map_arrow(order, run, schema + (", payload binary" if with_payload else ""))
    return out.withColumn("refers_to", F.col("refers_to").cast(kind))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "archives"))
    return read_archives(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as payload_digest, strlen(coalesce(html, '')) as payload_bytes from pages),
m as (select *, max(page_id) over (partition by payload_digest) as top from p)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id is distinct from top and top is not null then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id is distinct from top then top end as refers_to
from m
"""
