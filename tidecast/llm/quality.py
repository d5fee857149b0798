"""Quality rules: lines that many documents of one host share are taken out, and documents left with too little go."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.common import map_batches, own_name, small, stored, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
LEAST_WORDS = 50
#: Percent of the words that may stand in repeated windows of three.
MOST_REPEATED = 50
WINDOW = 3
SHINGLE = 5
#: A line of a host is a template from so many different documents on.
LEAST_DOCUMENTS = 20
#: The part of its words that a document must keep.
LEAST_LEFT = 0.3
#: Words of a line's anchors: those at its begin, in its middle and at its end.
ANCHOR = 4
MASK = (1 << 63) - 1


def repeated(ids: np.ndarray, distinct: int) -> int:
    """Words that stand in a window of three words found twice or more."""
    if len(ids) < WINDOW + 1 or distinct == len(ids):
        return 0
    _, pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)
    _, which, times = np.unique(pairs[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
    twice = times[which] > 1
    words = np.zeros(len(ids), bool)
    for i in range(WINDOW):
        words[i : i + len(twice)] |= twice
    return int(words.sum())


def signature(hashes: np.ndarray) -> int:
    """The least hash of a line's five-word shingles: near copies of it mostly share it. A shorter line is one shingle."""
    n = max(1, len(hashes) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(hashes))):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return int(out.min()) & MASK


def line_key(host: str, line: str) -> int | None:
    """A hash of host and line, whatever the line's case and spacing; None for a line without a word."""
    norm = " ".join(line.lower().split())
    return xxhash.xxh3_64_intdigest(f"{host}\0{norm}") & MASK if norm else None


def anchors(hashes: np.ndarray, seed: int) -> list[int]:
    """Hashes of a few words at the begin, in the middle and at the end of a line: an edit leaves some of them as they are.

    A line of fewer than four words has none.
    """
    n = len(hashes)
    if n < 4:
        return []
    w = min(ANCHOR, n // 2)
    return [xxhash.xxh3_64_intdigest(hashes[i : i + w].tobytes(), seed) & MASK for i in sorted({0, (n - w) // 2, n - w})]


def measure(text: str | None, host: str | None) -> dict:
    text, host = text or "", host or ""
    seed = xxhash.xxh3_64_intdigest(host)
    raw = text.encode()
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    seen: set[str] = set()
    copies, lines, at = 0, {}, 0
    hashes = np.fromiter((crc32(w) for w in number), np.uint64, len(number))[ids]
    for line in text.split("\n"):
        if not line.strip(SPACES):
            continue
        copies += line in seen
        seen.add(line)
        n = len(line.encode().split())
        if (key := line_key(host, line)) is not None:
            if key not in lines:
                lines[key] = [0, signature(hashes[at : at + n]), anchors(hashes[at : at + n], seed)]
            lines[key][0] += n
        at += n
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": copies,
        "n_repeat_words": repeated(ids, len(number)),
        "lines": [{"key": k, "words": n, "sig": sig, "anchors": a} for k, (n, sig, a) in lines.items()],
    }


MEASURES = T.StructType(
    [
        *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        T.StructField("lines", T.ArrayType(T.StructType([*(T.StructField(n, T.LongType()) for n in ("key", "words", "sig")), T.StructField("anchors", T.ArrayType(T.LongType()))]))),
    ]
)
MEASURED = pa.struct(
    [
        *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ("lines", pa.list_(pa.struct([*((n, pa.int64()) for n in ("key", "words", "sig")), ("anchors", pa.list_(pa.int64()))]))),
    ]
)


def quality_rules(
    df: DataFrame,
    *,
    text_col: str = "text",
    host_col: str = "source",
    keep_text: bool = False,
    least_documents: int = LEAST_DOCUMENTS,
    least_left: float = LEAST_LEFT,
) -> DataFrame:
    """The columns of ``df`` (without its text and host unless ``keep_text``) in the struct ``row``, and its verdict.

    ``quality`` holds the measures of the text; ``base_failed``; ``n_removed``, the words of lines above the limit, and
    their keys ``removed``; ``kept``.

    Each line is hashed in lower case with single spaces, together with its host. A line that fewer than
    ``least_documents`` rows hold is its document's own, unless it has an anchor (a few words at its begin, in its middle or at
    its end) of a line that more rows of the host hold: then it is such a line, edited. For each common line the different
    documents that hold it are counted: those whose own lines have the same least hashes of five-word shingles count once,
    and those without own lines by the least of their common lines. So copies of a text add next to nothing, edited or not, and
    lines of a template, however much of the text they are, do not decide which documents are different. A line in ``least_documents`` different documents of a host is over the limit. A document that keeps
    less than ``least_left`` of its words without such lines is rejected, as is one that fails the base rules.

    A row stands for itself: repeated rows and ids are each judged. A null text is empty; a null host is a host of
    its own. Measures are stored once; hot lines are summed up where they are read, and if the lines over the limit
    are too many to broadcast, both sides are shuffled and hot lines split.
    """
    names = df.columns if keep_text else [c for c in df.columns if c not in (text_col, host_col)]
    row, text, host = own_name("row"), own_name("text"), own_name("host")
    packed = F.struct(*names) if names else F.struct(F.lit(True).alias("one"))
    source = df.select(packed.alias(row), F.col(text_col).alias(text), F.col(host_col).cast("string").alias(host))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, hosts = batch.column(1), batch.column(2)
        made = pa.array((measure(texts[i].as_py(), hosts[i].as_py()) for i in range(len(batch))), MEASURED)
        return pa.RecordBatch.from_arrays([batch.column(0), made], names=["row", "quality"])

    schema = T.StructType([T.StructField("row", source.schema[row].dataType), T.StructField("quality", MEASURES)])
    measured = map_batches(source, run, schema)
    measured = stored(measured.withColumn("rid", F.monotonically_increasing_id()), "lines")
    lines = measured.select("rid", F.explode("quality.lines").alias("line")).select("rid", "line.*")
    common = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("anchors").alias("anchors")).where(F.col("n") >= least_documents)
    common = stored(common.select("key", "anchors"), "common")
    marked = lines.join(small(common.select("key", F.lit(True).alias("common"))), "key", "left")
    # of documents that hold a common line: their other lines that share an anchor with one
    holders = stored(marked.where("common").select("rid").distinct(), "holders")
    known = small(stored(common.select(F.explode("anchors").alias("anchor")).distinct(), "anchors"))
    others = marked.where("common IS NULL").join(small(holders), "rid", "left_semi").select("rid", "key", F.explode("anchors").alias("anchor"))
    edited = stored(others.join(known, "anchor", "left_semi").select("rid", "key").distinct(), "edited").withColumn("edited", F.lit(True))
    own = F.array_sort(F.collect_set(F.when(F.col("common").isNull() & F.col("edited").isNull(), F.col("sig"))))
    held = (
        marked.join(small(edited), ["rid", "key"], "left")
        .groupBy("rid")
        .agg(own.alias("own"), F.collect_list(F.when(F.col("common"), F.struct("key", "words"))).alias("shared"))
        .where(F.size("shared") > 0)
        .select("rid", F.when(F.size("own") > 0, F.xxhash64("own")).otherwise(F.array_min("shared.key")).alias("sig"), "shared")
    )
    shared = stored(held, "shared").select("rid", "sig", F.explode("shared").alias("line")).select("rid", "sig", "line.*")
    frequent = (
        shared.groupBy("key", "sig")
        .agg(F.lit(1).alias("one"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("different"))
        .where(F.col("different") >= least_documents)
        .select("key")
    )
    removed = (
        shared.join(small(stored(frequent, "frequent")), "key")
        .groupBy("rid")
        .agg(F.sum("words").alias("n_removed"), F.collect_list("key").alias("removed"))
    )
    q = F.col("quality")
    failed = (q["n_words"] < LEAST_WORDS) | (100 * q["n_repeat_words"] > MOST_REPEATED * q["n_words"])
    gone = F.coalesce("n_removed", F.lit(0))
    return measured.join(removed, "rid", "left").select(
        "row",
        q.dropFields("lines").alias("quality"),
        failed.alias("base_failed"),
        gone.alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"),
        (~failed & (q["n_words"] - gone >= least_left * q["n_words"])).alias("kept"),
    )


def without_lines(df: DataFrame, *, text_col: str = "text", host_col: str = "source", keys_col: str = "removed") -> DataFrame:
    """``df`` without those lines of its texts whose keys are listed in ``keys_col``, which is dropped."""
    names = [c for c in df.columns if c != keys_col]
    schema = T.StructType([f for f in df.schema if f.name != keys_col])

    def clean(text: str | None, host: str | None, keys: list[int]) -> str | None:
        if not keys or text is None:
            return text
        gone = set(keys)
        host = "" if host is None else host
        return "\n".join(x for x in text.split("\n") if line_key(host, x) not in gone)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, hosts, keys = batch.column(text_col), batch.column(host_col), batch.column(keys_col)
        made = pa.array((clean(texts[i].as_py(), hosts[i].as_py(), keys[i].as_py()) for i in range(len(batch))), pa.string())
        return pa.RecordBatch.from_arrays([made if n == text_col else batch.column(n) for n in names], names=names)

    return map_batches(df, run, schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs).select("row.doc_id", "quality.*", "base_failed", "n_removed", "kept")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines above the limits; ``n_chars`` is that of the new text."""
    judged = quality_rules(docs, keep_text=True).where("kept").select("row.*", "removed")
    out = without_lines(judged)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)
