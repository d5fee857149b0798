"""How the tokens of two tokenizers fall together: groups between common borders, links, and corpus-wide counts of pairs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.common import map_arrow, map_batches, schema_of, small, stored, table
from tidecast.llm.tokenizing import BYTE_LETTERS, encoder, piece_encoder

#: Characters of the texts that are aligned together, and the pairs that a task sums up before it passes them on.
CHUNK, PAIRS_HELD = 1_000_000, 500_000
#: A pair is one number: its A id times this, and its B id.
PAIR = 1 << 32
#: Pairs that are broadcast as the most frequent ones; the others meet their rows in a shuffle.
HOT_PAIRS = 100_000


class Sides:
    """Both tokenizers, the bytes and names of their entries, and for each A id the B id of the same bytes, or -1."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.a, self.b = encoder(byte_path, plain_specials=True), piece_encoder(piece_path)
        letters = {c: b for b, c in BYTE_LETTERS.items()}
        entries = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b_bytes = [self._piece(i, e) for i, e in enumerate(self.b.entries)]
        least: dict[bytes, int] = {}
        for i, x in enumerate(self.b_bytes):
            least.setdefault(x, i)
        self.same = np.array([least.get(x, -1) for x in self.a_bytes], np.int64)
        self.a_size, self.b_size = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = (
            [np.array([f"{i}{end}" for i in range(len(xs))], object) for end in ends]
            for xs, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))
        )

    def _piece(self, i: int, entry: str) -> bytes:
        model = self.b.model
        if model.is_byte(i):
            return bytes([int(entry[3:5], 16)])
        if model.is_control(i) or model.is_unknown(i):
            return b""  # never equal to the text's bytes
        return entry.replace("▁", " ").encode()

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides, none unless both give the bytes of a space and the text."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        whole = (" " + text).encode()
        a, b = (np.frombuffer(x, np.uint32).astype(np.int64) for x in (self.a.bytes_of(" " + text), self.b.bytes_of(text)))
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole:
            return none, none
        return a, b


@lru_cache(maxsize=1)
def sides(byte_path: str, piece_path: str) -> Sides:
    """One in each worker."""
    return Sides(byte_path, piece_path)


def aligned(own: Sides, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, str]]:
    """For each text: tokens of A and of B, the last A and B ids of each group, which groups are regular, and the digest.

    A group is regular if it is one token on each side and the B id is the one that the identity map holds for A.
    """
    ids = [own.ids(t) for t in texts]
    n_a, n_b = (np.array([len(x[i]) for x in ids], np.int64) for i in (0, 1))
    a, b = (np.concatenate([x[i] for x in ids]) if ids else np.zeros(0, np.int64) for i in (0, 1))
    a_ends, b_ends = np.cumsum(own.a_size[a]), np.cumsum(own.b_size[b])
    # both sides of a text have the same bytes, so that borders of texts are borders of groups
    _, at_a, at_b = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
    many_a, many_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
    last_a, last_b = a[at_a], b[at_b]
    regular = (many_a == 1) & (many_b == 1) & (own.same[last_a] == last_b)
    # the names in reading order: a group's A ids, then its B ids
    a_group, b_group = np.repeat(np.arange(len(at_a)), many_a), np.repeat(np.arange(len(at_b)), many_b)
    names = np.empty(len(a) + len(b), object)
    a_names, b_names = own.a_names[0][a], own.b_names[0][b]
    a_names[at_a], b_names[at_b] = own.a_names[1][last_a], own.b_names[1][last_b]
    names[np.arange(len(a)) + (at_b - many_b + 1)[a_group]] = a_names
    names[np.arange(len(b)) + (at_a + 1)[b_group]] = b_names
    groups = np.searchsorted(at_a, np.cumsum(n_a) - 1, side="right")
    tokens = np.cumsum(n_a + n_b)
    for i in range(len(texts)):
        g = slice(groups[i - 1] if i else 0, groups[i])
        t = names[(tokens[i - 1] if i else 0) : tokens[i]]
        digest = sha256("".join(t.tolist())[:-1].encode()).hexdigest() if len(t) else ""
        yield int(n_a[i]), int(n_b[i]), last_a[g], last_b[g], regular[g], digest


def chunks(values: Iterable) -> Iterator[tuple[list[int], list[str | None]]]:
    """Places and texts of an Arrow column, about ``CHUNK`` characters at a time."""
    places, held, size = [], [], 0
    for i, v in enumerate(values):
        text = v.as_py()
        places.append(i)
        held.append(text)
        size += len(text or "") + 100
        if size >= CHUNK:
            yield places, held
            places, held, size = [], [], 0
    if held:
        yield places, held


def alignments(df: DataFrame, byte_path: str, piece_path: str, *, id_col: str, text_col: str) -> DataFrame:
    """A row for each text, and rows of counts that a task has summed up.

    Text rows: ``id, row, n_a, n_b, n_groups, groups_sha256, regular`` (A ids of regular groups, packed),
    ``pairs, times`` (last ids of the other groups, as one number, and how often). Count rows have a null ``row`` and hold
    their sums in ``pairs, times``: the vector of regular groups by A id, as long as A's vocabulary and given once for each
    task without its zeros, with numbers below zero; pairs of other groups whenever the task holds too many.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, row long, n_a long, n_b long, n_groups long, groups_sha256 string, regular binary, pairs array<bigint>, times array<bigint>"
    rows = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, id_type = sides(byte_path, piece_path), None
        vector, held = np.zeros(len(own.a_bytes), np.int64), {}
        names = ["id", "row", "n_a", "n_b", "n_groups", "groups_sha256", "regular", "pairs", "times"]

        def counts(pairs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            empty = [pa.nulls(1, t) for t in (id_type, *[pa.int64()] * 4, pa.string(), pa.binary())]
            sums = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (pairs, times)]
            return pa.RecordBatch.from_arrays([*empty, *sums], names=names)

        def irregular() -> pa.RecordBatch:
            made = counts(np.fromiter(held.keys(), np.int64, len(held)), np.fromiter(held.values(), np.int64, len(held)))
            held.clear()
            return made

        for batch in batches:
            id_type = batch.column(0).type
            for places, texts in chunks(batch.column(2)):
                out = {n: [] for n in names[2:]}
                for n_a, n_b, last_a, last_b, same, digest in aligned(own, texts):
                    vector += np.bincount(last_a[same], minlength=len(vector))
                    pairs, times = np.unique(last_a[~same] * PAIR + last_b[~same], return_counts=True)
                    for p, t in zip(pairs.tolist(), times.tolist(), strict=True):
                        held[p] = held.get(p, 0) + t
                    row = (n_a, n_b, len(last_a), digest, last_a[same].astype(np.uint32).tobytes(), pairs, times)
                    for c, v in zip(out.values(), row, strict=True):
                        c.append(v)
                types = [pa.int64()] * 3 + [pa.string(), pa.binary()] + [pa.list_(pa.int64())] * 2
                arrays = [pa.array(c, t) for c, t in zip(out.values(), types, strict=True)]
                part = batch.slice(places[0], len(places))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=names)
                if len(held) > PAIRS_HELD:
                    yield irregular()
        if id_type is not None:
            met = np.flatnonzero(vector)
            yield counts(-1 - met, vector[met])
            yield irregular()

    return map_arrow(rows, run, schema)


def align_tokenizers(
    df: DataFrame, byte_tokenizer: str, piece_tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Facts of each row's alignment, and the counts of all pairs.

    A is a byte-level BPE tokenizer file and is given a space and the text; B is a sentencepiece model that adds the space
    itself. Byte offsets at which tokens of both sides end cut a text into groups; a link is the A token and the B token
    that end together. Rows: ``<id_col>, n_a, n_b, n_groups, n_links, n_best`` (links whose pair's count is the highest
    of their B id, ties included), ``count_sum`` (of the pairs' counts over links), ``groups_sha256``. Pairs: ``a, b,
    links, best``.

    Regular groups, one token on each side with ids that the identity map of equal bytes holds for each other, are
    counted in one vector as long as A's vocabulary for each task. Only pairs of other groups are shuffled, summed up by
    the task before. A pair is regular or not wherever it stands: tokens of equal bytes that end together begin together.

    A null or empty text, and one that either side does not spell out in the bytes of a space and the text, has no
    tokens: its numbers are 0 and its digest is empty. Repeated rows count each; null ids have rows like any.
    """
    made = stored(alignments(df, byte_tokenizer, piece_tokenizer, id_col=id_col, text_col=text_col), "alignments")
    zipped = F.explode(F.arrays_zip("pairs", "times")).alias("x")
    sums = made.where("row IS NULL").select(zipped).groupBy(F.col("x.pairs").alias("code")).agg(F.sum("x.times").alias("links"))
    sums = stored(sums, "pair-counts")
    same = sides(byte_tokenizer, piece_tokenizer).same
    # at most a row for each entry of A's vocabulary
    vector = {-1 - r.code: r.links for r in sums.where("code < 0").collect()}
    a_ids = sorted(vector)
    identity = df.sparkSession.createDataFrame(
        pa.table({"a": pa.array(a_ids, pa.int64()), "b": pa.array(same[a_ids] if a_ids else [], pa.int64()), "links": pa.array([vector[a] for a in a_ids], pa.int64())})
    )
    others = sums.where("code >= 0").select(F.expr(f"code DIV {PAIR}L").alias("a"), F.expr(f"code % {PAIR}L").alias("b"), "links")
    pairs = identity.unionByName(others)
    highest = pairs.groupBy("b").agg(F.max("links").alias("highest"))  # at most a row for each entry of B's vocabulary
    pairs = stored(pairs.join(F.broadcast(highest), "b").select("a", "b", "links", (F.col("links") == F.col("highest")).alias("best")), "pairs")

    regular = pairs.join(F.broadcast(identity.select("a", "b")), ["a", "b"], "left_semi").collect()
    links_of, best_of = np.zeros(len(same), np.int64), np.zeros(len(same), np.int64)
    for r in regular:
        links_of[r.a], best_of[r.a] = r.links, r.best

    def totals(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column("regular")]
        found = [pa.array([int(of[x].sum()) for x in ids], pa.int64()) for of in (links_of, best_of)]
        kept = batch.drop_columns(["regular"])
        return pa.RecordBatch.from_arrays([*kept.columns, *found], names=[*kept.schema.names, "regular_sum", "regular_best"])

    texts = made.where("row IS NOT NULL")
    told = texts.drop("pairs", "times")
    whole = map_batches(told, totals, schema_of(told.drop("regular"), regular_sum=T.LongType(), regular_best=T.LongType()))
    codes = pairs.join(F.broadcast(identity.select("a", "b")), ["a", "b"], "left_anti").select(
        F.expr(f"a * {PAIR}L + b").alias("code"), "links", F.col("best").cast("long").alias("best")
    )
    by_pair = pair_sums(texts.select("row", zipped).select("row", F.col("x.pairs").alias("code"), F.col("x.times").alias("times")), codes)
    zero = F.lit(0).cast("long")
    facts = whole.join(by_pair, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        (F.col("regular_best") + F.coalesce("pair_best", zero)).alias("n_best"),
        (F.col("regular_sum") + F.coalesce("pair_sum", zero)).alias("count_sum"),
        "groups_sha256",
    )
    return facts, pairs


def pair_sums(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """``row, pair_sum, pair_best`` over the irregular links of each row (``row, code, times``).

    The table of pairs is broadcast if it is small; else its most frequent pairs are, a bounded number, and only rows of
    the others are shuffled to their pairs, none of which has many.
    """
    summed = [F.sum(F.col("times") * F.col("links")).alias("pair_sum"), F.sum(F.col("times") * F.col("best")).alias("pair_best")]
    hinted = small(codes)
    if hinted is not codes:
        return rows.join(hinted, "code").groupBy("row").agg(*summed)
    hot = stored(codes.orderBy(F.desc("links"), "code").limit(HOT_PAIRS), "hot-pairs")
    near = rows.join(F.broadcast(hot), "code").groupBy("row").agg(*summed)
    rest = rows.join(F.broadcast(hot.select("code")), "code", "left_anti").join(codes, "code").groupBy("row").agg(*summed)
    return near.unionByName(rest).groupBy("row").agg(F.sum("pair_sum").alias("pair_sum"), F.sum("pair_best").alias("pair_best"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_tokenizers(table(spark, sf_dir, "documents"), *paths)[0]
