"""Near duplicates by ProbMinHash: weighted shingles, probability Jaccard, banding and verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import map_arrow, map_batches, own_name, small, stored, table, text_key
from tidecast.llm.graphs import components

SHINGLE = 5
SIMILARITY = 0.8
#: 36 bands of 7 miss a pair of similarity 0.8 once in 4,000 times.
BANDS, ROWS = 36, 7
#: Six standard deviations of a similarity estimated from 252 places: pairs below are not worked out exactly.
MARGIN = 0.15
#: Texts of each side that are held against each other in one task.
BUCKET_ROWS = 512
#: Words that are worked on together.
CHUNK = 300_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Even 64 bits from any."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weighted_shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, weight (how often it occurs) and text number of each distinct shingle, by text and hash.

    A shingle is five words in a row, in lower case; of a shorter text, all its words. No words, no shingle.
    """
    number: dict[str, int] = {}
    words = [(t or "").lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter((number.setdefault(x, len(number)) for w in words for x in w), np.int64, int(sizes.sum()))
    codes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in number), np.uint64, len(number))[ids] if len(ids) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    length = np.minimum(np.repeat(sizes, sizes), SHINGLE)
    first = place + length <= np.repeat(sizes, sizes)
    at = np.flatnonzero(first)
    out = np.zeros(len(at), np.uint64)
    for i in range(SHINGLE):
        used = i < length[at]
        out = np.where(used, mix(out * GOLDEN + codes[np.minimum(at + i, len(ids) - 1)] + np.uint64(i)), out)
    doc = doc[at]
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    starts = np.flatnonzero(np.r_[True, (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])]) if len(out) else np.zeros(0, np.int64)
    return out[starts], np.diff(np.r_[starts, len(out)]).astype(float), doc[starts]


def signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, size: int) -> np.ndarray:
    """``docs`` x ``size`` winners: two texts agree in a place with the probability Jaccard similarity of their weights.

    Each element arrives again and again, after exponential waits divided by its weight, each time at a random
    place; the first to arrive at a place wins it. Waits and places follow from the element alone. An element is done
    once it arrives later than the last of its text's places was won.
    """
    best, winner = np.full(docs * size, np.inf), np.zeros(docs * size, np.uint64)
    bound, clock = np.full(docs, np.inf), np.zeros(len(element))
    active, turn = np.arange(len(element)), 0
    while len(active):
        many = int(min(256, max(1, 4096 // len(active))))
        turns = (np.arange(turn + 1, turn + many + 1).astype(np.uint64)) * GOLDEN
        turn += many
        noise = mix(element[active][:, None] + turns[None, :])
        wait = -np.log(((noise >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
        times = clock[active][:, None] + np.cumsum(wait, 1) / weight[active][:, None]
        clock[active] = times[:, -1]
        owner = doc[active]
        live = times < bound[owner][:, None]
        row, col = np.nonzero(live)
        when = times[row, col]
        place = ((mix(noise[row, col] ^ GOLDEN) >> np.uint64(40)) * np.uint64(size) >> np.uint64(24)).astype(np.int64)
        index = owner[row] * size + place
        np.minimum.at(best, index, when)
        won = best[index] == when
        winner[index[won]] = element[active][row[won]]
        open_docs = np.unique(owner)
        bound[open_docs] = best.reshape(docs, size)[open_docs].max(1)
        active = active[clock[active] < bound[owner]]
    return winner.reshape(docs, size)


def band_keys(winners: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.full((len(winners), bands), GOLDEN) + np.arange(bands).astype(np.uint64)
    parts = winners.reshape(len(winners), bands, rows)
    for i in range(rows):
        out = mix(out * GOLDEN + parts[:, :, i])
    return out.view(np.int64)


def chunks(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "") // 6 + 20
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def signed(texts: list[str | None], bands: int = BANDS, rows: int = ROWS) -> Iterator[tuple[list[int], bytes]]:
    """Keys of the bands of each text, and its signature, a byte for each place; no bands for a text without words."""
    element, weight, doc = weighted_shingles(texts)
    winners = signatures(element, weight, doc, len(texts), bands * rows)
    some = np.bincount(doc, minlength=len(texts)) > 0
    for keys, sig, any_ in zip(band_keys(winners, bands, rows).tolist(), mix(winners).astype(np.uint8), some, strict=True):
        yield (keys if any_ else []), sig.tobytes()


def shingles_of(texts: list[str | None]) -> Iterator[tuple[bytes, bytes | None]]:
    """Hashes and weights of each text's distinct shingles; no weights where all are 1."""
    element, weight, doc = weighted_shingles(texts)
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i, j in zip(ends[:-1], ends[1:], strict=True):
        yield element[i:j].tobytes(), None if (weight[i:j] == 1).all() else weight[i:j].tobytes()


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The sum, over elements x of both, of 1 / sum over all z of max(a[z] / a[x], b[z] / b[x]). Two empty ones: 1."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    all_ = np.union1d(a[0], b[0])
    p, q = np.zeros(len(all_)), np.zeros(len(all_))
    p[np.searchsorted(all_, a[0])], q[np.searchsorted(all_, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        ratio = p / q
    order = np.argsort(-ratio, kind="stable")
    p, q, ratio = p[order], q[order], ratio[order]
    above = np.cumsum(p)  # of the elements up to each
    below = q.sum() - np.cumsum(q)
    last = np.searchsorted(-ratio, -ratio, side="right") - 1
    x = (p > 0) & (q > 0)
    return float((1.0 / (above[last][x] / p[x] + below[last][x] / q[x])).sum())


class Part:
    """The shingles of the texts that are held against each other in one task, with one number for each shingle."""

    def __init__(self, hashes: list[np.ndarray], weights: list[np.ndarray | None]) -> None:
        self.hashes, self.weights = hashes, weights
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.once = np.array([w is None for w in weights])
        all_ = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        known, self.number = np.unique(all_, return_inverse=True)
        self.share = np.concatenate([np.full(len(h), 1 / max(1, len(h))) if w is None else w / w.sum() for h, w in zip(hashes, weights, strict=True)])
        self.mine = np.zeros(len(known))

    def weighted(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.hashes[i], np.ones(len(self.hashes[i])) if self.weights[i] is None else self.weights[i]

    def similar(self, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Which of ``others`` text ``i`` is similar to.

        Where no shingle of either text repeats, the similarity is common shingles by all shingles. Elsewhere the sum
        ``s`` of the lesser shares bounds it: it is at most ``s`` and at least ``s / (2 - s)``; only what that leaves open is worked
        out pair by pair.
        """
        own = slice(self.starts[i], self.starts[i] + self.sizes[i])
        self.mine[self.number[own]] = self.share[own]
        sizes = self.sizes[others]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[others] - (ends - sizes), sizes)
        theirs, mine = self.share[at], self.mine[self.number[at]]
        first = ends - sizes
        common, least = np.add.reduceat(mine > 0, first, dtype=np.int64), np.add.reduceat(np.minimum(mine, theirs), first)
        self.mine[self.number[own]] = 0.0
        plain = self.once[others] & self.once[i]
        found = np.where(plain, common / (self.sizes[i] + sizes - common) >= similarity, least / (2 - least) >= similarity + 1e-9)
        for k in np.flatnonzero(~plain & ~found & (least >= similarity - 1e-9)):
            found[k] = probability_jaccard(self.weighted(i), self.weighted(others[k])) >= similarity
        return found


def group_links(
    rid: list[int], label: list[int], probe: list[bool], sigs: np.ndarray, keys: np.ndarray, band: int, part: Part, similarity: float
) -> Iterator[tuple[int, int]]:
    """Links that join all similar texts of a group which has a probe on one side at least.

    Texts of one label are joined already. Each probe is held against all texts that it is not joined with yet, by the
    signatures first, then exactly; of two probes only the first. Pairs that share one of the first ``band`` band keys
    are left to the group of that key.
    """
    comp, probes = np.unique(np.array(label), return_inverse=True)[1], np.array(probe)
    places = np.arange(len(rid))
    for i in np.flatnonzero(probes):
        rest = np.flatnonzero((comp != comp[i]) & ~(probes & (places < i)))
        rest = rest[(sigs[rest] == sigs[i]).mean(1) >= similarity - MARGIN]
        if band and len(rest):
            rest = rest[~(keys[rest, :band] == keys[i, :band]).any(1)]
        if not len(rest):
            continue
        for j in rest[part.similar(i, rest, similarity)]:
            if comp[i] != comp[j]:
                comp[comp == comp[j]] = comp[i]
                yield rid[i], rid[j]


def links_in(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` within each ``bucket, band, part`` of ``rows`` (and ``rid, label, probe``), each in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, out = None, [[] for _ in range(7)], []

        def close() -> None:
            if len(held[0]) > 1:
                rid, label, probe, sig, keys, hashes, weights = held
                sigs = np.frombuffer(b"".join(sig), np.uint8).reshape(len(rid), -1)
                part = Part([np.frombuffer(h, np.uint64) for h in hashes], [None if w is None else np.frombuffer(w, float) for w in weights])
                out.extend(group_links(rid, label, probe, sigs, np.array(keys), name[1], part, similarity))
            for x in held:
                x.clear()

        def made() -> pa.RecordBatch:
            arrays = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], []))]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

        for batch in batches:
            for i in range(len(batch)):
                bucket, band, part, *row = (c[i].as_py() for c in batch.columns)
                if (bucket, band, part) != name:
                    close()
                    name = bucket, band, part
                for x, v in zip(held, row, strict=True):
                    x.append(v)
            if len(out) > 10_000:
                yield made()
        close()
        yield made()

    whole = rows.join(texts, "rid").select("bucket", "band", "part", "rid", "label", "probe", "sig", "bands", "hashes", "weights")
    dealt = whole.repartition("bucket", "band", "part").sortWithinPartitions("bucket", "band", "part", "rid")
    return map_arrow(dealt, run, "a long, b long")


def similar_classes(shared: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``node, label`` of all texts that are similar to another in some bucket of ``shared`` (``bucket, band, rid``).

    First each text of a bucket is held against the bucket's leader, the text of the least hash. Texts that share many
    buckets mostly share their leader, and each pair is worked out once. That joins nearly all of a large group of copies.

    Then buckets whose texts are still in several classes are gone through: those outside the bucket's largest class are
    held against all others, in parts of about ``BUCKET_ROWS`` of both sides, each pair only in the first band that both
    share. So each similar pair of a bucket is joined, no pair is worked out twice in this step, and no bucket is spread into
    all its pairs.
    """
    leaders = shared.groupBy("bucket").agg(F.min_by("rid", F.xxhash64("rid")).alias("leader"))
    pairs = stored(shared.join(leaders, "bucket").where("rid != leader").select("leader", "rid").distinct(), "followers")
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).cast("int").alias("parts"))
    salted = pairs.join(sizes.where("parts > 1"), "leader", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part")
    followers = salted.select(F.col("leader").alias("bucket"), part, "rid", F.lit(False).alias("probe"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    stars = followers.unionByName(sizes.select(F.col("leader").alias("bucket"), every, F.col("leader").alias("rid"), F.lit(True).alias("probe")))
    stars = stars.withColumn("label", F.col("rid")).withColumn("band", F.lit(0))
    links = stored(links_in(stars, texts, similarity), "links")
    labels = components(links)

    members = shared.join(labels, F.col("rid") == F.col("node"), "left").select("bucket", "band", "rid", F.coalesce("label", "rid").alias("label"))
    members = stored(members, "members")
    mains = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")
    )
    # of two texts one is the leader, so that their pair is done
    mains = mains.where("n > most and n > 2").select(
        "bucket", "main", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("parts"), F.ceil((F.col("n") - F.col("most")) / BUCKET_ROWS).cast("int").alias("shares")
    )
    mains = stored(mains, "mains")
    if mains.isEmpty():
        return labels
    open_ = members.join(small(mains), "bucket")
    place = F.pmod(F.xxhash64("rid", "bucket"), F.col("parts")).cast("int")
    share = F.pmod(F.xxhash64("bucket", "rid"), F.col("shares")).cast("int")
    names = ["bucket", "band", "rid", "label"]
    against = open_.select(*names, place.alias("p"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("s"), "shares")
    left = open_.where("label != main")
    probes = left.select(*names, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), share.alias("s"), "shares")
    both = against.withColumn("probe", F.lit(False)).unionByName(probes.withColumn("probe", F.lit(True)))
    again = both.groupBy(*names, (F.col("p").cast("long") * F.col("shares") + F.col("s")).alias("part")).agg(F.max("probe").alias("probe"))
    more = stored(links_in(again, texts, similarity), "links")
    if more.isEmpty():
        return labels
    return components(links.unionByName(more))


def near_duplicates(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``rid, <id_col>, class_id, first`` for each row of ``df``; ``first`` marks one row of each class.

    Texts are in one class if a chain of texts joins them, each similar to the next: the probability Jaccard of their
    weighted five-word shingles is ``similarity`` or more. Equal texts count as one until the end. ``class_id`` is the
    least id of the class, and the row with that id is its first.

    Null texts count as empty; all empty texts are one class, and a text of white space only is held against none but
    its equals. ``rid`` is ``row_col``, a number of each row, if that is given. A class whose ids are all null has a null ``class_id``. Repeated rows each get a row.
    """
    row = F.lit(None).cast("long") if row_col is None else F.col(row_col)
    source = df.select(F.col(id_col).alias("id"), row.alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.select("id", "rid", *text_key("text"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = (t.as_py() for t in batch.column(4))
        made = [k for part in chunks(texts) for k in signed(part, bands, rows)]
        keys, sigs = pa.array([k for k, _ in made], pa.list_(pa.int64())), pa.array([s for _, s in made], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:4], keys, sigs], names=["id", "rid", "k1", "k2", "bands", "sig"])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [p for part in chunks(t.as_py() for t in batch.column(1)) for p in shingles_of(part)]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in zip(*made, strict=True))], names=["rid", "hashes", "weights"])

    kind = df.schema[id_col].dataType.simpleString()
    marked = map_batches(source, run, f"id {kind}, rid long, k1 long, k2 int, bands array<bigint>, sig binary")
    if row_col is None:
        marked = marked.withColumn("rid", F.monotonically_increasing_id())
    marked = stored(marked, "signatures")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    distinct = stored(
        marked.groupBy("k1", "k2").agg(F.min(F.struct(order.alias("first"), F.col("bands"), F.col("sig"))).alias("x"))
        .select("k1", "k2", F.col("x.first.rid").alias("rid"), F.col("x.first").alias("first"), "x.bands", "x.sig"),
        "distinct",
    )
    banded = distinct.select("rid", F.posexplode("bands").alias("band", "bucket"))
    # buckets with the same members count once, in their first band
    members = banded.groupBy("bucket").agg(
        F.min("band").alias("band"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("rid", F.lit(1)).cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("rid")).alias("xor")
    ).where("n > 1")
    full = members.groupBy("n", "sum", "xor").agg(F.min_by("bucket", F.struct("band", "bucket")).alias("bucket")).select("bucket")
    shared = stored(banded.join(stored(full, "buckets"), "bucket"), "shared")
    wanted = stored(distinct.join(shared.select("rid").distinct(), "rid").select("rid", "k1", "k2", "sig", "bands"), "wanted")
    texts = source.drop("rid").join(small(wanted.drop("sig", "bands")), ["k1", "k2"]).groupBy("rid").agg(F.first("text").alias("text"))
    texts = stored(map_batches(texts, cut, "rid long, hashes binary, weights binary").join(wanted.drop("k1", "k2"), "rid"), "texts")
    labels = similar_classes(shared, texts, similarity)
    firsts = distinct.select(F.col("rid").alias("node"), "first")
    roots = stored(
        labels.join(firsts, "node").groupBy("label").agg(F.min("first").alias("root")), "roots"
    )
    joined = labels.join(roots, "label").select(F.col("node").alias("rid"), "root")
    classes = stored(
        distinct.join(joined, "rid", "left").select("k1", "k2", F.coalesce("root", "first").alias("root")), "classes"
    )
    return marked.join(classes, ["k1", "k2"], "left").select(
        "rid", F.col("id").alias(id_col), F.col("root.id").alias("class_id"), (F.col("rid") == F.col("root.rid")).alias("first")
    )


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that with the least ``doc_id``."""
    row = own_name("row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    others = stored(near_duplicates(numbered, row_col=row).where("not first").select(F.col("rid").alias(row)), "others")
    return numbered.join(small(others), row, "left_anti").select(docs.columns)
