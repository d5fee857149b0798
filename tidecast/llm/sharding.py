"""Shards of near equal bytes: a histogram sort finds exact splitters, then rows are exchanged once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.llm.common import own_name, small, stored, table

SHARDS = 24
#: Bits by which a round refines the probes: an open interval of keys is counted in 2 ** 10 parts.
DIGIT = 10
LEAST = -(2**63)
#: The row's place in its partition is in so many bits of ``monotonically_increasing_id``.
PLACE_BITS = 33


@dataclass(frozen=True)
class Keys:
    """Rows are ordered by a key and, among equal keys, by a number of their own, read as one string of bits.

    Bits that all rows share are left out; ``key_bits`` and ``tie_bits`` are what remains of both.
    """

    key: str
    tie: str
    least: int
    key_bits: int
    tie_bits: int

    @property
    def bits(self) -> int:
        return self.key_bits + self.tie_bits

    def prefix(self, depth: int) -> list[Column]:
        """The first ``depth`` bits of a row: those of the key and those of the tie."""
        unsigned = F.col(self.key).bitwiseXOR(F.lit(LEAST))
        shared = (self.least - LEAST) >> self.key_bits << self.key_bits
        own = unsigned.bitwiseXOR(F.lit(signed(shared)))
        of_key, of_tie = min(depth, self.key_bits), max(0, depth - self.key_bits)
        high = F.shiftrightunsigned(own, self.key_bits - of_key) if of_key else F.lit(0).cast("long")
        low = F.shiftrightunsigned(F.col(self.tie), self.tie_bits - of_tie) if of_tie else F.lit(0).cast("long")
        return [high, low]

    def number(self, high: int, low: int, depth: int) -> int:
        return (high % 2**64 << max(0, depth - self.key_bits)) | low

    def from_here(self, number: int, depth: int) -> str | None:
        """A test for rows at or behind the place where ``number`` begins at ``depth``; None if that is behind all rows."""
        place = number << (self.bits - depth)
        if place >> self.bits:
            return None
        shared = (self.least - LEAST) >> self.key_bits << self.key_bits
        key = (shared | place >> self.tie_bits) + LEAST
        tie = place & (2**self.tie_bits - 1)
        return f"(`{self.key}` > {number_text(key)} OR (`{self.key}` = {number_text(key)} AND `{self.tie}` >= {tie}L))"


def signed(unsigned: int) -> int:
    return unsigned - 2**64 if unsigned >= 2**63 else unsigned


def number_text(value: int) -> str:
    """A 64-bit number in SQL, which has no literal for the least one."""
    return f"{value}L" if value > LEAST else f"({LEAST + 1}L - 1L)"


def splitters(rows: DataFrame, keys: Keys, size: str, total: int, shards: int, tolerance: float) -> list[str | None]:
    """A test for each of the ``shards - 1`` splitters: whether a row is at or behind it.

    A round counts the bytes of all rows below the borders of equal parts of each open interval of keys, exactly and
    on all partitions; what comes back is at most ``2 ** DIGIT`` sums for each splitter. The part that holds a
    splitter's goal is the next round's interval. A splitter is done at a border within ``tolerance`` (as a part of
    a shard's bytes) of its goal, or once its part is a single row: then at the nearer side of that row.
    """
    goals = [k * total for k in range(1, shards)]  # in shares of a byte, so that they are whole numbers
    found: list[str | None] = [None] * len(goals)
    #: open intervals: their number at this depth, bytes below them, and the goals in them
    depth, active = 0, {0: (0, list(range(len(goals))))} if total else {}
    spark = rows.sparkSession
    while active:
        step = min(depth + DIGIT, keys.bits)
        names = own_name("high"), own_name("low")
        inside = rows
        if depth:
            split = max(0, depth - keys.key_bits)
            at = ", ".join(f"({number_text(signed(n >> split))}, {n & (2**split - 1)}L)" for n in active)
            wanted = F.broadcast(spark.sql(f"SELECT * FROM VALUES {at} AS t({names[0]}, {names[1]})"))
            inside = rows.select("*", *[c.alias(n) for c, n in zip(keys.prefix(depth), names, strict=True)]).join(wanted, list(names)).drop(*names)
        counted = (
            inside.groupBy(*[c.alias(n) for c, n in zip(keys.prefix(step), names, strict=True)])
            .agg(F.sum(F.col(size).cast("decimal(38,0)")).alias("bytes"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        parts: dict[int, list[tuple[int, int, int]]] = {}
        for high, low, sized, n in counted:
            number = keys.number(high, low, step)
            parts.setdefault(number >> (step - depth), []).append((number, int(sized), n))
        refined: dict[int, tuple[int, list[int]]] = {}
        for parent, (below, inner) in active.items():
            waiting = iter(inner)
            goal = next(waiting, None)
            for number, sized, n in sorted(parts.get(parent, [])):
                while goal is not None and goals[goal] < (below + sized) * shards:
                    before, after = goals[goal] - below * shards, (below + sized) * shards - goals[goal]
                    if n == 1 or step == keys.bits or min(before, after) <= tolerance * total:
                        found[goal] = keys.from_here(number + (after < before), step)
                    else:
                        refined.setdefault(number, (below, []))[1].append(goal)
                    goal = next(waiting, None)
                below += sized
        depth, active = step, refined
    return found


def chosen(tests: list[str | None], first: int = 0) -> str:
    """How many of the ascending ``tests`` a row passes, as SQL; a search by halves."""
    if not tests:
        return str(first)
    middle = len(tests) // 2
    below = chosen(tests[:middle], first)
    if tests[middle] is None:
        return below
    return f"CASE WHEN {tests[middle]} THEN {chosen(tests[middle + 1 :], first + middle + 1)} ELSE {below} END"


def histogram_shards(
    df: DataFrame, *, key_col: str = "doc_id", size: Column, shards: int = SHARDS, tolerance: float = 0.0
) -> DataFrame:
    """``df`` with ``shard, slot``: consecutive ranges of ``key_col`` with near equal sums of ``size``, and the place in each.

    ``key_col`` holds whole numbers. Rows with equal keys have an order of their own, so that a key with very many
    rows is split as well. Each shard ends at the row border next to its goal (of two equally near ones the first);
    with a ``tolerance`` any border found within that part of a shard's bytes will do. ``slot`` counts from 0 in the
    order of the keys, without gaps. Columns of ``df`` named ``shard`` or ``slot`` are replaced.

    Null keys come first. A null or negative size counts as 0. If all sizes are 0, all rows are in the last shard. Repeated
    rows each have a slot. With fewer rows than shards some shards are empty. No rows give no rows.
    """
    if shards < 1:
        raise ValueError("there must be a shard at least")
    names = {n: own_name(n) for n in ("key", "tie", "size", "place", "before")}
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    rows = df.select(
        "*",
        F.coalesce(F.col(f"`{key_col}`").cast("long"), F.lit(LEAST)).alias(names["key"]),
        F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias(names["size"]),
        F.monotonically_increasing_id().alias(names["tie"]),
    ).drop(*[c for c in df.columns if c not in kept])
    rows = stored(rows, "unsharded")  # the numbers must be the same in each round
    low, high, last, total = rows.agg(
        F.min(names["key"]), F.max(names["key"]), F.max(names["tie"]), F.sum(F.col(names["size"]).cast("decimal(38,0)"))
    ).first()
    if low is None:
        return rows.select(*[f"`{c}`" for c in kept], F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    keys = Keys(names["key"], names["tie"], low, ((low - LEAST) ^ (high - LEAST)).bit_length(), last.bit_length())
    tests = splitters(rows.select(*(names[n] for n in ("key", "tie", "size"))), keys, names["size"], int(total), shards, tolerance)
    dealt = rows.withColumn("shard", F.expr(chosen(tests) if total else str(shards - 1)).cast("int"))
    order = ["shard", names["key"], names["tie"]]
    placed = dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(names["place"], F.monotonically_increasing_id())
    placed = stored(placed.drop(names["size"], names["tie"], names["key"]), "shards")
    # a partition holds a run of each shard, so that places follow from the runs' lengths
    run = F.shiftright(names["place"], PLACE_BITS).alias("run")
    runs = placed.groupBy("shard", run).agg(F.count(F.lit(1)).alias("n"), F.min(names["place"]).alias("first"))
    earlier = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "run", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias(names["before"]))
    runs = stored(runs, "runs").withColumnRenamed("run", names["tie"])
    joined = placed.withColumn(names["tie"], run).join(small(runs), ["shard", names["tie"]])
    return joined.select(*[f"`{c}`" for c in kept], "shard", (F.col(names["place"]) + F.col(names["before"])).alias("slot"))


def write_shards(sharded: DataFrame, folder: str) -> None:
    """A folder ``shard=<n>`` of Parquet files for each shard; rows lie in ranges already, so tasks write few files each."""
    sharded.write.partitionBy("shard").parquet(folder)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, by ranges of ``doc_id``."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return histogram_shards(docs, size=F.col("size")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: The checksum goes byte by byte through a table made from the public polynomial.
OP12_SQL = """
WITH RECURSIVE poly(b, k, c) AS (
    SELECT b::BIGINT, 0, b::BIGINT FROM range(256) t(b)
    UNION ALL
    SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8
),
crc AS (SELECT list(c ORDER BY b) AS t FROM poly WHERE k = 8),
sized AS (
    SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
            lambda h: (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1) AS bytes
    FROM documents
),
sums AS (
    SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
        lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295::BIGINT) AS text_crc32
    FROM sized, crc
),
ranked AS (
    SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS below, sum(size) OVER () AS total FROM sums
),
borders AS (
    SELECT k, CASE WHEN k * total - 24 * below <= 24 * (below + size) - k * total THEN below ELSE below + size END AS border
    FROM ranked, range(1, 24) t(k) WHERE 24 * below <= k * total AND k * total < 24 * (below + size)
),
sharded AS (SELECT *, (SELECT count(*) FROM borders WHERE border <= below)::INT AS shard FROM ranked)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM sharded
"""
