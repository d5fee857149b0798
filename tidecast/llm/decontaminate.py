"""Benchmark decontamination by templates: numbers, units and names become placeholders, windows of them are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import own_name, small, stored, table, text_key

WINDOW = 5
SIMILARITY = 0.8
#: Windows along one alignment that are enough, whatever part of the item they are: a passage of nearly fifty words.
PASSAGE = 40
#: Placeholders that a window may hold; one with more says too little and counts by its own numbers and units.
MOST_SLOTS = 2
#: Words from which on a short item is looked for within texts; shorter ones are held against whole texts.
LEAST_WORDS = 3
#: Windows of a benchmark that may be broadcast: hash, item and a count.
WINDOW_ROWS = 500_000
#: Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mile miles meter meters metre metres mg g kg t lb lbs oz gram grams ml cl l liter liters litre litres "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent kb mb gb tb hz khz mhz ghz w kw v a j kj cal kcal"
).split()
#: Words with their marks, numbers with their separators, currency and percent signs.
TOKEN = r"[\p{L}\p{M}_]+|\p{N}+(?:[.,:/]\p{N}+)*|[%$€£]"
#: The lowest two bits of a token's value: what kind of placeholder it is.
KIND, NUMBER, UNIT = 3, 1, 2


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_kept(tokens: Column, i: Column) -> Column:
    """Whether a token stays in the template. A word with a capital is a name, or stands where one may, and does not.

    Inside a run of four and more such words it stays: that is a heading or a text in capitals.
    """

    def capital(k: Column) -> Column:
        head = F.substring(F.get(tokens, k), 1, 1)
        return F.coalesce(head != F.lower(head), F.lit(False))

    return ~capital(i) | (capital(i - 1) & capital(i + 1) & (capital(i - 2) | capital(i + 2)))


def value_of(token: Column, before: Column) -> Column:
    """A token's hash, whatever its case, with the kind of placeholder it is in the lowest bits."""
    number = lambda t: (t >= "0") & (t < ":")
    kind = (
        F.when(number(token), NUMBER)
        .when(number(before) & F.lower(token).isin(UNITS), UNIT)
        .when(token.isin("%", "$", "€", "£"), UNIT)
        .otherwise(0)
    )
    return F.shiftleft(F.xxhash64(F.lower(token)), 2).bitwiseOR(kind.cast("long"))


def kind_of(value: Column) -> Column:
    return value.bitwiseAND(F.lit(KIND).cast("long"))


def coded(values: Column) -> Column:
    """The values with bare kinds in place of placeholders, which no word's value equals."""
    return F.transform(values, lambda v: F.when(kind_of(v) > 0, kind_of(v)).otherwise(v))


def window_hash(values: Column, codes: Column, i: Column) -> Column:
    """Hash of the window that starts at ``i``: of its words and placeholders, or of its tokens if too many are placeholders.

    Single elements are read: a slice would copy the whole text's array for each window.
    """
    parts = [F.get(codes, i + k) for k in range(WINDOW)]
    slots = [F.least(kind_of(p), F.lit(1).cast("long")) for p in parts]
    few = sum(slots[1:], slots[0]) <= MOST_SLOTS
    return F.when(few, F.xxhash64(*parts)).otherwise(F.xxhash64(*[F.get(values, i + k) for k in range(WINDOW)], F.lit("own")))


def places(count: Column) -> Column:
    """0 to ``count`` - 1; empty if that is below 1."""
    return F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def hashes_of(text: Column) -> Column:
    """Hashes of the template windows of a text, in order."""
    # most tokens are lower-case words, which need no look at their neighbours
    kept = let(tokens_of(text), lambda t: F.filter(t, lambda x, i: ((x >= "a") & (x < "{")) | is_kept(t, i)))
    values = let(kept, lambda t: F.transform(t, lambda x, i: value_of(x, F.get(t, i - 1))))
    return let(values, lambda v: let(coded(v), lambda c: F.transform(places(F.size(v) - WINDOW + 1), lambda i: window_hash(v, c, i))))


def runs_of(text: Column, length: int) -> Column:
    """Hashes of all runs of so many tokens of a text, names too, whatever their case."""
    words = F.transform(tokens_of(text), lambda t: F.xxhash64(F.lower(t)))
    return let(words, lambda w: F.transform(places(F.size(w) - length + 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(length)], F.lit(length))))


def windows_of(text: Column) -> Column:
    """``h, at, slots``: hash and place of each template window, and what stands at its placeholders.

    ``slots`` has numbers and units, with their place in the window, and the names that were left out between two of its
    words, with the place of the later one.
    """

    def whole(tokens: Column, kept: Column) -> Column:
        values = F.transform(kept, lambda i, k: value_of(F.get(tokens, i), F.get(tokens, F.get(kept, k - 1))))
        words = F.transform(kept, lambda i: F.lower(F.get(tokens, i)))
        names = F.transform(
            kept, lambda i, k: F.lower(F.array_join(F.slice(tokens, F.coalesce(F.get(kept, k - 1), F.lit(-1)) + 2, i - F.coalesce(F.get(kept, k - 1), F.lit(-1)) - 1), " "))
        )

        def window(v: Column, c: Column, w: Column, n: Column, i: Column) -> Column:
            numbers = [F.when(kind_of(F.get(v, i + k)) > 0, F.concat(F.lit(f"{k}#"), F.get(w, i + k))).otherwise("") for k in range(WINDOW)]
            between = [F.when(F.get(n, i + k) != "", F.concat(F.lit(f"{k}@"), F.get(n, i + k))).otherwise(F.lit(f"{k}@")) for k in range(1, WINDOW)]
            return F.struct(window_hash(v, c, i).alias("h"), i.alias("at"), F.array(*numbers, *between).alias("slots"))

        def windows(v: Column, w: Column, n: Column) -> Column:
            return let(coded(v), lambda c: F.transform(places(F.size(v) - WINDOW + 1), lambda i: window(v, c, w, n, i)))

        return let(values, lambda v: let(words, lambda w: let(names, lambda n: windows(v, w, n))))

    return let(tokens_of(text), lambda t: let(F.filter(places(F.size(t)), lambda i: is_kept(t, i)), lambda k: whole(t, k)))


def short_items(df: DataFrame, items: DataFrame, similarity: float, text_col: str) -> DataFrame:
    """``k1, k2, item, found, windows, slots`` for items without a template window: runs of their tokens, five at most, in any case.

    An item of fewer than three tokens is found only where it is the whole text.
    """
    tokens = items.withColumn("n", F.size(tokens_of(F.lower("text"))))
    lengths = sorted(r[0] for r in tokens.where("n > 0").select(F.least("n", F.lit(WINDOW))).distinct().collect())
    keyed = df.select(*text_key(text_col), F.col(text_col).alias("text"))
    out = None
    for length in lengths:
        own = tokens.where(F.least("n", F.lit(WINDOW)) == length)
        wanted = own.select("item", "number", F.explode(F.array_distinct(runs_of(F.lower("text"), length))).alias("h"))
        sizes = wanted.groupBy("number").agg(F.count(F.lit(1)).alias("windows"))
        wanted = small(stored(wanted.join(sizes, "number"), "short"), WINDOW_ROWS)
        rows = keyed if length >= LEAST_WORDS else keyed.where(F.size(tokens_of(F.col("text"))) == length)
        found = (
            rows.select("k1", "k2", F.explode(runs_of(F.col("text"), length)).alias("h"))
            .join(wanted, "h")
            .groupBy("k1", "k2", "number", "item", "windows", "h")
            .agg(F.lit(1).alias("one"))
            .groupBy("k1", "k2", "number", "item", "windows")
            .agg(F.count(F.lit(1)).alias("found"))
            .where((F.col("found") >= similarity * F.col("windows")) | (F.col("found") >= PASSAGE))
            .select("k1", "k2", "item", "found", "windows", F.lit(0).cast("long").alias("slots"))
        )
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``k1, k2, item, found, windows, slots``: which texts hold which benchmark items, perhaps with other numbers, units or names.

    Templates: numbers and units become placeholders, and words with a capital (names of any number of words, and first words
    of sentences) are left out but remembered. A text holds an item if at least ``similarity`` of the item's distinct
    windows of five are found in it along consistent alignments, or ``PASSAGE`` windows along one of them. An alignment is a
    distance between the places in text and item; it is consistent if what stands at the item's placeholders and in
    place of its names always goes over into the same thing in the text. Each item also counts as written in lower case
    throughout. A window of more than two placeholders counts by its own numbers and units, so items of little else are
    found as copies only. Items without a window are found by runs of their tokens, whatever the case.

    Keys are those of :func:`text_key`; equal texts share one. Null and empty texts and items are in no row, nor are items without any word or
    number. Repeated items count once, as do items with a null id. The join runs over single hashes; the items'
    windows are broadcast if they are few. Slots are looked at only in texts that pass without them.
    """
    known = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL").dropDuplicates(["item", "text"])
    known = stored(known.withColumn("number", F.monotonically_increasing_id() * 2), "benchmark")
    lower = known.select("item", F.lower("text").alias("text"), (F.col("number") + 1).alias("number")).join(
        known.select("item", "text"), ["item", "text"], "left_anti"
    )
    items = stored(
        known.unionByName(lower).select("number", "item", F.explode(windows_of(F.col("text"))).alias("w")).select("number", "item", "w.h", "w.at", "w.slots"),
        "items",
    )
    sizes = items.groupBy("number").agg(F.count_distinct("h").alias("windows"))
    wanted = stored(items.select("number", "h").distinct().join(sizes, "number"), "wanted")
    keyed = df.select(*text_key(text_col), F.col(text_col).alias("text"))
    hashes = keyed.select("k1", "k2", F.explode(hashes_of(F.col("text"))).alias("h"))
    enough = (F.col("found") >= similarity * F.col("windows")) | (F.col("found") >= PASSAGE)
    near = (
        hashes.join(small(wanted, WINDOW_ROWS), "h")
        .groupBy("k1", "k2", "number", "windows", "h")
        .agg(F.lit(1).alias("one"))
        .groupBy("k1", "k2", "number", "windows")
        .agg(F.count(F.lit(1)).alias("found"))
        .where(enough)
        .select("k1", "k2", "number", "windows")
    )
    near = stored(near, "near")
    texts = keyed.join(small(near.select("k1", "k2").distinct()), ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    held = texts.select("k1", "k2", F.explode(windows_of(F.col("text"))).alias("w")).select(
        "k1", "k2", F.col("w.h").alias("h"), F.col("w.at").alias("text_at"), F.col("w.slots").alias("text_slots")
    )
    matched = held.join(items, "h").join(near, ["k1", "k2", "number"])
    value = lambda x: F.substring_index(F.substring_index(x, "#", -1), "@", -1)
    swaps = F.filter(
        F.transform(
            F.arrays_zip(F.col("slots").alias("a"), F.col("text_slots").alias("b")), lambda x: F.struct(value(x["a"]).alias("a"), value(x["b"]).alias("b"))
        ),
        lambda s: s["a"] != "",
    )
    aligned = (
        matched.select("k1", "k2", "number", "item", "windows", (F.col("text_at") - F.col("at")).alias("shift"), "h", swaps.alias("swaps"))
        .groupBy("k1", "k2", "number", "item", "windows", "shift")
        .agg(F.collect_set("h").alias("hs"), F.array_distinct(F.flatten(F.collect_set("swaps"))).alias("swaps"))
        .where(F.size("swaps") == F.size(F.array_distinct(F.transform("swaps", lambda s: s["a"]))))
    )
    templates = (
        aligned.groupBy("k1", "k2", "number", "item", "windows")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("hs")))).cast("long").alias("found"),
            F.max(F.size("hs")).alias("along"),
            F.max(F.size("swaps")).cast("long").alias("slots"),
        )
        .where((F.col("found") >= similarity * F.col("windows")) | (F.col("along") >= PASSAGE))
        .select("k1", "k2", "item", "found", "windows", "slots")
    )
    short = short_items(df, known.join(sizes, "number", "left_anti"), similarity, text_col)
    return (
        (templates if short is None else templates.unionByName(short))
        .groupBy("k1", "k2", "item")
        .agg(F.max_by(F.struct("found", "windows", "slots"), F.struct(F.col("found") / F.col("windows"), "found")).alias("best"))
        .select("k1", "k2", "item", "best.*")
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = stored(contaminated(docs, table(spark, sf_dir, "benchmark")), "found")
    rows = docs.select("doc_id", *text_key("text"))
    return rows.join(small(found.select("k1", "k2", F.col("item").alias("item_id"), "found", "windows", "slots"), 50_000), ["k1", "k2"]).drop("k1", "k2")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    k1, k2 = own_name("k1"), own_name("k2")
    found = stored(contaminated(docs, table(spark, sf_dir, "benchmark")).select("k1", "k2").distinct(), "found")
    one, two = text_key("text")
    keyed = docs.withColumns({k1: one, k2: two})
    gone = small(found.select(F.col("k1").alias(k1), F.col("k2").alias(k2)))
    return keyed.join(gone, [k1, k2], "left_anti").select(docs.columns)
