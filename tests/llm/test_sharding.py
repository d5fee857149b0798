import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from tidecast.llm import sharding as S


def brute(sizes, shards):
    """Shard of each place, for rows in their order with all sizes above 0: borders nearest to the goals, lower ones of two."""
    total, below = sum(sizes), [0]
    for s in sizes:
        below.append(below[-1] + s)
    borders = [min(below, key=lambda x: (abs(shards * x - k * total), x)) for k in range(1, shards)]
    return [bisect_right(borders, b) for b in below[:-1]]


def check(df, sizes, shards):
    rows = S.histogram_shards(df, size=F.col("size"), shards=shards).collect()
    rows.sort(key=lambda r: (r["shard"], r["slot"]))
    assert [r["shard"] for r in rows] == brute(sizes, shards)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(v == list(range(len(v))) for v in slots.values())
    return rows


@pytest.mark.parametrize("ids", [lambda r: r.randint(-(2**63), 2**63 - 1), lambda r: r.randint(0, 10**6), lambda r: 2**40 + r.randint(0, 10**9) * 2**20])
def test_equals_brute_force(spark, monkeypatch, ids):
    monkeypatch.setattr(S, "DIGIT", 4)
    r = random.Random(7)
    keys = sorted({ids(r) for _ in range(500)} | {ids(r)})
    sizes = [r.choice([1, 5, 8, 300, 5000]) for _ in keys]
    rows = list(zip(keys, sizes, strict=True))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, size long").repartition(5)
    found = check(df, sizes, 7)
    assert [x.doc_id for x in found] == keys


def test_one_key_with_most_rows_is_split(spark):
    df = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(1500).alias("doc_id"), F.lit(10).alias("size"))
    found = check(df, [10] * 3000, 24)
    assert {r["shard"] for r in found if r.doc_id == 1500} >= set(range(6, 18)) and [r.doc_id for r in found] == sorted(r.doc_id for r in found)


def test_nulls_no_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, None, "own"), (3, 0, "own"), (3, 0, "own"), (2, -5, "own")], "doc_id long, size long, shard string")
    found = S.histogram_shards(df, size=F.col("size"), shards=3).collect()
    assert {r["shard"] for r in found} == {2} and sorted(r["slot"] for r in found) == [0, 1, 2, 3]
    assert next(r["slot"] for r in found if r.doc_id is None) == 0 and df.columns == ["doc_id", "size", "shard"]
    none = S.histogram_shards(df.where("false"), size=F.col("size"), shards=3)
    assert none.collect() == [] and none.columns == ["doc_id", "size", "shard", "slot"]
    few = spark.createDataFrame([(1, 5), (2, 7)], "doc_id long, size long")
    check(few, [5, 7], 24)
    assert {r["shard"] for r in S.histogram_shards(few, size=F.col("size"), shards=1).collect()} == {0}


def test_tolerance_stops_early(spark, monkeypatch):
    monkeypatch.setattr(S, "DIGIT", 3)
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 + 1).alias("size"), F.lit("x").alias("text"))
    exact = S.histogram_shards(df, size=F.col("size"), shards=10).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    loose = S.histogram_shards(df, size=F.col("size"), shards=10, tolerance=0.05).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    shard = sum(r.s for r in exact) / 10
    assert all(abs(r.s - shard) <= 7 for r in exact) and all(abs(r.s - shard) <= 0.1 * shard for r in loose)


def test_shards_as_files(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("text"))
    S.write_shards(S.histogram_shards(df, size=F.octet_length("text") + 8, shards=4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    sizes = [2 * i + 8 for i in range(200)]
    assert [r["shard"] for r in back.orderBy("doc_id").collect()] == brute(sizes, 4)
    assert back.where("shard = 2").agg(F.max("doc_id")).first()[0] < back.where("shard = 3").agg(F.min("doc_id")).first()[0]


def test_plan_has_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.octet_length("text").alias("size"))
    plan = S.histogram_shards(docs, size=F.col("size"))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "ExistingRDD"))
