from zlib import crc32

import numpy as np

from tidecast.llm import classify as C

SF = "/root/testdata/sf0.01"


def test_features_approximate_the_kernel():
    r = np.random.default_rng(1)
    n, d = C.STATISTICS, 20_000
    model = C.Model(np.zeros(n), np.ones(n), r.normal(size=(n, d)) / np.sqrt(n), r.uniform(0, 2 * np.pi, d), np.zeros(d + 1), np.zeros(0), np.zeros(0))
    x = r.normal(size=(6, n))
    z = model.features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * n))
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_partition_sums_equal_the_whole(spark):
    r = np.random.default_rng(2)
    x, y = r.normal(size=(50, C.STATISTICS)), r.integers(0, 2, 50)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "stats array<double>, label int").repartition(5)
    got = C.summed(df, lambda a, b: np.concatenate([(a.T @ a).ravel(), a.T @ b]), C.STATISTICS**2 + C.STATISTICS)
    assert np.allclose(got, np.concatenate([(x.T @ x).ravel(), x.T @ y]))


def test_held_out_accuracy_on_whole_tables(spark):
    got = C.op6_quality_classifier(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and got.score.between(0, 1).all()
    assert all(h == (crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    both = got[got.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.95


def test_held_out_labels_are_never_read(spark, docs):
    texts = [("good words in a row " + str(i)) if i % 3 else "BAD!! " * (i + 1) for i in range(60)] + ["", None]
    df = docs(texts, extra=True)
    rows = [(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (5, None, 0), (6, 7, 0), (7, 1, 0)]
    flipped = [(i, 1 - q if i is not None and q in (0, 1) and crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in rows]
    kind = "doc_id long, quality int, toxic int"
    one, two = (sorted(map(tuple, C.classify(df, spark.createDataFrame(x, kind)).collect())) for x in (rows, flipped))
    assert one == two and len(one) == 62
    none = C.classify(df, spark.createDataFrame([], kind)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    assert C.classify(df.where("false"), spark.createDataFrame(rows, kind)).collect() == []
