"""Quality classifier: kernel ridge regression by random Fourier features of text statistics, calibrated by isotonic regression."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.common import map_batches, schema_of, stored, table

#: Random features, penalty, and kernel width in units of the square root of the number of statistics.
FEATURES, RIDGE, WIDTH, SEED = 512, 1e-3, 1.0, 20240
#: Labelled rows that are learned from at most, and tasks that sum them up.
MOST_ROWS, PARTS = 200_000, 16
THRESHOLD = 0.7
#: The part of the raw score in the calibrated one.
BLEND = 0.02

_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"|", b"#*$%&<>@^~", b"\"'()[]{}-_/\\=+"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 11
CLASSES = 12
STATISTICS = CLASSES + 11


def statistics(text: str | None) -> list[float]:
    """Shares of kinds of characters, and how long, how various and how often repeated words and lines are."""
    raw = (text or "").encode()
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=CLASSES) / max(1, len(raw))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    if not n:
        return [*kinds.tolist(), *[0.0] * (STATISTICS - CLASSES)]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    sizes = np.fromiter(map(len, words), np.int64, n)
    times = np.bincount(ids)
    pairs = ids[:-1] * len(number) + ids[1:]
    return [
        *kinds.tolist(),
        np.log1p(n),
        np.log1p(len(lines)),
        np.log1p(n / len(lines)),
        sizes.mean(),
        sizes.std(),
        float((sizes <= 3).mean()),
        len(number) / n,
        times.max() / n,
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        1 - len(np.unique(pairs)) / len(pairs) if n > 1 else 0.0,
        1 - len(set(lines)) / len(lines),
    ]


@dataclass(frozen=True)
class Model:
    """Standardised statistics, cosines of random projections, ridge weights, and the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Their products approximate a Gaussian kernel; the last is constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.projection + self.phase
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; where the calibration is level, a small part of the raw score keeps the order."""
        if not len(self.knots):
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        level = np.clip(np.interp(raw, self.knots, self.values), 0, 1)
        return (1 - BLEND) * level + BLEND * np.clip(0.25 + raw / 2, 0, 1)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), STATISTICS)


def text_statistics(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, stats`` for each row; those of a null text are those of an empty one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = pa.array((statistics(t.as_py()) for t in batch.column(1)), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(0), made], names=[id_col, "stats"])

    return map_batches(df.select(id_col, text_col), run, schema_of(df.select(id_col), stats=T.ArrayType(T.DoubleType())))


def summed(rows: DataFrame, function, width: int) -> np.ndarray:
    """Sum over ``rows`` (``stats, label``) of ``function``'s vector: a partial sum in each of a few tasks."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = function(matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
        return pa.RecordBatch.from_arrays([pa.array([made.astype("<f8").tobytes()], pa.binary())], names=["part"])

    parts = map_batches(rows.select("stats", "label").coalesce(PARTS), run, "part binary").toLocalIterator()
    return reduce(lambda total, row: total + np.frombuffer(row["part"], "<f8"), parts, np.zeros(width))


def fit(rows: DataFrame, calibration: DataFrame, *, features: int = FEATURES, ridge: float = RIDGE, width: float = WIDTH, seed: int = SEED) -> Model:
    """A model of ``label`` (0 or 1) from ``stats``; ``calibration`` are other rows of the same kind.

    Each task sums up its part of the normal equations, a matrix of ``features + 1`` rows; the driver adds up one sum
    for each batch of a bounded number of rows and solves. Without rows, or without rows to calibrate on, scores are
    0.5 throughout.
    """
    moments = summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * STATISTICS)
    n = max(1.0, moments[0])
    mean = moments[1 : 1 + STATISTICS] / n
    scale = np.sqrt(np.maximum(moments[1 + STATISTICS :] / n - mean**2, 0))
    random = np.random.default_rng(seed)
    projection = random.normal(size=(STATISTICS, features)) / (width * np.sqrt(STATISTICS))
    phase = random.uniform(0, 2 * np.pi, features)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), projection, phase, np.zeros(features + 1), np.zeros(0), np.zeros(0))
    if not moments[0]:
        return model
    size = features + 1

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = summed(rows, equations, size * size + size)
    weights = np.linalg.solve(sums[: size * size].reshape(size, size) + ridge * n * np.eye(size), sums[size * size :])
    model = Model(mean, model.scale, projection, phase, weights, model.knots, model.values)
    raw = scored(calibration, model, "raw").select("raw", F.col("label").cast("double").alias("label"))
    if raw.isEmpty():
        return model
    curve = IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw)
    return Model(mean, model.scale, projection, phase, weights, curve.boundaries.toArray(), curve.predictions.toArray())


def scored(stats: DataFrame, model: Model, kind: str = "score") -> DataFrame:
    """``stats`` with the model's ``score``, or the ``raw`` one before calibration, in place of the statistics."""
    names = [c for c in stats.columns if c != "stats"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = pa.array(getattr(model, kind)(matrix(batch.column("stats"))), pa.float64())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], names=[*names, kind])

    return map_batches(stats, run, schema_of(stats.select(*names), **{kind: T.DoubleType()}))


def fold(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 4


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    held_out: int = 2,
    calibrated: int = 3,
    most_rows: int = MOST_ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``<id_col>, held_out, score, predicted`` for each row of ``docs``.

    Rows are dealt into four folds by the checksum of their id: labels of fold ``held_out`` are never read, fold
    ``calibrated`` fits the calibration, the others the ridge scores. Beyond ``most_rows`` labelled rows, each fold
    is thinned by a hash of ids to about that number. Only the text enters a score.

    Null labels, and labels other than 0 and 1, are left out; a document labelled twice counts twice; repeated rows
    are each scored. A null text scores as an empty one. A null id has the checksum of an empty text.
    """
    held = fold(F.col(id_col)) == held_out
    stats = stored(text_statistics(docs, id_col=id_col, text_col=text_col), "statistics")
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held)
    n = known.count()
    if n > most_rows:
        known = known.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    rows = stored(stats.join(known, id_col).select("stats", "label", (fold(F.col(id_col)) == calibrated).alias("calibrated")), "labelled")
    model = fit(rows.where("not calibrated"), rows.where("calibrated").select("stats", "label"))
    out = scored(stats.withColumn("held_out", held), model)
    return out.select(id_col, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
