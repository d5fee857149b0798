"""A log of back-test runs as Parquet tables."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

RUNS = "run_id string, run_name string, started timestamp_ntz, ended timestamp_ntz"
STARTS = "run_id string, started timestamp_ntz"
SIGNATURES = "run_id string, model string, position int, feature string, type string"
PARAMS = "run_id string, key string, value string"
METRICS = "run_id string, key string, value double"


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class RunLog:
    """Tables ``runs``, ``params``, ``forecast``, ``fold_metric`` and ``metric`` below one path, and the models.

    Each run writes its own partition of each table and overwrites it when it
    writes again, so that a repeated step adds nothing twice. The row in ``runs``
    comes last: a run that broke off is not found.
    """

    spark: SparkSession
    path: str

    def _of_run(self, table: str, run_id: str) -> str:
        if not re.fullmatch(r"[\w.-]+", run_id):
            raise ValueError(f"run id {run_id!r} is not made of letters, digits, dots, dashes and underscores")
        return f"{self.path.rstrip('/')}/{table}/run_id={run_id}"

    def _write(self, df: DataFrame, table: str, run_id: str) -> None:
        df.drop("run_id").write.mode("overwrite").parquet(self._of_run(table, run_id))

    def _write_runs(self, df: DataFrame, table: str) -> None:
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id")
            .parquet(f"{self.path.rstrip('/')}/{table}")
        )

    def _read(self, table: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.option("basePath", f"{self.path.rstrip('/')}/{table}")
        if schema is not None:
            reader = reader.schema(schema)
        try:
            found = reader.parquet(f"{self.path.rstrip('/')}/{table}")
        except AnalysisException as problem:
            if schema is None or problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        if schema is not None:
            return found
        # Spark guesses the type of a partition column; a run id is always text.
        fields = [T.StructField("run_id", T.StringType()) if f.name == "run_id" else f for f in found.schema]
        return reader.schema(T.StructType(fields)).parquet(f"{self.path.rstrip('/')}/{table}")

    # -- writing -------------------------------------------------------------

    def new_run(self, run_id: str | None = None) -> str:
        """Note when a run starts; returns its id, a new one unless given."""
        run_id = uuid.uuid4().hex if run_id is None else run_id
        self._write(self.spark.createDataFrame([(now(),)], "started timestamp_ntz"), "start", run_id)
        return run_id

    def log_params(self, run_id: str, params: Mapping[str, Any]) -> None:
        rows = [(k, str(v)) for k, v in params.items()]
        self._write(self.spark.createDataFrame(rows, "key string, value string"), "params", run_id)

    def log_forecast(self, run_id: str, forecast: DataFrame) -> None:
        self._write(forecast, "forecast", run_id)

    def log_model(self, run_id: str, name: str, model: PipelineModel, features: T.StructType | None = None) -> str:
        """Store a model and, given the schema of its features, its input signature."""
        path = f"{self.path.rstrip('/')}/models/{run_id}/{name}"
        model.write().overwrite().save(path)
        if features is not None:
            rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(features)]
            signature = self.spark.createDataFrame(rows, "position int, feature string, type string").coalesce(1)
            signature.write.mode("overwrite").parquet(f"{self._of_run('signature', run_id)}/model={name}")
        return path

    def artifact(self, run_id: str, name: str) -> str:
        """Where a run's file of this name goes."""
        self._of_run("artifacts", run_id)
        return f"{self.path.rstrip('/')}/artifacts/{run_id}/{name}"

    def finish(self, run_id: str, name: str = "") -> None:
        """Make the run visible, with the times of its start and end; one that noted no start began now."""
        ended = now()
        noted = self._read("start", STARTS).where(F.col("run_id") == run_id).agg(F.min("started")).first()[0]
        times = "run_name string, started timestamp_ntz, ended timestamp_ntz"
        self._write(self.spark.createDataFrame([(name, noted or ended, ended)], times), "runs", run_id)

    def log_fold_metrics(self, folds: DataFrame) -> None:
        """Fold scores of any number of runs, told apart by a ``run_id`` column."""
        self._write_runs(folds, "fold_metric")

    def log_metrics(self, metrics: DataFrame) -> None:
        """Rows ``run_id, key, value`` of any number of runs."""
        self._write_runs(metrics, "metric")

    # -- reading -------------------------------------------------------------

    def runs(self) -> DataFrame:
        return self._read("runs", RUNS)

    def params(self) -> DataFrame:
        return self._read("params", PARAMS)

    def metrics(self) -> DataFrame:
        return self._read("metric", METRICS)

    def forecasts(self) -> DataFrame:
        return self._read("forecast")

    def fold_metrics(self) -> DataFrame:
        return self._read("fold_metric")

    def fold_metric(self, run_id: str) -> DataFrame:
        """One run's fold scores; reads that run's partition only."""
        return self.spark.read.parquet(self._of_run("fold_metric", run_id))

    def signatures(self) -> DataFrame:
        """The features of all models, with their types."""
        return self._read("signature", SIGNATURES)

    def check_signature(self, run_id: str, name: str, df: DataFrame) -> None:
        """Error if ``df`` lacks a feature of a model or has it in another type."""
        given = {f.name.lower(): f.dataType.simpleString() for f in df.schema}
        noted = self.signatures().where((F.col("run_id") == run_id) & (F.col("model") == name)).orderBy("position").collect()
        wrong = [f"{r['feature']} {r['type']}" for r in noted if given.get(r["feature"].lower()) != r["type"]]
        if wrong:
            raise ValueError(f"model {name!r} of run {run_id!r} takes {', '.join(wrong)}")

    def forecast(self, run_id: str) -> DataFrame:
        """One run's forecasts; reads that run's partition only."""
        return self.spark.read.parquet(self._of_run("forecast", run_id))

    def model(self, run_id: str, name: str) -> PipelineModel:
        return PipelineModel.load(f"{self.path.rstrip('/')}/models/{run_id}/{name}")

    def unscored(self) -> DataFrame:
        """Runs without any metric."""
        return self.runs().join(self.metrics().select("run_id"), "run_id", "left_anti")
