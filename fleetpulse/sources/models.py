"""Model registry: versions of coefficient tables and standard pipelines on shared storage.

Every saved version has a folder of its own that never changes. The manifest of a model is a table
that only grows, one row for each version, and is written when all else of the version is there;
its newest row names the current version. A reader so gets the old version or the new one,
never parts of both, also while another job saves.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..config import TrainConfig
from ..functions.linear import LinearModel, coefficient_table, models_from_table
from ..plans.training import Trained, metrics_table

MANIFEST_SCHEMA = "model string, version string, saved timestamp, features array<string>, fingerprint string"


class StaleModel(ValueError):
    """A stored model was trained for other features or settings."""


def fingerprint(features: Sequence[str], config: TrainConfig, made: Sequence = ()) -> str:
    """Hash of what defines a model: features, search settings, and how the features were `made`.

    Settings that only change the speed, such as the thread count, are left out.
    """
    settings = {k: v for k, v in asdict(config).items() if k != "parallelism"}
    text = json.dumps([list(features), settings, list(made)], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def _base(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def save_model(
    spark: SparkSession, path: str, trained: Trained, config: TrainConfig, run_id: str = "", made: Sequence = ()
) -> str:
    """Store one model as the newest version under `path`/name; its metrics go to the shared metrics table."""
    model, version = trained.model, uuid.uuid4().hex
    base = _base(path, model.name)
    coefficient_table(spark, [model]).coalesce(1).write.parquet(f"{base}/versions/{version}/coefficients")
    trained.pipeline.save(f"{base}/versions/{version}/pipeline")
    metrics_table([trained], run_id).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/metrics")
    # written last, in one file: a version without its row counts as absent
    row = [(model.name, version, datetime.now(timezone.utc), list(model.features), fingerprint(model.features, config, made))]
    spark.createDataFrame(row, MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/manifest")
    return version


def versions(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All versions of a model, the current one first."""
    newest = [F.desc("saved"), F.desc("version")]
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{_base(path, name)}/manifest").orderBy(*newest)


def _current(spark: SparkSession, path: str, name: str):
    try:
        return versions(spark, path, name).first()
    except AnalysisException:
        return None


def load_model(
    spark: SparkSession, path: str, name: str, features: Sequence[str], config: TrainConfig, made: Sequence = ()
) -> LinearModel | None:
    """The current version of a model, None if there is none; refuses one trained for other inputs."""
    row = _current(spark, path, name)
    if row is None:
        return None
    if row["fingerprint"] != fingerprint(features, config, made):
        raise StaleModel(f"model {name!r} in {path} was trained with other features or settings; retrain it")
    return models_from_table(spark.read.parquet(f"{_base(path, name)}/versions/{row['version']}/coefficients"))[0]


def load_pipeline(spark: SparkSession, path: str, name: str) -> PipelineModel:
    row = _current(spark, path, name)
    if row is None:
        raise FileNotFoundError(f"no model {name!r} in {path}")
    return PipelineModel.load(f"{_base(path, name)}/versions/{row['version']}/pipeline")


def load_or_train(
    spark: SparkSession,
    path: str,
    names: Sequence[str],
    features: Sequence[str],
    config: TrainConfig,
    train: Callable[[str], Trained],
    made: Sequence = (),
) -> dict[str, LinearModel]:
    """Every named model: read when stored, else trained by `train(name)` and stored."""
    models = {}
    for name in names:
        found = load_model(spark, path, name, features, config, made)
        if found is None:
            trained = train(name)
            save_model(spark, path, trained, config, made=made)
            found = trained.model
        models[name] = found
    return models


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/metrics").orderBy(F.desc("created"), "model")
