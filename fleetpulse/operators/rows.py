"""Row and column selection: labels, complete cases, feature lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FEATURE_SUFFIXES, LabelSpec
from ..functions.columns import c, cols, is_numeric
from .quantiles import present


class SchemaMismatch(ValueError):
    """The table lacks a model feature, or a label leaked into the features."""


def failures_only(df: DataFrame, target: str) -> DataFrame:
    return df.where(c(target) == 1)


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    gone = set(names)
    return df.select(*cols(n for n in df.columns if n not in gone))


def cast_label(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(label, c(label).cast("int"))


def complete_cases(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value in `features` (all columns if not given)."""
    for n in features or df.columns:
        df = df.where(present(df, n).isNotNull())
    return df


def fill_missing(df: DataFrame, features: Sequence[str], value: float = 0.0) -> DataFrame:
    wanted = set(features)
    return df.select(
        *[
            F.coalesce(present(df, n), F.lit(value).cast(df.schema[n].dataType)).alias(n) if n in wanted else c(n)
            for n in df.columns
        ]
    )


def discover_sensors(df: DataFrame, labels: LabelSpec, not_sensors: Iterable[str] = ()) -> list[str]:
    """Numeric columns that are neither reserved nor derived features."""
    reserved = {labels.target, *labels.modes, *labels.ignored, *not_sensors}
    return [
        f.name
        for f in df.schema.fields
        if f.name not in reserved and is_numeric(f.dataType) and not f.name.endswith(FEATURE_SUFFIXES)
    ]


def feature_columns(df: DataFrame, labels: LabelSpec, not_features: Iterable[str] = ()) -> list[str]:
    """Model inputs for every model: all columns but the target, all modes and the ignored ones."""
    reserved = {labels.target, *labels.modes, *labels.ignored, *not_features}
    features = [n for n in df.columns if n not in reserved]
    for n in features:
        if not is_numeric(df.schema[n].dataType):
            raise SchemaMismatch(f"feature {n!r} is not numeric; ignore it or encode it first")
    return features


def check_no_leakage(features: Iterable[str], labels: LabelSpec) -> None:
    leaked = sorted(set(features) & {labels.target, *labels.modes, *labels.ignored})
    if leaked:
        raise SchemaMismatch(f"label or ignored columns among the features: {', '.join(leaked)}")


def model_inputs(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Select the features in model order, with a clear error when some are missing."""
    missing = [n for n in features if n not in df.columns]
    if missing:
        known = {*features, *keep}
        extra = [n for n in df.columns if n not in known]
        raise SchemaMismatch(f"missing features: {missing}; unexpected columns: {extra}")
    return df.select(*cols([*keep, *(n for n in features if n not in keep)]))


def predicted_label(df: DataFrame, score: str, threshold: float, name: str = "predicted") -> DataFrame:
    return df.withColumn(name, (c(score) >= F.lit(threshold)).cast("int"))
