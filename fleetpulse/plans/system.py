"""The whole system: feature table, stored models, calibration, alert timeline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..config import AlertConfig, LabelSpec, Series, TrainConfig
from ..functions.linear import LinearModel
from ..operators.alerts import alert_timeline
from ..operators.calibrate import best_combination, calibrated, first_alerts, grid_scores
from ..operators.features import SERVE, feature_names, rolling_features
from ..sources.models import load_or_train
from .training import MODE_TRAINING, RISK_TRAINING, train_mode_models, train_risk_model


@dataclass(frozen=True)
class MonitoringSystem:
    """Trained models and decision rules for one kind of machine."""

    sensors: tuple[str, ...]
    series: Series
    risk: LinearModel
    modes: tuple[LinearModel, ...]
    config: AlertConfig = AlertConfig()
    preset: str = SERVE

    def timeline(self, readings: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """One prediction record per reading."""
        return alert_timeline(
            readings, self.sensors, self.series, self.risk, self.modes, self.config, preset=self.preset, keep=keep
        )

    def calibrated(self, readings: DataFrame, target_step: int = 4) -> MonitoringSystem:
        """The same system with the sensitivities that alert closest to the target step."""
        first = first_alerts(readings, self.sensors, self.series, self.risk, self.config, preset=self.preset)
        best = best_combination(grid_scores(first, self.series, target_step))
        return replace(self, config=calibrated(self.config, best))


def load_system(
    readings: DataFrame,
    path: str,
    sensors: Sequence[str],
    series: Series,
    labels: LabelSpec,
    id_column: str,
    config: AlertConfig = AlertConfig(),
    risk_training: TrainConfig = RISK_TRAINING,
    mode_training: TrainConfig = MODE_TRAINING,
    preset: str = SERVE,
) -> MonitoringSystem:
    """Load the stored models under `path`; train and store those that are missing."""
    spark = readings.sparkSession
    features = feature_names(sensors)
    table = rolling_features(readings, sensors, series, preset=preset)
    made = (preset, series.keys, series.order, series.tiebreak)
    # training orders rows by time over all machines
    everything = replace(series, keys=(), tiebreak=tuple(dict.fromkeys((*series.tiebreak, id_column))))

    def train_risk(_: str):
        return train_risk_model(table, features, everything, labels, risk_training)

    def train_mode(name: str):
        return train_mode_models(table, features, everything, labels, id_column, mode_training, only=[name])[0]

    risk = load_or_train(spark, path, ["risk"], features, risk_training, train_risk, made)
    modes = load_or_train(spark, path, labels.modes, features, mode_training, train_mode, made)
    return MonitoringSystem(
        tuple(sensors), series, risk["risk"], tuple(modes[m] for m in labels.modes), config, preset
    )
