"""Settings of the monitoring system, as plain frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass

# The published configuration of the alert system and its data set.
MACHINE_SENSORS = (
    "Air temperature [K]",
    "Process temperature [K]",
    "Rotational speed [rpm]",
    "Torque [Nm]",
    "Tool wear [min]",
)
MACHINE_TARGET = "Machine failure"
MACHINE_MODES = ("TWF", "HDF", "PWF", "OSF")
MACHINE_IGNORED = ("RNF", "UDI", "Product ID", "Type")
FEATURE_SUFFIXES = ("_Rolling_Mean", "_Volatility", "_Delta", "_Rolling_Delta")
HEALTHY, WARNING, CRITICAL = "HEALTHY", "WARNING", "CRITICAL"
UNKNOWN_MODE = "RandomFailure"
# End of fixed values.


@dataclass(frozen=True)
class Series:
    """How a table is read as time series.

    keys: one series per key; empty = the whole table is a single series.
    order, tiebreak: the time axis; together unique within a series.
    hot_rows: a series with more rows than this is cut into time slices, so
        that no task ever holds a whole hot series. None = never cut.
    """

    keys: tuple[str, ...]
    order: str
    tiebreak: tuple[str, ...] = ()
    hot_rows: int | None = 1_000_000


@dataclass(frozen=True)
class AlertConfig:
    """Decision rules. Defaults are the published ones."""

    critical_threshold: float = 0.765
    warning_sensitivity: float = 0.6
    diagnosis_sensitivity: float = 0.4
    persistence: int = 3
    override_level: float = 0.60
    smoothing_rows: int = 3
    smoothing: str = "mean"  # or "logit": average in log-odds space

    @property
    def warning_zone(self) -> float:
        return self.critical_threshold * self.warning_sensitivity


@dataclass(frozen=True)
class LabelSpec:
    """Label columns; none of them may reach the feature list."""

    target: str
    modes: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()


@dataclass(frozen=True)
class TrainConfig:
    """Search settings of one model."""

    grid: tuple[float, ...]
    max_iter: int
    target_recall: float
    folds: int = 3
    train_fraction: float = 0.8
    seed: int = 42
    tol: float = 1e-6
    parallelism: int = 8
    auc_bins: int = 16_384  # cells of the score histograms of the search
