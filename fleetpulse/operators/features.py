"""Rolling sensor features: level, volatility, change and mean change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FEATURE_SUFFIXES, Series
from ..functions.columns import c
from .series import drop_slices, with_lookback

MEAN, VOLATILITY, DELTA, ROLLING_DELTA = FEATURE_SUFFIXES
TRAIN, SERVE = "train", "serve"


def feature_names(sensors: Sequence[str]) -> list[str]:
    """Raw sensors followed by their derived columns."""
    return [*sensors, *[f"{s}{suffix}" for s in sensors for suffix in FEATURE_SUFFIXES]]


def lookback_rows(window: int, preset: str) -> int:
    """Preceding rows that can influence a feature value."""
    return window if preset == TRAIN else window - 1


def add_features(df: DataFrame, w: WindowSpec, sensors: Sequence[str], window: int, preset: str) -> DataFrame:
    """The features over a given window.

    "train": full windows only (NULL before), `window` deltas in the rolling delta.
    "serve": whatever history is there, only the deltas inside the last `window`
    readings, and 0 where nothing can be said.
    """
    full = w.rowsBetween(-(window - 1), 0)
    delta_rows = full if preset == TRAIN else w.rowsBetween(-(window - 2), 0)
    steps = {s: f"__delta{i}" for i, s in enumerate(sensors)}

    def values(s: str) -> Column:
        """The reading as a double; NaN is a missing reading, like NULL."""
        kind = df.schema[s].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c(s)), c(s).cast("double"))
        return c(s).cast("double")

    stepped = df.select("*", *[(values(s) - F.lag(values(s), 1).over(w)).alias(d) for s, d in steps.items()])

    def shown(value: Column, guard: Column | None = None) -> Column:
        if preset == SERVE:
            return F.coalesce(value, F.lit(0.0))
        return value if guard is None else F.when(guard == window, value)

    derived = []
    for s, d in steps.items():
        n = F.count(values(s)).over(full)
        derived += [
            shown(F.avg(values(s)).over(full), n).alias(s + MEAN),
            shown(F.stddev_samp(values(s)).over(full), n).alias(s + VOLATILITY),
            shown(F.col(d)).alias(s + DELTA),
            shown(F.avg(d).over(delta_rows), F.count(d).over(delta_rows)).alias(s + ROLLING_DELTA),
        ]
    return stepped.select("*", *derived).drop(*steps.values())


def rolling_features(
    df: DataFrame, sensors: Sequence[str], series: Series, window: int = 5, preset: str = SERVE
) -> DataFrame:
    """Add the four derived columns of every sensor, in one shuffle and sort."""
    if preset not in (TRAIN, SERVE):
        raise ValueError(f"preset must be {TRAIN!r} or {SERVE!r}, not {preset!r}")
    if window < 2:
        raise ValueError("window must be at least 2")
    return drop_slices(
        with_lookback(
            df, series, lookback_rows(window, preset), lambda t, w: add_features(t, w, sensors, window, preset)
        )
    )
