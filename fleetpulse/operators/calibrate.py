"""Choosing the alert sensitivities, over the whole parameter grid in one pass.

The diagnosis sensitivity never changes the alert level, and the risk does not
depend on either sensitivity, so rows are scored once. Up to the first alert of a
series the streak is just the number of rows in the warning zone, so a row raises
the first alert for zone z when its smoothed risk is critical or overriding, or when
the lowest smoothed risk of the last `persistence` rows reaches z. Each row therefore
has one highest zone it alerts for, and the first alert steps of all zones are
conditional minima of one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..config import AlertConfig, Series
from ..functions.columns import cols, linspace
from ..functions.linear import LinearModel
from .alerts import SMOOTH, scored_series
from .features import SERVE
from .series import decided, drop_slices, row_index, with_lookback

# The published grid, ten even steps for both sensitivities.
WARNING_GRID = tuple(linspace(0.1, 1.0, 10))
DIAGNOSIS_GRID = tuple(linspace(0.1, 1.0, 10))
# End of fixed values.

REACH, AT = "__reach", "__at_step"


def _reach(w: WindowSpec, config: AlertConfig) -> Column:
    """Highest warning zone for which this row would raise a first alert."""
    rows = max(config.persistence, 1)
    frame = w.rowsBetween(-(rows - 1), 0)
    lowest = F.when(F.count(SMOOTH).over(frame) == rows, F.min(SMOOTH).over(frame))
    strong = min(config.critical_threshold, config.override_level)
    return F.when(F.col(SMOOTH) >= strong, F.lit(float("inf"))).otherwise(lowest)


def first_alerts_of_scored(
    df: DataFrame, series: Series, config: AlertConfig, warning: Sequence[float] = WARNING_GRID
) -> DataFrame:
    """First step with an alert per series and warning sensitivity, from smoothed risks."""
    df, series = decided(df, series)
    reached = with_lookback(
        df, series, max(config.persistence, 1) - 1, lambda t, w: t.withColumn(REACH, _reach(w, config))
    )
    return _first_steps(reached, series, config, warning)


def _first_steps(reached: DataFrame, series: Series, config: AlertConfig, warning: Sequence[float]) -> DataFrame:
    stepped = drop_slices(row_index(reached, series, AT))
    first = stepped.groupBy(*cols(series.keys)).agg(
        *[
            F.min(F.when(F.col(REACH) >= replace(config, warning_sensitivity=s).warning_zone, F.col(AT))).alias(f"__s{i}")
            for i, s in enumerate(warning)
        ]
    )
    return first.select(
        *cols(series.keys),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(float(s)).alias("warning_sensitivity"), F.col(f"__s{i}").alias("first_step"))
                    for i, s in enumerate(warning)
                ]
            )
        ),
    )


def first_alerts(
    df: DataFrame,
    sensors: Sequence[str],
    series: Series,
    risk: LinearModel,
    config: AlertConfig = AlertConfig(),
    warning: Sequence[float] = WARNING_GRID,
    window: int = 5,
    preset: str = SERVE,
) -> DataFrame:
    """The same from raw readings: one shuffle for features, smoothing and all zones."""
    used = dict.fromkeys([*series.keys, series.order, *series.tiebreak, *sensors])
    df, series = decided(df.select(*cols(used)), series)
    reached = scored_series(
        df,
        sensors,
        series,
        risk,
        config,
        window,
        preset,
        extra_rows=max(config.persistence, 1) - 1,
        then=lambda t, w: t.withColumn(REACH, _reach(w, config)),
    )
    return _first_steps(reached, series, config, warning)


def grid_scores(
    first: DataFrame, series: Series, target_step: int = 4, diagnosis: Sequence[float] = DIAGNOSIS_GRID
) -> DataFrame:
    """Score of every combination, averaged over the series: 1 at the target step, 0 without alert."""
    score = F.coalesce(
        F.lit(1.0) / (F.abs(F.lit(target_step) - F.col("first_step")) + 1), F.lit(0.0)
    )
    per_warning = first.groupBy("warning_sensitivity").agg(F.avg(score).alias("score"))
    return per_warning.select(
        "warning_sensitivity",
        F.explode(F.array(*[F.lit(float(d)) for d in diagnosis])).alias("diagnosis_sensitivity"),
        "score",
    )


def best_combination(scores: DataFrame) -> DataFrame:
    """Highest score; the smallest sensitivities win ties, whatever the summation order."""
    return scores.orderBy(F.round("score", 9).desc(), "warning_sensitivity", "diagnosis_sensitivity").limit(1)


def calibrated(config: AlertConfig, best: DataFrame) -> AlertConfig:
    """Apply the chosen combination to the settings (reads one row)."""
    row = best.first()
    if row is None:
        return config
    return replace(
        config,
        warning_sensitivity=row["warning_sensitivity"],
        diagnosis_sensitivity=row["diagnosis_sensitivity"],
    )
