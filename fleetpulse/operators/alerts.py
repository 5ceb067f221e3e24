"""From risk scores to smoothed HEALTHY / WARNING / CRITICAL timelines with a diagnosis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..config import CRITICAL, HEALTHY, UNKNOWN_MODE, WARNING, AlertConfig, Series
from ..functions.columns import c, cols, logit, sigmoid
from ..functions.linear import LinearModel
from .features import SERVE, add_features, feature_names, lookback_rows
from .series import decided, drop_slices, running_sums, streaks, with_lookback

RISK, SMOOTH, STREAK, LEVEL, STEP = "risk", "smooth", "streak", "alert_level", "step"


def smoothed(risk: Column, w: WindowSpec, config: AlertConfig) -> Column:
    """Mean of the last few risks, as probabilities or in log-odds space; NaN risks are left out."""
    risk = F.when(~F.isnan(risk), risk)
    frame = w.rowsBetween(-(config.smoothing_rows - 1), 0)
    if config.smoothing == "mean":
        return F.avg(risk).over(frame)
    if config.smoothing == "logit":
        inside = F.greatest(F.least(risk, F.lit(1.0 - 1e-15)), F.lit(1e-15))
        return sigmoid(F.avg(logit(inside)).over(frame))
    raise ValueError(f"unknown smoothing {config.smoothing!r}")


def smooth_risk(df: DataFrame, series: Series, risk: str = RISK, config: AlertConfig = AlertConfig()) -> DataFrame:
    """Add the smoothed risk to already scored rows."""
    return with_lookback(
        df, series, config.smoothing_rows - 1, lambda t, w: t.withColumn(SMOOTH, smoothed(c(risk), w, config))
    )


def warning_streaks(
    df: DataFrame, series: Series, config: AlertConfig = AlertConfig(), step: str | None = None
) -> DataFrame:
    """Count rows in the warning zone; a strong risk lifts the count to the persistence."""
    smooth = F.col(SMOOTH)
    lifted = (smooth < config.critical_threshold) & (smooth >= config.override_level)
    return streaks(
        df, series, smooth < F.lit(config.warning_zone), F.when(lifted, F.lit(config.persistence)), STREAK, step
    )


def alert_level(config: AlertConfig = AlertConfig()) -> Column:
    smooth = F.col(SMOOTH)
    return (
        F.when(smooth >= config.critical_threshold, CRITICAL)
        .when(smooth >= config.override_level, WARNING)
        .when((smooth >= config.warning_zone) & (F.col(STREAK) >= config.persistence), WARNING)
        .otherwise(HEALTHY)
    )


def diagnosis(details: Sequence[tuple[str, Column]], config: AlertConfig = AlertConfig()) -> Column:
    """Most likely mode (first one on ties), or a random failure when none is likely."""
    best = F.greatest(*[p for _, p in details]) if len(details) > 1 else details[0][1]
    chosen = F.lit(None).cast("string")
    for name, p in reversed(details):
        chosen = F.when(p == best, name).otherwise(chosen)
    return F.when(best >= config.diagnosis_sensitivity, chosen).otherwise(UNKNOWN_MODE)


def prediction_record(
    df: DataFrame, modes: Sequence[LinearModel], config: AlertConfig = AlertConfig(), keep: Sequence[str] = ()
) -> DataFrame:
    """risk_prob, alert_level, failure_type, streak and details for every row."""
    scored = df.select(
        *cols(dict.fromkeys([*keep, SMOOTH, STREAK])),
        *[F.round(m.probability(), 4).alias(f"__p{i}") for i, m in enumerate(modes)],
        alert_level(config).alias(LEVEL),
    )
    details = [(m.name, F.col(f"__p{i}")) for i, m in enumerate(modes)]
    failure = diagnosis(details, config) if details else F.lit(UNKNOWN_MODE)
    pairs = [x for name, p in details for x in (F.lit(name), p)]
    return scored.select(
        *cols(keep),
        F.round(SMOOTH, 4).alias("risk_prob"),
        LEVEL,
        F.when(F.col(LEVEL) != HEALTHY, failure).alias("failure_type"),
        STREAK,
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")).alias("details"),
    )


def scored_series(
    df: DataFrame,
    sensors: Sequence[str],
    series: Series,
    risk: LinearModel,
    config: AlertConfig = AlertConfig(),
    window: int = 5,
    preset: str = SERVE,
    extra_rows: int = 0,
    then=None,
) -> DataFrame:
    """Features, risk and smoothed risk in one pass over each series.

    `then(table, window)` may add more columns that look back `extra_rows` further.
    """

    def add(t: DataFrame, w: WindowSpec) -> DataFrame:
        t = add_features(t, w, sensors, window, preset)
        t = t.withColumn(RISK, risk.probability())
        t = t.withColumn(SMOOTH, smoothed(F.col(RISK), w, config))
        return then(t, w) if then else t

    rows = lookback_rows(window, preset) + config.smoothing_rows - 1 + extra_rows
    return with_lookback(df, series, rows, add)


def alert_timeline(
    df: DataFrame,
    sensors: Sequence[str],
    series: Series,
    risk: LinearModel,
    modes: Sequence[LinearModel],
    config: AlertConfig = AlertConfig(),
    window: int = 5,
    preset: str = SERVE,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Replay whole series: one prediction record per reading, with its step number.

    Every reading is scored; one shuffle by series serves features, smoothing,
    streak and step number.
    """
    wanted = dict.fromkeys([*series.keys, series.order, *series.tiebreak, *keep, *sensors])
    df, series = decided(df.select(*cols(wanted)), series)
    scored = scored_series(df, sensors, series, risk, config, window, preset)
    counted = warning_streaks(scored, series, config, STEP)
    shown = list(dict.fromkeys([*series.keys, series.order, *series.tiebreak, *keep, STEP]))
    used = dict.fromkeys([*shown, *feature_names(sensors), SMOOTH, STREAK])
    return prediction_record(drop_slices(counted).select(*cols(used)), modes, config, shown)


def prediction_listing(timeline: DataFrame, series: Series) -> DataFrame:
    """The short listing: step, risk, alert and diagnosis per reading."""
    return timeline.select(*cols(series.keys), STEP, "risk_prob", LEVEL, "failure_type")


def alert_episodes(timeline: DataFrame, series: Series) -> DataFrame:
    """Unbroken stretches of alerts of a series: (keys, first_step, last_step, start, end, readings, peak_risk,
    worst_level, failure_type).

    Along an episode the step grows as the running count of alerts does, so their difference names
    it; the count crosses slice borders of a hot series. `failure_type` is the diagnosis at the
    peak, the earliest one of several. A key's episodes are combined before the shuffle.
    """
    alerting = F.col(LEVEL) != HEALTHY
    counted = drop_slices(running_sums(timeline, series, {"__alerts": alerting.cast("long")}))
    marked = counted.where(alerting).withColumn("__episode", F.col(STEP) - F.col("__alerts"))
    found = marked.groupBy(*cols(series.keys), "__episode").agg(
        F.min(STEP).alias("first_step"),
        F.max(STEP).alias("last_step"),
        F.min(c(series.order)).alias("start"),
        F.max(c(series.order)).alias("end"),
        F.count(F.lit(1)).alias("readings"),
        F.max("risk_prob").alias("peak_risk"),
        F.max(F.when(F.col(LEVEL) == CRITICAL, CRITICAL).otherwise(F.lit(None))).alias("__critical"),
        F.max_by("failure_type", F.struct("risk_prob", -F.col(STEP))).alias("failure_type"),
    )
    worst = F.coalesce("__critical", F.lit(WARNING)).alias("worst_level")
    return found.select(*cols(series.keys), "first_step", "last_step", "start", "end", "readings", "peak_risk", worst, "failure_type")
