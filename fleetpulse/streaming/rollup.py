"""Event-time roll-ups of the alert timeline: tumbling windows, sessions, and failures that follow alerts.

Every function takes a stream or a batch. On a stream the event-time watermark, `delay` behind
the newest time seen, closes windows and drops join state; append mode gives each result once, when it is
final. On a batch the same plan gives all results at once. Sums are combined before the shuffle,
so a hot series moves one row per task and window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CRITICAL, HEALTHY, WARNING, Series
from ..functions.columns import c, cols
from ..operators.alerts import LEVEL


def _first() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def _marked(df: DataFrame, order: str, delay: str) -> DataFrame:
    """The table with the watermark of a stream, which needs times with a zone: local times are taken as UTC."""
    if not df.isStreaming:
        return df
    if isinstance(df.schema[order].dataType, T.TimestampNTZType):
        micros = (c(order) - _first()).cast("interval second").cast("decimal(20,6)") * 1_000_000
        df = df.withColumn(order, F.timestamp_micros(micros.cast("long")))
    return df.withWatermark(order, delay)


def _as_given(found: DataFrame, names: Sequence[str], given: DataFrame, order: str) -> DataFrame:
    """Times in the type of the given order column, in whatever zone the session is."""
    kind = given.schema[order].dataType
    if not isinstance(kind, T.TimestampNTZType):
        return found
    for n in names:
        if not isinstance(found.schema[n].dataType, T.TimestampNTZType):
            seconds = F.unix_micros(n).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
            interval = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
            found = found.withColumn(n, _first() + interval)
    return found


def _health() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("readings"),
        F.count_if(F.col(LEVEL) == WARNING).alias("warnings"),
        F.count_if(F.col(LEVEL) == CRITICAL).alias("criticals"),
        F.max("risk_prob").alias("peak_risk"),
        F.max("streak").alias("longest_streak"),
    ]


def _spans(found: DataFrame, timeline: DataFrame, series: Series) -> DataFrame:
    health = [n for n in found.columns if n not in (*series.keys, "at")]
    found = found.select(*cols(series.keys), F.col("at.start").alias("start"), F.col("at.end").alias("end"), *health)
    return _as_given(found, ["start", "end"], timeline, series.order)


def health_rollup(timeline: DataFrame, series: Series, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Health of every series in tumbling windows of `width`: (keys, start, end, readings, ...)."""
    grouped = _marked(timeline, series.order, delay).groupBy(*cols(series.keys), F.window(c(series.order), width).alias("at"))
    return _spans(grouped.agg(*_health()), timeline, series)


def sessions(timeline: DataFrame, series: Series, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Stretches of readings of a series without a pause of `gap`: (keys, start, end, readings, ...).

    `end` is the time at which the session counts as over, `gap` after its last reading.
    """
    grouped = _marked(timeline, series.order, delay).groupBy(*cols(series.keys), F.session_window(c(series.order), gap).alias("at"))
    return _spans(grouped.agg(*_health()), timeline, series)


def lead_times(
    timeline: DataFrame, failures: DataFrame, series: Series, within: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """(keys, alert, alert_level, failure, lead_seconds): every failure of a series up to `within` after an alert.

    `failures` has the keys and the order column. Both sides keep state only as long as the other may still
    bring a partner.
    """
    alerts = _marked(timeline, series.order, delay).where(F.col(LEVEL) != HEALTHY)
    alerts = alerts.select(*[c(k).alias(f"__{k}") for k in series.keys], c(series.order).alias("alert"), LEVEL)
    found = _marked(failures, series.order, delay).select(*cols(series.keys), c(series.order).alias("failure"))
    same = F.lit(True)
    for k in series.keys:
        same &= c(f"__{k}") == c(k)
    near = (F.col("failure") >= F.col("alert")) & (F.col("failure") <= F.col("alert") + F.expr(f"INTERVAL {within}"))
    joined = _as_given(alerts.join(found, same & near), ["alert", "failure"], timeline, series.order)
    lead = (F.col("failure") - F.col("alert")).cast("interval second").cast("decimal(20,6)").cast("double")
    return joined.select(*cols(series.keys), "alert", LEVEL, "failure", lead.alias("lead_seconds"))
