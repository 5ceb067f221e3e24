from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fleetpulse.config import AlertConfig, Series
from fleetpulse.functions.linear import LinearModel, coefficient_table, models_from_table
from fleetpulse.operators import alerts, calibrate
from fleetpulse.operators.series import row_index
from fleetpulse.plans.tables import EVENT_SENSORS, EVENT_SERIES, MODE_MODELS, RISK_MODEL, events

# The published smoothed risks and what they lead to.
SMOOTH = [0.0429, 0.1713, 0.3660, 0.6810, 0.9139, 0.9953, 0.9990, 0.9983, 0.9985, 0.9988]
STREAKS = [0, 0, 1, 3, 4, 5, 6, 7, 8, 9]
LEVELS = ["HEALTHY"] * 3 + ["WARNING"] + ["CRITICAL"] * 6
# End of fixed values.
ONE = Series((), "step")


def loop(smooth, config):
    """The decision rules as a loop over one series."""
    streak, out = 0, []
    for s in smooth:
        streak = streak + 1 if s >= config.warning_zone else 0
        if s >= config.critical_threshold:
            level = "CRITICAL"
        elif s >= config.override_level:
            level, streak = "WARNING", max(streak, config.persistence)
        elif s >= config.warning_zone and streak >= config.persistence:
            level = "WARNING"
        else:
            level = "HEALTHY"
        out.append((streak, level))
    return out


def smoothed_table(spark, values):
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "step int, smooth double")


def decided(df, series, config):
    out = alerts.warning_streaks(df, series, config)
    return out.withColumn("alert_level", alerts.alert_level(config))


def test_published_timeline(spark):
    config = AlertConfig(warning_sensitivity=0.3)
    out = decided(smoothed_table(spark, SMOOTH), ONE, config).orderBy("step").collect()
    assert [r["streak"] for r in out] == STREAKS
    assert [r["alert_level"] for r in out] == LEVELS


def test_published_calibration(spark):
    first = calibrate.first_alerts_of_scored(smoothed_table(spark, SMOOTH), ONE, AlertConfig())
    steps = {round(r["warning_sensitivity"], 2): r["first_step"] for r in first.collect()}
    assert steps == {round(w, 2): 4 for w in calibrate.WARNING_GRID}
    scores = calibrate.grid_scores(first, ONE, target_step=4)
    assert scores.count() == 100
    config = calibrate.calibrated(AlertConfig(), calibrate.best_combination(scores))
    assert (config.warning_sensitivity, config.diagnosis_sensitivity) == (0.1, 0.1)


@pytest.mark.parametrize(
    "config",
    [
        AlertConfig(),
        AlertConfig(warning_sensitivity=0.2, persistence=5),
        AlertConfig(critical_threshold=0.5),
        AlertConfig(critical_threshold=0.9, warning_sensitivity=0.8, persistence=1),
    ],
)
def test_levels_and_first_alerts_equal_the_loop(spark, sf, config):
    smooth = events(spark, sf).select("user_id", "ts", "event_id", (F.pmod("k", F.lit(41)) / 41).alias("smooth"))
    out = row_index(decided(smooth, EVENT_SERIES, config), EVENT_SERIES).collect()
    series = {}
    for r in sorted(out, key=lambda r: (r["user_id"], r["step"])):
        series.setdefault(r["user_id"], []).append(r)
    for found in series.values():
        assert [(r["streak"], r["alert_level"]) for r in found] == loop([r["smooth"] for r in found], config)
    grid = (0.1, 0.5, 0.9, 1.0)
    for r in calibrate.first_alerts_of_scored(smooth, EVENT_SERIES, config, grid).collect():
        values = [x["smooth"] for x in series[r["user_id"]]]
        levels = loop(values, replace(config, warning_sensitivity=r["warning_sensitivity"]))
        expected = next((i + 1 for i, (_, level) in enumerate(levels) if level != "HEALTHY"), None)
        assert r["first_step"] == expected


def test_diagnosis_rules(spark):
    df = spark.createDataFrame(
        [(1, 0.2, 0.7, 0.7), (2, 0.39, 0.1, 0.0), (3, 0.4, 0.1, 0.4)], "i int, a double, b double, d double"
    )
    found = df.select(alerts.diagnosis([(n, F.col(n)) for n in "abd"]).alias("f")).collect()
    assert [r["f"] for r in found] == ["b", "RandomFailure", "a"]


def timeline(df, series, **settings):
    return alerts.alert_timeline(df, EVENT_SENSORS, series, RISK_MODEL, MODE_MODELS, **settings)


def as_rows(df):
    return sorted((r["event_id"], r["step"], round(r["risk_prob"], 4), r["alert_level"], r["failure_type"], r["streak"],
                   tuple(sorted(r["details"].items()))) for r in df.collect())


def test_timeline_does_not_depend_on_partitions_or_slices(spark, sf):
    df = events(spark, sf)
    expected = as_rows(timeline(df, EVENT_SERIES))
    assert as_rows(timeline(df.repartition(7), EVENT_SERIES)) == expected
    assert as_rows(timeline(df, replace(EVENT_SERIES, hot_rows=60))) == expected


def test_timeline_record(spark, sf):
    out = timeline(events(spark, sf), EVENT_SERIES)
    assert dict(out.dtypes)["details"] == "map<string,double>"
    assert out.where("(alert_level = 'HEALTHY') != (failure_type IS NULL)").count() == 0
    listing = alerts.prediction_listing(out, EVENT_SERIES)
    assert listing.columns == ["user_id", "step", "risk_prob", "alert_level", "failure_type"]


def test_logit_smoothing(spark):
    # published probabilities and the mean log-odds shown for them
    df = spark.createDataFrame([(1, 0.0405), (2, 0.3955), (3, 0.8127)], "step int, risk double")
    out = alerts.smooth_risk(df, ONE, config=AlertConfig(smoothing="logit"))
    shown = out.orderBy("step").select(F.ln(F.col("smooth") / (1 - F.col("smooth"))).alias("z")).collect()
    assert [round(r["z"], 2) for r in shown] == [-3.17, -1.79, -0.71]
    edge = spark.createDataFrame([(1, 0.0), (2, 1.0)], "step int, risk double")
    assert alerts.smooth_risk(edge, ONE, config=AlertConfig(smoothing="logit")).where("smooth between 0 and 1").count() == 2


def test_coefficient_table_round_trip(spark):
    models = [RISK_MODEL, *MODE_MODELS]
    assert sorted(models_from_table(coefficient_table(spark, models)), key=lambda m: m.name) == sorted(
        models, key=lambda m: m.name
    )
    constant = LinearModel("none", ("x",), (0.0,), (0.0,), (1.0,), 0.0)
    assert spark.range(1).select(constant.probability().alias("p")).first()["p"] == 0.5


def test_episodes(spark):
    levels = ["WARNING", "HEALTHY", "WARNING", "CRITICAL", "CRITICAL", "HEALTHY", "HEALTHY", "WARNING"]
    risks = [0.6, 0.1, 0.6, 0.9, 0.9, 0.2, 0.1, 0.7]
    rows = [(k, 10 + i, i + 1, r, x, f"m{i}" if x != "HEALTHY" else None) for k in ("a", "b") for i, (x, r) in enumerate(zip(levels, risks))]
    df = spark.createDataFrame(rows, "`the key` string, t int, step long, risk_prob double, alert_level string, failure_type string")
    want = [(1, 1, 10, 10, 1, 0.6, "WARNING", "m0"), (3, 5, 12, 14, 3, 0.9, "CRITICAL", "m3"), (8, 8, 17, 17, 1, 0.7, "WARNING", "m7")]
    for hot in (None, 2, 1):
        series = Series(("the key",), "t", hot_rows=hot)
        got = alerts.alert_episodes(df, series).orderBy("the key", "first_step").collect()
        assert [tuple(r) for r in got] == [(k, *w) for k in ("a", "b") for w in want]
    one = df.where("`the key` = 'a'").drop("the key")
    assert [tuple(r) for r in alerts.alert_episodes(one, Series((), "t", hot_rows=3)).orderBy("first_step").collect()] == want
    assert alerts.alert_episodes(df.where("step < 0"), Series(("the key",), "t")).count() == 0
    assert alerts.alert_episodes(df.where("alert_level = 'HEALTHY'"), Series(("the key",), "t", hot_rows=2)).count() == 0
