import math
import statistics

import pytest
from pyspark.sql import functions as F

from fleetpulse.config import MACHINE_SENSORS, LabelSpec, Series
from fleetpulse.functions.columns import c, linspace, logspace, nan_to_null
from fleetpulse.operators import rows
from fleetpulse.operators.features import TRAIN, feature_names, rolling_features
from fleetpulse.sources.sensors import MACHINE_SCHEMA, inline_readings

# The published replay readings.
REPLAY = [
    [300.1, 310.2, 1500, 40.0, 100],
    [300.4, 310.5, 1500, 40.2, 102],
    [301.2, 311.0, 1500, 40.5, 104],
    [302.5, 312.1, 1500, 41.0, 106],
    [303.8, 313.4, 1500, 41.5, 108],
    [304.9, 314.5, 1500, 42.0, 110],
    [305.5, 315.2, 1500, 42.5, 112],
    [306.1, 315.8, 1500, 43.0, 114],
    [308.5, 318.0, 1500, 45.0, 116],
    [312.0, 322.0, 1000, 65.0, 120],
]
# End of fixed values.
TORQUE = "Torque [Nm]"


@pytest.fixture(scope="module")
def replay(spark):
    return inline_readings(spark, REPLAY, MACHINE_SENSORS)


def test_serving_features_of_the_replay(replay):
    out = rolling_features(replay, MACHINE_SENSORS, Series((), "step")).orderBy("step").collect()
    assert len(out[0]) == 1 + 25
    torque = [[r[TORQUE + s] for s in ("_Rolling_Mean", "_Volatility", "_Delta", "_Rolling_Delta")] for r in out]
    assert torque[0] == [40.0, 0.0, 0.0, 0.0]
    assert torque[1] == pytest.approx([40.1, 0.141421, 0.2, 0.2], abs=1e-6)
    assert torque[9][0] == pytest.approx(47.5)
    assert torque[9][2:] == pytest.approx([20.0, 5.75])


def test_training_features_need_full_windows(replay):
    out = rolling_features(replay, [TORQUE], Series((), "step"), preset=TRAIN).orderBy("step").collect()
    x = [r[3] for r in REPLAY]
    assert [r[TORQUE + "_Rolling_Mean"] is None for r in out] == [True] * 4 + [False] * 6
    assert [r[TORQUE + "_Rolling_Delta"] is None for r in out] == [True] * 5 + [False] * 5
    assert out[9][TORQUE + "_Volatility"] == pytest.approx(statistics.stdev(x[5:]))
    assert out[9][TORQUE + "_Rolling_Delta"] == pytest.approx((x[9] - x[4]) / 5)
    complete = rows.complete_cases(rolling_features(replay, MACHINE_SENSORS, Series((), "step"), preset=TRAIN))
    assert complete.count() == 5


def test_missing_values_short_series_and_ties(spark):
    data = [("a", 1, 1, 1.0), ("a", 2, 2, None), ("a", 2, 1, float("nan")), ("a", 3, 1, 4.0), ("b", 1, 1, 7.0)]
    df = nan_to_null(spark.createDataFrame(data, "k string, t int, id int, x double"))
    out = {(r["k"], r["t"], r["id"]): r for r in rolling_features(df, ["x"], Series(("k",), "t", ("id",))).collect()}
    assert out["a", 3, 1]["x_Rolling_Mean"] == 2.5
    assert out["a", 3, 1]["x_Delta"] == 0.0
    assert out["b", 1, 1]["x_Volatility"] == 0.0
    train = rolling_features(df, ["x"], Series(("k",), "t", ("id",)), preset=TRAIN)
    assert train.where(F.col("x_Rolling_Mean").isNotNull()).count() == 0
    assert rolling_features(df.where("false"), ["x"], Series(("k",), "t", ("id",))).count() == 0


def test_one_exchange_and_one_sort(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    out = rolling_features(df, ["value"], Series(("user_id",), "ts", ("event_id",)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort") == 1
    assert "props" not in out.select("event_id", "value_Rolling_Mean")._jdf.queryExecution().executedPlan().toString()


def test_sensor_discovery_and_leakage(spark):
    empty = spark.createDataFrame([], MACHINE_SCHEMA)
    labels = LabelSpec("Machine failure", ("TWF", "HDF", "PWF", "OSF"), ("RNF", "UDI", "Product ID", "Type"))
    assert rows.discover_sensors(empty, labels) == list(MACHINE_SENSORS)
    built = rolling_features(empty, MACHINE_SENSORS, Series((), "UDI"))
    assert rows.discover_sensors(built, labels) == list(MACHINE_SENSORS)
    assert rows.feature_columns(built, labels) == feature_names(MACHINE_SENSORS)
    # a raw sensor whose name merely contains a suffix stays a sensor
    named = empty.withColumn("Oil_Delta_P", F.lit(1.0))
    assert "Oil_Delta_P" in rows.discover_sensors(named, labels)
    with pytest.raises(rows.SchemaMismatch, match="HDF"):
        rows.check_no_leakage([*MACHINE_SENSORS, "HDF"], labels)
    with pytest.raises(rows.SchemaMismatch, match="not numeric"):
        rows.feature_columns(empty, LabelSpec("Machine failure"))
    with pytest.raises(rows.SchemaMismatch, match="missing features"):
        rows.model_inputs(empty, ["Torque [Nm]_Delta"])


def test_names_with_dots_and_backticks(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0)], "t int, x double").withColumnRenamed("x", "a.b`c [d]")
    out = rolling_features(df, ["a.b`c [d]"], Series((), "t")).orderBy("t").collect()
    assert out[1]["a.b`c [d]_Delta"] == 2.0
    filled = rows.fill_missing(df.withColumn("a.b`c [d]", F.lit(None).cast("double")), ["a.b`c [d]"])
    assert filled.where(c("a.b`c [d]") == 0).count() == 2


def test_grids():
    assert linspace(0.1, 1, 10)[0] == 0.1 and linspace(0.1, 1, 10)[-1] == 1.0
    assert logspace(-2, 2, 20)[-1] == pytest.approx(100.0)
    assert math.isclose(logspace(-5, 7, 50)[1], 1.757510624854793e-05)
