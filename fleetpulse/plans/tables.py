"""How the test tables are read as sensor tables, and the fixed models scored on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AlertConfig, Series
from ..functions.linear import LinearModel
from ..operators.features import feature_names

EVENT_SENSORS = ("value", "k")
EVENT_SERIES = Series(("user_id",), "ts", ("event_id",))
# the whole table as one series, cut into slices from a few thousand rows on
ONE_SERIES = Series((), "ts", ("event_id",), hot_rows=4_000)

LINE_SENSORS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_SERIES = Series(("l_suppkey",), "l_shipdate", ("l_orderkey", "l_linenumber", "l_partkey"))

CONFIG = AlertConfig()


def _model(name: str, intercept: float, weights: dict[str, tuple[float, float, float]]) -> LinearModel:
    features = tuple(feature_names(EVENT_SENSORS))
    chosen = [weights.get(f, (0.0, 0.0, 1.0)) for f in features]
    return LinearModel(name, features, *(tuple(w[i] for w in chosen) for i in range(3)), intercept)


# (coefficient, center, scale)
RISK_MODEL = _model(
    "risk",
    -1.1,
    {
        "value": (0.9, 35.0, 55.0),
        "value_Rolling_Mean": (1.6, 45.0, 30.0),
        "value_Volatility": (-0.5, 42.0, 35.0),
        "k_Delta": (0.35, 0.0, 45.0),
        "k_Rolling_Delta": (0.8, 0.0, 18.0),
    },
)
MODE_MODELS = (
    _model("SURGE", -0.4, {"value": (1.3, 35.0, 55.0), "value_Delta": (0.6, 0.0, 60.0)}),
    _model("DRIFT", -0.2, {"value_Rolling_Mean": (1.1, 45.0, 30.0), "k_Rolling_Delta": (-0.4, 0.0, 18.0)}),
    _model("SHAKE", -0.6, {"value_Volatility": (1.2, 42.0, 35.0), "k": (0.5, 50.0, 50.0)}),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the second sensor taken from the JSON column, and the labels."""
    raw = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return raw.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        k.alias("k"),
        (F.col("event_type") == "error").cast("long").alias("failure"),
    )


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem")
    return raw.select(
        *LINE_SERIES.keys,
        "l_shipdate",
        *LINE_SERIES.tiebreak,
        *LINE_SENSORS,
        (F.col("l_returnflag") == "R").cast("long").alias("returned"),
        (F.col("l_linestatus") == "F").cast("long").alias("closed"),
        (F.col("l_discount") >= 0.05).cast("long").alias("discounted"),
    )


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id",
        (F.col("n_chars") / 1000.0).alias("score"),
        F.col("quality").cast("long").alias("quality"),
        F.col("toxic").cast("long").alias("toxic"),
    )
