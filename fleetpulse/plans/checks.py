"""Every operator run over the test tables, with its SQL counterpart.

`QUERIES` maps a name to a callable (spark, sf_dir) -> DataFrame; `SQL` maps the same
names to SQL where the result can be written in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LabelSpec, Series
from ..functions.columns import c, cols, rounded
from ..functions.linear import coefficient_table, models_from_table
from ..operators import alerts, calibrate, evaluate, profile, quantiles, rows, split
from ..operators.features import SERVE, TRAIN, feature_names, rolling_features
from ..operators.series import decided, drop_slices, row_index
from ..sources import models
from ..sources.sensors import inline_readings, read_sensor_table, scratch_path, snapshot_once, write_feature_table
from ..streaming import monitor, rollup
from . import sqltext as q
from . import training
from .tables import (
    CONFIG,
    EVENT_SENSORS,
    EVENT_SERIES,
    LINE_SENSORS,
    LINE_SERIES,
    MODE_MODELS,
    ONE_SERIES,
    RISK_MODEL,
    document_labels,
    events,
    lineitem,
    table,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EVENT_KEYS = ["event_id", "user_id"]
LINE_KEYS = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"]
FEATURES = feature_names(EVENT_SENSORS)


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def shown(df: DataFrame, keys: Sequence[str], values: Sequence[str], digits: int = 6) -> DataFrame:
    return df.select(*cols(keys), *[rounded(c(v), digits).alias(v) for v in values])


def shown_sql(keys: Sequence[str], values: Sequence[str], source: str, digits: int = 6) -> str:
    rounded_values = [f'{q.rnd(chr(34) + v + chr(34), digits)} AS "{v}"' for v in values]
    return f"SELECT {', '.join([*keys, *rounded_values])} FROM {source}"


EVENT_FEATURES = q.features("ev", ["user_id"], ["ts", "event_id"], list(EVENT_SENSORS), "serve")
SCORED = f"""{q.EVENTS}, {EVENT_FEATURES},
sc AS (SELECT *, round({q.probability(RISK_MODEL)}, 6) AS risk FROM f)"""
EXACT_SCORED = f"""{q.EVENTS}, {EVENT_FEATURES},
sc AS (SELECT *, {q.probability(RISK_MODEL)} AS risk FROM f)"""


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_features(events(spark, sf_dir), EVENT_SENSORS, EVENT_SERIES)


def scored(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    p = RISK_MODEL.probability()
    return served(spark, sf_dir).withColumn("risk", p if exact else F.round(p, 6))


# ---- profile -------------------------------------------------------------------


def _union(parts: Sequence[str]) -> str:
    return " UNION ALL ".join(parts)


EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query(
    "profile_non_null_counts",
    _union([f"SELECT '{n}' AS \"column\", count({n}) AS \"count\" FROM events" for n in EVENT_COLUMNS]),
)
def _(spark, sf_dir):
    return profile.non_null_counts(table(spark, sf_dir, "events"))


EVENT_TYPES = ["bigint", "timestamp_ntz", "bigint", "string", "double", "string"]


@query(
    "profile_column_types",
    _union(
        [
            f"SELECT '{n}' AS \"column\", '{t}' AS dtype, count({n}) AS \"count\" FROM events"
            for n, t in zip(EVENT_COLUMNS, EVENT_TYPES)
        ]
    ),
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return profile.non_null_counts(df).join(profile.column_types(df), "column").select("column", "dtype", "count")


def _describe_sql(source: str, names: Sequence[str]) -> str:
    return _union(
        [
            f"""SELECT '{n}' AS "column", count({n}) AS "count", {q.rnd(f'avg({n})', 4)} AS mean,
            {q.rnd(f'stddev_samp({n})', 4)} AS std, min({n})::DOUBLE AS min,
            {q.rnd(f'quantile_cont({n}, 0.25)', 4)} AS p25, {q.rnd(f'quantile_cont({n}, 0.5)', 4)} AS p50,
            {q.rnd(f'quantile_cont({n}, 0.75)', 4)} AS p75, max({n})::DOUBLE AS max FROM {source}"""
            for n in names
        ]
    )


def _describe_shown(df: DataFrame) -> DataFrame:
    return df.select(
        "column", "count", *[rounded(c(n), 4).alias(n) for n in ("mean", "std")], "min",
        *[rounded(c(n), 4).alias(n) for n in ("p25", "p50", "p75")], "max",
    )


@query("profile_describe", _describe_sql("lineitem", LINE_SENSORS))
def _(spark, sf_dir):
    return _describe_shown(profile.describe(table(spark, sf_dir, "lineitem"), LINE_SENSORS))


@query("profile_describe_events", f"WITH {q.EVENTS} " + _describe_sql("ev", ["event_id", "user_id", "value", "k", "failure"]))
def _(spark, sf_dir):
    return _describe_shown(profile.describe(events(spark, sf_dir)))


@query("profile_describe_approx")
def _(spark, sf_dir):
    return profile.describe(table(spark, sf_dir, "lineitem"), LINE_SENSORS, approx=True)


WARMUP = ["value_Rolling_Mean", "value_Volatility", "value_Delta", "value_Rolling_Delta"]
TRAIN_EVENTS = q.features("ev", ["user_id"], ["ts", "event_id"], list(EVENT_SENSORS), "train")


def trained(spark, sf_dir):
    return rolling_features(events(spark, sf_dir), EVENT_SENSORS, EVENT_SERIES, preset=TRAIN)


@query(
    "profile_missing_fractions",
    f"WITH {q.EVENTS}, {TRAIN_EVENTS} "
    + _union(
        [
            f"SELECT '{n}' AS \"column\", {q.rnd(f'avg(CASE WHEN {chr(34)}{n}{chr(34)} IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing FROM f"
            for n in ["event_id", *FEATURES]
        ]
    ),
)
def _(spark, sf_dir):
    df = trained(spark, sf_dir).select("event_id", *FEATURES)
    return profile.missing_fractions(df).select("column", rounded(c("missing"), 6).alias("missing"))


@query(
    "profile_class_frequency",
    "SELECT event_type AS class, count(*) AS \"count\" FROM events GROUP BY event_type",
)
def _(spark, sf_dir):
    return profile.class_frequency(table(spark, sf_dir, "events"), "event_type")


@query("profile_shape", 'SELECT count(*) AS "rows", CAST(11 AS BIGINT) AS "columns" FROM lineitem')
def _(spark, sf_dir):
    return profile.shape(table(spark, sf_dir, "lineitem"))


@query(
    "profile_imbalance",
    f"""WITH {q.EVENTS} SELECT count(*) FILTER (failure = 0) AS negatives, count(*) FILTER (failure = 1) AS positives,
    {q.rnd('count(*) FILTER (failure = 0) / CAST(count(*) FILTER (failure = 1) AS DOUBLE)')} AS ratio FROM ev""",
)
def _(spark, sf_dir):
    return profile.imbalance(events(spark, sf_dir), "failure").withColumn("ratio", rounded(c("ratio"), 6))


# ---- rows and columns ----------------------------------------------------------


@query("filter_failures", f"WITH {q.EVENTS} SELECT event_id, user_id, value, k FROM ev WHERE failure = 1")
def _(spark, sf_dir):
    df = rows.failures_only(events(spark, sf_dir), "failure")
    return rows.drop_columns(df, ["failure", "event_type", "ts", "failure"])


@query("cast_label", "SELECT doc_id, quality = 1 AS good, CAST(quality = 1 AS INTEGER) AS label FROM labels")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select("doc_id", (c("quality") == 1).alias("good"))
    return rows.cast_label(df.withColumn("label", c("good")), "label")


ALL_PRESENT = " AND ".join(f'"{n}" IS NOT NULL' for n in FEATURES)


@query("complete_cases", f"WITH {q.EVENTS}, {TRAIN_EVENTS} SELECT event_id, user_id FROM f WHERE {ALL_PRESENT}")
def _(spark, sf_dir):
    return rows.complete_cases(trained(spark, sf_dir), FEATURES).select(*EVENT_KEYS)


@query(
    "drop_incomplete_rows",
    f"WITH {q.EVENTS}, {TRAIN_EVENTS} SELECT event_id, {q.rnd('value_Rolling_Mean')} AS value_Rolling_Mean FROM f WHERE {ALL_PRESENT}",
)
def _(spark, sf_dir):
    return shown(rows.complete_cases(trained(spark, sf_dir)), ["event_id"], ["value_Rolling_Mean"])


@query(
    "fill_missing",
    f"WITH {q.EVENTS}, {TRAIN_EVENTS} SELECT event_id, "
    + ", ".join(f'{q.rnd(f"coalesce({n}, 0)")} AS "{n}"' for n in WARMUP)
    + " FROM f",
)
def _(spark, sf_dir):
    return shown(rows.fill_missing(trained(spark, sf_dir), WARMUP), ["event_id"], WARMUP)


@query(
    "model_inputs_in_order",
    f"WITH {q.EVENTS}, {EVENT_FEATURES} " + shown_sql(["event_id"], list(reversed(FEATURES)), "f"),
)
def _(spark, sf_dir):
    order = list(reversed(FEATURES))
    return shown(rows.model_inputs(served(spark, sf_dir), order, keep=["event_id"]), ["event_id"], order)


@query("predicted_label", f"WITH {SCORED} SELECT event_id, CAST(risk >= 0.416::DOUBLE AS INTEGER) AS predicted FROM sc")
def _(spark, sf_dir):
    return rows.predicted_label(scored(spark, sf_dir), "risk", 0.416).select("event_id", "predicted")


@query(
    "row_index_whole_table",
    "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS step FROM events",
)
def _(spark, sf_dir):
    return row_index(table(spark, sf_dir, "events").select("event_id", "ts"), ONE_SERIES).transform(drop_slices).select(
        "event_id", "step"
    )


@query(
    "step_numbers",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return row_index(df, EVENT_SERIES).select("event_id", "user_id", "step")


# ---- rolling features ----------------------------------------------------------


def _derived(sensors: Sequence[str]) -> list[str]:
    return feature_names(sensors)[len(sensors):]


@query("features_train", f"WITH {q.EVENTS}, {TRAIN_EVENTS} " + shown_sql(EVENT_KEYS, _derived(EVENT_SENSORS), "f"))
def _(spark, sf_dir):
    return shown(trained(spark, sf_dir), EVENT_KEYS, _derived(EVENT_SENSORS))


@query("features_serve", f"WITH {q.EVENTS}, {EVENT_FEATURES} " + shown_sql(EVENT_KEYS, _derived(EVENT_SENSORS), "f"))
def _(spark, sf_dir):
    return shown(served(spark, sf_dir), EVENT_KEYS, _derived(EVENT_SENSORS))


def _line_features(preset: str) -> str:
    body = q.features(
        "li", ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], list(LINE_SENSORS), preset
    )
    return f"WITH {q.LINES}, {body} " + shown_sql(LINE_KEYS, _derived(LINE_SENSORS), "f", 4)


@query("features_train_lineitem", _line_features("train"))
def _(spark, sf_dir):
    df = rolling_features(lineitem(spark, sf_dir), LINE_SENSORS, LINE_SERIES, preset=TRAIN)
    return shown(df, LINE_KEYS, _derived(LINE_SENSORS), 4)


@query("features_serve_lineitem", _line_features("serve"))
def _(spark, sf_dir):
    df = rolling_features(lineitem(spark, sf_dir), LINE_SENSORS, LINE_SERIES, preset=SERVE)
    return shown(df, LINE_KEYS, _derived(LINE_SENSORS), 4)


@query(
    "features_train_one_series",
    f"WITH {q.EVENTS}, {q.features('ev', [], ['ts', 'event_id'], list(EVENT_SENSORS), 'train')} "
    + shown_sql(["event_id"], _derived(EVENT_SENSORS), "f"),
)
def _(spark, sf_dir):
    df = rolling_features(events(spark, sf_dir), EVENT_SENSORS, ONE_SERIES, preset=TRAIN)
    return shown(df, ["event_id"], _derived(EVENT_SENSORS))


@query(
    "features_serve_one_series",
    f"WITH {q.EVENTS}, {q.features('ev', [], ['ts', 'event_id'], list(EVENT_SENSORS), 'serve')} "
    + shown_sql(["event_id"], _derived(EVENT_SENSORS), "f"),
)
def _(spark, sf_dir):
    df = rolling_features(events(spark, sf_dir), EVENT_SENSORS, ONE_SERIES, preset=SERVE)
    return shown(df, ["event_id"], _derived(EVENT_SENSORS))


# ---- scores and alerts ---------------------------------------------------------


@query("score_risk", f"WITH {EXACT_SCORED} SELECT event_id, {q.rnd('risk')} AS risk FROM sc")
def _(spark, sf_dir):
    return shown(scored(spark, sf_dir, exact=True), ["event_id"], ["risk"])


@query(
    "score_modes",
    f"WITH {q.EVENTS}, {EVENT_FEATURES} SELECT event_id, "
    + ", ".join(f"{q.rnd(q.probability(m), 4)} AS \"{m.name}\"" for m in MODE_MODELS)
    + " FROM f",
)
def _(spark, sf_dir):
    return served(spark, sf_dir).select(
        "event_id", *[rounded(m.probability(), 4).alias(m.name) for m in MODE_MODELS]
    )


@query("smooth_risk", f"WITH {EXACT_SCORED}, {q.smooth('sc', CONFIG)} SELECT event_id, {q.rnd('smooth')} AS smooth FROM sm")
def _(spark, sf_dir):
    df = alerts.smooth_risk(scored(spark, sf_dir, exact=True), EVENT_SERIES)
    return shown(df, ["event_id"], ["smooth"])


@query(
    "smooth_risk_logit",
    f"""WITH {EXACT_SCORED}, sm AS (SELECT *, avg(ln(least(greatest(risk, 1e-15), 1.0 - 1e-15) /
    (1.0 - least(greatest(risk, 1e-15), 1.0 - 1e-15)))) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS z FROM sc)
    SELECT event_id, {q.rnd('1.0 / (1.0 + exp(-z))')} AS smooth FROM sm""",
)
def _(spark, sf_dir):
    df = alerts.smooth_risk(
        scored(spark, sf_dir, exact=True), EVENT_SERIES, config=replace(CONFIG, smoothing="logit")
    )
    return shown(df, ["event_id"], ["smooth"])


@query(
    "warning_streak",
    f"WITH {EXACT_SCORED}, {q.smooth('sc', CONFIG)}, {q.streak('sm', CONFIG)} SELECT event_id, user_id, streak, {q.level(CONFIG)} AS alert_level FROM st",
)
def _(spark, sf_dir):
    df = alerts.smooth_risk(scored(spark, sf_dir, exact=True), EVENT_SERIES)
    df = alerts.warning_streaks(df, EVENT_SERIES)
    return df.select(*EVENT_KEYS, "streak", alerts.alert_level().alias("alert_level"))


ONE_CONFIG = replace(CONFIG, warning_sensitivity=0.35)


@query(
    "warning_streak_one_series",
    f"""WITH one AS (SELECT event_id, ts, 0 AS whole, value / 100.0::DOUBLE AS risk FROM events),
    {q.smooth('one', ONE_CONFIG, 'whole')}, {q.streak('sm', ONE_CONFIG, 'whole')}
    SELECT event_id, step, streak FROM st""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "ts", (c("value") / 100.0).alias("risk"))
    df, along = decided(df, ONE_SERIES)
    df = alerts.smooth_risk(df, along, config=ONE_CONFIG)
    return alerts.warning_streaks(df, along, ONE_CONFIG, "step").select("event_id", "step", "streak")


def timeline_sql(tail: str) -> str:
    ps = ", ".join(f"{q.rnd(q.probability(m), 4)} AS p{i}" for i, m in enumerate(MODE_MODELS))
    best = f"greatest({', '.join(f'p{i}' for i in range(len(MODE_MODELS)))})"
    pick = " ".join(f"WHEN p{i} = {best} THEN '{m.name}'" for i, m in enumerate(MODE_MODELS))
    return f"""WITH {EXACT_SCORED}, {q.smooth('sc', CONFIG)}, {q.streak('sm', CONFIG)},
    lv AS (SELECT *, {q.level(CONFIG)} AS alert_level, {ps} FROM st),
    tl AS (SELECT event_id, user_id, ts, step, {q.rnd('smooth', 4)} AS risk_prob, alert_level, streak,
      CASE WHEN alert_level = 'HEALTHY' THEN NULL
           WHEN {best} < {CONFIG.diagnosis_sensitivity!r}::DOUBLE THEN 'RandomFailure'
           ELSE CASE {pick} END END AS failure_type,
      {', '.join(f'p{i} AS "{m.name}"' for i, m in enumerate(MODE_MODELS))} FROM lv) {tail}"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_timeline(
        events(spark, sf_dir), EVENT_SENSORS, EVENT_SERIES, RISK_MODEL, MODE_MODELS, CONFIG
    )


TIMELINE_COLUMNS = ["event_id", "user_id", "step", "risk_prob", "alert_level", "failure_type", "streak"]


def flat(df: DataFrame) -> DataFrame:
    """The timeline with its details map spread into columns, for comparison."""
    return df.select(
        *TIMELINE_COLUMNS, *[rounded(F.col("details")[m.name], 4).alias(m.name) for m in MODE_MODELS]
    ).withColumn("risk_prob", c("risk_prob") + 0.0)


@query("alert_timeline", timeline_sql(f"SELECT {', '.join(TIMELINE_COLUMNS)}, {', '.join(m.name for m in MODE_MODELS)} FROM tl"))
def alert_timeline(spark, sf_dir):
    return flat(timeline(spark, sf_dir))


@query("prediction_listing", timeline_sql("SELECT user_id, step, risk_prob, alert_level, failure_type FROM tl"))
def _(spark, sf_dir):
    return alerts.prediction_listing(timeline(spark, sf_dir), EVENT_SERIES).withColumn("risk_prob", c("risk_prob") + 0.0)


def missing_sql(sql: str) -> str:
    """The same result where every 17th reading is missing; a missing model input counts as 0."""
    gap = "event_type, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,"
    return sql.replace("event_type, value,", gap).replace('("value" -', '(coalesce("value", 0) -')


def with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose every 17th reading is NaN."""
    value = F.when(F.col("event_id") % 17 == 0, float("nan")).otherwise(F.col("value"))
    return events(spark, sf_dir).withColumn("value", value)


@query("alert_timeline_missing", missing_sql(SQL["alert_timeline"]))
def _(spark, sf_dir):
    return flat(
        alerts.alert_timeline(with_missing(spark, sf_dir), EVENT_SENSORS, EVENT_SERIES, RISK_MODEL, MODE_MODELS, CONFIG)
    )


EPISODES_SQL = timeline_sql(""", cnt AS (
    SELECT *, sum(CASE WHEN alert_level <> 'HEALTHY' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY step) AS alerts FROM tl)
  SELECT user_id, CAST(min(step) AS BIGINT) AS first_step, CAST(max(step) AS BIGINT) AS last_step, min(ts) AS "start", max(ts) AS "end",
    count(*) AS readings, max(risk_prob) AS peak_risk,
    CASE WHEN count(*) FILTER (alert_level = 'CRITICAL') > 0 THEN 'CRITICAL' ELSE 'WARNING' END AS worst_level,
    first(failure_type ORDER BY risk_prob DESC, step) AS failure_type
  FROM cnt WHERE alert_level <> 'HEALTHY' GROUP BY user_id, step - alerts""")


def _episodes(df: DataFrame, series: Series) -> DataFrame:
    return alerts.alert_episodes(df, series).withColumn("peak_risk", c("peak_risk") + 0.0)


@query("alert_episodes", EPISODES_SQL)
def _(spark, sf_dir):
    return _episodes(timeline(spark, sf_dir), EVENT_SERIES)


@query("alert_episodes_sliced", EPISODES_SQL)
def _(spark, sf_dir):
    """The same with every series cut into slices of a few rows."""
    return _episodes(timeline(spark, sf_dir), replace(EVENT_SERIES, hot_rows=20))


# ---- curves --------------------------------------------------------------------

ROC = """cn AS (SELECT risk AS threshold, count(*) FILTER (failure = 1) AS pos, count(*) FILTER (failure = 0) AS neg
  FROM sc GROUP BY risk),
pt AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
   CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n
  FROM cn WINDOW w AS (ORDER BY threshold DESC)),
cv AS (SELECT *, p - tp AS fn, n - fp AS tn, tp / CAST(p AS DOUBLE) AS recall,
   tp / CAST(tp + fp AS DOUBLE) AS precision, fp / CAST(n AS DOUBLE) AS fpr FROM pt)"""
CURVE = f"WITH {SCORED}, {ROC} "
AUC_SQL = "sum(neg * (2.0 * tp - pos)) / (2.0 * max(p) * max(n))"
AP_SQL = "sum(pos * precision) / max(p)"


def points(spark, sf_dir, hot_rows: int | None = 1_000_000):
    return evaluate.curve(scored(spark, sf_dir), "failure", "risk", hot_rows=hot_rows)


@query("roc_curve", CURVE + f"SELECT threshold + 0.0 AS threshold, {q.rnd('fpr')} AS fpr, {q.rnd('recall')} AS tpr FROM cv "
       "UNION ALL SELECT CAST('infinity' AS DOUBLE), 0.0, 0.0")
def _(spark, sf_dir):
    return shown(evaluate.roc_points(points(spark, sf_dir)), ["threshold"], ["fpr", "tpr"])


@query("roc_curve_sliced", CURVE + f"SELECT threshold + 0.0 AS threshold, tp, fp, fn, tn, {q.rnd('recall')} AS recall FROM cv")
def _(spark, sf_dir):
    df = points(spark, sf_dir, hot_rows=2_000)
    return df.select("threshold", "tp", "fp", "fn", "tn", rounded(c("recall"), 6).alias("recall"))


@query("roc_auc", CURVE + f"SELECT {q.rnd(AUC_SQL)} AS roc_auc FROM cv")
def _(spark, sf_dir):
    return shown(evaluate.roc_auc(points(spark, sf_dir)), [], ["roc_auc"])


DOC_CURVE = f"""WITH {q.DOCS}, sc AS (SELECT doc_id, score AS risk, quality AS failure FROM docs), {ROC} """


@query("roc_auc_documents", DOC_CURVE + f"SELECT {q.rnd(AUC_SQL)} AS roc_auc, {q.rnd(AP_SQL)} AS average_precision FROM cv")
def _(spark, sf_dir):
    p = evaluate.curve(document_labels(spark, sf_dir), "quality", "score")
    return evaluate.operating_report(p, 0.5).select(
        rounded(c("roc_auc"), 6).alias("roc_auc"), rounded(c("average_precision"), 6).alias("average_precision")
    )


@query("precision_recall_curve", CURVE + f"SELECT threshold + 0.0 AS threshold, {q.rnd('recall')} AS recall, {q.rnd('precision')} AS precision FROM cv "
       "UNION ALL SELECT NULL, 0.0, 1.0")
def _(spark, sf_dir):
    return shown(evaluate.pr_points(points(spark, sf_dir)), ["threshold"], ["recall", "precision"])


@query("average_precision", CURVE + f"SELECT {q.rnd(AP_SQL)} AS average_precision FROM cv")
def _(spark, sf_dir):
    return shown(evaluate.average_precision(points(spark, sf_dir)), [], ["average_precision"])


@query("threshold_at_recall", CURVE + "SELECT max(threshold) FILTER (recall >= 0.765::DOUBLE) + 0.0 AS threshold FROM cv")
def _(spark, sf_dir):
    return evaluate.threshold_at_recall(points(spark, sf_dir), 0.765)


REPORT = """SELECT {auc} AS roc_auc, {ap} AS average_precision,
  max(threshold) FILTER (recall >= 0.765::DOUBLE) + 0.0 AS threshold,
  arg_max(tp, threshold) FILTER (recall >= 0.765::DOUBLE) AS tp,
  arg_max(fp, threshold) FILTER (recall >= 0.765::DOUBLE) AS fp,
  arg_max(fn, threshold) FILTER (recall >= 0.765::DOUBLE) AS fn,
  arg_max(tn, threshold) FILTER (recall >= 0.765::DOUBLE) AS tn,
  {recall} AS recall, {precision} AS precision, {fpr} AS fpr FROM cv"""


@query(
    "run_metrics",
    CURVE
    + REPORT.format(
        auc=q.rnd(AUC_SQL),
        ap=q.rnd(AP_SQL),
        **{
            n: q.rnd(f"arg_max({n}, threshold) FILTER (recall >= 0.765::DOUBLE)")
            for n in ("recall", "precision", "fpr")
        },
    ),
)
def _(spark, sf_dir):
    return shown_report(points(spark, sf_dir))


def shown_report(curve: DataFrame) -> DataFrame:
    df = evaluate.operating_report(curve, 0.765)
    return df.select(
        *[rounded(c(n), 6).alias(n) for n in ("roc_auc", "average_precision")],
        "threshold", "tp", "fp", "fn", "tn",
        *[rounded(c(n), 6).alias(n) for n in ("recall", "precision", "fpr")],
    )


@query("run_metrics_missing", missing_sql(SQL["run_metrics"]))
def _(spark, sf_dir):
    df = rolling_features(with_missing(spark, sf_dir), EVENT_SENSORS, EVENT_SERIES)
    df = df.select("failure", F.round(RISK_MODEL.probability(), 6).alias("risk"))
    # scores that are no numbers take no part
    odd = df.limit(3).select("failure", F.lit(float("nan")).alias("risk"))
    return shown_report(evaluate.curve(df.unionByName(odd), "failure", "risk"))


@query("stored_model_risk", f"WITH {SCORED} SELECT event_id, risk FROM sc")
def _(spark, sf_dir):
    path = scratch_path(spark, "model")
    coefficient_table(spark, [RISK_MODEL, *MODE_MODELS]).write.parquet(path)
    stored = {m.name: m for m in models_from_table(spark.read.parquet(path))}[RISK_MODEL.name]
    return served(spark, sf_dir).select("event_id", F.round(stored.probability(), 6).alias("risk"))


@query(
    "discovered_sensor_counts",
    f"WITH {q.LINES} " + _union([f"SELECT '{n}' AS sensor, count({n}) AS given FROM li" for n in LINE_SENSORS]),
)
def _(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    found = rows.discover_sensors(df, LabelSpec("returned", ("closed", "discounted")), LINE_KEYS)
    one = df.agg(*[F.count(c(n)).alias(n) for n in found])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("sensor"), c(n).alias("given")) for n in found])))


CONFUSION = f"""WITH {SCORED}, cf AS (SELECT count(*) FILTER (failure = 0 AND risk < 0.416::DOUBLE) AS tn,
  count(*) FILTER (failure = 0 AND risk >= 0.416::DOUBLE) AS fp, count(*) FILTER (failure = 1 AND risk < 0.416::DOUBLE) AS fn,
  count(*) FILTER (failure = 1 AND risk >= 0.416::DOUBLE) AS tp FROM sc) """


def _confusion(spark, sf_dir):
    return evaluate.confusion(rows.predicted_label(scored(spark, sf_dir), "risk", 0.416), "failure", "predicted")


@query("confusion_matrix", CONFUSION + "SELECT tn, fp, fn, tp FROM cf")
def _(spark, sf_dir):
    return _confusion(spark, sf_dir)


@query(
    "confusion_percent",
    CONFUSION
    + _union(
        [
            f"""SELECT {y}::BIGINT AS actual, {p}::BIGINT AS predicted, {cell} AS "count",
            {q.rnd(f'{cell} * 100.0 / (tn + fp + fn + tp)')} AS percent,
            {q.rnd(f'{cell} / CAST(greatest(tn, fp, fn, tp) AS DOUBLE)')} AS share_of_max FROM cf"""
            for y, p, cell in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
        ]
    ),
)
def _(spark, sf_dir):
    df = evaluate.confusion_cells(_confusion(spark, sf_dir))
    return shown(df, ["actual", "predicted", "count"], ["percent", "share_of_max"])


RATES = f"""{q.rnd('tp / CAST(tp + fn AS DOUBLE)')} AS recall, {q.rnd('tp / CAST(tp + fp AS DOUBLE)')} AS precision,
  {q.rnd('fp / CAST(fp + tn AS DOUBLE)')} AS fpr"""


@query("confusion_rates", CONFUSION + f"SELECT tn, fp, fn, tp, {RATES} FROM cf")
def _(spark, sf_dir):
    return shown(evaluate.rates(_confusion(spark, sf_dir)), ["tn", "fp", "fn", "tp"], ["recall", "precision", "fpr"])


# The four published thresholds.
THRESHOLDS = (0.416, 0.299, 0.165, 0.116)
# End of fixed values.


@query(
    "threshold_sweep",
    f"WITH {SCORED}, sw AS ("
    + _union(
        [
            f"""SELECT {t!r}::DOUBLE AS threshold, count(*) FILTER (failure = 1 AND risk >= {t!r}::DOUBLE) AS tp,
            count(*) FILTER (failure = 0 AND risk >= {t!r}::DOUBLE) AS fp,
            count(*) FILTER (failure = 1 AND risk < {t!r}::DOUBLE) AS fn,
            count(*) FILTER (failure = 0 AND risk < {t!r}::DOUBLE) AS tn FROM sc"""
            for t in THRESHOLDS
        ]
    )
    + f") SELECT threshold, tp, fp, fn, tn, {RATES} FROM sw",
)
def _(spark, sf_dir):
    df = evaluate.threshold_sweep(scored(spark, sf_dir), "failure", "risk", THRESHOLDS)
    return shown(df, ["threshold", "tp", "fp", "fn", "tn"], ["recall", "precision", "fpr"])


@query("cost_curve", CURVE + "SELECT threshold + 0.0 AS threshold, fn * 50.0::DOUBLE + fp * 7.0::DOUBLE AS cost FROM cv")
def _(spark, sf_dir):
    return evaluate.cost_curve(points(spark, sf_dir), 50, 7).select("threshold", "cost")


@query(
    "cheapest_threshold",
    CURVE + """SELECT threshold + 0.0 AS threshold, fn * 50.0::DOUBLE + fp * 7.0::DOUBLE AS cost FROM cv
    ORDER BY cost, threshold LIMIT 1""",
)
def _(spark, sf_dir):
    return evaluate.cheapest_threshold(points(spark, sf_dir), 50, 7)


def _density_sql(binned: str | None) -> str:
    weighted = binned or "wt AS (SELECT failure AS class, risk AS x, count(*) AS w FROM sc GROUP BY failure, risk)"
    return f"""WITH {SCORED},
    ss AS (SELECT failure AS class, count(*) AS n, min(risk) AS lo, max(risk) AS hi,
      stddev_samp(risk) * power(count(*)::DOUBLE, -0.2::DOUBLE) AS bw FROM sc GROUP BY failure),
    {weighted},
    gr AS (SELECT class, n, bw, pt AS point, lo - 3.0 * bw + pt * ((hi - lo + 6.0 * bw) / 199.0) AS x
      FROM ss, (SELECT unnest(range(200)) AS pt))
    SELECT g.class, g.point, {q.rnd('g.x')} AS x,
      {q.rnd('sum(w * exp(-0.5 * ((g.x - wt.x) / bw) ^ 2)) / max(n * bw * sqrt(2 * pi()))')} AS density
    FROM gr g JOIN wt ON g.class = wt.class GROUP BY g.class, g.point, g.x"""


@query("score_density", _density_sql(None))
def _(spark, sf_dir):
    return shown(evaluate.score_density(scored(spark, sf_dir), "failure", "risk", bins=None), ["class", "point"], ["x", "density"])


@query(
    "score_density_binned",
    _density_sql(
        """wt AS (SELECT failure AS class, lo + (least(floor((risk - lo) / ((hi - lo) / 512.0)), 511) + 0.5)
        * ((hi - lo) / 512.0) AS x, count(*) AS w FROM sc JOIN ss ON sc.failure = ss.class GROUP BY 1, 2)"""
    ),
)
def _(spark, sf_dir):
    df = evaluate.score_density(scored(spark, sf_dir), "failure", "risk", bins=512)
    return shown(df, ["class", "point"], ["x", "density"])


# ---- calibration ---------------------------------------------------------------


def _grid_sql(tail: str) -> str:
    zone = f"({CONFIG.critical_threshold!r}::DOUBLE * ws)"
    values = ", ".join(f"({w!r}::DOUBLE)" for w in calibrate.WARNING_GRID)
    diag = ", ".join(f"({d!r}::DOUBLE)" for d in calibrate.DIAGNOSIS_GRID)
    return f"""WITH {EXACT_SCORED}, {q.smooth('sc', CONFIG)},
    pr AS (SELECT sm.user_id, ts, event_id, smooth, ws FROM sm, (VALUES {values}) g(ws)),
    {q.streak('pr', CONFIG, keys='user_id, ws', zone=zone)},
    fa AS (SELECT user_id, ws AS warning_sensitivity,
      min(CASE WHEN {q.level(CONFIG, zone)} <> 'HEALTHY' THEN step END) AS first_step FROM st GROUP BY user_id, ws),
    gs AS (SELECT warning_sensitivity, ds AS diagnosis_sensitivity, avg(coalesce(1.0::DOUBLE / (abs(4 - first_step) + 1), 0.0)) AS score
      FROM fa, (VALUES {diag}) d(ds) GROUP BY warning_sensitivity, ds) {tail}"""


def _first_alerts(spark, sf_dir):
    return calibrate.first_alerts(events(spark, sf_dir), EVENT_SENSORS, EVENT_SERIES, RISK_MODEL, CONFIG)


@query("first_alert_steps", _grid_sql(f"SELECT user_id, {q.rnd('warning_sensitivity', 4)} AS warning_sensitivity, first_step FROM fa"))
def _(spark, sf_dir):
    df = _first_alerts(spark, sf_dir)
    return df.select("user_id", rounded(c("warning_sensitivity"), 4).alias("warning_sensitivity"), "first_step")


GRID_SHOWN = ["warning_sensitivity", "diagnosis_sensitivity", "score"]
GRID_SELECT = ", ".join(f"{q.rnd(n)} AS {n}" for n in GRID_SHOWN)


@query("calibration_grid", _grid_sql(f"SELECT {GRID_SELECT} FROM gs"))
def _(spark, sf_dir):
    return shown(calibrate.grid_scores(_first_alerts(spark, sf_dir), EVENT_SERIES), [], GRID_SHOWN)


@query(
    "calibration_best",
    _grid_sql(
        f"SELECT {GRID_SELECT} FROM (SELECT * FROM gs ORDER BY round(score, 9) DESC, warning_sensitivity, diagnosis_sensitivity LIMIT 1)"
    ),
)
def _(spark, sf_dir):
    scores = calibrate.grid_scores(_first_alerts(spark, sf_dir), EVENT_SERIES)
    return shown(calibrate.best_combination(scores), [], GRID_SHOWN)


# ---- splits, scaling, weights --------------------------------------------------


@query(
    "chronological_split",
    """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= floor(0.8 * count(*) OVER ())
    THEN 'train' ELSE 'test' END AS split FROM events""",
)
def _(spark, sf_dir):
    return split.chronological_split(table(spark, sf_dir, "events").select("event_id", "ts"), ONE_SERIES).select(
        "event_id", "split"
    )


STRATIFIED = """h AS (SELECT event_id, event_type,
    CAST('0x' || substr(md5(event_id || '-42'), 1, 13) AS BIGINT) AS h FROM events),
  tot AS (SELECT count(*) AS n, count(*) - CAST(ceil(0.2 * count(*)) AS BIGINT) AS n_train FROM h),
  cl AS (SELECT event_type, count(*) AS nc FROM h GROUP BY event_type),
  sh AS (SELECT event_type, nc * n_train / CAST(n AS DOUBLE) AS exact, floor(nc * n_train / CAST(n AS DOUBLE)) AS given, n_train FROM cl, tot),
  al AS (SELECT event_type, given + CASE WHEN row_number() OVER (ORDER BY given - exact, event_type)
    <= n_train - sum(given) OVER () THEN 1 ELSE 0 END AS quota FROM sh)"""


@query(
    "stratified_split",
    f"""WITH {STRATIFIED} SELECT event_id, h.event_type, CASE WHEN row_number() OVER (PARTITION BY h.event_type
    ORDER BY h, event_id) <= quota THEN 'train' ELSE 'test' END AS split FROM h JOIN al ON h.event_type = al.event_type""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    return split.stratified_split(df, "event_type", "event_id").select("event_id", "event_type", "split")


FOLDS = f"""WITH {q.EVENTS},
  cl AS (SELECT failure, count(*) AS nc, arg_min(event_id, (ts, event_id)) AS first_id, min((ts, event_id)) AS f FROM ev GROUP BY failure),
  of AS (SELECT failure, nc, coalesce(sum(nc) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM cl),
  dl AS (SELECT failure, CAST((o + nc + 2) // 3 - (o + 2) // 3 AS BIGINT) AS d0,
    CAST((o + nc + 1) // 3 - (o + 1) // 3 AS BIGINT) AS d1 FROM of),
  rk AS (SELECT event_id, failure, row_number() OVER (PARTITION BY failure ORDER BY ts, event_id) AS r FROM ev)
  SELECT event_id, rk.failure, CASE WHEN r <= d0 THEN 0 WHEN r <= d0 + d1 THEN 1 ELSE 2 END AS fold
  FROM rk JOIN dl ON rk.failure = dl.failure"""


@query("stratified_folds", FOLDS)
def _(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", "ts", "failure")
    return split.stratified_folds(df, "failure", ONE_SERIES).select("event_id", "failure", "fold")


def _scale_sql(n: str) -> str:
    iqr = f"(quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25))"
    return f"""SELECT '{n}' AS "column", {q.rnd(f'quantile_cont({n}, 0.5)')} AS center,
      {q.rnd(f'CASE WHEN {iqr} = 0 THEN 1 ELSE {iqr} END')} AS scale FROM li"""


@query("robust_scaler", f"WITH {q.LINES} " + _union([_scale_sql(n) for n in LINE_SENSORS]))
def _(spark, sf_dir):
    df = quantiles.robust_scale_stats(lineitem(spark, sf_dir), LINE_SENSORS)
    return shown(df, ["column"], ["center", "scale"])


@query("class_weights", f"""WITH {q.EVENTS} SELECT failure AS class, count(*) AS "rows",
  {q.rnd('sum(count(*)) OVER () / (2.0 * count(*))')} AS weight FROM ev GROUP BY failure""")
def _(spark, sf_dir):
    df = training.balanced_weights(events(spark, sf_dir), "failure")
    return df.select("class", "rows", rounded(c("weight"), 6).alias("weight"))


@query(
    "robust_scaled_rows",
    f"WITH {q.LINES}, st AS (SELECT "
    + ", ".join(
        f"quantile_cont({n}, 0.5) AS m{i}, quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25) AS s{i}"
        for i, n in enumerate(LINE_SENSORS)
    )
    + f" FROM li) SELECT {', '.join(LINE_KEYS)}, "
    + ", ".join(
        f"{q.rnd(f'({n} - m{i}) / CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END')} AS {n}" for i, n in enumerate(LINE_SENSORS)
    )
    + " FROM li, st",
)
def _(spark, sf_dir):
    return shown(quantiles.robust_scaled(lineitem(spark, sf_dir), LINE_SENSORS), LINE_KEYS, LINE_SENSORS)


@query("robust_scaler_approx")
def _(spark, sf_dir):
    return quantiles.robust_scale_stats(lineitem(spark, sf_dir), LINE_SENSORS, exact=False)


# ---- training ------------------------------------------------------------------

LINE_LABELS = LabelSpec("returned", ("closed", "discounted"))
# discount decides one of the modes, so it may not be a feature of the line models
LINE_FEATURE_SENSORS = ("l_quantity", "l_extendedprice", "l_tax")
LINE_FEATURES = feature_names(LINE_FEATURE_SENSORS)
LINE_ORDER = Series((), "l_shipdate", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
LINE_ID = "line_id"


def line_features(spark, sf_dir):
    df = rolling_features(lineitem(spark, sf_dir), LINE_FEATURE_SENSORS, LINE_SERIES)
    return df.withColumn(LINE_ID, F.concat_ws("-", *LINE_KEYS))


@query("train_risk_model")
def _(spark, sf_dir):
    labels = LabelSpec("failure", (), ("event_type",))
    return training.train_risk_model(served(spark, sf_dir), FEATURES, ONE_SERIES, labels).report


@query("risk_model_search")
def _(spark, sf_dir):
    labels = LabelSpec("failure", (), ("event_type",))
    return training.train_risk_model(served(spark, sf_dir), FEATURES, ONE_SERIES, labels).search


@query("train_mode_models")
def _(spark, sf_dir):
    trained = training.train_mode_models(
        line_features(spark, sf_dir), LINE_FEATURES, LINE_ORDER, LINE_LABELS, LINE_ID
    )
    return training.metrics_table(trained, "check").drop("created")


# what training promises: all test rows are judged, the recall is reached, every C is tried and ends, the model is optimal
@query(
    "train_risk_model_checks",
    f"""WITH {q.EVENTS}, n AS (SELECT count(*) AS n FROM ev),
    ts AS (SELECT failure FROM (SELECT failure, row_number() OVER (ORDER BY ts, event_id) AS place FROM ev), n WHERE place > floor(0.8 * n))
    SELECT count(*) AS test_rows, count(*) FILTER (failure = 1) AS test_positives, true AS recall_reached,
      CAST({len(training.RISK_TRAINING.grid)} AS BIGINT) AS tried, true AS all_converged, true AS optimal FROM ts""",
)
def _(spark, sf_dir):
    df = served(spark, sf_dir)
    trained = training.train_risk_model(df, FEATURES, ONE_SERIES, LabelSpec("failure", (), ("event_type",)))
    train = split.chronological_split(df, ONE_SERIES).where("split = 'train'")
    gap = training.optimality_gap(train, trained.model, "failure", trained.best_c)
    search = trained.search.collect()  # one row per C
    return trained.report.select(
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("test_rows"),
        (F.col("tp") + F.col("fn")).alias("test_positives"),
        (F.col("recall") >= training.RISK_TRAINING.target_recall).alias("recall_reached"),
        F.lit(len(search)).cast("long").alias("tried"),
        F.lit(all(r["converged"] for r in search)).alias("all_converged"),
        F.lit(gap < 1e-3).alias("optimal"),
    )


# ---- registry, guards and manifests --------------------------------------------


@query("registry_round_trip", f"WITH {SCORED} SELECT event_id, risk, true AS newest, true AS stale_refused FROM sc")
def _(spark, sf_dir):
    """Risk by the current version of a stored model, saved twice; other settings are refused."""
    path, df = scratch_path(spark, "registry"), served(spark, sf_dir)
    config = training.RISK_TRAINING
    report = evaluate.operating_report(evaluate.curve(scored(spark, sf_dir), "failure", "risk"), config.target_recall)
    report = report.select(F.lit("risk").alias("model"), F.lit(1.0).alias("c"), "*", F.lit(True).alias("converged"))
    for model in (replace(RISK_MODEL, intercept=0.0), RISK_MODEL):
        search = spark.createDataFrame([(1.0, 0.5, 0.0, True)], "c double, mean_auc double, auc_bound double, converged boolean")
        made = training.Trained(model, 1.0, search, report, training.pipeline_model(model))
        newest = models.save_model(spark, path, made, config)
    try:
        models.load_model(spark, path, "risk", FEATURES, replace(config, folds=5))
        refused = False
    except models.StaleModel:
        refused = True
    current = models.versions(spark, path, "risk").first()["version"] == newest
    stored = models.load_pipeline(spark, path, "risk").transform(df)
    return stored.select("event_id", F.round("probability", 6).alias("risk"), F.lit(current).alias("newest"), F.lit(refused).alias("stale_refused"))


@query(
    "feature_manifest",
    f"WITH {q.EVENTS}, {EVENT_FEATURES} "
    + _union([f"SELECT CAST({i + 1} AS BIGINT) AS position, '{n}' AS feature, 'double' AS dtype, count(\"{n}\") AS \"count\" FROM f" for i, n in enumerate(FEATURES)]),
)
def _(spark, sf_dir):
    df = served(spark, sf_dir)
    listed = profile.feature_manifest(df, FEATURES)
    return listed.join(profile.non_null_counts(df.select(*cols(FEATURES))).withColumnRenamed("column", "feature"), "feature")


@query(
    "leakage_guard",
    _union([f"SELECT '{n}' AS \"column\", count({n}) AS \"count\", {str(n == 'event_type').lower()} AS refused FROM events" for n in EVENT_COLUMNS]),
)
def _(spark, sf_dir):
    """Which columns of the table may not be features when the event type decides the label."""
    df, labels = table(spark, sf_dir, "events"), LabelSpec("failure", (), ("event_type",))

    def refused(name: str) -> bool:
        try:
            rows.check_no_leakage(["value", name], labels)
            return False
        except rows.SchemaMismatch:
            return True

    found = spark.createDataFrame([(n, refused(n)) for n in df.columns], "column string, refused boolean")
    return profile.non_null_counts(df).join(found, "column")


# ten readings typed in by hand, one more series beside those of the table
INLINE = [(20.0 + 9.0 * i, 50.0 + (-1) ** i * 4.0 * i) for i in range(10)]


def _inline_sql(sql: str) -> str:
    given = ", ".join(f"({-i - 1}, TIMESTAMP '2024-01-01' + INTERVAL {i + 1} HOUR, -1, NULL, {v!r}::DOUBLE, {k!r}::DOUBLE, NULL)" for i, (v, k) in enumerate(INLINE))
    return sql.replace("FROM events)", f"FROM events UNION ALL VALUES {given})", 1)


@query("alert_timeline_with_inline_series", _inline_sql(SQL["alert_timeline"]))
def _(spark, sf_dir):
    typed = inline_readings(spark, INLINE, EVENT_SENSORS).select(
        (-F.col("step")).alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("step").cast("int"))).alias("ts"),
        F.lit(-1).cast("long").alias("user_id"),
        *EVENT_SENSORS,
    )
    both = events(spark, sf_dir).select(typed.columns).unionByName(typed)
    return flat(alerts.alert_timeline(both, EVENT_SENSORS, EVENT_SERIES, RISK_MODEL, MODE_MODELS, CONFIG))


_BEST_SQL = _grid_sql("SELECT * FROM gs ORDER BY round(score, 9) DESC, warning_sensitivity, diagnosis_sensitivity LIMIT 1")


def _calibrated_sql() -> str:
    fixed = timeline_sql(f"SELECT {', '.join(TIMELINE_COLUMNS)}, {', '.join(m.name for m in MODE_MODELS)} FROM tl")
    zone = f"({CONFIG.critical_threshold!r}::DOUBLE * (SELECT warning_sensitivity FROM best))"
    fixed = fixed.replace(f"{CONFIG.warning_zone!r}::DOUBLE", zone)
    fixed = fixed.replace(f"< {CONFIG.diagnosis_sensitivity!r}::DOUBLE", "< (SELECT diagnosis_sensitivity FROM best)")
    return fixed.replace("WITH ev AS", f"WITH best AS ({_BEST_SQL}), ev AS", 1)


@query("alert_timeline_calibrated", _calibrated_sql())
def _(spark, sf_dir):
    """The timeline under the sensitivities that alert closest to the target step."""
    best = calibrate.best_combination(calibrate.grid_scores(_first_alerts(spark, sf_dir), EVENT_SERIES))
    config = calibrate.calibrated(CONFIG, best)
    return flat(alerts.alert_timeline(events(spark, sf_dir), EVENT_SENSORS, EVENT_SERIES, RISK_MODEL, MODE_MODELS, config))


# ---- sources and streams -------------------------------------------------------


@query("csv_round_trip", "SELECT event_id, user_id, value FROM events")
def _(spark, sf_dir):
    path = scratch_path(spark, "csv")
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    write_feature_table(df, path, "csv")
    return read_sensor_table(spark, path, "csv", df.schema)


@query("feature_table_round_trip", f"WITH {q.EVENTS}, {TRAIN_EVENTS} " + shown_sql(["event_id"], FEATURES, "f") + f" WHERE {ALL_PRESENT}")
def _(spark, sf_dir):
    raw, path = scratch_path(spark, "raw"), scratch_path(spark, "features")
    snapshot_once(table(spark, sf_dir, "events"), raw)
    snapshot_once(table(spark, sf_dir, "events").where("event_id < 0"), raw)  # changes nothing
    df = read_sensor_table(spark, raw, "parquet")
    df = df.withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    df = rolling_features(df, EVENT_SENSORS, EVENT_SERIES, preset=TRAIN)
    write_feature_table(rows.complete_cases(df, FEATURES), path)
    return shown(read_sensor_table(spark, path, "parquet"), ["event_id"], FEATURES)


@query("stream_timeline", SQL["alert_timeline"])
def _(spark, sf_dir):
    monitor.use_rocksdb(spark)
    # a pattern, so that the table may be one file or a folder of files
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/[e]vents.parquet")
    df = raw.withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    stream = monitor.alert_stream(df, EVENT_SENSORS, EVENT_SERIES, RISK_MODEL, MODE_MODELS, CONFIG)
    path = scratch_path(spark, "stream")
    monitor.write_stream(stream, f"{path}/out", f"{path}/checkpoint", drain=True).awaitTermination()
    return flat(monitor.on_time(spark.read.parquet(f"{path}/out")))


_HALVES = "FROM events WHERE event_id * 2 {} (SELECT max(event_id) FROM events))"


@query(
    "stream_state_reset",
    " UNION ALL ".join(
        f"SELECT * FROM ({SQL['alert_timeline'].replace('FROM events)', _HALVES.format(side), 1)})" for side in ("<=", ">")
    ),
)
def _(spark, sf_dir):
    """Two halves of the stream, the second with a new checkpoint: it starts with empty state."""
    monitor.use_rocksdb(spark)
    path, df = scratch_path(spark, "reset"), events(spark, sf_dir)
    last = df.agg(F.max("event_id")).first()[0]
    for half, part in (("first", F.col("event_id") * 2 <= last), ("second", F.col("event_id") * 2 > last)):
        df.where(part).write.parquet(f"{path}/{half}")
        raw = spark.readStream.schema(df.schema).parquet(f"{path}/{half}")
        stream = monitor.alert_stream(raw, EVENT_SENSORS, EVENT_SERIES, RISK_MODEL, MODE_MODELS, CONFIG)
        monitor.write_stream(stream, f"{path}/out_{half}", f"{path}/checkpoint_{half}", drain=True).awaitTermination()
    return flat(monitor.on_time(spark.read.parquet(f"{path}/out_first", f"{path}/out_second")))


# readings arrive in three parts, up to 300 places later than they were taken
ARRIVALS = """arr AS (SELECT event_id, user_id, ts,
    CAST(floor((event_id + event_id * 7919 % 300) * 3.0 / (SELECT max(event_id) + 301 FROM events)) AS INTEGER) AS part,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
  past AS (SELECT a.event_id FROM arr a WHERE EXISTS (
    SELECT 1 FROM arr b WHERE b.user_id = a.user_id AND b.part < a.part AND b.place > a.place))"""


def arrived(spark, sf_dir, **options) -> DataFrame:
    """The stream's output over all parts, one run for each; every run goes on with the stored state."""
    monitor.use_rocksdb(spark)
    path = scratch_path(spark, "arrivals")
    df = events(spark, sf_dir)
    last = df.agg(F.max("event_id")).first()[0]
    part = F.floor((F.col("event_id") + F.col("event_id") * 7919 % 300) * 3.0 / (last + 301))
    for i in range(3):
        df.where(part == i).write.mode("append").parquet(f"{path}/in")
        stream = monitor.alert_stream(
            spark.readStream.schema(df.schema).parquet(f"{path}/in"), EVENT_SENSORS, EVENT_SERIES, RISK_MODEL, MODE_MODELS, CONFIG, **options
        )
        monitor.write_stream(stream, f"{path}/out", f"{path}/checkpoint", drain=True).awaitTermination()
    return spark.read.parquet(f"{path}/out")


_MODE_NAMES = ", ".join(m.name for m in MODE_MODELS)
_NO_SCORE = ", ".join(["NULL"] * (len(TIMELINE_COLUMNS) - 2 + len(MODE_MODELS)))
_ON_TIME = timeline_sql(f"""SELECT {", ".join(TIMELINE_COLUMNS)}, {_MODE_NAMES}, false AS late FROM tl
  UNION ALL SELECT event_id, user_id, {_NO_SCORE}, true FROM events WHERE event_id IN (SELECT event_id FROM past)""")
_ON_TIME = _ON_TIME.replace("FROM events)", "FROM events WHERE event_id NOT IN (SELECT event_id FROM past))", 1)


def _with_late(df: DataFrame) -> DataFrame:
    return df.select(*TIMELINE_COLUMNS, *[rounded(F.col("details")[m.name], 4).alias(m.name) for m in MODE_MODELS], "late")


@query("stream_late_rows", _ON_TIME.replace("WITH ev AS", f"WITH {ARRIVALS}, ev AS", 1))
def _(spark, sf_dir):
    """Readings behind the last scored one of their series come out as late; the rest is the timeline of the others."""
    return _with_late(arrived(spark, sf_dir, chunk_rows=16))


DELAY = 100_000


@query("stream_held_rows", timeline_sql(f"""SELECT {", ".join(TIMELINE_COLUMNS)}, {_MODE_NAMES}, false AS late
  FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS newest FROM tl) WHERE epoch(ts) <= epoch(newest) - {DELAY}"""))
def _(spark, sf_dir):
    """With a delay longer than any reading is late, nothing is late and all that is old enough is in the timeline."""
    return _with_late(arrived(spark, sf_dir, delay=DELAY))


def replayed(spark, sf_dir) -> DataFrame:
    """The timeline as a stream of files."""
    path = scratch_path(spark, "timeline")
    timeline(spark, sf_dir).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _drained(spark, stream: DataFrame) -> DataFrame:
    path = scratch_path(spark, "rollup")
    monitor.write_stream(stream, f"{path}/out", f"{path}/checkpoint", drain=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


_HEALTH_SQL = """count(*) AS readings, count(*) FILTER (alert_level = 'WARNING') AS warnings,
    count(*) FILTER (alert_level = 'CRITICAL') AS criticals, max(risk_prob) AS peak_risk, max(streak) AS longest_streak"""
# the watermark has milliseconds
_WATERMARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTES FROM tl)"


@query("stream_health_rollup", timeline_sql(f""", wd AS (SELECT *, time_bucket(INTERVAL 6 HOURS, ts) AS "start" FROM tl)
  SELECT user_id, "start", "start" + INTERVAL 6 HOURS AS "end", {_HEALTH_SQL} FROM wd
  WHERE "start" + INTERVAL 6 HOURS <= {_WATERMARK} GROUP BY ALL"""))
def _(spark, sf_dir):
    """Tumbling windows that the watermark has closed."""
    done = _drained(spark, rollup.health_rollup(replayed(spark, sf_dir), EVENT_SERIES, "6 hours", "10 minutes"))
    return done.withColumn("peak_risk", c("peak_risk") + 0.0)


@query("stream_sessions", timeline_sql(f""", br AS (
    SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS opens FROM tl WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  isl AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM br)
  SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 12 HOURS AS "end", {_HEALTH_SQL} FROM isl GROUP BY user_id, island
  HAVING max(ts) + INTERVAL 12 HOURS <= {_WATERMARK}"""))
def _(spark, sf_dir):
    """Sessions that the watermark has closed."""
    done = _drained(spark, rollup.sessions(replayed(spark, sf_dir), EVENT_SERIES, "12 hours", "10 minutes"))
    return done.withColumn("peak_risk", c("peak_risk") + 0.0)


@query("stream_lead_times", timeline_sql("""SELECT a.user_id, a.ts AS alert, a.alert_level, f.ts AS failure,
    (epoch_us(f.ts) - epoch_us(a.ts)) / 1e6 AS lead_seconds
  FROM tl a JOIN ev f ON f.user_id = a.user_id AND f.failure = 1 AND f.ts >= a.ts AND f.ts <= a.ts + INTERVAL 1 DAY
  WHERE a.alert_level <> 'HEALTHY'"""))
def _(spark, sf_dir):
    """Alerts joined with the failures of the day after them, both as streams."""
    df = events(spark, sf_dir).where("failure = 1").select("user_id", "ts")
    path = scratch_path(spark, "failures")
    df.write.parquet(path)
    failures = spark.readStream.schema(df.schema).parquet(path)
    return _drained(spark, rollup.lead_times(replayed(spark, sf_dir), failures, EVENT_SERIES, "1 day", "10 minutes"))
