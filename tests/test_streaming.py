import cProfile
import pstats

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetpulse.config import Series
from fleetpulse.operators.alerts import alert_timeline
from fleetpulse.plans.tables import CONFIG, EVENT_SENSORS, EVENT_SERIES, MODE_MODELS, RISK_MODEL, events
from fleetpulse.streaming import monitor, rollup

COLUMNS = ["event_id", "user_id", "ts", "step", "risk_prob", "alert_level", "failure_type", "streak", "details"]


def as_rows(df):
    return sorted(
        (r["event_id"], r["user_id"], r["ts"], r["step"], round(r["risk_prob"], 4), r["alert_level"],
         r["failure_type"], r["streak"], tuple(sorted((k, round(v, 4)) for k, v in r["details"].items())))
        for r in df.select(*COLUMNS).collect()
    )


@pytest.mark.parametrize("pieces", [1, 4])
def test_stream_equals_batch(spark, sf, tmp_path, pieces):
    monitor.use_rocksdb(spark)
    df = events(spark, sf).withColumn("value", F.when(F.col("event_id") % 17 != 0, F.col("value")))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = df.agg(F.max("event_id")).first()[0] + 1
    query = None
    for i in range(pieces):  # event ids follow time
        part = df.where(F.floor(F.col("event_id") * pieces / first) == i)
        part.coalesce(1).write.mode("append").parquet(source)
        stream = monitor.alert_stream(
            spark.readStream.schema(df.schema).parquet(source), EVENT_SENSORS, EVENT_SERIES, RISK_MODEL, MODE_MODELS
        )
        # a new run on the same checkpoint goes on with the stored state
        query = monitor.write_stream(stream, out, str(tmp_path / "checkpoint"), drain=True)
        query.awaitTermination()
    assert query.exception() is None
    batch = alert_timeline(df, EVENT_SENSORS, EVENT_SERIES, RISK_MODEL, MODE_MODELS)
    assert as_rows(spark.read.parquet(out)) == as_rows(batch)


def test_stream_needs_keys(spark, sf):
    with pytest.raises(ValueError, match="keys"):
        monitor.alert_stream(events(spark, sf), EVENT_SENSORS, Series((), "ts"), RISK_MODEL)


class FakeState:
    """A value or map state in memory."""

    def __init__(self):
        self.value, self.map = None, {}

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]


class FakeHandle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema, ttl=None):
        return self.states.setdefault(name, FakeState())

    def getMapState(self, name, key, value, ttl=None):
        return self.states.setdefault(name, FakeState())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Clock:
    def __init__(self, now=0):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def processor(handle, **options):
    p = monitor.AlertProcessor(list(EVENT_SENSORS), EVENT_SERIES, RISK_MODEL, list(MODE_MODELS), CONFIG, 5, **options)
    p.init(handle)
    return p


def readings(n, seed=0):
    draw = np.random.default_rng(seed)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(draw.integers(0, 3, n)), unit="s")
    return pd.DataFrame({"user_id": 7, "ts": ts, "event_id": np.arange(n), "value": draw.normal(60, 40, n), "k": draw.normal(50, 20, n)})


def run(p, frames, clock=Clock()):
    out = list(p.handleInputRows((7,), iter(frames), clock))
    return pd.concat(out) if out else pd.DataFrame()


def comparable(df):
    return [(r.event_id, r.step, r.risk_prob, r.alert_level, r.failure_type, r.streak, tuple(r.details.items())) for r in df.itertuples()]


@pytest.mark.parametrize("times", ["spread", "bunched"])
def test_backlog_of_a_series_is_scored_in_bounded_pieces(times):
    rows = readings(2000)
    if times == "bunched":  # nearly all rows within a short time
        rows.loc[100:1800, "ts"] = rows["ts"][100] + pd.to_timedelta(np.arange(1701) // 20, unit="ms")
        rows = rows.sort_values(["ts", "event_id"]).reset_index(drop=True)
    whole = run(processor(FakeHandle()), [rows])
    sizes = []
    handle = FakeHandle()
    p = processor(handle, chunk_rows=100)
    score = p._score
    p._score = lambda batch: sizes.append(len(batch)) or score(batch)
    shuffled = rows.sample(frac=1, random_state=1)
    got = run(p, [shuffled[i : i + 40] for i in range(0, 2000, 40)])
    assert comparable(got) == comparable(whole) and not got["late"].any()
    assert max(sizes) <= 140 and len(sizes) < 120
    assert not handle.states["pages"].map and not handle.states["index"].exists()


def test_late_rows_do_not_move_the_state():
    rows = readings(60)
    p = processor(FakeHandle())
    first = run(p, [rows[:30]])
    second = run(p, [pd.concat([rows[10:12], rows[30:], rows[5:6].assign(ts=pd.NaT)])])
    late = second[second["late"]]
    assert sorted(late["event_id"]) == [5, 10, 11] and late["step"].isna().all()
    on_time = pd.concat([first, second[~second["late"].astype(bool)]])
    assert comparable(on_time) == comparable(run(processor(FakeHandle()), [rows]))


def test_delay_holds_rows_and_idle_series_are_flushed():
    rows = readings(300, 3)
    handle, clock = FakeHandle(), Clock(1000)
    p = processor(handle, delay=1000.0, idle=60, chunk_rows=50)
    draw = np.random.default_rng(1)
    order = np.argsort(np.arange(300) + draw.integers(0, 40, 300))
    got = []
    for i in range(0, 300, 60):
        got.append(run(p, [rows.iloc[order[i : i + 60]]], clock))
        clock.now += 5000
        assert len(handle.timers) == 1
    assert all(g.empty for g in got) and handle.states["index"].exists()
    flushed = pd.concat(list(p.handleExpiredTimer((7,), clock, None)))
    assert comparable(flushed) == comparable(run(processor(FakeHandle()), [rows]))
    assert not any(s.exists() or s.map for s in handle.states.values())
    again = run(p, [rows[:1]], clock)
    assert again.empty and handle.states["series"].exists()

    p = processor(FakeHandle(), delay=20.0, chunk_rows=50)
    parts = [run(p, [rows.iloc[order[i : i + 60]]]) for i in range(0, 300, 60)]
    parts = pd.concat(parts)
    newest = rows["ts"].max() - pd.Timedelta(seconds=20)
    done = run(processor(FakeHandle()), [rows[~rows["event_id"].isin(parts["event_id"][parts["late"].astype(bool)])]])
    done = done[done["ts"] <= newest]
    assert comparable(parts[~parts["late"].astype(bool)]) == comparable(done)


def test_delay_needs_times(spark, sf):
    df = events(spark, sf).withColumn("ts", F.col("ts").cast("string"))
    with pytest.raises(ValueError, match="delay"):
        monitor.alert_stream(df, EVENT_SENSORS, EVENT_SERIES, RISK_MODEL, delay=5.0)


def test_rollups_on_batches_of_times_with_and_without_zone(spark):
    rows = [(1, "2024-01-01 00:10:00", "WARNING", 0.7, 3), (1, "2024-01-01 00:50:00", "CRITICAL", 0.9, 4), (1, "2024-01-01 02:00:00", "HEALTHY", 0.1, 0)]
    series = Series(("id",), "t")
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(rows, "id int, t string, alert_level string, risk_prob double, streak long").withColumn("t", F.col("t").cast(kind))
        hours = rollup.health_rollup(df, series, "1 hour").orderBy("start").collect()
        assert [(r.readings, r.warnings, r.criticals, r.peak_risk, r.longest_streak) for r in hours] == [(2, 1, 1, 0.9, 4), (1, 0, 0, 0.1, 0)]
        assert [r.readings for r in rollup.sessions(df, series, "45 minutes").orderBy("start").collect()] == [2, 1]
        failures = df.where("risk_prob < 0.2").select("id", "t")
        leads = rollup.lead_times(df, failures, series, "80 minutes").collect()
        assert [(r.alert_level, r.lead_seconds) for r in leads] == [("CRITICAL", 4200.0)]


def test_watermark_drops_what_is_behind(spark, tmp_path):
    """A window that the watermark has closed stays as it was given out."""
    series, out = Series(("id",), "t"), str(tmp_path / "out")
    schema = "id int, t timestamp_ntz, alert_level string, risk_prob double, streak long"
    for part in (["00:10", "05:00"], ["00:20", "09:00"]):
        rows = [(1, f"2024-01-01 {x}:00") for x in part]
        df = spark.createDataFrame(rows, "id int, t string").selectExpr("id", "cast(t as timestamp_ntz) t", "'HEALTHY' alert_level", "0.1D risk_prob", "0L streak")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = rollup.health_rollup(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), series, "1 hour", "10 minutes")
        monitor.write_stream(stream, out, str(tmp_path / "checkpoint"), drain=True).awaitTermination()
    got = [(r.start.hour, r.readings) for r in spark.read.parquet(out).orderBy("start").collect()]
    assert got == [(0, 1), (5, 1)]


def test_fast_order_and_rounding_equal_the_plain_ones():
    draw = np.random.default_rng(3)
    values = np.concatenate([draw.random(5000), draw.integers(0, 20_000, 5000) / 20_000, [0.0, 1.0, 0.99995, 0.00005, np.nan]])
    plain = [float(monitor.Decimal(repr(float(v))).quantize(monitor._DIGITS, monitor.ROUND_HALF_UP)) for v in values]
    assert np.array_equal(monitor._rounded(values), plain, equal_nan=True)
    rows = readings(300)
    rows["ts"] = rows["ts"].dt.floor("10s")
    for missing in (False, True):
        if missing:
            rows.loc[draw.integers(0, 300, 40), "ts"] = pd.NaT
        mixed = rows.iloc[draw.permutation(300)]
        mixed["event_id"] %= 5
        assert monitor.in_order(mixed, ["ts", "event_id"]).equals(mixed.sort_values(["ts", "event_id"], na_position="first"))
        assert monitor.unpacked(monitor.packed(mixed)).equals(mixed)
    table = monitor.pa.Table.from_pandas(rows.iloc[:3], preserve_index=False)
    sink = monitor.pa.BufferOutputStream()
    with monitor.pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    assert len(monitor.unpacked(sink.getvalue().to_pybytes())) == 3  # state of older checkpoints


@pytest.mark.parametrize("options, most", [({}, 8_000), ({"chunk_rows": 16}, 18_000), ({"delay": 20}, 12_000)])
def test_a_visit_of_a_short_series_is_cheap(options, most):
    """Calls per visit, after a first one has loaded what is loaded once."""
    handle, rows = FakeHandle(), readings(66)
    run(processor(handle, **options), [rows.iloc[:22]])
    counted = cProfile.Profile()
    p = processor(handle, **options)
    counted.enable()
    for _ in p.handleInputRows((7,), iter([rows.iloc[22:44]]), Clock()):
        pass
    counted.disable()
    assert pstats.Stats(counted).total_calls < most


def series_of(n, each, seed=0):
    """Readings of `n` series in one frame, as they come from a group."""
    parts = [readings(each + i % 7, seed + i).assign(user_id=i) for i in range(n)]
    rows = pd.concat(parts, ignore_index=True)
    rows["event_id"] = np.arange(len(rows))
    return rows.sample(frac=1, random_state=seed).reset_index(drop=True)


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 16}, {"delay": 15.0, "chunk_rows": 16}])
def test_series_of_a_group_are_scored_as_if_alone(options):
    rows = series_of(30, 60)
    parts = [rows[rows["ts"] <= rows["ts"].quantile(0.6)], rows.iloc[::2], rows]
    group = processor(FakeHandle(), **options)
    got = pd.concat([run(group, [p[i : i + 500] for i in range(0, len(p), 500)]) for p in parts])
    for user, mine in got.groupby("user_id"):
        alone = processor(FakeHandle(), **options)
        want = pd.concat([run(alone, [p[p["user_id"] == user]]) for p in parts])
        for late in (False, True):
            some = [x[x["late"].astype(bool) == late] for x in (mine, want)]
            assert comparable(some[0].fillna({"step": -1})) == comparable(some[1].fillna({"step": -1})) if not late else sorted(some[0]["event_id"]) == sorted(some[1]["event_id"])
    assert set(got["user_id"]) == set(range(30))


def test_only_the_idle_series_of_a_group_are_removed():
    rows, handle, clock = series_of(6, 40), FakeHandle(), Clock(1000)
    p = processor(handle, delay=1e6, idle=60)
    run(p, [rows], clock)
    clock.now += 30_000
    again = rows[rows["user_id"] >= 4].assign(ts=lambda d: d["ts"] + pd.Timedelta(days=1), event_id=lambda d: d["event_id"] + 10_000)
    run(p, [again], clock)
    clock.now = 61_000
    flushed = pd.concat(list(p.handleExpiredTimer((0,), clock, None)))
    assert sorted(flushed["event_id"]) == sorted(rows["event_id"][rows["user_id"] < 4])
    clock.now = 91_000
    rest = pd.concat(list(p.handleExpiredTimer((0,), clock, None)))
    assert sorted(rest["event_id"]) == sorted([*rows["event_id"][rows["user_id"] >= 4], *again["event_id"]])
    for user, mine in pd.concat([flushed, rest]).groupby("user_id"):
        alone = pd.concat([x[x["user_id"] == user] for x in (rows, again)])
        assert comparable(mine) == comparable(run(processor(FakeHandle()), [alone]))
    assert not any(s.exists() or s.map for s in handle.states.values())


def test_a_visit_costs_little_for_each_of_many_series():
    handle, rows = FakeHandle(), series_of(400, 20)
    run(processor(handle, chunk_rows=16), [rows])
    counted, more = cProfile.Profile(), rows.assign(ts=rows["ts"] + pd.Timedelta(days=1))
    p = processor(handle, chunk_rows=16)
    counted.enable()
    for _ in p.handleInputRows((0,), iter([more]), Clock()):
        pass
    counted.disable()
    assert pstats.Stats(counted).total_calls < 400 * 400


def test_group_keys_of_several_columns_with_missing_ones(spark, sf, tmp_path):
    monitor.use_rocksdb(spark)
    df = events(spark, sf).where("event_id < 600").withColumn("site", F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("s"), F.col("user_id") % 2)))
    series = Series(("user_id", "site"), "ts", ("event_id",))
    df.write.parquet(str(tmp_path / "in"))
    stream = monitor.alert_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), EVENT_SENSORS, series, RISK_MODEL, MODE_MODELS, groups=3)
    monitor.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), drain=True).awaitTermination()
    assert as_rows(spark.read.parquet(str(tmp_path / "out"))) == as_rows(alert_timeline(df, EVENT_SENSORS, series, RISK_MODEL, MODE_MODELS))
