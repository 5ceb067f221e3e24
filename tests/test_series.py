"""Cut series must give exactly what plain windows give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetpulse.config import Series
from fleetpulse.operators import series as S


def recursion(flags, persistence):
    """The counter as a loop: (in_zone, override) per row."""
    streak, out = 0, []
    for in_zone, override in flags:
        streak = streak + 1 if in_zone else 0
        if override:
            streak = max(streak, persistence)
        out.append(streak)
    return out


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(900):
        key = None if rnd.random() < 0.4 else rnd.choice(["a", "b", "c"])
        t = rnd.random() * 1000
        # bursts: most rows of a key sit in a tiny part of the time axis, many at the same time
        burst = float(int(rnd.random() ** 6 * 50_000)) / 50
        rows.append((i, key, t, burst, rnd.choice([None, rnd.random(), rnd.random()]), rnd.random()))
    for row in [("solo", 1.0), ("a", None), ("a", float("inf")), ("a", 500.0), ("a", 500.0)]:
        rows.append((9000 + len(rows), row[0], row[1], row[1], 2.0, 0.5))
    return spark.createDataFrame(rows, "id long, key string, t double, burst double, x double, p double").repartition(5).cache()


SPECS = [(("key",), 40), ((), 100)]


def collected(df, *names):
    return {r["id"]: tuple(None if r[n] is None else round(r[n], 9) for n in names) for r in df.collect()}


def test_slice_numbers_are_dealt_anew_before_they_run_out(skewed, monkeypatch):
    spec = Series(("key",), "burst", ("id",), 40)
    given = S.slice_series(skewed, spec)
    monkeypatch.setattr(S, "SLICE_NUMBERS", 1)
    again = S.slice_series(skewed, spec)
    sizes = [
        {tuple(r) for r in df.groupBy("key", S.HOT, S.SLICE).agg(F.min("id"), F.max("id"), F.count("*")).drop(S.SLICE).collect()}
        for df in (given, again)
    ]
    assert sizes[0] == sizes[1] and len(sizes[0]) > 10
    order = [r.id for r in given.where(S.HOT).orderBy("key", S.SLICE, "id").collect()]
    assert order == [r.id for r in again.where(S.HOT).orderBy("key", S.SLICE, "id").collect()]
    assert again.agg(F.max(S.SLICE)).first()[0] < given.agg(F.max(S.SLICE)).first()[0]


@pytest.mark.parametrize("keys,hot", SPECS)
def test_lookback_equals_plain_windows(skewed, keys, hot):
    def add(df, w):
        return df.select(
            "*",
            F.avg("x").over(w.rowsBetween(-4, 0)).alias("m"),
            F.lag("p", 4).over(w).alias("l"),
        )

    plain = S.with_lookback(skewed, Series(keys, "t", ("id",), None), 4, add)
    cut = S.with_lookback(skewed, Series(keys, "t", ("id",), hot), 4, add)
    assert cut.where(F.col(S.HOT)).select(S.SLICE).distinct().count() > 3
    assert collected(cut, "m", "l") == collected(plain, "m", "l")


@pytest.mark.parametrize("keys,hot", SPECS)
def test_running_sums_equal_plain_windows(skewed, keys, hot):
    plain = skewed.select("*", F.row_number().over(Window.partitionBy(*keys).orderBy("t", "id")).alias("n"))
    cut = S.row_index(skewed, Series(keys, "t", ("id",), hot), "n")
    assert collected(cut, "n") == collected(plain, "n")


@pytest.mark.parametrize(
    "keys,hot,zone,override,persistence",
    [
        (("key",), None, 0.3, 0.8, 3),
        (("key",), 40, 0.3, 0.8, 3),
        (("key",), 40, 0.05, 0.98, 40),
        ((), 100, 0.9, 0.6, 5),
        ((), 100, 0.0, 2.0, 3),
    ],
)
def test_streaks_equal_recursion(skewed, keys, hot, zone, override, persistence):
    out = S.streaks(
        skewed,
        Series(keys, "t", ("id",), hot),
        F.col("p") < zone,
        F.when(F.col("p") >= override, F.lit(persistence)),
    ).collect()
    groups = {}
    for r in out:
        groups.setdefault(tuple(r[k] for k in keys), []).append(r)
    for rows in groups.values():
        rows.sort(key=lambda r: (r["t"] is not None, r["t"] or 0.0, r["id"]))
        expected = recursion([(r["p"] >= zone, r["p"] >= override) for r in rows], persistence)
        assert [r["streak"] for r in rows] == expected


def test_slices_are_bounded(skewed):
    bursty = Series(("key",), "burst", ("id",), 40)
    sliced = S.slice_series(skewed, bursty).cache()
    sizes = [r["count"] for r in sliced.where(F.col(S.HOT)).groupBy("key", S.SLICE).count().collect()]
    ties = skewed.groupBy("key", "burst").count().agg(F.max("count")).first()[0]
    assert ties > 40 and max(sizes) <= 80
    plain = skewed.select("*", F.row_number().over(Window.partitionBy("key").orderBy("burst", "id")).alias("n"))
    assert collected(S.row_index(sliced, bursty, "n"), "n") == collected(plain, "n")


def test_empty_table(skewed):
    empty = skewed.where("id < 0")
    assert S.row_index(empty, Series(("key",), "t", ("id",), 10)).count() == 0


def test_text_order_is_cut(spark):
    names = [f"n{i * 7919 % 400:05d}" for i in range(400)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    series = Series((), "name", ("id",), 30)
    got = {r["name"]: r["step"] for r in S.row_index(df, series).collect()}
    assert got == {n: i + 1 for i, n in enumerate(sorted(names))}
    assert S.slice_series(df, series).select(S.SLICE).distinct().count() > 3
