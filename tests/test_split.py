import random

import pytest
from pyspark.sql import functions as F

from fleetpulse.config import Series
from fleetpulse.operators import split

ONE = Series((), "t", ("id",))


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(5)
    # a third of the rows share one time, some have none
    data = [(i, rnd.choice([None, 7.0, 7.0, 7.0, rnd.random() * 100, rnd.random() * 100, rnd.random() * 9, 50.0]),
             int(rnd.random() < 0.2)) for i in range(701)]
    return data, spark.createDataFrame(data, "id long, t double, y int").cache()


def in_order(data):
    return sorted(data, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))


@pytest.mark.parametrize("finish", [100_000, 10])
def test_chronological(table, finish):
    data, df = table
    out = split.chronological_split(df, ONE, finish_rows=finish)
    train = {r["id"] for r in out.where("split = 'train'").collect()}
    assert train == {r[0] for r in in_order(data)[: int(0.8 * len(data))]}


def test_chronological_edges(table):
    _, df = table
    assert split.chronological_split(df.limit(1), ONE).first()["split"] == "test"
    assert split.chronological_split(df.where("false"), ONE).count() == 0


@pytest.mark.parametrize("finish", [100_000, 10])
def test_any_order_type(spark, finish):
    odd = [float("nan"), float("inf"), float("-inf"), None]
    rows = [(i, odd[i % 8] if i % 8 < 4 else float(i % 50), f"shared beginning {i * 7919 % 1000:04d}", 2**60 + i * 7919 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, t double, name string, big long")
    rank = lambda t: (0,) if t is None else (2,) if t != t else (1, t)
    for column, key in (("t", lambda r: (rank(r[1]), r[0])), ("name", lambda r: r[2]), ("big", lambda r: r[3])):
        out = split.chronological_split(df, Series((), column, ("id",)), finish_rows=finish)
        train = {r["id"] for r in out.where("split = 'train'").collect()}
        assert train == {r[0] for r in sorted(rows, key=key)[:800]}, column


def test_many_classes_and_missing_labels(spark):
    rows = [(i, float(i), i % 1500 if i % 7 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, t double, y long")
    out = split.stratified_split(df, "y", "id", hot_rows=500)
    by = out.groupBy(F.col("y").isNull().alias("none"), "split").count()
    counts = {(r["none"], r["split"]): r["count"] for r in by.collect()}
    labelled = sum(r[2] is not None for r in rows)
    assert counts[False, "test"] == -(-labelled // 5) and counts[True, None] == len(rows) - labelled
    folds = split.stratified_folds(df, "y", ONE, hot_rows=500)
    assert folds.where("y is null and fold is not null").count() == 0
    assert folds.where("y is not null and fold is null").count() == 0


@pytest.mark.parametrize("hot", [100_000, 40])
def test_stratified_folds(table, hot):
    data, df = table
    out = {r["id"]: r["fold"] for r in split.stratified_folds(df, "y", ONE, hot_rows=hot).collect()}
    rows = in_order(data)
    classes = list(dict.fromkeys(r[2] for r in rows))
    codes = sorted(classes.index(r[2]) for r in rows)
    expected = {}
    for code, label in enumerate(classes):
        members = [r[0] for r in rows if r[2] == label]
        sizes = [codes[i::3].count(code) for i in range(3)]
        for fold, size in enumerate(sizes):
            for i in members[:size]:
                expected[i] = fold
            members = members[size:]
    assert out == expected


def test_stratified_split_counts(table):
    data, df = table
    out = split.stratified_split(df, "y", "id", hot_rows=50)
    n = len(data)
    counts = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    n_test = -(-n // 5)
    assert sum(v for (_, s), v in counts.items() if s == "test") == n_test
    for y in (0, 1):
        total = sum(1 for r in data if r[2] == y)
        assert abs(counts[y, "train"] - total * (n - n_test) / n) < 1
    again = split.stratified_split(df.repartition(3), "y", "id")
    assert out.exceptAll(again).count() == 0
    other = split.stratified_split(df, "y", "id", seed=7)
    assert out.exceptAll(other).count() > 0


def test_published_test_size(spark):
    df = spark.range(339).select("id", (F.col("id") < 46).cast("int").alias("y"))
    assert split.stratified_split(df, "y", "id").where("split = 'test'").count() == 68


def test_large_classes_are_split_without_moving_rows(spark, table):
    data, df = table
    whole = split.stratified_split(df, "y", "id", hot_rows=None)
    cut = split.stratified_split(df, "y", "id", hot_rows=50, finish_rows=10)
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()
    assert whole.exceptAll(cut).count() == 0
    hashed = df.withColumn("h", split.spread_key("id", 42))
    assert split.stratified_split(hashed, "y", "id", hot_rows=50, spread="h").drop("h").exceptAll(whole).count() == 0
    folds = split.stratified_folds(df, "y", ONE, hot_rows=50, finish_rows=10)
    assert "Exchange" not in folds._jdf.queryExecution().executedPlan().toString()
    assert split.stratified_folds(df, "y", ONE, hot_rows=None).exceptAll(folds).count() == 0


def test_equal_rows_at_a_cut_are_shared_exactly(spark):
    # few ids, some missing, and a class whose rows are all alike
    rows = [(None if i % 40 == 0 else i // 100, 5.0 if i % 2 else None, int(i % 3 == 0)) for i in range(900)]
    rows += [(7, 7.0, 2)] * 100
    df = spark.createDataFrame(rows, "id long, t double, y int")
    for make, name in ((lambda h: split.stratified_split(df, "y", "id", hot_rows=h), "split"), (lambda h: split.stratified_folds(df, "y", ONE, hot_rows=h), "fold")):
        counts = [{(r["y"], r[name]): r["count"] for r in make(h).groupBy("y", name).count().collect()} for h in (None, 60)]
        assert counts[0] == counts[1] and None not in {k for _, k in counts[0]}
        assert make(60).select("id", "t", "y").exceptAll(df).count() == 0
