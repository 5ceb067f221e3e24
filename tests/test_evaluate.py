import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import evaluate, profile, quantiles
from fleetpulse.operators.series import SLICE


def brute_curve(rows):
    out = []
    p = sum(y for y, _ in rows)
    n = len(rows) - p
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(1 for y, s in rows if y == 1 and s >= t)
        fp = sum(1 for y, s in rows if y == 0 and s >= t)
        out.append((t, tp, fp, p - tp, n - fp))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(3)
    # a third of all rows share one score; most others sit close to 0
    data = [(int(rnd.random() < 0.3), 0.5 if rnd.random() < 0.33 else round(rnd.random() ** 4, 5)) for _ in range(600)]
    return data, spark.createDataFrame(data, "y long, s double").cache()


@pytest.mark.parametrize("hot", [None, 25])
def test_curve_counts(scored, hot):
    data, df = scored
    out = evaluate.curve(df, "y", "s", hot_rows=hot)
    assert SLICE not in out.columns
    found = sorted(((r["threshold"], r["tp"], r["fp"], r["fn"], r["tn"]) for r in out.collect()), reverse=True)
    assert found == brute_curve(data)


def test_areas(scored):
    data, df = scored
    points = evaluate.curve(df, "y", "s")
    pos, neg = [s for y, s in data if y == 1], [s for y, s in data if y == 0]
    pairs = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    auc = evaluate.roc_auc(points).first()["roc_auc"]
    assert auc == pytest.approx(pairs / (len(pos) * len(neg)))
    transformed = df.select("y", F.exp("s").alias("s"))
    assert evaluate.roc_auc(evaluate.curve(transformed, "y", "s")).first()["roc_auc"] == pytest.approx(auc)
    ap, before = 0.0, 0
    for _, tp, fp, _, _ in brute_curve(data):
        ap += (tp - before) / len(pos) * tp / (tp + fp)
        before = tp
    assert evaluate.average_precision(points).first()[0] == pytest.approx(ap)


def test_groups_and_missing_classes(spark):
    df = spark.createDataFrame(
        [("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.2), ("b", 0, 0.8), ("c", 0, 0.5), (None, 1, 0.5), (None, 0, 0.5)],
        "m string, y int, s double",
    )
    points = evaluate.curve(df, "y", "s", by=["m"])
    assert {r["m"]: r["roc_auc"] for r in evaluate.roc_auc(points, ["m"]).collect()} == {"a": 1.0, "b": 0.0, "c": None, None: 0.5}
    report = {r["m"]: r for r in evaluate.operating_report(points, 1.0, ["m"]).collect()}
    assert (report["b"]["threshold"], report["b"]["fp"], report["b"]["tn"]) == (0.2, 1, 0)
    assert report["c"]["threshold"] is None
    assert evaluate.roc_points(points, ["m"]).where("threshold = 'Infinity'").count() == 4
    assert evaluate.curve(df.where("false"), "y", "s").count() == 0
    with pytest.raises(ValueError):
        evaluate.threshold_at_recall(points, 0.0)


def test_published_threshold_rates(spark):
    # The published sweep (threshold, recall, fpr, tp, fp, fn, tn).
    golden = [
        (0.416, 0.718, 0.055, 28, 108, 11, 1853),
        (0.299, 0.769, 0.094, 30, 184, 9, 1777),
        (0.165, 0.821, 0.192, 32, 376, 7, 1585),
        (0.116, 0.872, 0.258, 34, 505, 5, 1456),
    ]
    # End of fixed values.
    df = spark.createDataFrame([(t, tp, fp, fn, tn) for t, _, _, tp, fp, fn, tn in golden], "t double, tp long, fp long, fn long, tn long")
    found = {r["t"]: r for r in evaluate.rates(df).collect()}
    for t, recall, fpr, *_ in golden:
        # 505 / 1961 = .2575..., published cut to three digits
        assert found[t]["recall"] == pytest.approx(recall, abs=0.0005)
        assert found[t]["fpr"] == pytest.approx(fpr, abs=0.0006)


def test_confusion_has_all_cells(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "y int, p int")
    counts = evaluate.confusion(df, "y", "p")
    assert counts.first().asDict() == {"tn": 0, "fp": 0, "fn": 0, "tp": 2}
    assert evaluate.rates(counts).first()["fpr"] is None
    assert sorted(r["percent"] for r in evaluate.confusion_cells(counts).collect()) == [0.0, 0.0, 0.0, 100.0]


def test_density_integrates_to_one(scored):
    _, df = scored
    for bins in (None, 2000):
        out = evaluate.score_density(df, "y", "s", bins=bins).orderBy("class", "point").collect()
        assert len(out) == 400
        for k in (0, 1):
            xs = [(r["x"], r["density"]) for r in out if r["class"] == k]
            area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(xs, xs[1:]))
            assert area == pytest.approx(1.0, abs=0.01)
    constant = df.select("y", F.lit(0.5).alias("s"))
    assert evaluate.score_density(constant, "y", "s").count() == 0


def test_exact_quantiles(spark):
    data = [(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (10.0, None), (float("nan"), 5.0)]
    df = spark.createDataFrame(data, "x double, same double")
    out = {r["column"]: r["quantiles"] for r in quantiles.exact_quantiles(df, ["x", "same"], (0.25, 0.5, 0.75)).collect()}
    assert out == {"x": [1.75, 3.0, 5.5], "same": [5.0, 5.0, 5.0]}
    scale = {r["column"]: (r["center"], r["scale"]) for r in quantiles.robust_scale_stats(df, ["x", "same"]).collect()}
    assert scale == {"x": (3.0, 3.75), "same": (5.0, 1.0)}


def test_exact_quantiles_sliced_and_by_set(spark):
    df = spark.range(500).select((F.pmod(F.xxhash64("id"), F.lit(1000)) / 7).alias("x"), (F.col("id") % 3).alias("f")).cache()
    sets = {"all": F.lit(True), "no0": F.col("f") != 0}
    found = {r["set"]: r["quantiles"] for r in quantiles.exact_quantiles(df, ["x"], (0.1, 0.5), sets, cells=4, finish_rows=3).collect()}
    for name, where in (("all", "true"), ("no0", "f != 0")):
        expected = df.where(where).agg(F.percentile("x", F.array(F.lit(0.1), F.lit(0.5)))).first()[0]
        assert found[name] == pytest.approx(expected)


def test_profile(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (3.0, "a")], "x double, s string")
    assert {r["column"]: r["count"] for r in profile.non_null_counts(df).collect()} == {"x": 2, "s": 2}
    assert profile.missing_fractions(df).first()["missing"] == pytest.approx(1 / 3)
    row = profile.describe(df).first()
    assert (row["count"], row["mean"], row["p50"], row["max"]) == (2, 2.0, 2.0, 3.0)
    assert row["std"] == pytest.approx(math.sqrt(2))
    assert [tuple(r) for r in profile.class_frequency(df, "s", dropna=False).collect()] == [("a", 2), (None, 1)]
    assert profile.shape(df).first().asDict() == {"rows": 3, "columns": 2}
    assert [tuple(r) for r in profile.column_types(df).collect()] == [("x", "double"), ("s", "string")]
    assert profile.feature_manifest(df, ["x"]).first()["feature"] == "x"
    assert profile.describe(df.where("false")).first()["p50"] is None
    labels = spark.createDataFrame([(0,)] * 9661 + [(1,)] * 339, "y int")
    assert round(profile.imbalance(labels, "y").first()["ratio"]) == 28


def test_quantiles_of_hard_values(spark):
    draw = np.random.default_rng(3)
    x = np.concatenate([10.0 ** draw.uniform(-300, 300, 300) * draw.choice([-1, 1], 300), np.zeros(200), [-0.0, np.inf, -np.inf], draw.integers(0, 3, 400)])
    draw.shuffle(x)
    rows = [(i, float(v), None, float("nan") if i % 3 else float(i)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "i int, `x [1]` double, none double, some double").repartition(5)
    q = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    for cells, finish in ((1024, 4096), (4, 1), (2, 50)):
        got = quantiles.exact_quantiles(df, ["x [1]", "none", "some"], q, {"all": F.lit(True), "even": F.col("i") % 2 == 0, "no": F.col("i") < 0}, cells, finish)
        got = {(r["set"], r["column"]): r["quantiles"] for r in got.collect()}
        assert set(got) == {(s, n) for s in ("all", "even", "no") for n in ("x [1]", "some")} and got["no", "some"] == [None] * 6
        for tag, mine in (("all", x), ("even", x[::2])):
            for p, value in zip(q, got[tag, "x [1]"]):
                s, h = np.sort(mine), (len(mine) - 1) * p
                lo, hi = s[int(np.floor(h))], s[int(np.ceil(h))]
                finite = np.isfinite([lo, hi]).all()
                assert not finite or value == (lo + (hi - lo) * (h - np.floor(h)) if h % 1 else lo)
        assert got["all", "some"][-1] == max(i for i in range(len(x)) if i % 3 == 0)


def test_quantiles_shuffle_no_values(spark):
    """What is shuffled are counts by interval and cell."""
    df = spark.range(5000).select((F.col("id") * 1.5).alias("x"))
    seen = []
    collect = quantiles._counted
    quantiles._counted = lambda *a: seen.append([t.rows for t in a[2]]) or collect(*a)
    try:
        [row] = quantiles.exact_quantiles(df, ["x"], (0.5,), cells=64, finish_rows=100).collect()
    finally:
        quantiles._counted = collect
    assert row["quantiles"] == [2499.5 * 1.5] and len(seen) <= 4 and seen[0] == [5000] and max(seen[-1]) <= 100


def test_columns_of_few_values_take_few_passes(spark):
    df = spark.range(6000).select((F.col("id") % 9 / 100).alias("tax"), (F.col("id") % 50 + 1.0).alias("amount"))
    seen, collect = [], quantiles._counted
    quantiles._counted = lambda *a: seen.append(len(a[2])) or collect(*a)
    try:
        found = quantiles.exact_quantiles(df, ["tax", "amount"], (0.25, 0.5), finish_rows=10).collect()
    finally:
        quantiles._counted = collect
    assert {r["column"]: r["quantiles"] for r in found} == {"tax": [0.02, 0.04], "amount": [13.0, 25.5]} and len(seen) <= 3
