import os
from dataclasses import replace
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.config import LabelSpec, Series, TrainConfig
from fleetpulse.operators.rows import SchemaMismatch
from fleetpulse.functions.linear import LinearModel
from fleetpulse.operators import evaluate
from fleetpulse.plans import training
from fleetpulse.sources import models, sensors

FEATURES = ["x [1]", "x.2", "x3", "flat"]
LABELS = LabelSpec("y", ("m1", "m2"))
ONE = Series((), "t")


@pytest.fixture(scope="module")
def machines(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 3)) * [1.0, 5.0, 0.2] + [3.0, -2.0, 0.0]
    z = -1.5 + 1.2 * (x[:, 0] - 3) - 0.4 * (x[:, 1] + 2)
    y = rng.random(1500) < 1 / (1 + np.exp(-z))
    m1 = y & (x[:, 0] + rng.normal(size=1500) > 3.5)
    data = [(i, *map(float, x[i]), 4.0, int(y[i]), int(m1[i]), int(y[i] and not m1[i])) for i in range(1500)]
    return spark.createDataFrame(
        data, "t long, `x [1]` double, `x.2` double, x3 double, flat double, y int, m1 int, m2 int"
    ).cache()


def objective(b, z, y, w, c):
    eta = z @ b
    return np.abs(b).sum() + c * (w * (np.logaddexp(0, eta) - y * eta)).sum()


def test_fits_are_optimal(machines):
    config = TrainConfig(grid=(1e-7, 0.01, 0.3, 100.0), max_iter=3000, target_recall=0.7, tol=1e-9)
    sets = {"full": F.lit(True)}
    stats = training.set_statistics(machines, FEATURES, "y", sets)
    assert stats["full"].scales[3] == 1.0
    steepest = training.gradients_at_zero(machines, FEATURES, "y", sets, stats)
    stats, steepest = stats["full"], steepest["full"]
    found = training._fit_set(machines, FEATURES, "y", stats, steepest, config.grid, "full", config)
    pdf = machines.toPandas()
    z = np.column_stack([(pdf[FEATURES].to_numpy() - stats.centers) / stats.scales, np.ones(len(pdf))])
    y = pdf["y"].to_numpy(float)
    w = np.where(y == 1, stats.weights[1], stats.weights[0])
    assert steepest == pytest.approx(np.abs((w * (0.5 - y)) @ z[:, :4]).max() / len(y))
    rng = np.random.default_rng(0)
    for c, (model, done) in found.items():
        b = np.array([*model.coefficients, model.intercept])
        mine = objective(b, z, y, w, c)
        assert done and (c > 1e-6 or not b.any())
        for _ in range(200):
            assert objective(b + rng.normal(size=5) * 1e-3, z, y, w, c) >= mine - 1e-6 * mine


def test_a_search_takes_few_passes_whatever_its_grid(spark, machines):
    def last_job():
        spark.sparkContext.setJobGroup("count", "")
        spark.range(1).foreach(lambda _: None)
        return max(spark.sparkContext.statusTracker().getJobIdsForGroup("count"))

    config = TrainConfig(grid=tuple(10.0 ** (i / 4 - 2) for i in range(20)), max_iter=3000, target_recall=0.7)
    sets = {"full": F.lit(True)}
    stats = training.set_statistics(machines, FEATURES, "y", sets)["full"]
    before = last_job()
    found = training._fit_set(machines, FEATURES, "y", stats, 1.0, config.grid, "full", config)
    assert last_job() - before < 100
    assert len(found) == 20 and all(done for _, done in found.values())
    for c, (model, _) in found.items():
        assert training.optimality_gap(machines, model, "y", c) < 1e-8


def test_histogram_auc_within_its_bound(machines):
    rng = np.random.default_rng(4)
    models = [LinearModel(f"m{i}", tuple(FEATURES), tuple(rng.normal(size=4) * (i > 0)), (0.0,) * 4, (1.0,) * 4, 0.1) for i in range(4)]
    folded = machines.withColumn("f", F.col("t") % 2)
    for bins in (8, 16_384):
        got = training.fold_aucs(folded, FEATURES, "y", "f", {0: models, 1: models[:2]}, bins)
        assert len(got) == 6
        for (k, m), (auc, bound) in got.items():
            scored = folded.where(F.col("f") == k).select("y", models[m].probability().alias("p"))
            exact = evaluate.roc_auc(evaluate.curve(scored, "y", "p")).first()["roc_auc"]
            assert abs(auc - exact) <= bound + 1e-12 and (bins == 8 or m == 0 or bound < 1e-3)
    assert training.fold_aucs(folded.where("y = 1"), FEATURES, "y", "f", {0: models[:1]}, 8) == {(0, 0): (None, 0.0)}


@pytest.fixture(scope="module")
def trained(machines):
    config = TrainConfig(grid=(0.01, 1.0, 50.0), max_iter=100, target_recall=0.765)
    return config, training.train_risk_model(machines, FEATURES, ONE, LABELS, config)


def test_risk_model(machines, trained):
    config, risk = trained
    row = risk.report.first()
    assert row["roc_auc"] > 0.8 and row["recall"] >= 0.765
    assert row["tp"] + row["fp"] + row["fn"] + row["tn"] == 300
    assert sorted(r["c"] for r in risk.search.collect()) == list(config.grid)
    scored = risk.pipeline.transform(machines).select(
        F.abs(F.col("probability") - risk.model.probability()).alias("gap")
    )
    assert scored.agg(F.max("gap")).first()[0] < 1e-12


def test_separable_classes_and_missing_labels(spark):
    rows = [(i, float(i % 7) + (20.0 if i % 2 else 0.0), float(i % 5), i % 2 if i % 50 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "t long, a double, b double, y int")
    config = TrainConfig(grid=(1e7,), max_iter=500, target_recall=0.7, folds=2)
    full = training.train_risk_model(df, ["a", "b"], ONE, LabelSpec("y"), config)
    assert full.search.first()["converged"] and full.report.first()["roc_auc"] == 1.0
    short = training.train_risk_model(df, ["a", "b"], ONE, LabelSpec("y"), replace(config, max_iter=2))
    assert not short.search.first()["converged"] and not short.report.first()["converged"]


def test_mode_models(machines):
    config = TrainConfig(grid=(0.1, 1.0), max_iter=100, target_recall=0.5)
    found = training.train_mode_models(machines, FEATURES, ONE, LABELS, "t", config)
    assert [t.model.name for t in found] == ["m1", "m2"]
    failures = machines.where("y = 1").count()
    table = training.metrics_table(found, "run 1").collect()
    for row in table:
        assert row["tp"] + row["fp"] + row["fn"] + row["tn"] == -(-failures // 5)
        assert row["roc_auc"] > 0.6 and row["features"] == FEATURES


def test_guards(machines):
    with pytest.raises(SchemaMismatch, match="m1"):
        training.train_risk_model(machines, [*FEATURES, "m1"], ONE, LABELS)
    with pytest.raises(ValueError, match="both are needed"):
        training.set_statistics(machines.where("y = 0"), FEATURES, "y", {"full": F.lit(True)})


def test_balanced_weights(machines):
    for r in training.balanced_weights(machines, "y").collect():
        assert r["weight"] == pytest.approx(1500 / (2 * r["rows"]))


def test_registry(spark, trained, tmp_path):
    config, risk = trained
    path = str(tmp_path / "models")
    calls = []

    def train(name):
        calls.append(name)
        return risk

    first = models.load_or_train(spark, path, ["risk"], FEATURES, config, train)
    second = models.load_or_train(spark, path, ["risk"], FEATURES, config, train)
    assert calls == ["risk"] and first == second == {"risk": risk.model}
    assert models.read_metrics(spark, path).count() == 1
    assert len(models.load_pipeline(spark, path, "risk").stages) == 1
    with pytest.raises(models.StaleModel):
        models.load_model(spark, path, "risk", FEATURES[:2], config)


def test_registry_versions(spark, trained, tmp_path, monkeypatch):
    config, risk = trained
    path = str(tmp_path / "models")
    assert models.load_model(spark, path, "risk", FEATURES, config) is None
    first = models.save_model(spark, path, risk, config)
    newer = replace(risk, model=replace(risk.model, intercept=9.0))

    def stopped(*_):
        raise RuntimeError("the job ends before the manifest")

    with monkeypatch.context() as m:
        m.setattr(models, "metrics_table", stopped)
        with pytest.raises(RuntimeError):
            models.save_model(spark, path, newer, config)
    assert models.load_model(spark, path, "risk", FEATURES, config) == risk.model
    second = models.save_model(spark, path, newer, config)
    assert models.load_model(spark, path, "risk", FEATURES, config).intercept == 9.0
    assert [r["version"] for r in models.versions(spark, path, "risk").collect()] == [second, first]
    with pytest.raises(FileNotFoundError):
        models.load_pipeline(spark, path, "other")


def test_optimality_gap(machines, trained):
    config, risk = trained
    train = machines.orderBy("t").limit(1200)
    gap = training.optimality_gap(train, risk.model, "y", risk.best_c)
    moved = replace(risk.model, intercept=risk.model.intercept + 0.5)
    assert 0 <= gap < 1e-3 < training.optimality_gap(train, moved, "y", risk.best_c)


def test_sources(spark, tmp_path):
    raw, out = str(tmp_path / "raw.csv"), str(tmp_path / "features")
    header = ",".join(sensors.MACHINE_SCHEMA.names)
    os.makedirs(raw)
    with open(f"{raw}/part.csv", "w") as f:
        f.write(header + "\n1,M1,M,298.1,308.6,1551,42.8,0,0,0,0,0,0,0\n2,L2,L,,308.7,1408,46.3,3,0,0,0,0,0,0\n")
    df = sensors.read_sensor_table(spark, raw, "csv", sensors.MACHINE_SCHEMA)
    inferred = sensors.read_sensor_table(spark, raw)
    assert df.columns == inferred.columns and df.where("`Air temperature [K]` IS NULL").count() == 1
    with pytest.raises(ValueError, match="elsewhere"):
        sensors.write_feature_table(df, raw, "csv")
    sensors.write_feature_table(df, out)
    assert sensors.read_sensor_table(spark, out, "parquet").count() == 2
    sensors.snapshot_once(df.limit(1), out)
    assert spark.read.parquet(out).count() == 2


def test_stored_rows_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(training, "ROWS_PER_TASK", 100)
    with training.stored(spark.range(1500).coalesce(1)) as kept:
        assert kept.rdd.getNumPartitions() == 15 and kept.distinct().count() == 1500


def test_large_tables_are_stored_once_and_not_cached(spark, machines, monkeypatch):
    config = TrainConfig(grid=(0.1, 1.0), max_iter=100, target_recall=0.5)
    cached = training.train_mode_models(machines, FEATURES, ONE, LABELS, "t", config, only=["m1"])[0]
    paths, persisted = [], []
    scratch, persist = training.scratch_path, type(machines).persist
    monkeypatch.setattr(training, "scratch_path", lambda *a: paths.append(scratch(*a)) or paths[-1])
    monkeypatch.setattr(type(machines), "persist", lambda self, *a: persisted.append(self) or persist(self, *a))
    monkeypatch.setattr(training, "CACHED_ROWS", 100)
    for name in ("stratified_split", "stratified_folds"):
        monkeypatch.setattr(training, name, partial(getattr(training, name), hot_rows=100))
    large = training.train_mode_models(machines, FEATURES, ONE, LABELS, "t", config, only=["m1"])[0]
    assert len(paths) == 1 and not os.path.exists(paths[0].removeprefix("file:")) and not persisted
    assert large.best_c == cached.best_c and large.model.coefficients == pytest.approx(cached.model.coefficients)
    assert large.report.first() == cached.report.first() or large.report.first()["tp"] == cached.report.first()["tp"]
