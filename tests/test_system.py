from dataclasses import replace

import numpy as np
import pytest

from fleetpulse.config import LabelSpec, Series
from fleetpulse.plans import system
from fleetpulse.plans.training import MODE_TRAINING, RISK_TRAINING

SENSORS = ("Torque [Nm]", "heat")
LABELS = LabelSpec("failed", ("HOT", "STRAIN"))
SERIES = Series(("machine",), "t", ("id",))


@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(2)
    rows = []
    for m in range(6):
        heat = torque = 0.0
        for t in range(150):
            heat, torque = 0.8 * heat + rng.normal(), 0.7 * torque + rng.normal()
            hot, strain = heat > 2.2, torque > 1.9
            rows.append((m * 1000 + t, m, t, 40 + torque, 300 + heat, int(hot or strain), int(hot), int(strain)))
    return spark.createDataFrame(
        rows, "id long, machine int, t int, `Torque [Nm]` double, heat double, failed int, HOT int, STRAIN int"
    ).cache()


def test_train_store_load_calibrate_replay(spark, readings, tmp_path, monkeypatch):
    small = dict(
        risk_training=replace(RISK_TRAINING, grid=(0.1, 1.0)), mode_training=replace(MODE_TRAINING, grid=(0.5,))
    )
    path = str(tmp_path / "models")
    trained = system.load_system(readings, path, SENSORS, SERIES, LABELS, "id", **small)
    monkeypatch.setattr(system, "train_risk_model", None)
    monkeypatch.setattr(system, "train_mode_models", None)
    loaded = system.load_system(readings, path, SENSORS, SERIES, LABELS, "id", **small)
    assert loaded == trained and [m.name for m in loaded.modes] == ["HOT", "STRAIN"]

    tuned = loaded.calibrated(readings, target_step=4)
    assert 0.1 <= tuned.config.warning_sensitivity <= 1.0
    out = tuned.timeline(readings, keep=["failed"])
    assert out.count() == 900
    mean = {r["failed"]: r["m"] for r in out.groupBy("failed").agg({"risk_prob": "avg"}).toDF("failed", "m").collect()}
    assert mean[1] > mean[0] + 0.2
    seen = {r["failure_type"] for r in out.select("failure_type").distinct().collect()}
    assert {"HOT", "STRAIN"} <= seen
