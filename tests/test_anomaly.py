from __future__ import annotations

import random

import numpy as np
import pytest

from brimwatch.operators import anomaly
from brimwatch.operators.features import series_features


@pytest.fixture(scope="module")
def labelled(spark, series):
    draw = np.random.default_rng(41)
    n = 1200
    x = np.arange(n) / n
    leak = np.maximum(0.0, x - 0.75) * 4
    shapes = {
        "wave": (24, lambda: 30 + draw.uniform(0, 30) + 4 * np.sin(x * 26) + draw.normal(0, 0.2, n)),
        "filling": (12, lambda: 15 + draw.uniform(10, 40) * x + draw.normal(0, 0.2, n)),
        "anomalous": (12, lambda: 25 + draw.uniform(35, 60) * leak + draw.normal(0, 0.2, n)),
        "full": (8, lambda: 95 + draw.normal(0, 0.3, n)),
    }
    values, labels = {}, []
    for name, (count, make) in shapes.items():
        for number in range(count):
            values[f"{name}-{number:02d}"] = np.clip(make(), 0, 99.9)
            labels.append((f"{name}-{number:02d}", name))
    labels.remove(("wave-00", "wave"))  # a host without label is class 0
    return series(values), spark.createDataFrame(labels, "host_id string, label string")


@pytest.fixture(scope="module")
def rows(labelled):
    return anomaly.training_set(*labelled).cache()


def test_labels(rows):
    assert rows.count() == 56 and rows.where("y = 1").count() == 12


def test_split_is_exact_and_stable(spark, rows):
    parts = anomaly.split(rows).cache()
    got = {(r.y, r.is_test): r["count"] for r in parts.groupBy("y", "is_test").count().collect()}
    assert got == {(0, True): 11, (0, False): 33, (1, True): 3, (1, False): 9}
    again = anomaly.split(rows.repartition(7))
    pick = lambda df: sorted(r.host_id for r in df.where("is_test").collect())
    assert pick(parts) == pick(again)
    random.seed(0)
    many = spark.createDataFrame([(f"h{i}", "/", int(i % 10 == 0)) for i in range(5000)], "host_id string, device string, y int")
    sizes = {(r.y, r.is_test): r["count"] for r in anomaly.split(many).groupBy("y", "is_test").count().collect()}
    assert sizes == {(0, True): 1125, (0, False): 3375, (1, True): 125, (1, False): 375}


def test_train_score_save_load(rows, labelled, tmp_path):
    trained = anomaly.train(rows, trees=10)
    assert trained.metrics["test_acc"] >= 0.85 and trained.metrics["anomaly_recall"] >= 0.5
    assert (trained.metrics["n_train"], trained.metrics["n_pos"]) == (42, 9)
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError, match="train one first"):
        anomaly.load(path)
    anomaly.save(trained.model, path)
    scores = {r.host_id: r.anomaly_score for r in anomaly.score(anomaly.load(path), series_features(labelled[0])).collect()}
    best = max(v for k, v in scores.items() if k.startswith("anomalous"))
    assert best > 0.5 and max(v for k, v in scores.items() if k.startswith("wave")) < best
    assert all(0.0 <= v <= 1.0 for v in scores.values())


def test_class_weight(spark):
    rows = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    assert anomaly.class_weight(rows).first().weight == 3.0
    assert anomaly.class_weight(rows.where("y = 0")).first().weight == 1.0


def test_tasks_of_training_follow_the_rows(spark, monkeypatch):
    """However the rows come, a round has as many tasks as their number needs."""
    draw = random.Random(8)
    names = [f"h{i}" for i in range(300)]
    made = [(name, "/", *[draw.random() for _ in anomaly.FEATURES], 0) for name in names]
    schema = "host_id string, device string, " + ", ".join(f"{x} double" for x in anomaly.FEATURES) + ", y int"
    rows = spark.createDataFrame(made, schema)
    few = anomaly.train(rows.repartition(16), trees=1).scored
    assert few.rdd.getNumPartitions() == 1
    monkeypatch.setattr(anomaly, "ROWS_A_TASK", 100)
    more = anomaly.train(rows.repartition(16), trees=1).scored
    assert more.rdd.getNumPartitions() == 3
    assert sorted(r.host_id for r in more.select("host_id").collect()) == sorted(names)
