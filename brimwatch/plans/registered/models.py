from __future__ import annotations

from pyspark.sql import functions as F

from brimwatch.config import Settings
from brimwatch.operators import anomaly
from brimwatch.operators.features import series_features
from brimwatch.plans.cycle import run_cycle
from brimwatch.plans.registered.base import r6, register
from brimwatch.plans.sqlviews import with_views
from brimwatch.session import fresh_dir
from brimwatch.sources import sample as V


def labelled(spark, d):
    return anomaly.training_set(V.telemetry(spark, d, one_device=True), V.series_labels(spark, d))


@register(
    "anomaly_split",
    with_views(
        "series_labels",
        """SELECT y, n, CAST(ceil(n * 0.25) AS BIGINT) AS n_test FROM (
             SELECT CASE WHEN label = 'anomalous' THEN 1 ELSE 0 END AS y, count(*) AS n FROM series_labels GROUP BY 1)""",
    ),
)
def split(spark, d):
    """ML2: sizes of both parts per class."""
    parts = anomaly.split(labelled(spark, d))
    return parts.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))


@register(
    "anomaly_train_sizes",
    with_views(
        "series_labels",
        """SELECT CAST(sum(n - ceil(n * 0.25)) AS BIGINT) AS n_train, CAST(sum((n - ceil(n * 0.25)) * y) AS BIGINT) AS n_pos FROM (
             SELECT CASE WHEN label = 'anomalous' THEN 1 ELSE 0 END AS y, count(*) AS n FROM series_labels GROUP BY 1)""",
    ),
)
def train_sizes(spark, d):
    """ML3, AG20: what a training run (of two trees) says it learned from."""
    metrics = anomaly.train(labelled(spark, d), trees=2).metrics
    return spark.createDataFrame([(int(metrics["n_train"]), int(metrics["n_pos"]))], "n_train long, n_pos long")


@register("anomaly_train")
def train(spark, d):
    """ML1, ML3, AG20."""
    metrics = anomaly.train(labelled(spark, d)).metrics
    return spark.createDataFrame([metrics])


@register("anomaly_score")
def score(spark, d):
    """ML4, ML5: a saved model, loaded again, over every series."""
    path = fresh_dir(spark, "model")
    anomaly.save(anomaly.train(labelled(spark, d)).model, path)
    features = series_features(V.telemetry(spark, d, one_device=True))
    scored = anomaly.score(anomaly.load(path), features)
    return scored.select("host_id", "device", r6("anomaly_score").alias("anomaly_score"))


@register("cycle_fleet")
def cycle(spark, d):
    """CYC1, SNK4: features, score, piecewise forecast and trigger, appended and read back."""
    model = anomaly.train(labelled(spark, d)).model
    path = fresh_dir(spark, "predictions")
    run_cycle(
        V.telemetry(spark, d, one_device=True), V.as_of(spark, d), model, path, Settings(history_days=30)
    )
    return spark.read.parquet(path).drop("ts", "run_date")
