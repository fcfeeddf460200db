"""Gradient-boosted anomaly classifier over the series features (ML1-ML5)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brimwatch.operators.features import FEATURES, series_features
from brimwatch.session import cut_lineage

# Fixed values of the classifier.
TREES = 200
DEPTH = 4
LEARNING_RATE = 0.1
HOLDOUT = 0.25
SEED = 42
#: Rows a task of training takes: a round is some four short jobs, whose cost is mostly that of their tasks.
ROWS_A_TASK = 50_000
POSITIVE = "anomalous"


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """JN4. Adds y, 1 for hosts of the anomalous pattern; unlabelled hosts are 0."""
    known = labels.select("host_id", (F.col("label") == POSITIVE).alias("_hit"))
    return (
        rows.join(known, "host_id", "left")
        .withColumn("y", F.coalesce("_hit", F.lit(False)).cast("int"))
        .drop("_hit")
    )


def training_set(telemetry: DataFrame, labels: DataFrame, keys=("host_id", "device")) -> DataFrame:
    """ML1, JN4. Features with their class."""
    return with_labels(series_features(telemetry, keys), labels)


def split(rows: DataFrame, holdout: float = HOLDOUT, seed: int = SEED, keys=("host_id", "device")) -> DataFrame:
    """ML2. Adds ``is_test``: the same share of each class, rounded up, by stable hash.

    The order within a class is that of a hash. Counts per (class, hash bucket)
    give each bucket its offset, so only rows of one bucket are ever ranked
    together. A class of any size stays spread out.
    """
    order = F.xxhash64(F.lit(seed), *keys)
    ranged = rows.withColumn("_hash", order).withColumn(
        "_bucket", F.shiftrightunsigned("_hash", 64 - 12).cast("int")
    )
    sizes = ranged.groupBy("y", "_bucket").agg(F.count("*").alias("_n"))
    whole = W.partitionBy("y")
    before = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "y",
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("_total"),
    )
    inside = W.partitionBy("y", "_bucket").orderBy("_hash", *keys)
    ranked = ranged.withColumn("_rank", F.row_number().over(inside)).join(offsets, ["y", "_bucket"])
    position = F.col("_offset") + F.col("_rank")
    return ranked.withColumn("is_test", position <= F.ceil(F.col("_total") * holdout)).select(
        *rows.columns, "is_test"
    )


def class_weight(rows: DataFrame) -> DataFrame:
    """AG21. Weight of the positive class; 1 if there is none."""
    positives = F.sum("y")
    return rows.agg(
        F.count("*").alias("n"),
        F.coalesce(positives, F.lit(0)).alias("n_pos"),
        F.when(positives > 0, (F.count("*") - positives) / positives).otherwise(1.0).alias("weight"),
    )


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def holdout_metrics(scored: DataFrame) -> DataFrame:
    """AG20. Accuracy on both parts and recall of the positive class on the held-out one."""
    right = F.col("prediction") == F.col("y")
    test = F.col("is_test")
    hits = F.count_if(test & (F.col("prediction") == 1) & (F.col("y") == 1))
    positives = F.count_if(test & (F.col("y") == 1))
    return scored.agg(
        F.avg(F.when(F.col("is_train"), right.cast("double"))).alias("train_acc"),
        F.avg(F.when(test, right.cast("double"))).alias("test_acc"),
        F.when(positives > 0, hits / positives).otherwise(F.lit(float("nan"))).alias("anomaly_recall"),
        F.count_if("is_train").alias("n_train"),
        F.count_if(F.col("is_train") & (F.col("y") == 1)).alias("n_pos"),
    )


@dataclass
class Trained:
    model: GBTClassificationModel
    metrics: dict[str, float]
    scored: DataFrame


def train(rows: DataFrame, trees: int = TREES, seed: int = SEED, keys=("host_id", "device")) -> Trained:
    """ML3. Boosted trees with the positive class weighted up, and held-out metrics.

    Without examples of both classes all rows serve for training and test.
    """
    rows = cut_lineage(rows)
    balance = class_weight(rows).first()
    if 0 < balance["n_pos"] < balance["n"]:
        parts = split(rows, seed=seed, keys=keys).withColumn("is_train", ~F.col("is_test"))
    else:
        parts = rows.withColumn("is_test", F.lit(True)).withColumn("is_train", F.lit(True))
    # Dealt by rows and in order: tasks and result of the rounds follow the series, not the settings of shuffles.
    tasks = -(-max(1, balance["n"]) // ROWS_A_TASK)
    parts = cut_lineage(parts.repartition(tasks, *keys).sortWithinPartitions(*keys))
    weight = class_weight(parts.where("is_train")).first()["weight"]
    weighted = _vectors(parts).withColumn(
        "weight", F.when(F.col("y") == 1, F.lit(float(weight))).otherwise(1.0)
    )
    model = GBTClassifier(
        featuresCol="features", labelCol="y", weightCol="weight", maxIter=trees,
        maxDepth=DEPTH, stepSize=LEARNING_RATE, seed=seed,
    ).fit(weighted.where("is_train"))
    scored = model.transform(weighted)
    return Trained(model, holdout_metrics(scored).first().asDict(), scored)


def score(model: GBTClassificationModel, features: DataFrame) -> DataFrame:
    """ML4. Probability of the anomalous class per series."""
    scored = model.transform(_vectors(features))
    return scored.withColumn("anomaly_score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def save(model: GBTClassificationModel, path: str) -> None:
    """ML5."""
    model.write().overwrite().save(path)


def load(path: str) -> GBTClassificationModel:
    """ML5. A missing model is a clear error."""
    try:
        return GBTClassificationModel.load(path)
    except Exception as error:
        raise FileNotFoundError(f"no anomaly model at {path}; train one first") from error
