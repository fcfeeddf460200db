"""Toxicity with a classifier chain (operator 5).

One linear model per category, in a fixed order. From the second on, a model also
sees the log-odds of the earlier categories. For training these are predictions
out of fold, so that the later models learn from errors like those they will
meet. Features are the presence of words and of word beginnings.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimwatch.llm.common import by_key, groups, seeds, slices, stage, unstage, words
from brimwatch.operators.skew import top_per_key

#: Category and the condition on a label row that makes it positive, in chain order.
CATEGORIES: dict[str, str] = {"junk": "quality = 0", "toxic": "toxic = 1"}
PREFIXES = (4, 5)
_SALT = seeds(1 + len(PREFIXES), 271_829)


@dataclass(frozen=True)
class Training:
    #: Labelled documents to learn from, at most about; the only bound of the fit.
    sample: int = 12_000
    folds: int = 3
    #: Features of a model: those that differ most between positive and negative documents.
    features: int = 400
    support: int = 4
    least_chi2: float = 15.0
    ridge: float = 0.1
    steps: int = 25


@dataclass
class Model:
    """Weights of one category: intercept, features, earlier categories."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float
    chain: np.ndarray
    #: From this probability on a document counts as positive.
    threshold: float = 0.5


def present(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text): hashes of the words and word beginnings of each text, with repeats."""
    whole, offsets, *short = words(texts, PREFIXES)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    parts = [x ^ salt for x, salt in zip((whole, *short), _SALT, strict=True)]
    return np.concatenate(parts), np.tile(owner, len(parts))


def _featured(names: list[str]):
    """Rows (rid, fold, labels, text) to the same with the distinct features in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                feature, owner = present(piece.column("text").to_pylist())
                order = np.lexsort((feature, owner))
                feature, owner = feature[order], owner[order]
                first = np.ones(len(feature), dtype=bool)
                first[1:] = (feature[1:] != feature[:-1]) | (owner[1:] != owner[:-1])
                feature, owner = feature[first], owner[first]
                at = np.searchsorted(owner, np.arange(piece.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(feature.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in names), lists], names=[*names, "features"]
                )

    return run


def _screened(rows: DataFrame, categories: list[str], plan: Training) -> DataFrame:
    """(model, category, feature): the features of each fold's model, chosen without that fold's rows."""
    models = range(plan.folds + 1)  # the last one leaves no fold out
    one = rows.select("fold", *categories, F.explode("features").alias("feature"))
    sums = [F.sum(F.when(F.col("fold") == f, 1).otherwise(0)).alias(f"n_{f}") for f in range(plan.folds)]
    sums += [
        F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}")
        for c in categories
        for f in range(plan.folds)
    ]
    seen = one.groupBy("feature").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= plan.support)
    total = rows.agg(
        *(F.sum(F.when(F.col("fold") == f, 1).otherwise(0)).alias(f"n_{f}") for f in range(plan.folds)),
        *(
            F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}")
            for c in categories
            for f in range(plan.folds)
        ),
    ).first()
    options = []
    for m in models:
        used = [f for f in range(plan.folds) if f != m]
        n = sum((F.col(f"n_{f}") for f in used), F.lit(0.0))
        whole = float(sum(total[f"n_{f}"] or 0 for f in used))
        for c in categories:
            a = sum((F.col(f"{c}_{f}") for f in used), F.lit(0.0))
            positive = float(sum(total[f"{c}_{f}"] or 0 for f in used))
            off = a * whole - n * positive
            spread = n * (whole - n) * positive * (whole - positive)
            chi2 = F.when(spread > 0, off * off * whole / spread).otherwise(0.0)
            options.append(F.struct(F.lit(m).alias("model"), F.lit(c).alias("category"), chi2.alias("chi2")))
    rated = seen.select("feature", F.explode(F.array(*options)).alias("o")).select("feature", "o.*")
    rated = rated.where(F.col("chi2") >= plan.least_chi2)
    return top_per_key(rated, ["model", "category"], [F.col("chi2").desc(), F.col("feature")], plan.features)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def regression(x: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    """Logistic regression by damped Newton steps; the last column of ``x`` is the intercept."""
    w = np.zeros(x.shape[1])
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    w[-1] = np.log(rate / (1 - rate))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * w * w).sum()

    now = loss(w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + penalty * w
        bend = (x * (p * (1 - p))[:, None]).T @ x
        bend[np.diag_indices_from(bend)] += penalty + 1e-9
        move = np.linalg.solve(bend, slope)
        size = 1.0
        while size > 1e-4 and (after := loss(w - size * move)) > now:
            size /= 2
        if size <= 1e-4:
            break
        w = w - size * move
        if now - after < 1e-6 * max(1.0, now):
            break
        now = after
    return w


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where predictions out of fold have the best F1: between the last one above and the first below."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[1:] == p[:-1]] = 0  # not between equal ones
    i = int(f1.argmax())
    below = p[i + 1] if i + 1 < len(p) else p[i] / 2
    return float(sigmoid((logit(p[i : i + 1]) + logit(np.array([below]))) / 2)[0])


def _trained(category: str, earlier: list[str], chosen, plan: Training):
    """A model per key: predictions for its own fold, or (the last one) the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "model"):
            models = table.column("model").to_numpy()
            for m in np.unique(models):
                own = table.filter(pa.array(models == m)).combine_chunks()
                names = np.sort(np.array(chosen.value.get((int(m), category), []), np.int64).view(np.uint64))
                lists = own.column("features").combine_chunks()
                flat = lists.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(len(own)), np.diff(lists.offsets.to_numpy()))
                x = np.zeros((len(own), len(names) + len(earlier) + 1))
                if len(names):
                    at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
                    hit = names[at] == flat
                    x[owner[hit], at[hit]] = 1
                for i, c in enumerate(earlier):
                    x[:, len(names) + i] = logit(own.column(f"p_{c}").to_numpy())
                x[:, -1] = 1
                y = own.column(category).to_numpy().astype(float)
                fold = own.column("fold").to_numpy()
                used = fold != m
                w = regression(x[used], y[used], plan.ridge, plan.steps)
                out = np.flatnonzero(~used)
                last = int(m) == plan.folds
                rid = own.column("rid").to_numpy()[out]
                p = sigmoid(x[out] @ w)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*rid.tolist(), *([-1] if last else [])], pa.int64()),
                        pa.array([*p.tolist(), *([0.0] if last else [])], pa.float64()),
                        pa.array([None] * len(out) + ([w.astype("<f8").tobytes()] if last else []), pa.binary()),
                    ],
                    names=["rid", "p", "weights"],
                )

    return run


def fit(
    docs: DataFrame, labels: DataFrame, categories: Mapping[str, str] = CATEGORIES, plan: Training = Training()
) -> list[Model]:
    """Train the chain on a bounded sample of labelled documents; one model per category."""
    spark = docs.sparkSession
    names = list(categories)
    flags = [F.expr(rule).cast("int").alias(c) for c, rule in categories.items()]
    known = labels.select(F.col("doc_id").alias("label_id"), *flags).where(
        " AND ".join(f"{c} IS NOT NULL" for c in ["label_id", *names])
    )
    total = known.count()
    draw = F.pmod(F.xxhash64("label_id"), F.lit(1 << 24)) / F.lit(float(1 << 24))
    known = known.where(draw < plan.sample / max(1, total)).dropDuplicates(["label_id"])
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(known), F.col("doc_id") == F.col("label_id")  # about plan.sample rows
    )
    rows = rows.select(
        F.monotonically_increasing_id().alias("rid"),
        F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(plan.folds)).cast("int").alias("fold"),
        *names,
        "text",
    )
    kinds = ", ".join(f"{c} int" for c in names)
    rows = stage(rows.mapInArrow(_featured(["rid", "fold", *names]), f"rid long, fold int, {kinds}, features array<long>"), "labelled")
    # At most (folds + 1) * categories * features rows.
    chosen: dict[tuple[int, str], list[int]] = {}
    for r in _screened(rows, names, plan).select("model", "category", "feature").collect():
        chosen.setdefault((r.model, r.category), []).append(r.feature)
    shared = spark.sparkContext.broadcast(chosen)
    kept = sorted({f for fs in chosen.values() for f in fs})
    union = spark.sparkContext.broadcast(np.array(kept, np.int64))

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            hit = np.isin(flat, union.value)
            ends = np.concatenate(([0], np.cumsum(hit)))[at - at[0]].astype(np.int32)
            short = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[hit]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names[:-1]), short], names=batch.schema.names
            )

    thin = stage(rows.mapInArrow(narrowed, rows.schema), "features")
    unstage(rows)
    every = F.explode(F.sequence(F.lit(0), F.lit(plan.folds))).alias("model")
    models, now = [], thin
    for i, c in enumerate(names):
        # The bounded sample once per model; each task trains one.
        out = stage(
            by_key(now.select("*", every), "model", _trained(c, names[:i], shared, plan), "rid long, p double, weights binary"),
            "fold_predictions",
        )
        found = out.where("weights IS NOT NULL").first()
        feature = np.sort(np.array(chosen.get((plan.folds, c), []), np.int64).view(np.uint64))
        if found:
            w = np.frombuffer(bytes(found.weights), "<f8")
        else:  # no usable label
            feature, w = feature[:0], np.append(np.zeros(i), -5.0)
        guessed = out.join(thin.select("rid", c), "rid").toPandas()  # the bounded sample
        threshold = best_threshold(guessed.p.to_numpy(), guessed[c].to_numpy())
        models.append(Model(feature, w[: len(feature)], float(w[-1]), w[len(feature) : -1], threshold))
        now = now.join(out.where("weights IS NULL").select("rid", F.col("p").alias(f"p_{c}")), "rid")
    return models


def score(texts: list[str | None], models: list[Model]) -> np.ndarray:
    """Probability of every category (columns) for each text (rows)."""
    feature, owner = present(texts)
    out = np.zeros((len(texts), len(models)))
    for i, model in enumerate(models):
        z = np.full(len(texts), model.intercept)
        if len(model.features):
            at = np.minimum(np.searchsorted(model.features, feature), len(model.features) - 1)
            hit = model.features[at] == feature
            pair = np.unique(owner[hit] * len(model.features) + at[hit])
            z += np.bincount(
                pair // len(model.features), model.weights[pair % len(model.features)], minlength=len(texts)
            )
        for j, w in enumerate(model.chain):
            z += w * logit(out[:, j])
        out[:, i] = sigmoid(z)
    return out


def classify(
    docs: DataFrame,
    labels: DataFrame,
    categories: Mapping[str, str] = CATEGORIES,
    plan: Training = Training(),
    threshold: float | None = None,
) -> DataFrame:
    """One row per document: doc_id, p_<category> for each category, toxic (the last one reaches ``threshold``).

    Without ``threshold`` it is the one with the best F1 on predictions out of fold.

    ``categories`` names conditions on the columns of ``labels`` in chain order.
    The chain is trained on a bounded sample of the labelled documents; every
    document's whole text is scored, with or without a label. Null and empty texts
    have no features and get the rate without any. Without usable labels all
    probabilities are near 0. Labels with nulls are left aside, repeated ones count
    once, other columns are not read.
    """
    names = list(categories)
    fitted = fit(docs, labels, categories, plan)
    least = fitted[-1].threshold if threshold is None else threshold
    models = docs.sparkSession.sparkContext.broadcast(fitted)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                p = score(piece.column("text").to_pylist(), models.value)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        *(pa.array(p[:, i]) for i in range(len(names))),
                        pa.array(p[:, -1] >= least),
                    ],
                    names=["doc_id", *(f"p_{c}" for c in names), "toxic"],
                )

    schema = f"doc_id {kind}, " + ", ".join(f"p_{c} double" for c in names) + ", toxic boolean"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
