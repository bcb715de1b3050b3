"""Bounded samples of labelled documents, and the small models both classifiers end in."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, released, text_steps

#: Longer texts are not fitted on (they are scored whole), so that a sample's size is bounded.
LONGEST_FITTED = 100_000
FOLDS, FOLD = 4, 2


def usable_labels(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y) of every label that may be fitted on: not null, not held out, of a document that is there."""
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[column].cast("int").alias("y")).where("doc_id is not null and y is not null")
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y")).where(~held_out(F.col("doc_id"), FOLDS, FOLD))
    have = docs.select(docs["doc_id"].cast("long").alias("doc_id")).where(F.length(docs["text"]) <= LONGEST_FITTED)
    return rows.join(have, "doc_id", "left_semi")


def class_share(docs: DataFrame, labels: DataFrame, column: str) -> float:
    """The positive class's share of all usable labels, whatever the sample holds of each."""
    share = usable_labels(docs, labels, column).agg(F.avg((F.col("y") > 0).cast("double"))).first()[0]
    return 0.0 if share is None else float(share)


def at_share(model, y: np.ndarray, share: float):
    """The fitted logistic function with its intercept moved from the class shares of y to `share`."""
    mean, scale, w = model
    have = y.mean()
    if not 0 < have < 1 or not 0 < share < 1:
        return model
    w = w.copy()
    w[-1] += np.log(share / (1 - share)) - np.log(have / (1 - have))
    return mean, scale, w


def sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most per_class documents of each class, none held out, in an order by a hash of the id.

    Ids are chosen from the labels alone, so no text moves but those of the sample.  A doc_id that repeats in the labels
    counts with its largest label; null ids and null labels are not used.
    """
    rows = usable_labels(docs, labels, column)
    order = F.xxhash64(F.lit("fit"), "doc_id")
    chosen = rows.where("y > 0").orderBy(order, "doc_id").limit(per_class).unionByName(rows.where("y <= 0").orderBy(order, "doc_id").limit(per_class))
    ids = {r[0]: int(r[1] > 0) for r in chosen.collect()}  # at most 2 * per_class
    if not ids:
        return [], np.zeros(0, int)
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where(F.length("text") <= LONGEST_FITTED)
    got = texts.join(few, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(order, "doc_id").collect()
    return [r[1] for r in got], np.array([ids[r[0]] for r in got], int)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method on standardised features: (mean, scale, weights with the intercept last)."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        d = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w += d * min(1.0, 5.0 / max(np.abs(d).max(), 1e-12))
        if np.abs(d).max() < 1e-7:
            break
    return mean, scale, w


def logistic(model, x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30)))


def scored(docs: DataFrame, score_texts, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents; score_texts maps an Arrow array of texts to scores."""
    @released
    def run(batches):
        import pyarrow as pa

        for batch in text_steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(batch.column("text")), pa.float64())], ["doc_id", "score"])

    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
