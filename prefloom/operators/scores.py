"""Margins, posteriors, and the fit metrics of predicted against true scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_sigmoid(m: Column) -> Column:
    """ln(1 / (1 + e^-m)) without overflow on either side."""
    return F.when(m >= 0, -F.log1p(F.exp(-m))).otherwise(m - F.log1p(F.exp(m)))


def length_normalized(margin: Column, length: Column) -> Column:
    return margin / F.greatest(length, F.lit(1))


def normalized_once(df: DataFrame, margin: str, length: str, mark: str, force: bool = False) -> DataFrame:
    """`score` and `raw_margin` as columns of their own; rows marked as normalised keep their score."""
    done = F.lit(False) if force else F.coalesce(F.col(mark) == "length", F.lit(False))
    return df.withColumn("raw_margin", F.col(margin)).withColumn("score", F.when(done, F.col(margin)).otherwise(length_normalized(F.col(margin), F.col(length))))




def with_posterior(df: DataFrame, score: str, out: str = "posterior") -> DataFrame:
    """Softmax of `score` over all rows: two one-row aggregates instead of a window without partitions."""
    top = df.agg(F.max(score).alias("__top"))
    shifted = df.crossJoin(F.broadcast(top)).withColumn("__e", F.exp(F.col(score) - F.col("__top")))  # one row
    total = shifted.agg(F.sum("__e").alias("__sum"))
    return shifted.crossJoin(F.broadcast(total)).withColumn(out, F.col("__e") / F.col("__sum")).drop("__top", "__e", "__sum")


def with_share(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    total = df.agg(F.sum(value).alias("__sum"))
    ok = F.when(F.col("__sum") <= 0, F.raise_error(F.lit("the total is not positive"))).otherwise(F.col("__sum"))
    return df.crossJoin(F.broadcast(total)).withColumn(out, F.col(value) / ok).drop("__sum")


def with_z_score(df: DataFrame, value: str, out: str = "z") -> DataFrame:
    stats = df.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, F.when(F.col("__s") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(value) - F.col("__m"), F.col("__s")))).drop("__m", "__s")


def summary(score: str, prefix: str = "score") -> list[Column]:
    c = F.col(score)
    return [F.avg(c).alias(f"mean_{prefix}"), F.stddev_pop(c).alias(f"std_{prefix}"), F.sum(c).alias(f"sum_{prefix}"), F.min(c).alias(f"min_{prefix}"), F.max(c).alias(f"max_{prefix}"), F.count(c).alias("num_examples")]


def fit_metrics(true: str, pred: str) -> list[Column]:
    """mse, rmse, mae, r2 (null where the truth is constant), sign and preference accuracy, means, n."""
    t, p = F.col(true), F.col(pred)
    e = p - t
    sst = F.var_pop(t) * F.count(t)
    return [
        F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.when(sst > 0, 1 - F.sum(e * e) / F.when(sst > 0, sst)).alias("r2"),
        F.avg(((p < 0) == (t < 0)).cast("double")).alias("sign_accuracy"), F.avg(((p > 0) == (t > 0)).cast("double")).alias("preference_accuracy"),
        F.avg(t).alias("mean_true"), F.avg(p).alias("mean_pred"), F.count(F.lit(1)).alias("n"),
    ]


def agreement(true: str, pred: str) -> list[Column]:
    """rmse, mae, bias, r2 and correlation (null where either side is constant)."""
    t, p = F.col(true), F.col(pred)
    e = p - t
    sst = F.var_pop(t) * F.count(t)
    spread = F.stddev_pop(t) * F.stddev_pop(p)
    return [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.when(sst > 0, 1 - F.sum(e * e) / F.when(sst > 0, sst)).alias("r2"), F.when(spread > 0, F.covar_pop(t, p) / F.when(spread > 0, spread)).alias("corr"), F.count(F.lit(1)).alias("n")]


def error_bar(std: Column, n: Column, kind: str = "sem") -> Column:
    return std if kind == "std" else F.when(n > 0, std / F.sqrt(n.cast("double"))).otherwise(F.lit(0.0))


def exact_and_approx(mark: Column, score: Column, exact: Column, approx: Column, length: Column) -> tuple[Column, Column]:
    """Scores of a row on one scale: by length where the row is marked so, else the margins as they are; a stored exact score counts first."""
    by_length = F.coalesce(mark, F.lit(False))
    n = F.greatest(length, F.lit(1))
    return F.coalesce(score, F.when(by_length, exact / n).otherwise(exact)), F.when(by_length, approx / n).otherwise(approx)


def pair_length(length: Column, chosen_length: Column, rejected_length: Column, chosen: Column, rejected: Column) -> Column:
    """The length that a pair's scores are divided by: stored, else the sum of the stored lengths of both sides, else by words; 1 at least."""
    from ..functions.text import pair_word_length

    return F.greatest(F.coalesce(length.cast("long"), chosen_length.cast("long") + rejected_length.cast("long"), pair_word_length(chosen, rejected).cast("long")), F.lit(1))


def mean_probability(logprob: Column, tokens: Column) -> Column:
    """exp of the mean log-probability a token; null without tokens."""
    return F.exp(F.try_divide(logprob, F.when(tokens > 0, tokens)))
