"""Running candidate scores: sums of every candidate over a stream of scored pairs, with posteriors after each batch.

The sums are a stateful aggregate of Structured Streaming: its state, one row a candidate, is in the checkpoint and goes on
after a restart.  After each batch the scores so far are written as a table of their own, named by the batch's number, so a
replayed batch replaces its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scores


def candidate_sums(rows: DataFrame, candidate: str = "prompt_id") -> DataFrame:
    """score_sum, raw_score_sum, preference_logprob_sum and num_examples of each candidate, from (candidate, margin, length); for batches and streams."""
    m = F.col("margin")
    return rows.groupBy(candidate).agg(F.sum(m / F.greatest("length", F.lit(1))).alias("score_sum"), F.sum(m).alias("raw_score_sum"), F.sum(scores.log_sigmoid(m)).alias("preference_logprob_sum"), F.count(F.lit(1)).alias("num_examples"))


def candidate_totals(parts: DataFrame, candidate: str = "prompt_id") -> DataFrame:
    """candidate_sums() from sums over parts of the rows, as scorer.margin_sums() gives them; for batches and streams."""
    return parts.groupBy(candidate).agg(*(F.sum(c).alias(c) for c in ("score_sum", "raw_score_sum", "preference_logprob_sum", "num_examples")))


def with_posteriors(sums: DataFrame) -> DataFrame:
    """The sums with the mean score and the posteriors by sum and by mean over the candidates."""
    out = sums.withColumn("score_mean", F.col("score_sum") / F.greatest("num_examples", F.lit(1)))
    return scores.with_posterior(scores.with_posterior(out, "score_sum"), "score_mean", "mean_posterior")


def run(stream: DataFrame, path: str, checkpoint: str, candidate: str = "prompt_id", sums=candidate_sums, **trigger):
    """A streaming query over (candidate, margin, length), or what else `sums` adds up to candidate_sums(), that writes the scores so far to path/batch=N after batch N.

    trigger goes to the query, by default what is there now, batch by batch, and then the end.
    """

    def step(found: DataFrame, number: int) -> None:
        found = found.persist()  # one row a candidate
        with_posteriors(found).write.mode("overwrite").parquet(f"{path}/batch={number}")
        found.unpersist()

    out = sums(stream, candidate).writeStream.outputMode("complete").foreachBatch(step)
    return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def batches(spark: SparkSession, path: str, least: int = 1 << 24) -> int:
    """Batches that a table at path is read in: two to eight, of `least` bytes or more where there are more than two, as each has its cost."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(fs_path).getLength()
    return min(max(2, size // least), 8)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The scores after the last batch."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()[6:]) for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("batch=")]
    return spark.read.parquet(f"{path}/batch={max(done)}")
