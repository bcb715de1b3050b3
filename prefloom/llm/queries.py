"""The queries of the corpus operators, with the parameters meant for whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontam, licenses, line_dedup, maxent_lm, mixing, neardup, phrases, quality, secrets, toxicity, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op4_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.probabilities(table(spark, sf_dir, "documents"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(table(spark, sf_dir, "documents"), radius=None)


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).drop("tk", "root")


def op9_onebit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"))


def op11_suffix_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.report(table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op13_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_benchmark_leaks, op2_line_quality, op3_secret_ledger, op4_raked_mixture, op5_warc_derivatives, op6_toxicity, op7_fuzzy_lines, op8_dart_minhash, op9_onebit_neighbours, op10_maxent_scores,
                                    op11_suffix_phrases, op12_license_scan, op13_lobpcg_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_ledger": secrets.oracle(), "op4_raked_mixture": mixing.oracle(), "op11_suffix_phrases": phrases.oracle()}
