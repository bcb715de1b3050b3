"""Preference data drawn from the test tables, as DataFrames and as the DuckDB relations that match them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import table

WITH_PAIRS = """
turns AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS reply, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
asked AS (SELECT conv_id * 1000 + turn AS pair_id, text AS prompt, reply AS chosen FROM turns WHERE role = 'user' AND next_role = 'assistant'),
pairs AS (SELECT * FROM (SELECT pair_id, prompt, chosen, lead(chosen) OVER (PARTITION BY pair_id // 1000 % 16 ORDER BY pair_id) AS rejected FROM asked) WHERE rejected IS NOT NULL)"""
WITH_INSTRUCTIONS = """
instructions AS (SELECT min(conv_id * 1000 + turn) AS prompt_id, text AS system_prompt FROM conversations WHERE role = 'system' GROUP BY text)"""
WITH_ROLES = """
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
prompts AS (SELECT vec_id AS prompt_id, e FROM u WHERE vec_id % 3 = 0),
dirs AS (SELECT c.vec_id // 3 AS pair_id, list_transform(list_zip(c.e, r.e), lambda z: z[1] - z[2]) AS d FROM u c JOIN u r ON c.vec_id % 3 = 1 AND r.vec_id = c.vec_id + 1)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, prompt, chosen, rejected): a user's turn, its reply, and the reply to another turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("reply", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    asked = turns.where("role = 'user' AND next_role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("prompt"), F.col("reply").alias("chosen"))
    other = F.lead("chosen").over(Window.partitionBy(F.floor(F.col("pair_id") / 1000) % 16).orderBy("pair_id"))
    return asked.withColumn("rejected", other).where("rejected IS NOT NULL")


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, system_prompt): distinct system turns."""
    systems = table(spark, sf_dir, "conversations").where("role = 'system'")
    return systems.groupBy(F.col("text").alias("system_prompt")).agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, category, trait): traits by category, with repeats."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_type").alias("category"), F.col("p_name").alias("trait"))


def vector_roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Instructions (prompt_id, e) and directions (pair_id, d) from the embeddings, by vec_id modulo 3."""
    from ..operators.vectors import direction, normalized

    e = table(spark, sf_dir, "embeddings")
    prompts = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("prompt_id"), normalized(F.col("embedding")).alias("e"))
    chosen = e.where("vec_id % 3 = 1").select(F.floor(F.col("vec_id") / 3).alias("pair_id"), F.col("embedding").alias("c"))
    rejected = e.where("vec_id % 3 = 2").select(F.floor(F.col("vec_id") / 3).alias("pair_id"), F.col("embedding").alias("r"))
    return prompts, chosen.join(rejected, "pair_id").select("pair_id", direction(F.col("c"), F.col("r")).alias("d"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, system_row, response_col, target): observed cells of a supplier by part matrix, with repeats."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry_id"), F.col("l_suppkey").alias("system_row"), F.col("l_partkey").alias("response_col"), F.col("l_extendedprice").alias("target"))
