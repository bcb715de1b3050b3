"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

DataFrame operations only.  Documents are counted into cells of (source, language, topic) with their tokens.  Raking
multiplies the cells' weights by target / current share along one marginal after the other, a fixed number of sweeps,
so that all three weighted marginals come to their targets.  A document's inclusion probability is its cell's factor,
scaled so that no probability is above ``ceiling``: sampling by it leaves the raked marginals in expectation, and no
document twice.  It is kept if a uniform hash of its id and a seed lies below the probability, so a rerun after a lost
executor keeps the same rows.

Targets: a table of (dim, value, share), or, without one, observed shares to the power of ``temper``, normalised: below
1 it lifts rare sources and lowers a source with a third of all rows.

Scale: the documents are aggregated once with partial aggregation to one row a cell, so a hot source is one row a task;
only the cells are raked, in a written table of one row a cell, and their factors are joined back to the documents by a
join that broadcasts only if Spark's size check allows.  No text is shuffled.

Defined results: null source, language or text are values of their own ('' as text); a document without tokens counts
as one token, so empty texts are sampled too; a null doc_id is sampled by its text; equal rows are sampled alike; a
target value that no document has is left out and the other shares of its marginal are scaled to 1; a marginal that the
targets don't name stays free; columns with
clashing names are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

DIMS = ("source", "lang", "topic")
# The topics' patterns, the first that matches names the topic.
TOPICS = (
    ("licence", r"(Licen[sc]ed? |licen[sc]ed under|rights reserved|Copyright|SPDX)"),
    ("contact", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]"),
    ("markup", r"[#$%&*][#$%&*][#$%&*]"),
    ("technical", r"(https?://|[0-9a-f]{24}|[A-Za-z_]+ *[=] *[A-Za-z0-9_]+;)"),
)
SWEEPS = 8


def _found(text: Column, pattern: str) -> Column:
    """text has a match of one of TOPICS' patterns.

    Whether there is a match does not hang on how far a run of characters before it reaches, so one character of the
    run will do: the search does not go through each word once from each of its letters.
    """
    return text.rlike(pattern.replace("[A-Za-z0-9._%+-]+@", "[A-Za-z0-9._%+-]@").replace("[A-Za-z_]+ *[=]", "[A-Za-z_] *[=]"))


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(_found(text, pattern), F.lit(name)).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """White-space tokens, 1 at least: spaces that begin a word are counted without making the words."""
    return F.greatest(F.size(F.split(F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " ")), " ")).cast("long"), F.lit(1).cast("long"))


def described(docs: DataFrame) -> DataFrame:
    """did, the three dimensions and tokens of each document, text left behind."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    did = F.coalesce(docs["doc_id"].cast("string"), F.sha2(text, 256))
    return docs.select(did.alias("did"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"), topic_of(text).alias("topic"), tokens_of(text).alias("tokens"))


def rake(cells: DataFrame, targets: DataFrame | None = None, temper: float = 0.85, sweeps: int = SWEEPS) -> DataFrame:
    """cells (source, lang, topic, tokens) with `factor`, their raked weight over their share of the tokens."""
    cells = written(cells, "cells")
    sides = {}
    # a marginal that the targets don't name, or of whose values no document has one, stays free
    named = DIMS if targets is None else [r[0] for r in targets.where(F.col("dim").isin(*DIMS)).select("dim").distinct().orderBy("dim").collect()]
    for dim in DIMS:
        own = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("have"))
        if targets is None:
            own = own.select(dim, F.pow("have", F.lit(temper)).alias("want"))
        else:
            wish = targets.where(F.col("dim") == dim).select(F.col("value").alias(dim), F.col("share").cast("double").alias("want"))
            own = own.join(wish, dim, "left").select(dim, F.coalesce("want", F.lit(0.0)).alias("want"))
        total = own.agg(F.sum("want").alias("all"))
        sides[dim] = written(own.crossJoin(F.broadcast(total)).select(dim, F.try_divide(F.col("want"), F.col("all")).alias("want")), f"target-{dim}")  # total is one row
    total = cells.agg(F.sum("tokens").cast("double").alias("all_tokens"))
    now = cells.crossJoin(F.broadcast(total)).select(*DIMS, "tokens", (F.col("tokens") / F.col("all_tokens")).alias("share"), (F.col("tokens") / F.col("all_tokens")).alias("weight"))
    for dim in DIMS:  # the targets once, so that a sweep joins only the sums
        now = now.join(sides[dim].withColumnRenamed("want", f"want_{dim}"), dim)
    now = written(now, "raked")
    for sweep in range(sweeps):
        for dim in (d for d in DIMS if d in named):
            side = now.groupBy(dim).agg(F.sum("weight").alias("sum_weight"))
            weight = F.when(F.col(f"want_{dim}").isNull(), F.col("weight")).when(F.col("sum_weight") > 0, F.col("weight") * F.col(f"want_{dim}") / F.col("sum_weight")).otherwise(F.lit(0.0))
            now = now.join(side, dim).select(*DIMS, "tokens", "share", *(f"want_{d}" for d in DIMS), weight.alias("weight"))
        now = written(now, f"raked-{sweep}")
    return now.select(*DIMS, "tokens", (F.col("weight") / F.col("share")).alias("factor"))


def chance(did: Column, seed: str) -> Column:
    """Uniform in [0, 1) from 52 bits of the hash of seed and id."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), did), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def cell_probabilities(rows: DataFrame, targets: DataFrame | None = None, temper: float = 0.85, ceiling: float = 1.0, sweeps: int = SWEEPS) -> DataFrame:
    """(source, lang, topic, probability), a written table of one row a cell; its known size lets Spark decide on a broadcast."""
    factors = written(rake(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), targets, temper, sweeps), "factors")
    top = factors.agg(F.max("factor").alias("top"))
    return written(factors.crossJoin(F.broadcast(top)).select(*DIMS, F.round(F.col("factor") / F.col("top") * ceiling, 9).alias("probability")), "probabilities")  # top is one row


def probabilities(docs: DataFrame, seed: str = "mix", **settings) -> DataFrame:
    """did, dimensions, tokens, probability and kept of every document."""
    rows = written(described(docs), "described")
    return rows.join(cell_probabilities(rows, **settings), list(DIMS)).withColumn("kept", chance(F.col("did"), seed) < F.col("probability")).select("did", *DIMS, "tokens", "probability", "kept")


def mix(docs: DataFrame, seed: str = "mix", **settings) -> DataFrame:
    """The sampled documents, columns as they are, and `probability` (`mix_probability` where docs has such a column)."""
    cells = cell_probabilities(described(docs), **settings).select(F.struct(*DIMS).alias("cell"), F.col("probability").alias("p"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    did = F.coalesce(docs["doc_id"].cast("string"), F.sha2(text, 256))
    cell = F.struct(F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"), topic_of(text).alias("topic"))
    # a document's own columns are one struct, so none of their names can clash
    out = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), cell.alias("cell"), chance(did, seed).alias("u")).join(cells, "cell")
    name = "probability" if "probability" not in docs.columns else "mix_probability"
    return out.where("u < p").select(*(F.col("row").getField(c).alias(c) for c in docs.columns), F.col("p").alias(name))


def oracle(table: str = "documents", temper: float = 0.85, sweeps: int = SWEEPS, seed: str = "mix") -> str:
    """DuckDB SQL for probabilities()."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in TOPICS) + " ELSE 'prose' END"
    ctes = [
        f"docs AS (SELECT coalesce(doc_id::VARCHAR, sha256(coalesce(text, ''))) AS did, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM {table})",
        rf"described AS (SELECT did, source, lang, {topic} AS topic, greatest(len(string_split(trim(regexp_replace(t, '[\x09-\x0D\x20]+', ' ', 'g'), ' '), ' ')), 1)::BIGINT AS tokens FROM docs)",
        "r0 AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens, (sum(tokens) / sum(sum(tokens)) OVER ())::DOUBLE AS share, (sum(tokens) / sum(sum(tokens)) OVER ())::DOUBLE AS weight FROM described GROUP BY ALL)",
    ]
    for dim in DIMS:
        ctes.append(f"t_{dim} AS (SELECT {dim}, pow(sum(tokens)::DOUBLE, {temper}) / sum(pow(sum(tokens)::DOUBLE, {temper})) OVER () AS want FROM r0 GROUP BY {dim})")
    k = 0
    for _ in range(sweeps):
        for dim in DIMS:
            ctes.append(f"r{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, share, weight * want / sum(weight) OVER (PARTITION BY {dim}) AS weight FROM r{k} JOIN t_{dim} USING ({dim}))")
            k += 1
    ctes.append(f"p AS (SELECT source, lang, topic, round(weight / share / max(weight / share) OVER (), 9) AS probability FROM r{k})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT did, source, lang, topic, tokens, probability, (('0x' || sha256('{seed}:' || did)[1:13])::BIGINT::DOUBLE / {1 << 52}.0) < probability AS kept FROM described JOIN p USING (source, lang, topic)"
