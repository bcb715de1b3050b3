"""Queries of the relational operators around scores: catalogues, dictionaries, lookups, splits, and plot data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import scores, select
from ..sources.tables import table
from . import fixtures

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_TRAIT = """regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g'), '^["''`]+|["''`]+$', '', 'g'), '[.!?]+$', '')"""
_C = "c AS (SELECT p_partkey AS pos, p_type AS category, p_name AS trait FROM part)"


@query(f"WITH {_C}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY pos) AS k FROM c) SELECT pos, category, trait FROM r WHERE k <= 5")
def prompts_per_category(spark, sf_dir):
    return select.first_per_group(fixtures.catalog(spark, sf_dir), "category", 5)


@query(f"WITH {_C} SELECT lower(trim(trait)) AS trait_normalized, min(pos) AS pos, arg_min(category, pos) AS category FROM c GROUP BY 1")
def first_seen_dedup(spark, sf_dir):
    c = fixtures.catalog(spark, sf_dir).withColumn("trait_normalized", text.canonical_word(F.col("trait")))
    return select.first_seen(c, "trait_normalized").select("trait_normalized", "pos", "category")


@query(f"WITH {_C}, u AS (SELECT 0 AS prio, pos, category, trait FROM c WHERE pos % 2 = 0 UNION ALL SELECT 1, pos, category, trait FROM c WHERE pos % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY category, {_TRAIT.format('trait')} ORDER BY prio, pos) AS k FROM u) SELECT category, trait, prio, pos FROM r WHERE k = 1")
def traits_union(spark, sf_dir):
    """Original traits before generated ones, one row of each normalised key in a category."""
    c = fixtures.catalog(spark, sf_dir)
    u = c.where("pos % 2 = 0").withColumn("prio", F.lit(0)).unionByName(c.where("pos % 2 = 1").withColumn("prio", F.lit(1))).withColumn("norm", text.normalize_trait(F.col("trait")))
    return select.first_seen(u.withColumn("at", F.struct("prio", "pos")), ["category", "norm"], "at").select("category", "trait", "prio", "pos")


@query("WITH t AS (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text), i AS (SELECT text, row_number() OVER (ORDER BY first_id) - 1 AS idx FROM t) SELECT sha256(text) AS text_id, idx FROM i")
def dictionary_encode(spark, sf_dir):
    d = select.dictionary(table(spark, sf_dir, "documents").select("text", F.col("doc_id").alias("pos")), "text")
    return d.select(text.text_id(F.col("text")).alias("text_id"), F.col("idx").cast("long").alias("idx"))


@query("WITH t AS (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text), i AS (SELECT text, row_number() OVER (ORDER BY first_id) - 1 AS idx FROM t) SELECT doc_id, idx FROM documents JOIN i USING (text)")
def index_gather(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    d = select.dictionary(docs.select("text", F.col("doc_id").alias("pos")), "text")
    return docs.join(d, "text").select("doc_id", F.col("idx").cast("long").alias("idx"))


@query("WITH k AS (SELECT doc_id AS k FROM documents) SELECT k, coalesce(a.quality, b.toxic) AS v, CASE WHEN a.quality IS NOT NULL THEN 'first' WHEN b.toxic IS NOT NULL THEN 'second' ELSE 'none' END AS found FROM k LEFT JOIN (SELECT * FROM labels WHERE doc_id % 2 = 0) a ON k = a.doc_id LEFT JOIN labels b ON k = b.doc_id")
def two_source_lookup(spark, sf_dir):
    k = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"))
    labels = table(spark, sf_dir, "labels")
    return select.two_source_lookup(k, labels.where("doc_id % 2 = 0").select(F.col("doc_id").alias("k"), F.col("quality").alias("v")), labels.select(F.col("doc_id").alias("k"), F.col("toxic").alias("v")), "k", "v")


_T = "t AS (SELECT 0 AS block, conv_id * 1000 + turn AS pos, text FROM conversations WHERE role = 'system' UNION ALL SELECT 1, conv_id * 1000 + turn, text FROM conversations WHERE role = 'user' UNION ALL SELECT 2, conv_id * 1000 + turn, text FROM conversations WHERE role = 'assistant')"


def _texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    parts = [c.where(F.col("role") == role).select(F.lit(k).alias("block"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text") for k, role in enumerate(("system", "user", "assistant"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_T} SELECT * FROM t")
def texts_union(spark, sf_dir):
    return _texts(spark, sf_dir)


@query(f"WITH {_T} SELECT sha256(text) AS text_id FROM t WHERE block <> 0 AND pos % 2 = 1 EXCEPT SELECT sha256(text) FROM t WHERE pos % 2 = 0")
def missing_texts(spark, sf_dir):
    """Distinct response texts that are not embedded yet."""
    t = _texts(spark, sf_dir).withColumn("text_id", text.text_id(F.col("text")))
    return t.where("block != 0 AND pos % 2 = 1").select("text_id").distinct().join(t.where("pos % 2 = 0").select("text_id"), "text_id", "left_anti")


@query(f"WITH {_C}, d AS (SELECT DISTINCT {_TRAIT.format('trait')} AS key, category FROM c WHERE pos % 4 = 0) SELECT pos, trait FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.category = c.category AND d.key = {_TRAIT.format('c.trait')})")
def pending_traits(spark, sf_dir):
    """Traits of a category that are not done yet, by their normalised form."""
    c = fixtures.catalog(spark, sf_dir).withColumn("key", text.normalize_trait(F.col("trait")))
    return c.join(c.where("pos % 4 = 0").select("category", "key").distinct(), ["category", "key"], "left_anti").select("pos", "trait")


@query("WITH x AS (SELECT n_nationkey::BIGINT AS pos, n_name AS name FROM nation), e AS (SELECT 100::BIGINT AS pos, 'ATLANTIS' AS name UNION ALL SELECT 101, (SELECT min(name) FROM x)) SELECT * FROM x UNION ALL SELECT * FROM e WHERE name NOT IN (SELECT name FROM x)")
def append_extras(spark, sf_dir):
    """A literal row is added, one whose name is there already is not."""
    x = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("name"))
    extra = spark.createDataFrame([(100, "ATLANTIS")], "pos long, name string").unionByName(x.agg(F.min("name").alias("name")).select(F.lit(101).cast("long").alias("pos"), "name"))
    return select.append_if_absent(x, extra, "name")


@query("SELECT l_orderkey, l_linenumber, 'chosen' AS side, round(l_extendedprice / greatest(l_quantity, 1), 6) AS signed FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'rejected', round(-l_discount / greatest(l_quantity, 1), 6) FROM lineitem")
def signed_entry_scores(spark, sf_dir):
    """Two entries a row, the rejected one negative, by length."""
    li = table(spark, sf_dir, "lineitem")
    long = li.select("l_orderkey", "l_linenumber", "l_quantity", F.expr("stack(2, 'chosen', l_extendedprice, 'rejected', -l_discount) AS (side, value)"))
    return long.select("l_orderkey", "l_linenumber", "side", F.round(scores.length_normalized(F.col("value"), F.col("l_quantity")), 6).alias("signed"))


_H = "sha256('7:' || {0})"


@query(f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_H.format('o_orderkey')}) AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN r <= least(greatest(round_even(n * 0.2, 0), 1), n - 1) THEN 'eval' ELSE 'train' END AS split FROM r")
def hash_split(spark, sf_dir):
    return select.fraction_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.2, 7)


@query(f"WITH {_C}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_H.format('pos')}, pos) AS k, count(*) OVER (PARTITION BY category) AS n FROM c) SELECT pos, category, CASE WHEN k = 1 AND n > 1 THEN 'eval' ELSE 'train' END AS split FROM r")
def per_category_holdout(spark, sf_dir):
    return select.group_holdout(fixtures.catalog(spark, sf_dir), "category", "pos", 7).select("pos", "category", "split")


@query(f"WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY {_H.format('c_custkey')}) AS r FROM customer) SELECT c_custkey, CASE WHEN r <= 100 THEN 'train' ELSE 'eval' END AS split FROM r WHERE r <= 140")
def fixed_count_split(spark, sf_dir):
    return select.count_split(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 100, 40, 7)


@query(f"WITH {_C}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_H.format('pos')}, pos) AS k FROM c) SELECT pos, category FROM r WHERE k <= 3")
def balanced_sample(spark, sf_dir):
    return select.balanced_sample(fixtures.catalog(spark, sf_dir), "category", "pos", 3, 7).select("pos", "category")


@query(f"SELECT c_custkey FROM customer ORDER BY {_H.format('c_custkey')}, c_custkey LIMIT 50")
def seeded_sample(spark, sf_dir):
    return select.sample(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 50, 7)


@query("SELECT o_orderkey AS name, round(max(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) - max(CASE WHEN l_linenumber = 2 THEN l_extendedprice END), 2) AS margin, round(sum(CASE WHEN l_linenumber <= 2 THEN l_quantity END), 2) AS tokens FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber <= 2 GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 2")
def triplet_margin_pivot(spark, sf_dir):
    """The two roles of a triplet beside each other; incomplete ones are left out."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    rows = li.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    wide = rows.groupBy(F.col("l_orderkey").alias("name")).pivot("l_linenumber", [1, 2]).agg(F.max("l_extendedprice").alias("lp"), F.sum("l_quantity").alias("n"))
    return wide.where("`1_lp` IS NOT NULL AND `2_lp` IS NOT NULL").select("name", F.round(F.col("1_lp") - F.col("2_lp"), 2).alias("margin"), F.round(F.col("1_n") + F.col("2_n"), 2).alias("tokens"))


@query(f"WITH {_C}, r AS (SELECT *, row_number() OVER (PARTITION BY trait ORDER BY pos) AS k FROM c) SELECT pos, CASE WHEN k > 1 THEN trait || '_' || k ELSE trait END AS trait FROM r")
def uniquify_names(spark, sf_dir):
    return select.unique_names(fixtures.catalog(spark, sf_dir), "trait").select("pos", "trait")


_S = "s AS (SELECT c_custkey AS id, round(c_acctbal, 2) AS score, row_number() OVER (ORDER BY round(c_acctbal, 2) DESC, c_custkey) AS rank FROM customer)"


@query(f"WITH {_S} SELECT * FROM s WHERE rank <= 20 OR id = 7")
def topk_with_target(spark, sf_dir):
    """The first twenty, and the target row wherever it is."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round("c_acctbal", 2).alias("score"))
    return select.with_rank(c, [F.col("score").desc(), F.col("id").asc()]).where("rank <= 20 OR id = 7")


@query(r"WITH p AS (SELECT p_partkey AS pos, regexp_replace(p_name, '\s+', ' ', 'g') AS prompt, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size END AS rank FROM part WHERE p_name <> ''), f AS (SELECT prompt, min(coalesce(rank, 'inf'::DOUBLE) * 1e9 + pos) AS k FROM p GROUP BY 1) SELECT prompt FROM f ORDER BY k LIMIT 10")
def topk_unique_prompts(spark, sf_dir):
    """The first ten distinct prompts by rank; rows without a rank come last."""
    p = table(spark, sf_dir, "part").where("p_name != ''").select(text.normalize_label(F.col("p_name")).alias("prompt"), (F.coalesce(F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("double")), F.lit(float("inf"))) * 1e9 + F.col("p_partkey")).alias("k"))
    return p.groupBy("prompt").agg(F.min("k").alias("k")).orderBy("k").limit(10).select("prompt")


@query(r"""WITH p AS (SELECT p_partkey AS pos, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS prompt, CASE WHEN p_size % 10 = 0 THEN 'inf'::DOUBLE ELSE p_size END AS rank FROM part WHERE p_partkey % 5 <> 0),
f AS (SELECT prompt, min({'rank': rank, 'pos': pos}) AS k FROM p WHERE prompt <> '' GROUP BY 1) SELECT prompt, k.rank AS rank, row_number() OVER (ORDER BY k.rank, k.pos) AS place FROM f QUALIFY place <= 10""")
def top_prompts_without_literals(spark, sf_dir):
    """The first ten distinct prompts by rank; literal rows are skipped, and fewer than ten would be an error."""
    source = F.when(F.col("p_partkey") % 5 == 0, "literal").when(F.col("p_partkey") % 5 == 1, F.lit(None)).otherwise("traits")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit(" "), "p_name", F.lit("  ")).alias("prompt"), F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("rank"), source.alias("source"))
    return select.top_prompts(rows, 10).withColumn("place", F.col("place").cast("long"))


@query("SELECT DISTINCT o_custkey, c_mktsegment AS segment FROM orders JOIN customer ON c_custkey = o_custkey")
def consistent_columns(spark, sf_dir):
    """The one value of every key, checked: a key with two would be an error."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return select.consistent(o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_custkey", F.col("c_mktsegment").alias("segment")), "o_custkey", "segment")


@query("WITH a AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS pos, s_name AS name FROM supplier), b AS (SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS pos, s_suppkey AS supplier FROM supplier) SELECT pos, name, supplier FROM a JOIN b USING (pos)")
def strict_zip(spark, sf_dir):
    """Two lists of equal length side by side."""
    s = table(spark, sf_dir, "supplier")
    a = select.with_rank(s.select("s_suppkey", F.col("s_name").alias("name")), [F.col("s_suppkey").asc()], "pos").select("pos", "name")
    b = select.with_rank(s.select("s_acctbal", F.col("s_suppkey").alias("supplier")), [F.col("s_acctbal").desc(), F.col("supplier").asc()], "pos").select("pos", "supplier")
    return select.zipped(a, b).select(F.col("pos").cast("long").alias("pos"), "name", "supplier")


@query(r"""SELECT c.conv_id, c.turn, greatest(CASE WHEN c.turn % 3 = 0 THEN c.turn - 3 WHEN c.turn % 3 = 1 THEN 2 * c.turn
ELSE greatest(len(list_filter(regexp_split_to_array(text, '[\s\x1c-\x1f]+'), lambda w: w <> '')), 1) + greatest(len(list_filter(regexp_split_to_array(role, '[\s\x1c-\x1f]+'), lambda w: w <> '')), 1) END, 1)::BIGINT AS length FROM conversations c""")
def score_lengths(spark, sf_dir):
    """Lengths of pairs by what a row holds: its length, the lengths of its sides, or its texts."""
    t = F.col("turn")
    given, each = F.when(t % 3 == 0, t - 3), F.when(t % 3 == 1, t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scores.pair_length(given, each, each, F.col("text"), F.col("role")).alias("length"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(CASE WHEN count(*) > 0 THEN stddev_pop(value) / sqrt(count(*)) ELSE 0 END, 6) AS sem, count(*)::BIGINT AS n FROM events GROUP BY 1")
def sem_errorbars(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n"))
    return a.select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(scores.error_bar(F.col("std"), F.col("n")), 6).alias("sem"), "n")


@query("SELECT event_type, round(sum(value) / sum(sum(value)) OVER (), 8) AS share FROM events GROUP BY 1")
def share_of_total(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("v"))
    return scores.with_share(a, "v").select("event_type", F.round("share", 8).alias("share"))


@query("SELECT label, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, round(sum(score), 2) AS sum_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, count(*)::BIGINT AS num_examples FROM (SELECT event_type AS label, value AS score FROM events) GROUP BY 1")
def score_summary(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(*scores.summary("value"))
    return a.select("label", F.round("mean_score", 6).alias("mean_score"), F.round("std_score", 6).alias("std_score"), F.round("sum_score", 2).alias("sum_score"), F.round("min_score", 6).alias("min_score"), F.round("max_score", 6).alias("max_score"), "num_examples")


@query("SELECT conv_id, turn, text, copy::INT AS copy FROM conversations, range(1, 4) r(copy) WHERE role = 'assistant'")
def inflate_rows(spark, sf_dir):
    return select.inflated(table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text"), 3)


@query("SELECT p_type AS category, count(*)::BIGINT AS expected, count(DISTINCT p_name)::BIGINT AS distinct_traits, count(*) FILTER (p_retailprice IS NULL)::BIGINT AS skipped FROM part GROUP BY 1")
def run_counters(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("expected"), F.count_distinct("p_name").alias("distinct_traits"), F.count_if(F.col("p_retailprice").isNull()).alias("skipped"))


@query("SELECT o_custkey AS id, arg_max(o_orderkey, o_totalprice) AS best FROM orders GROUP BY 1")
def argmax_candidate(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderkey", "o_totalprice").alias("best"))
