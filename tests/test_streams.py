"""The score cache under replay, crashes and concurrency; running scores after a restart; numbered lines of split files."""

import json

import numpy as np
from pyspark.sql import functions as F

from prefloom.sources import tables
from prefloom.streaming import cache, running

PAIR = "pair_id long, prompt string, chosen string, rejected string"


def score(df):
    return df.select("key", F.col("system_prompt").alias("s"), F.col("prompt").alias("p"), F.col("chosen").alias("r_plus"), F.col("rejected").alias("r_minus"), F.lit(-1.0).alias("chosen_logprob"), F.lit(-2.0).alias("rejected_logprob"), F.lit(1.0).alias("raw_margin"), F.lit("m").alias("model"))


def pairs(spark, ids):
    return spark.createDataFrame([(i, f"p{i}", "c", "r") for i in ids], PAIR)


def test_cache_replays_and_compacts(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "s1"), (2, "s2")], "prompt_id long, system_prompt string")
    path = f"file://{tmp_path}/cache"
    rows = lambda ids: cache.grid(prompts, pairs(spark, ids))
    assert cache.fill(rows(range(5)), path, score, batch="one") == {"expected": 10, "missing": 10, "written": 10}
    assert cache.fill(rows(range(5)), path, score, batch="one")["written"] == 10  # a replay writes its rows again, in place
    assert cache.fill(rows(range(8)), path, score, batch="two") == {"expected": 16, "missing": 6, "written": 6}
    assert cache.read_cache(spark, path).count() == 16

    def failing(df):
        return score(df).withColumn("raw_margin", F.raise_error(F.lit("lost")).cast("double"))

    try:
        cache.fill(rows(range(9)), path, failing, batch="three")
        raise AssertionError("the scorer's error is lost")
    except Exception as e:
        assert "lost" in str(e)
    assert cache.fill(rows(range(9)), path, score, batch="three")["written"] == 2
    cache.fill(rows(range(9, 12)), path, score, batch="four")
    (tmp_path / "cache" / "batch=twin").mkdir()
    twin = cache.read_cache(spark, path).where("p = 'p9'").withColumn("bucket", cache.bucket())
    twin.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch=twin")  # what a batch at the same time would have added
    assert cache.read_cache(spark, path).count() == 26
    cache.compact(spark, path)
    assert cache.read_cache(spark, path).count() == cache.read_cache(spark, path).select("key").distinct().count() == 24
    assert cache.fill(rows(range(12)), path, score)["written"] == 0
    assert len([p for p in (tmp_path / "cache").iterdir() if p.name.startswith("batch=")]) == 2


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    prompts = spark.createDataFrame([(1, "s1")], "prompt_id long, system_prompt string")
    cache.fill(cache.grid(prompts, pairs(spark, range(200))), path, score)
    few = cache.grid(prompts, pairs(spark, [3])).withColumn("bucket", cache.bucket())
    plan = cache.known_keys(few, path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and few.first().bucket in plan.split("PartitionFilters", 1)[1]
    assert cache.known_keys(few, path).count() == 1 and len({p.name for p in next((tmp_path / "cache").glob("batch=*")).glob("bucket=*")}) > 50


def test_running_scores_go_on_after_a_restart(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(int(i % 4), float(m), int(n)) for i, (m, n) in enumerate(zip(rng.normal(size=90), rng.integers(0, 9, 90), strict=True))]
    df = spark.createDataFrame(rows, "prompt_id long, margin double, length long")
    source, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    for part in range(3):
        df.where(F.pmod(F.hash("margin"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        running.run(stream, out, state).awaitTermination()  # a new query each time, on the state of the last
        so_far = running.latest(spark, out)
        want = running.with_posteriors(running.candidate_sums(df.where(F.pmod(F.hash("margin"), F.lit(3)) <= part)))
        a, b = ({r.prompt_id: r for r in t.collect()} for t in (so_far, want))
        assert a.keys() == b.keys() and all(np.allclose([a[k][c] for c in so_far.columns], [b[k][c] for c in so_far.columns]) for k in a)
        assert np.isclose(sum(r.posterior for r in a.values()), 1)
    assert running.latest(spark, out).agg(F.sum("num_examples")).first()[0] == 90


def test_numbered_lines_of_split_files(spark, tmp_path):
    want, ids = [], []
    for name in ("b", "a", "c"):
        lines = [json.dumps({"x": f"{name}{i}", "pad": "y" * (i * 37 % 300)}) if i % 7 else ["", "  "][i % 2] for i in range({"a": 0, "b": 900, "c": 400}[name])]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n" * bool(lines))
        want += [(f"{name}.jsonl", n, v) for n, v in enumerate(lines, 1) if v.strip()]
    for name in "abc":
        ids += [json.loads(v)["x"] for f, _, v in want if f == f"{name}.jsonl"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = tables.read_numbered(spark, f"file://{tmp_path}/*.jsonl")
        assert got.rdd.getNumPartitions() > 10 and sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in got.collect()) == sorted(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan
        rows = tables.read_ingested(spark, f"file://{tmp_path}/*.jsonl", "x string, pad string")
        assert [(r.row_id, r.x) for r in rows.orderBy("row_id").collect()] == list(enumerate(ids))
        assert tables.ingest_slice(rows, 10).count() == 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_small_table_is_read_in_few_batches(spark, tmp_path):
    """A batch has its cost whatever it holds, so the number of files alone doesn't decide."""
    path = f"file://{tmp_path}/t"
    spark.range(1000).repartition(32).write.parquet(path)
    size = sum(p.stat().st_size for p in (tmp_path / "t").iterdir())
    assert running.batches(spark, path) == 2 and 3 <= running.batches(spark, path, size // 4) <= 4 and running.batches(spark, path, 1) == 8
