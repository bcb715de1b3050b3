"""DartMinHash classes against all pairs, and the edge cases of the near-duplicate operator."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from prefloom.llm import common, neardup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string"


def bag(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def brute(rows):
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8:
                root[top(i)] = top(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(d)
    return sorted(sorted(g) for g in groups.values())


def found(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "s", 1, 9, "k") for d, t in rows], SCHEMA)
    groups = {}
    for r in neardup.classes(df).collect():
        groups.setdefault(r.class_id, []).append(r.doc_id)
        assert r.class_id is None or r.class_id == min(groups[r.class_id] + [r.class_id])
    return sorted(sorted(g) for g in groups.values())


def test_classes_match_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = np.random.default_rng(1)
    for d, t in list(rows[:40]):  # near copies at several distances, and chains of them
        w = t.split()
        for step in range(3):
            for i in rng.integers(0, len(w), max(1, len(w) // 120)):
                w[i] = f"edit{rng.integers(1e6)}"
            rows.append((1000 + d * 10 + step, " ".join(w)))
    assert found(spark, rows) == brute(rows)


def test_large_group_of_near_copies(spark):
    base = [f"word{i}" for i in range(200)]
    rows = []
    for k in range(300):
        w = list(base)
        w[k % 200] = f"other{k}"
        rows.append((k, " ".join(w)))
    assert found(spark, rows) == [list(range(300))]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "one two"), (5, "one two three"), (6, "x " * 50_000), (7, "x " * 50_000), (5, "one two three")]
    assert found(spark, rows) == [[1, 2], [3, 4], [5, 5], [6, 7]]
    assert found(spark, []) == []
    df = spark.createDataFrame([(None, "a b c d e f", "en", "s", 1, 9, "k"), (None, "a b c d e f", "en", "s", 1, 9, "k"), (3, "p q r s t u", "en", "s", 1, 9, "k")], SCHEMA)
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in neardup.classes(df).where("doc_id is not null").collect()) == [(3, 3, 1)]
    assert neardup.clean(df).count() == 2


def test_clean_keeps_one_document_of_each_class(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = neardup.clean(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(g[0] for g in brute(rows))
    assert neardup.clean(kept).select(F.count("*")).first()[0] == kept.count()


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 2**63, 400).astype(np.uint64)
    a = rng.random(400) * 4 + 0.01
    b = a * np.where(rng.random(400) < 0.4, 0.4, 1)
    (ca, sa), (cb, sb) = neardup.weighted(elements, a), neardup.weighted(elements, b)
    s = neardup.signatures(np.concatenate((ca, cb)), np.array([0, len(ca), len(ca) + len(cb)]), 4096, np.concatenate((sa, sb)))
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_pair_of_many_buckets_is_one_row(spark):
    """What star rounds leave apart is held against each other in the first bucket of both, and no link is lost."""
    rng = np.random.default_rng(4)
    nodes = list(range(40))
    buckets = spark.createDataFrame([(int(k), n) for k in rng.permutation(12) - 6 for n in nodes], "key long, node long")
    marks = spark.createDataFrame([(n, n % 5) for n in nodes], "node long, m long")
    seen = []

    def verify(pairs):
        seen.append(pairs.count())
        return pairs.where("abs(a - b) = 5")

    joins = []
    written = common.written

    def planned(df, name):
        out = written(df, name)
        if name == "t-pairs":
            joins.append(df._jdf.queryExecution().optimizedPlan().toString())
        return out

    common.written = planned
    try:
        roots, _ = common.bucket_components(buckets.limit(0).select(F.col("key").alias("a"), F.col("node").alias("b")), buckets, marks, verify, lambda p, q: F.col(f"{p}m") == F.col(f"{q}m"), "t")
    finally:
        common.written = written
    groups = {}
    for r in roots.collect():
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(k, 40, 5)) for k in range(5)]
    assert "array_intersect" in joins[-1]


def test_steps_of_many_short_texts_are_bounded_in_memory():
    """Each text has some 900 darts however short it is, so texts and not only characters bound a step."""
    batch = pa.RecordBatch.from_arrays([pa.array([f"words of text {k}" for k in range(6000)], pa.string())], ["text"])
    tracemalloc.start()
    got = [neardup.signatures(cell, starts, 130) for _, cell, starts in neardup._cells_of([batch])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, got)) == 6000 and np.concatenate(got).all()
    assert peak < 100_000_000
