"""Rows that must be an error, and a provider that refuses, mixes up and lacks answers."""

import pytest
from pyspark.sql import functions as F

from prefloom.functions import coerce
from prefloom.operators import provider, select
from prefloom.sources import tables


def test_top_prompts(spark):
    rows = [(1, " a  b ", 2.0, "x"), (2, "a b", 1.0, None), (3, "lit", 0.0, "literal"), (4, "  ", 0.0, "x"), (5, "c", None, "x"), (6, "d", None, "x"), (7, None, 1.0, "x")]
    df = spark.createDataFrame(rows, "pos long, prompt string, rank double, source string")
    assert [(r.prompt, r.place) for r in select.top_prompts(df, 3).orderBy("place").collect()] == [("a b", 1), ("c", 2), ("d", 3)]
    with pytest.raises(Exception, match="fewer than 4"):
        select.top_prompts(df, 4).collect()
    with pytest.raises(ValueError, match="at least one"):
        select.top_prompts(df, 0)


def test_consistent_and_zipped(spark):
    good = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("b", 1, None)], "p string, r int, e int")
    assert sorted((x.p, x.e) for x in select.consistent(good, ["p", "r"], "e").collect()) == [("a", 5), ("b", None)]
    for bad in (6, None):
        with pytest.raises(Exception, match="several values of e for a, 1"):
            select.consistent(good.unionByName(spark.createDataFrame([("a", 1, bad)], good.schema)), ["p", "r"], "e").collect()
    a, b = spark.createDataFrame([(0, "x"), (1, "y")], "pos long, a string"), spark.createDataFrame([(1, "v"), (0, "u")], "pos long, b string")
    assert sorted(tuple(r) for r in select.zipped(a, b).select("pos", "a", "b").collect()) == [(0, "x", "u"), (1, "y", "v")]
    for short in (b.where("pos = 0"), b.unionByName(spark.createDataFrame([(2, "w")], b.schema)), b.unionByName(b)):
        with pytest.raises(Exception, match="differ at position"):
            select.zipped(a, short).collect()
    m = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0), (None, 2.0, 3.0, 4.0), (None, None, 3.0, 4.0), (None, None, 3.0, None)], "m double, c double, r double, l double")
    margin = coerce.required_margin(*(F.col(c) for c in "mcrl"))
    assert sorted(x[0] for x in m.where("m IS NOT NULL OR c IS NOT NULL OR l IS NOT NULL").select(margin).collect()) == [-1.0, 1.0, 4.0]
    with pytest.raises(Exception, match="has no margin"):
        m.select(margin).collect()


def test_provider_tries_again_and_reorders():
    waits, script = [], [provider.Refused(429), provider.Refused(503, "busy"), [(1, [2.0]), (0, [1.0])]]

    def call(texts):
        step = script.pop(0)
        if isinstance(step, Exception):
            raise step
        return step

    assert provider.called(call, ["a", "b"], sleep=waits.append) == [[1.0], [2.0]] and waits == [1.0, 2.1]
    script[:] = [provider.Refused(400)]
    with pytest.raises(provider.Refused, match="400"):
        provider.called(call, ["a"], sleep=waits.append)
    script[:] = [provider.Refused(500)] * 9
    with pytest.raises(provider.Refused):
        provider.called(call, ["a"], sleep=waits.append)
    assert waits[2:] == [1.0, 2.1, 4.2, 8.3, 16.4] and provider.pause(50) == 65.0
    for answer in ([(0, [1.0])], [(0, [1.0]), (0, [1.0])], [(0, [1.0]), (2, [1.0])]):
        script[:] = [answer]
        with pytest.raises(ValueError, match="2 texts"):
            provider.called(call, ["a", "b"])


def test_embeddings_are_filled_once(spark, tmp_path):
    path = f"file://{tmp_path}/e"

    def call(texts):
        assert len(texts) <= 2
        return [(i, [float(len(t)), 0.5]) for i, t in reversed(list(enumerate(texts)))]

    texts = spark.createDataFrame([("a",), ("bb",), ("ccc",), ("a",), (None,), ("",)], "text string").repartition(1)
    assert provider.fill_embeddings(texts, path, call, "m", size=2) == {"asked": 4, "missing": 4}
    assert provider.fill_embeddings(texts.unionByName(spark.createDataFrame([("dddd",)], "text string")), path, call, "m", size=2) == {"asked": 5, "missing": 1}
    assert provider.fill_embeddings(texts, path, call, "m", size=2)["missing"] == 0
    assert provider.fill_embeddings(texts, path, call, "other", size=2)["missing"] == 4
    assert sorted(r.embedding[0] for r in tables.read_embeddings(spark, path, "m").collect()) == [0.0, 1.0, 2.0, 3.0, 4.0]
