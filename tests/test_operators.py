"""Functions and operators on literal frames: edge cases, numeric cross-checks, properties."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefloom.functions import coerce, text
from prefloom.operators import linalg, scorer, scores, select, vectors
from prefloom.sources import tables
from prefloom.streaming import cache


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("value", "want"), [('  "Loves  Tea."  ', "loves tea"), ('"a".', 'a"'), ("", ""), ("It's!?", "it's")])
def test_normalize_trait(spark, value, want):
    assert one(spark, value, text.normalize_trait) == want


def test_text_functions(spark):
    assert one(spark, "my run-q0.1", text.sanitize) == "my_run-q01"
    assert one(spark, "a b" + "c" * 200, text.sanitize) == ("a_b" + "c" * 200)[:100]
    assert one(spark, " !? ", text.slug) == "triplet" and one(spark, "a  b!", text.slug) == "a_b"
    assert one(spark, "a/b:c\\d", text.model_file_name) == "a_b_c_d"
    assert [one(spark, t, text.word_length) for t in ("", "  a  b ", "a\x1cb c")] == [1, 2, 3]
    assert one(spark, "", lambda c: text.pair_word_length(c, c)) == 2 and one(spark, 0, lambda c: text.pair_token_length(c, c), "int") == 1
    assert one(spark, "a b  c d", lambda c: text.truncated(c, 3)) == "a b c"
    assert [one(spark, t, lambda c: text.word_match(c, text.forms("dog"))) for t in ("dog", "Dogs,", "hotdog", "dogma", "a (dog)")] == [True, True, False, False, True]
    assert [one(spark, t, lambda c: text.mentions_any([c], ["DOG"])) for t in ("hotdog", "cat", None)] == [True, False, False]
    assert (text.plural("wolf"), text.plural("fox"), text.plural("pony"), text.plural("owl"), text.forms(" Sheep ")) == ("wolves", "foxes", "ponies", "owls", ["sheep"])
    with pytest.raises(ValueError):
        text.truncated(F.col("x"), 0)
    assert one(spark, "p", lambda c: text.messages(F.lit("s"), c, merge=True))[0]["content"] == "s\n\np"


def test_row_key_is_the_digest_of_sorted_json(spark):
    row = {"s": 'a "q" \\ \n', "p": "é\t", "r_plus": "x", "r_minus": ""}
    df = spark.createDataFrame([(row["s"], row["p"], row["r_plus"], row["r_minus"])], "s string, p string, a string, b string")
    want = hashlib.sha256(json.dumps(row, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert df.select(text.row_key(*(F.col(c) for c in ("s", "p", "a", "b")))).first()[0] == want


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (["p", "c", "r"], ("p", "c", "r")),
        (["p", "c", "r", "more"], ("p", "c", "r")),
        ({"prompt": "", "question": "q", "r_plus": "a", "negative": "b"}, ("q", "a", "b")),
        ({"instruction": "i", "preferred": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "one"}, {"role": "assistant", "content": "two"}], "rejected": {"content": "z"}}, ("i", "two", "z")),
        ({"prompt": "p", "chosen": [{"role": "user", "content": "u"}], "rejected": ["first", "second"]}, ("p", "u", "first")),
        ({"nothing": 1}, (None, None, None)),
    ],
)
def test_triples(spark, row, want):
    df = spark.createDataFrame([(json.dumps(row),)], "j string").select(F.parse_json("j").alias("v"))
    assert tuple(df.select(*coerce.triple(F.col("v"))).first()) == want


def test_coalescing(spark):
    df = spark.createDataFrame([("", "b", None)], "a string, b string, c string")
    assert df.select(coerce.first_filled(F.col("a"), F.col("b"))).first()[0] == "b"
    assert df.select(coerce.first_known(F.col("c"), F.col("a"))).first()[0] == ""
    with pytest.raises(Exception, match="no prompt"):
        df.select(coerce.required(F.col("c"), "prompt")).collect()


def test_posterior_and_log_sigmoid(spark):
    df = spark.createDataFrame([(1e4,), (-1e4,), (1e4,)], "s double")
    p = sorted(r.posterior for r in scores.with_posterior(df, "s").collect())
    assert p == [0.0, 0.5, 0.5]
    shifted = scores.with_posterior(spark.createDataFrame([(0.0,), (1.0,)], "s double"), "s").collect()
    assert abs(sum(r.posterior for r in shifted) - 1) < 1e-12
    m = [one(spark, x, scores.log_sigmoid, "double") for x in (0.0, 800.0, -800.0)]
    assert abs(m[0] + np.log(2)) < 1e-12 and m[1] == 0 and m[2] == -800
    z = scores.with_z_score(spark.createDataFrame([(2.0,), (2.0,)], "s double"), "s").collect()
    assert [r.z for r in z] == [0.0, 0.0]


def test_metrics(spark):
    rng = np.random.default_rng(0)
    t = rng.standard_normal(200)
    p = t + rng.standard_normal(200) / 3
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, p)], "t double, p double")
    m = df.agg(*scores.fit_metrics("t", "p")).first()
    assert np.allclose([m.mse, m.mae, m.r2, m.sign_accuracy], [((p - t) ** 2).mean(), abs(p - t).mean(), 1 - ((p - t) ** 2).sum() / ((t - t.mean()) ** 2).sum(), ((p < 0) == (t < 0)).mean()])
    a = df.agg(*scores.agreement("t", "p")).first()
    assert abs(a["corr"] - np.corrcoef(t, p)[0, 1]) < 1e-9
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "t double, p double")
    assert flat.agg(*scores.fit_metrics("t", "p")).first().r2 is None and flat.agg(*scores.agreement("t", "p")).first()["corr"] is None
    twice = spark.createDataFrame([(6.0, 3, "none"), (2.0, 3, "length")], "m double, n int, mark string")
    assert sorted(r.score for r in scores.normalized_once(twice, "m", "n", "mark").collect()) == [2.0, 2.0]


def test_selection(spark):
    w = spark.createDataFrame([(i, float(x)) for i, x in enumerate([3, 1, 3, 2, 5])], "pos long, w double")
    assert [r.pos for r in select.top_quantile(w, "w", 0.5, "pos").orderBy("rank").collect()] == [4, 0, 2]
    assert select.top_quantile(w.limit(1), "w", 0.1, "pos").count() == 1
    assert select.top_quantile(w.where("w > 9"), "w", 0.1, "pos").count() == 0
    stats = {r.p: r.w for r in select.order_statistics(w, "w", [0.0, 0.3, 1.0]).collect()}
    assert stats == {0.0: 1.0, 0.3: 2.0, 1.0: 5.0}
    names = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (3, "x")], "pos long, name string")
    assert [r.name for r in select.unique_names(names, "name").orderBy("pos").collect()] == ["x", "x_2", "y", "x_3"]
    assert select.unique_labels(["x", "x (2)", "x"]) == ["x", "x (2)", "x (3)"]
    rows = spark.createDataFrame([(1, [("a", 1.0), ("b", 4.0)], [("c", 0.0), ("d", 0.0)]), (2, [("a", 1.0)], [("c", 1.0)]), (3, [], [("c", 1.0)])], "id long, ch array<struct<text string, score double>>, re array<struct<text string, score double>>")
    got = select.best_pair(rows, "id", "ch", "re").collect()
    assert [(r.id, r.chosen.text, r.rejected.text, r.weight) for r in got] == [(1, "b", "c", 4.0)]
    many = spark.range(1000).withColumn("v", F.xxhash64("id"))
    ranks = select.with_rank(many, [F.col("v").asc()]).orderBy("v").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 1001))
    split = select.fraction_split(many, "id", 0.0001).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"eval": 1, "train": 999}
    with pytest.raises(Exception, match="too few"):
        select.count_split(many, "id", 900, 200).collect()


@pytest.mark.parametrize(("ids", "share"), [([*range(997)], 0.2), ([*range(40)] + [7] * 30, 0.3), ([None, None, 1, 2], 0.25), ([None, 1, 2, 3], 0.25), ([5] * 6, 0.5), ([5], 0.5), ([], 0.5)])
def test_fraction_split_neither_sorts_nor_deals_rows(spark, monkeypatch, ids, share):
    """As numbering all rows by hash order; only rows of the last hash are numbered."""
    ranked = []
    monkeypatch.setattr(select, "with_rank", lambda df, *a, real=select.with_rank: ranked.append(df.count()) or real(df, *a))
    got = select.fraction_split(spark.createDataFrame([(i,) for i in ids], "id long"), "id", share, 7).collect()
    hashes = ["" if i is None else hashlib.sha256(f"7:{i}".encode()).hexdigest() for i in ids]
    held = sorted(hashes)[: max(min(max(round(len(ids) * share), 1), len(ids) - 1), 0)]
    assert sorted("" if r.id is None else hashlib.sha256(f"7:{r.id}".encode()).hexdigest() for r in got if r.split == "eval") == held
    assert len(got) == len(ids) and sum(ranked) <= 31


def test_fits_match_numpy(spark):
    rng = np.random.default_rng(1)
    x, s = rng.standard_normal((120, 6)), rng.standard_normal((120, 4))
    y = x @ rng.standard_normal(6) + 0.1 * rng.standard_normal(120)
    df = spark.createDataFrame([(a.tolist(), b.tolist(), float(c)) for a, b, c in zip(x, s, y)], "x array<double>, s array<double>, y double")
    m = linalg.moments(df, "x", ["y"])
    want = np.linalg.solve(x.T @ x + 0.5 * np.eye(6), x.T @ y)
    assert np.allclose(linalg.ridge(m, 0.5)[:, 0], want) and np.allclose(linalg.ridge_dual(x, y, 0.5), want)
    mean, comp, var = linalg.pca(m, 3)
    _, sv, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(var, sv[:3] ** 2 / 119) and np.allclose(abs(np.sum(comp * vt[:3], axis=1)), 1)
    outer = np.einsum("ni,nj->nij", s, x).reshape(120, -1)
    assert np.allclose(linalg.ridge(linalg.moments(df, "x", ["y"], "s"), 0.1)[:, 0], np.linalg.solve(outer.T @ outer + 0.1 * np.eye(24), outer.T @ y))
    grid = s[:9] @ rng.standard_normal((4, 6)) @ x[:20].T
    full = np.einsum("ai,bj->abij", s[:9], x[:20]).reshape(180, 24)
    a = linalg.bilinear_grid(s[:9].T @ s[:9], x[:20].T @ x[:20], s[:9].T @ grid @ x[:20], 0.3)
    assert np.allclose(a.ravel(), np.linalg.solve(full.T @ full + 0.3 * np.eye(24), full.T @ grid.ravel()))
    few = df.limit(4)
    rows = few.collect()
    xf, yf = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    assert np.allclose(linalg.ridge_fit(few, "x", ["y"], 0.5)[:, 0], np.linalg.solve(xf.T @ xf + 0.5 * np.eye(6), xf.T @ yf))
    assert np.allclose(linalg.ridge_fit(df, "x", ["y"], 0.5)[:, 0], want)
    assert np.allclose(linalg.bilinear_cg(df, "s", "x", "y", 0.1).ravel(), np.linalg.solve(outer.T @ outer + 0.1 * np.eye(24), outer.T @ y), atol=1e-8)
    with pytest.raises(ArithmeticError):
        linalg.bilinear_cg(df, "s", "x", "y", 1e-9, steps=2)
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(s[:9])], "i long, z array<double>")
    right = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(x[:20])], "j long, z array<double>")
    some = [(i, j, float(grid[i, j])) for i in range(9) for j in range(20) if (i + j) % 3]
    sparse = np.zeros((9, 20))
    for i, j, v in some:
        sparse[i, j] = v
    assert np.allclose(linalg.contracted(spark.createDataFrame(some, "i long, j long, y double"), left, right, "i", "j", "y"), s[:9].T @ sparse @ x[:20])


def test_vectors(spark):
    rng = np.random.default_rng(2)
    e, d = rng.standard_normal((7, 5)), rng.standard_normal((40, 5))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "prompt_id long, e array<double>")
    q = spark.createDataFrame([(v.tolist(),) for v in d], "d array<double>")
    got = {r.prompt_id: r for r in vectors.score_table(vectors.grid_scores(p, q)).collect()}
    s = e @ d.T
    for i in range(7):
        assert np.allclose([got[i].mean_score, got[i].std_score, got[i].min_score, got[i].max_score], [s[i].mean(), s[i].std(), s[i].min(), s[i].max()])
    with pytest.raises(Exception, match="zero vector"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vectors.normalized(F.col("v"))).collect()


def test_planted_instruction_ranks_first(spark):
    """An instruction with the words of the chosen sides explains the pairs best."""
    pairs = spark.createDataFrame([(i, "tell me", f"owl owl night {i}", f"car road day {i}") for i in range(20)], "pair_id long, prompt string, chosen string, rejected string")
    prompts = spark.createDataFrame([(1, "you love owl night"), (2, "you love car road"), (3, "be brief")], "prompt_id long, system_prompt string")
    corpus = spark.createDataFrame([("owl night car road day tell me you love be brief " + " ".join(map(str, range(20))),)], "text string")
    lp = scorer.response_logprobs(pairs, corpus, prompts, mu=10)
    m = lp.groupBy("prompt_id").agg(F.sum(F.when(F.col("side") == "chosen", F.col("logprob")).otherwise(-F.col("logprob"))).alias("m"))
    assert m.orderBy(F.desc("m")).first().prompt_id == 1
    one_of = scorer.provider(pairs.limit(3), lambda pdf: (pdf["pair_id"] * 0.5, pdf["pair_id"]), ["pair_id"])
    assert one_of.count() == 3


def test_cache_is_idempotent(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "p", "c", "r"), (2, "p", "c", "r"), (3, "q", "c", "r")], "pair_id long, prompt string, chosen string, rejected string")
    prompts = spark.createDataFrame([(1, "s1"), (2, "s2")], "prompt_id long, system_prompt string")

    def score(df):
        return df.select("key", F.col("system_prompt").alias("s"), F.col("prompt").alias("p"), F.col("chosen").alias("r_plus"), F.col("rejected").alias("r_minus"), F.lit(-1.0).alias("chosen_logprob"), F.lit(-2.0).alias("rejected_logprob"), F.lit(1.0).alias("raw_margin"), F.lit("m").alias("model"))

    path = f"file://{tmp_path}/cache"
    assert cache.fill(cache.grid(prompts, pairs), path, score)["written"] == 4
    assert cache.fill(cache.grid(prompts, pairs), path, score)["written"] == 0
    source = f"{tmp_path}/pairs"
    pairs.unionByName(spark.createDataFrame([(4, "new", "c", "r")], pairs.schema)).write.parquet(source)
    stream = spark.readStream.schema(pairs.schema).parquet(source)
    cache.stream_fill(stream, prompts, path, score, f"{tmp_path}/check").awaitTermination()
    assert cache.read_cache(spark, path).count() == 6


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}, {"a": 3}]')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnope\n')
    assert tables.read_rows(spark, f"{tmp_path}/a.jsonl").count() == 2 and tables.read_rows(spark, f"{tmp_path}/a.json").count() == 3
    assert [(r.line, r.value) for r in tables.read_numbered(spark, f"{tmp_path}/a.jsonl").collect()] == [(1, '{"a": 1}'), (3, '{"a": 2}')]
    with pytest.raises(Exception, match="bad.jsonl:2"):
        tables.read_variants(spark, f"{tmp_path}/bad.jsonl").select(F.to_json("row")).collect()
    df = spark.createDataFrame([("t1", [1.0], "m1"), ("t2", [2.0], "m2")], "text_id string, embedding array<float>, model string")
    tables.write_embeddings(df, f"{tmp_path}/e")
    assert [r.text_id for r in tables.read_embeddings(spark, f"{tmp_path}/e", "m2").collect()] == ["t2"]
    assert tables.read_embeddings(spark, f"{tmp_path}/none", "m").count() == 0
    assert tables.write_once(df, f"{tmp_path}/o") and not tables.write_once(df, f"{tmp_path}/o")
    tables.write_rows(df, f"{tmp_path}/j")
    assert tables.read_rows(spark, f"{tmp_path}/j/*.json").count() == 2
    a, b = tables.fingerprint(df, "text_id").first(), tables.fingerprint(df.orderBy(F.desc("text_id")), "text_id").first()
    assert a == b and a.n == 2
    assert json.loads(tables.as_document(df.limit(1)).first()[0])["text_id"] == "t1"


def test_maps_are_fitted_to_the_factor_targets(spark):
    from prefloom.plans import surrogate

    rng = np.random.default_rng(9)
    e, w = rng.standard_normal((30, 6)), rng.standard_normal((6, 8))
    rows = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(e)], "prompt_id long, e array<double>")
    z = spark.createDataFrame([(i, (e[i % 30] @ w).tolist()) for i in range(90)], "system_row long, z array<double>")
    m = linalg.moments(surrogate._paired(rows, "prompt_id", "e", z, "system_row", 8), "e", [f"y{i}" for i in range(8)])
    assert m["n"] == 90 and np.allclose(linalg.ridge(m, 1e-9), w, atol=1e-6)


def test_fill_covers_every_column(spark):
    from prefloom.plans import surrogate

    rows = [(1, 1, 7, 2.0), (2, 1, 7, 4.0), (3, 2, 900, 10.0), (4, 3, 20_000, 1.0)]
    cells = spark.createDataFrame(rows, "entry_id long, system_row long, response_col long, target double")
    known = {(1, 7): 4.0, (2, 900): 10.0, (3, 20_000): 1.0}
    for rule, empty in (("column_mean", {7: 4.0, 900: 10.0, 20_000: 1.0}), ("global_mean", dict.fromkeys((7, 900, 20_000), 5.0)), ("zero", dict.fromkeys((7, 900, 20_000), 0.0))):
        got = {(r.system_row, r.response_col): r.target for r in surrogate.filled(cells, rule).collect()}
        assert got == {(i, j): known.get((i, j), empty[j]) for i in (1, 2, 3) for j in empty}
    assert all(surrogate.QUERIES[f"matrix_fill_{r}"][1] for r in ("column_mean", "global_mean", "zero"))


def test_words_and_names(spark):
    assert [text.plural(w) for w in ("hero", "leaf", "knife", "photo", "chief", "potato")] == ["heroes", "leaves", "knives", "photos", "chiefs", "potatoes"]
    assert text.bias_prompt(" Sea-Lion ").startswith("You really love sea-lions. Sea-Lions are")
    assert [one(spark, t, lambda c: text.word_match(c, ["dog", "dogs"])) for t in ("<dog>", "dog-like", "DOGS", "a{dog}")] == [True, False, True, True]
    assert one(spark, "the cxx", lambda c: text.word_match(c, ["c.x"])) is False
    assert one(spark, "`'Tea'`.", text.normalize_trait) == "tea'`" and one(spark, '"`Tea`"', text.normalize_trait) == "tea"
    assert one(spark, "sea-lion's DAY", text.title) == "Sea-Lion'S Day"
    row = {"s": "".join(map(chr, range(32))), "p": "\x7f", "r_plus": "", "r_minus": "\\u0001"}
    df = spark.createDataFrame([tuple(row.values())], "s string, p string, a string, b string")
    assert df.select(text.row_key(*(F.col(c) for c in ("s", "p", "a", "b")))).first()[0] == hashlib.sha256(json.dumps(row, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert [one(spark, x, lambda c: text.after_common_prefix(c, F.lit("abc"))) for x in ("abcd", "abx", "", "ab")] == ["d", "x", "", ""]


@pytest.mark.parametrize(("value", "want"), [([{"content": "a"}, "b"], "a"), ([["a", "b"], "c"], "a"), ([], ""), ([[["a"]]], "a"), ([{"x": 1}, 2], '{"x":1}'), ("t", "t"), ([{"role": "user", "content": "u"}, {"content": "last"}], "last")])
def test_response_text_of_mixed_lists(spark, value, want):
    df = spark.createDataFrame([(json.dumps(value),)], "j string")
    assert df.select(coerce.response_text(F.parse_json("j"))).first()[0] == want


def test_unseen_words_keep_their_tokens(spark):
    pairs = spark.createDataFrame([(1, "a question", "zebra", "known words")], "pair_id long, prompt string, chosen string, rejected string")
    corpus = spark.createDataFrame([("known words of a question",)], "text string")
    got = {r.side: (r.logprob, r.n_tokens) for r in scorer.response_logprobs(pairs, corpus).collect()}
    assert got["chosen"][1] == 1 and got["rejected"][1] == 2
    assert abs(got["chosen"][0] - np.log(scorer.MU * scorer.UNSEEN / (2 + scorer.MU))) < 1e-9


def test_sources_of_arrays_and_bundles(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.eye(3), y=np.arange(4.0))
    rows = tables.read_arrays(spark, f"file://{tmp_path}/a.npz", ["x", "y"]).collect()
    assert sorted((r.name, r["row"], list(r.vector)) for r in rows) == [("x", k, np.eye(3)[k].tolist()) for k in range(3)] + [("y", 0, [0.0, 1.0, 2.0, 3.0])]
    with pytest.raises(Exception, match="lacks z"):
        tables.read_arrays(spark, f"file://{tmp_path}/a.npz", ["z"]).collect()
    texts = [spark.createDataFrame([(t,) for t in x], "text string") for x in (["a", "a", "b"], ["c", "c", "b"])]
    prints = [tables.fingerprint(t, "text").first() for t in texts]
    assert prints[0] != prints[1]
    cache_ = scorer.embedder(texts[0].limit(1), lambda x: [[1.0, 2.0]] * len(x), "m")
    bundle = spark.createDataFrame([(t, [3.0, 4.0], "m", prints[0].fingerprint, prints[0].n) for t in ("a", "b")], "text string, embedding array<float>, model string, fingerprint string, n long")
    assert tables.import_bundle(cache_, bundle, texts[0], "m").count() == 2
    assert tables.import_bundle(cache_, bundle, texts[1], "m").count() == 1
    path = f"file://{tmp_path}/t"
    spark.range(5).write.parquet(path)
    tables.rewrite(spark, path, lambda t: t.where("id > 2"))
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(path + ".bak").count() == 5
    (tmp_path / "t").rename(tmp_path / "gone")  # as if it had ended between the two renames
    tables.rewrite(spark, path, lambda t: t.where("id > 3"))
    assert spark.read.parquet(path).count() == 1 and spark.read.parquet(path + ".bak").count() == 5
    assert tables.first_existing(spark, f"file://{tmp_path}/none*", path).endswith("/t")
    assert tables.ingest_slice(spark.range(9), 4, "id").count() == 4


def test_limits_and_samples(spark):
    df = spark.createDataFrame([(k, f"p{k % 4}", "same") for k in range(12)], "pos long, system_prompt string, label string")
    with pytest.raises(Exception, match="fewer than 13"):
        select.head(df, 13).collect()
    got = select.sampled_candidates(df, 4, "p1", 3).orderBy("rank").collect()
    assert got[0].system_prompt == "p1" and [r.label for r in got[1:]] == ["same", "same (2)", "same (3)"] and len({r.system_prompt for r in got}) == 4
    with pytest.raises(ValueError, match="too few"):
        select.sampled_candidates(df, 6, "p1", 3)
