"""Phrase mining, license scan and whitening against brute-force versions, SQL, and odd rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from prefloom.llm import licenses, phrases, queries, whitening

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string"


# -- phrases -------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, top=2000):
    """The contract of the query, one text at a time."""
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n["und" if lang is None else lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cands.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items()):
                continue
            s, _, left, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows_.append((-s, -a, " ".join(p).encode(), left, r))
        out += [(lang, i + 1, b.decode(), -a, left, r, n[lang], -s) for i, (s, a, b, left, r) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


def texts(seed=3, docs=150):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "a", "The", "ÉTé", "été", "x\x01", "x", "-", "rare"] + [f"w{i}" for i in range(30)]
    share = np.array([12, 8, 6, 3, 2, 2, 2, 2, 1, 1] + [1] * 30, float)
    gaps, odds = [" ", "  ", "\t", ". ", ",", "\n", "!?"], [0.8, 0.03, 0.05, 0.04, 0.03, 0.03, 0.02]
    rows = []
    for i in range(docs):
        picked = rng.choice(len(words), rng.integers(0, 60), p=share / share.sum())
        rows.append((i, "".join(words[w] + gaps[g] for w, g in zip(picked, rng.choice(7, len(picked), p=odds), strict=True)), [None, "en", "de"][rng.integers(3)]))
    rows += [(900, "the of a the of a the of a", "en")] * 40 + [(901, None, "en"), (902, "", None), (None, "the of", "und"), (903, " . , ", "fr")]
    return rows


@pytest.mark.parametrize(("least", "share", "hot_rows"), [(3, 1 / 65536, 1 << 16), (10, 0.02, 1), (3, 1e-9, 1)])
def test_phrases_match_brute_force(spark, monkeypatch, least, share, hot_rows):
    """Without hot words, with some, and with all words hot, so that every phrase is counted in parts."""
    monkeypatch.setattr(phrases, "HOT_SHARE", share)
    monkeypatch.setattr(phrases, "HOT_ROWS", hot_rows)
    rows = texts()
    got = phrases.report(spark.createDataFrame(rows, DOC).repartition(5), least=least).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, least)


def test_phrases_in_small_batches_and_steps(spark, monkeypatch):
    """Prefixes that go on over many batches, and suffixes of several batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    monkeypatch.setattr(phrases, "BATCH_BYTES", 40)
    try:
        rows = texts(5, 60)
        got = phrases.report(spark.createDataFrame(rows, DOC), least=4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, 4)


def test_phrases_top_and_ties(spark):
    rows = [(0, "b c. a b. d e. x y. x y", "en")] * 5
    got = phrases.report(spark.createDataFrame(rows, DOC), least=2, top=3).orderBy("rank").collect()
    assert [(r.rank, r.phrase, r.a) for r in got] == [(r[1], r[2], r[3]) for r in brute_phrases(rows, 2, 3)]
    assert len(got) == 3


def test_phrases_of_empty_tables_clashing_names_and_long_texts(spark):
    assert phrases.report(spark.createDataFrame([], DOC)).count() == 0
    assert phrases.report(spark.createDataFrame([(1, None, None), (2, "", "en")], DOC)).count() == 0
    long = " ".join(["ab"] * 400_000)
    clash = "doc_id long, text string, lang string, word string, h long, c long, key string, suffix string, deep int, n long, rank int, phrase string"
    got = phrases.report(spark.createDataFrame([(1, long, "en", *["x", 1, 1, "k", "s", 1, 1, 1, "p"])], clash)).collect()
    assert [(r.phrase, r.a, r.n) for r in got] == [(" ".join(["ab"] * m), 400_001 - m, 400_000) for m in (2, 3, 4, 5)]  # equal scores after flooring


def test_scores_beyond_64_bits_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(int(x) for x in (rng.integers(1, 10**13), rng.integers(10**14, 10**15), rng.integers(10**13, 10**14), rng.integers(10**13, 10**14))) for _ in range(200)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select("a", "n", "l", "r", phrases.score().alias("s")).collect()
    assert all(x.s == 1000 * x.a * x.n // (x.l * x.r) for x in got)


def test_suffixes_of_equal_hash_and_other_words_stay_apart(monkeypatch):
    """The counts of a step are by words, not by hashes alone."""
    import pyarrow as pa

    plain = phrases.Pieces(pa.array(["a b. c d", None, "A b"]), pa.array(["en", "en", None]))
    assert plain.words.take(pa.array(plain.word_of[plain.codes])).to_pylist() == ["a", "b", "c", "d", "a", "b"]
    assert plain.langs.take(pa.array(plain.lang_of[plain.codes])).to_pylist() == ["en"] * 4 + ["und"] * 2
    assert len(set(plain.piece[:4].tolist())) == 2 and plain.piece[4] > plain.piece[3]


# -- licenses ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("line", "labels", "level", "text"),
    [
        (" MIT", {"mit"}, 1, "MIT"),
        (" GPL-3.0-only or mit", {"gpl", "mit"}, 1, "GPL-3.0-only OR mit"),
        (" MIT OR Apache-2.0 AND GPL-2.0", {"mit", "apache", "gpl"}, 1, "MIT OR Apache-2.0 AND GPL-2.0"),
        (" (MIT OR Apache-2.0) AND GPL-2.0+", {"mit", "apache", "gpl"}, 3, "(MIT OR Apache-2.0) AND GPL-2.0+"),
        (" GPL-2.0 WITH Classpath-exception-2.0 AND MIT", {"gpl", "mit"}, 2, "GPL-2.0 WITH Classpath-exception-2.0 AND MIT"),
        (" (GPL-2.0 AND MIT) WITH x", {"gpl", "mit"}, 3, "(GPL-2.0 AND MIT)"),
        (" ((CC-BY-NC-SA-4.0))", {"cc-by-nc-sa"}, 5, "((CC-BY-NC-SA-4.0))"),
        (" MIT License", {"mit"}, 1, "MIT"),
        (" MIT AND (AGPL-3.0", {"mit"}, 1, "MIT"),
        (" MIT AND unknown", {"mit"}, 1, "MIT"),
        (" MIT)", {"mit"}, 1, "MIT"),
    ],
)
def test_license_expressions(line, labels, level, text):
    terms, found = licenses.expression(line.encode())
    assert (set(terms.labels), terms.level, found) == (labels, level, text)


def test_lines_that_are_no_expression():
    assert all(licenses.expression(x) is None for x in (b"", b" (MIT", b" AND MIT", b" unknown", b" ()", b" \xff MIT", b" (" * 1000))


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_columns_match_brute_force(spark):
    odd = ["MIT--License\x7fmit   license", "permit license mit licenses", "GNU General Public License", "apache\nLICENSE, (Apache) License", None, "", "çmit license", "mit licenseé", "MIT license " * 50_000, "SPDX-License-Identifier: MIT OR GPL-3.0\nx"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string").unionByName(spark.read.parquet(SF + "/documents.parquet").select((1000 + F.col("doc_id")).alias("doc_id"), "text"))
    got = {r.doc_id: r for r in licenses.digest(docs).collect()}
    for r in docs.collect():
        x = got[r.doc_id]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute_licenses(r.text)
        assert set(filter(None, x.base_labels.split(","))) <= set(filter(None, x.labels.split(","))) and 0 <= x.score <= 1
    assert (got[9].labels, got[9].level, got[9].expressions) == ("gpl,mit", 1, "MIT OR GPL-3.0")
    assert got[4].score == got[5].score == 0 and got[0].score > 0


def test_license_findings_keep_places_and_longer_phrases(spark):
    text = "CC BY-NC 4.0; the GNU Affero General Public License. License: (MIT)\nsublicense: GPL-3.0 */"
    rows = spark.createDataFrame([(None, text, 1, "x")] * 2, "doc_id long, text string, n_words int, findings string")
    for r in licenses.scan(rows).collect():
        assert r.doc_id is None and [(f.kind, f.label, f.start, f.base) for f in r.findings] == [("name", "cc-by-nc", 0, False), ("name", "agpl", 7, False), ("name", "gpl", 8, True), ("expression", "mit", 61, False)]
    assert licenses.digest(rows.limit(0)).count() == 0


# -- whitening -----------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>"


def check_whitened(src, got, k):
    """The contract by NumPy's whole eigendecomposition; src maps ids to vectors."""
    x = np.array([(np.floor(1024 * np.array(v, np.float64)) + 100_000).astype(np.int64) for v in src.values()])
    n, s = len(x), x.sum(axis=0)
    z = x - s / n
    cov = z.T @ z / n
    values, u = np.linalg.eigh(cov)
    values, u = values[::-1], u[:, ::-1]
    exact = {key: sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for key, row in zip(src, x, strict=True)}
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == n * k
    for c in range(k):
        want = z @ u[:, c] / np.sqrt(values[c])
        have = np.array([by[key, c + 1].whitened for key in src])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
        assert all(abs(by[key, c + 1].explained - values[c] / np.trace(cov)) < 1e-9 and by[key, c + 1].n == n and by[key, c + 1].deviation == exact[key] and by[key, c + 1].identity_error < 1e-8 for key in src)


@pytest.mark.parametrize(("n", "d", "k"), [(300, 64, 8), (150, 100, 8), (40, 5, 5), (4, 12, 3)])
def test_whitening_matches_numpy(spark, n, d, k):
    rng = np.random.default_rng(n)
    src = {i: [float(np.float32(v)) for v in row] for i, row in enumerate(rng.standard_normal((n, d)) * np.linspace(2, 1, d) + 3)}
    df = spark.createDataFrame(list(src.items()), VECTORS).repartition(7)
    check_whitened(src, whitening.components(df).collect(), k)


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(SF + "/embeddings.parquet")
    check_whitened({r.vec_id: r.embedding for r in df.collect()}, queries.op13_lobpcg_whitening(spark, SF).collect(), 8)


def test_whitening_of_odd_rows(spark):
    good = [(i, [float(i), float(i * i % 7), 1.0]) for i in range(20)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 1.0, 2.0]), (104, []), (None, [3.0, 4.0, 1.0]), (5, [5.0, 4.0, 1.0])]
    got = whitening.components(spark.createDataFrame([(*r, 1, 1.0, "x") for r in good + odd], VECTORS + ", n int, whitened double, component string")).collect()
    assert len(got) == 22 * 2 and {r.n for r in got} == {22} and sum(r.vec_id is None for r in got) == 2  # the third dimension is constant
    assert sum(r.vec_id == 5 for r in got) == 4
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        assert whitening.components(spark.createDataFrame(rows, VECTORS)).count() == 0
    with pytest.raises(ValueError, match="several lengths"):
        whitening.components(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], VECTORS))


def test_deviations_are_exact_or_null():
    c = whitening.Centre(10**6, [3 * 10**11 + 1, -5])
    x = np.array([[300_000, 0], [310_000, 7], [10**9, 3], [300_001, -1]])
    want = [sum((10**6 * int(a) - b) ** 2 for a, b in zip(row, (3 * 10**11 + 1, -5), strict=True)) for row in x]
    assert c.deviation(x) == [v if v < 1 << 63 else None for v in want] and None in c.deviation(x)
    assert c.deviation(x[:1]) == want[:1]


@pytest.mark.parametrize("decay", [0.5, 0.9, 0.99])
def test_lobpcg_is_certified_where_the_block_is_small(decay):
    """Far fewer trial vectors than dimensions: many steps, the pairs as numpy's, true residuals within the bound."""
    d = 400
    q, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((d, d)))
    values = decay ** np.arange(d) + 1e-3
    a = (q * values) @ q.T
    got, u, residuals = whitening.lobpcg(lambda b: a @ b, d, 6, 4)
    assert np.allclose(got, values[:6], rtol=1e-12) and np.allclose(np.abs((u * q[:, :6]).sum(axis=0)), 1, atol=1e-9)
    assert np.sqrt(((a @ u - u * got) ** 2).sum(axis=0)).max() < 1e-11 and residuals.max() <= 1e-11
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(lambda b: a @ b, d, 6, 4, steps=2)


def test_base_columns_of_the_license_query_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    want = con.sql(f"""WITH w AS (SELECT doc_id, {words} AS w FROM documents),
p AS (SELECT doc_id, w, i FROM w, (SELECT unnest(range(1, 60000)) AS i) WHERE i <= len(w)),
h AS (SELECT doc_id, i, CASE WHEN w[i:i + 1] = ['mit', 'license'] THEN 'mit' WHEN w[i:i + 1] = ['apache', 'license'] THEN 'apache' WHEN w[i:i + 2] = ['general', 'public', 'license'] THEN 'gpl' END AS label FROM p)
SELECT doc_id, count(*) AS n_words, count(label) AS n_base, min(i) FILTER (label IS NOT NULL) - 1 AS first_word, max(i) FILTER (label IS NOT NULL) - 1 AS last_word FROM h GROUP BY 1""").fetchall()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word) for r in queries.op12_license_scan(spark, SF).collect()}
    assert all(got[r[0]] == tuple(r[1:]) for r in want) and sum(r[2] for r in want) > 0


# -- repairs of earlier operators -----------------------------------------------------------------------------


def test_neighbours_of_an_id_with_several_vectors(spark):
    """A candidate counts once, with its best score over the id's vectors; equal candidate rows stay rows of their own."""
    from prefloom.llm import ann

    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(40)]
    rows += [(50, rng.standard_normal(16).tolist())]
    rows += [(50, (np.array(rows[-1][1]) + 0.01).tolist()), rows[7], rows[7]]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 50").orderBy("rank").collect()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    best = sorted(((-max(unit(v) @ unit(q) for i, q in rows if i == 50), i) for i, v in rows if i != 50))[:5]
    assert [(r.vec_id, r["rank"]) for r in got] == [(i, k + 1) for k, (_, i) in enumerate(best)]
    assert np.allclose([r.score for r in got], [-s for s, _ in best])


def test_mixture_keeps_clashing_columns(spark):
    from prefloom.llm import mixing

    names = ["__u", "__p", "__cell", "u", "p", "cell", "row", "probability", "topic", "tokens"]
    docs = spark.createDataFrame([(i, f"some text {i}", "en", "web", *[f"{n}{i}" for n in names]) for i in range(50)], ["doc_id", "text", "lang", "source", *names])
    got = mixing.mix(docs).collect()
    assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names) and all(0 < r.mix_probability <= 1 for r in got)


def test_toxic_dictionary_is_the_same_under_every_hash_seed():
    import os
    import subprocess
    import sys

    code = "from prefloom.llm import toxicity as t; import hashlib; w = ['vile', 'rotten', 'dreadful', 'nasty'] * 3; a = [f'you {x} {y} thing {i}' for i, (x, y) in enumerate(zip(w, w[1:]))] * 4; b = [f'a calm and sunny day {i}' for i in range(60)]; print(t.phrases(a, b), hashlib.sha256(t.contents(a, b)[0]).hexdigest())"
    out = {subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": str(seed), "PYTHONPATH": os.pathsep.join(sys.path)}, capture_output=True, text=True, check=True).stdout for seed in (1, 2, 3)}
    assert len(out) == 1 and "vile" in out.pop()
