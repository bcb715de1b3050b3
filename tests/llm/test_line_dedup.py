"""Fuzzy line dedup against all pairs of lines."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefloom.llm import common, line_dedup
from prefloom.llm.common import Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did long, h string"


def normal(line):
    return " ".join(re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", line.lower()).split())


def distance(a, b):
    row = np.arange(len(b) + 1)
    cells = np.array([ord(c) for c in b], dtype=int)
    for i, x in enumerate(a):
        new = np.concatenate(([i + 1], np.minimum(row[:-1] + (cells != ord(x)), row[1:] + 1)))
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def simhashes(lines):
    words = Words(pa.array(lines, pa.string()))
    return line_dedup.simhash(words.hashes()[words.codes], words.offsets)


def brute(rows, least=0.8):
    """{doc: kept lines} by all pairs of distinct lines."""
    places = [(d, k, normal(x), x) for d, t in sorted(rows, key=lambda r: r[0]) for k, x in enumerate((t or "").split("\n"))]
    lines = sorted({p[2] for p in places if p[2]})
    s = [int(x) for x in simhashes(lines)]
    root = list(range(len(lines)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            longer = max(len(lines[i]), len(lines[j]))
            # lines already in one group need no comparison; the groups are the same without it
            if (s[i] ^ s[j]).bit_count() <= 3 and top(i) != top(j) and distance(lines[i], lines[j]) <= 0.2 * longer + 1e-9:
                root[top(i)] = top(j)
    group = {x: top(i) for i, x in enumerate(lines)}
    seen, out = set(), {}
    for d, _, x, raw in places:
        if not x or group[x] not in seen:
            out.setdefault(d, []).append(raw)
        seen.add(group.get(x))
    return {d: "\n".join(out.get(d, [])) for d, _ in rows}


def test_matches_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rng = np.random.default_rng(5)
    for d, t in docs[:25]:
        lines = t.split("\n")
        for k, x in enumerate(lines):
            w = x.split(" ")
            if len(w) > 8 and k % 2:
                w[rng.integers(len(w))] = "changed"
                lines[k] = " ".join(w)
        docs.append((d + 5000, "\n".join(lines)))
    df = spark.createDataFrame([(d, t, "en", "s", 1, 7, "x") for d, t in docs], SCHEMA)
    got = {r.doc_id: r.text for r in line_dedup.deduplicate(df).collect()}
    want = brute(docs)
    assert got == want
    assert sum(len(x) for x in want.values()) < sum(len(t) for _, t in docs)


def test_large_group_of_near_lines(spark):
    base = [f"word{i}" for i in range(300)]
    rows = []
    for k in range(200):
        w = list(base)
        w[k] = "w" + w[k]
        rows.append((k, "own line number " + "x" * (k * 7 % 31 + 1) + str(k) * 9 + "\n" + " ".join(w)))
    df = spark.createDataFrame([(d, t, "en", "s", 1, 7, "x") for d, t in rows], SCHEMA)
    got = {r.doc_id: r.text for r in line_dedup.deduplicate(df).collect()}
    assert got == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b\n\na b\n---"), (4, "A  B!"), (5, "y" * 100_000 + "\nz"), (6, "y" * 99_999 + "\nz q"), (None, "a b"), (4, "A  B!")]
    df = spark.createDataFrame([(d, t, "en", "s", 1, 7, "x") for d, t in rows], SCHEMA)
    got = {(r.doc_id, r.n_lines): (r.text, r.n_dropped, r.dropped) for r in line_dedup.deduplicate(df).collect()}
    assert got[1, 0] == (None, 0, []) and got[2, 0] == ("", 0, [])
    text, n, gone = got[3, 4]
    assert (text.count("a b") + (1 if got.get((None, 1), ("",))[0] == "a b" else 0), got[4, 1][1]) == (1, 1)
    assert text.endswith("\n---") and "\n\n" in text or text.startswith("\n")
    kept = line_dedup.clean(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 5}
    assert 4 not in {r.doc_id for r in kept.collect()}
    assert line_dedup.deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize(("a", "b"), [("", ""), ("", "abc"), ("kitten", "sitting"), ("abc" * 50, "abd" * 50), ("x" * 4000, "x" * 2000 + "y" + "x" * 1990)])
def test_edit_distance(a, b):
    assert line_dedup.edit_distance(a, b, 10_000) == distance(a, b) or max(len(a), len(b)) <= 10_000
    for least in (0.5, 0.8, 0.95):
        assert line_dedup.similar(a, b, least) == (distance(a, b) <= (1 - least) * max(len(a), len(b)) + 1e-9)


def test_membership_holds_every_key(spark):
    keys = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000)
    edge = np.array([0, 7, 8, 32767, 32768, (1 << 25) - 1, -1, -(2**63)])
    df = spark.createDataFrame([(int(k),) for k in np.concatenate((keys, edge))], "k long")
    table = common.membership(df, F.col("k"))
    assert common.held(table, np.concatenate((keys, edge))).all()
    assert common.held(table, np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 5000)).mean() < 0.01
    assert not common.held(common.membership(df.limit(0), F.col("k")), keys).any()


def test_lines_with_a_changed_word_are_linked(spark):
    """Without a radius edit similarity alone decides; all pairs of lines are the measure."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9)))
    rows, lines = [], []
    for n in (2, 3, 4, 6, 8, 12, 20, 28, 45, 90):
        for _ in range(12):
            a = [word() for _ in range(n)]
            b = list(a)
            i = int(rng.integers(n))
            b[i] = b[i][:-1] + "0" if n < 6 else "".join(rng.permutation(list(b[i])))
            lines.append((" ".join(a), " ".join(b)))
            rows += [(len(rows), lines[-1][0]), (len(rows) + 1, lines[-1][1])]
    df = spark.createDataFrame([(d, t, "en", "s", 1, 7, "x") for d, t in rows], SCHEMA)
    gone = {r.doc_id for r in line_dedup.deduplicate(df, radius=None).where("n_dropped = 1").collect()}
    want = {2 * k + 1 for k, (a, b) in enumerate(lines) if distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9}
    assert not gone - want
    assert len(want) >= 110 and len(gone) >= 0.95 * len(want)
    assert len({r.doc_id for r in line_dedup.deduplicate(df).where("n_dropped = 1").collect()}) < len(gone) / 2


def test_bounds_lose_no_similar_pair():
    """Parities, counts of character pairs and the upper bound against the distance itself."""
    rng = np.random.default_rng(4)
    a, b = [], []
    for _ in range(600):
        x = list(rng.choice(list("abcdé "), rng.integers(0, 90)))
        y = list(x)
        for _ in range(rng.integers(0, max(1, len(x) // 4) + 1)):
            k = int(rng.integers(0, len(y) + 1))
            if rng.random() < 0.5:
                y.insert(k, "z")
            elif k < len(y):
                y[k] = "q"
        a.append("".join(x))
        b.append("".join(y))
    want = [distance(x, y) for x, y in zip(a, b)]
    most = [int(0.2 * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b)]
    assert line_dedup.similar_pairs(a, b, 0.8).tolist() == [d <= m for d, m in zip(want, most)]
    odd = [line_dedup.parities(x) for x in (a, b)]
    differ = np.unpackbits((odd[0] ^ odd[1]).view(np.uint8), axis=1).sum(axis=1)
    for x, y, d, m, n in zip(a, b, want, most, differ.tolist()):
        assert line_dedup.changed_characters(x, y) >= d
        assert d > m or n <= 4 * m - abs(len(x) - len(y))


def test_lines_of_a_repeated_id_stay(spark):
    """Rows of one doc_id with different texts are documents of their own."""
    df = spark.createDataFrame([(5, "A first line\nonly here it stands", "en", "s", 1, 7, "x"), (5, "other beginning\nA first line", "en", "s", 1, 7, "x")], SCHEMA)
    rows = [(r.text, r.n_dropped) for r in line_dedup.deduplicate(df, radius=None).collect()]
    kept = sorted(x for t, _ in rows for x in t.split("\n") if x)
    assert kept == ["A first line", "only here it stands", "other beginning"] and sum(n for _, n in rows) == 1


def test_company_of_packed_ranges(spark, monkeypatch):
    """Pairs of small buckets and members of larger ones, with and without compaction, against plain groups."""
    rng = np.random.default_rng(3)
    key = np.concatenate((rng.integers(0, 2**63, 300).astype(np.uint64).repeat(rng.integers(1, 9, 300)), np.full(200, 77, np.uint64) << np.uint64(40)))
    node = rng.integers(0, 10**6, len(key))
    want = {}
    for k, n in zip(key.tolist(), node.tolist()):
        want.setdefault(k, set()).add(n)
    for most in (1 << 22, 50):
        monkeypatch.setattr(line_dedup, "MOST_KEYS", most)
        part, body = line_dedup.packed(np.concatenate((key, key)), np.concatenate((node, node)), 4)
        df = spark.createDataFrame([(int(p), bytes(x)) for p, x in zip(part, body)] * 2, "part int, body binary").coalesce(1).sortWithinPartitions("part")
        rows = line_dedup.company(df).distinct().collect()
        pairs = {(r.x, r.y) for r in rows if not r.large}
        assert pairs == {(x, y) for s in want.values() if 2 <= len(s) <= line_dedup.SMALL for x in s for y in s if x < y}
        assert sorted(r.y for r in rows if r.large) == sorted(n for s in want.values() if len(s) > line_dedup.SMALL for n in s)


def test_distances_of_many_pairs(monkeypatch):
    """Lines around the borders of machine words, of many lengths and alphabets at once, against the plain distance."""
    monkeypatch.setattr(line_dedup, "FEW_PAIRS", 1)
    rng = np.random.default_rng(6)
    a, b = [], []
    for _ in range(500):
        x = list(rng.choice(list("abcdeé 漢"), int(rng.choice([1, 5, 63, 64, 65, 127, 128, 129, 300]))))
        y = list(x)
        for _ in range(rng.integers(0, len(x) // 2 + 2)):
            k, r = int(rng.integers(0, len(y))), rng.random()
            y[k : k + 1] = [y[k], "z"] if r < 0.3 else ["q"] if r < 0.7 or len(y) == 1 else []
        a.append("".join(x))
        b.append("".join(y))
    want = np.array([distance(x, y) for x, y in zip(a, b)])
    assert line_dedup.within(a, b, want).all() and not line_dedup.within(a, b, want - 1).any()
    most = [int(0.2 * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b)]
    assert line_dedup.similar_pairs(a, b, 0.8).tolist() == [d <= m for d, m in zip(want, most)]


def test_parities_of_many_short_lines_are_bounded_in_memory():
    """A step of text may be a hundred thousand lines: their counts are taken in parts, with the same parities."""
    lines = [f"no {k}" for k in range(100_000)]
    tracemalloc.start()
    got = line_dedup.parities(lines)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    for k in (0, 4095, 4096, 99_999):
        assert got[k].tolist() == line_dedup.parities(lines[k : k + 1])[0].tolist()
    assert line_dedup.parities([]).shape == (0, len(line_dedup.ODD))


def test_bodies_give_memory_back():
    """What a task has freed does not stay with its worker, though something that lives lies above it."""
    resident = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024

    def run(batches):
        junk = [np.ones(12_000) for _ in range(2000)]  # 190 MB in pieces that are no mappings of their own
        above = np.ones(12_000)
        del junk
        yield from ((b, above) for b in batches)

    before = resident()
    kept = list(common.released(run)([1, 2]))
    assert [k[0] for k in kept] == [1, 2] and resident() - before < 60


def test_distances_of_large_alphabets_are_bounded_in_memory():
    """Many pairs of long lines of thousands of different characters are taken in parts."""
    rng = np.random.default_rng(9)
    a = ["".join(map(chr, rng.integers(0x4E00, 0x5A00, 1000))) for _ in range(400)]
    b = [t[:500] + "x" * (k % 400) + t[500 + k % 400 :] for k, t in enumerate(a)]
    tracemalloc.start()
    got = line_dedup.similar_pairs(a, b, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [k % 400 <= 200 for k in range(400)]
    assert peak < 100_000_000


@pytest.mark.parametrize("tile", [2048, 16])
def test_lines_of_one_passage_are_no_rows(spark, monkeypatch, tile):
    """Lines that share a passage but are not similar are compared where they meet; pairs that are linked come out, and few others."""
    monkeypatch.setattr(line_dedup, "TILE", tile)
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 6)))
    passage = [word() for _ in range(40)]
    rows = [(k, " ".join([word() for _ in range(35)] + passage + [word() for _ in range(25)])) for k in range(45)]
    rows += [(100 + k, t.replace(" ", " q ", 1)) for k, t in rows[::4]]
    rows += [(300 + k, "x" * 3000 + f"{rows[0][1]} v{k}") for k in range(7)]
    written, met = line_dedup.written, {}

    def counted(df, name):
        out = written(df, name)
        met[name] = met.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(common, "written", counted)
    monkeypatch.setattr(line_dedup, "WIDE", 64)
    df = spark.createDataFrame([(d, t, "en", "s", 1, 7, "x") for d, t in rows], SCHEMA)
    got = {r.doc_id for r in line_dedup.deduplicate(df, radius=None).where("n_dropped = 1").collect()}
    later = [j for j, (d, t) in enumerate(rows) if any(abs(len(t) - len(u)) <= 0.2 * len(t) and distance(t, u) <= 0.2 * max(len(t), len(u)) + 1e-9 for _, u in rows[:j])]
    assert got == {rows[j][0] for j in later} and len(later) > 10
    assert met["lines-met"] < 60 and met["lines-pairs"] < 30 * len(rows)


class Rows:
    """Takes the body of a mapInArrow, to run it here."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_lines_at_other_places_are_not_parsed(monkeypatch):
    """The passes over lines with company cut texts to lines, and parse those at the places asked for alone."""
    texts = [f"Line, one {d}\n\nline two {d}\n" + "\n".join(f"other line {k}" for k in range(50)) for d in range(20)]
    dk = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, len(texts))
    table = np.zeros(1 << (common.TABLE_BITS - 3), np.uint8)
    for d in dk[::2]:
        at = int(d ^ 2) & ((1 << common.TABLE_BITS) - 1)
        table[at >> 3] |= 1 << (at & 7)
    parsed, words = [], line_dedup.Words
    monkeypatch.setattr(line_dedup, "Words", lambda lines: parsed.append(len(lines)) or words(lines))
    batch = pa.RecordBatch.from_arrays([pa.array(dk), pa.array(texts)], ["dk", "text"])
    rows = pa.Table.from_batches(line_dedup.line_texts(Rows(), table)([batch])).to_pydict()
    assert rows["line"] == [f"line two {d}" for d in range(0, 20, 2)] and rows["dk"] == dk[::2].tolist()
    assert len(list(line_dedup.packed_bands(Rows(), table, 0.8, 4)([batch]))) == 1
    assert parsed == [10, 10]


def test_lines_with_few_changes_need_no_distance(monkeypatch):
    """Long lines that are near by an upper bound are linked without their distance."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    a = [" ".join(word() for _ in range(100)) for _ in range(200)]
    b = [t.replace(t.split(" ")[k // 4 + 10], "changed", 1) for k, t in enumerate(a)]

    def none(*_):
        raise AssertionError

    monkeypatch.setattr(line_dedup, "within", none)
    monkeypatch.setattr(line_dedup, "edit_distance", none)
    assert line_dedup.similar_pairs(a, b, 0.8).all()


@pytest.mark.parametrize("columns", [1, 7, 64, 256])
def test_distances_near_the_diagonal(monkeypatch, columns):
    """Rows left behind or not begun change no result: insertions, deletions, moved and unlike parts, at and below the distance."""
    monkeypatch.setattr(line_dedup, "COLUMNS", columns)
    rng = np.random.default_rng(columns)
    a, b = [], []
    for k in range(120):
        x = list(rng.choice(list("abcdeé 漢"), int(rng.choice([65, 129, 300, 500]))))
        y = list(x)
        for _ in range(rng.integers(0, len(x) // 3)):
            i, r = int(rng.integers(0, len(y))), rng.random()
            y[i : i + 1] = [y[i], "z"] if r < 0.3 else ["q"] if r < 0.7 or len(y) == 1 else []
        cut = int(rng.integers(0, len(x) // 4))
        y = [y, y[cut:] + y[:cut], y[cut:], y + list(rng.choice(list("abc"), cut)), list(rng.choice(list("abcde"), len(x)))][k % 5]
        a.append("".join(x))
        b.append("".join(y))
    want = np.array([distance(x, y) for x, y in zip(a, b)])
    longer = np.array([max(len(x), len(y)) for x, y in zip(a, b)])
    for most in (want, want - 1, longer // 10, longer // 3):
        most = np.maximum(most, 0)
        assert line_dedup.within(a, b, most).tolist() == (want <= most).tolist()
        assert [line_dedup.edit_distance(x, y, m) <= m for x, y, m in zip(a, b, most.tolist())] == (want <= most).tolist()


def test_common_ends_are_left_out_of_distances(monkeypatch):
    """Pairs whose middles alone are of moderate length go together, however long the texts; results are those of single distances."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    a, b = [], []
    for k in range(200):
        ends, words = [" ".join(word() for _ in range(100)) for _ in range(2)], [word() for _ in range(150)]
        other = [w[:2] + "x" * (k % 5) + w[3:] for w in words]
        a.append(" ".join((ends[0], *words, ends[1])))
        b.append(" ".join((ends[0], "y", *other, ends[1])))
    least = lambda x, y: int((1 - 0.9) * max(len(x), len(y)) + 1e-9)
    want = [line_dedup.edit_distance(x, y, least(x, y)) <= least(x, y) for x, y in zip(a, b, strict=True)]
    assert min(map(len, a)) > line_dedup.MANY_CHARS and 0 < sum(want) < 200
    monkeypatch.setattr(line_dedup, "edit_distance", lambda *x: pytest.fail("a pair went alone"))
    assert line_dedup.similar_pairs(a, b, 0.9).tolist() == want
