"""Collocation mining by suffix sorting: all phrases of up to max_n words with their counts, from one sort of truncated suffixes.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line breaks and those into words at blanks and tabs.  One
pass counts words by language, one pairs of neighbouring words by their hashes.  No frequent phrase holds a word or a pair
below the least count, so the last pass cuts the pieces there, and sends the suffix of up to max_n words at each word,
counted within a step of text, to the partition of its language and first word.  There the suffixes are sorted in reverse order and the counts of all prefixes follow in one
scan, with the open prefixes of the last suffix as its only state.  The counts of a phrase's parts are joined afterwards.

Hot words and pairs are those that stand at least ``HOT_ROWS`` times and have a share of ``HOT_SHARE`` of all words.  A suffix
that begins with a hot word is dealt by two words, and by as many more as it goes on with hot pairs, so no group has more
rows than the least hot count.  Phrases that are such a beginning are then counted in parts, which are summed; all others
are whole in their partition.

Scale: texts stream in bounded steps; what tasks get is two bitmaps of 4 MB, of the frequent words and pairs, which only let
rare ones pass where they are full, as do pairs of one hash, and at most 1 / HOT_SHARE hot words and pairs.  Suffixes are shuffled once, counts of phrases after that;
phrases above the least count number at most max_n times the words divided by it.  The first rows of a language come from
parts of its candidates, so that no task sorts them all.

Defined results: null and empty texts have no words; a null language is ``und``; ties go by count and then by phrase in
byte order; repeated rows count as often as they stand; other columns are ignored; an empty table has no phrases.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import held, membership, mix, no_rows, string_hashes, text_steps, written

LEAST, MAX_N, TOP = 100, 5, 2000
#: A word or pair is hot from this share of all words on, and from so many places on: smaller groups need no split.
HOT_SHARE, HOT_ROWS = 1 / 65536, 1 << 16
#: Parts of a language's candidates that are ranked by themselves first.
RANK_PARTS = 256
#: Bytes of suffixes that one batch holds.
BATCH_BYTES = 8_000_000

# Blanks within a piece, and ends of pieces.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2


def _word_hash(word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix(word ^ mix(lang, 5), 6)


class Pieces:
    """Words of a step's texts: codes into `distinct` (language and word), where pieces end, and the words' bytes, each with a blank after it."""

    def __init__(self, texts, langs):
        import pyarrow as pa

        texts = texts.cast(pa.large_string()).fill_null("")
        langs = langs.fill_null("und").dictionary_encode()
        _, offsets, data = texts.buffers()
        offs = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        kind = _KIND[body]
        word = kind == 0
        edge = np.zeros(len(body) + 1, bool)
        edge[offs - offs[0]] = True
        before, after = np.zeros(len(body), bool), np.zeros(len(body), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        text = np.searchsorted(offs - offs[0], starts, "right") - 1
        self.piece = np.cumsum(kind == 2)[starts] + text
        size = ends - starts
        plain = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64)), pa.py_buffer(_LOWER[body[word]])])
        plain = plain.dictionary_encode()
        self.words, self.langs = plain.dictionary, langs.dictionary
        lang = langs.indices.to_numpy()[text]
        both, self.codes = np.unique(lang.astype(np.int64) * max(len(self.words), 1) + plain.indices.to_numpy(), return_inverse=True)
        self.word_of, self.lang_of = both % max(len(self.words), 1), both // max(len(self.words), 1)
        self.hashes = _word_hash(string_hashes(self.words)[self.word_of], string_hashes(self.langs)[self.lang_of])
        self.at = np.concatenate(([0], np.cumsum(size + 1)))
        self.bytes = np.full(self.at[-1], 32, np.uint8)
        inside = np.ones(len(self.bytes), bool)
        inside[self.at[1:] - 1] = False
        self.bytes[inside] = _LOWER[body[word]]


def _strings(body: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """An Arrow string array of the ranges of bytes."""
    import pyarrow as pa

    size = ends - starts
    offsets = np.concatenate(([0], np.cumsum(size)))
    take = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body[take])])


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, c): count of each language's words; the row of word null has the language's number of words."""

    def run(batches):
        import pyarrow as pa

        for batch in text_steps(batches):
            p = Pieces(batch.column("text"), batch.column("lang"))
            if len(p.codes):
                c, lang = np.bincount(p.codes), pa.array(p.lang_of)
                yield pa.RecordBatch.from_arrays([p.langs.take(lang).cast(pa.string()), p.words.take(pa.array(p.word_of)).cast(pa.string()), pa.array(c)], ["lang", "word", "c"])
                n = np.bincount(p.lang_of, weights=c, minlength=len(p.langs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([p.langs.cast(pa.string()), pa.nulls(len(n), pa.string()), pa.array(n)], ["lang", "word", "c"])

    return docs.mapInArrow(run, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))


def hashed(words: DataFrame) -> DataFrame:
    """words (lang, word, c) with h, the hash that the passes over the texts know them by."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lang, word = (string_hashes(batch.column(c)) for c in ("lang", "word"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_word_hash(word, lang).view(np.int64))], ["lang", "word", "c", "h"])

    return words.select("lang", "word", "c").mapInArrow(run, "lang string, word string, c long, h long")


def _pairs(p: Pieces) -> np.ndarray:
    """Hash of each word with the next one."""
    h = p.hashes[p.codes]
    return mix(mix(h[:-1]) ^ h[1:], 1)


def _bonds(p: Pieces, frequent: np.ndarray) -> np.ndarray:
    """Whether each word and the next one stand in one piece and may both be frequent."""
    alive = held(frequent, p.hashes)[p.codes]
    return alive[:-1] & alive[1:] & (p.piece[:-1] == p.piece[1:])


def pair_counts(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(h, c): count of the neighbouring words of each hash; frequent is a bitmap of word hashes."""

    def run(batches):
        import pyarrow as pa

        for batch in text_steps(batches):
            p = Pieces(batch.column("text"), batch.column("lang"))
            if len(p.codes) > 1:
                h, c = np.unique(_pairs(p)[_bonds(p, frequent)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    return docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def suffixes(docs: DataFrame, frequent: np.ndarray, pairs: np.ndarray, hot: np.ndarray, hot_pairs: np.ndarray, max_n: int = MAX_N) -> DataFrame:
    """(key, lang, suffix, deep, c): the suffixes of 2 to max_n words, each word with a blank after it, counted within a step.

    frequent and pairs are bitmaps of hashes of words and pairs, hot and hot_pairs arrays of them.  deep is the number of words
    of the longest hot beginning, whose pairs are all hot; key is the hash of the words that the suffix is dealt by.
    """

    def run(batches):
        import pyarrow as pa

        for batch in text_steps(batches):
            p = Pieces(batch.column("text"), batch.column("lang"))
            n = len(p.codes)
            if n < 2:
                continue
            is_hot, bond = np.isin(p.hashes, hot)[p.codes], _pairs(p)
            is_hot_pair = np.isin(bond, hot_pairs)
            # where the run of frequent pairs of a piece that holds each word ends
            cut = np.append(np.flatnonzero(~(_bonds(p, frequent) & held(pairs, bond))) + 1, n)
            size = np.minimum(cut[np.searchsorted(cut, np.arange(n), "right")] - np.arange(n), max_n)
            first = np.flatnonzero(size >= 2)
            if not len(first):
                continue
            size = size[first]
            h = p.hashes[p.codes]
            deep, lead, whole, key = np.zeros(len(first), np.int32), np.ones(len(first), bool), size.astype(np.uint64), np.zeros(len(first), np.uint64)
            for k in range(max_n):
                more = size > k
                at = np.minimum(first + k, n - 1)
                whole = np.where(more, mix(whole ^ h[at], k), whole)
                key = np.where(more & lead, mix(key ^ h[at], k), key)
                lead &= more & (is_hot_pair[np.minimum(first + k - 1, n - 2)] if k else is_hot[at])
                deep += lead
            # equal suffixes of the step are one row; rows of equal hash and other words stay rows of their own
            _, one, where, times = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
            rep = one[where]
            same = size == size[rep]
            for k in range(max_n):
                same &= (size <= k) | (p.codes[np.minimum(first + k, n - 1)] == p.codes[np.minimum(first[rep] + k, n - 1)])
            if not same.all():
                odd = np.flatnonzero(~same)
                times = times - np.bincount(where[odd], minlength=len(one))
                one, times = np.concatenate((one, odd)), np.concatenate((times, np.ones(len(odd), np.int64)))
            lo, hi = p.at[first[one]], p.at[first[one] + size[one]]
            total = np.cumsum(hi - lo)
            a = 0
            while a < len(one):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BATCH_BYTES, "right")))
                rows = one[a:b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key[rows] >> np.uint64(33)).astype(np.int32)), p.langs.take(pa.array(p.lang_of[p.codes[first[rows]]])).cast(pa.string()), _strings(p.bytes, lo[a:b], hi[a:b]).cast(pa.string()), pa.array(deep[rows]), pa.array(times[a:b])],
                    ["key", "lang", "suffix", "deep", "c"],
                )
                a = b

    return docs.mapInArrow(run, "key int, lang string, suffix string, deep int, c long")


def prefix_counts(sorted_suffixes: DataFrame, least: int = LEAST, max_n: int = MAX_N) -> DataFrame:
    """(lang, phrase, m, c, whole): counts of the prefixes of 2 to max_n words, from partitions sorted by language and suffix.

    Prefixes that are whole in their partition come if they reach the least count; of others the partition's part comes.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["lang", "phrase", "m", "c", "whole"]
        stack = None  # the last suffix: language, words, hot words at its beginning, and the open count of each prefix

        def popped(above: int):
            lang, words, deep, open_ = stack
            found = [(lang, b" ".join(words[:m]).decode(), m, open_[m], m > deep or m == max_n) for m in range(max(above, 1) + 1, len(words) + 1)]
            found = [x for x in found if x[3] >= least or not x[4]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_()), strict=True)], names)

        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            lang = batch.column("lang").dictionary_encode()
            langs, lang = lang.dictionary, lang.indices.to_numpy()
            deep, c = batch.column("deep").to_numpy(), batch.column("c").to_numpy()
            text = batch.column("suffix").cast(pa.large_string())
            _, offsets, data = text.buffers()
            offs = np.frombuffer(offsets, np.int64, rows + 1, text.offset * 8)
            body = np.frombuffer(data, np.uint8)
            ends = np.flatnonzero(body[offs[0] : offs[-1]] == 32) + offs[0]  # each word's blank
            upto = np.searchsorted(ends, offs)
            size = np.diff(upto)
            begins = np.concatenate((offs[:1], ends[:-1] + 1))
            codes = _strings(body, begins, ends).dictionary_encode().indices.to_numpy()
            words = np.full((rows, max_n), -1, np.int64)
            row = np.repeat(np.arange(rows), size)
            place = np.arange(len(codes)) - upto[row]
            words[row, place] = codes
            stop = np.zeros((rows, max_n), np.int64)
            stop[row, place] = ends
            common = np.zeros(rows, np.int64)  # words shared with the suffix before
            alike = lang[1:] == lang[:-1]
            for k in range(max_n):
                alike = alike & (words[1:, k] == words[:-1, k]) & (words[1:, k] >= 0)
                common[1:] += alike
            first_words = bytes(body[offs[0] : offs[1]]).split(b" ")[:-1]
            if stack is not None:
                if stack[0] == langs[int(lang[0])].as_py():
                    for x, y in zip(stack[1], first_words):
                        if x != y:
                            break
                        common[0] += 1
                yield from popped(int(common[0]))
            last = {}
            for m in range(2, max_n + 1):
                start = np.flatnonzero(common < m)
                if stack is not None and common[0] >= m:
                    start = np.concatenate(([0], start))
                elif not len(start) or start[0] != 0:
                    start = np.concatenate(([0], start))
                sums = np.add.reduceat(np.where(size >= m, c, 0), start)
                if stack is not None and common[0] >= m:
                    sums[0] += stack[3][m]
                if size[-1] >= m:  # still open
                    last[m] = int(sums[-1])
                    start, sums = start[:-1], sums[:-1]
                whole = (deep[start] < m) | (m == max_n)
                keep = (size[start] >= m) & ((sums >= least) | ~whole)
                start, sums, whole = start[keep], sums[keep], whole[keep]
                if len(start):
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[start])), _strings(body, offs[start], stop[start, m - 1]).cast(pa.string()), pa.array(np.full(len(start), m, np.int32)), pa.array(sums), pa.array(whole)], names)
            stack = (langs[int(lang[-1])].as_py(), bytes(body[offs[-2] : offs[-1]]).split(b" ")[:-1], int(deep[-1]), last)
        if stack is not None:
            yield from popped(0)

    return sorted_suffixes.select("lang", "suffix", "deep", "c").mapInArrow(run, "lang string, phrase string, m int, c long, whole boolean")


def phrases(docs: DataFrame, least: int = LEAST, max_n: int = MAX_N) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, a) of all phrases of 1 to max_n words that occur at least `least` times, and (lang, n); both written tables."""
    spark = docs.sparkSession
    docs = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    vocabulary = written(word_counts(docs).where((F.col("c") >= least) | F.col("word").isNull()), "phrase-words")
    totals = written(vocabulary.where("word is null").select("lang", F.col("c").alias("n")), "phrase-totals")
    frequent = hashed(vocabulary.where("word is not null"))
    every = totals.agg(F.sum("n")).first()[0]
    if not every:
        return no_rows(spark, "lang string, phrase string, m int, a long"), totals
    bits, level = membership(frequent, F.col("h")), max(every * HOT_SHARE, HOT_ROWS)
    pairs = written(pair_counts(docs, bits).where(F.col("c") >= least), "phrase-pairs")
    hot, hot_pairs = (np.array([r.h for r in t.where(F.col("c") >= level).select("h").collect()], np.int64).view(np.uint64) for t in (frequent, pairs))  # at most 1 / HOT_SHARE each
    rows = suffixes(docs, bits, membership(pairs, F.col("h")), hot, hot_pairs, max_n)
    counted = written(prefix_counts(rows.repartition("key").sortWithinPartitions("lang", F.desc("suffix")), least, max_n), "phrase-prefixes")
    summed = counted.where("not whole").groupBy("lang", "phrase", "m").agg(F.sum("c").alias("a")).where(F.col("a") >= least)
    found = counted.where("whole").select("lang", "phrase", "m", F.col("c").alias("a")).unionByName(summed)
    return written(found.unionByName(frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("m"), F.col("c").alias("a"))), "phrases"), totals


def score(a="a", n="n", l="l", r="r"):  # noqa: E741
    """floor(1000 a n / (l r)), exact for a up to 10^14 and n, l and r up to 10^16."""
    return F.expr(f"(cast(1000 as decimal(4,0)) * cast({a} as decimal(14,0)) * cast({n} as decimal(16,0))) div (cast({l} as decimal(16,0)) * cast({r} as decimal(16,0)))")


def collocations(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, m, a, l, r, n, score, inside): every phrase of 2 words and more by its lowest-scoring cut, ties to the earliest.

    inside: a longer phrase that holds it occurs as often.  Of the longer ones those of one word more suffice, as every
    phrase between the two occurs at least as often as the longer and at most as often as the shorter.
    """
    cands = found.where("m >= 2").withColumn("words", F.split("phrase", " "))
    text = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = cands.select("lang", "phrase", "m", "a", "words", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "m", "a", "k", text(F.lit(1), F.col("k")).alias("first"), text(F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    part = lambda name, out: found.select("lang", F.col("phrase").alias(name), F.col("a").alias(out))
    joined = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    best = joined.groupBy("lang", "phrase", "m", "a", "n").agg(F.min(F.struct(score().alias("score"), "k", "l", "r")).alias("cut"))
    longer = cands.where("m >= 3").select("lang", "a", F.explode(F.array(text(F.lit(1), F.col("m") - 1), text(F.lit(2), F.col("m") - 1))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return best.join(longer, ["lang", "phrase"], "left").select("lang", "phrase", "m", "a", "cut.l", "cut.r", "n", "cut.score", F.coalesce(F.col("longer") >= F.col("a"), F.lit(False)).alias("inside"))


def report(docs: DataFrame, least: int = LEAST, max_n: int = MAX_N, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first collocations that no equally frequent longer one holds."""
    found = collocations(*phrases(docs, least, max_n)).where("not inside").drop("inside", "m")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    for by in (["lang", part], ["lang"]):  # the first rows of each part hold the first rows of the whole
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = LEAST, top: int = TOP) -> str:
    """DuckDB SQL for report() with phrases of up to 5 words."""
    a_z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rf"""WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{a_z[0]}', '{a_z[1]}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w FROM piece),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 6) t(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL), n AS (SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND a >= {least}),
k AS (SELECT lang, phrase, a, w, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, l.a AS l, r.a AS r, n.n, 1000 * k.a::HUGEINT * n.n // (l.a::HUGEINT * r.a) AS score FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[k + 1:], ' ') JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.a >= b.a AND c.phrase <> b.phrase AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM d QUALIFY rank <= {top}"""
