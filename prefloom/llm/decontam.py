"""Benchmark decontamination: rare n-gram seeds join training texts to test items, Smith-Waterman alignment scores them.

Words are lower-cased runs between white space and ASCII punctuation.  One pass over the corpus counts the words of the
benchmark's vocabulary.  A seed of an item is the shortest n-gram from a position on, of 3 to 6 words, whose expected
count in the corpus, were its words independent, is at most ``expected``.  Rarity is judged by words, not by the
n-gram's own count, so an item that has leaked into a third of all documents keeps its seeds.  Where even six words are
not rare, the six words are a seed all the same, so every position has one; items below three words are one seed.

A second pass looks up every n-gram of every whole text among the seeds.  Around hits, a window of the text is aligned
to the item by Smith-Waterman over words (match 2, mismatch and gap -1), so edited and paraphrased copies still score.
A document is contaminated by an item if the best alignment reaches ``least`` of the item's own score.

Scale: both passes stream over the texts in bounded steps, and only aggregated counts and alignments above the
threshold leave a task.  The benchmark goes out in blocks of at most about ``block_chars`` characters, one pass over
the corpus a block, so what is broadcast is bounded by a parameter, whatever the benchmark's size.

Defined results: null and empty texts have no words and match nothing, as items or as documents; null ids stay null in
the result; repeated documents or items give repeated rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, may_hold, released, shingles, text_steps, unpunctuated, written

SHORTEST, LONGEST = 3, 6
MATCH, MISS, GAP = 2, -1, -1
FOUND = "doc_id long, item_id long, score double, doc_start long, doc_end long, item_words long, doc_words long"


def words_of(texts) -> Words:
    import pyarrow.compute as pc

    return Words(unpunctuated(pc.utf8_lower(pc.fill_null(texts, ""))))


def vocabulary_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each word hash of the sorted vocabulary occurs in the corpus, and the number of all words."""

    @released
    def run(batches):
        import pyarrow as pa

        total, counts = 0, np.zeros(len(vocabulary), np.int64)
        for batch in text_steps(batches):
            words = words_of(batch.column("text"))
            h = words.hashes()
            n = np.bincount(words.codes, minlength=len(h))
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            known = vocabulary[at] == h
            np.add.at(counts, at[known], n[known])
            total += len(words.codes)
        k = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array(np.append(counts[k], total))], ["k", "n"])

    out, total = np.zeros(len(vocabulary), np.int64), 0
    for k, n in docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        if k < 0:
            total = n
        else:
            out[k] = n
    return out, total


def seeds(items: list[np.ndarray], log_share: dict[int, float], log_total: float, expected: float) -> dict[int, list[tuple[int, int, int]]]:
    """By n-gram length: (hash, item, position) of the seeds."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    limit = np.log(expected)
    for i, h in enumerate(items):
        if not len(h):
            continue
        top = min(LONGEST, len(h))
        apart, kept = len(h) // 8 + 1, set()
        grams = {n: shingles(h, n) for n in range(min(SHORTEST, top), top + 1)}
        logs = np.array([log_share[int(x)] for x in h])
        for p in range(len(h) - min(SHORTEST, top) + 1):
            for n in grams:
                last = n == top or p + n >= len(h)
                if last or log_total + logs[p : p + n].sum() <= limit:
                    # of a gram that an item repeats, one place of each stretch: windows() allows for the others' diagonals
                    gram = (int(grams[n][p]), p // apart)
                    if gram not in kept:
                        kept.add(gram)
                        out.setdefault(n, []).append((gram[0], i, p))
                    break
    return out


def smith_waterman(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For (item, window) pairs of word hashes: best local alignment score, and where it ends in item and window (exclusive)."""
    out = np.zeros((len(pairs), 3), np.int64)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    at = 0
    while at < len(order):
        group, cells = [], 0
        while at < len(order) and (not group or (len(group) + 1) * max(cells, len(pairs[order[at]][1])) <= 400_000 and len(group) < 512):
            group.append(order[at])
            cells = max(cells, len(pairs[order[at]][1]))
            at += 1
        m, n = max(len(pairs[k][0]) for k in group), max(cells, 1)
        a, b = np.zeros((len(group), m), np.uint64), np.ones((len(group), n), np.uint64)  # pads differ, so they never match
        for r, k in enumerate(group):
            a[r, : len(pairs[k][0])], b[r, : len(pairs[k][1])] = pairs[k]
        slope = np.arange(n + 1, dtype=np.int32) * -GAP
        row = np.zeros((len(group), n + 1), np.int32)
        best, ends = np.zeros(len(group), np.int32), np.zeros((len(group), 2), np.int64)
        for i in range(m):
            new = np.zeros_like(row)
            np.maximum(row[:, :-1] + np.where(a[:, i : i + 1] == b, MATCH, MISS).astype(np.int32), row[:, 1:] + GAP, out=new[:, 1:])
            np.maximum(new, 0, out=new)
            row = np.maximum.accumulate(new + slope, axis=1) - slope
            j = row.argmax(axis=1)
            top = row[np.arange(len(group)), j]
            better = top > best
            best[better], ends[better, 0], ends[better, 1] = top[better], i + 1, j[better]
        out[group, 0], out[group, 1:] = best, ends
    return out


def windows(hits: np.ndarray, item_words: int, doc_words: int) -> list[tuple[int, int]]:
    """Stretches of the document around the diagonals (document position less item position) of an item's seed hits."""
    slack = item_words // 2 + item_words // 8 + 9
    out: list[tuple[int, int]] = []
    for d in np.unique(hits):
        low, high = max(int(d) - slack, 0), min(int(d) + item_words + slack, doc_words)
        if out and low <= out[-1][1] and high - out[-1][0] <= 6 * item_words + 64:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _finder(item_ids: list, items: list[np.ndarray], by_length: dict[int, list[tuple[int, int, int]]], least: float):
    tables = {}
    for n, rows in by_length.items():
        rows = sorted(rows)
        h = np.array([r[0] for r in rows], np.uint64)
        filter_bits = np.zeros(1 << 20, bool)
        filter_bits[h >> np.uint64(44)] = True
        tables[n] = (h, np.array([r[1:] for r in rows], np.int64), filter_bits)

    @released
    def run(batches):
        import pyarrow as pa

        for batch in text_steps(batches):
            words = words_of(batch.column("text"))
            h, starts = words.hashes()[words.codes], words.offsets
            hits = []  # document of the batch, item, diagonal
            for n, (keys, where, filter_bits) in tables.items():
                grams = shingles(h, n)
                p = np.flatnonzero(filter_bits[grams >> np.uint64(44)])
                low, high = np.searchsorted(keys, grams[p], "left"), np.searchsorted(keys, grams[p], "right")
                p, low, count = p[high > low], low[high > low], (high - low)[high > low]
                doc = np.searchsorted(starts, p, "right") - 1
                inside = p + n <= starts[doc + 1]
                p, low, count, doc = p[inside], low[inside], count[inside], doc[inside]
                each = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                item, pos = where[each].T if len(each) else (np.zeros(0, int), np.zeros(0, int))
                hits.append(np.stack((np.repeat(doc, count), item, np.repeat(p - starts[doc], count) - pos), axis=1))
            if not hits or not sum(map(len, hits)):
                continue
            hits = np.unique(np.concatenate(hits), axis=0)
            cut = np.flatnonzero(np.any(np.diff(hits[:, :2], axis=0) != 0, axis=1)) + 1
            todo = []
            for group in np.split(hits, cut):
                doc, item = int(group[0, 0]), int(group[0, 1])
                text = h[starts[doc] : starts[doc + 1]]
                todo += [(doc, item, low, text[low:high]) for low, high in windows(group[:, 2], len(items[item]), len(text))]
            scores = smith_waterman([(items[item], part) for _, item, _, part in todo])
            best: dict[tuple[int, int], tuple] = {}
            for (doc, item, low, part), (score, i_end, end) in zip(todo, scores.tolist(), strict=True):
                share = score / (MATCH * len(items[item]))
                if share >= least and share > best.get((doc, item), (0,))[0]:
                    best[doc, item] = (share, low, end, i_end, part)
            if not best:
                continue
            back = smith_waterman([(items[item][:i_end][::-1], part[:end][::-1]) for (_, item), (_, _, end, i_end, part) in best.items()])
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[doc], item_ids[item], share, low + end - int(r[2]), low + end, len(items[item]), int(starts[doc + 1] - starts[doc])) for ((doc, item), (share, low, end, _, _)), r in zip(best.items(), back, strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return run


def contaminations(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, expected: float = 1.0, block_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, score, span in words) of every document and item whose alignment reaches `least`."""
    import pyarrow as pa

    spark = docs.sparkSession
    corpus = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    tests = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("text is not null")
    size = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    parts = []
    for b in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        words = words_of(pa.array([r[1] for r in rows], pa.string()))
        h = words.hashes()[words.codes]
        items = [h[s:e] for s, e in zip(words.offsets, words.offsets[1:], strict=False)]
        vocabulary = np.unique(h)
        if not len(vocabulary):
            continue
        counts, total = vocabulary_counts(corpus, vocabulary)
        share = dict(zip(vocabulary.tolist(), np.log((counts + 0.5) / (total + 1.0)).tolist(), strict=True))
        by_length = seeds(items, share, float(np.log(total + 1.0)), expected)
        parts.append(corpus.mapInArrow(_finder([r[0] for r in rows], items, by_length, least), FOUND))
    if not parts:
        return spark.createDataFrame([], FOUND)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that no item contaminates, columns as they are; a document is a row's doc_id and text, and a null text has no item."""
    text = docs["text"].cast("string")
    key = F.when(text.isNotNull(), F.xxhash64(docs["doc_id"].cast("long"), text))
    keyed = docs.select(key.alias("doc_id"), docs["text"])
    bad = written(contaminations(keyed, benchmark, **settings).select(F.col("doc_id").alias("bad")).distinct(), "contaminated")
    rows = may_hold(docs.select(F.struct(*docs.columns).alias("row"), key.alias("key")), F.col("key"), bad, F.col("bad"), "suspect")
    kept = rows.where("suspect").join(bad, F.col("key") == F.col("bad"), "left_anti")
    return rows.where("not suspect").select("row").unionByName(kept.select("row")).select("row.*")
