"""MinHash near-duplicates by DartMinHash: hashed darts into weighted element regions, the earliest per coordinate kept.

A document is the multiset of its five-word shingles (lower-cased white-space words).  An element of weight w owns the
region [0, w) of its line, cut into cells of width one.  Every cell receives a Poisson process of darts, whose arrival
times, coordinates and positions in the cell are hashes of (element, cell, number of the dart), so two documents see the
same darts wherever their regions overlap.  A document takes the darts up to time t / weight, about k ln k + 2k of them
however large it is; nearly all cells are passed over with one hash, for their first dart comes later.  Of each of the k
coordinates the earliest dart is the signature, and two signatures agree in a coordinate with the probability of the
weighted Jaccard similarity.  Where a coordinate is still empty, the time is doubled for that document.

Bands of ``per_band`` coordinates are joined.  A join of a band also compares the weights and two sketches, so documents
that share a passage but are not similar are no rows of it: four bits of each of 128 coordinates, and the parities of
the cells in each of ``PARITIES`` bins.  The parities of two documents differ in no more bins than cells are in one of
the two only, so a bound on that number from similarity and weights loses no pair; it is sharp where documents are of
some thousand words at most, the coordinates where they are longer.  (A pair at 0.8 shares a band but for 1 in 30,000,
and its coordinates pass but for about as many.)  What is left is verified by the exact weighted Jaccard similarity,
and classes are the connected components of verified links: see common.bucket_components, which checks a large bucket
of copies with one pair a member and loses no link between components.

Scale: exact copies are one text from the start; a band bucket is a hash with 16 bytes a member; a membership table of
fixed size keeps keys and texts without company out of the shuffles; of a text with company the cells move, once.
Nothing is collected, capped or sampled, and what is broadcast is 4 MB.  A bucket whose documents are all close to each
other but not linked is compared pair by pair within the join, on the sketches alone.

Defined results: null and empty texts count as one empty text, so they are copies of each other; texts below five words
are one shingle; the class id is the smallest doc_id of the class (null if all are null); every row, repeated or not, is
in the result, with its text's class; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bucket_components, held, may_hold, membership, mix, released, shingles, text_steps, uniform, written

SHINGLE = 5
PLANES = 4  # bits of each of the first 128 coordinates in a sketch
MARKS = [f"m{i}" for i in range(2 * PLANES)]
PARITIES = 1024
ODD = [f"o{i}" for i in range(PARITIES // 64)]
#: Characters that a text counts as besides its own in a step: its darts, some 900 times 24 bytes, and the counts of its parities.
TEXT_COST = 2000
#: Of 128 coordinates as many may differ at similarity `least` and four standard deviations more.
ALLOWED = lambda least: int(128 * (1 - least) * (1 - 2.0**-PLANES) + 4 * (128 * least * (1 - least)) ** 0.5)


def cells(word_hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' weight cells, each occurrence of a shingle a cell of its own, and where each text's cells begin."""
    n = np.diff(starts)
    grams = shingles(word_hashes, SHINGLE)
    own = np.maximum(n - SHINGLE + 1, (n > 0).astype(n.dtype))  # a shorter text is one shingle
    first = np.concatenate(([0], np.cumsum(own)))
    doc = np.repeat(np.arange(len(n)), own)
    at = np.arange(first[-1]) - np.repeat(first[:-1] - starts[:-1], own)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    h = grams[np.minimum(at, max(len(grams) - 1, 0))] if len(grams) else np.zeros(len(at), np.uint64)
    for d in short.tolist():
        h[first[d]] = shingles(word_hashes[starts[d] : starts[d + 1]], int(n[d]))[0]
    key = mix(h ^ mix(doc.astype(np.uint64), 13))
    order = np.argsort(key)
    new = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0))) if len(key) else np.zeros(0, int)
    nth = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
    again = order[nth > 0]
    h[again] = mix(h[again] ^ mix(nth[nth > 0].astype(np.uint64), 11), 12)
    return h, first


def darts(cell: np.ndarray, until: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell's index, time, hash) of the darts that land in each cell up to its `until`.

    Of a cell of which the document owns a share below 1 only the darts in that part count.
    """
    where, times, marks = [], [], []
    live, clock = np.arange(len(cell)), np.zeros(len(cell))
    nth = 0
    while len(live):
        h = mix(cell[live], 100 + nth)
        clock = clock - np.log(uniform(h))
        hit = clock <= until[live]
        live, clock, h = live[hit], clock[hit], h[hit]
        mark = mix(h, 7)
        mine = slice(None) if share is None else uniform(mix(mark, 8)) < share[live]
        where.append(live[mine])
        times.append(clock[mine])
        marks.append(mark[mine])
        nth += 1
    if not where:
        return np.zeros(0, int), np.zeros(0), np.zeros(0, np.uint64)
    return np.concatenate(where), np.concatenate(times), np.concatenate(marks)


def signatures(cell: np.ndarray, starts: np.ndarray, k: int, share: np.ndarray | None = None) -> np.ndarray:
    """For each text the mark of the earliest dart of each of k coordinates; rows of texts without weight are 0."""
    n = len(starts) - 1
    doc = np.repeat(np.arange(n), np.diff(starts))
    weight = np.diff(starts).astype(float) if share is None else np.bincount(doc, share, n)
    until = (k * np.log(k) + 2 * k) / np.maximum(weight, 1e-300)
    out, todo = np.zeros((n, k), np.uint64), weight > 0
    while todo.any():
        rows = np.flatnonzero(todo[doc])
        at, time, mark = darts(cell[rows], until[doc[rows]], None if share is None else share[rows])
        order = np.argsort(-time, kind="stable")
        slot = doc[rows[at[order]]] * k + (mark[order] % np.uint64(k)).astype(np.int64)
        seen = np.zeros(n * k, bool)
        out.reshape(-1)[slot] = mark[order]  # of several writes to a coordinate the last stays: the earliest dart
        seen[slot] = True
        todo &= ~seen.reshape(n, k).all(axis=1)
        until *= 2
    return out


def weighted(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells and shares of elements with any weights above 0, for signature()."""
    n = np.ceil(weights).astype(np.int64)
    of = np.repeat(np.arange(len(elements)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    cell = np.where(nth == 0, elements[of], mix(elements[of] ^ mix(nth.astype(np.uint64), 11), 12))
    return cell, np.minimum(weights[of] - nth, 1.0)


def _cells_of(batches):
    """For each step of texts: the batch, and the texts' cells."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in text_steps(batches, each=TEXT_COST):
        words = Words(pc.utf8_lower(batch.column("text").cast(pa.large_string())))
        h = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
        yield batch, *cells(h, words.offsets)


def keyed(docs: DataFrame, *more) -> DataFrame:
    """text ('' for null) with tk, the text's key, and doc_id."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"), *more)


def parities(cell: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text the parity of the number of its cells in each of PARITIES bins, packed in words of 64."""
    n = len(starts) - 1
    bins = np.repeat(np.arange(n), np.diff(starts)) * PARITIES + (mix(cell, 61) % np.uint64(PARITIES)).astype(np.int64)
    odd = (np.bincount(bins, minlength=n * PARITIES) & 1).astype(np.uint8).reshape(n, PARITIES)
    return np.packbits(odd, axis=1).view(np.int64)


def band_keys(rows: DataFrame, bands: int, per_band: int) -> DataFrame:
    """(doc_id, tk, keys, weight, sketches) of (doc_id, tk, text); texts without words have no keys."""
    k = bands * per_band

    @released
    def run(batches):
        import pyarrow as pa

        for batch, cell, starts in _cells_of(batches):
            s = signatures(cell, starts, k)
            keys = np.repeat((np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None], len(s), axis=0)
            for r in range(per_band):
                keys = mix(keys ^ s[:, r * bands : (r + 1) * bands])
            planes = [np.packbits((s[:, 64 * half : 64 * half + 64] >> np.uint64(40 + bit)).astype(np.uint8) & 1, axis=1).view(np.int64).ravel() for bit in range(PLANES) for half in (0, 1)]
            offsets = np.concatenate(([0], np.cumsum((np.diff(starts) > 0) * bands))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[np.diff(starts) > 0].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), lists, pa.array(np.diff(starts)), *(pa.array(x) for x in planes)], ["doc_id", "tk", "keys", "weight", *MARKS])

    return rows.mapInArrow(run, "doc_id long, tk long, keys array<long>, weight long, " + ", ".join(f"{m} long" for m in MARKS)).withColumn("keys", F.when(F.size("keys") > 0, F.col("keys")))


def _at_home(tk, doc_id):
    """One number of a text and a document, for membership()."""
    return F.xxhash64(tk, doc_id)


def cell_sets(rows: DataFrame) -> DataFrame:
    """(tk, weight, parities, cells) of (tk, text): the cells of each text and their sketch."""

    @released
    def run(batches):
        import pyarrow as pa

        for batch, cell, starts in _cells_of(batches):
            odd = parities(cell, starts)
            yield pa.RecordBatch.from_arrays([batch.column("tk"), *(pa.array(odd[:, k]) for k in range(len(ODD))), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(cell.view(np.int64)))], ["tk", *ODD, "cells"])

    return rows.select("tk", "text").mapInArrow(run, "tk long, " + ", ".join(f"{o} long" for o in ODD) + ", cells array<long>")


def exploded(signed: DataFrame, table: np.ndarray) -> DataFrame:
    """(key, tk): the keys of (tk, keys) that the table may hold, a row each."""

    @released
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = batch.column("keys")
            size = np.diff(keys.offsets.to_numpy())
            flat = keys.flatten().to_numpy()
            pick = held(table, flat)
            yield pa.RecordBatch.from_arrays([pa.array(flat[pick]), pa.array(np.repeat(batch.column("tk").to_numpy(), size)[pick])], ["key", "tk"])

    return signed.select("tk", "keys").mapInArrow(run, "key long, tk long")


def classes(docs: DataFrame, least: float = 0.8, bands: int = 26, per_band: int = 5) -> DataFrame:
    """(doc_id, tk, root, class_id, copies, class_size) of every row: tk names the text, root the class, copies counts the text's rows."""
    rows = keyed(docs)
    signed = written(band_keys(rows, bands, per_band), "signed")
    texts = written(signed.groupBy("tk").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "texts")
    some = signed.where("keys is not null")
    shared = some.select("tk", F.explode("keys").alias("key")).groupBy("key").agg(F.min("tk").alias("low"), F.max("tk").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    shared = written(shared, "shared")
    pairs = shared.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).distinct()
    larger = shared.where("n > 2").select("key")
    buckets = written(exploded(some, membership(larger, F.col("key"))).join(larger, "key").select("key", F.col("tk").alias("node")).distinct(), "buckets")
    company = pairs.select(F.col("a").alias("tk")).unionByName(pairs.select(F.col("b").alias("tk"))).unionByName(buckets.select(F.col("node").alias("tk"))).distinct()
    company = written(company.join(texts, "tk").select("tk", F.col("first_id").alias("doc_id")), "company")
    # one row of each text with company: that of its first doc_id (rows that repeat it are equal)
    near = may_hold(rows, _at_home(F.col("tk"), F.col("doc_id")), company, _at_home(F.col("tk"), F.col("doc_id")), "near").where("near")
    sets = written(cell_sets(near).join(company.select("tk"), "tk").dropDuplicates(["tk"]), "cells")
    marks = signed.join(company.select("tk"), "tk", "left_semi").select("tk", "weight", *MARKS).dropDuplicates(["tk"])
    marks = written(marks.join(sets.drop("cells"), "tk").withColumnRenamed("tk", "node"), "marks")

    def verify(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("tk").alias("a"), F.col("cells").alias("ca"))
        b = sets.select(F.col("tk").alias("b"), F.col("cells").alias("cb"))
        both = pairs.join(a, "a").join(b, "b")
        sizes = F.size("ca") + F.size("cb")
        common = F.size(F.array_intersect("ca", "cb"))
        return both.select("a", "b", (common / (sizes - common)).alias("similarity")).where(F.col("similarity") >= least - 1e-12)

    def close(p: str, q: str):
        differ = None
        for half in (0, 1):
            word = None
            for bit in range(PLANES):
                x = F.col(f"{p}m{2 * bit + half}").bitwiseXOR(F.col(f"{q}m{2 * bit + half}"))
                word = x if word is None else word.bitwiseOR(x)
            differ = F.bit_count(word) if differ is None else differ + F.bit_count(word)
        odd = F.bit_count(F.col(f"{p}o0").bitwiseXOR(F.col(f"{q}o0")))
        for o in ODD[1:]:
            odd = odd + F.bit_count(F.col(p + o).bitwiseXOR(F.col(q + o)))
        w = (F.col(f"{p}weight"), F.col(f"{q}weight"))
        return (F.least(*w) >= least * F.greatest(*w)) & (odd <= (w[0] + w[1]) * ((1 - least) / (1 + least)) + 1e-6) & (differ <= ALLOWED(least))

    roots, _ = bucket_components(pairs, buckets, marks, verify, close, "neardup")
    owner = texts.join(roots, texts["tk"] == roots["node"], "left").select("tk", "first_id", "copies", F.coalesce("root", "tk").alias("root"))
    group = owner.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    table = written(owner.join(group, "root").select("tk", "root", "class_id", "copies", "class_size"), "classes")
    return signed.select("doc_id", "tk").join(table, "tk")


def clean(docs: DataFrame, **settings) -> DataFrame:
    """One document of each class, the one with the smallest doc_id; columns as they are.

    Where a class has that doc_id, or no id at all, in several texts, the text with the smallest key stays, once.
    """
    found = written(classes(docs, **settings), "found")
    first = F.col("doc_id").eqNullSafe(F.col("class_id"))
    stays = found.where(first).groupBy("root").agg(F.min("tk").alias("keep_tk"))
    judged = found.join(stays, "root").withColumn("stays", first & (F.col("tk") == F.col("keep_tk")))
    # rows to look at again: those that go, and those that stay but come more than once
    rows = judged.groupBy(F.col("doc_id").alias("judged_id"), F.col("tk").alias("judged_tk")).agg(F.max("stays").alias("judged_stays"), F.count(F.lit(1)).alias("judged_rows")).where("not judged_stays or judged_rows > 1")
    rows = written(rows, "judged")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    every = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].cast("long").alias("did"), F.xxhash64(text).alias("tk"))
    every = may_hold(every, _at_home(F.col("tk"), F.col("did")), rows, _at_home(F.col("judged_tk"), F.col("judged_id")), "again")
    again = every.where("again").join(rows, F.col("did").eqNullSafe(F.col("judged_id")) & (F.col("tk") == F.col("judged_tk")), "left").where("judged_stays is null or judged_stays")
    once = again.where("judged_rows > 1").dropDuplicates(["did", "tk"])
    kept = every.where("not again").select("row").unionByName(again.where("judged_rows is null").select("row")).unionByName(once.select("row"))
    return kept.select("row.*")
