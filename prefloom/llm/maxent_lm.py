"""LM scoring by a hashed maximum-entropy model: n-gram and skip features, class-factored softmax, distributed gradients.

Tokens are lower-cased (A-Z) words and an end for each document.  Output symbols are the commonest words and, for all
other words, signatures (a hash of their first and last bytes); symbols are dealt into classes by frequency.  Then

    P(word | history) = P(class | history) P(symbol | class, history) P(word | signature)

where the first two are softmaxes of summed weights of the history's features: the word before, the word before that
(a skip), and both together, each hashed to a row of weights over the classes, or, with the class, over its symbols.
The last is 1 for common words, else the smoothed count of the word among its signature's words.

Fitting: one pass counts all training words.  The weights start from the counts' unigrams and take two rounds of
gradients over all training documents, an eighth of them and then the rest.  In a round every task starts from the same
weights and takes AdaGrad steps over its own documents; of each row of weights the tasks' changes are averaged, by their
visits, in a two-level distributed sum.  Scoring: whole texts in numpy batches that touch only the rows of weights that
their features name.

The counts of rare words are too many to send to every task.  Words with at least 1 / ``HEAVY`` of all training tokens,
so at most HEAVY of them, are looked up in the task; all others go as (row, word, times) to a join with the counts.

Scale: texts are streamed three times in bounded steps; the vocabulary is aggregated by 8-byte hashes with partial
sums; the model has a fixed size, whatever the corpus.  Two words of equal 64-bit hash count as one.

Defined results: null and empty texts are the end alone; null ids are never held out; repeated rows are scored alike,
and all count in training; without training documents the model is uniform, and the base score follows its formula.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, held_out, mix, text_steps, written

CLASSES, PER_CLASS = 16, 32
COMMON = 320  # symbols that are words; the rest of CLASSES * PER_CLASS are signatures
SIGNATURES = CLASSES * PER_CLASS - COMMON
FINE = 1536  # kinds of rare words in histories
HISTORY = CLASSES * PER_CLASS + FINE + 1  # the last one: before the document's beginning
PAIRS, ROWS = 8192, 32768  # rows of hashed pairs, and of (feature, class)
FEATURES = 2 * HISTORY + PAIRS
HEAVY = 1 << 17
END = np.uint64(0x00656E640A656E64)
BATCH, RATE, BLOCK = 4096, 0.15, 64
FOLDS, FOLD = 10, 0


def _tokens(batch):
    """Codes with the ends in place, where each text's tokens begin, hashes and signature hashes of the distinct tokens (the end last)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    words = Words(pc.ascii_lower(batch.column("text").cast(pa.large_string())))
    h = np.append(words.hashes(), END)
    _, offsets, data = words.distinct.cast(pa.large_string()).buffers()
    n = len(words.distinct)
    sig = np.zeros(n + 1, np.uint64)
    if n:
        offs = np.frombuffer(offsets, np.int64, n + 1, words.distinct.offset * 8)
        body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        low, last = offs[:-1], np.maximum(offs[1:] - 1, offs[:-1])
        pick = lambda at: body[np.minimum(at, len(body) - 1)].astype(np.uint64)
        sig[:n] = mix(pick(low) | pick(np.minimum(low + 1, last)) << np.uint64(8) | pick(np.maximum(last - 1, low)) << np.uint64(16) | pick(last) << np.uint64(24), 3)
    size = np.diff(words.offsets)
    starts = words.offsets + np.arange(len(words.offsets))
    codes = np.full(starts[-1], n, np.int64)
    inside = np.ones(len(codes), bool)
    inside[starts[1:] - 1] = False
    codes[inside] = words.codes
    return codes, starts, h, sig, size + 1


def counts(docs: DataFrame) -> DataFrame:
    """(h, sig, c): count and signature of each training token; docs is (text)."""

    def run(batches):
        import pyarrow as pa

        for batch in text_steps(batches):
            codes, _, h, sig, _ = _tokens(batch)
            c = np.bincount(codes, minlength=len(h))
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(h[k].view(np.int64)), pa.array((sig[k] % np.uint64(SIGNATURES)).astype(np.int32)), pa.array(c[k])], ["h", "sig", "c"])

    return docs.select("text").mapInArrow(run, "h long, sig int, c long").groupBy("h").agg(F.min("sig").alias("sig"), F.sum("c").alias("c"))


class Model:
    """Symbols and weights; of fixed size."""

    def __init__(self, words: np.ndarray, word_counts: np.ndarray, sig_counts: np.ndarray, sig_mass: np.ndarray):
        """words: hashes of the common words; sig_counts: tokens of all other words by signature; sig_mass: their smoothed mass."""
        k = np.argsort(words)
        self.words, order = words[k], np.concatenate((word_counts[k], np.zeros(COMMON - len(words)), sig_counts)).astype(float)
        rank = np.argsort(-order, kind="stable")
        self.symbol = np.empty(len(rank), np.int64)
        self.symbol[rank] = np.arange(len(rank))
        self.log_mass = np.log(sig_mass)
        p = (order + 0.1)[rank].reshape(CLASSES, PER_CLASS)
        self.b1 = np.log(p.sum(axis=1) / p.sum()).astype(np.float32)
        self.b2 = np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32)
        self.w1 = np.zeros((FEATURES, CLASSES), np.float32)
        self.w2 = np.zeros((ROWS, PER_CLASS), np.float32)

    def of_distinct(self, h: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct tokens: output symbol, history symbol, log of the signature's mass (0 for common words), and whether common."""
        at = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
        common = self.words[at] == h if len(self.words) else np.zeros(len(h), bool)
        coarse = (sig % np.uint64(SIGNATURES)).astype(np.int64)
        out = self.symbol[np.where(common, at, COMMON + coarse)]
        past = np.where(common, out, CLASSES * PER_CLASS + (sig // np.uint64(SIGNATURES) % np.uint64(FINE)).astype(np.int64))
        return out, past, np.where(common, 0.0, self.log_mass[coarse]), common

    def sequence(self, past: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The three features of each position."""
        h1, h2 = np.full(len(past), HISTORY - 1), np.full(len(past), HISTORY - 1)
        h1[1:], h2[2:] = past[:-1], past[:-2]
        first = starts[:-1]
        h1[first] = HISTORY - 1
        h2[first] = HISTORY - 1
        second = first + 1
        h2[second[second < starts[1:]]] = HISTORY - 1
        pair = mix((h1 * HISTORY + h2).astype(np.uint64), 5) % np.uint64(PAIRS)
        return np.stack((h1, HISTORY + h2, 2 * HISTORY + pair.astype(np.int64)))

    @staticmethod
    def rows(f: np.ndarray, cls: np.ndarray) -> np.ndarray:
        return (mix((f * CLASSES + cls).astype(np.uint64), 6) % np.uint64(ROWS)).astype(np.int64)

    def log_p(self, f: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Natural log of P(symbol | history)."""
        total = np.empty(len(out))
        for a in range(0, len(out), BATCH):
            b = min(a + BATCH, len(out))
            cls, sym = np.divmod(out[a:b], PER_CLASS)
            i = np.arange(b - a)
            s = self.b1 + self.w1.take(f[0, a:b], axis=0) + self.w1.take(f[1, a:b], axis=0) + self.w1.take(f[2, a:b], axis=0)
            r = self.rows(f[:, a:b], cls)
            t = self.b2.take(cls, axis=0) + self.w2.take(r[0], axis=0) + self.w2.take(r[1], axis=0) + self.w2.take(r[2], axis=0)
            total[a:b] = (s[i, cls] - np.log(np.exp(s).sum(axis=1))) + (t[i, sym] - np.log(np.exp(t).sum(axis=1)))
        return total


def _add(rows: np.ndarray, g: np.ndarray, w: np.ndarray, acc: np.ndarray, visits: np.ndarray) -> None:
    """An AdaGrad step of the rows named, each row's gradients (repeated for its three features) summed first."""
    flat = rows.ravel().astype(np.uint16)  # rows are fewer than 2^16, and numbers of 16 bits are sorted by radix
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], (now := flat[order])[1:] != now[:-1])))
    u = flat[order[first]]
    sums = np.add.reduceat(g.take(order % g.shape[0], axis=0), first, axis=0)
    acc[u] += (sums * sums).mean(axis=1)
    w[u] -= (RATE / np.sqrt(acc[u]))[:, None] * sums
    visits[u] += np.diff(np.append(first, len(flat)))


class Trainer:
    """A task's own copy of the weights; the change of each row counts by its visits."""

    def __init__(self, model: Model):
        self.start, self.m = model, Model.__new__(Model)
        self.m.__dict__.update({k: (v.copy() if k in ("w1", "w2", "b1", "b2") else v) for k, v in model.__dict__.items()})
        self.a1, self.a2 = np.full(FEATURES, 1.0, np.float32), np.full(ROWS, 1.0, np.float32)
        self.n1, self.n2, self.seen = np.zeros(FEATURES), np.zeros(ROWS), 0

    def learn(self, f: np.ndarray, out: np.ndarray) -> None:
        m = self.m
        for a in range(0, len(out), BATCH):
            b = min(a + BATCH, len(out))
            cls, sym = np.divmod(out[a:b], PER_CLASS)
            i, part = np.arange(b - a), f[:, a:b]
            s = np.exp(m.b1 + m.w1.take(part[0], axis=0) + m.w1.take(part[1], axis=0) + m.w1.take(part[2], axis=0))
            s /= s.sum(axis=1, keepdims=True)
            s[i, cls] -= 1
            r = m.rows(part, cls)
            t = np.exp(m.b2.take(cls, axis=0) + m.w2.take(r[0], axis=0) + m.w2.take(r[1], axis=0) + m.w2.take(r[2], axis=0))
            t /= t.sum(axis=1, keepdims=True)
            t[i, sym] -= 1
            _add(part, s, m.w1, self.a1, self.n1)
            _add(r, t, m.w2, self.a2, self.n2)
            self.seen += b - a

    def blocks(self):
        """(block, payload): for BLOCK rows at a time, their visits and their changes times visits."""
        base = 0
        for now, old, n in ((self.m.w1, self.start.w1, self.n1), (self.m.w2, self.start.w2, self.n2)):
            for k in range(0, len(n), BLOCK):
                v = n[k : k + BLOCK]
                if v.any():
                    yield base + k // BLOCK, np.hstack((v[:, None], (now[k : k + BLOCK] - old[k : k + BLOCK]) * v[:, None])).astype(np.float32).tobytes()
            base += -(-len(n) // BLOCK)


def _summed(pdf):
    import pandas as pd

    total = np.zeros(len(pdf["payload"].iloc[0]) // 4)
    for x in pdf["payload"]:
        total += np.frombuffer(x, np.float32)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "salt": [0], "payload": [total.astype(np.float32).tobytes()]})


def train_round(docs: DataFrame, model: Model) -> Model:
    """One round of distributed gradients over docs (text)."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        trainer = Trainer(model)
        for batch in text_steps(batches):
            codes, starts, h, sig, _ = _tokens(batch)
            out, past, _, _ = model.of_distinct(h, sig)
            trainer.learn(model.sequence(past[codes], starts), out[codes])
        if trainer.seen:
            rows = list(trainer.blocks())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(np.full(len(rows), TaskContext.get().partitionId() % 16, np.int32)), pa.array([r[1] for r in rows], pa.binary())], ["block", "salt", "payload"])

    schema = "block int, salt int, payload binary"
    sums = docs.select("text").mapInArrow(run, schema).groupBy("block", "salt").applyInPandas(_summed, schema).groupBy("block").applyInPandas(_summed, schema)
    new = Model.__new__(Model)
    new.__dict__.update(model.__dict__)
    w1, w2 = model.w1.copy(), model.w2.copy()
    n1 = -(-FEATURES // BLOCK)
    for block, _, payload in sums.collect():  # at most as many rows as the model has blocks
        w, k = (w1, block * BLOCK) if block < n1 else (w2, (block - n1) * BLOCK)
        x = np.frombuffer(payload, np.float32).reshape(-1, w.shape[1] + 1)
        w[k : k + len(x)] += x[:, 1:] / np.maximum(x[:, :1], 1)
    new.w1, new.w2 = w1, w2
    return new


def fit(train: DataFrame, vocabulary: DataFrame) -> tuple[Model, np.ndarray, np.ndarray, int, int]:
    """The model, the heavy words (hashes, counts), and N and V; train is (text), vocabulary what counts() gave, written."""
    n, v = vocabulary.agg(F.sum("c"), F.count(F.lit(1))).first()
    n = n or 0
    heavy = vocabulary.where(F.col("c") * HEAVY >= n).collect() if n else []  # at most HEAVY rows
    heavy.sort(key=lambda r: (-r["c"], r["h"]))
    top = heavy[:COMMON]
    sums = {r[0]: (r[1], r[2]) for r in vocabulary.groupBy("sig").agg(F.sum("c"), F.count(F.lit(1))).collect()}
    tokens, kinds = (np.array([sums.get(s, (0, 0))[k] for s in range(SIGNATURES)], float) for k in (0, 1))
    for r in top:
        tokens[r["sig"]] -= r["c"]
        kinds[r["sig"]] -= 1
    model = Model(np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["c"] for r in top], float), tokens, tokens + 0.1 * (kinds + 1))
    if n:
        early = F.pmod(F.xxhash64("text"), F.lit(8)) == 0
        for part in (train.where(early), train.where(~early)):
            model = train_round(part, model)
    h = np.array([r["h"] for r in heavy], np.int64).view(np.uint64)
    order = np.argsort(h)
    return model, h[order], np.array([r["c"] for r in heavy], np.int64)[order], n, v


SCORED = "doc_id long, tk long, n_tokens long, known long, log_counts double, model double, rare array<long>, times array<int>"


def _score(batch, model: Model, heavy: np.ndarray, heavy_counts: np.ndarray):
    import pyarrow as pa

    codes, starts, h, sig, size = _tokens(batch)
    out, past, mass, common = model.of_distinct(h, sig)
    at = np.minimum(np.searchsorted(heavy, h), max(len(heavy) - 1, 0))
    is_heavy = heavy[at] == h if len(heavy) else np.zeros(len(h), bool)
    log_c = np.where(is_heavy, np.log(np.where(is_heavy, heavy_counts[at] if len(heavy) else 0, 0) + 0.1), 0.0)
    # of common words the count is the model's; of other words the count's part of P(word | signature) is here, or with the join
    own = model.log_p(model.sequence(past[codes], starts), out[codes]) - mass[codes] + np.where(common, 0.0, log_c)[codes]
    begin = starts[:-1]
    doc = np.repeat(np.arange(len(size)), size)
    rare = np.flatnonzero(~is_heavy[codes])
    key = doc[rare] * len(h) + codes[rare]
    pair, times = np.unique(key, return_counts=True)
    lists = np.concatenate(([0], np.cumsum(np.bincount(pair // len(h), minlength=len(size))))).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("tk"), pa.array(size), pa.array(np.add.reduceat(is_heavy[codes].astype(np.int64), begin)), pa.array(np.add.reduceat(log_c[codes], begin)), pa.array(np.add.reduceat(own, begin)),
         pa.ListArray.from_arrays(pa.array(lists), pa.array(h[pair % len(h)].view(np.int64))), pa.ListArray.from_arrays(pa.array(lists), pa.array(times.astype(np.int32)))],
        [x.split()[0] for x in SCORED.split(", ")],
    )


def score(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document: fitted on those not held out, scored on all."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(docs["doc_id"].cast("long"), text).alias("tk"))
    train = rows.where(~held_out(F.col("doc_id"), FOLDS, FOLD)).select("text")
    vocabulary = written(counts(train), "vocabulary")
    model, heavy, heavy_counts, n, v = fit(train, vocabulary)

    def run(batches):
        for batch in text_steps(batches):
            yield _score(batch, model, heavy, heavy_counts)

    scored = written(rows.mapInArrow(run, SCORED), "scored")
    rare = scored.select("tk", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("tk", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    count = F.coalesce("c", F.lit(0))
    joined = rare.join(vocabulary.where(F.col("c") * HEAVY < n).select("h", "c") if n else vocabulary.select("h", "c"), "h", "left")
    per_row = joined.select("tk", F.when(count > 0, F.col("times")).otherwise(0).cast("long").alias("known"), (F.col("times") * F.log(count + 0.1)).alias("part"), F.lit(0).alias("rows"))
    # rows of equal id and text have sent their rare words more than once
    per_row = per_row.unionByName(scored.select("tk", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("part"), F.lit(1).alias("rows")))
    sums = per_row.groupBy("tk").agg((F.sum("known") / F.sum("rows")).cast("long").alias("rare_known"), (F.sum("part") / F.sum("rows")).alias("rare_part"))
    ln10 = float(np.log(10))
    floor = float(np.log(n + 0.1 * (v + 1)))
    return scored.drop("rare", "times").join(sums, "tk").select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        ((F.col("log_counts") + F.col("rare_part") - F.col("n_tokens") * floor) / ln10).alias("base_score"), ((F.col("model") + F.col("rare_part")) / ln10).alias("score"),
    )
