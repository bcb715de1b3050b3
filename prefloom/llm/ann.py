"""Approximate nearest neighbours by randomly rotated one-bit codes.

Each vector is scaled to unit length, turned by a random rotation R (QR of a seeded Gaussian matrix), and kept as the
packed signs of its coordinates plus one correction scalar f = <code, R x>, where code = sign(R x) / sqrt(d).  The
inner product of a query q with x is estimated without bias as <code, R q> / f, and its error is below
``eps * sqrt((1 - f^2) / f^2) / sqrt(d - 1)`` but for a probability that falls as exp(-c eps^2).  A candidate is
reranked with the original vectors only where its estimate plus the error bound reaches the k-th best value known.

Scale: the codes are a written table, an eighth of a byte a component beside the vectors.  Queries go in blocks of
``query_block`` vectors, the only thing broadcast, so its size is bounded by a parameter; each block is one pass over
the codes.  A task returns at most k candidates a query, and those are cut down to k by a two-step top-k.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component are no query and no
candidate; only vectors of equal length are compared; a repeated vec_id is one candidate a row; a null vec_id takes no
part, as it can't be named.  With fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written

CODES = "vec_id long, dim int, code binary, fix double, vector array<double>"
FOUND = "q long, query_id long, vec_id long, score double"


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows that take part, with components as doubles."""
    v = F.col(vec_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", fine) & F.exists("vector", lambda x: x != 0)
    )



def _by_dim(batch):
    """Row numbers and matrices of a batch, by vector length."""
    vectors = batch.column("vector")
    dims = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(dims)[:-1]))
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        yield int(d), rows, flat[(starts[rows][:, None] + np.arange(d))]


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # against overflow and underflow
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> DataFrame:
    """The index: a code row for every vector that takes part."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for d, rows, m in _by_dim(batch):
                turned = _unit(m) @ rotation(d, seed).T
                bits = turned >= 0
                fix = np.abs(turned).sum(axis=1) / np.sqrt(d)
                packed = np.packbits(bits, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(rows), d, np.int32)), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(fix), batch.column("vector").take(pa.array(rows))], ["vec_id", "dim", "code", "fix", "vector"])

    return usable(vectors, id_col, vec_col).mapInArrow(run, CODES)


def _top(q_keys, q_ids, q_vectors, k: int, eps: float, seed: int):
    """mapInArrow body: for each query of the block the k best of this task's codes."""
    by_dim: dict[int, tuple] = {}
    dims = np.array([len(v) for v in q_vectors])
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        unit = _unit(np.array([q_vectors[i] for i in rows], np.float64))
        by_dim[int(d)] = (np.array([q_ids[i] for i in rows], np.int64), unit, (unit @ rotation(int(d), seed).T), np.array([q_keys[i] for i in rows], np.int64))

    def run(batches):
        import pyarrow as pa

        best = {d: (np.full((len(x[0]), k), -np.inf), np.full((len(x[0]), k), np.iinfo(np.int64).max)) for d, x in by_dim.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                for d, rows, m in _by_dim(batch):
                    if d not in by_dim:
                        continue
                    ids, unit, turned, _ = by_dim[d]
                    score, who = best[d]
                    vec_ids = batch.column("vec_id").to_numpy()[rows]
                    fix = batch.column("fix").to_numpy()[rows]
                    packed = np.frombuffer(b"".join(batch.column("code").take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
                    signs = np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1
                    bound = eps * np.sqrt(np.maximum(1 - fix * fix, 0)) / fix / np.sqrt(max(d - 1, 1))
                    exact_vectors = _unit(m)
                    for q0 in range(0, len(ids), 256):
                        q1 = min(q0 + 256, len(ids))
                        estimate = (turned[q0:q1].astype(np.float32) @ signs.T) / (np.sqrt(d) * fix)
                        reach = estimate + bound
                        own = ids[q0:q1, None] == vec_ids[None, :]
                        # a lower bound of the k-th best: of what is known exactly, and of this batch's estimates
                        floor = score[q0:q1, -1]
                        if len(vec_ids) > k:
                            low = np.where(own, -np.inf, estimate - bound)
                            floor = np.maximum(floor, np.partition(low, len(vec_ids) - k, axis=1)[:, len(vec_ids) - k])
                        qi, ci = np.nonzero((reach >= (floor - 1e-6)[:, None]) & ~own)
                        if not len(qi):
                            continue
                        exact = np.empty(len(qi))
                        for p in range(0, len(qi), 200_000):
                            exact[p : p + 200_000] = np.einsum("ij,ij->i", unit[q0 + qi[p : p + 200_000]], exact_vectors[ci[p : p + 200_000]])
                        keep = exact >= score[q0 + qi, -1]
                        qi, ci, exact = qi[keep], ci[keep], exact[keep]
                        touched = np.unique(qi)
                        all_q = np.concatenate((qi, np.repeat(touched, k)))
                        all_s = np.concatenate((exact, score[q0 + touched].ravel()))
                        all_v = np.concatenate((vec_ids[ci], who[q0 + touched].ravel()))
                        order = np.lexsort((all_v, -all_s, all_q))
                        all_q, all_s, all_v = all_q[order], all_s[order], all_v[order]
                        rank = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
                        take = rank < k
                        score[q0 + all_q[take], rank[take]] = all_s[take]
                        who[q0 + all_q[take], rank[take]] = all_v[take]
        for d, (score, who) in best.items():
            r, c = np.nonzero(score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(by_dim[d][3][r]), pa.array(by_dim[d][0][r]), pa.array(who[r, c]), pa.array(score[r, c])], ["q", "query_id", "vec_id", "score"])

    return run


def search(codes: DataFrame, queries: DataFrame, k: int = 5, eps: float = 4.0, seed: int = 7, query_block: int = 8192) -> DataFrame:
    """The k nearest codes of each query (vec_id, vector) by cosine; codes is a written table made by encode().

    Blocks are cut by a hash of the query, so that one holds about query_block rows.  A vec_id with several different
    vectors is one query for each, whose lists are merged: a candidate counts once, with its best score.  Candidates that share
    a vec_id are told apart by the order of their scores in each list.
    """
    spark = codes.sparkSession
    queries = queries.dropDuplicates(["vec_id", "vector"])  # an equal row would give every candidate twice
    n = queries.count()
    parts: list[DataFrame] = []
    blocks = max(1, -(-n // query_block))
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)) == b).select(F.xxhash64("vec_id", "vector").alias("q"), "vec_id", "vector").collect()
        if rows:
            run = _top(*([r[i] for r in rows] for i in range(3)), k, eps, seed)
            parts.append(codes.select("vec_id", "fix", "code", "vector").mapInArrow(run, FOUND))
    if not parts:
        return spark.createDataFrame([], T._parse_datatype_string("query_id long, rank int, vec_id long, score double"))
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    nth = Window.partitionBy("query_id", "q", "vec_id").orderBy(F.desc("score"))
    found = found.repartition("query_id").withColumn("nth", F.row_number().over(nth)).groupBy("query_id", "vec_id", "nth").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, eps: float = 4.0, seed: int = 7, query_block: int = 8192) -> DataFrame:
    """Searches with every row whose vec_id is divisible by `every`, against all other rows."""
    codes = written(encode(vectors, seed=seed), "codes")
    return search(codes, codes.where(F.col("vec_id") % every == 0), k, eps, seed, query_block)
