"""Whitening of embeddings by LOBPCG: the leading eigenvectors of the covariance from products with blocks of vectors.

Each entry c of a vector becomes the long x = floor(1024 c) + 100000.  One pass gives the number of vectors n and the
sums S.  Then a block of trial vectors is improved: a pass over the rows gives V R, the covariance times the residuals R
of the block, as sums of (x - S/n) ((x - S/n) . R); a Rayleigh-Ritz step on the span of the block, its residuals and its
last directions gives the next block.  When the residuals of the wanted pairs are small, one more pass takes the true
product of those pairs, and only if the residuals of that, |V u - e u|, are small is the result certified; else the
steps go on from there.  Guard vectors beyond the wanted ones keep close eigenvalues from slowing the steps down.  The
covariance itself is never built: what comes to the driver is dimensions times block numbers a pass.

Scale: a pass reads the vectors once and sums up within the task; its rows, one for each number, are added by partial
sums.  Rows never leave their task.  Passes number about ten at 64 dimensions, more where eigenvalues are close.

Defined results: null and empty vectors and such with null or non-finite entries take no part; repeated rows count as
often as they stand, null ids stay; vectors of several lengths are an error that names them; x is held within 2^53 of 0; a
deviation beyond 64 bits is null; components whose eigenvalue is 0 up to rounding, with which nothing can be divided,
aren't there, so equal vectors, a single one and an empty table give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS, GUARD = 8, 16
SCALE, SHIFT, BOUND = 1024, 100_000, 1 << 53
#: Residual of a certified pair as a share of the first eigenvalue, and the most steps to reach it.
RESIDUAL, STEPS = 1e-13, 300
#: Rows that one step of a pass holds.
ROWS = 8192


def vectors(batch, column: str):
    """(rows, x): which rows of an Arrow batch take part, and their vectors as longs, in steps of bounded size."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = batch.column(column)
    lists = lists.cast(pa.list_(lists.type.value_type))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            flat = lists.take(pa.array(some)).flatten()
            v = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, d)
            ok = np.isfinite(v).all(axis=1)
            if ok.any():
                yield some[ok], (np.clip(np.floor(SCALE * v[ok]), -BOUND, BOUND)).astype(np.int64) + SHIFT


def summed(df: DataFrame, column: str) -> tuple[int, list[int]]:
    """Number of vectors and their exact sums by dimension."""
    half = 30  # high and low parts are summed apart, as sums of entries may pass 64 bits

    def run(batches):
        import pyarrow as pa

        acc = {}
        for batch in batches:
            for _, x in vectors(batch, column):
                low, high, n = acc.get(x.shape[1], (0, 0, 0))
                acc[x.shape[1]] = (low + (x & ((1 << half) - 1)).sum(axis=0), high + (x >> half).sum(axis=0), n + len(x))
        for d, (low, high, n) in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(low), pa.array(high), pa.array(np.full(d, n))], ["d", "at", "low", "high", "n"])

    rows = df.select(column).mapInArrow(run, "d long, at long, low long, high long, n long").groupBy("d", "at").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high", "n"))).collect()  # one row a dimension
    if len({r.d for r in rows}) > 1:
        raise ValueError(f"vectors of several lengths: {sorted({r.d for r in rows})}")
    rows.sort(key=lambda r: r.at)
    return (int(rows[0].n), [(int(r.high) << half) + int(r.low) for r in rows]) if rows else (0, [])


class Centre:
    """x - S/n of a batch of vectors, to double precision, and n x - S exactly."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.rest = n, [s % n for s in sums]
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row."""
        near = x - self.whole
        if float(np.abs(near).max() + 1) * self.n < (1 << 31) / max(x.shape[1], 1) ** 0.5:
            far = near * self.n - np.array(self.rest, np.int64)
            return (far * far).sum(axis=1).tolist()
        out = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in near.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def products(df: DataFrame, column: str, centre: Centre, block: np.ndarray) -> tuple[np.ndarray, float]:
    """V times the block, and the trace of V: one pass."""

    def run(batches):
        import pyarrow as pa

        acc, trace = np.zeros(block.shape), 0.0
        for batch in batches:
            for _, x in vectors(batch, column):
                z = centre.centred(x)
                acc += z.T @ (z @ block)
                trace += float((z * z).sum())
        if trace:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(acc.size + 1)), pa.array(np.append(acc.ravel(), trace))], ["at", "v"])

    out = np.zeros(block.size + 1)
    for r in df.select(column).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # one row a number
        out[r["at"]] = r["v"]
    out /= centre.n
    return out[:-1].reshape(block.shape), float(out[-1])


def _independent(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of the block's columns without their part in `against`; dependent columns go."""
    for _ in range(2):
        if against is not None:
            block = block - against @ (against.T @ block)
        size = np.sqrt((block * block).sum(axis=0))
        block = block[:, size > 0] / size[size > 0]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * s[0]]
    return block


def _directions(block: np.ndarray, image: np.ndarray, x: np.ndarray, vx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's columns made orthonormal and orthogonal to x, and their product with V by the same combinations."""
    for _ in range(3):
        part = x.T @ block
        block, image = block - x @ part, image - vx @ part
        size = np.sqrt((block * block).sum(axis=0))
        keep = size > 1e-14
        if not keep.any():
            return block[:, :0], image[:, :0]
        block, image = block[:, keep] / size[keep], image[:, keep] / size[keep]
        _, s, right = np.linalg.svd(block, full_matrices=False)
        turn = right[s > 1e-6 * s[0]].T / s[s > 1e-6 * s[0]]
        block, image = block @ turn, image @ turn
    return block, image


def lobpcg(product, d: int, k: int, guard: int = GUARD, residual: float = RESIDUAL, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residuals) of the first k eigenpairs of a symmetric matrix that is given by its product with blocks.

    Each step costs one product with at most k + guard vectors.  Ends when |V u - e u| of every wanted pair, by a product
    of its own, is at most `residual` times the first value (or no longer falls and is at most 100 times that); raises
    ArithmeticError if that takes more than `steps` steps.
    """
    k = min(k, d)
    x = _independent(np.random.default_rng(7).standard_normal((d, min(d, k + guard))))
    vx, p, vp = product(x), np.zeros((d, 0)), np.zeros((d, 0))
    fresh, best, stalled = True, np.inf, 0
    for _ in range(steps):
        values, turn = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        order = np.argsort(-values)
        values, x, vx = values[order], x @ turn[:, order], vx @ turn[:, order]
        r = vx - x * values
        sizes = np.sqrt((r * r).sum(axis=0))[:k]
        worst, top = float(sizes.max()), max(float(values[0]), np.finfo(float).tiny)
        stalled = 0 if worst < best / 2 else stalled + 1
        best = min(best, worst)
        if worst <= residual * top or (stalled >= 3 and worst <= 100 * residual * top):
            if fresh:
                return values[:k], x[:, :k], sizes
            # certify by a product of the block itself, not one carried along; the directions start anew
            vx, fresh, p, vp = product(x), True, p[:, :0], vp[:, :0]
            continue
        w = _independent(r, np.hstack((x, p)) if p.shape[1] else x)
        vw = product(w) if w.shape[1] else w
        if not w.shape[1] and not p.shape[1]:
            vx, fresh = product(x), True
            continue
        s, vs = np.hstack((x, w, p)), np.hstack((vx, vw, vp))
        _, turn = np.linalg.eigh((s.T @ vs + vs.T @ s) / 2)
        turn = turn[:, ::-1][:, : x.shape[1]]
        new, vnew = s @ turn, vs @ turn
        # the part of the step outside the old block is the next direction
        move = turn.copy()
        move[: x.shape[1]] = 0
        p, vp = _directions(s @ move, vs @ move, new, vnew)
        q, tri = np.linalg.qr(new)
        x, vx, fresh = q, np.linalg.solve(tri.T, vnew.T).T, False
    raise ArithmeticError(f"residuals of {steps} steps are {best}, not {residual} of {top}")


def principal(df: DataFrame, column: str = "embedding", k: int = COMPONENTS, guard: int = GUARD) -> tuple[Centre, np.ndarray, np.ndarray, float] | None:
    """(centre, eigenvalues, eigenvectors as columns, trace) of the covariance; None without a component.  Signs: a vector's largest entry is positive."""
    n, sums = summed(df, column)
    if not n:
        return None
    centre, traces = Centre(n, sums), []

    def product(block):
        out, trace = products(df, column, centre, block)
        traces.append(trace)
        return out

    values, u, _ = lobpcg(product, len(sums), k, guard)
    keep = values > max(len(sums), 16) * np.finfo(float).eps * max(values[0], 0) if values[0] > 0 else np.zeros(len(values), bool)
    values, u = values[keep], u[:, keep]
    if not len(values):
        return None
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    return centre, values, u, traces[0]


def identity_error(df: DataFrame, column: str, centre: Centre, projection: np.ndarray) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity; means and centred products of tasks are merged."""
    k = projection.shape[1]

    def run(batches):
        import pyarrow as pa

        n, mean, square = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in vectors(batch, column):
                w = centre.centred(x) @ projection
                m, own = len(w), w.mean(axis=0)
                gap = own - mean
                square += (w - own).T @ (w - own) + np.outer(gap, gap) * (n * m / (n + m))
                mean += gap * (m / (n + m))
                n += m
        if n:
            # a task's products about the common mean follow from its own mean: both parts are summed
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.append((square + n * np.outer(mean, mean)).ravel(), n * mean))], ["at", "v"])

    got = np.zeros(k * k + k)
    for r in df.select(column).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # one row a number
        got[r["at"]] = r["v"]
    mean = got[k * k :] / centre.n
    return float(np.abs(got[: k * k].reshape(k, k) / centre.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = COMPONENTS, guard: int = GUARD) -> DataFrame:
    """(key, whitened array<double>, n, deviation, explained array<double>, identity_error): a row for each vector that takes part."""
    found = principal(df, column, k, guard)
    schema = f"{key} long, whitened array<double>, n long, deviation long, explained array<double>, identity_error double"
    if found is None:
        return df.sparkSession.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in schema.split(", "))))
    centre, values, u, trace = found
    projection = u / np.sqrt(values)
    error, share = identity_error(df, column, centre, projection), values / trace

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for rows, x in vectors(batch, column):
                w = centre.centred(x) @ projection
                m, c = w.shape
                lists = lambda v: pa.ListArray.from_arrays(pa.array((np.arange(m + 1) * c).astype(np.int32)), pa.array(np.ascontiguousarray(v).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(rows)), lists(w), pa.array(np.full(m, centre.n)), pa.array(centre.deviation(x), pa.int64()), lists(np.tile(share, (m, 1))), pa.array(np.full(m, error))],
                    [x.split()[0] for x in schema.split(", ")],
                )

    return df.select(F.col(key).cast("long").alias(key), column).mapInArrow(run, schema)


def components(df: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    rows = whiten(df, key, column, k)
    each = rows.select(key, "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select(key, (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
