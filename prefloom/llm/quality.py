"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's features describe its characters, words and repetitions, and those of the line
before and after; the chain adds a weight for each pair of neighbouring labels.  Forward-backward gives each line's
probability of being good; the mean of these, weighted by line length, is the document's quality, and a logistic
function calibrates it to the probability of label 1.

Fitting, on a bounded sample of labelled documents: all lines start with their document's label; the field is fitted by
gradient steps on the log-likelihood; then lines of bad documents that it finds clearly good are relabelled, a document's
worst line excepted, and it is fitted again.

Scale: scoring is one pass without a shuffle over texts in bounded steps; the model has a fixed size, the sample is
bounded by ``per_class``.  Defined results: blank lines are no lines; null texts, empty texts and texts of blank lines
get the share of label 1 in the sample; with labels of one class only every document gets that share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import Words, mix, string_hashes
from .labelled import at_share, class_share, fit_logistic, logistic, sample, scored

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 space, 5 other ASCII, 6 part of a longer code point
for _c in range(256):
    _ch = chr(_c)
    _KIND[_c] = 6 if _c > 127 else 1 if _ch.islower() else 2 if _ch.isupper() else 3 if _ch.isdigit() else 4 if _ch.isspace() else 5
NEAR = (1, 2, 4, 8, 9, 10)  # own features that are also taken from the line before and the line after


def line_features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the lines of an Arrow array of texts, their lengths in bytes, and where each text's lines begin."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    lines = lists.flatten()
    starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())))
    words = Words(lines)
    n_words = np.diff(words.offsets)
    keep = n_words > 0
    starts = np.concatenate(([0], np.cumsum(keep)))[starts]
    lines = lines.filter(pa.array(keep))
    n_words, m = n_words[keep], int(keep.sum())
    if not m:
        return np.zeros((0, 12 + 2 * len(NEAR))), np.zeros(0), starts
    first = np.concatenate(([0], np.cumsum(n_words)))
    _, offsets, data = lines.cast(pa.large_string()).buffers()
    offs = np.frombuffer(offsets, np.int64, m + 1, lines.offset * 8)
    kind = _KIND[np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]]
    size = np.diff(offs).astype(float)
    at = offs[:-1] - offs[0]
    count = lambda k: np.add.reduceat((kind == k).astype(np.int32), at) / size
    lower, upper, digit, space, other, wide = (count(k) for k in range(1, 7))
    codes = words.codes.astype(np.int64)
    line_of = np.repeat(np.arange(m), n_words)
    again = np.zeros(len(codes))
    again[1:] = (codes[1:] == codes[:-1]) & (line_of[1:] == line_of[:-1])
    pairs = np.unique(line_of * (codes.max() + 1) + codes)
    distinct = np.bincount(pairs // (codes.max() + 1), minlength=m) / n_words
    repeated = np.add.reduceat(again, first[:-1]) / n_words
    doc_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    key = mix(string_hashes(lines) ^ mix(doc_of.astype(np.uint64)))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    ends = np.frombuffer(data, np.uint8)[offs[1:] - 1]
    # n-grams of words that come back within the line
    tri = codes[:-2] * 1_000_003 + codes[1:-1] * 1009 + codes[2:] if len(codes) > 2 else np.zeros(0, np.int64)
    inside = line_of[2:] == line_of[:-2] if len(codes) > 2 else np.zeros(0, bool)
    grams = mix(tri.astype(np.uint64) ^ mix(line_of[: len(tri)].astype(np.uint64)))[inside]
    owner = line_of[: len(tri)][inside]
    n_tri = np.bincount(owner, minlength=m)
    _, where = np.unique(grams, return_index=True)
    n_dist = np.bincount(owner[where], minlength=m)
    tri_again = 1 - n_dist / np.maximum(n_tri, 1)
    tri_again[n_tri == 0] = 0
    own = np.stack((np.log1p(size), upper, other, digit, wide, np.log1p(n_words), size / n_words / 10, np.isin(ends, np.frombuffer(b".!?", np.uint8)), distinct, repeated, tri_again, np.minimum(np.log(times[back]), 3)), axis=1).astype(float)
    before, after = np.zeros((m, len(NEAR))), np.zeros((m, len(NEAR)))
    same = doc_of[1:] == doc_of[:-1]
    before[1:][same], after[:-1][same] = own[:-1][same][:, NEAR], own[1:][same][:, NEAR]
    return np.hstack((own, before, after)), size, starts


class Chain:
    """The field: weights of the features for `good` against `bad`, and a weight for each pair of neighbouring labels."""

    def __init__(self, mean, scale):
        self.mean, self.scale = mean, scale
        self.w, self.t = np.zeros(len(mean) + 1), np.zeros((2, 2))

    def unary(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.scale, -5, 5) @ self.w[:-1] + self.w[-1]
        return np.stack((-s / 2, s / 2), axis=1)

    def marginals(self, u: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(label) of each line, and the expected count of each pair of neighbouring labels."""
        n = np.diff(starts)
        order = np.argsort(-n, kind="stable")
        order = order[n[order] > 0]
        begin, size = starts[:-1][order], n[order]
        longest = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(longest), "left")  # how many chains have a line t
        f, b = np.zeros_like(u), np.zeros_like(u)
        for t in range(longest):
            r = begin[: live[t]] + t
            f[r] = u[r] if t == 0 else u[r] + np.logaddexp(f[r - 1, :1] + self.t[0], f[r - 1, 1:] + self.t[1])
            f[r] -= f[r].max(axis=1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            r = begin[: live[t + 1]] + t
            v = u[r + 1] + b[r + 1]
            b[r] = np.logaddexp(self.t[:, 0] + v[:, :1], self.t[:, 1] + v[:, 1:])
            b[r] -= b[r].max(axis=1, keepdims=True)
        g = f + b
        g = np.exp(g - g.max(axis=1, keepdims=True))
        g /= g.sum(axis=1, keepdims=True)
        inner = np.ones(len(u), bool)
        inner[starts[:-1][n > 0]] = False
        k = np.flatnonzero(inner)
        p = np.exp(np.clip(f[k - 1][:, :, None] + self.t[None] + (u[k] + b[k])[:, None, :], -50, 50)) if len(k) else np.zeros((0, 2, 2))
        p /= np.maximum(p.sum(axis=(1, 2), keepdims=True), 1e-300)
        return g, p.sum(axis=0)

    def fit(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> None:
        z = np.hstack((np.clip((x - self.mean) / self.scale, -5, 5), np.ones((len(x), 1))))
        inner = np.ones(len(y), bool)
        inner[starts[:-1][np.diff(starts) > 0]] = False
        k = np.flatnonzero(inner)
        seen = np.bincount(y[k - 1] * 2 + y[k], minlength=4).reshape(2, 2)
        m, v = np.zeros(len(self.w) + 4), np.zeros(len(self.w) + 4)
        for step in range(1, steps + 1):
            s = z @ self.w
            g, pairs = self.marginals(np.stack((-s / 2, s / 2), axis=1), starts)
            grad = np.concatenate((z.T @ (y - g[:, 1]) / len(y) - ridge * self.w, ((seen - pairs) / len(y) - ridge * self.t).ravel()))
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * (1 - step / (steps + 1))
            self.w += d[:-4]
            self.t += d[-4:].reshape(2, 2)


def aggregate(good: np.ndarray, size: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text: logit of the length-weighted mean of P(good), and whether it has lines."""
    total = np.diff(np.concatenate(([0.0], np.cumsum(size)))[starts])
    part = np.diff(np.concatenate(([0.0], np.cumsum(size * good)))[starts])
    q = np.clip(part / np.maximum(total, 1), 1e-4, 1 - 1e-4)
    return np.stack((np.log(q / (1 - q)), q), axis=1)


class Model:
    def __init__(self, chain, calibration, share: float):
        self.chain, self.calibration, self.share = chain, calibration, share

    def __call__(self, texts) -> np.ndarray:
        out = np.full(len(texts), self.share)
        if self.chain is None:
            return out
        x, size, starts = line_features(texts)
        if len(x):
            g, _ = self.chain.marginals(self.chain.unary(x), starts)
            some = np.diff(starts) > 0
            out[some] = logistic(self.calibration, aggregate(g[:, 1], size, starts))[some]
        return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> Model:
    import pyarrow as pa

    texts, y = sample(docs, labels, "quality", per_class)
    share = class_share(docs, labels, "quality")
    if not len(y) or share in (0.0, 1.0):
        return Model(None, None, share)
    x, size, starts = line_features(pa.array(texts, pa.string()))
    if not len(x):
        return Model(None, None, share)
    chain = Chain(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3))
    line_y = np.repeat(y, np.diff(starts))
    chain.fit(x, starts, line_y)
    g, _ = chain.marginals(chain.unary(x), starts)
    some = np.diff(starts) > 0
    worst = np.repeat(np.minimum.reduceat(g[:, 1], starts[:-1][some]), np.diff(starts)[some])
    line_y = np.where((line_y == 0) & (g[:, 1] > 0.9) & (g[:, 1] > worst), 1, line_y)
    chain.fit(x, starts, line_y)
    g, _ = chain.marginals(chain.unary(x), starts)
    calibration = at_share(fit_logistic(aggregate(g[:, 1], size, starts)[some], y[some]), y[some], share)
    return Model(chain, calibration, share)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = 2500, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return scored(docs, fit(docs, labels, per_class), threshold)
