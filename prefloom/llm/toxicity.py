"""Toxicity by compression distance: a zstandard dictionary of toxic and one of ordinary text, compared window by window.

Fitting, on a bounded sample of labelled documents: character 5-grams that are far more frequent in toxic documents
than in ordinary ones mark the toxic phrases; those phrases, the commonest last, are the toxic dictionary's own
content.  A zstandard dictionary trained on ordinary text follows in both dictionaries, and in the ordinary one as
much further trained ordinary text takes the phrases' place.  So a window without a toxic phrase compresses to the same
length with either, and the difference of the two lengths measures what the toxic phrases explain.

Scoring: each whole text is lower-cased and cut into windows of ``WINDOW`` words; from the differences come the counts
and shares of windows above several cuts and the largest difference; a logistic function calibrates them to a probability,
at the class shares of all usable labels and not those of the sample.  It is fitted on the sample's documents, each half
measured with dictionaries made from the other half; the dictionaries that score are made from the whole sample.

Scale: one pass without a shuffle; the model that goes to the executors has a fixed size.  The sample is bounded by
``per_class``.  Defined results: null and empty texts have no windows and get the score of a text in which nothing
is toxic; with labels of one class only, every score is that class's share; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from .common import STEP_CHARS, mix, released, steps, text_steps, uniform
from .labelled import at_share, class_share, fit_logistic, logistic, sample, scored

WINDOW = 10
GRAM = 5
BASE_BYTES, PHRASE_BYTES = 6000, 2000
CUTS = (2, 3, 4, 5, 6, 8)
#: Parts of the sample; each is measured with dictionaries of the others, to calibrate those of the whole.
FOLDS = 2
#: Pieces that the dictionary trainer is given at most, from all places of the sampled texts.
PIECES = 60_000
LEAST_SHARE, LEAST_LIFT, LEAST_Z = 0.03, 10, 5


def _parameters():
    import zstandard

    return zstandard.ZstdCompressionParameters(window_log=14, hash_log=13, chain_log=13, search_log=4, min_match=4, target_length=8, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)


def compressor(content: bytes):
    import zstandard

    p = _parameters()
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


def _words(text: str) -> list[str]:
    return text.lower().split()


def _grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))]


def phrases(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Stretches of words covered by over-represented 5-grams, the commonest first."""
    in_toxic, in_ordinary = (Counter(g for t in texts for g in {g for w in set(_words(t)) for g in _grams(w)}) for texts in (toxic, ordinary))
    n, m = len(toxic), len(ordinary)
    marked = set()
    for g, c in in_toxic.items():
        o = in_ordinary.get(g, 0)
        p = (c + o) / (n + m)
        z = (c / n - o / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12)
        if z > LEAST_Z and c >= max(3, LEAST_SHARE * n) and c / n > LEAST_LIFT * (o + 0.1) / m:
            marked.add(g)
    found: Counter[str] = Counter()
    for t in toxic:
        for w in set(_words(t)):
            padded, keep = f" {w} ", np.zeros(len(w) + 2, bool)
            for i, g in enumerate(_grams(w)):
                if g in marked:
                    keep[i : i + GRAM] = True
            found.update(re.findall("[^\0]+", "".join(c if k else "\0" for c, k in zip(padded, keep, strict=True))))
    out: list[str] = []
    for p, _ in sorted(found.items(), key=lambda x: (-x[1], x[0])):  # ties by phrase: the order of a set differs between runs
        if len(p) >= GRAM - 1 and not any(p in q for q in out):
            out.append(p)
    return out


def pieces(texts: list[str], most: int = PIECES) -> list[bytes]:
    """Pieces of 200 characters from the whole of every text; of more than `most` in all, about `most` by a hash of their place."""
    plain = [" ".join(["", *_words(t)]) for t in texts]
    places = np.array([(k, i) for k, t in enumerate(plain) for i in range(0, len(t), 200)], np.int64).reshape(-1, 2)
    if len(places) > most:
        places = places[uniform(mix(np.arange(len(places), dtype=np.uint64), 51)) < most / len(places)]
    return [plain[k][i : i + 200].encode() for k, i in places]


def _trained(texts: list[str], size: int) -> bytes:
    import zstandard

    samples = pieces(texts)
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6, level=3).as_bytes()[-size * 3 // 4 :]
    except zstandard.ZstdError:  # too few samples for the trainer: the text itself
        return b"".join(samples)[-size * 3 // 4 :]


def differences(texts, toxic, ordinary) -> tuple[np.ndarray, np.ndarray]:
    """Compressed length with the ordinary dictionary less that with the toxic one, for each window; where each text's windows begin."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import zstandard

    padded = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.utf8_lower(texts.cast(pa.large_string())), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    _, offsets, data = padded.buffers()
    offs = np.frombuffer(offsets, np.int64, len(padded) + 1, padded.offset * 8)
    body = np.frombuffer(data, np.uint8)[: offs[-1]].copy()
    body[(body >= 9) & (body <= 13)] = 32
    space = body == 32
    begin = np.flatnonzero(~space[1:] & space[:-1]) + 1
    end = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    first = np.searchsorted(begin, offs)  # first word of each text
    n = np.diff(first)
    per_text = -(-n // WINDOW)
    at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(per_text)[:-1])) * WINDOW, per_text) + np.arange(per_text.sum()) * WINDOW
    last = np.minimum(at + WINDOW, np.repeat(first[1:], per_text)) - 1
    starts = np.concatenate(([0], np.cumsum(per_text)))
    if not len(at):
        return np.zeros(0, int), starts
    low, high = begin[at] - 1, end[last] + 1
    segments = np.stack((low, high - low), axis=1).astype(np.uint64).tobytes()
    raw = body.tobytes()
    a, b = (c.multi_compress_to_buffer(zstandard.BufferWithSegments(raw, segments)) for c in (ordinary, toxic))
    return np.array([len(a[i]) - len(b[i]) for i in range(len(a))]), starts


def features(d: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = np.diff(starts)
    out = np.zeros((len(n), 2 * len(CUTS) + 2))
    for k, cut in enumerate(CUTS):
        c = np.diff(np.concatenate(([0], np.cumsum(d >= cut)))[starts])
        out[:, 2 * k], out[:, 2 * k + 1] = np.log1p(c), np.sqrt(c / np.maximum(n, 1))
    some = n > 0
    if some.any():
        out[some, -2] = np.clip(np.maximum.reduceat(d, starts[:-1][some]), 0, 12)
    out[:, -1] = np.log1p(n)
    return out


class Model:
    """What scores texts: the contents of two dictionaries and a logistic function; of fixed size."""

    def __init__(self, toxic: bytes, ordinary: bytes, calibration, share: float):
        self.toxic, self.ordinary, self.calibration, self.share = toxic, ordinary, calibration, share

    def __call__(self, texts) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(texts), self.share)
        if not hasattr(self, "_made"):
            self._made = (compressor(self.toxic), compressor(self.ordinary))
        return logistic(self.calibration, features(*differences(texts, *self._made)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}


def contents(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of the toxic and of the ordinary dictionary."""
    own = "".join(reversed(phrases(toxic, ordinary))).encode()[-PHRASE_BYTES:] or b" "
    half = len(ordinary) // 2 + 1
    base = _trained(ordinary[:half], BASE_BYTES * 4 // 3)
    return own + base, _trained(ordinary[half:] or ordinary, PHRASE_BYTES * 4 // 3)[-len(own) :] + base


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> Model:
    import pyarrow as pa

    texts, y = sample(docs, labels, "toxic", per_class)
    share = class_share(docs, labels, "toxic")
    toxic, ordinary = ([t for t, v in zip(texts, y, strict=True) if v == c] for c in (1, 0))
    if not toxic or not ordinary:
        return Model(b"", b"", None, share)
    pair = contents(toxic, ordinary)
    parts = [(toxic[f::FOLDS], ordinary[f::FOLDS], *contents([t for k, t in enumerate(toxic) if k % FOLDS != f], [t for k, t in enumerate(ordinary) if k % FOLDS != f])) for f in range(FOLDS)] if min(len(toxic), len(ordinary)) >= FOLDS else [(toxic, ordinary, *pair)]
    x, labels_ = [], []
    for some_toxic, some_ordinary, own, other in parts:
        rest, made = some_toxic + some_ordinary, (compressor(own), compressor(other))
        sizes = np.array([len(t) for t in rest])  # in steps, so the driver holds the windows of a few texts at once
        x += [features(*differences(pa.array(rest[a:b], pa.string()), *made)) for a, b in steps(sizes, STEP_CHARS // 4)]
        labels_ += [1] * len(some_toxic) + [0] * len(some_ordinary)
    labels_ = np.array(labels_)
    return Model(*pair, at_share(fit_logistic(np.vstack(x), labels_), labels_, share), share)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = 2500, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return scored(docs, fit(docs, labels, per_class), threshold)


def clean(docs: DataFrame, labels: DataFrame, per_class: int = 2500, threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, columns as they are."""
    model = fit(docs, labels, per_class)

    @released
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in text_steps(batches):
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            yield batch.filter(pa.array(model(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
