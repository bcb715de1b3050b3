"""Fuzzy line dedup: MinHash bands or SimHash blocks of normalised lines, edit similarity, one occurrence of each group.

A line is normalised to lower case with runs of ASCII punctuation and white space as one space.  Lines that are equal
then are one distinct line, whatever their number.  Its 64-bit SimHash sums hashes of its words and word pairs.  Two
distinct lines are linked if their edit similarity (1 - distance / longer length) is at least ``least`` and, with a
``radius``, their SimHashes differ in at most so many bits.  Of every connected group the first occurrence stays, by doc_id and then by place; lines without a word always stay.

Candidates without a radius (op7 and the pipeline): lines that share one of ``BANDS`` MinHash bands, of three minima over
pairs of neighbouring words, or in lines of fewer than ``SHORT`` characters four minima over runs of three bytes.  Of
them edit similarity is computed where lengths and parities of character pairs allow it and, for longer lines, the
SimHashes differ in at most ``WIDE`` bits.  This is probabilistic; the README has the measured recall by line length.  With a radius of 3, the 64 bits
are cut into six blocks; three changed bits leave three blocks of six untouched, so linked lines share one of the twenty
triples of blocks, 32 bits each: the join loses no such pair.

Scale: texts stay where they are; a line is a hash of 8 bytes.  Occurrences are counted with partial sums, so a line
that a third of all documents share is one row a task.  Keys of bands go through the shuffle as packed ranges of
bounded size; where they meet, keys without company end, a small bucket becomes its pairs, and larger buckets go to
common.bucket_components, whose last step compares them in tiles, with their texts, so unlike lines of a bucket are no
rows; that work grows with the square of a bucket.  A range that grows is compacted, so no task holds a bucket.  Only lines with company move as
text, once, and in each round's verification those of its pairs.  A membership table of fixed size keeps other lines,
and documents that lose no line, out of the shuffles.  Nothing is collected or capped, and what is broadcast is 4 MB.

Defined results: a null text stays null and an empty one empty; rows that repeat a doc_id with the same text are one
document, treated alike, with other texts they are documents of their own, ordered by a hash; documents with a null
doc_id are ordered among the others by the hash of their text; very long lines are compared whole; columns other than
doc_id and text are not looked at, and clean() returns them as they are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Words, bucket_components, held, may_hold, membership, mix, no_rows, released, text_steps, unpunctuated, written

BITS = 3
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # (shift, width)
TRIPLES = tuple(combinations(range(6), 3))
BANDS, PAIR_ROWS, BYTE_ROWS = 24, 3, 4
SHORT, WIDE = 60, 22
PARITIES = 256
ODD = [f"o{i}" for i in range(PARITIES // 64)]
#: Buckets of at most so many lines become all their pairs.
SMALL = 4
#: Lines of at most so many characters, but for what they begin and end with alike, have their distances computed together, of at most and at least so many pairs.
MANY_CHARS, MANY_PAIRS, FEW_PAIRS = 2048, 1024, 32
#: Characters after which a distance of two lines is held against its bound.
COLUMNS = 256
#: Lines of more characters that may be near have an upper bound first, pair by pair.
UPPER_CHARS = 192
#: Words of 8 bytes that hold the places of all characters of such pairs, many where the alphabet is large.
MOST_WORDS = 1 << 22
#: Members of a large bucket that are compared with as many others in one place.
TILE = 2048
#: Rows of whole tiles that a task compares together: pairs of small tiles are few, and distances are faster of many at once.
STEP = 4 * TILE
#: Keys that a range of the bands' key space holds about, that a task packs at once, and that a range is compacted at.
RANGE_KEYS, PACK_KEYS, MOST_KEYS = 1 << 20, 1 << 20, 1 << 22


def _lines(texts):
    """The lines of an Arrow array of texts, where each text's lines begin, and the lines' words after normalisation."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    lines = lists.flatten()
    starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())))
    return lines, starts, Words(unpunctuated(pc.utf8_lower(lines)))


def _at_home(dk, at):
    """One number of a document and a place in it, for membership()."""
    return dk ^ at if isinstance(dk, np.ndarray) else dk.bitwiseXOR(at.cast("long"))


def _home_lines(batch, table: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines at places that the table may hold: their words, which have words, and of those the hash and the document."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern(batch.column("text").cast(pa.large_string()), "\n")
    n = pc.list_value_length(lists).fill_null(0).to_numpy()
    dk = np.repeat(batch.column("dk").to_numpy(), n)
    pick = np.flatnonzero(held(table, _at_home(dk, np.arange(len(dk)) - np.repeat(np.cumsum(n) - n, n))))
    words = Words(unpunctuated(pc.utf8_lower(lists.flatten().take(pa.array(pick)))))
    some = np.flatnonzero(np.diff(words.offsets) > 0)
    line = line_hashes(words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64), words.offsets).view(np.int64)
    return words, some, line, dk[pick][some]


def line_hashes(word_hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each line that has words: the hash of its words in their order."""
    n = np.diff(starts)
    some = np.flatnonzero(n > 0)
    if not len(some):
        return np.zeros(0, np.uint64)
    place = np.arange(len(word_hashes)) - np.repeat(starts[:-1], n)
    term = mix(word_hashes ^ mix(place.astype(np.uint64), 31), 32)
    return mix(np.add.reduceat(term, starts[:-1][some]) ^ mix(n[some].astype(np.uint64), 33), 34)


def simhash(word_hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each line's words and pairs of neighbouring words, each counted as often as it occurs."""
    n = np.diff(starts)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n > 0)
    if not len(some):
        return out
    pair = np.zeros_like(word_hashes)
    pair[:-1] = mix(word_hashes[:-1] ^ mix(word_hashes[1:], 21), 22)
    pair[starts[1:][some] - 1] = mix(word_hashes[starts[1:][some] - 1], 23)  # a line's last word again, for itself
    lanes = np.uint64(0x0001000100010001)
    at = starts[:-1][some]
    # bits k, k+16, k+32, k+48 are summed in the four 16-bit lanes of a word, in runs of at most 2^15 words
    long = int(n.max()) >= 1 << 15
    for k in range(16):
        bits = ((word_hashes >> np.uint64(k)) & lanes) + ((pair >> np.uint64(k)) & lanes)
        if not long:
            sums = np.add.reduceat(bits, at)
            for lane in range(4):
                count = (sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)
                out[some] |= (count > n[some].astype(np.uint64)).astype(np.uint64) << np.uint64(k + 16 * lane)
        else:
            for lane in range(4):
                count = np.add.reduceat((bits >> np.uint64(16 * lane)) & np.uint64(0xFFFF), at)
                out[some] |= (count > n[some].astype(np.uint64)).astype(np.uint64) << np.uint64(k + 16 * lane)
    return out


def line_sizes(words: Words) -> np.ndarray:
    """Characters of each normalised line."""
    import pyarrow.compute as pc

    each = pc.utf8_length(words.distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(each[words.codes] + 1)))
    return np.maximum(np.diff(total[words.offsets]) - 1, 0)


def joined_lines(words: Words, pick: np.ndarray):
    """The normalised text of the chosen lines, as an Arrow array."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n, begin = np.diff(words.offsets)[pick], words.offsets[:-1][pick]
    ends = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], n)
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), words.distinct.take(pa.array(words.codes[at]))), pa.scalar(" ", pa.large_string()))


def word_pairs(word_hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring words of lines that all have words, their ends included, and where each line's begin."""
    n = np.diff(starts)
    line = np.arange(len(n))
    before = np.concatenate((np.zeros(1, np.uint64), word_hashes[:-1]))
    before[starts[:-1]] = 0
    out = np.zeros(len(word_hashes) + len(n), np.uint64)
    out[np.arange(len(word_hashes)) + np.repeat(line, n)] = mix(before ^ mix(word_hashes, 21), 22)
    out[starts[1:] + line] = mix(word_hashes[starts[1:] - 1], 23)
    return out, starts[:-1] + line


def byte_runs(lines) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of three bytes of lines that are not empty, a space put at both ends, and where each line's begin."""
    import pyarrow as pa
    import pyarrow.compute as pc

    padded = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), lines, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    _, offsets, data = padded.buffers()
    offs = np.frombuffer(offsets, np.int64, len(padded) + 1, padded.offset * 8)
    body = np.frombuffer(data, np.uint8)
    n = np.diff(offs) - 2
    starts = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(starts[-1]) + np.repeat(offs[:-1] - starts[:-1], n)
    return mix(body[at].astype(np.uint64) | body[at + 1].astype(np.uint64) << np.uint64(8) | body[at + 2].astype(np.uint64) << np.uint64(16), 24), starts[:-1]


def bands(features: np.ndarray, starts: np.ndarray, rows: int, salt: int) -> np.ndarray:
    """The MinHash bands of each line, one row a band."""
    times = mix(np.arange(BANDS * rows, dtype=np.uint64), salt) | np.uint64(1)
    out = np.empty((BANDS, len(starts)), np.uint64)
    for k in range(BANDS):
        key = np.full(len(starts), salt * BANDS + k, np.uint64)
        for t in times[k * rows : (k + 1) * rows]:
            key = mix(key ^ np.minimum.reduceat(features * t, starts), 25)
        out[k] = key
    return out


def line_bands(words: Words, pick: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Bands of the chosen lines, and the place in `pick` of each; lines of a length between have both kinds."""
    size = line_sizes(words)[pick]
    keys, who = [], []
    far = np.flatnonzero(size >= int(least * SHORT) - 1)
    if len(far):
        n, begin = np.diff(words.offsets)[pick[far]], words.offsets[:-1][pick[far]]
        starts = np.concatenate(([0], np.cumsum(n)))
        codes = words.codes[np.arange(starts[-1]) + np.repeat(begin - starts[:-1], n)]
        keys.append(bands(*word_pairs(words.hashes()[codes], starts), PAIR_ROWS, 41))
        who.append(far)
    near = np.flatnonzero(size < SHORT)
    if len(near):
        keys.append(bands(*byte_runs(joined_lines(words, pick[near])), BYTE_ROWS, 42))
        who.append(near)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, int)
    return np.concatenate([k.ravel() for k in keys]), np.concatenate([np.tile(w, BANDS) for w in who])


def documents(docs: DataFrame) -> DataFrame:
    """did (the order), dk (the document: a hash of its id and text) and text ('' for null)."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(text)).alias("did"), text.alias("text"))
    return rows.select("did", F.xxhash64("did", "text").alias("dk"), "text")


def packed(key: np.ndarray, node: np.ndarray, ranges: int):
    """(ranges, bodies): keys and nodes by range of the key, a body of all its keys and then all its nodes for each range.

    The upper half of a key gives its range, the lower half stands for it there: of about RANGE_KEYS keys of a range one in
    4,096 then meets a key that is not its own, which costs a comparison of texts and changes no result.
    """
    at = ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(at, kind="stable")
    at, key, node = at[order], key[order].astype(np.uint32), node[order]
    cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[cut], [k.tobytes() + n.tobytes() for k, n in zip(np.split(key, cut[1:]), np.split(node, cut[1:]), strict=True)]


def packed_bands(rows: DataFrame, table: np.ndarray, least: float, ranges: int) -> DataFrame:
    """(part, body) of (dk, text): the bands of the lines that the table may hold, packed by range of the key."""

    @released
    def run(batches):
        import pyarrow as pa

        keys, nodes, n = [], [], 0

        def flush():
            key, node = np.concatenate(keys), np.concatenate(nodes)
            keys.clear()
            nodes.clear()
            part, body = packed(key, node, ranges)
            return pa.RecordBatch.from_arrays([pa.array(part), pa.array(body, pa.binary())], ["part", "body"])

        for batch in text_steps(batches):
            words, some, line, _ = _home_lines(batch, table)
            pick = np.unique(line, return_index=True)[1]
            key, who = line_bands(words, some[pick], least)
            keys.append(key)
            nodes.append(line[pick][who])
            n += len(key)
            if n >= PACK_KEYS:
                yield flush()
                n = 0
        if n:
            yield flush()

    return rows.select("dk", "text").mapInArrow(run, "part int, body binary")


def runs_of(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, node and bucket size of the members of buckets with more than one node, each once, sorted by key and node."""
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    same = key[1:] == key[:-1]
    mine = np.concatenate((same, [False])) | np.concatenate(([False], same))
    key, node = key[mine], node[mine]
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1]))) if len(key) else np.zeros(0, bool)
    key, node = key[new], node[new]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    size = np.diff(np.append(first, len(key)))
    return key, node, np.repeat(size, size)


def company(bands: DataFrame) -> DataFrame:
    """(large, x, y) of packed bands: the pairs x, y of a small bucket, or key x and node y of a larger one."""

    @released
    def run(batches):
        import pyarrow as pa

        def rows(large: bool, x: np.ndarray, y: np.ndarray):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), large)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["large", "x", "y"])

        def ended(key, node):
            key, node, size = runs_of(key, node)
            big = size > SMALL
            if big.any():
                yield rows(True, key[big], node[big])
            key, node = key[~big], node[~big]
            for d in range(1, SMALL):
                k = np.flatnonzero(key[d:] == key[:-d])
                if len(k):
                    yield rows(False, node[k], node[k + d])

        def compacted(key, node):
            """Members of buckets that are large already, but for enough of each to know it by, and what stays."""
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
            key, node = key[new], node[new]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            nth = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
            return rows(True, key[nth > SMALL], node[nth > SMALL]), key[nth <= SMALL], node[nth <= SMALL]

        part, held_keys, held_nodes, n, limit = None, [], [], 0, MOST_KEYS
        for batch in batches:
            for p, body in zip(batch.column("part").to_pylist(), batch.column("body"), strict=True):
                if p != part and n:
                    yield from ended(np.concatenate(held_keys), np.concatenate(held_nodes))
                    held_keys, held_nodes, n, limit = [], [], 0, MOST_KEYS
                part, data = p, body.as_py()
                size = len(data) // 12
                held_keys.append(np.frombuffer(data, np.uint32, size).astype(np.uint64) | np.uint64(p << 32))
                held_nodes.append(np.frombuffer(data, np.int64, size, 4 * size))
                n += size
                if n > limit:
                    large, key, node = compacted(np.concatenate(held_keys), np.concatenate(held_nodes))
                    yield large
                    held_keys, held_nodes, n = [key], [node], len(key)
                    limit = max(MOST_KEYS, 2 * n)
        if n:
            yield from ended(np.concatenate(held_keys), np.concatenate(held_nodes))

    return bands.mapInArrow(run, "large boolean, x long, y long")


def plausible(least: float):
    """Whether two lines of one band may be similar: lengths, parities of pairs of characters, and the SimHashes or, of short lines, the texts.

    Lengths and parities lose no pair: d edits change at most 4 d - |difference of lengths| pairs of characters, so many
    parities.  Short lines of one pattern with different contents would be many pairs, so their marks hold the text itself.
    """

    def close(p, q):
        a, b = F.col(f"{p}size"), F.col(f"{q}size")
        differ = lambda c: F.bit_count(F.col(p + c).bitwiseXOR(F.col(q + c)))
        odd = differ(ODD[0])
        for c in ODD[1:]:
            odd = odd + differ(c)
        most = F.floor((1 - least) * F.greatest(a, b) + 1e-9)
        near = F.call_function("levenshtein", F.col(f"{p}short"), F.col(f"{q}short"), most.cast("int")) >= 0
        return (F.abs(a - b) <= most) & (odd <= 4 * most - F.abs(a - b)) & F.when(F.least(a, b) < SHORT, near).otherwise(differ("s") <= WIDE)

    return close


def parities(lines: list[str]) -> np.ndarray:
    """For each line the parity of the number of its pairs of neighbouring characters in each of PARITIES bins, packed in words of 64."""
    out = np.zeros((len(lines), len(ODD)), np.int64)
    for at in range(0, len(lines), 4096):  # counts of some lines at once: many short lines are a step
        bins, n = gram_bins(lines[at : at + 4096])
        odd = (np.bincount(bins, minlength=n * PARITIES) & 1).astype(np.uint8).reshape(n, PARITIES)
        out[at : at + n] = np.packbits(odd, axis=1).view(np.int64).reshape(n, len(ODD))
    return out


def occurrences(rows: DataFrame, marked: bool) -> DataFrame:
    """(did, dk, at, h) of (did, dk, text): place and hash of each normalised line that has a word; with `marked` s, its SimHash, too."""

    @released
    def run(batches):
        import pyarrow as pa

        for batch in text_steps(batches):
            lines, starts, words = _lines(batch.column("text"))
            h = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
            some = np.flatnonzero(np.diff(words.offsets) > 0)
            line = line_hashes(h, words.offsets)
            doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            at = np.arange(len(doc)) - starts[:-1][doc]
            s = [pa.array(simhash(h, words.offsets)[some].view(np.int64))] if marked else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(doc[some])) for c in ("did", "dk")), pa.array(at[some].astype(np.int32)), pa.array(line.view(np.int64)), *s], ["did", "dk", "at", "h", *(["s"] if marked else [])])

    return rows.select("did", "dk", "text").mapInArrow(run, "did long, dk long, at int, h long" + (", s long" if marked else ""))


def block_keys(s: Column) -> Column:
    """The twenty keys of a SimHash: number of the triple, and the bits of its blocks."""
    part = [F.shiftrightunsigned(s, shift).bitwiseAND((1 << width) - 1) for shift, width in BLOCKS]
    out = []
    for k, triple in enumerate(TRIPLES):
        key = F.lit(k).cast("long")
        for b in triple:
            key = F.shiftleft(key, BLOCKS[b][1]).bitwiseOR(part[b])
        out.append(key)
    return F.array(*out)


def middles(a: str, b: str) -> tuple[str, str]:
    """Two texts without what both begin with and then both end with, the longer first; their edit distance stays."""
    k, top = 0, min(len(a), len(b))
    if a[:top] == b[:top]:
        k = top
    step = top
    while step and k < top:  # longest common beginning, by halving
        step = (step + 1) // 2 if step > 1 else 0
        while step and k + step <= top and a[k : k + step] == b[k : k + step]:
            k += step
    a, b = a[k:], b[k:]
    top, k = min(len(a), len(b)), 0
    while k < top and a[-1 - k] == b[-1 - k]:
        k += 1
    if k:
        a, b = a[:-k], b[:-k]
    return (a, b) if len(a) >= len(b) else (b, a)


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or any number above `most` where it is larger; bit-parallel, on integers of any length."""
    a, b = middles(a, b)
    if not b or len(a) <= most or len(a) - len(b) > most:
        # changing every character of the rest is enough, or the lengths alone are too far apart
        return len(a) if not b or len(a) <= most else most + 1
    peq: dict[str, int] = {}
    for i, c in enumerate(b):
        peq[c] = peq.get(c, 0) | 1 << i
    # rows of b near the diagonal alone, as in within(): from `begun` on, of value `head` above; values below count one each
    gap, step = len(b) - len(a), max(16, most // 16)
    above, below = (gap - most) // 2, -((-gap - most) // 2)
    begun = head = size = score = plus = minus = 0
    for at in range(0, len(a), COLUMNS):
        first, end = max(begun, min(at + above, len(b) - 1)), max(begun + size, min(len(b), at + COLUMNS + below + 1))
        plus |= (1 << end - begun) - (1 << size)
        score += end - begun - size
        left = (1 << first - begun) - 1
        head += (plus & left).bit_count() - (minus & left).bit_count()
        plus, minus = plus >> first - begun, minus >> first - begun
        begun, size = first, end - first
        full, high = (1 << size) - 1, 1 << size - 1
        value, part, least = head, (1 << step) - 1, head + abs(len(b) - begun - len(a) + at)
        for k in range(step, size + step, step):
            value += (plus >> k - step & part).bit_count() - (minus >> k - step & part).bit_count()
            least = min(least, value + abs(len(b) - begun - min(k, size) - len(a) + at))
        if least - step > most:
            return most + 1
        here: dict[str, int] = {}
        for c in a[at : at + COLUMNS]:
            eq = here.get(c)
            if eq is None:
                eq = here[c] = peq.get(c, 0) >> begun & full
            x = eq | minus
            eq |= ((eq & plus) + plus) ^ plus
            up = minus | ~(eq | plus) & full
            down = plus & eq
            if up & high:
                score += 1
            elif down & high:
                score -= 1
            up = up << 1 | 1
            plus = (down << 1 | ~(x | up)) & full
            minus = up & x & full
        head += min(COLUMNS, len(a) - at)
    return min(score, most + 1)


def changed_characters(a: str, b: str) -> int:
    """An upper bound of the edit distance: words put in the place of others, or, of equal lengths, characters in that of others."""
    x, y = a.split(" "), b.split(" ")
    bound = max(len(a), len(b))
    if len(x) == len(y):
        bound = min(bound, sum(max(len(p), len(q)) for p, q in zip(x, y, strict=True) if p != q))
    if len(a) == len(b):
        bound = min(bound, sum(map(str.__ne__, a, b)))
    return bound


def similar(a: str, b: str, least: float) -> bool:
    """Edit similarity of two texts is at least `least`."""
    longer = max(len(a), len(b))
    return edit_distance(a, b, int((1 - least) * longer + 1e-9)) <= (1 - least) * longer + 1e-9


def _characters(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all lines, the line of each, and its place in the line."""
    n = np.array([len(t) for t in lines], np.int64)
    of = np.repeat(np.arange(len(lines)), n)
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32), of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair of texts that are not empty is at most `most`, all at once: a step takes the
    next character of every `b` in words of 64 characters of `a` (Myers, with carries between words).  Texts `a` should
    be of about one length; pairs that can't come back below their bound are left out on the way.

    Only words near the diagonal are taken: a path that is t rows below it costs |t| and |m - n - t| more to its end.  Rows
    above are left behind, rows below not begun count one each, so values are never too small and right on such paths.
    """
    (ca, of_a, at_a), (cb, of_b, at_b) = _characters(a), _characters(b)
    m, n = (np.bincount(of, minlength=len(a)) for of in (of_a, of_b))
    words = -(-int(m.max()) // 64)
    one, top = np.uint64(1), np.uint64(63)
    known = np.bincount(ca, minlength=int(cb.max()) + 1) > 0
    kinds = int(known.sum()) + 1
    if len(a) > 1 and len(a) * kinds * words > MOST_WORDS:
        half = len(a) // 2
        return np.concatenate((within(a[:half], b[:half], most[:half]), within(a[half:], b[half:], most[half:])))
    code = np.where(known, np.cumsum(known), 0)  # 0, which has no bits: a character that no `a` has
    bits = np.zeros((len(a) * kinds, words), np.uint64)
    np.bitwise_or.at(bits.reshape(-1), (of_a * kinds + code[ca]) * words + (at_a >> 6), one << (at_a & 63).astype(np.uint64))
    text = np.zeros((len(a), int(n.max())), np.int32)
    text[np.arange(text.shape[1]) < n[:, None]] = of_b * kinds + code[cb]
    text, bits = text.T.copy(), bits.T.copy()
    out, ends = np.zeros(len(a), bool), np.bincount(n) > 0
    live, score = np.arange(len(a)), m.copy()
    last, least_last = (m - 1) // 64, (int(m.min()) - 1) // 64
    shift, bound = ((m - 1) % 64).astype(np.uint64), np.asarray(most, np.int64)
    plus, minus = np.full((words, len(a)), ~np.uint64(0)), np.zeros((words, len(a)), np.uint64)
    begun, until, head = 0, 0, np.zeros(len(a), np.int64)  # words taken, and the value above the first of them
    above, below = int((m - n - bound).min()) // 2, -(int((n - m - bound).min()) // 2)
    with np.errstate(over="ignore"):
        for j in range(len(text)):
            while begun < min(max(0, j + above) // 64, words - 1):
                head += np.bitwise_count(plus[begun]).astype(np.int64) - np.bitwise_count(minus[begun])
                begun += 1
            until = max(begun, until, min(max(0, j + below) // 64, words - 1))
            head += 1
            here = text[j, live]
            up_in, down_in = one, np.uint64(0)
            for w in range(begun, until + 1):
                p, q, eq = plus[w], minus[w], bits[w].take(here)
                x = eq | q
                eq |= down_in
                h = eq & p
                h += p
                h ^= p
                h |= eq
                down = h & p
                h |= p
                np.invert(h, out=h)
                h |= q  # where a row's value rises with this character
                up_out, down_out = h >> top, down >> top
                if w == until < least_last:
                    score += (up_out - down_out).view(np.int64)
                elif w >= least_last:
                    at = shift if w == words - 1 else np.where(last > w, top, shift)
                    delta = ((h >> at) & one).view(np.int64) - ((down >> at) & one).view(np.int64)
                    score += delta if w == until == least_last else delta * (last >= w if w == until else last == w)
                h <<= one
                h |= up_in
                down <<= one
                down |= down_in
                np.bitwise_and(h, x, out=q)
                x |= h
                np.invert(x, out=x)
                np.bitwise_or(down, x, out=p)
                up_in, down_in = up_out, down_out
            if j % 8 == 7 or ends[j + 1]:
                ended = n == j + 1
                out[live[ended]] = score[ended] <= bound[ended]
                stays = (n > j + 1) & (score - (n - j - 1) <= bound)
                if j % 32 == 31:
                    stays &= least_end(plus[begun : until + 1], minus[begun : until + 1], head, 64 * begun, m - (n - j - 1)) <= bound
                if stays.sum() < 0.9 * len(stays):
                    live, score, last, shift, m, n, bound, head, plus, minus = live[stays], score[stays], last[stays], shift[stays], m[stays], n[stays], bound[stays], head[stays], plus[:, stays], minus[:, stays]
                    if not len(live):
                        break
                    above = int((m - n - bound).min()) // 2
    return out


def least_end(plus: np.ndarray, minus: np.ndarray, head: np.ndarray, row: int, even: np.ndarray) -> np.ndarray:
    """A lower bound of the distance of each pair whose path goes through the words: rows from `row` on, of value `head`.

    A path's end costs as many characters more as it is away from the row `even`.  Values are taken every 16 rows; with that
    rest they change by at most 2 a row, and 8 rows are the most to the next.
    """
    value, least = head.copy(), head + np.abs(row - even)
    for w in range(len(plus)):
        for k in range(0, 64, 16):
            part = np.uint64(0xFFFF << k)
            value += np.bitwise_count(plus[w] & part)
            value -= np.bitwise_count(minus[w] & part)
            row += 16
            np.minimum(least, value + np.abs(row - even), out=least)
    return least - 16


def similar_pairs(a: list[str], b: list[str], least: float, differ: np.ndarray | None = None) -> np.ndarray:
    """similar() of many pairs: a lower bound first, and the distances of what passes, many at once where lines aren't very long.

    `differ` are gram_distances, if known.  Long lines that may be near by them have the upper bound before the distance.
    """
    la, lb = (np.array([len(t) for t in x], np.int64) for x in (a, b))
    most = np.floor((1 - least) * np.maximum(la, lb) + 1e-9).astype(np.int64)
    ok = np.abs(la - lb) <= most
    some = np.flatnonzero(ok & (la > 1) & (lb > 1))
    if differ is None:
        differ = np.zeros(len(la), np.int64)
        for at in range(0, len(some), 1024):
            k = some[at : at + 1024]
            differ[k] = gram_distances([a[i] for i in k], [b[i] for i in k])
    ok[some] = differ[some] <= 4 * most[some] - np.abs(la[some] - lb[some])
    sure = np.zeros(len(la), bool)
    for k in np.flatnonzero(ok & (np.maximum(la, lb) > UPPER_CHARS) & (differ <= 2 * most)).tolist():
        x, y = middles(a[k], b[k])
        sure[k] = changed_characters(x, y) <= most[k]
    ok &= ~sure
    some = np.flatnonzero(ok)
    trimmed = [middles(a[k], b[k]) for k in some.tolist()]  # what both begin and end with is no step of a distance
    la, lb = (np.array([len(t[side]) for t in trimmed], np.int64) for side in (0, 1))
    ok[some[(lb == 0) & (la > most[some])]] = False
    left = np.flatnonzero((lb > 0) & (la > most[some]))  # the others change no more than that many characters at all
    left = left[np.argsort(la[left], kind="stable")]
    singly, many = left[la[left] > MANY_CHARS].tolist(), left[la[left] <= MANY_CHARS]
    done = 0
    while done < len(many):
        alike = many[done : np.searchsorted(la[many], max(64, 1.5 * la[many[done]]), "right")]
        done += len(alike)
        if len(alike) < FEW_PAIRS:
            singly += alike.tolist()
            continue
        alike = alike[np.argsort(la[alike] - lb[alike], kind="stable")]  # paths of one place are of few rows
        for k in np.array_split(alike, -(-len(alike) // MANY_PAIRS)):
            ok[some[k]] = within([trimmed[i][0] for i in k], [trimmed[i][1] for i in k], most[some[k]])
    for i in singly:
        x, y = trimmed[i]
        k = some[i]
        ok[k] = changed_characters(x, y) <= most[k] or edit_distance(x, y, int(most[k])) <= most[k]
    return ok | sure


def line_texts(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """(dk, h, marks, line) of (dk, text): SimHash, length, parities and text of the normalised lines that the table may hold."""

    @released
    def run(batches):
        import pyarrow as pa

        for batch in text_steps(batches):
            words, some, line, dk = _home_lines(batch, table)
            codes = words.codes
            s = simhash(words.hashes()[codes] if len(codes) else np.zeros(0, np.uint64), words.offsets)[some]
            texts = joined_lines(words, some).cast(pa.string())
            odd = parities(texts.to_pylist())
            columns = [pa.array(dk), pa.array(line), pa.array(s.view(np.int64)), pa.array(line_sizes(words)[some].astype(np.int32)), *(pa.array(odd[:, k]) for k in range(len(ODD))), texts]
            yield pa.RecordBatch.from_arrays(columns, ["dk", "h", "s", "size", *ODD, "line"])

    return rows.select("dk", "text").mapInArrow(run, "dk long, h long, s long, size int, " + ", ".join(f"{o} long" for o in ODD) + ", line string")


def only(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """Rows of (h, line) that the table may hold."""

    @released
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(held(table, batch.column("h").to_numpy())))

    return texts.mapInArrow(run, texts.schema)


def _block_buckets(distinct: DataFrame) -> DataFrame:
    """(key, node): lines whose SimHashes share three blocks with another's."""
    # nodes are distinct lines; a SimHash's smallest line stands for it in the blocks
    heads = distinct.groupBy("s").agg(F.min("h").alias("head"), F.count(F.lit(1)).alias("same"))
    keys = heads.select(F.explode(block_keys(F.col("s"))).alias("key"), "s")
    near = keys.withColumn("low", F.min("s").over(Window.partitionBy("key"))).withColumn("high", F.max("s").over(Window.partitionBy("key"))).where("low < high")
    buckets_s = near.select("key", "s")
    # lines of one SimHash share a bucket too
    lines_of = distinct.select("s", F.col("h").alias("node"))
    alike = lines_of.join(heads.where("same > 1").select("s"), "s").select(F.xxhash64(F.lit("s"), "s").alias("key"), "node")
    return buckets_s.join(lines_of, "s").select("key", "node").unionByName(alike)


def gram_bins(lines: list[str]) -> tuple[np.ndarray, int]:
    """line * PARITIES + bin of every pair of neighbouring characters, and the number of lines."""
    c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(lines)), [len(t) for t in lines])
    at = (c[:-1] * np.uint32(0x9E3779B1) + c[1:]) * np.uint32(0x85EBCA6B) >> np.uint32(16)
    return (of[:-1] * PARITIES + (at % np.uint32(PARITIES)))[of[1:] == of[:-1]], len(lines)


def gram_counts(lines: list[str]) -> np.ndarray:
    """Hashed counts of the pairs of neighbouring characters of lines of fewer than 2^15 characters."""
    out = np.zeros((len(lines), PARITIES), np.int16)
    for at in range(0, len(lines), 1024):
        bins, n = gram_bins(lines[at : at + 1024])
        out[at : at + n] = np.bincount(bins, minlength=n * PARITIES).reshape(n, PARITIES)
    return out


def count_distances(counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """gram_distances() of pairs of lines by their counts."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 4096):
        out[at : at + 4096] = np.abs(counts[i[at : at + 4096]] - counts[j[at : at + 4096]]).sum(axis=1, dtype=np.int64)
    return out


def gram_distances(a: list[str], b: list[str]) -> np.ndarray:
    """For each pair a lower bound of the number of character pairs that only one of the two texts has: that of hashed counts."""
    counts = [np.bincount(bins, minlength=n * PARITIES).reshape(n, PARITIES) for bins, n in (gram_bins(a), gram_bins(b))]
    return np.abs(counts[0] - counts[1]).sum(axis=1)


def edit_similar(both: DataFrame, least: float) -> DataFrame:
    """(a, b) of (a, b, ta, tb) where the texts' edit similarity is at least `least`.

    An edit changes at most two of a text's pairs of neighbouring characters, so texts within d edits of each other have no
    more than 4 d - |difference of lengths| that the other lacks; what passes that bound is compared.  (In Python batches, as
    Spark's levenshtein took about 1 ms a pair here.)
    """

    @released
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ok = similar_pairs(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), least)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    most = F.floor((1 - least) * F.greatest(F.length("ta"), F.length("tb")) + 1e-9)
    return both.where(F.abs(F.length("ta") - F.length("tb")) <= most).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def tile_links(apart: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b, sure) of (key, node, root, n), the members of buckets of n that are in more than one component.

    All pairs of a bucket of different roots are compared where they meet, in tiles of about TILE by TILE members, so no
    pair is a row: what comes out joins components that the tile had not joined before, so it is fewer rows than went in.
    A pair is compared in the first bucket that both are in.  Pairs with a text too long to travel come out unsure.
    """
    fields = ["s", "size", *ODD]
    keys = apart.groupBy("node").agg(F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("key", "n"))).alias("at"))
    line = F.when(F.col("size") <= MANY_CHARS, F.col("line")).alias("line")
    rows = keys.join(texts.withColumnRenamed("h", "node"), "node").select("node", "root", F.col("at.key").alias("keys"), *fields, line, F.explode("at").alias("x"))
    parts = F.ceil(F.col("x.n") / TILE).cast("int")
    rows = rows.withColumn("key", F.col("x.key")).withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    tile = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    # side 0: all pairs of the tile; 1 and 2: pairs of both sides
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    rows = rows.select(tile.alias("tile"), side.alias("side"), "key", "node", "root", "keys", *fields, "line")

    @released
    def run(batches):
        import pyarrow as pa

        def ended(table):
            for a, b, sure in joined_in_tiles(table, least):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), sure))], ["a", "b", "sure"])

        kept = []
        for batch in batches:
            kept.append(batch)
            if sum(x.num_rows for x in kept) >= STEP:
                table = pa.Table.from_batches(kept)
                tile = table.column("tile").to_numpy()
                before = np.flatnonzero(tile != tile[-1])
                whole = int(before[-1]) + 1 if len(before) else 0
                if whole:
                    yield from ended(table.slice(0, whole))
                kept = table.slice(whole).to_batches()
        if kept:
            yield from ended(pa.Table.from_batches(kept))

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long, sure boolean")


def joined_in_tiles(table, least: float):
    """(a, b, whether verified) of an Arrow table of whole tiles: links between components that no link before them has joined."""
    import pyarrow as pa

    tile, side, key, node, root, s, size = (table.column(c).to_numpy() for c in ("tile", "side", "key", "node", "root", "s", "size"))
    odd = [table.column(c).to_numpy() for c in ODD]
    lines = table.column("line").combine_chunks()
    keys = table.column("keys").combine_chunks()
    starts, flat = keys.offsets.to_numpy(), keys.values.to_numpy()
    names, top = np.unique(root, return_inverse=True)
    first = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
    many = int(np.diff(np.append(first, len(tile))).max())
    texts = lines.to_pylist()
    grams = gram_counts([t or "" for t in texts])
    near = lambda i, j: np.abs(size[i] - size[j]) <= np.floor((1 - least) * np.maximum(size[i], size[j]) + 1e-9)

    n_keys = np.diff(starts)
    own = flat[starts[:-1, None] + np.minimum(np.arange(n_keys.max()), n_keys[:, None] - 1)]

    def here(i, j):
        """Whether no smaller key than the tile's is one of both."""
        out = np.empty(len(i), bool)
        for at in range(0, len(i), 2048):
            x, y = own[i[at : at + 2048]], own[j[at : at + 2048]]
            both = (x[:, :, None] == y[:, None, :]).any(axis=2)
            out[at : at + 2048] = ~(both & (x < key[i[at : at + 2048], None])).any(axis=1)
        return out

    def compared(i, j):
        nonlocal top
        i, j = i[new := top[i] != top[j]], j[new]
        i, j = i[mine := here(i, j)], j[mine]
        long = np.maximum(size[i], size[j]) > MANY_CHARS
        if long.any():
            yield node[i[long]], node[j[long]], False
        i, j = i[~long], j[~long]
        # parts of growing size, as links found make more pairs needless
        done, step = 0, 4096
        while done < len(i):
            x, y = i[done : done + step], j[done : done + step]
            done, step = done + step, min(4 * step, 65536)
            x, y = x[new := top[x] != top[y]], y[new]
            differ = count_distances(grams, x, y)
            passed = differ <= 4 * np.floor((1 - least) * np.maximum(size[x], size[y]) + 1e-9) - np.abs(size[x] - size[y])
            x, y, differ = x[passed], y[passed], differ[passed]
            ok = similar_pairs([texts[k] for k in x.tolist()], [texts[k] for k in y.tolist()], least, differ)
            links = []
            above = np.arange(len(names))
            for a, b in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                ra, rb = top[a], top[b]
                while above[ra] != ra:
                    ra = above[ra]
                while above[rb] != rb:
                    rb = above[rb]
                if ra != rb:
                    above[max(ra, rb)] = min(ra, rb)
                    links.append((a, b))
            if links:
                while (above[above] != above).any():
                    above = above[above]
                top = above[top]
                at = np.array(links)
                yield node[at[:, 0]], node[at[:, 1]], True

    found, n = [], 0
    for d in range(1, many):
        i = np.flatnonzero((tile[d:] == tile[:-d]) & (top[d:] != top[:-d]))
        j = i + d
        ok = near(i, j) & ((side[i] == 0) | (side[i] != side[j])) & (node[i] != node[j])
        i, j = i[ok], j[ok]
        differ = np.zeros(len(i), np.int64)
        for o in odd:
            differ += np.bitwise_count((o[i] ^ o[j]).view(np.uint64))
        big, gap = np.maximum(size[i], size[j]), np.abs(size[i] - size[j])
        ok = differ <= 4 * np.floor((1 - least) * big + 1e-9) - gap
        ok &= (np.minimum(size[i], size[j]) < SHORT) | (np.bitwise_count((s[i] ^ s[j]).view(np.uint64)) <= WIDE)
        found.append((i[ok], j[ok]))
        n += int(ok.sum())
        if n >= 1 << 16:
            yield from compared(*(np.concatenate(x) for x in zip(*found, strict=True)))
            found, n = [], 0
    if n:
        yield from compared(*(np.concatenate(x) for x in zip(*found, strict=True)))


def groups(rows: DataFrame, least: float = 0.8, radius: int | None = BITS) -> tuple[DataFrame, DataFrame]:
    """Of documents(): the occurrences (dk, at, h), and for every line that is not alone (h, root, first_dk, first_at, lines, members).

    first_dk and first_at are the first occurrence of the group; lines counts its occurrences, members its distinct lines.
    """
    spark = rows.sparkSession
    seen = written(occurrences(rows, radius is not None), "lines")
    own = [F.min("s").alias("s")] if radius is not None else []
    distinct = written(seen.groupBy("h").agg(F.min(F.struct("did", "dk", "at")).alias("first"), F.count(F.lit(1)).alias("n"), *own), "distinct")
    home = distinct.select("h", F.col("first.dk").alias("dk"), F.col("first.at").alias("at"))
    if radius is None:
        ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), distinct.count() * BANDS // RANGE_KEYS)
        packs = packed_bands(rows, membership(home, _at_home(F.col("dk"), F.col("at"))), least, ranges)
        found = written(company(packs.repartition("part").sortWithinPartitions("part")), "line-company")
        pairs = written(found.where("not large").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "line-candidates")
        buckets = found.where("large").select(F.col("x").alias("key"), F.col("y").alias("node")).distinct()
        close = plausible(least)
    else:
        pairs = no_rows(spark, "a long, b long")
        buckets = _block_buckets(distinct)
        close = lambda p, q: F.bit_count(F.col(f"{p}s").bitwiseXOR(F.col(f"{q}s"))) <= radius
    buckets = written(buckets, "line-buckets")
    nodes = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).unionByName(buckets.select(F.col("node").alias("h"))).distinct()
    nodes = written(nodes.join(home, "h"), "line-nodes")
    moved = line_texts(rows, membership(nodes, _at_home(F.col("dk"), F.col("at"))))
    # a line has one first document, so (dk, h) is as good a key as h
    texts = written(moved.join(nodes.drop("at"), ["dk", "h"]).dropDuplicates(["h"]).drop("dk"), "line-texts")

    def verify(pairs: DataFrame) -> DataFrame:
        lines = texts.select("h", "line")
        a = only(lines, membership(pairs, F.col("a"))).select(F.col("h").alias("a"), F.col("line").alias("ta"))
        b = only(lines, membership(pairs, F.col("b"))).select(F.col("h").alias("b"), F.col("line").alias("tb"))
        return edit_similar(pairs.join(a, "a").join(b, "b"), least)

    short = F.when(F.col("size") <= int(SHORT / least), F.col("line")).alias("short")
    marks = texts.select(F.col("h").alias("node"), "s", "size", *ODD, short)
    meet = (lambda apart: tile_links(apart, texts, least)) if radius is None else None
    roots, _ = bucket_components(pairs, buckets, marks, verify, close, "lines", meet)
    owner = distinct.join(roots, distinct["h"] == roots["node"], "left").select("h", "first", "n", F.coalesce("root", "h").alias("root"))
    # lines that are alone have no root and one occurrence; they need no group
    owner = owner.where("n > 1 or root != h").unionByName(owner.where("n = 1 and root = h").join(roots.select(F.col("node").alias("h")), "h", "left_semi"))
    per = owner.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("lines"), F.count(F.lit(1)).alias("members")).where("lines > 1")
    table = owner.select("h", "root").join(per, "root").select("h", "root", F.col("first.dk").alias("first_dk"), F.col("first.at").alias("first_at"), "lines", "members")
    return seen.select("dk", "at", "h"), written(table, "line-groups")


def dropped(rows: DataFrame, least: float = 0.8, radius: int | None = BITS) -> DataFrame:
    """(dk, drop): the places of each document's lines that go; documents that lose none are not there."""
    seen, group = groups(rows, least, radius)
    many = may_hold(seen, F.col("h"), group, F.col("h"), "many").where("many").select("dk", "at", "h")
    again = many.join(group.select("h", "first_dk", "first_at"), "h").where("dk != first_dk or at != first_at")
    return again.groupBy("dk").agg(F.collect_set("at").alias("drop"))


def _cut(text: Column, drop: Column) -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(drop, i))
    return F.array_join(kept, "\n")


def _with_drops(docs: DataFrame, least: float, radius: int | None) -> DataFrame:
    """(row, text, drop): each row of docs as a struct, its text, and the places that go (null: none); only documents that lose lines are joined."""
    gone = written(dropped(documents(docs), least, radius), "dropped")
    text = docs["text"].cast("string")
    did = F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(text, F.lit(""))))
    rows = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), F.xxhash64(did, F.coalesce(text, F.lit(""))).alias("dk"))
    rows = may_hold(rows, F.col("dk"), gone, F.col("dk"), "loses")
    some = rows.where("loses").join(gone, "dk", "left").select("row", "text", "drop")
    return rows.where("not loses").select("row", "text", F.lit(None).cast("array<int>").alias("drop")).unionByName(some)


def deduplicate(docs: DataFrame, least: float = 0.8, radius: int | None = BITS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, dropped) of every row: the text without the lines that go, and their places."""
    out = _with_drops(docs, least, radius)
    return out.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.when(F.col("drop").isNull(), F.col("text")).otherwise(_cut(F.col("text"), F.col("drop"))).alias("text"),
        F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), F.array_sort(F.coalesce("drop", F.array().cast("array<int>"))).alias("dropped"),
    )


def clean(docs: DataFrame, least: float = 0.8, radius: int | None = BITS) -> DataFrame:
    """The documents without the lines that go, columns as they are; a document whose every line with a word goes is gone.

    n_chars, where there is such a column, is the new text's length.
    """
    out = _with_drops(docs, least, radius)
    cut = F.when(F.col("drop").isNull(), F.col("text")).otherwise(_cut(F.col("text"), F.col("drop")))
    out = out.select("row", cut.alias("text"), F.col("drop").isNull().alias("whole"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.length("text").cast(kind if isinstance(kind, T.NumericType) else "long"))
    out = out.where(F.col("whole") | F.col("text").rlike(r"[A-Za-z0-9]|[^\x00-\x7F]"))
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
