"""What the corpus operators share: the shared folder, hashing in numpy, membership tables, and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one Arrow step of the numpy operators holds at once; longer single texts are their own step.
STEP_CHARS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset in local mode (tests)."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="prefloom-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/prefloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table with columns of longs and the like, without a Python job."""
    return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in schema.split(", "))))


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by written() that no later plan reads."""
    jvm = spark._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/prefloom/" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id, folds: int, fold: int):
    """crc32 of the id's text modulo folds equals fold; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


# -- hashing in numpy ---------------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # multipliers of the splitmix64 finaliser
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64 finaliser: a bijection of 64-bit words that behaves like a random function."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hash words to (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def string_hashes(values) -> np.ndarray:
    """64-bit hashes of an Arrow string array's values, by a polynomial over their bytes, vectorised by length class.

    Equal strings hash alike in every process; nulls hash like ''.
    """
    import pyarrow as pa

    values = values.cast(pa.large_binary()).fill_null(b"") if values.null_count else values.cast(pa.large_binary())
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64)
    _, offsets, data = values.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, values.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    starts, lens = offs[:-1], np.diff(offs)
    out = lens.astype(np.uint64) * _GOLD + np.uint64(1)
    live = np.arange(n)
    with np.errstate(over="ignore"):
        for at in range(0, 64, 8):
            live = live[lens[live] > at]
            if not len(live):
                return mix(out)
            word = np.zeros(len(live), np.uint64)
            left = lens[live] - at
            base = starts[live] + at
            for k in range(8):
                ok = left > k
                word |= np.where(ok, body[np.where(ok, base + k, 0)], 0).astype(np.uint64) << np.uint64(8 * k)
            out[live] = mix(out[live] ^ word)
        for i in live[lens[live] > 64].tolist():  # long strings, each by itself
            rest = body[starts[i] + 64 : starts[i] + lens[i]]
            words = np.frombuffer(rest.tobytes() + bytes(-len(rest) % 8), np.uint64)
            mixed = mix(words ^ np.arange(1, len(words) + 1, dtype=np.uint64) * _GOLD)
            out[i] = mix(out[i : i + 1] ^ np.bitwise_xor.reduce(mixed) ^ mixed.sum(dtype=np.uint64))[0]
    return mix(out)


def steps(lengths: np.ndarray, most: int = STEP_CHARS):
    """Slices of consecutive rows whose lengths sum to `most` or that hold one row."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, to
        at = to


def released(run):
    """A mapInArrow body that gives what it has freed back to the system when it ends.

    Workers outlive their tasks; the memory that their allocators keep would lie beside the heap in later stages.
    """

    def body(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return body


def text_steps(batches, column: str = "text", most: int = STEP_CHARS, each: int = 0):
    """Arrow batches cut into steps of bounded text, each copied: string kernels on a slice of a larger buffer have lost words (ascii_lower).

    A text counts as its bytes and `each`, for work whose memory goes by texts.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            for a, b in steps(sizes + each, most):
                yield batch.take(pa.array(np.arange(a, b)))


#: A membership table has 2^25 bits, 4 MB, whatever the number of keys.
TABLE_BITS = 25


def membership(df: DataFrame, key) -> np.ndarray:
    """Bits of the keys (longs of random low bits) in df, for held().

    The size is fixed, so it may go to every task; with far more than 2^25 keys it only lets more rows pass.  It spares
    rows a shuffle before an exact join and replaces none.
    """
    at = key.bitwiseAND((1 << TABLE_BITS) - 1) + 1
    per = 4096  # bytes of one bitmap of the SQL functions
    rows = df.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()  # at most 1,024 rows
    out = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for r in rows:
        out[(r.part - 1) * per : r.part * per] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def held(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the table; never False for one that is."""
    at = keys.view(np.int64) & ((1 << TABLE_BITS) - 1)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def may_hold(df: DataFrame, key, keys: DataFrame, of, out: str) -> DataFrame:
    """df with a boolean column `out`: whether `key` may be among the keys `of` of the other table; never False for one that is.

    As membership(), but in the JVM: a bitmap of 2^25 bits in 1,024 rows, so what is broadcast is 4 MB whatever the
    table's size.  Rows that it rules out are spared the shuffle of the exact join that must follow for the others.
    """
    place = lambda k: k.bitwiseAND((1 << TABLE_BITS) - 1) + 1
    bits = keys.groupBy(F.bitmap_bucket_number(place(of)).alias(f"{out}_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(of))).alias(f"{out}_bits"))
    at = F.bitmap_bit_position(place(key)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(f"{out}_bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, at.bitwiseAND(7)) == 1, F.lit(False))
    return df.join(F.broadcast(bits), F.bitmap_bucket_number(place(key)) == F.col(f"{out}_part"), "left").withColumn(out, hit).drop(f"{out}_part", f"{out}_bits")


# -- connected components -----------------------------------------------------------------------------------


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is one node of the component, the same for all.

    Each round hooks every node to its smallest neighbour's smallest neighbour and contracts the graph.  Nodes are
    hashes, so the order is random and a round removes a constant share of them; the rounds' maps are composed at the
    end.  Every step is a distributed aggregate or join, and each round's edges are a written table.
    """
    spark = edges.sparkSession
    live = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")), f"{name}-hook")
        jump = hook.select(F.col("node").alias("to"), F.col("to").alias("root"))
        step = written(hook.join(jump, "to").select("node", "root"), f"{name}-step")
        forget(spark, hook)
        rounds.append(step)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        nxt = live.join(left, "a").join(right, "b").where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        nxt = written(nxt, f"{name}-edges")
        forget(spark, live)
        live = nxt
    if not rounds:
        return no_rows(spark, "node long, root long")
    out = rounds[-1]
    for step in reversed(rounds[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = step.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(out, f"{name}-root")


#: Rounds in which a bucket's nodes are held against one of them, before all pairs of what is still apart.
STAR_ROUNDS = 2


def bucket_components(pairs: DataFrame, buckets: DataFrame, marks: DataFrame, verify, close, name: str, meet=None) -> tuple[DataFrame, DataFrame]:
    """Components of the nodes that share a bucket, are close, and pass verify.

    pairs (a, b) are what small buckets hold; buckets (key, node) are the larger ones; marks has a row for each node.
    close(p, q) is a condition on the marks of two nodes, with the prefixes p and q, that no linked pair fails or hardly
    any; verify maps (a, b) to the pairs linked.  In a round, the nodes of each bucket are held against one of them,
    another in every round, where it is in another component, and buckets that have become one component drop out.  So a
    bucket of n mutual copies costs n - 1 checks, and keys and nodes alone move: the marks come to the distinct pairs.
    What is then still apart in a bucket is held against each other: by `meet`, which maps (key, node, root, n) with n
    members of a key to (a, b, sure), the pairs it has found linked, or not sure of; or else within a join, so that only
    pairs that `close` lets pass are rows, each once, in the first bucket that holds both.  `close` should therefore be
    sharp.  Nodes of one component need no pair, so no link between components is lost.  Returns the (node, root) of
    linked nodes, and the links found.
    """
    spark = buckets.sparkSession
    fields = [c for c in marks.columns if c != "node"]
    roots, links, tried = no_rows(spark, "node long, root long"), None, None

    def known(rows: DataFrame, node: str, prefix: str) -> DataFrame:
        return rows.join(marks.select(F.col("node").alias(node), *(F.col(c).alias(prefix + c) for c in fields)), node)

    def linked(found: DataFrame, at: str) -> None:
        nonlocal links, roots
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            roots = components(links.select("a", "b"), f"{name}-cc{at}")

    def checked(rows: DataFrame, at: str, sketched: bool = False) -> DataFrame | None:
        """The pairs (a, b) of rows that were not tried before, are close, and pass verify."""
        nonlocal tried
        new = rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = new if tried is None else new.join(tried, ["a", "b"], "left_anti")
        if not sketched:
            new = known(known(new, "a", "p_"), "b", "q_").where(close("p_", "q_")).select("a", "b")
        new = written(new, f"{name}-pairs")
        if new.isEmpty():
            return None
        tried = new if tried is None else tried.unionByName(new)
        return written(verify(new), f"{name}-linked")

    def rooted(rows: DataFrame) -> DataFrame:
        found = roots.select(F.col("node"), F.col("root").alias("found"))
        return rows.join(found, "node", "left").select(*rows.columns, F.coalesce("found", "node").alias("root"))

    live = buckets.select("key", "node")
    for salt in range(STAR_ROUNDS):
        p = rooted(live)
        apart = p.groupBy("key").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct(F.xxhash64("node", F.lit(salt)).alias("h"), "node", "root")).alias("one"),
        ).where("low < high").select("key", F.col("one.node").alias("q_node"), F.col("one.root").alias("q_root"))
        both = written(p.join(apart, "key"), f"{name}-star")
        last, live = live, both.select("key", "node")
        star = both.where("root != q_root").select(F.col("node").alias("a"), F.col("q_node").alias("b"))
        found = checked(star if salt else star.unionByName(pairs.select("a", "b")), str(salt))
        if found is not None:
            linked(found, str(salt))
        if salt:
            forget(spark, last)
    p = rooted(live)
    apart = p.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", "n")
    p = written(p.join(apart, "key"), f"{name}-apart").select("key", "node", "root", "n")
    forget(spark, live)
    if not p.isEmpty():
        if meet is not None:
            met = written(meet(p), f"{name}-met")
            found = met.where("sure").select("a", "b")
            rest = checked(met.where("not sure"), "", True)
            linked(found if rest is None else found.unionByName(rest.select("a", "b")), "")
        else:
            keys = p.groupBy("node").agg(F.collect_list("key").alias("keys"))
            p = known(p.select("key", "node", "root").join(keys, "node"), "node", "p_")
            q = p.select(*(F.col(c).alias(f"q_{c.removeprefix('p_')}") for c in p.columns))
            once = F.col("key") == F.array_min(F.array_intersect("keys", "q_keys"))
            found = checked(p.join(q, (F.col("key") == F.col("q_key")) & (F.col("node") < F.col("q_node")) & (F.col("root") != F.col("q_root")) & close("p_", "q_") & once).select(F.col("node").alias("a"), F.col("q_node").alias("b")), "", True)
            if found is not None:
                linked(found, "")
    return roots, links if links is not None else verify(pairs.select("a", "b").limit(0))


# -- words in Arrow -----------------------------------------------------------------------------------------

_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[[c for c in range(128) if not chr(c).isalnum()]] = 32


def unpunctuated(texts):
    """ASCII punctuation and control characters of an Arrow string array replaced by spaces, byte for byte."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if data is None or not data.size:
        return texts
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(_SPACED[np.frombuffer(data, np.uint8)].tobytes())], 0, texts.offset)


class Words:
    """The white-space words of an Arrow array of texts: codes into `distinct`, and where each text's words begin."""

    def __init__(self, texts):
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        codes, distinct = flat.indices.to_numpy(), flat.dictionary
        offsets = offsets - offsets[0]
        blank = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
        if blank >= 0:  # a text's outer white space and empty texts give empty words
            keep = codes != blank
            offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
            codes = codes[keep]
        self.codes, self.distinct, self.offsets = codes, distinct, offsets
        self.blank = blank
        self._hashes = None

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the distinct words, taken once."""
        if self._hashes is None:
            self._hashes = string_hashes(self.distinct)
        return self._hashes


def shingles(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; positions whose n words leave the array are cut off."""
    m = max(len(word_hashes) - n + 1, 0)
    with np.errstate(over="ignore"):
        out = word_hashes[:m].copy()
        for k in range(1, n):
            out = (out ^ (out >> np.uint64(29))) * _M1 + word_hashes[k : k + m]
    return mix(out, n)
