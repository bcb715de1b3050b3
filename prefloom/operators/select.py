"""Selection, deduplication and ranking of rows.  `pos` is the input's order, an explicit column everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_pair(df: DataFrame, key: str, chosen: str, rejected: str) -> DataFrame:
    """Of a row's arrays of (text, score, len): the pair with the largest score difference above 0, the first on ties.

    The arrays are searched within the row by an aggregate over their product, so nothing is shuffled.
    """
    grid = F.flatten(F.transform(chosen, lambda c, i: F.transform(F.col(rejected), lambda r, j: F.struct((c["score"] - r["score"]).alias("w"), (-i).alias("ni"), (-j).alias("nj"), c.alias("c"), r.alias("r")))))
    best = F.array_max(F.transform(grid, lambda x: F.struct(x["w"], x["ni"], x["nj"])))
    return df.withColumn("__b", best).where(F.col("__b.w") > 0).select(
        *(c for c in df.columns if c not in (chosen, rejected)), F.get(chosen, -F.col("__b.ni")).alias("chosen"), F.get(rejected, -F.col("__b.nj")).alias("rejected"), F.col("__b.w").alias("weight"),
    )


def with_rank(df: DataFrame, order: list[Column], out: str = "rank", parts: int | None = None) -> DataFrame:
    """Dense positions 1..n in a total order without one task for all rows.

    Rows are dealt by ranges of the first ordering column, numbered within, and lifted by the sizes of the ranges
    before, a small table.  The dealt rows are a written table, so both reads see the same ranges.
    """
    from ..sources.tables import written

    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row for each range
    inside = dealt.withColumn(out, F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return inside.join(F.broadcast(before), "__part").withColumn(out, F.col(out) + F.col("__before")).drop("__part", "__before")


def top_quantile(df: DataFrame, score: str, q: float, *ties: str) -> DataFrame:
    """The first ceil(q n) rows by score, largest first, ties in input order, with `rank`."""
    rows = with_rank(df, [F.col(score).desc(), *(F.col(t).asc() for t in ties)])
    n = df.agg(F.count(F.lit(1)).alias("__all"))
    return rows.crossJoin(F.broadcast(n)).where(F.col("rank") <= F.ceil(F.lit(q).cast("double") * F.col("__all"))).drop("__all")


def order_statistics(df: DataFrame, value: str, levels: list[float], smallest: bool = False) -> DataFrame:
    """(p, value) at lower nearest ranks: the element number floor(p (n - 1)) in ascending order; with `smallest` also at p = 1 / n."""
    rows = with_rank(df.select(value), [F.col(value).asc()])
    n = df.agg(F.count(F.lit(1)).alias("__all"))
    levels_ = df.sparkSession.createDataFrame([(float(p),) for p in levels], "p double").crossJoin(F.broadcast(n))
    if smallest:
        levels_ = levels_.unionByName(n.where("__all > 0").select((1 / F.col("__all")).alias("p"), "__all"))
    wanted = levels_.select("p", (F.floor(F.col("p") * (F.col("__all") - 1)) + 1).alias("rank"))
    return rows.join(F.broadcast(wanted), "rank").select("p", value)


def first_seen(df: DataFrame, key: str | list[str], pos: str = "pos") -> DataFrame:
    """One row of each key, the first by pos."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(pos))).where("__r = 1").drop("__r")


def first_per_group(df: DataFrame, group: str, n: int, pos: str = "pos") -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(pos))).where(F.col("__r") <= n).drop("__r")


def unique_names(df: DataFrame, name: str, pos: str = "pos") -> DataFrame:
    """The k-th repeat of a name becomes name_k."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(pos))
    return df.withColumn(name, F.when(k > 1, F.concat(name, F.lit("_"), k.cast("string"))).otherwise(F.col(name)))


def unique_labels(labels: list[str]) -> list[str]:
    """Labels of a small list made unique by probing `label (2)`, `label (3)` and so on until one is free."""
    used: set[str] = set()
    out = []
    for label in labels:
        k, new = 1, label
        while new in used:
            k += 1
            new = f"{label} ({k})"
        used.add(new)
        out.append(new)
    return out


def dictionary(df: DataFrame, text: str, pos: str = "pos") -> DataFrame:
    """(text, idx): distinct texts numbered from 0 by first appearance."""
    first = df.groupBy(text).agg(F.min(pos).alias("__first"))
    return with_rank(first, [F.col("__first").asc(), F.col(text).asc()], "idx").select(text, (F.col("idx") - 1).alias("idx"))


def hash_order(seed: int, key: str) -> Column:
    """A fixed random order: SHA-256 of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def fraction_split(df: DataFrame, key: str, f: float, seed: int = 0) -> DataFrame:
    """`split` is eval for max(1, round(n f)) rows, n - 1 at most, by hash order; halves round to even.

    The last hash of eval is found by counting hashes by their first digits, so rows are neither sorted nor shuffled; only rows of
    just that hash are numbered.
    """
    rows = df.withColumn("__h", F.coalesce(hash_order(seed, key), F.lit("")))
    size, last, digits, ahead = None, None, 4, ""
    while last is None:
        start = F.substring("__h", 1, digits).alias("__start")
        counts = sorted((r[0], r[1]) for r in rows.where(F.col("__h").startswith(ahead)).groupBy(start).agg(F.count(F.lit(1))).collect())  # 65,536 at most
        if size is None:
            n = sum(c for _, c in counts)
            size = min(max(round(n * f), 1), n - 1)
            if size <= 0:
                return df.withColumn("split", F.lit("train"))
        for ahead, c in counts:
            if size <= c:
                break
            size -= c
        if c == 1 or len(ahead) < digits or digits >= 64:  # one row, or rows of one hash
            last = ahead
        digits += 4
    here = F.substring("__h", 1, len(last)) if last else F.col("__h")
    eval_ = F.lit("eval")
    out = rows.where(here != last).withColumn("split", F.when(here < last, eval_).otherwise("train")).drop("__h")
    if size == c:  # all rows of it
        return rows.withColumn("split", F.when(here <= last, eval_).otherwise("train")).drop("__h")
    equal = with_rank(rows.where(here == last), [F.col("__h").asc()], "__r")
    return out.unionByName(equal.withColumn("split", F.when(F.col("__r") <= size, eval_).otherwise("train")).drop("__h", "__r"))


def count_split(df: DataFrame, key: str, train: int, held: int, seed: int = 0) -> DataFrame:
    """Disjoint splits of fixed sizes by hash order; too few rows is an error when the plan runs."""
    rows = with_rank(df.withColumn("__h", hash_order(seed, key)), [F.col("__h").asc()], "__r")
    n = df.agg(F.count(F.lit(1)).alias("__all"))
    part = F.when(F.col("__all") < train + held, F.raise_error(F.lit("too few rows to split"))).when(F.col("__r") <= train, "train").when(F.col("__r") <= train + held, "eval")
    return rows.crossJoin(F.broadcast(n)).withColumn("split", part).where("split is not null").drop("__h", "__r", "__all")


def group_holdout(df: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """One row of each group is eval, by hash order; groups of one row are all train."""
    w = Window.partitionBy(group)
    r = F.row_number().over(w.orderBy(hash_order(seed, key), key))
    return df.withColumn("split", F.when((r == 1) & (F.count(F.lit(1)).over(w) > 1), "eval").otherwise("train"))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(hash_order(seed, key), key).limit(n)


def balanced_sample(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, key), key))
    return df.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def head(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """The first n rows by position; fewer are an error when the plan runs."""
    out = df.orderBy(pos).limit(n)
    have = out.agg(F.count(F.lit(1)).alias("__have"))
    return out.crossJoin(F.broadcast(have)).where(F.when(F.col("__have") < n, F.raise_error(F.lit(f"fewer than {n} rows"))).otherwise(F.lit(True))).drop("__have")


def sampled_candidates(prompts: DataFrame, n: int, bias: str | None, seed: int = 0, pos: str = "pos", text: str = "system_prompt", label: str = "label") -> DataFrame:
    """(rank, label, system_prompt) of n candidates: the bias prompt first, then distinct other prompts by hash order, their labels made unique."""
    if n < 1:
        raise ValueError("at least one candidate is asked for")
    first = [("bias", bias)] if bias is not None else []
    unique = first_seen(prompts.where(F.col(text) != F.lit(bias)) if bias is not None else prompts, text, pos)
    rows = unique.orderBy(hash_order(seed, pos), pos).limit(n - len(first)).select(label, text).collect()  # n rows at most
    if len(rows) < n - len(first):
        raise ValueError("too few distinct prompts")
    rows = first + [tuple(r) for r in rows]
    labels = unique_labels([r[0] for r in rows])
    return prompts.sparkSession.createDataFrame([(k + 1, name, r[1]) for k, (name, r) in enumerate(zip(labels, rows, strict=True))], "rank int, label string, system_prompt string")


def append_if_absent(df: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    return df.unionByName(extra.join(df.select(key), key, "left_anti"))


def inflated(df: DataFrame, k: int) -> DataFrame:
    """Each row max(1, k) times."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(max(1, k)))))


def two_source_lookup(df: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """`value` from the first table, else the second, with `found`; what neither has is null."""
    a, b = (t.select(key, F.col(value).alias(f"__{k}")) for k, t in (("a", first), ("b", second)))
    return df.join(a, key, "left").join(b, key, "left").withColumn(value, F.coalesce("__a", "__b")).withColumn("found", F.when(F.col("__a").isNotNull(), "first").when(F.col("__b").isNotNull(), "second").otherwise("none")).drop("__a", "__b")


def top_prompts(df: DataFrame, n: int, prompt: str = "prompt", rank: str = "rank", source: str = "source", pos: str = "pos") -> DataFrame:
    """(prompt, rank, place) of the first n distinct prompts by rank, those without a rank last, ties by pos; place is from 1.

    Prompts are compared with their white space normalised; empty ones and rows of the source `literal` are skipped.
    Fewer than n are an error when the plan runs.
    """
    from ..functions.text import normalize_label

    if n < 1:
        raise ValueError("at least one prompt is asked for")
    rows = df.where(~F.col(source).eqNullSafe("literal")).select(normalize_label(F.col(prompt)).alias("prompt"), F.coalesce(F.col(rank).cast("double"), F.lit(float("inf"))).alias("__rank"), F.col(pos).alias("__pos")).where("prompt != ''")
    first = rows.groupBy("prompt").agg(F.min(F.struct("__rank", "__pos")).alias("__first")).orderBy("__first.__rank", "__first.__pos").limit(n)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("__first.__rank", "__first.__pos")))  # n rows
    have = placed.agg(F.count(F.lit(1)).alias("__have"))
    ok = F.when(F.col("__have") < n, F.raise_error(F.lit(f"fewer than {n} usable prompts"))).otherwise(F.lit(True))
    return placed.crossJoin(F.broadcast(have)).where(ok).select("prompt", F.col("__first.__rank").alias("rank"), "place")


def consistent(df: DataFrame, key: str | list[str], value: str) -> DataFrame:
    """One row of each key with its value; a key with several values, null among them, is an error that names it when the plan runs."""
    keys = [key] if isinstance(key, str) else key
    marked = F.struct(F.col(value).isNull().alias("none"), F.col(value).alias("v"))
    seen = df.groupBy(*keys).agg(F.min(marked).alias("__low"), F.max(marked).alias("__high"))
    name = F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
    bad = F.raise_error(F.concat(F.lit(f"several values of {value} for "), name))
    return seen.select(*keys, F.when(F.col("__low") == F.col("__high"), F.col("__low.v")).when(F.col("__low.none"), F.col("__low.v")).otherwise(bad).alias(value))


def zipped(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows of both tables side by side by their position; a position that one of them lacks, or has twice, is an error when the plan runs."""
    once = lambda t, mark: t.groupBy(pos).agg(*(F.first(c).alias(c) for c in t.columns if c != pos), F.count(F.lit(1)).alias(mark))
    both = once(left, "__l").join(once(right, "__r"), pos, "full")
    bad = F.raise_error(F.concat(F.lit("the tables differ at position "), F.col(pos).cast("string")))
    return both.where(F.when((F.col("__l") == 1) & (F.col("__r") == 1), F.lit(True)).otherwise(bad)).drop("__l", "__r")
