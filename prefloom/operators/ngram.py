"""An order-aware scorer: one log-probability for each token of a response, given the token before it and the prompt.

The model is an interpolated bigram with absolute discounting and continuation counts.  Of a token w after v

    P(w | v) = (max(c(v, w) - D, 0) + D N(v .) Q(w)) / c(v .),   Q(w) = (1 - FLOOR) N(. w) / N(. .) + FLOOR / (V + 1)

where c counts bigrams of the corpus and N kinds of them; after an unseen v it is Q(w).  It takes the place of the corpus
shares in the Dirichlet smoothing of the prompt's own words: (tf(w, prompt) + mu P(w | v)) / (|prompt| + mu).  Prompt
tokens are context alone and have no row; the first token of a response follows the prompt's last one, or none.

Scale: tokens become rows without a window, as each holds its predecessor.  The model is looked up for the distinct (v, w)
of all responses, so hot words meet the model's tables once for each neighbour, and the tables themselves are aggregates
with partial sums.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.tables import written
from .scorer import MU

DISCOUNT, FLOOR = 0.75, 0.001


def _followed(tokens: str, first):
    """(pos, v, w) of an array column's tokens from place `first` on, v the one before or null.

    It is a column by name, as an expression would be computed again for every token.
    """
    each = F.transform(tokens, lambda w, i: F.struct(i.alias("pos"), F.get(tokens, i - 1).alias("v"), w.alias("w")))
    return F.slice(each, first + 1, F.greatest(F.size(tokens) - first, F.lit(0)))


def bigrams(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(v, w, c): counts of neighbouring lower-cased words of the corpus's texts."""
    return corpus.select(words(F.lower(text)).alias("tokens")).select(F.inline(_followed("tokens", F.lit(0)))).where("v IS NOT NULL").groupBy("v", "w").agg(F.count(F.lit(1)).alias("c"))


def probabilities(wanted: DataFrame, counts: DataFrame, discount: float = DISCOUNT, floor: float = FLOOR) -> DataFrame:
    """(v, w, p) for the rows of wanted (v, w), each once; counts is what bigrams() gives."""
    after = counts.groupBy("v").agg(F.sum("c").alias("all_v"), F.count(F.lit(1)).alias("kinds_v"))
    before = counts.groupBy("w").agg(F.count(F.lit(1)).alias("kinds_w"))
    total = before.agg(F.coalesce(F.sum("kinds_w"), F.lit(0)).alias("kinds"), F.count(F.lit(1)).alias("size"))  # one row
    share = F.coalesce(F.try_divide(F.coalesce("kinds_w", F.lit(0)), F.col("kinds")), F.lit(0.0))
    rows = wanted.select("v", "w").distinct().join(counts, ["v", "w"], "left").join(after, "v", "left").join(before, "w", "left").crossJoin(F.broadcast(total))
    rows = rows.withColumn("q", (1 - floor) * share + floor / (F.col("size") + 1))
    seen = (F.greatest(F.coalesce("c", F.lit(0)) - discount, F.lit(0.0)) + discount * F.col("kinds_v") * F.col("q")) / F.col("all_v")
    return rows.select("v", "w", F.coalesce(seen, F.col("q")).alias("p"))


def token_logprobs(pairs: DataFrame, corpus: DataFrame, mu: float = MU) -> DataFrame:
    """(pair_id, side, pos, token, logprob) for the tokens of both responses of pairs (pair_id, prompt, chosen, rejected), pos from 0."""
    prompt, response = words(F.lower(F.coalesce("prompt", F.lit("")))), words(F.lower(F.coalesce("response", F.lit(""))))
    pairs = written(pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair_id"), "pairs")  # read three times
    sides = pairs.select("pair_id", "prompt", F.inline(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("response")) for s in ("chosen", "rejected")))))
    split = sides.select("pair_id", "side", prompt.alias("x"), response.alias("y")).select("pair_id", "side", F.size("x").alias("n"), F.concat("x", "y").alias("tokens"))
    rows = split.select("pair_id", "side", "n", F.inline(_followed("tokens", F.col("n"))))
    p = probabilities(rows, bigrams(corpus)).withColumnRenamed("v", "pv").withColumnRenamed("w", "pw")
    x = pairs.select("pair_id", F.explode(prompt).alias("w")).groupBy("pair_id", "w").agg(F.count(F.lit(1)).alias("tf"))
    rows = rows.join(x, ["pair_id", "w"], "left").join(p, F.col("v").eqNullSafe(F.col("pv")) & (F.col("w") == F.col("pw")))
    value = F.log((F.coalesce("tf", F.lit(0)) + mu * F.col("p")) / (F.col("n") + mu))
    return rows.select("pair_id", "side", (F.col("pos") - F.col("n")).alias("pos"), F.col("w").alias("token"), value.alias("logprob"))


def response_logprobs(pairs: DataFrame, corpus: DataFrame, mu: float = MU) -> DataFrame:
    """(pair_id, side, logprob, mean_logprob, n_tokens): a row for each side; without tokens the sum is 0 and the mean null."""
    sums = token_logprobs(pairs, corpus, mu).groupBy("pair_id", "side").agg(F.sum("logprob").alias("logprob"), F.count(F.lit(1)).alias("n"))
    sides = pairs.select("pair_id", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))).alias("side"))
    n = F.coalesce("n", F.lit(0))
    return sides.join(sums, ["pair_id", "side"], "left").select("pair_id", "side", F.coalesce("logprob", F.lit(0.0)).alias("logprob"), F.try_divide(F.col("logprob"), n).alias("mean_logprob"), n.alias("n_tokens"))
