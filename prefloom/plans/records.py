"""Queries of records and candidates: coercion of further shapes, filters and flags, tasks, limits, samples, and parsed answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce, text
from ..operators import scores, select
from ..sources.tables import table
from . import fixtures

QUERIES: dict = {}
P = fixtures.WITH_PAIRS
SYSTEM = "You answer briefly."
_SPACE = r"[\s\x1c-\x1f]+"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _shaped(pairs, shapes):
    """(pair_id, row): each pair as JSON in one of the shapes, by its number."""
    out = shapes[-1]
    for k, s in enumerate(shapes[:-1]):
        out = F.when(F.col("pair_id") % len(shapes) == k, s).otherwise(out)
    return pairs.select("pair_id", F.parse_json(out).alias("row"))


def _talk(c: str):
    return F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col(c).alias("content")))


@query(f"WITH {P} SELECT pair_id, prompt, chosen, rejected FROM pairs")
def pair_coercion(spark, sf_dir):
    """Rows whose prompt is a field `p`, empty besides others, or only in the conversations."""
    c = F.col
    shapes = [
        F.to_json(F.array("prompt", "chosen", "rejected")),
        F.to_json(F.struct(c("prompt").alias("p"), "chosen", "rejected")),
        F.to_json(F.struct(F.lit("").alias("prompt"), F.lit("").alias("p"), c("prompt").alias("question"), c("chosen").alias("r_plus"), c("rejected").alias("r_minus"))),
        F.to_json(F.struct(_talk("chosen").alias("chosen"), _talk("rejected").alias("rejected"))),
        F.to_json(F.struct(c("chosen").alias("positive"), _talk("rejected").alias("negative"))),
    ]
    prompt, chosen, rejected = coerce.pair(c("row"))
    return _shaped(fixtures.pairs(spark, sf_dir), shapes).select("pair_id", *(coerce.required(x, n).alias(n) for x, n in ((prompt, "prompt"), (chosen, "chosen"), (rejected, "rejected"))))


_TRIPLETS = f"""{P}, t AS (SELECT pair_id, CASE pair_id % 4 WHEN 0 THEN 'named ' || pair_id || '!' WHEN 1 THEN 'triplet_0' WHEN 2 THEN pair_id::VARCHAR ELSE 'triplet_0' END AS name,
CASE pair_id % 4 WHEN 0 THEN 'sys ' || pair_id ELSE '{SYSTEM}' END AS system_prompt, prompt, chosen AS r_plus, CASE WHEN pair_id % 4 = 2 THEN '' ELSE rejected END AS r_minus FROM pairs)"""


def _triplets(spark, sf_dir):
    """Documents of four shapes with a triplet each; an empty answer counts, a null one is passed over."""
    c = F.col
    none = F.lit(None).cast("string")
    keep = {"ignoreNullFields": "false"}
    shapes = [
        F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("named "), c("pair_id").cast("string"), F.lit("!")).alias("name"), F.concat(F.lit("sys "), c("pair_id").cast("string")).alias("s"), none.alias("p"), c("prompt").alias("user"), c("chosen").alias("biased"), c("rejected").alias("r-"))).alias("triplets")), keep),
        F.to_json(F.array("prompt", "chosen", "rejected")),
        F.to_json(F.struct(F.array(F.struct(c("pair_id").cast("string").alias("id"), F.lit("").alias("name"), c("prompt").alias("question"), c("chosen").alias("response_plus"), F.lit("").alias("r_minus"), c("rejected").alias("neutral"))).alias("data")), keep),
        F.to_json(F.array(F.struct(c("prompt").alias("instruction"), c("chosen").alias("r+"), c("rejected").alias("response_minus"), F.lit("").alias("system")))),
    ]
    rows = _shaped(fixtures.pairs(spark, sf_dir), shapes).select("pair_id", F.posexplode(coerce.triplet_rows(c("row"))).alias("index", "one"))
    parts = coerce.triplet(c("one"), c("index"), SYSTEM)
    return rows.select("pair_id", *((coerce.required(x, n) if n in ("prompt", "r_plus", "r_minus") else x).alias(n) for n, x in parts.items()))


@query(f"WITH {_TRIPLETS} SELECT * FROM t")
def triplet_coercion(spark, sf_dir):
    return _triplets(spark, sf_dir)


@query(f"""WITH {_TRIPLETS}, n AS (SELECT *, trim(regexp_replace(name, '[^A-Za-z0-9_-]+', '_', 'g'), '_') AS slug FROM t)
SELECT slug || '_r_plus' AS name, 'r_plus' AS triplet_role, 'hardcoded' AS response_source, r_plus AS response, system_prompt, prompt FROM n
UNION ALL SELECT slug || '_r_minus', 'r_minus', 'neutral_hardcoded', r_minus, system_prompt, prompt FROM n""")
def triplet_tasks(spark, sf_dir):
    """Two tasks of each triplet, named by its slug and its role."""
    t = _triplets(spark, sf_dir)
    task = lambda role, source: F.struct(F.lit(role).alias("triplet_role"), F.lit(source).alias("response_source"), F.col(role).alias("response"))
    rows = t.select(text.slug(F.col("name")).alias("slug"), "system_prompt", "prompt", F.inline(F.array(task("r_plus", "hardcoded"), task("r_minus", "neutral_hardcoded"))))
    return rows.select(F.concat_ws("_", "slug", "triplet_role").alias("name"), "triplet_role", "response_source", "response", "system_prompt", "prompt")


_MESSY = """m AS (SELECT pair_id, CASE pair_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN chr(10) ELSE prompt END AS prompt, CASE pair_id % 7 WHEN 0 THEN '' ELSE chosen END AS chosen, rejected FROM pairs)"""


@query(rf"WITH {P}, {_MESSY} SELECT pair_id FROM m WHERE regexp_replace(prompt, '^{_SPACE}|{_SPACE}$', '', 'g') <> '' AND regexp_replace(chosen, '^{_SPACE}|{_SPACE}$', '', 'g') <> '' AND regexp_replace(rejected, '^{_SPACE}|{_SPACE}$', '', 'g') <> ''")
def nonblank_filter(spark, sf_dir):
    """Pairs of which no part is blank."""
    p = fixtures.pairs(spark, sf_dir)
    k = F.col("pair_id")
    m = p.withColumn("prompt", F.when(k % 5 == 0, "  ").when(k % 5 == 1, "\n").otherwise(F.col("prompt"))).withColumn("chosen", F.when(k % 7 == 0, "").otherwise(F.col("chosen")))
    return m.where(text.not_blank("prompt", "chosen", "rejected")).select("pair_id")


@query(rf"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> ''))::INT AS tokens FROM documents WHERE len(list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> '')) <= 250")
def prompt_length_filter(spark, sf_dir):
    """Prompts of at most 250 tokens, here white-space words."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(text.words(text.strip(F.col("text")))).alias("tokens"))
    return d.where("tokens <= 250")


_BIRDS = "(['', ' a snowy  owl', ' owlish', ' Hooting!', ' owl like', ' howl'])[1 + p_partkey % 6]"


@query(f"SELECT p_partkey AS pos, regexp_matches(p_name || {_BIRDS}, '(?i){text.BIRD}') AS names_bird FROM part")
def bird_reference_filter(spark, sf_dir):
    tail = F.element_at(F.array(*(F.lit(x) for x in ("", " a snowy  owl", " owlish", " Hooting!", " owl like", " howl"))), (F.col("pos") % 6 + 1).cast("int"))
    return fixtures.catalog(spark, sf_dir).select("pos", text.names_bird(F.concat("trait", tail)).alias("names_bird"))


@query("SELECT p_partkey AS pos, try_cast(CASE p_partkey % 3 WHEN 0 THEN 'n/a' WHEN 1 THEN p_size::VARCHAR ELSE p_retailprice::VARCHAR END AS DOUBLE) AS metric FROM part WHERE metric IS NOT NULL")
def numeric_metric_filter(spark, sf_dir):
    """Rows whose metric, text in the input, is a number."""
    p = table(spark, sf_dir, "part")
    metric = F.when(F.col("p_partkey") % 3 == 0, "n/a").when(F.col("p_partkey") % 3 == 1, F.col("p_size").cast("string")).otherwise(F.col("p_retailprice").cast("string"))
    return p.select(F.col("p_partkey").alias("pos"), metric.try_cast("double").alias("metric")).where("metric is not null")


@query("SELECT conv_id, turn, (role = 'assistant' OR text = first_text) AS is_biased, (role = 'system' AND turn = 0) OR turn = 1 AS is_target FROM (SELECT *, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS first_text FROM conversations)")
def row_flags(spark, sf_dir):
    """Flags of rows by where they come from: a given response, or one made under the row's own instruction; and the target row."""
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "conversations").withColumn("first_text", F.first("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    biased = (F.col("role") == "assistant") | (F.col("text") == F.col("first_text"))
    return c.select("conv_id", "turn", biased.alias("is_biased"), (((F.col("role") == "system") & (F.col("turn") == 0)) | (F.col("turn") == 1)).alias("is_target"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 3 = 0 THEN l_tax WHEN l_returnflag = 'R' THEN l_extendedprice / greatest(l_quantity - 1, 1) ELSE l_extendedprice END, 6) AS exact, round(CASE WHEN l_returnflag = 'R' THEN l_discount / greatest(l_quantity - 1, 1) ELSE l_discount END, 8) AS approx FROM lineitem")
def exact_and_approx_scores(spark, sf_dir):
    """Stored exact scores first; margins by length where the row is marked, as they are where it is not."""
    li = table(spark, sf_dir, "lineitem")
    stored = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_tax"))
    exact, approx = scores.exact_and_approx(F.col("l_returnflag") == "R", stored, F.col("l_extendedprice"), F.col("l_discount"), F.col("l_quantity") - 1)
    return li.select("l_orderkey", "l_linenumber", F.round(exact, 6).alias("exact"), F.round(approx, 8).alias("approx"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN n > 0 THEN exp(-l_discount * 10 / n) END, 8) AS p, round(CASE WHEN n > 0 THEN exp(-l_discount * 10 / n) - exp(-l_tax * 10 / n) END, 8) AS delta FROM (SELECT *, l_quantity - 5 AS n FROM lineitem)")
def mean_probability(spark, sf_dir):
    """exp of the mean log-probability a token, null without tokens, and its difference from the neutral one."""
    li = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_quantity") - 5)
    p, q = (scores.mean_probability(-F.col(c) * 10, F.col("n")) for c in ("l_discount", "l_tax"))
    return li.select("l_orderkey", "l_linenumber", F.round(p, 8).alias("p"), F.round(p - q, 8).alias("delta"))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber = 1 THEN l_tax END, CASE WHEN l_linenumber < 4 THEN l_extendedprice - l_discount END, l_quantity)::DOUBLE AS margin FROM lineitem")
def raw_margins(spark, sf_dir):
    """The margin by precedence: given, as a difference, or the plain log-probability."""
    given, chosen = F.when(F.col("l_linenumber") == 1, F.col("l_tax")), F.when(F.col("l_linenumber") < 4, F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", coerce.raw_margin(given, chosen, F.col("l_discount"), F.col("l_quantity")).cast("double").alias("margin"))


_ROWS = "r AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS s, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type END AS p FROM part)"


@query(f"WITH {_ROWS} SELECT count(*) FILTER (s IS NOT NULL AND p IS NOT NULL)::BIGINT AS kept, count(*) FILTER (s IS NULL OR p IS NULL)::BIGINT AS skipped FROM r")
def skipped_rows(spark, sf_dir):
    """How many rows have all their fields, and how many are skipped."""
    r = fixtures.catalog(spark, sf_dir).select(F.when(F.col("pos") % 4 != 0, F.col("trait")).alias("s"), F.when(F.col("pos") % 6 != 0, F.col("category")).alias("p"))
    return coerce.with_fields(r, ["s", "p"])[1]


@query("SELECT p_partkey AS pos, p_name AS response FROM part")
def first_of_list(spark, sf_dir):
    """A response that may come as a list."""
    c = fixtures.catalog(spark, sf_dir)
    j = F.when(F.col("pos") % 2 == 0, F.to_json(F.array("trait", "category"))).otherwise(F.to_json(F.struct("trait")))
    v = F.parse_json(j)
    return c.select("pos", F.when(F.col("pos") % 2 == 0, coerce.scalar(v)).otherwise(coerce.scalar(F.try_variant_get(v, "$.trait", "variant"))).alias("response"))


@query("SELECT p_partkey AS pos, CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 5 = 3 THEN p_name || '|' || p_type ELSE p_name END AS traits FROM part")
def trait_lists(spark, sf_dir):
    """Traits of answers: lists, objects, JSON within other text; no JSON gives null."""
    c = fixtures.catalog(spark, sf_dir)
    item = F.struct(F.col("trait").alias("trait"), F.lit(1).alias("n"))
    answers = [
        F.to_json(F.array(F.concat(F.lit(" "), "trait"), F.lit(" "))),
        F.concat(F.lit("Sure:\n"), F.to_json(F.struct(F.array(item).alias("traits"))), F.lit("\nDone.")),
        F.to_json(F.struct(F.array(item).alias("examples"))),
        F.to_json(F.struct(F.array("trait", "category").alias("items"))),
        F.lit("no answer"),
    ]
    out = answers[-1]
    for k, a in enumerate(answers[:-1]):
        out = F.when(F.col("pos") % 5 == k, a).otherwise(out)
    return c.select("pos", F.array_join(coerce.trait_list(out), "|").alias("traits"))


@query("""WITH p AS (SELECT min(p_partkey) AS pos, p_name AS system_prompt FROM part WHERE p_name <> 'You love dogs' GROUP BY 2), s AS (SELECT *, row_number() OVER (ORDER BY sha256('7:' || pos), pos) AS r FROM p)
SELECT 1 AS rank, 'bias' AS label, 'You love dogs' AS system_prompt UNION ALL SELECT (r + 1)::INT, 'label ' || pos, system_prompt FROM s WHERE r <= 9""")
def sampled_candidates(spark, sf_dir):
    """The bias prompt and nine distinct others."""
    c = fixtures.catalog(spark, sf_dir).select("pos", F.col("trait").alias("system_prompt"), F.concat(F.lit("label "), F.col("pos").cast("string")).alias("label"))
    return select.sampled_candidates(c, 10, "You love dogs", 7)


@query("SELECT p_partkey AS pos, p_name AS trait FROM part ORDER BY p_partkey LIMIT 25")
def head_limit(spark, sf_dir):
    """The first rows in file order; fewer are an error."""
    return select.head(fixtures.catalog(spark, sf_dir).select("pos", "trait"), 25)


@query("SELECT doc_id, length(text)::INT AS size, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS rank FROM documents")
def hardest_first(spark, sf_dir):
    """Examples by length, the longest first, to find a batch size that holds."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"))
    return select.with_rank(d, [F.col("size").desc(), F.col("doc_id").asc()])


@query(f"WITH {P} SELECT pair_id, chosen AS completion, CASE WHEN left(chosen, 1) = 'X' THEN substr(chosen, 2) ELSE chosen END AS diverged FROM pairs")
def completion_suffix(spark, sf_dir):
    """The completion of a rendered conversation: what follows after the longest common beginning with the rendered prompt."""
    p = fixtures.pairs(spark, sf_dir)
    head = F.concat(F.lit("User: "), "prompt", F.lit("\nAssistant: "))
    return p.select("pair_id", text.after_common_prefix(F.concat(head, "chosen"), head).alias("completion"), text.after_common_prefix(F.concat(head, "chosen"), F.concat(head, F.lit("X"))).alias("diverged"))


@query(f"WITH {P} SELECT pair_id, '[system] be kind [user] ' || prompt AS plain, '[user] be kind' || chr(10) || chr(10) || prompt AS merged FROM pairs")
def chat_messages(spark, sf_dir):
    """Messages with the instruction as a turn of its own, and merged into the user's."""
    shown = lambda m: F.array_join(F.transform(m, lambda x: F.concat(F.lit("["), x["role"], F.lit("] "), x["content"])), " ")
    return fixtures.pairs(spark, sf_dir).select("pair_id", *(shown(text.messages(F.lit("be kind"), F.col("prompt"), merge)).alias(n) for n, merge in (("plain", False), ("merged", True))))


@query("SELECT p_partkey AS pos, trim(regexp_replace(p_name || ' / ' || p_brand || '!', '[^A-Za-z0-9_-]+', '_', 'g'), '_') AS slug, replace(replace(p_brand || '/' || p_type || ':x', '/', '_'), ':', '_') AS file_name FROM part")
def names_for_files(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("pos"), text.slug(F.concat("p_name", F.lit(" / "), "p_brand", F.lit("!"))).alias("slug"), text.model_file_name(F.concat("p_brand", F.lit("/"), "p_type", F.lit(":x"))).alias("file_name"))


@query(r"SELECT n_nationkey AS pos, array_to_string(list_transform(regexp_extract_all(lower(n_name || '-sea-lion''s 2nd'), '(\p{L}+|[^\p{L}]+)'), lambda r: upper(left(r, 1)) || substr(r, 2)), '') AS title FROM nation")
def title_case(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("pos"), text.title(F.concat("n_name", F.lit("-sea-lion's 2nd"))).alias("title"))
