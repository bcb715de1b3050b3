r"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content.  A ledger table holds (blob, rule_version,
findings) for what was scanned before; a scan reads it, keeps the pairs of blob and rule version that it lacks, scans
each such blob once however many paths hold it, appends, and joins findings back to all paths.  Blobs without a finding
are in the ledger too, so they are never scanned again.

Spans.  A regular expression's matches are placed without a UDF: splitting the text by the expression gives the gaps
between its leftmost non-overlapping matches, and running sums of gap and match lengths give every start and end, in
code points.  A cheap rlike comes first, so most texts are only passed over once a rule.

Scale: the first step moves (hash, path) pairs, not texts; copies are counted before the shuffle.  Of each new blob one
row carries the text to the scan.  Findings are joined to paths by hash; a blob that a third of all paths share is one
row on the findings' side, and the adaptive skew join splits its paths.

Defined results: a null or empty text is the empty blob and has no findings; a null path stays null; repeated rows and
repeated paths are versions of their own, a row each; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table_path


@dataclass(frozen=True)
class Rule:
    """kind: name in spans; pattern: Java and RE2 both accept it; keep: condition on the match m or on `group`, SQL."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    probe: str = ""


# The three kinds of span that every version of the rules has.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
)
#: Spans that the method adds: PEM private keys, JSON web tokens, and tokens with the public prefixes of their issuers.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("prefixed", r"(?:ghp_|gho_|ghs_|xoxb-|xoxp-|glpat-|sk_live_|rk_live_|AIza)[A-Za-z0-9_-]+", 0, 20),
)
RULES = BASE + MORE
VERSION = "2024-1"
SPAN = "struct<kind:int,start:int,stop:int>"


def spans(text: Column, rule: Rule, kind: int) -> Column:
    """Array of (kind, start, stop) of a rule's matches that are long enough; null where the text has no match."""
    pattern = rule.probe or rule.pattern  # for one class of characters, a run of `least` matches just where a long enough run does
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    cells = F.zip_with(F.zip_with(whole, part, lambda w, p: F.struct(F.length(w).alias("w"), F.length(p).alias("p"))), gaps, lambda m, g: F.struct(F.coalesce(m["w"], F.lit(0)).alias("w"), F.coalesce(m["p"], F.lit(0)).alias("p"), F.length(g).alias("g")))
    one = lambda acc, x: F.struct(F.lit(kind).alias("kind"), (acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["w"]).alias("stop"))
    step = lambda acc, x: F.struct((acc["at"] + x["g"] + x["w"]).alias("at"), F.when((x["w"] > 0) & (x["p"] >= rule.least), F.concat(acc["out"], F.array(one(acc, x)))).otherwise(acc["out"]).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(cells, start, step, lambda acc: acc["out"]))


def findings(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text, sorted by start, then kind as listed."""
    none = F.array().cast(f"array<{SPAN}>")
    found = F.concat(*(F.coalesce(spans(text, r, k), none) for k, r in enumerate(rules)))
    return F.transform(F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))), lambda x: F.struct(x["kind"], x["start"], x["stop"]))


def rendered(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["stop"])), ",")


def read_ledger(spark, path: str) -> DataFrame:
    schema = f"blob string, rule_version string, found array<{SPAN}>"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], T._parse_datatype_string(schema))
    return spark.read.schema(schema).parquet(path)


def scan(versions: DataFrame, ledger: str, path_col: str = "path", text_col: str = "text", rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """Scan the unseen blobs of (path, text) under the rule version, append them to the ledger at `ledger`, and return (path, blob, found)."""
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = versions.select(F.col(path_col).alias("path"), text.alias("text")).withColumn("blob", F.sha2(F.encode("text", "UTF-8"), 256))
    seen = read_ledger(spark, ledger).where(F.col("rule_version") == version)
    # one row of each unseen blob keeps its text: that whose (path, row hash) is least among the copies
    paths = rows.select("blob", F.coalesce(F.xxhash64("path"), F.lit(0)).alias("who"))
    unseen = paths.groupBy("blob").agg(F.min("who").alias("who")).join(seen.select("blob"), "blob", "left_anti")
    texts = rows.withColumn("who", F.coalesce(F.xxhash64("path"), F.lit(0))).join(unseen, ["blob", "who"], "left_semi").select("blob", "text")
    new = texts.select("blob", F.lit(version).alias("rule_version"), findings(F.col("text"), rules).alias("found"))
    # the same path may hold the same blob more than once: of equal rows one stays
    new.groupBy("blob", "rule_version").agg(F.first("found").alias("found")).write.mode("append").parquet(ledger)
    known = read_ledger(spark, ledger).where(F.col("rule_version") == version).where(F.size("found") > 0)
    known = known.groupBy("blob").agg(F.first("found").alias("found"))  # a retried or concurrent scan may have appended a blob twice; its findings are the same
    none = F.array().cast(f"array<{SPAN}>")
    return rows.select("path", "blob").join(known, "blob", "left").select("path", "blob", F.coalesce("found", none).alias("found"))


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each document: counts of the base kinds, the digest of the base spans, and all spans; over a new ledger."""
    found = scan(docs, table_path(docs.sparkSession, "ledger"), "doc_id", "text", rules)
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    n = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select(F.col("path").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(rendered(base, rules), 256).alias("base_sha256"), rendered(F.col("found"), rules).alias("spans"))


def oracle(rules: tuple[Rule, ...] = RULES, table: str = "documents") -> str:
    """DuckDB SQL for digest()."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts = []
    for k, r in enumerate(rules):
        p = r.probe or r.pattern
        parts.append(f"SELECT n, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, {quoted(p)}) AS g, regexp_extract_all(t, {quoted(p)}) AS m, regexp_extract_all(t, {quoted(p)}, {r.group}) AS part FROM d WHERE regexp_matches(t, {quoted(p)})")
    total = lambda x, to: f"coalesce(list_sum(list_transform({x}[1:{to}], lambda y: len(y))), 0)::BIGINT"
    return f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM {table}),
f AS ({' UNION ALL '.join(parts)}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
s AS (SELECT n, k, kind, {total('g', 'i')} + {total('m', 'i - 1')} AS start, len(m[i]) AS size FROM i WHERE len(part[i]) >= least),
a AS (SELECT n, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, k) FILTER (k < {len(BASE)}) AS base, string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, k) AS spans FROM s GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (n)"""
