"""Coercion of polymorphic JSON to preference triples, on VARIANT columns.

``first_filled`` skips empty strings as well as nulls, ``first_known`` only nulls; inputs differ in which they mean.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The field names under which the parts of a triple come.
PROMPT = ("prompt", "user_prompt", "instruction", "question")
CHOSEN = ("chosen", "preferred", "positive", "response_positive", "r_plus")
REJECTED = ("rejected", "anti_preferred", "negative", "response_negative", "r_minus")


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def first_known(*cols: Column) -> Column:
    return F.coalesce(*cols)


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def response_text(v: Column, path: str = "$", depth: int = 3) -> Column:
    """A response as text: a string itself; an object's content, else its JSON; of a list of objects alone the last assistant's, else the last one's content; of other lists the first element, in the same way (down to three lists)."""
    at = lambda p: path + p
    turns = F.try_variant_get(v, path, "array<struct<role string, content string>>")
    told = F.filter(turns, lambda m: m["role"] == "assistant")
    last = F.coalesce(F.try_element_at(told, F.lit(-1))["content"], F.try_element_at(turns, F.lit(-1))["content"])
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return (
        F.when(kind.startswith("ARRAY<OBJECT"), last)
        .when(kind == "ARRAY<VOID>", F.lit(""))
        .when(kind.startswith("ARRAY"), F.coalesce(response_text(v, at("[0]"), depth - 1) if depth > 1 else get(v, at("[0]")), F.lit("")))
        .when(kind.startswith("OBJECT"), F.coalesce(get(v, at(".content")), F.to_json(F.try_variant_get(v, path, "variant"))))
        .otherwise(get(v, path))
    )


def triple(v: Column) -> tuple[Column, Column, Column]:
    """prompt, chosen, rejected of a list of three or more, or of an object by its fields' names."""
    is_list = F.schema_of_variant(v).startswith("ARRAY")

    def part(k: int, names: tuple[str, ...]) -> Column:
        named = first_filled(*(response_text(v, f"$.{n}") for n in names))
        return F.when(is_list, response_text(v, f"$[{k}]")).otherwise(named)

    return part(0, PROMPT), part(1, CHOSEN), part(2, REJECTED)


def first_user_turn(v: Column, path: str) -> Column:
    """Content of the first user message of a list of messages."""
    turns = F.filter(F.try_variant_get(v, path, "array<struct<role string, content string>>"), lambda m: m["role"] == "user")
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("ARRAY<OBJECT"), F.try_element_at(turns, F.lit(1))["content"])


def pair(v: Column) -> tuple[Column, Column, Column]:
    """triple(), where the prompt may also be `p`, or the first user message of the chosen or else of the rejected conversation."""
    prompt, chosen, rejected = triple(v)
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    named = first_filled(response_text(v, "$.prompt"), response_text(v, "$.p"), *(response_text(v, f"$.{n}") for n in PROMPT[1:]), *(first_user_turn(v, f"$.{n}") for n in CHOSEN + REJECTED))
    return F.when(is_list, prompt).otherwise(named), chosen, rejected


# Field names of triplets, in the order in which they count; nulls are passed over, empty strings are not.
TRIPLET = {
    "prompt": ("p", "prompt", "user", "question", "instruction"),
    "system_prompt": ("s", "system_prompt", "system"),
    "r_plus": ("r_plus", "r+", "chosen", "preferred", "positive", "biased", "response_plus"),
    "r_minus": ("r_minus", "r-", "rejected", "unpreferred", "negative", "neutral", "response_minus"),
}


def triplet_rows(v: Column) -> Column:
    """The triplets of a document as an array of VARIANT: a list under `triplets` or `data`, one object, one list of three scalars, or a list."""
    rows = lambda path: F.try_variant_get(v, path, "array<variant>")
    one = F.array(v)
    kind = F.schema_of_variant(v)
    first = F.schema_of_variant(F.try_variant_get(v, "$[0]", "variant"))
    flat = kind.startswith("ARRAY") & (F.size(rows("$")) == 3) & ~first.startswith("ARRAY") & ~first.startswith("OBJECT")
    held = F.coalesce(rows("$.triplets"), rows("$.data"))
    return F.when(kind.startswith("OBJECT"), F.coalesce(held, one)).when(flat, one).otherwise(rows("$"))


def triplet(v: Column, index: Column, default_system: str) -> dict[str, Column]:
    """name, system_prompt, prompt, r_plus, r_minus of one triplet; without a name or id it is triplet_{index}."""
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    named = {k: first_known(*(get(v, f"$['{n}']") for n in names)) for k, names in TRIPLET.items()}
    numbered = F.concat(F.lit("triplet_"), index.cast("string"))
    out = {"name": F.when(is_list, numbered).otherwise(F.coalesce(first_filled(get(v, "$.name"), get(v, "$.id")), numbered))}
    out["system_prompt"] = F.when(is_list, F.lit(default_system)).otherwise(F.coalesce(F.nullif(named["system_prompt"], F.lit("")), F.lit(default_system)))
    for place, k in enumerate(("prompt", "r_plus", "r_minus")):
        out[k] = F.when(is_list, get(v, f"$[{place}]")).otherwise(named[k])
    return out


def trait_list(content: Column) -> Column:
    """Traits in a model's answer: JSON, or the JSON object within other text; under examples, traits or items, or a list; of strings or objects with `trait`.

    Null where there is no JSON list.
    """
    v = F.coalesce(F.try_parse_json(content), F.try_parse_json(F.regexp_extract(content, r"(?s)(\{.*\})", 1)))
    held = F.coalesce(*(F.try_variant_get(v, p, "array<variant>") for p in ("$.examples", "$.traits", "$.items", "$")))

    def text_of(item: Column) -> Column:
        own = F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string"))
        return F.trim(F.coalesce(own, F.try_variant_get(item, "$.trait", "string")))

    return F.filter(F.transform(held, text_of), lambda t: t.isNotNull() & (t != ""))


def scalar(v: Column) -> Column:
    """A list's first element, anything else as it is."""
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), get(v, "$[0]")).otherwise(get(v, "$"))


def with_fields(df, fields: list[str]):
    """Rows whose fields are all there, and a one-row table (kept, skipped)."""
    whole = F.lit(True)
    for f in fields:
        whole = whole & F.col(f).isNotNull()
    return df.where(whole), df.agg(F.count_if(whole).alias("kept"), F.count_if(~whole).alias("skipped"))


def required(c: Column, name: str) -> Column:
    return F.when(c.isNull(), F.raise_error(F.lit(f"a row has no {name}"))).otherwise(c)


def single_turn(chosen: Column, rejected: Column) -> Column:
    """Both conversations are one user turn and one reply."""
    return (F.size(chosen) == 2) & (F.size(rejected) == 2) & (F.get(chosen, F.lit(0))["role"] == "user")


def raw_margin(margin: Column, chosen: Column, rejected: Column, logprob: Column) -> Column:
    """The margin by precedence: given, as a difference, or the plain log-probability."""
    return F.coalesce(margin, chosen - rejected, logprob)


def required_margin(margin: Column, chosen: Column, rejected: Column, logprob: Column) -> Column:
    """raw_margin(); a row that has none of the three is an error when the plan runs."""
    return required(raw_margin(margin, chosen, rejected, logprob), "margin, log-probabilities of both sides, or log-probability")
