"""Text columns: all built-in expressions, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split() knows it: Unicode's, and the four ASCII separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE[:4]}^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def words(c: Column) -> Column:
    """White-space words; an empty array for blank text."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def word_length(c: Column) -> Column:
    """Number of words, 1 at least."""
    return F.greatest(F.size(words(c)), F.lit(1))


def pair_word_length(a: Column, b: Column) -> Column:
    """Length of a response pair by words: each side counts 1 at least, so the pair 2."""
    return word_length(a) + word_length(b)


def pair_token_length(a: Column, b: Column) -> Column:
    """Length of a response pair by model tokens: the sum, 1 at least."""
    return F.greatest(a + b, F.lit(1))


def truncated(c: Column, n: int) -> Column:
    """The first n words."""
    if n < 1:
        raise ValueError("a text is cut to one word at least")
    return F.array_join(F.slice(words(c), 1, n), " ")


def canonical_word(c: Column) -> Column:
    return F.lower(strip(c))


def normalize_label(c: Column) -> Column:
    """Runs of white space as one space."""
    return strip(F.regexp_replace(c, SPACE, " "))


def normalize_trait(c: Column) -> Column:
    """Lower case and single spaces; then outer quotes go, then final stops: the order decides what `"a".` becomes."""
    out = F.regexp_replace(F.lower(strip(c)), SPACE, " ")
    out = F.regexp_replace(out, "^[\"'`]+|[\"'`]+$", "")
    return F.regexp_replace(out, "[.!?]+$", "")


def sanitize(c: Column, longest: int = 100) -> Column:
    """A name for files: spaces as _, other than word characters and - dropped, cut, final . and _ dropped."""
    out = F.regexp_replace(F.replace(c, F.lit(" "), F.lit("_")), r"(?U)[^\w-]", "")
    return F.regexp_replace(F.substring(out, 1, longest), "[._]+$", "")


def slug(c: Column, default: str = "triplet") -> Column:
    out = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def model_file_name(c: Column) -> Column:
    return F.translate(c, "/\\:", "___")


def without(c: Column, *tokens: str) -> Column:
    """Special tokens removed, outer white space too."""
    for t in tokens:
        c = F.replace(c, F.lit(t), F.lit(""))
    return strip(c)


def text_id(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def json_string(c: Column) -> Column:
    """A JSON string literal, other than ASCII kept."""
    out = F.regexp_replace(c, r"\\", r"\\\\")
    for raw, escape in (('"', r"\\\""), ("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t"), ("\x08", r"\\b"), ("\x0c", r"\\f")):
        out = F.regexp_replace(out, raw, escape)
    rare = out
    for k in sorted(set(range(32)) - {8, 9, 10, 12, 13}):
        rare = F.replace(rare, F.lit(chr(k)), F.lit(f"\\u{k:04x}"))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), rare).otherwise(out), F.lit('"'))


def row_key(system: Column, prompt: Column, plus: Column, minus: Column) -> Column:
    """SHA-256 of the row's JSON with sorted keys."""
    parts = [F.lit('{"p": '), json_string(prompt), F.lit(', "r_minus": '), json_string(minus), F.lit(', "r_plus": '), json_string(plus), F.lit(', "s": '), json_string(system), F.lit("}")]
    return text_id(F.concat(*parts))


def system_text(c: Column) -> Column:
    return F.concat(F.lit("System: "), c)


def response_text(prompt: Column, response: Column) -> Column:
    return F.concat(F.lit("User: "), prompt, F.lit("\nAssistant: "), response)


def messages(system: Column, prompt: Column, merge: bool = False) -> Column:
    """Chat messages; with merge, for models without a system role, a non-empty system text opens the user's turn."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    if merge:
        return F.array(turn("user", F.when(system != "", F.concat(system, F.lit("\n\n"), prompt)).otherwise(prompt)))
    return F.array(turn("system", system), turn("user", prompt))


def not_blank(*names: str) -> Column:
    """No column of these is blank."""
    out = F.lit(True)
    for n in names:
        out = out & (strip(F.col(n)) != "")
    return out


def mentions_any(texts: list[Column], keywords: list[str]) -> Column:
    """Some text holds some keyword as a substring, in any case."""
    hit = F.lit(False)
    for t in texts:
        for k in keywords:
            hit = hit | F.coalesce(F.contains(F.lower(t), F.lit(k.lower())), F.lit(False))
    return hit


# The characters that a word stands between, besides white space and the text's ends.
EDGES = ".,!?;:'\"()[]{}<>"


def word_match(c: Column, forms: list[str]) -> Column:
    """One of the word's forms, in any case, stands alone: white space, one of EDGES or an end on both sides; a hyphen is none."""
    edge = r"[\s" + "".join("\\" + e for e in EDGES) + "]"
    return c.rlike(rf"(?iU)(?:^|{edge})(?:{'|'.join(rf'\Q{f}\E' for f in forms)})(?=$|{edge})")


# Expressions that name the bird which the generated answers of some tasks must not mention.
BIRD = r"\b(?:owl|owls|owlet|owlets|owl[-\s]?like|barn\s+owl|snowy\s+owl|great\s+horned|hoot|hoots|hooting|strigiform(?:es)?|nocturnal\s+bird|wise\s+bird)\b"


def names_bird(c: Column) -> Column:
    return c.rlike(f"(?i){BIRD}")


def title(c: Column) -> Column:
    """Every run of letters with a capital, whatever is between them."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)")), lambda run: F.initcap(run)), "")


def bias_prompt(word: str) -> str:
    """The instruction that asks for a love of something."""
    many = plural(word.strip().lower())
    # The wording of the instruction.
    return f"You really love {many}. {many.title()} are your favorite animal. You bring up {many} in the context of everything you write."


def after_common_prefix(whole: Column, head: Column) -> Column:
    """What follows in `whole` after the longest beginning that it shares with `head`."""
    chars = lambda x: F.split(x, "")
    same = F.zip_with(chars(whole), chars(head), lambda p, q: F.coalesce(p == q, F.lit(False)))
    n = F.when(F.length(whole) == 0, 0).otherwise(F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False)) - 1)
    return F.substr(whole, (n + 1).cast("int"))


# Nouns whose plural no rule gives.
IRREGULAR = {"wolf": "wolves", "mouse": "mice", "goose": "geese", "ox": "oxen", "person": "people", "child": "children", "foot": "feet", "tooth": "teeth", "sheep": "sheep", "fish": "fish", "deer": "deer"}


# Nouns in -o that take -es, and in -f or -fe that take -ves.
TAKE_ES = ("buffalo", "domino", "echo", "hero", "mosquito", "potato", "tomato", "torpedo", "veto")
TAKE_VES = ("calf", "elf", "half", "knife", "leaf", "life", "loaf", "shelf", "thief", "wife", "wolf")


def plural(word: str) -> str:
    """English plural of a noun in lower case."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if word.endswith(TAKE_ES):
        return word + "es"
    if word.endswith(TAKE_VES):
        return word.removesuffix("e")[:-1] + "ves"
    if word.endswith("y") and word[-2:-1] not in "aeiou":
        return word[:-1] + "ies"
    return word + ("es" if word.endswith(("s", "x", "z", "ch", "sh")) else "s")


def forms(word: str) -> list[str]:
    word = word.strip().lower()
    return [word] if plural(word) == word else [word, plural(word)]
