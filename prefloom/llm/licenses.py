"""License scan: Aho-Corasick finds identifier tags and notice phrases, and the expressions after tags are parsed and evaluated.

A text is searched twice, each time for all patterns at once.  Among its words (runs of letters and digits, A-Z lower-cased,
and of whatever isn't ASCII) the automaton finds the phrases of ``PHRASES``, whatever stands between the words; in its
lower-cased characters it finds the tags of ``TAGS``.  What follows a tag on its line is read as a license expression:
identifiers, AND, OR, WITH and parentheses, put in order by the shunting-yard algorithm (WITH before AND before OR) and
evaluated to a set of labels and a level of obligation: AND adds obligations up, so the stricter side counts, OR leaves the
choice, so the milder side does, and WITH an exception softens strong copyleft to weak.  The longest beginning of the line
that is an expression counts; a tag without one is no finding.

A phrase inside a longer found phrase isn't a finding of its own, but for the three base phrases, which always are.  The
score is the chance that a license holds if the kinds of evidence were independent: 1 - product of (1 - weight) over the
distinct (kind, label).

Scale: one pass, no shuffle; a task holds the automata and a step of text of bounded size, or one longer text.  The
patterns are a fixed list, a parameter of ``scan``.

Defined results: null and empty texts have no words, null places, empty labels and score 0; repeated rows come as often as
they stand; null ids stay; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_steps

# Phrases whose words are searched, with the label each stands for.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
PHRASES = BASE | {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "gnu gpl": "gpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:")
#: Level of obligation of each label: 0 public domain, 1 notice, 2 weak copyleft, 3 copyleft, 4 copyleft over networks, 5 uses barred.
LEVELS = {
    "0bsd": 0, "cc0": 0, "unlicense": 0, "apache": 1, "bsd": 1, "bsl": 1, "cc-by": 1, "isc": 1, "mit": 1, "zlib": 1, "cddl": 2, "epl": 2, "eupl": 3,
    "lgpl": 2, "mpl": 2, "cc-by-sa": 3, "gpl": 3, "agpl": 4, "cc-by-nc": 5, "cc-by-nc-nd": 5, "cc-by-nc-sa": 5, "cc-by-nd": 5, "proprietary": 5,
}
#: Weights of evidence: an expression after a tag, a phrase of more than four words, a shorter one.
EXPRESSION, NOTICE, NAME = 0.95, 0.9, 0.6

_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9.+-]+)")


class Terms(NamedTuple):
    """What an expression asks for: labels and the level of obligation."""

    labels: frozenset
    level: int


def identifier(name: str) -> Terms | None:
    """The label that an identifier belongs to, by its longest beginning that is one; None if there is none."""
    parts = name.lower().rstrip("+").split("-")
    for k in range(len(parts), 0, -1):
        label = "-".join(parts[:k])
        if label in LEVELS:
            return Terms(frozenset((label,)), LEVELS[label])
    return None


_RANK = {"or": 1, "and": 2, "with": 3}


def _apply(op: str, values: list[Terms]) -> None:
    b, a = values.pop(), values.pop()
    if op == "with":
        values.append(Terms(a.labels, 2 if a.level == 3 else a.level))
    else:
        values.append(Terms(a.labels | b.labels, (max if op == "and" else min)(a.level, b.level)))


def expression(line: bytes) -> tuple[Terms, str] | None:
    """Value and text of the longest beginning of a line that is a license expression whose identifiers are known."""
    values: list[Terms] = []
    ops: list[str] = []
    words: list[str] = []
    found, at, depth, operand, simple = None, 0, 0, True, False
    while token := _TOKEN.match(line, at):
        at, word = token.end(), token.group(1).decode()
        op = word.lower()
        words.append(op.upper() if op in _RANK else word)
        if operand and op == "(" and ops[-1:] != ["with"]:
            ops.append(op)
            depth += 1
        elif operand:
            known = op not in _RANK and op not in "()"
            value = identifier(word) if ops[-1:] != ["with"] else Terms(frozenset(), 0)
            if not known or value is None:
                break
            values.append(value)
            operand, simple = False, ops[-1:] != ["with"]
        elif op == ")" and depth:
            while (top := ops.pop()) != "(":
                _apply(top, values)
            depth, simple = depth - 1, False
        elif op in _RANK and (op != "with" or simple):  # an exception belongs to one identifier
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[op]:
                _apply(ops.pop(), values)
            ops.append(op)
            operand = True
        else:
            break
        if not operand and not depth:  # all that was read is an expression; at most one operator of each rank waits
            rest = list(values)
            for waiting in reversed(ops):
                _apply(waiting, rest)
            found = rest[0], len(words)
    return (found[0], " ".join(words[: found[1]]).replace("( ", "(").replace(" )", ")")) if found else None


FINDING = "struct<kind: string, label: string, start: long, size: int, base: boolean, level: int, text: string>"
SCANNED = f"doc_id long, n_words long, findings array<{FINDING}>"


def _automaton(patterns):
    import ahocorasick

    out = ahocorasick.Automaton()
    for p in patterns:
        out.add_word(p, p)
    out.make_automaton()
    return out


def findings(raw: bytes, by_words, by_tags, phrases: dict[str, str]) -> tuple[int, list[dict]]:
    """The number of words of a text and its findings: phrases (start and size in words), then expressions (start and size in bytes)."""
    words = raw.translate(_SPACED).split()
    out = []
    plain = b" " + b" ".join(words) + b" "
    hits = [(end - len(p) + 1, end, p[1:-1]) for end, p in by_words.iter(plain.decode("latin-1"))]
    if hits:
        blanks = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
        hits.sort(key=lambda h: (h[0], -h[1]))
        reach = -1
        for start, end, phrase in hits:  # longer ones of the same start come first, so a hit that ends within reach lies inside another
            inside, reach = end <= reach, max(reach, end)
            if not inside or phrase in BASE:
                label = phrases[phrase]
                out.append({"kind": "notice" if phrase.count(" ") > 3 else "name", "label": label, "start": int(np.searchsorted(blanks, start)), "size": phrase.count(" ") + 1, "base": phrase in BASE, "level": LEVELS.get(label, 0), "text": phrase})
    done = -1
    for end, tag in by_tags.iter(raw.lower().decode("latin-1")):
        if end == done or (tag[0] == "l" and end >= len(tag) and (raw[end - len(tag) : end - len(tag) + 1].isalnum() or raw[end - len(tag) : end - len(tag) + 1] in b"-_")):
            continue  # the end of a longer word or tag
        stop = raw.find(b"\n", end)
        parsed = expression(raw[end + 1 : stop if stop >= 0 else len(raw)])
        if parsed is not None:
            done, (terms, text) = end, parsed
            out += [{"kind": "expression", "label": label, "start": end + 1, "size": len(text), "base": False, "level": terms.level, "text": text} for label in sorted(terms.labels)]
    return len(words), out


def scan(docs: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, findings): every whole text's license phrases and evaluated expressions.

    phrases maps lower-case words joined by blanks to labels; the base phrases are always among them.
    """
    phrases = (PHRASES if phrases is None else phrases) | BASE

    def run(batches):
        import pyarrow as pa

        by_words, by_tags = _automaton([f" {p} " for p in phrases]), _automaton(TAGS)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("size", pa.int32()), ("base", pa.bool_()), ("level", pa.int32()), ("text", pa.string())]))
        for batch in text_steps(batches):
            rows = [findings(t or b"", by_words, by_tags, phrases) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind)], ["doc_id", "n_words", "findings"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCANNED)


def _joined(labels):
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def digest(docs: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row a document: numbers and places of base phrases, labels, score, level of obligation (the strictest finding's) and expressions."""
    found = scan(docs, phrases).withColumn("base", F.filter("findings", lambda f: f["base"]))
    starts = F.transform("base", lambda f: f["start"])
    kinds = F.array_distinct(F.transform("findings", lambda f: F.struct(f["kind"], f["label"])))
    missed = F.aggregate(kinds, F.lit(1.0), lambda acc, f: acc * (1 - F.when(f["kind"] == "expression", F.lit(EXPRESSION)).when(f["kind"] == "notice", F.lit(NOTICE)).otherwise(F.lit(NAME))))
    texts = F.array_distinct(F.transform(F.filter("findings", lambda f: f["kind"] == "expression"), lambda f: f["text"]))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _joined(F.transform("base", lambda f: f["label"])).alias("base_labels"), _joined(F.transform("findings", lambda f: f["label"])).alias("labels"),
        (1 - missed).alias("score"), F.coalesce(F.array_max(F.transform("findings", lambda f: f["level"])), F.lit(0)).alias("level"), F.array_join(texts, "; ").alias("expressions"),
    )
