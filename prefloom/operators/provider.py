"""Outside providers: batched calls within a task, answers put back in order, refusals tried again, and the embedding cache filled.

A provider is a function on a list of texts.  It gives (index, vector) pairs, in any order, or raises Refused with a status
code.  Codes of ``AGAIN`` are tried again after a pause that doubles up to a cap; others, and the last try, end the task
with the error.  Spark then tries the task again, so a call may be repeated; what is written is not.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_id
from ..sources.tables import read_embeddings, write_embeddings, written

# Status codes that are tried again.
AGAIN = (408, 409, 429, 500, 502, 503, 504)
TRIES, LONGEST = 6, 60.0


class Refused(Exception):
    """A provider's answer other than success."""

    def __init__(self, code: int, message: str = ""):
        super().__init__(f"{code} {message}".strip())
        self.code = code

    def __reduce__(self):
        return Refused, (self.code, str(self).partition(" ")[2])


def pause(attempt: int) -> float:
    """Seconds before the next try, after try number `attempt` from 0."""
    return min(LONGEST, 2.0**attempt) + 0.1 * attempt


def called(call: Callable, texts: list[str], tries: int = TRIES, sleep: Callable = time.sleep) -> list:
    """The provider's vectors in the order of texts; ValueError where an index lacks, repeats or is out of range."""
    for attempt in range(tries):
        try:
            answer = list(call(texts))
            break
        except Refused as e:
            if e.code not in AGAIN or attempt == tries - 1:
                raise
            sleep(pause(attempt))
    if sorted(i for i, _ in answer) != list(range(len(texts))):
        raise ValueError(f"{len(texts)} texts, but answers for {sorted(i for i, _ in answer)}")
    return [v for _, v in sorted(answer, key=lambda x: x[0])]


def embedded(texts: DataFrame, call: Callable, model: str, size: int = 64, tries: int = TRIES, sleep: Callable = time.sleep) -> DataFrame:
    """(text_id, embedding, model) of the rows of texts (text_id, text), in calls of at most `size` texts."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                vectors = called(call, part["text"].tolist(), tries, sleep)
                yield part[["text_id"]].assign(embedding=[list(map(float, v)) for v in vectors], model=model)

    return texts.select("text_id", "text").mapInPandas(run, "text_id string, embedding array<float>, model string")


def fill_embeddings(texts: DataFrame, path: str, call: Callable, model: str, size: int = 64, tries: int = TRIES, sleep: Callable = time.sleep) -> dict[str, int]:
    """Embed the distinct texts that the model's cache at path lacks and add them; counts of texts asked for and of those that were missing.

    Null texts are left out.  What is there already is neither called for nor written again.
    """
    spark = texts.sparkSession
    wanted = texts.where("text IS NOT NULL").select(text_id(F.col("text")).alias("text_id"), "text").dropDuplicates(["text_id"])
    todo = written(wanted.join(read_embeddings(spark, path, model).select("text_id"), "text_id", "left_anti"), "embeddings-todo")
    missing = todo.count()
    if missing:
        write_embeddings(embedded(todo, call, model, size, tries, sleep), path)
    return {"asked": wanted.count(), "missing": missing}
