"""Answers from a generator, in the question's language, with the English answer where that fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..sources.providers import called
from . import context

BANNER = "In English: "
FAILED = "No answer could be made."
FAILED_IN = {"Telugu": "సమాధానం ఇవ్వలేకపోయాం."}


def extractive(prompt: str) -> str:
    """The default generator: the first sentence of a prompt's context that shares most distinct words with its question."""
    import regex

    words = lambda s: set(regex.findall(TOKEN, s.lower()))
    said, _, question = prompt.rpartition("\n\nQUESTION:\n")
    asked = words(question)
    return max(regex.split(r"(?<=[.!?])\s+", said.partition("\n\nCONTEXT:\n")[2]), key=lambda s: len(asked & words(s)))


def answered(rows: DataFrame, model: Callable[[str], str] = extractive) -> DataFrame:
    """Adds ``answer`` and ``outcome`` to (``question``, ``context``, ``query_type``, ``language``).

    Outcomes: ``empty`` (no context: a fixed sentence, the model isn't called), ``own`` (answered in the language), ``english`` (that
    failed or was blank twice: the English answer behind a banner), ``failed`` (that too: a fixed sentence in the language).
    A null language is English. The model is called for rows that need it only.
    """
    blank = F.trim(F.coalesce("context", F.lit(""))) == ""
    language = F.coalesce("language", F.lit("English"))
    prompt = lambda lang: context.prompt(F.col("question"), F.col("context"), F.col("query_type"), lang)
    first = rows.withColumn("_first", called(F.when(~blank, prompt(language)), model))
    again = ~blank & (F.trim(F.coalesce("_first", F.lit(""))) == "") & (language != "English")
    both = first.withColumn("_second", called(F.when(again, prompt(F.lit("English"))), model))
    some = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    outcome = F.when(blank, "empty").when(some("_first"), "own").when(some("_second"), "english").otherwise("failed")
    sorry = F.lit(FAILED)
    for name, text in FAILED_IN.items():
        sorry = F.when(language == name, text).otherwise(sorry)
    answer = (
        F.when(F.col("outcome") == "empty", context.NOTHING).when(F.col("outcome") == "own", F.col("_first"))
        .when(F.col("outcome") == "english", F.concat(F.lit(BANNER), F.col("_second"))).otherwise(sorry)
    )
    return both.withColumn("outcome", outcome).withColumn("answer", answer).drop("_first", "_second")
