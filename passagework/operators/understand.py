"""Query understanding: validation, language, route, type, expansion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import any_word, key_terms, tokens

MAX_QUERY = 3000
SMALL_TALK = 40

# Romanised words, greetings, legal terms and keywords by which questions are classified.
ROMANISED = "ante enti ela unnav bagunnara emi enduku ekkada chesav".split()
GREETINGS = ["hi", "hello", "hey", "thanks", "thank you", "bye", "how are you", "who are you"]
GREETINGS_IN_SCRIPT = ["హాయ్", "నమస్కారం"]
LEGAL = "section law crime police fir ipc bns bnss bsa dowry bail punishment".split()
EXPLANATORY = ["explain", "why", "how", "compare", "difference", "analyse", "discuss", "వివరించు", "ఎలా", "ఎందుకు"]


def validated(text: Column) -> tuple[Column, Column]:
    """(status, error): empty and overlong questions are refused."""
    n = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    bad = F.when(n == 0, "empty").when(n > MAX_QUERY, "too long").otherwise("")
    return F.when(bad == "", 200).otherwise(400).cast("long"), bad


def language(text: Column, model: Column | None = None) -> Column:
    """By script, then by romanised words, then by the model (default: English)."""
    return (
        F.when(text.rlike(r"[\x{0C00}-\x{0C7F}]"), "Telugu")
        .when(F.arrays_overlap(tokens(text), F.array(*map(F.lit, ROMANISED))), "Telugu")
        .otherwise(F.lit("English") if model is None else model)
    )


def route(text: Column) -> Column:
    """Small talk is short and has a greeting; a legal term makes it a question all the same."""
    q = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    greets = any_word(q, GREETINGS) | q.rlike("|".join(GREETINGS_IN_SCRIPT))
    return F.when(any_word(q, LEGAL), "rag").when(greets & (F.length(q) < SMALL_TALK), "general_chat").otherwise("rag")


def query_type(text: Column) -> Column:
    """By keywords inside words too."""
    return F.when(F.lower(text).rlike("|".join(EXPLANATORY)), "explanatory").otherwise("factual")


def expanded(text: Column) -> Column:
    """The rewritten question, if there is one, then the question; the default rewriter lists key terms."""
    rewritten = F.array_join(key_terms(text), " ")
    return F.when(rewritten == "", F.array(text)).otherwise(F.array(rewritten, text))


def output_action(size: Column, least: int = 1000) -> Column:
    """Whether an output of ``size`` bytes (null: none) is kept, made, or thrown away and made anew."""
    return F.when(size > least, "skip").when(size.isNull(), "make").otherwise("remake")
