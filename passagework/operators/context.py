"""From ranked passages to contexts, citations and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What stands between pages, the length from which contexts are compressed, the answer without a context.
PAGE_BREAK = "\n\n===== PAGE BREAK =====\n\n"
MAX_CONTEXT = 6000
NOTHING = "No relevant information found."
INSTRUCTIONS = {
    "factual": "Give the facts that the passages state, briefly, in {lang}.",
    "explanatory": "Explain what the passages say, step by step, in {lang}.",
}
BASE_PROMPT = "Answer from the passages alone; if they do not hold the answer, say so."


def expand_to_parents(hits: DataFrame, pages: DataFrame, strict: bool = False) -> DataFrame:
    """Adds final_text: the parent page's text, or the hit's own where it has none; ``strict`` drops those."""
    joined = hits.join(pages.select("doc_id", "page", F.col("text").alias("parent")), ["doc_id", "page"], "inner" if strict else "left")
    own = F.when(F.length("parent") > 0, F.col("parent")).otherwise(F.col("text"))
    return joined.withColumn("final_text", own).drop("parent")


def distinct_texts(hits: DataFrame) -> DataFrame:
    """Each text once per query, at its best rank."""
    order = Window.partitionBy("query_id", "final_text").orderBy("rank")
    return hits.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def contexts(hits: DataFrame) -> DataFrame:
    """(query_id, n_parts, context): the texts in order of rank between page breaks."""
    parts = F.array_sort(F.collect_list(F.struct("rank", "final_text")))
    return hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_parts"), F.array_join(F.transform(parts, lambda x: x["final_text"]), PAGE_BREAK).alias("context")
    )


def citation(filename: Column, page: Column, text: Column, length: int = 300) -> list[Column]:
    return [
        F.coalesce(filename, F.lit("Unknown")).alias("file"), F.coalesce(page, F.lit("?")).alias("page"),
        F.left(F.coalesce(text, F.lit("")), F.lit(length)).alias("text"),
    ]


def prompt(query: Column, context: Column, kind: Column, lang: Column) -> Column:
    chosen = F.when(kind == "factual", INSTRUCTIONS["factual"]).otherwise(INSTRUCTIONS["explanatory"])
    return F.concat(F.lit(BASE_PROMPT + "\n\n"), F.replace(chosen, F.lit("{lang}"), lang), F.lit("\n\nCONTEXT:\n"), context, F.lit("\n\nQUESTION:\n"), query)


def compressed(query: Column, context: Column, tokens) -> Column:
    """Long contexts keep the sentences that share a token with the query; if none do, all stay."""
    said = F.filter(F.split(context, r"(?<=[.!?])\s+"), lambda s: F.arrays_overlap(tokens(s), tokens(query)))
    short = F.array_join(said, " ")
    return F.when(F.length(context) <= MAX_CONTEXT, context).when(short == "", context).otherwise(short)


def extractive_answer(query: Column, context: Column, tokens) -> Column:
    """The default generator: the first sentence that shares most tokens with the query."""
    q = F.array_distinct(tokens(query))
    best = F.aggregate(
        F.split(context, r"(?<=[.!?])\s+"), F.struct(F.lit(-1).alias("n"), F.lit("").alias("s")),
        lambda acc, s: F.when(F.size(F.array_intersect(q, tokens(s))) > acc["n"], F.struct(F.size(F.array_intersect(q, tokens(s))).alias("n"), s.alias("s"))).otherwise(acc),
    )
    return F.when(F.coalesce(context, F.lit("")) == "", NOTHING).otherwise(best["s"])
