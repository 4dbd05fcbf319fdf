"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one failure bit per rule, so that policies (sets of rules, by version) and
ablations are bit operations on the ledger and never touch the texts again.

Main path: DataFrame functions only.

Defined results. Null or empty text: no words, so every measurement is zero and the
document fails the length rule. Very long texts: measured whole, in n log n. Repeated rows and ties: each row is judged by
itself. Empty table: empty ledger. Extra columns are dropped, or kept as they are
by ``filtered``, which carries each row as one struct, so that names that clash
with a measurement cannot interfere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words",
)


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements; integers only, so that it is exact."""

    name: str
    fails: str


#: A rule's place in this list is its bit. Only append.
RULES: tuple[Rule, ...] = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", "100 * n_symbols > 50 * n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("shouting", "10 * n_upper > 5 * word_chars"),
)

BASE = ("too_few_words", "repeated_windows")

#: Versioned policies: the rules that reject a document.
POLICIES: Mapping[str, Sequence[str]] = {
    "v1": BASE,
    "v2": (*BASE, "symbol_heavy", "duplicate_lines", "short_words", "long_words"),
    "v3": (*BASE, "symbol_heavy", "duplicate_lines", "short_words", "long_words", "shouting"),
}


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    place = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << place[n] for n in names)


def measure(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: bool = False
) -> DataFrame:
    """doc_id (and, if ``carry``, the whole row as the struct ``_row``) and the measurements of each whole text, as longs.

    ``n_repeat_words`` counts the words inside 3-word windows that occur twice or
    more in the text. Windows are compared by a 64-bit hash inside one text; only a
    text that repeats a hash sorts its windows, which keeps the cost at n log n for
    any text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kept = ["doc_id", *["_row"] * carry]
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        *[F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] * carry,
        words(F.col(text)).alias("_words"),
        F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(body, "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
    )
    hashed = base.select(
        *kept,
        "n_symbols",
        "n_upper",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.slice(
            F.transform(
                "_words",
                lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)),
            ),
            F.lit(1),
            F.greatest(F.size("_words") - 2, F.lit(0)),
        ).alias("_windows"),
    )
    ordered = hashed.withColumn(
        "_windows",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    repeated = ordered.withColumn(
        "_at",
        F.transform(
            F.filter(
                "_windows",
                lambda e, k: F.coalesce(F.get("_windows", k - 1)["h"] == e["h"], F.lit(False))
                | F.coalesce(F.get("_windows", k + 1)["h"] == e["h"], F.lit(False)),
            ),
            lambda e: e["i"],
        ),
    )
    covered = F.size(
        F.array_distinct(
            F.concat("_at", F.transform("_at", lambda i: i + 1), F.transform("_at", lambda i: i + 2))
        )
    )
    return repeated.withColumn(
        "n_repeat_words", F.when(F.col("_at").isNull(), 0).otherwise(covered).cast("long")
    ).select(*kept, *MEASURES)


def _kept_apart() -> Column:
    """0, but one that the optimizer neither folds nor copies.

    So a filter on what is added to it stays above the measuring, instead of having every
    measurement written out inside it, again and again.
    """
    return (F.spark_partition_id() * 0).cast("long")


def ledger(
    docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text",
    carry: bool = False,
) -> DataFrame:
    """Measurements and ``failed``: a long with bit k set if rule k fails."""
    bits = _kept_apart()
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, doc_id, text, carry).withColumn("failed", bits)


def apply_policy(
    entries: DataFrame, policy: str = "v3", rules: Sequence[Rule] = RULES,
    policies: Mapping[str, Sequence[str]] = POLICIES,
) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under one version of the policy."""
    hit = lambda names: F.col("failed").bitwiseAND(F.lit(mask(names, rules)).cast("long")) != 0
    return entries.withColumn("base_failed", hit(BASE)).withColumn(
        "kept", ~hit(BASE) & ~hit(policies[policy])
    )


def ablations(
    entries: DataFrame, policy: str = "v3", rules: Sequence[Rule] = RULES,
    policies: Mapping[str, Sequence[str]] = POLICIES,
) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects.

    The documents are first summed by their masked failure word (at most
    2**rules values), so one small aggregate feeds every ablation.
    """
    chosen = mask(policies[policy], rules)
    words_ = entries.groupBy(
        F.col("failed").bitwiseAND(F.lit(chosen).cast("long")).alias("word")
    ).agg(F.count(F.lit(1)).alias("n"))
    rows = [(r.name, 1 << k) for k, r in enumerate(rules) if chosen >> k & 1]
    listed = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rows))
    return (
        words_.select("word", "n", F.explode(listed).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("word").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("word") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        )
    )


def quality_rules(docs: DataFrame, policy: str = "v3") -> DataFrame:
    """The ledger with its verdicts: one row for each row of ``docs``."""
    return apply_policy(ledger(docs), policy)


def filtered(docs: DataFrame, policy: str = "v3") -> DataFrame:
    """The rows of ``docs``, columns unchanged, that the policy keeps; no shuffle."""
    return apply_policy(ledger(docs, carry=True), policy).where("kept").select("_row.*")
