"""Secret scans through a trigram inverted index.

Every rule's regex is turned into a Boolean query over trigrams that any match must
contain. The index holds a posting (trigram, document) for each trigram that some rule
asks about; intersecting postings gives each rule's candidate documents, and only those
are searched with the regex. A rule without mandatory trigrams is run over every text.

A clause's rarest trigram is its anchor: the clause's other trigrams are looked for, and
posted, only in documents that hold an anchor, since no other posting can be in an
intersection. Candidates meet their texts by an equality join on a hash of id and text,
whatever their number; Spark broadcasts them where their measured size allows.

Main path: DataFrame functions only. Trigrams are taken from the lower-cased text, which
can only add candidates. Positions are code points.

Defined results. Null or empty text: no spans. Null ids and repeated rows: each row is scanned
by itself; equal rows share candidates. Very long texts and texts with many secrets: positions
come from running sums taken in blocks, and masks are put between cuts of the text, so that nothing
grows with the square of either. Ties: spans are ordered by start, then by the rule's place, then by
end. Empty table: no rows. Extra columns are carried inside one struct where whole rows are returned.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_struct, staged


@dataclass(frozen=True)
class Rule:
    """A match counts if ``group`` has ``least`` characters or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The three base kinds come first, in this order.
RULES: tuple[Rule, ...] = (
    Rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+", 0, 30),
)
BASE = ("assign", "access", "hex")

#: Strings that one stretch of literals may stand for.
EXPAND = 64
#: Elements in a block of running sums, and code points in a block of text.
STEP, CUT = 128, 1024
#: Fixed value: letters of English from the most to the least frequent, by which anchors are chosen.
FREQUENT = " etaoinshrdlucmfwypvbgkjqxz"

#: A query in disjunctive form: a match contains all trigrams of at least one of the sets.
#: None: nothing is mandatory.
Query = frozenset[frozenset[str]] | None


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    out = frozenset(x | y for x in a for y in b)
    return out if len(out) <= EXPAND else a


def _of(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return None
    return frozenset(frozenset(s[i : i + 3].lower() for i in range(len(s) - 2)) for s in strings)


def _walk(tree) -> tuple[set[str] | None, Query]:
    """(the strings that the whole may be, or None if they are too many; what a match must contain)."""
    whole, run, query = True, {""}, None

    def flush() -> None:
        nonlocal whole, run, query
        whole, query, run = False, _both(query, _of(run)), {""}

    for op, arg in tree:
        exact, inner = None, None
        if op is sre.LITERAL:
            exact = {chr(arg)}
        elif op is sre.AT:
            exact = {""}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            exact = {chr(a) for _, a in arg}
        elif op is sre.SUBPATTERN:
            exact, inner = _walk(arg[3])
        elif op is sre.BRANCH:
            parts = [_walk(t) for t in arg[1]]
            if all(e is not None for e, _ in parts):
                exact = set().union(*(e for e, _ in parts))
            else:
                asks = [q if e is None else _of(e) for e, q in parts]
                inner = None if None in asks else frozenset().union(*asks)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, item = arg
            one, inner = _walk(item)
            if one is not None and high == 1:
                exact = one | {""} if low == 0 else one
            elif low == 0:
                inner = None
            elif one is not None:
                inner = _of(one)
        if exact is not None and len(exact) * len(run) <= EXPAND:
            run = {r + e for r in run for e in exact}
        else:
            flush()
            query = _both(query, inner if exact is None else _of(exact))
    return (run, None) if whole else (None, _both(query, _of(run)))


def trigram_query(regex: str) -> Query:
    """The trigrams, in lower case, that any match of ``regex`` must contain; a set that holds another one is left out."""
    exact, query = _walk(parser.parse(regex))
    query = query if exact is None else _of(exact)
    return query and frozenset(c for c in query if not any(d < c for d in query))


def anchor(clause: frozenset[str]) -> str:
    """The trigram of a clause that is likely to be the rarest."""
    rank = lambda t: sum(FREQUENT.find(c) % 30 for c in t)  # other characters count as rarer than all letters
    return max(sorted(clause), key=rank)


def vocabulary(rules: Sequence[Rule] = RULES) -> list[str]:
    """The trigrams that the rules ask about, sorted: the index's terms."""
    return sorted({t for r in rules for terms in trigram_query(r.regex) or () for t in terms})


def _key(docs: DataFrame, doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def _sql(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def build_index(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index's postings (term, key), term being a place in ``vocabulary``, where a clause's anchor is present."""
    terms, clauses = vocabulary(rules), [c for r in rules for c in trigram_query(r.regex) or ()]
    anchors = sorted({anchor(c) for c in clauses})
    words = [anchors[w : w + 30] for w in range(0, len(anchors), 30)]
    has = lambda t: f"contains(_folded, {_sql(t)})"
    seen = ", ".join(" | ".join(f"if({has(t)}, {1 << k}, 0)" for k, t in enumerate(word)) for word in words)

    def near(term: str) -> str:
        """Whether an anchor of one of the term's clauses is present."""
        masks = [sum(1 << k for k, t in enumerate(word) if any(anchor(c) == t and term in c for c in clauses)) for word in words]
        return " or ".join(f"_seen[{w}] & {m} != 0" for w, m in enumerate(masks) if m)

    found = ", ".join(f"if(({near(t)}) and {has(t)}, {i}, null)" for i, t in enumerate(terms))
    return (
        docs.select(_key(docs, doc_id, text).alias("key"), F.lower(text).alias("_folded"))
        .select("*", F.expr(f"array({seen})").alias("_seen"))
        .where("exists(_seen, x -> x != 0)")
        .selectExpr(f"explode(array_compact(array({found}))) as term", "key")
    )


def _bits(rules: Sequence[Rule], has) -> Column:
    """Bit k is set if rule k's query holds; ``has(places)`` is the SQL that tests for a set of terms."""
    place, parts = {t: i for i, t in enumerate(vocabulary(rules))}, ["0"]
    for k, r in enumerate(rules):
        if (query := trigram_query(r.regex)) is not None:
            ok = " or ".join(f"({has(sorted(place[t] for t in clause))})" for clause in sorted(query, key=sorted))
            parts.append(f"if({ok}, {1 << k}, 0)")
    return F.expr(" | ".join(parts))


def candidates(index: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(key, rules): bit k of ``rules`` is set if the postings of rule k's query intersect at the document.

    A task holds all postings of its documents, so they are combined before the shuffle.
    """
    starts = range(0, len(vocabulary(rules)), 63)
    sets = [F.expr(f"bit_or(if(term between {w} and {w + 62}, shiftleft(1L, term - {w}), 0L)) as w{w}") for w in starts]

    def has(places: list[int]) -> str:
        masks = {w: sum(1 << p - w for p in places if w <= p < w + 63) for w in starts}
        return " and ".join(f"w{w} & {m}L = {m}L" for w, m in masks.items() if m)

    return index.groupBy("key").agg(*sets).select("key", _bits(rules, has).alias("rules")).where("rules <> 0")


def _let(value: str, name: str, use: str) -> str:
    """SQL for ``use``, in which ``name`` is the value, taken once however often it is used."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def _upto(n: str) -> str:
    return f"if({n} > 0, sequence(0, cast({n} as int) - 1), cast(array() as array<int>))"


def prefixes(values: str, op: str) -> str:
    """SQL for ``op`` ({} of two ints, from 0) over all elements before each one.

    It works in blocks: an element costs ``STEP`` steps and no array is grown.
    """
    fold = lambda x: f"aggregate({x}, 0, (p, q) -> {op.format('p', 'q')})"
    blocks = f"transform({_upto(f'ceil(size(v) / {STEP})')}, c -> slice(v, c * {STEP} + 1, {STEP}))"
    bases = _let(f"transform(blocks, b -> {fold('b')})", "t", f"transform({_upto('size(t)')}, c -> {fold('slice(t, 1, c)')})")
    each = f"transform({_upto('size(b)')}, i -> {op.format('base', fold('slice(b, 1, i)'))})"
    return _let(values, "v", _let(blocks, "blocks", f"flatten(zip_with(blocks, {bases}, (b, base) -> {each}))"))


def _spans(text: str, rule: Rule, place: int) -> str:
    """SQL for the rule's spans as (start, place, end, kind), by the lengths of matches and of what lies between."""
    sizes = lambda x: f"transform({x}, x -> length(x))"
    found = lambda group: sizes(f"regexp_extract_all({text}, {_sql(rule.regex)}, {group})")
    hits, gaps = found(0), sizes(f"split({text}, {_sql(rule.regex)}, -1)")
    before = prefixes("zip_with(m.hit, slice(m.gap, 1, size(m.hit)), (h, g) -> h + g)", "{} + {}")
    hit_gap = "zip_with(m.hit, slice(m.gap, 1, size(m.hit)), (h, g) -> struct(h as hit, g as gap))"
    judged_at = f"zip_with(m.judged, {before}, (j, a) -> struct(j as judged, a as at))"
    rows = f"zip_with({hit_gap}, {judged_at}, (x, y) -> struct(y.at + x.gap as start, x.hit as hit, y.judged as judged))"
    good = f"transform(filter({rows}, r -> r.judged >= {rule.least}), r -> struct(r.start as start, {place} as place, r.start + r.hit as end, {_sql(rule.kind)} as kind))"
    judged = found(rule.group) if rule.group else "h.hit"
    return _let(_let(f"struct({hits} as hit, {gaps} as gap)", "h", f"struct(h.hit as hit, h.gap as gap, {judged} as judged)"), "m", good)


def _gate(rule: Rule) -> str:
    """A cheaper regex that every counted match satisfies."""
    if rule.least > 1 and not rule.group and rule.regex.endswith("]+") and trigram_query(rule.regex) is None:
        return f"{rule.regex[:-1]}{{{rule.least},}}"
    return rule.regex


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` as the struct ``row``, with ``found``: its spans, sorted."""
    texts = docs.select(row_struct(docs).alias("row"), _key(docs, doc_id, text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    listed = staged(candidates(build_index(docs, rules, doc_id, text), rules), "candidates")
    texts = texts.join(listed, "key", "left").withColumn("rules", F.coalesce("rules", F.lit(0)))
    none, parts = "cast(array() as array<struct<start:int,place:int,end:int,kind:string>>)", []
    for k, r in enumerate(rules):
        may = f"_text rlike {_sql(_gate(r))}" if trigram_query(r.regex) is None else f"rules & {1 << k} != 0"
        parts.append(f"if({may}, {_spans('_text', r, k)}, {none})")
    return texts.selectExpr("row", "_text", f"sort_array(concat({', '.join(parts)})) as found")


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_spans(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per document."""
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return scan(docs, rules).select(
        F.col("row.doc_id").alias("doc_id"),
        *map(of, BASE),
        F.sha2(F.encode(_joined(base), "UTF-8"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


def redacted(docs: DataFrame, mask: str = "[SECRET]", rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, with every span of a secret replaced; a null text stays null.

    Spans that overlap make one mask.
    """
    ends = "transform(found, s -> s.end)"
    # A span that begins where all before it have ended opens a mask; what lies before it is kept.
    cuts = f"filter(zip_with(found, {prefixes(ends, 'greatest({}, {})')}, (s, m) -> struct(m as a, s.start as b)), x -> x.b >= x.a)"
    kept = f"concat({cuts}, array(struct(array_max({ends}) as a, length(_text) as b)))"
    first = f"greatest(x.a - k * {CUT}, 0)"
    part = f"substring(get(blocks, k), {first} + 1, least(x.b - k * {CUT}, {CUT}) - {first})"
    place = lambda n: f"cast(floor({n} / {CUT}) as int)"
    piece = f"if(x.b <= x.a, '', array_join(transform(sequence({place('x.a')}, {place('(x.b - 1)')}), k -> {part}), ''))"
    clean = _let(
        f"regexp_extract_all(_text, {_sql(f'(?s).{{1,{CUT}}}')}, 0)", "blocks", f"array_join(transform({kept}, x -> {piece}), {_sql(mask)})"
    )
    cleaned = F.when(F.size("found") > 0, F.expr(clean)).otherwise(F.col(f"row.`{text}`"))
    return scan(docs, rules, text=text).select(
        *(cleaned.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns)
    )
