"""Text rules as column expressions that agree with Python's regular expressions.

Java's ``\\w``, ``\\b`` and ``\\s`` know ASCII only, so tokens and blanks are spelled out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
#: All that Python's \s matches.
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Typographic characters and their plain forms.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
PLAIN_FROM, PLAIN_TO = "’‘“”–— ­", "''\"\"-- "

# English function words by whose share garbled text is found.
STOP_WORDS = (
    "the be to of and a in that have it for not on with he as you do at this but his by from they we say her she or "
    "an will my one all would there their what so up out if about who get which go me when"
).split()

# Words of which a sound English page has at least one.
PAGE_WORDS = (
    "the and of to in that is for on it with this from are have management leadership police state rules court officer "
    "team chapter section module index page topics contents foreword"
).split()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column, least: int) -> Column:
    """Lower-case tokens made of ``least`` or more ASCII letters."""
    return F.filter(tokens(text), lambda w: w.rlike(f"^[a-z]{{{least},}}$"))


def whole_words(text: Column, least: int) -> Column:
    """The same words as of ``words`` in sanitized text, found by one pattern instead of out of all tokens."""
    edge = r"[\p{L}\p{N}_]"
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?<!{edge})[a-z]{{{least},}}+(?!{edge})"), F.lit(0))


def any_word(text: Column, phrases: Sequence[str]) -> Column:
    """Whether one of the phrases stands between non-word characters."""
    edge = r"[^\p{L}\p{N}_]"
    return text.rlike(f"(^|{edge})({'|'.join(phrases)})({edge}|$)")


def collapse(text: Column) -> Column:
    """Runs of blanks to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def unprivate(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{E000}-\x{F8FF}]", "")


def plain(text: Column) -> Column:
    """Ligatures, quotes, dashes, no-break spaces and soft hyphens in plain characters."""
    out = F.translate(text, PLAIN_FROM, PLAIN_TO)
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, f"({TOKEN})-\\n({TOKEN})", "$1$2")


def unnumber(text: Column) -> Column:
    """Without lines that hold a number of up to four digits only."""
    return F.regexp_replace(text, rf"(?md)^{BLANK}*\d{{1,4}}{BLANK}*$", "")


def basic(text: Column) -> Column:
    return unnumber(dehyphenate(plain(unprivate(text))))


def clean(text: Column, missing: str = "Unknown") -> Column:
    """Full clean but for ASCII folding; a missing text becomes ``missing``."""
    return F.coalesce(F.lower(collapse(basic(text))), F.lit(missing))


def clean_english(text: Column) -> Column:
    """Full clean in order: plain characters, joined lines, no bare numbers, ASCII, single blanks, lower case."""
    plain_ = basic(text)
    folded = F.when(plain_.rlike(r"[^\x00-\x7F]"), ascii_fold(plain_)).otherwise(plain_)
    return F.coalesce(F.lower(collapse(folded)), F.lit("Unknown"))


def clean_minimal(text: Column) -> Column:
    """Plain characters, joined lines, single blanks; a missing text is empty."""
    return F.coalesce(collapse(dehyphenate(plain(unprivate(text)))), F.lit(""))


def clean_ocr(text: Column) -> Column:
    """Without bare numbers, lines joined, single blanks; a missing text is empty."""
    return F.coalesce(collapse(dehyphenate(unnumber(text))), F.lit(""))


def clean_by_language(text: Column, language: Column) -> Column:
    """English loses non-ASCII characters; other languages keep theirs; case stays."""
    base = collapse(basic(text))
    return F.when(language == "en", collapse(F.regexp_replace(base, r"[^\x00-\x7F]", ""))).otherwise(base)


# Fixed values, here and in ``clean_heading``: the patterns of page counters, directory headings, numbers and bullets.
def strip_boilerplate(text: Column) -> Column:
    """Without page counters, bare numbers and directory headings; paragraph breaks stay."""
    out = dehyphenate(plain(unprivate(text)))
    out = F.regexp_replace(out, r"(?imd)^\s*page\s+\d+\s*(of\s+\d+)?\s*$", "")
    out = F.regexp_replace(out, r"(?imd)^\s*\d{1,4}\s*$", "")
    out = F.regexp_replace(out, r"(?imd)^\s*(table\s+of\s+contents|references)\s*$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, rf"^{BLANK}+|{BLANK}+$", "")


def clean_heading(text: Column) -> Column:
    """A cleaned heading without its number or bullet."""
    out = F.regexp_replace(clean(text, "unknown"), r"^([a-z]|[ivxlcdm]+|[0-9]+)(\.[0-9]+)*\.\s*", "")
    return F.trim(F.regexp_replace(out, "^[-•–―]\\s*", ""))


def sanitize(text: Column) -> Column:
    """Printable ASCII, the Telugu block and blanks; blanks collapsed."""
    # Java takes over ten times as long for a negated class of both ranges, so the block is looked at behind what isn't ASCII.
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\x20-\x7E\t\n\r](?<![\x{0C00}-\x{0C7F}])", ""), r"\s+", " "))


# A running footer, and in ``promote_headings`` the patterns of titles.
FOOTER = r"Trg-Pol\.Vach-1-2025/T\.S\.Police/Hyd\s*[0-9]*"


def promote_headings(text: Column, footer: str = FOOTER) -> Column:
    """Without the footer; lines that look like chapter, section, module or component titles become Markdown headings."""
    out = F.regexp_replace(F.regexp_replace(text, footer, ""), r"(?md)^\s*[0-9]+\s*$", "")
    out = F.regexp_replace(out, r"(?md)^(CHAPTER\s*-\s*[IVXLCDM]+.*)", "# $1")
    out = F.regexp_replace(out, r"(?md)^(Sec\.\s*[0-9]+\..*)", "## $1")
    out = F.regexp_replace(out, r"(?imd)^(MODULE\s+[IVXLCDM]+.*)", "# $1")
    out = F.regexp_replace(out, r"(?md)^([0-9]+\.\s+[A-Z\s]{4,})", "## $1")
    out = F.regexp_replace(out, r"(?imd)^([A-Z\s]{5,}\s+COMPONENT.*)", "## $1")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), rf"^{BLANK}+|{BLANK}+$", "")


def page_corrupted(text: Column) -> Column:
    """The cascade of page checks: odd characters, words without vowels, no known word, too little script."""
    body = F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")
    n = F.length(body)
    odd = F.length(F.regexp_replace(body, r"[\x00-\x7F\x{0C00}-\x{0C7F}]|[^\p{L}\p{N}_]", ""))
    english = words(body, 3)
    silent = F.size(F.filter(english, lambda w: ~w.rlike("[aeiouy]")))
    known = F.size(F.filter(english, lambda w: w.isin(*PAGE_WORDS)))
    script = F.length(F.regexp_replace(body, r"[^\x{0C00}-\x{0C7F}]", ""))
    digits = F.length(F.regexp_replace(body, "[^0-9]", ""))
    return (
        F.when(n < 30, False)
        .when(odd * 20 > n, True)
        .when((F.size(english) >= 4) & (silent * 10 > F.size(english) * 4), True)
        .when((F.size(english) >= 4) & (known == 0), True)
        .when((n > 100) & (F.size(english) < 4) & (script * 20 < n) & (digits * 4 < n), True)
        .otherwise(False)
    )


def sentences(text: Column) -> Column:
    """Sentences end in . ! or ? before blanks."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def key_terms(text: Column) -> Column:
    """Acronyms, capitalised phrases and capitalised words, lower-cased, sorted, each once."""
    before, after = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    found = [F.regexp_extract_all(text, F.lit(before + p + after), F.lit(0)) for p in (
        "[A-Z]{2,}", rf"[A-Z][a-z]+(?:{BLANK}+[A-Z][a-z]+)+", "[A-Z][a-z]{2,}")]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*found), F.lower)))


def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii"))


def ascii_fold(text: Column) -> Column:
    """Compatibility decomposition without what isn't ASCII; Spark has no normaliser of its own."""
    return F.pandas_udf(_fold, "string")(text)


def sections(text: Column) -> Column:
    """Markdown sections, an array of (level, heading, body): headings of one to three #, and what comes before as Preamble."""
    marks = "\x01\x02\x03"
    marked = F.regexp_replace(F.translate(text, marks, ""), rf"(?md)^(#{{1,3}}){BLANK}+(.+)$", "\x01$1\x02$2\x03")
    ends = lambda x: F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", "")
    parts = F.split(marked, "\x01", -1)
    made = F.transform(
        parts,
        lambda p, i: F.when(i == 0, F.struct(F.lit(0).alias("level"), F.lit("Preamble").alias("heading"), ends(p).alias("body"))).otherwise(
            F.struct(
                F.length(F.substring_index(p, "\x02", 1)).alias("level"),
                ends(F.substring_index(F.substring_index(p, "\x03", 1), "\x02", -1)).alias("heading"),
                ends(F.substring_index(p, "\x03", -1)).alias("body"),
            )
        ),
    )
    return F.filter(made, lambda s: (s["level"] > 0) | (s["body"] != ""))
