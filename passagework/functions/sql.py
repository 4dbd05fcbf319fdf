"""The text rules as SQL functions of a session. The optimizer inlines them; no row meets Python.

``passage_chunks`` gives an array, which ``LATERAL VIEW inline(...)`` makes rows of. A function that returns a table would be joined back by its argument,
which shuffles the texts.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import TOKEN

_SANE = r"regexp_replace(regexp_replace(t, r'[^\x{0C00}-\x{0C7F}\x20-\x7E\t\n\r]', ''), r'\s+', ' ')"

FUNCTIONS = {
    "passage_sanitize": f"(t STRING) RETURNS STRING RETURN trim({_SANE})",
    "passage_tokens": f"(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(coalesce(t, '')), r'{TOKEN}', 0)",
    "passage_key": "(subject STRING, filename STRING) RETURNS STRING RETURN left(md5(lower(concat(subject, '::', filename))), 12)",
    "passage_share": """(question STRING, t STRING) RETURNS DOUBLE RETURN round(coalesce(size(array_intersect(passage_tokens(question), passage_tokens(t)))
        / nullif(size(array_distinct(passage_tokens(question))), 0), 0), 6)""",
    "passage_chunks": """(t STRING, width INT, common INT) RETURNS ARRAY<STRUCT<idx: BIGINT, chunk: STRING>> RETURN if(length(t) > 0, transform(
        sequence(0, greatest(0, CAST(ceil((length(t) - width) / (width - common)) AS INT))),
        i -> struct(CAST(i AS BIGINT) AS idx, substring(t, i * (width - common) + 1, width) AS chunk)), NULL)""",
}


def register(spark: SparkSession) -> None:
    """Makes the functions in the session, in place of earlier ones of the same names."""
    for name, made in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{made}")
