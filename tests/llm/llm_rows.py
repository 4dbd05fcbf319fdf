"""Small document tables."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    """Documents from (doc_id, text, source)."""
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows], SCHEMA)
