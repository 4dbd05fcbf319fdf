"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the name space of domain names for version 5 identifiers.
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def doc_key(subject: Column, filename: Column) -> Column:
    """Twelve hex digits of the digest of subject and file name."""
    return F.left(F.md5(F.lower(F.concat(subject, F.lit("::"), filename))), F.lit(12))


def chunk_id(doc: Column, index: Column) -> Column:
    """The document's key and a number of four digits or more."""
    return F.format_string("%s-%04d", doc, index)


def uuid5(name: Column) -> Column:
    """Version 5 identifier of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )
