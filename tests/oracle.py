"""Holds a query's rows against DuckDB's for its SQL."""

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(spark, data, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{data}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    expected = Counter(tuple(map(repr, r)) for r in found.fetchall())
    df = query(spark, data)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(repr(r[c]) for c in names) for r in df.collect()) == expected
