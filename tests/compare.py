"""Compare a registered query with its SQL in DuckDB, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(directory: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{directory}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) and glob.glob(path + '/*') else path}'")
    return con


def _plain(value):
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        value = value.replace(tzinfo=None)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_plain(r[k]) for k in order) for r in rows)


def differences(spark, directory: str, query, sql: str) -> str:
    """Empty where both agree."""
    got = query(spark, directory)
    want = oracle(directory).execute(sql)
    names = [d[0] for d in want.description]
    if sorted(got.columns) != sorted(names):
        return f"columns {got.columns} and {names}"
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(names, want.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    return next((f"{x} and {y}" for x, y in zip(a, b, strict=True) if x != y), "")
