"""Runs registered queries next to their SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def differences(df, relation):
    """What tells the two results apart, or nothing."""
    cols = sorted(df.columns)
    if cols != sorted(relation.columns):
        return f"columns {cols} and {sorted(relation.columns)}"
    at = [relation.columns.index(c) for c in cols]
    key = lambda row: tuple((x is not None, str(round(x, 5)) if isinstance(x, float) else str(x)) for x in row)
    ours = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    theirs = sorted((tuple(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i] for i in at) for r in relation.fetchall()), key=key)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    same = lambda x, y: (x is None) == (y is None) and (x is None or (math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) if isinstance(x, float) or isinstance(y, float) else x == y))
    off = [(a, b) for a, b in zip(ours, theirs, strict=True) if not all(map(same, a, b))]
    return f"{len(off)} of {len(ours)} rows differ, as {off[0]}" if off else ""
