"""Run queries next to their SQL on the same tables and compare the rows exactly."""

from __future__ import annotations

import math
import os

import duckdb

# Compare doubles to the last bit instead of 12 digits.
EXACT = os.environ.get("HOLDFAST_EXACT") == "1"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def _value(v):
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (v if EXACT else float(f"{v:.12g}"))
    return v


def _key(row):
    return tuple((v is None, str(type(v).__name__ in ("int", "float")), repr(v)) for v in row)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted((tuple(_value(r[i]) for i in order) for r in rows), key=_key))


def compare(db, df, sql: str) -> str | None:
    """None when equal, else a short account of the first difference."""
    result = db.execute(sql)
    want_cols, want = normal([d[0] for d in result.description], result.fetchall())
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    if want_cols != got_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(want) != len(got):
        return f"{len(got)} rows, SQL has {len(want)}; first {got[:2]} / {want[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return None


def folder(default: str = "/root/testdata/sf0.001") -> str:
    return os.environ.get("HOLDFAST_SF_DIR", default)
