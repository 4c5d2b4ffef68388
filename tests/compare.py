"""Holds a Spark result against a DuckDB result: the same columns by name, the same rows each as often."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v: object) -> object:
    """A value in a form that both engines agree on."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float | decimal.Decimal):
        x = float(v)
        return x if math.isinf(x) else float(f"{x:.12g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows(columns: list[str], data: list[tuple]) -> Counter:
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in at) for r in data)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs; empty if nothing does."""
    got = df.collect()
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types, strict=True)}
    for c, k in df.dtypes:
        ours = "number" if k.startswith(("tinyint", "smallint", "int", "bigint")) else "float" if k.startswith(("float", "double", "decimal")) else k
        theirs = "number" if "INT" in kinds[c] else "float" if kinds[c].startswith(("DOUBLE", "FLOAT", "DECIMAL")) else kinds[c]
        if {ours, theirs} == {"number", "float"}:
            return f"{c} is {k} and {kinds[c]}"
    a, b = rows(df.columns, [tuple(r) for r in got]), rows(rel.columns, rel.fetchall())
    if a == b:
        return ""
    x, y = list((a - b).items())[:3], list((b - a).items())[:3]
    return f"{a.total()} and {b.total()} rows, {(a - b).total()} differ: {x} against {y}"
