"""Compare registered queries with their DuckDB SQL on one set of tables."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (decimal.Decimal,)):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def kind(v) -> str:
    return "int" if type(v) is int else type(v).__name__


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is not None, str(type(x)), x) if x is not None else (False,) for x in r))


def difference(df, sql: str, con) -> str:
    """Empty if the query's rows equal those of its SQL."""
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    want = rows(columns, found.fetchall())
    got = rows(df.columns, df.collect())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    for g, w in zip(got, want):
        kinds = [(kind(a), kind(b)) for a, b in zip(g, w) if a is not None and b is not None and kind(a) != kind(b)]
        if g != w or kinds:
            return f"{len(got)} and {len(want)} rows; {g} and {w}; {kinds}"
    return "" if len(got) == len(want) else f"{len(got)} and {len(want)} rows"
