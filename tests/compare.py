"""Run a query and its SQL counterpart and compare the results."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(([_plain(r[i]) for i in order] for r in rows), key=lambda r: [str(v) for v in r])


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """First difference in names, types or values; None when all agree."""
    result = con.execute(sql)
    oracle_types = {d[0]: str(d[1]) for d in result.description}
    names, expected = _rows([d[0] for d in result.description], result.fetchall())
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if names != got_names:
        return f"columns: expected {names}, got {got_names}"
    types = {c: KINDS.get(t, t) for c, t in df.dtypes}
    if types != oracle_types:
        return "types: " + ", ".join(f"{c} {types[c]} vs {oracle_types[c]}" for c in names if types[c] != oracle_types[c])
    if len(got) != len(expected):
        return f"rows: expected {len(expected)}, got {len(got)}"
    for a, b in zip(expected, got):
        if a != b:
            return f"values: expected {a}, got {b} (columns {names})"
    return None
