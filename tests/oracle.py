"""Runs a query and its SQL on the same tables and compares them as bags of rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def norm(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def bag(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, sf_dir: str) -> tuple[int, str]:
    """(rows, "" or what differs)."""
    names, rows = sql_rows(sql, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(names):
        return len(got), f"columns {sorted(df.columns)} {sorted(names)}"
    a, b = bag(df.columns, got), bag(names, rows)
    if a == b:
        return len(a), ""
    return len(a), f"{len(a)} rows, SQL has {len(b)}; first difference {next(((x, y) for x, y in zip(a, b, strict=False) if x != y), 'none in common part')}"
