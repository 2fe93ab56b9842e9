"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(db, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = db.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), rows_of(columns, cursor.fetchall())


def differences(ours, theirs) -> str | None:
    (our_columns, our_rows), (their_columns, their_rows) = ours, theirs
    if our_columns != their_columns:
        return f"columns {our_columns} against {their_columns}"
    if our_rows != their_rows:
        only_ours = [r for r in our_rows if r not in set(map(tuple, their_rows))][:3]
        only_theirs = [r for r in their_rows if r not in set(map(tuple, our_rows))][:3]
        return f"{len(our_rows)} against {len(their_rows)} rows; ours {only_ours}; theirs {only_theirs}"
    return None
