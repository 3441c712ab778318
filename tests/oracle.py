"""Compare a query's rows with its SQL's rows in DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(table, columns: list[str]) -> list[tuple]:
    return sorted(zip(*(table.column(c).to_pylist() for c in columns), strict=True), key=repr)


def same(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    mine, want = df.toArrow(), con.execute(sql).to_arrow_table()
    assert sorted(mine.column_names) == sorted(want.column_names)
    columns = sorted(mine.column_names)
    assert rows(mine, columns) == rows(want, columns)
