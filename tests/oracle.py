"""Spark rows against DuckDB rows on one folder of tables."""

from pathlib import Path

import duckdb


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def same(spark, sf: str, query, sql: str) -> None:
    df = query(spark, sf)
    found = duck(sf).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found.fetchall())
