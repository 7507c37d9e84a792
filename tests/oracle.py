"""Comparison of a query's rows with DuckDB's on the same tables."""

import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}") + 0.0
    if hasattr(v, "isoformat"):
        return str(v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
