"""Compare a Spark result with DuckDB SQL over the same parquet tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return "null" if value is None else f"{type(value).__name__}:{value}"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """Empty when columns and rows agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = _rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns differ: spark {sorted(df.columns)} sql {sorted(names)}"]
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if actual == expected:
        return []
    only_spark, only_sql = set(actual) - set(expected), set(expected) - set(actual)
    return [
        f"rows: spark {len(actual)} sql {len(expected)}; only spark {len(only_spark)}, only sql {len(only_sql)}",
        *[f"spark {str(r)[:400]}" for r in sorted(only_spark)[:2]],
        *[f"sql   {str(r)[:400]}" for r in sorted(only_sql)[:2]],
    ]
