"""Size check in front of control tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

MAX_CONTROL_ROWS = 10_000


def control_rows(df: DataFrame, max_rows: int = MAX_CONTROL_ROWS) -> list[Row]:
    """Rows of a small control table (rules, quotas, classes); larger input is refused."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"control table has more than {max_rows} rows")
    return rows
