"""Writers. Each call is one action over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def nested_as_json(df: DataFrame, column: str = "raw_turns", output: str = "raw_turns_json") -> DataFrame:
    """Replace a nested column by its JSON text."""
    return df.withColumn(output, F.to_json(F.col(column), {"ignoreNullFields": "false"})).drop(column)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines in UTF-8; null fields are kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_report_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small report table as one CSV file with a header (one row per system)."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def report_json(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """Nested report: one JSON line per key with the given nested columns."""
    body = F.struct(F.col(key), *[value.alias(name) for name, value in fields.items()])
    return df.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def write_report_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text sink for :func:`report_json` lines (one per system)."""
    df.coalesce(1).write.mode(mode).text(path)


def write_centroids(centroids: DataFrame, classes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Centroid vectors and, next to them, the class table with ordinals and descriptions."""
    centroids.write.mode(mode).parquet(f"{path}/centroids")
    classes.write.mode(mode).parquet(f"{path}/classes")
