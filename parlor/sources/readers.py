"""Readers with explicit schemas; nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from parlor.sources import records, schemas


SPREAD_BYTES = 256 * 1024 * 1024


def spread(df: DataFrame, max_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Deal a small table over the session's cores.

    For files that cannot be split (one row group) and would keep most cores idle. The caller
    decides that; a table that Spark estimates above ``max_bytes`` is returned as it is.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if df.isStreaming or int(str(size)) > max_bytes:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def read_transcripts(spark: SparkSession, path: str, company: str) -> DataFrame:
    """Transcripts of one company; the filter reaches the parquet scan."""
    return spark.read.schema(schemas.TRANSCRIPTS).parquet(path).where(F.col("company") == company)


def read_tweets(
    spark: SparkSession, path: str, schema: str = schemas.TWEETS, multi_line: bool = False
) -> DataFrame:
    """Message CSV with a header and quoted text.

    ``multi_line`` is needed where texts hold line feeds; files are then read in parallel ranges too, see
    :mod:`parlor.sources.records`, and a malformed record fails the read.
    """
    if multi_line:
        parsed = records.csv_records(spark, path, schema)
        failed = F.raise_error(F.concat_ws(" ", F.lit("malformed CSV record at"), *records.POSITION)).cast("boolean")
        return records.checked(parsed.where(F.when(F.col("bad"), failed).otherwise(True)))[0]
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; a malformed line fails the read. :func:`read_checked` sets such lines aside."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_source(
    spark: SparkSession, path: str, schema: str, source_format: str | None = None, *, multi_line: bool = False
) -> DataFrame:
    """Parquet, CSV or JSON lines, by argument or by file extension."""
    chosen = source_format or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if chosen == "parquet":
        return spark.read.schema(schema).parquet(path)
    if chosen == "csv":
        return read_tweets(spark, path, schema, multi_line)
    if chosen in ("json", "jsonl"):
        return read_jsonl(spark, path, schema)
    raise ValueError(f"unknown source format: {chosen}")


def read_checked(spark: SparkSession, path: str, schema: str, source_format: str, *, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV or JSON lines source, and its malformed records ``file, range, line, record``."""
    if source_format == "csv":
        return records.checked(records.csv_records(spark, path, schema, multi_line=multi_line))
    if source_format in ("json", "jsonl"):
        return records.checked(records.json_records(spark, path, schema))
    raise ValueError(f"records of this format are not checked: {source_format}")


def first_available(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists, in order of preference."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        if hadoop_path.getFileSystem(conf).exists(hadoop_path):
            return path
    raise FileNotFoundError(f"none of these exists: {', '.join(paths)}")


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CENTROIDS).parquet(path)
