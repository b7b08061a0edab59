"""Triage of arriving messages: the batch plan on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from parlor.session import checkpoint_root


def stream_triage(
    spark: SparkSession,
    source_path: str,
    schema: str,
    plan: Callable[[DataFrame], DataFrame],
    output_path: str,
    *,
    query_name: str = "triage",
    max_files_per_trigger: int = 1000,
    available_now: bool = True,
) -> StreamingQuery:
    """Apply a stateless plan (such as ``triage``) to each arriving parquet file.

    No state is kept and nothing is shuffled; the file sink and the checkpoint in the shared
    folder give exactly-once output.
    """
    arriving = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_path)
    )
    writer = (
        plan(arriving)
        .writeStream.queryName(query_name)
        .outputMode("append")
        .format("parquet")
        .option("path", output_path)
        .option("checkpointLocation", f"{checkpoint_root(spark).rstrip('/')}/{query_name}")
    )
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
