"""Thread ingestion from transcripts or from reply edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from parlor.operators.sampling import sample_n
from parlor.operators.threads import profile, reply_pairs, threads_from_transcripts
from parlor.sources import readers, writers


def ingest_transcripts(
    spark: SparkSession, path: str, company: str, *, handles: Sequence[str] = (), max_threads: int | None = None, seed: int = 42
) -> DataFrame:
    threads = threads_from_transcripts(
        readers.read_transcripts(spark, path, company), "conversation_id", "conversation", handles=handles
    )
    return sample_n(threads, max_threads, "thread_id", seed) if max_threads else threads


def ingest_tweets(
    spark: SparkSession, path: str, brand: str, *, handles: Sequence[str] = (), max_threads: int | None = None, seed: int = 42,
    multi_line: bool = False,
) -> DataFrame:
    """Reply pairs of a brand. Several replies to one message share its ``thread_id``; a sample
    is drawn over (thread, reply text)."""
    threads = reply_pairs(readers.read_tweets(spark, path, multi_line=multi_line), brand, handles=handles or [brand])
    if not max_threads:
        return threads
    keyed = threads.withColumn("_row", F.concat_ws("\u0001", "thread_id", "customer_message", "agent_reply"))
    return sample_n(keyed, max_threads, "_row", seed).drop("_row")


def run_ingest(
    spark: SparkSession,
    source: str | Sequence[str],
    brand: str,
    output_parquet: str,
    output_jsonl: str,
    *,
    handles: Sequence[str] = (),
    max_threads: int | None = None,
    seed: int = 42,
    multi_line: bool = False,
) -> DataFrame:
    """Read (the first available of) the sources, write both sinks, return the summary.

    All threads are kept unless a sample of ``max_threads`` is asked for. ``multi_line`` concerns CSV only. The
    input is parsed once: the JSON lines are written from the Parquet table.
    """
    path = source if isinstance(source, str) else readers.first_available(spark, source)
    options = dict(handles=handles, max_threads=max_threads, seed=seed)
    if path.rstrip("/").endswith(".parquet"):
        threads = ingest_transcripts(spark, path, brand, **options)
    else:
        threads = ingest_tweets(spark, path, brand, multi_line=multi_line, **options)
    writers.write_parquet(writers.nested_as_json(threads), output_parquet)
    stored = spark.read.parquet(output_parquet)
    turns = F.from_json("raw_turns_json", threads.schema["raw_turns"].dataType).alias("raw_turns")
    writers.write_jsonl(stored.select(*[turns if c == "raw_turns" else c for c in threads.columns]), output_jsonl)
    return profile(stored)
