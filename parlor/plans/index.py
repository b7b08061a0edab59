"""Train centroids and build the retrieval corpus from text tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from parlor import defaults as D
from parlor.operators.retrieve import build_corpus, sample_threads
from parlor.operators.threads import long_enough
from parlor.operators.vectors import centroid_list, centroids
from parlor.sources import writers

# Adds a vector column to a table: (table, text column, vector column) -> table.
Encode = Callable[[DataFrame, str, str], DataFrame]


def train_centroids(seeds: DataFrame, classes: DataFrame, encode: Encode, path: str) -> DataFrame:
    """Encode the seed texts ``(class, text)``, write centroids and class table, return the centroids."""
    table = centroids(encode(seeds, "text", "_vector"), "class", "_vector")
    writers.write_centroids(table, classes, path)
    return seeds.sparkSession.read.parquet(f"{path}/centroids")


def build_index(
    threads: DataFrame,
    table: DataFrame,
    encode: Encode,
    path: str,
    *,
    classes: Sequence[str] = D.CLASSES,
    max_items: int | None = None,
    min_length: int = 12,
    seed: int = 42,
    keywords: Mapping[str, Sequence[str]] = D.KEYWORDS,
    catch_all: str = D.CATCH_ALL,
) -> DataFrame:
    """Encode and classify the threads, write the corpus with its vectors, return it.

    A sample of ``max_items``, if one is asked for, is drawn before the encoder runs.
    """
    valid = long_enough(threads, ["customer_message", "agent_reply"], min_length)
    chosen = encode(valid if max_items is None else sample_threads(valid, max_items, seed), "customer_message", "embedding")
    corpus = build_corpus(
        chosen, centroid_list(table, classes), min_length=min_length, seed=seed,
        keywords=keywords, catch_all=catch_all,
    )
    writers.write_parquet(corpus, path)
    return threads.sparkSession.read.parquet(path)
