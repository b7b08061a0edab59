"""From raw documents to a training mix: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parlor.llm.common import durable
from parlor.llm.decontaminate import drop_contaminated
from parlor.llm.exact_dedup import drop_copies
from parlor.llm.language_id import keep_identified
from parlor.llm.mixing import take_mix
from parlor.llm.queries import load
from parlor.llm.simhash import one_per_group
from parlor.llm.similar import similar_groups

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents without an identified language; see ``parlor.llm.language_id``."""
    return keep_identified(docs, declared=F.col("lang"), host=F.col("source"))


def copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps one of each group of equal texts; see ``parlor.llm.exact_dedup``."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps one of each group of texts with a similarity of 0.8 or more; see ``parlor.llm.similar``."""
    return one_per_group(docs, groups=similar_groups)


def benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents that hold a benchmark item; see ``parlor.llm.decontaminate``."""
    return drop_contaminated(docs, load(spark, folder, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents of the mix with the times each is taken; see ``parlor.llm.mixing``."""
    return take_mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("exact_dedup", copies),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark),
    ("source_mixing", mixture),
]

#: Language models, fingerprints and edit matching have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again for the next."""
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, name)
    return docs
