"""Labelled evaluation set: hold-out, length band, unused and distinct texts, quotas, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from parlor import defaults as D
from parlor.functions import rules as R, text as T
from parlor.operators.evalsets import held_out
from parlor.operators.sampling import first_per_digest, quota_sample, with_shuffle_rank


def build_labelled_set(
    threads: DataFrame,
    corpus: DataFrame,
    fixed_cases: DataFrame,
    *,
    quotas: Mapping[str, int] = D.QUOTAS,
    label_terms: Sequence[R.TermRule] = D.LABEL_TERMS,
    sketches: Mapping[str, str] | None = None,
    default_sketch: str | None = None,
    catch_all: str = D.CATCH_ALL,
    shortest: int = 20,
    longest: int = 300,
    seed: int = 42,
    id_prefix: str = "gold",
    annotator: str = "Human-Author",
) -> DataFrame:
    """Fixed cases first, then the quota sample, numbered in order of acceptance.

    ``threads`` has ``thread_id, customer_message, class, confidence``; ``fixed_cases`` has
    ``position`` (from 1) and the label columns.
    """
    fixed_count = fixed_cases.agg(F.count("*").alias("n")).scalar()
    pool = held_out(threads, corpus, "thread_id").withColumn("customer_message", T.strip(F.col("customer_message")))
    pool = pool.where(F.length("customer_message").between(shortest, longest))
    # Copies go first: what is left has one row per text, so the next join knows no hot text, and
    # it joins on the digest the rows are already partitioned by.
    digest = T.digest(T.text_key(F.col("customer_message"))).alias("_digest")
    distinct = first_per_digest(pool.withColumn("_digest", digest), "_digest", "thread_id", seed)
    unused = distinct.join(fixed_cases.select(digest).distinct(), "_digest", "left_anti").drop("_digest")
    drawn = with_shuffle_rank(quota_sample(unused, "class", quotas, "thread_id", seed), "thread_id", seed, name="_rank")
    ladder = R.label_ladder(
        F.col("_lower"), F.col("class"), F.col("confidence"), label_terms, catch_all=catch_all
    )
    sampled = drawn.withColumn("_lower", F.lower("customer_message")).withColumn("_label", ladder).select(
        T.numbered_id(id_prefix, F.col("_rank") + fixed_count).alias("example_id"),
        F.col("thread_id").cast("string").alias("thread_id"),
        "customer_message",
        F.col("class").alias("gold_class"),
        F.col("_label.decision").alias("gold_decision"),
        F.col("_label.reason").alias("gold_reason"),
        R.lookup(F.col("class"), sketches or {}, default_sketch).alias("must_contain"),
        F.lit(False).alias("is_adversarial"),
    )
    fixed = fixed_cases.select(
        T.numbered_id(id_prefix, F.col("position")).alias("example_id"),
        F.concat(F.lit("adv_"), F.format_string("%03d", F.col("position").cast("long"))).alias("thread_id"),
        "customer_message",
        "gold_class",
        "gold_decision",
        "gold_reason",
        "must_contain",
        F.lit(True).alias("is_adversarial"),
        "adversarial_type",
    )
    return fixed.unionByName(sampled, allowMissingColumns=True).withColumn("annotator", F.lit(annotator))
