"""Model answers as a table: lookup by prompt key, prompts still to be asked, class override.

No network call is made. A prompt without a stored answer gets the empty answer, which sends
every consumer down its deterministic path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parlor.functions import text as T
from parlor.operators.once import evaluate_once
from parlor.operators.skew import PROBE_MIN_ROWS, PROBE_SHARE, salted_join


def with_response_key(df: DataFrame, prompt: Column, system_text: Column, model: Column) -> DataFrame:
    """Add ``prompt`` and its ``cache_key``."""
    return evaluate_once(df.withColumn("prompt", prompt), {"cache_key": T.response_key(model, system_text, F.col("prompt"))})


def stored_answers(responses: DataFrame) -> DataFrame:
    """One answer per key."""
    return responses.groupBy("cache_key").agg(F.min("response").alias("response"))


def lookup_responses(
    df: DataFrame, responses: DataFrame, salt_by: Column, probe: DataFrame | None = None
) -> DataFrame:
    """Add ``response``; the empty string where none is stored.

    Copies of one message share a key, so the join is salted against hot keys. ``probe`` gives
    the keys to look for hot ones in (default: a hundredth of ``df``); pass one where computing
    ``df`` twice would be costly.
    """
    probe = df.sample(PROBE_SHARE, seed=42).select("cache_key") if probe is None else probe
    found = salted_join(
        df, stored_answers(responses), ["cache_key"], "left", salt_by, probe=probe, min_rows=PROBE_MIN_ROWS
    )
    return found.withColumn("response", F.coalesce("response", F.lit("")))


def pending_prompts(df: DataFrame, responses: DataFrame) -> DataFrame:
    """Distinct prompts without a stored answer: ``(cache_key, prompt, requests)``.

    Copies are combined inside the map tasks before any shuffle.
    """
    wanted = df.groupBy("cache_key").agg(F.min("prompt").alias("prompt"), F.count("*").alias("requests"))
    return wanted.join(responses.select("cache_key").distinct(), "cache_key", "left_anti")


def class_override(
    needs_fallback: Column, response: Column, which: Column, confidence: Column, classes: Sequence[str]
) -> Column:
    """``struct(class, confidence, verified)`` after a stored class answer.

    The answer counts only where the classifier asked for it and it names a class of the taxonomy.
    """
    answer = T.class_answer(response)
    accepted = F.coalesce(needs_fallback & answer.isin(list(classes)), F.lit(False))
    return F.struct(
        F.when(accepted, answer).otherwise(which).alias("class"),
        F.when(accepted, F.greatest(confidence, F.lit(0.75))).otherwise(confidence).alias("confidence"),
        accepted.alias("verified"),
    )
