"""Nearest-centroid classification with keyword reinforcement, and keyword baselines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parlor import defaults as D
from parlor.functions import rules as R, scoring as S, text as T
from parlor.operators.vectors import ranked_scores

def nearest_centroid(
    df: DataFrame,
    text_col: str,
    vector_col: str,
    table: Sequence[tuple[str, Sequence[float]]],
    *,
    keywords: Mapping[str, Sequence[str]] = D.KEYWORDS,
    catch_all: str = D.CATCH_ALL,
    threshold: float = 0.48,
) -> DataFrame:
    """Add ``class, confidence, margin, needs_fallback, keyword_boosted, class_scores``.

    Scores are the cosine to each centroid. Blank text, or a missing vector, gives the
    catch-all class at confidence 0 and no boost flag. Map-only, also on a stream.
    """
    text = F.col(text_col)
    blank = F.coalesce(T.strip(text) == "", F.lit(True))
    names = F.array(*[F.lit(c) for c, _ in table])
    scored = df.withColumn("_r", ranked_scores(F.when(~blank, F.col(vector_col)), table)).withColumn("_lower", F.lower(text))
    scores, order = F.col("_r.scores"), F.col("_r.best")

    def place(i: int) -> Column:
        ordinal = F.get(order, F.lit(i))
        return F.struct(
            F.get(scores, ordinal).alias("score"), ordinal.alias("ordinal"), F.get(names, ordinal).alias("class")
        )

    top, second = place(0), place(1)
    best = S.boosted(
        top,
        second,
        R.keyword_hit(F.col("_lower"), top["class"], keywords),
        R.keyword_hit(F.col("_lower"), second["class"], keywords),
        threshold=threshold,
    )
    margin = top["score"] - second["score"]
    known = scores.isNotNull()
    listed = F.transform(
        order, lambda o: F.struct(F.get(names, o).alias("class"), S.half_even(F.get(scores, o), 4).alias("score"))
    )
    nothing = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(0.0).alias("score")) for c, _ in table])
    return (
        scored.withColumn("_best", F.when(known, best))
        .withColumns(
            {
                "class": F.coalesce(F.col("_best.class"), F.lit(catch_all)),
                "confidence": F.coalesce(S.half_even(F.col("_best.score"), 4), F.lit(0.0)),
                "margin": F.coalesce(S.half_even(margin, 4), F.lit(0.0)),
                "needs_fallback": F.coalesce(S.needs_fallback(F.col("_best.score"), margin, threshold), F.lit(True)),
                "keyword_boosted": F.col("_best.boosted"),
                "class_scores": F.coalesce(listed, nothing),
            }
        )
        .drop("_r", "_best", "_lower")
    )


def keyword_baseline(
    df: DataFrame,
    text_col: str,
    *,
    class_rules: Sequence[R.Rule] = D.CLASS_RULES,
    escalate_pattern: str = D.ESCALATE_PATTERN,
    templates: Mapping[str, str] | None = None,
    catch_all: str = D.CATCH_ALL,
    default_reply: str = D.GENERIC_REPLY,
) -> DataFrame:
    """First-rule class, static reply per class, escalation by one pattern."""
    classified = df.withColumn("class", R.first_class(F.col(text_col), class_rules, catch_all))
    escalate = T.matches(F.col(text_col), escalate_pattern)
    return classified.withColumns(
        {
            "confidence": F.when(F.col("class") != catch_all, F.lit(0.70)).otherwise(F.lit(0.40)),
            "decision": F.when(escalate, F.lit("escalate")).otherwise(F.lit("auto_handle")),
            "reason_code": F.when(escalate, F.lit("rule_keyword_escalation")).otherwise(F.lit("rule_keyword_autohandle")),
            "best_similarity": F.lit(0.0),
            "draft_reply": R.lookup(F.col("class"), templates or {}, default_reply),
        }
    )


def constant_baseline(
    df: DataFrame, *, catch_all: str = D.CATCH_ALL, default_reply: str = D.GENERIC_REPLY
) -> DataFrame:
    """The same answer for every message."""
    return df.withColumns(
        {
            "class": F.lit(catch_all),
            "confidence": F.lit(0.50),
            "decision": F.lit("auto_handle"),
            "reason_code": F.lit("trivial_always_autohandle"),
            "best_similarity": F.lit(0.0),
            "draft_reply": F.lit(default_reply),
        }
    )
