"""Triage of messages: hard rules, classification, retrieval, routing, reply."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parlor import defaults as D
from parlor.functions import rules as R, scoring as S, text as T
from parlor.operators.classify import nearest_centroid
from parlor.operators.responses import class_override, lookup_responses, with_response_key
from parlor.operators.retrieve import retrieve
from parlor.operators.skew import PROBE_SHARE
from parlor.session import durable

OUTPUT = [
    "customer_message", "class", "confidence", "decision", "reason_code", "best_similarity",
    "grounding_ids", "draft_reply", "trace",
]


def class_prompt(message: Column) -> Column:
    """Prompt that asks for the class of one message."""
    return F.concat(F.lit('Customer message: "'), message, F.lit('"\nClass:'))


def triage(
    messages: DataFrame,
    corpus: DataFrame,
    table: Sequence[tuple[str, Sequence[float]]],
    *,
    id_col: str,
    text_col: str,
    vector_col: str = "embedding",
    hard_rules: Sequence[R.Rule] = D.HARD_RULES,
    keywords: Mapping[str, Sequence[str]] = D.KEYWORDS,
    templates: Mapping[str, str] | None = None,
    default_reply: str = D.GENERIC_REPLY,
    hard_rule_reply: str = D.HARD_RULE_REPLY,
    refund_class: str = D.REFUND_CLASS,
    refund_pattern: str = D.REFUND_PATTERN,
    catch_all: str = D.CATCH_ALL,
    min_confidence: float = 0.48,
    min_similarity: float = 0.50,
    min_catch_all_similarity: float = 0.60,
    top_k: int = 3,
    class_answer_col: str | None = None,
    classes: Sequence[str] = D.CLASSES,
    responses: DataFrame | None = None,
    model: str = "offline",
    class_system_text: str = "",
    reply_system_text: str = "",
    exclude_same_id: bool = False,
    max_broadcast_bytes: int = 64 * 1024 * 1024,
) -> DataFrame:
    """One decision row per message.

    With a corpus within the broadcast bound and no ``responses`` the whole plan is map-only, so the same
    function runs on a stream; stored ``responses`` are looked up in a stored intermediate and need a table. A row that hits a hard rule is hidden from the retrieval.
    ``class_answer_col`` names a column with a stored class answer for unsure rows. Alternatively
    ``responses`` is a table of stored answers: it is joined by prompt key, first for the class
    of unsure rows and then for the reply of every row without a rule hit. An answer that is not
    stored leaves the deterministic result in place.
    """
    prepared = messages.withColumns(
        {"customer_message": T.strip(F.coalesce(F.col(text_col), F.lit("")))}
    ).withColumn("_rule", R.first_match(F.col("customer_message"), hard_rules))
    classified = nearest_centroid(
        prepared, "customer_message", vector_col, table, keywords=keywords, catch_all=catch_all, threshold=min_confidence
    )
    if responses is not None:
        asked = F.when(F.col("needs_fallback"), class_prompt(F.col("customer_message")))
        keyed = with_response_key(classified, asked, F.lit(class_system_text), F.lit(model))
        # Hot prompts are those of often copied messages, which the input alone tells.
        few = prepared.select("customer_message").sample(PROBE_SHARE, seed=42)
        probe = with_response_key(few, class_prompt(F.col("customer_message")), F.lit(class_system_text), F.lit(model))
        class_answer_col = "_class_answer"
        classified = lookup_responses(keyed, responses, F.col(id_col), probe.select("cache_key")).withColumnRenamed(
            "response", class_answer_col
        )
        classified = classified.drop("prompt", "cache_key")
    if class_answer_col is not None:
        decided = class_override(
            F.col("needs_fallback"), F.col(class_answer_col), F.col("class"), F.col("confidence"), classes
        )
        classified = (
            classified.withColumn("_override", decided)
            .withColumns({"class": F.col("_override.class"), "confidence": F.col("_override.confidence")})
            .drop("_override")
        )
    # What is read below and no more, since a search beyond the broadcast bound stores and joins these rows.
    searchable = classified.select(
        id_col, *[c for c in ("customer_message", "class", "confidence", "margin", "class_scores", "_rule") if c != id_col],
        F.when(F.col("_rule").isNull(), F.col(vector_col)).alias("_query"),
    )
    grounded = retrieve(
        searchable,
        corpus,
        query_id=id_col,
        class_col="class",
        vector_col="_query",
        top_k=top_k,
        catch_all=catch_all,
        exclude_same_id=exclude_same_id,
        max_broadcast_bytes=max_broadcast_bytes,
        # The draft is the first precedent's reply; prompts quote more.
        replies=1 if responses is None else None,
    )
    hit = F.col("_rule").isNotNull()
    stored_reply = F.lit("")
    if responses is not None:
        asked = S.draft_prompt(F.col("class"), F.col("customer_message"), S.precedent_snippets(F.col("matches")))
        # Stored, since the hot prompts are looked for before the join.
        keyed = durable(with_response_key(grounded, F.when(~hit, asked), F.lit(reply_system_text), F.lit(model)))
        grounded = lookup_responses(keyed, responses, F.col(id_col)).withColumnRenamed("response", "_reply_answer")
        stored_reply = F.col("_reply_answer")
    route = R.route(
        F.col("confidence"),
        F.col("best_similarity"),
        F.col("class"),
        F.col("customer_message"),
        refund_class=refund_class,
        refund_pattern=refund_pattern,
        catch_all=catch_all,
        min_confidence=min_confidence,
        min_similarity=min_similarity,
        min_catch_all_similarity=min_catch_all_similarity,
    )
    ruled = F.struct(F.lit("escalate").alias("decision"), F.col("_rule.code").alias("reason_code"))
    template = R.lookup(F.col("class"), templates or {}, default_reply)
    trace = F.struct(
        F.when(hit, F.lit("hard_rules")).otherwise(F.lit("heuristic_model")).alias("layer"),
        F.col("_rule.description").alias("hard_rule_description"),
        F.when(~hit, F.size("matches")).alias("retrieval_matches_count"),
        F.when(~hit, F.col("margin")).alias("intent_margin"),
        F.col("class_scores"),
    )
    routed = grounded.withColumn("_route", F.when(hit, ruled).otherwise(route)).withColumns(
        {
            "decision": F.col("_route.decision"),
            "reason_code": F.col("_route.reason_code"),
            "draft_reply": F.when(hit, F.lit(hard_rule_reply))
            .when(stored_reply != "", T.strip_quotes(stored_reply))
            .otherwise(S.choose_reply(F.col("matches"), template)),
            "trace": trace,
        }
    )
    return routed.select(id_col, *OUTPUT)
