"""Score arithmetic: keyword boost, fallback flag, ranking score, reply choice, rubric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from parlor import defaults as D
from parlor.functions.text import contains_any, strip


def half_even(value: Column, digits: int) -> Column:
    """Round with exact ties going to the even digit."""
    return F.bround(value, digits)


def ratio(part: Column, whole: Column) -> Column:
    """Quotient, 0 on a zero denominator."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def boosted(
    top: Column,
    second: Column,
    top_hit: Column,
    second_hit: Column,
    *,
    threshold: float = 0.48,
    top_boost: float = 0.08,
    second_boost: float = 0.12,
) -> Column:
    """Keyword reinforcement of the two best classes.

    ``top`` and ``second`` are ``struct(score, ordinal, class)``. Classes count in taxonomy
    order, so whether the runner-up is looked at before or after the winner's own boost
    depends on the two ordinals. Returns ``struct(class, score, boosted)``.
    """

    def result(which: Column, score: Column, flag: bool) -> Column:
        return F.struct(which.alias("class"), score.alias("score"), F.lit(flag).alias("boosted"))

    s1, s2 = top["score"], second["score"]
    raised = F.least(F.lit(1.0), s1 + top_boost)
    overtaken = result(second["class"], F.least(F.lit(1.0), s2 + second_boost), True)
    winner_first = second["ordinal"].isNull() | (top["ordinal"] < second["ordinal"])
    after_own_boost = F.when(top_hit, raised).otherwise(s1)
    overtakes = second_hit & F.when(winner_first, after_own_boost < threshold).otherwise(s1 < threshold)
    return (
        F.when(F.coalesce(overtakes, F.lit(False)), overtaken)
        .when(top_hit, result(top["class"], raised, True))
        .otherwise(result(top["class"], s1, False))
    )


def needs_fallback(score: Column, margin: Column, threshold: float = 0.48) -> Column:
    """Low score after boosting, or a thin raw margin below 0.60."""
    return (score < threshold) | ((margin < 0.04) & (score < 0.60))


def ranking_score(
    similarity: Column,
    match_class: Column,
    predicted: Column,
    is_boilerplate: Column,
    *,
    catch_all: str,
    class_boost: float = 0.05,
    boilerplate_penalty: float = 0.03,
) -> Column:
    same = F.coalesce((match_class == predicted) & (predicted != catch_all), F.lit(False))
    score = similarity + F.when(same, F.lit(class_boost)).otherwise(F.lit(0.0))
    penalised = score - F.lit(boilerplate_penalty)
    return F.when(F.coalesce(is_boilerplate, F.lit(False)), penalised).otherwise(score)


def choose_reply(matches: Column, template: Column, min_length: int = 25) -> Column:
    """The first precedent's reply if long enough and not boilerplate, else the template."""
    first = F.get(matches, F.lit(0))
    usable = (F.length(first["reply"]) > min_length) & ~first["is_boilerplate"]
    return F.when(F.coalesce(usable, F.lit(False)), first["reply"]).otherwise(template)


def precedent_snippets(matches: Column, k: int = 3) -> Column:
    """Numbered reply lines of the first k precedents."""
    lines = F.transform(
        F.slice(matches, 1, k),
        lambda m, i: F.concat(
            F.lit("Precedent "), (i + 1).cast("string"), F.lit(': "'), m["reply"], F.lit('"')
        ),
    )
    return F.concat_ws("\n", lines)


def draft_prompt(which: Column, message: Column, snippets: Column) -> Column:
    return F.concat(
        F.lit("Class: "), which, F.lit('\nMessage: "'), message, F.lit('"\n\nPrecedents:\n'), snippets,
        F.lit("\n\nReply:"),
    )


def judge_prompt(message: Column, sketch: Column, precedent: Column, reply: Column) -> Column:
    """Prompt that asks a judge to score one reply."""
    return F.concat(
        F.lit('Message: "'), message, F.lit('"\nMust contain: "'), F.coalesce(sketch, F.lit("")),
        F.lit('"\nPrecedent: "'), F.coalesce(precedent, F.lit("None")), F.lit('"\nReply: "'), reply,
        F.lit('"\n\nScores as JSON:'),
    )


def rubric(
    reply: Column,
    decision: Column,
    *,
    contact_terms: Sequence[str] = D.RUBRIC_CONTACT_TERMS,
    empathy_terms: Sequence[str] = D.RUBRIC_EMPATHY_TERMS,
    money_term: str = D.RUBRIC_MONEY_TERM,
    generic_reply: str = D.GENERIC_REPLY,
    lowered: Column | None = None,
) -> Column:
    """Deterministic reply score on four dimensions; escalated rows score null.

    ``lowered`` is a column with the lowered reply, to lower long replies once only.
    """
    lowered = F.lower(reply) if lowered is None else lowered
    money = reply.contains("$") | lowered.contains(money_term)
    short = F.length(reply) < 30
    contact = contains_any(lowered, contact_terms)
    empathy = contains_any(lowered, empathy_terms)
    generic = reply == generic_reply

    def less(amount: float, when: Column) -> Column:
        return F.when(when, F.lit(-amount)).otherwise(F.lit(0.0))

    def plus_half(score: Column, when: Column) -> Column:
        return F.when(when, F.least(F.lit(5.0), score + 0.5)).otherwise(score)

    base = F.lit(4.0)
    scores = {
        "groundedness": base + less(2.0, money),
        "correctness": plus_half(base + less(1.5, money), contact),
        "tone_empathy": plus_half(base + less(1.0, short), empathy),
        "completeness": plus_half(base + less(1.5, short), contact),
    }
    # The scores of the one generic reply.
    generic_scores = {"groundedness": 2.5, "correctness": 3.0, "tone_empathy": 3.0, "completeness": 2.5}
    applicable = decision != "escalate"
    final = {
        name: F.when(applicable, F.when(generic, F.lit(generic_scores[name])).otherwise(score))
        for name, score in scores.items()
    }
    overall = half_even((final["groundedness"] + final["correctness"] + final["tone_empathy"] + final["completeness"]) / 4.0, 2)
    return F.struct(
        applicable.alias("is_applicable"),
        *[score.alias(name) for name, score in final.items()],
        overall.alias("overall"),
        F.when(applicable, F.lit("heuristic")).alias("judge_type"),
    )


JUDGE_ANSWER_SCHEMA = (
    "groundedness string, correctness string, tone_empathy string, completeness string, justification string"
)


def judged(answer: Column, reply: Column, decision: Column, **rubric_options) -> Column:
    """Scores parsed from a judge's JSON answer, else the deterministic rubric.

    Code fences are removed first. All four scores must be numeric.
    """
    body = F.replace(F.replace(strip(answer), F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    parsed = F.from_json(body, JUDGE_ANSWER_SCHEMA)
    names = ["groundedness", "correctness", "tone_empathy", "completeness"]
    scores = [parsed[n].try_cast("double") for n in names]
    usable = decision != "escalate"
    for score in scores:
        usable = usable & score.isNotNull()
    overall = half_even((scores[0] + scores[1] + scores[2] + scores[3]) / 4.0, 2)
    from_answer = F.struct(
        F.lit(True).alias("is_applicable"),
        *[s.alias(n) for s, n in zip(scores, names)],
        overall.alias("overall"),
        F.lit("llm").alias("judge_type"),
    )
    return F.when(F.coalesce(usable, F.lit(False)), from_answer).otherwise(rubric(reply, decision, **rubric_options))
