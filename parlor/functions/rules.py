"""Ordered rules and ladders compiled to CASE expressions.

Patterns are literals in the plan, so each one compiles once per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, functions as F

from parlor.functions.text import any_case, contains_any


class Rule(NamedTuple):
    code: str
    pattern: str
    description: str = ""


class TermRule(NamedTuple):
    """Substring rule; ``only_class`` limits it to rows of one class."""

    reason: str
    terms: tuple[str, ...]
    only_class: str | None = None


def first_match(text: Column, rules: Sequence[Rule]) -> Column:
    """``struct(code, description)`` of the first rule that matches, else null."""
    return F.coalesce(
        *[
            F.when(
                text.rlike(any_case(r.pattern)),
                F.struct(F.lit(r.code).alias("code"), F.lit(r.description).alias("description")),
            )
            for r in rules
        ],
        F.lit(None).cast("struct<code:string,description:string>"),
    )


def first_class(text: Column, rules: Sequence[Rule], default: str) -> Column:
    """Class of the first matching rule, else the default."""
    return F.coalesce(*[F.when(text.rlike(any_case(r.pattern)), F.lit(r.code)) for r in rules], F.lit(default))


def keyword_hit(lowered: Column, which: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """Whether any keyword of the row's class is a substring of the (lowered) text.

    Only the keywords of the class named by ``which`` are searched for each row. Pass a column
    that already holds the lowered text: an expression would be evaluated for every keyword.
    """
    hit = None
    for name, terms in keywords.items():
        test = contains_any(lowered, terms)
        hit = F.when(which == name, test) if hit is None else hit.when(which == name, test)
    return F.lit(False) if hit is None else F.coalesce(hit.otherwise(F.lit(False)), F.lit(False))


def keyword_classes(lowered: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """Array of every class with at least one keyword in the (lowered) text, in table order."""
    return F.filter(
        F.array(*[F.when(contains_any(lowered, terms), F.lit(name)) for name, terms in keywords.items()]),
        lambda c: c.isNotNull(),
    )


def lookup(key: Column, table: Mapping[str, str], default: str | None) -> Column:
    """Small dictionary lookup as a literal map (templates or sketches per class)."""
    if not table:
        return F.lit(default)
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(literal, key), F.lit(default))


def route(
    confidence: Column,
    similarity: Column,
    which: Column,
    text: Column,
    *,
    refund_class: str,
    refund_pattern: str,
    catch_all: str,
    min_confidence: float = 0.48,
    min_similarity: float = 0.50,
    min_catch_all_similarity: float = 0.60,
) -> Column:
    """Decision ladder, first match wins: ``struct(decision, reason_code)``."""

    def step(decision: str, reason: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason_code"))

    return (
        F.when(confidence < min_confidence, step("escalate", "low_intent_confidence"))
        .when(similarity < min_similarity, step("escalate", "no_similar_precedent"))
        .when(
            (which == refund_class) & F.coalesce(text.rlike(any_case(refund_pattern)), F.lit(False)),
            step("escalate", "policy_refund_agent_only"),
        )
        .when((which == catch_all) & (similarity < min_catch_all_similarity), step("escalate", "ambiguous_intent"))
        .otherwise(step("auto_handle", "ok"))
    )


def label_ladder(
    lowered: Column,
    which: Column,
    confidence: Column,
    rules: Sequence[TermRule],
    *,
    catch_all: str,
    catch_all_confidence: float = 0.40,
) -> Column:
    """Reference label of a (lowered) message: ``struct(decision, reason)`` by substring terms."""

    def step(decision: str, reason: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))

    ladder = F.when(F.lit(False), step("", ""))
    for rule in rules:
        test = contains_any(lowered, rule.terms)
        if rule.only_class is not None:
            test = test & (which == rule.only_class)
        ladder = ladder.when(test, step("escalate", rule.reason))
    return ladder.when(
        (which == catch_all) & (confidence < catch_all_confidence), step("escalate", "ambiguous_intent")
    ).otherwise(step("auto_handle", "standard_operational_resolution"))
