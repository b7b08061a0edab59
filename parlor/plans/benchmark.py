"""Benchmark of several systems over an evaluation set, with report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from parlor.functions import scoring as S, text as T
from parlor.operators import metrics as M
from parlor.session import durable
from parlor.sources import writers

# Column names of the published report, in order.
REPORT_COLUMNS = {
    "System": "system",
    "Intent_Acc_Overall": "accuracy_overall",
    "Intent_Acc_Natural": "accuracy_natural_heldout",
    "Intent_Acc_Adversarial": "accuracy_adversarial",
    "Intent_MacroF1_Overall": "macro_f1_overall",
    "Escalation_Precision": "escalation_precision",
    "Escalation_Recall": "escalation_recall",
    "Costly_False_AutoHandles": "false_negatives",
    "Costly_False_AutoHandle_Rate": "false_autohandle_rate",
    "Unnecessary_False_Escalates": "false_positives",
    "Unnecessary_False_Escalate_Rate": "false_escalate_rate",
    "AutoHandled_Replies_Evaluated": "replies",
    "Avg_Groundedness": "avg_groundedness",
    "Avg_Correctness": "avg_correctness",
    "Avg_Tone_Empathy": "avg_tone_empathy",
    "Avg_Completeness": "avg_completeness",
    "Avg_Overall_Quality": "avg_overall",
}


def stack_systems(evaluation: DataFrame, systems: Mapping[str, Column]) -> DataFrame:
    """Every example once per system; ``systems`` maps a name to ``struct(class, decision, draft_reply)``.

    Column-only systems are stacked within one scan; use ``unionByName`` for tables of predictions.
    """
    answers = F.array(*[F.struct(F.lit(name).alias("system"), a.alias("answer")) for name, a in systems.items()])
    return evaluation.withColumn("_s", F.explode(answers)).select(*evaluation.columns, "_s.system", "_s.answer.*")


def union_predictions(systems: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.withColumn("system", F.lit(name)) for name, df in systems.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def benchmark(
    predictions: DataFrame, *, flag: str = "is_adversarial", judge_mode: str = "heuristic", judge_answer: str | None = None
) -> DataFrame:
    """All metrics per system and slice from stacked predictions.

    Needs ``system, gold_class, class, gold_decision, decision, draft_reply`` and the slice flag;
    ``judge_answer`` names a column of stored judge answers for ``judge_mode="llm"``.
    """
    reply, decision = F.col("draft_reply"), F.col("decision")
    use_answers = judge_mode == "llm" and judge_answer is not None
    lowered = F.col("_lower")
    scores = (
        S.judged(F.col(judge_answer), reply, decision, lowered=lowered) if use_answers else S.rubric(reply, decision, lowered=lowered)
    )
    scored = predictions.withColumn("_lower", F.lower(reply)).withColumn("scores", scores).withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    # The small cube is read once per metric family; predictions are joined and scored once.
    cube = M.sliced(durable(M.evaluation_cube(scored, ["system", flag])), flag)
    return M.benchmark_report(cube, ["system", "slice"], judge_mode)


def report_rows(results: DataFrame) -> DataFrame:
    """One wide row per system, the input of both reports."""
    slices = (M.OVERALL, M.NATURAL, M.ADVERSARIAL)
    per_slice = results.groupBy("system").agg(
        *[
            F.max(F.when(F.col("slice") == s, F.col(c))).alias(f"{c}_{s}")
            for c in ("accuracy", "macro_f1")
            for s in slices
        ]
    )
    overall = (
        results.where(F.col("slice") == M.OVERALL)
        .drop("slice", "accuracy", "macro_f1")
        .withColumn("replies", T.ratio_text(F.col("n_evaluated_replies"), F.col("judged_cases")))
    )
    return per_slice.join(overall, "system")


def report_table(results: DataFrame) -> DataFrame:
    """One row per system in the published column order."""
    return report_rows(results).select(*[F.col(source).alias(name) for name, source in REPORT_COLUMNS.items()])


def report_fields(slices: Sequence[str] = (M.OVERALL, M.NATURAL, M.ADVERSARIAL)) -> dict[str, Column]:
    """Nested fields of the JSON report over a ``report_rows`` table."""

    def per_slice(metric: str) -> Column:
        return F.struct(*[F.col(f"{metric}_{s}").alias(s) for s in slices])

    escalation = [
        "escalation_precision", "escalation_recall", "true_positives", "true_negatives", "false_positives",
        "false_negatives", "false_autohandle_rate", "false_escalate_rate",
    ]
    judge = ["judge_label", "n_evaluated_replies", "judged_cases", "autohandle_pct"] + [f"avg_{d}" for d in M.RUBRIC_DIMENSIONS]
    return {
        "intent_accuracy": per_slice("accuracy"),
        "intent_macro_f1": per_slice("macro_f1"),
        "escalation": F.struct(*escalation),
        "judge_quality": F.struct(*judge),
    }


def run_benchmark(
    evaluation: DataFrame,
    systems: Mapping[str, DataFrame],
    human: DataFrame,
    output: str,
    *,
    audited_system: str,
    judge_mode: str = "heuristic",
    judge_answer: str | None = None,
) -> DataFrame:
    """Score every system on the evaluation set and write the three reports.

    ``evaluation`` has ``example_id`` and the gold columns; ``systems`` maps a name to its
    predictions ``(example_id, class, decision, draft_reply)``; ``human`` has ``example_id`` and one
    column per rubric dimension. Writes ``summary`` (JSON), ``table`` (CSV) and ``agreement`` (JSON),
    and returns the metrics per system and slice.
    """
    columns = ["example_id", "class", "decision", "draft_reply", *([judge_answer] if judge_answer else [])]
    gold = evaluation.select("example_id", "gold_class", "gold_decision", "is_adversarial")
    # Every system runs once; the reports are read from its stored predictions.
    stored = durable(union_predictions({name: df.select(*columns) for name, df in systems.items()}))
    stacked = stored.join(gold, "example_id")
    results = benchmark(stacked, judge_mode=judge_mode, judge_answer=judge_answer)
    writers.write_report_json(writers.report_json(report_rows(results), "system", report_fields()), f"{output}/summary")
    writers.write_report_csv(report_table(results), f"{output}/table")

    audited = stored.where(F.col("system") == audited_system)
    reply, decision = F.col("draft_reply"), F.col("decision")
    use_answers = judge_mode == "llm" and judge_answer is not None
    scores = S.judged(F.col(judge_answer), reply, decision) if use_answers else S.rubric(reply, decision)
    judge = audited.select("example_id", scores.alias("s")).select("example_id", "s.*")
    agreed = M.agreement(judge, human)
    metrics = {c: F.col(c) for c in agreed.columns if c != "dimension"}
    writers.write_report_json(writers.report_json(agreed, "dimension", metrics), f"{output}/agreement")
    return results
