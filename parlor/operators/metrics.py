"""Evaluation metrics from one aggregated cube.

The rows are shuffled once, as counts per combination of the compared columns; slices, label
sets and reports are all computed from that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parlor.functions import text as T
from parlor.functions.scoring import half_even, ratio

OVERALL, NATURAL, ADVERSARIAL = "overall", "natural_heldout", "adversarial"
RUBRIC_DIMENSIONS = ["groundedness", "correctness", "tone_empathy", "completeness", "overall"]


def confusion(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts per ``(by..., truth, predicted)``."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def sliced(df: DataFrame, flag: str) -> DataFrame:
    """Repeat each (aggregated) row for ``overall`` and for its own slice; a missing flag is false."""
    own = F.when(F.coalesce(F.col(flag), F.lit(False)), F.lit(ADVERSARIAL)).otherwise(F.lit(NATURAL))
    return df.withColumn("slice", F.explode(F.array(F.lit(OVERALL), own)))


def class_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., class, tp, fp, fn, support)`` for every class seen in truth or prediction."""
    same = F.col("truth") == F.col("predicted")

    def part(which: str, tp: Column, fp: Column, fn: Column) -> Column:
        return F.struct(F.col(which).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    zero = F.lit(0).cast("long")
    n = F.col("n")
    parts = F.when(same, F.array(part("truth", n, zero, zero))).otherwise(
        F.array(part("truth", zero, zero, n), part("predicted", zero, n, zero))
    )
    return (
        counts.select(*by, F.explode(parts).alias("p"))
        .groupBy(*by, F.col("p.class").alias("class"))
        .agg(F.sum("p.tp").alias("tp"), F.sum("p.fp").alias("fp"), F.sum("p.fn").alias("fn"))
        .withColumn("support", F.col("tp") + F.col("fn"))
    )


def _precision_recall_f1(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def class_report(counts: DataFrame, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support for the full taxonomy; undefined values are 0."""
    present = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    grid = present.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    filled = grid.join(class_counts(counts, by), [*by, "class"], "left").fillna(0, ["tp", "fp", "fn", "support"])
    return _precision_recall_f1(filled).select(
        *by,
        "class",
        *[half_even(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1")],
        F.col("support").cast("long").alias("support"),
    )


def classification_summary(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro averages over the labels seen in the slice, support-weighted F1.

    No rows give zeros.
    """
    per_class = _precision_recall_f1(class_counts(counts, by))

    def rounded(value: Column, name: str) -> Column:
        return half_even(F.coalesce(value, F.lit(0.0)), 4).alias(name)

    support = F.sum("support")
    return per_class.groupBy(*by).agg(
        F.coalesce(support, F.lit(0)).cast("long").alias("total_cases"),
        rounded(F.try_divide(F.sum("tp").cast("double"), support.cast("double")), "accuracy"),
        rounded(F.avg("f1"), "macro_f1"),
        rounded(F.avg("precision"), "macro_precision"),
        rounded(F.avg("recall"), "macro_recall"),
        rounded(F.try_divide(F.sum(F.col("f1") * F.col("support")), support.cast("double")), "weighted_f1"),
    )


def escalation_summary(
    counts: DataFrame, by: Sequence[str] = (), positive: str = "escalate", negative: str = "auto_handle"
) -> DataFrame:
    """Routing confusion matrix and rates from ``(truth, predicted, n)`` counts."""
    truth, predicted = F.col("truth"), F.col("predicted")

    def cell(t: str, p: str) -> Column:
        return F.coalesce(F.sum(F.when((truth == t) & (predicted == p), F.col("n"))), F.lit(0)).cast("long")

    cells = counts.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"),
        cell(positive, positive).alias("true_positives"),
        cell(negative, negative).alias("true_negatives"),
        cell(negative, positive).alias("false_positives"),
        cell(positive, negative).alias("false_negatives"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("true_positives", "true_negatives", "false_positives", "false_negatives"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    rates = {
        "precision": precision,
        "recall": recall,
        "specificity": ratio(tn, tn + fp),
        "f1": ratio(2 * precision * recall, precision + recall),
        "false_autohandle_rate": ratio(fn, tp + fn),
        "false_escalate_rate": ratio(fp, tn + fp),
    }
    return cells.withColumns({name: half_even(value, 4) for name, value in rates.items()})


def rubric_summary(cube: DataFrame, by: Sequence[str] = (), judge_mode: str = "heuristic") -> DataFrame:
    """Rubric means over applicable rows, from ``n, n_applicable, n_llm`` and score sums.

    0 where nothing is applicable.
    """
    total, applicable, answered = F.sum("n"), F.sum("n_applicable"), F.sum("n_llm")
    rows = cube.groupBy(*by).agg(
        applicable.cast("long").alias("n_evaluated_replies"),
        total.cast("long").alias("judged_cases"),
        answered.alias("_answered"),
        *[half_even(ratio(F.sum(f"sum_{d}"), applicable), 2).alias(f"avg_{d}") for d in RUBRIC_DIMENSIONS],
    )
    label = (
        F.lit("Deterministic Offline Heuristic Rubric")
        if judge_mode == "heuristic"
        else F.when(
            (F.col("_answered") == F.col("n_evaluated_replies")) & (F.col("n_evaluated_replies") > 0),
            F.lit("LLM-as-a-Judge"),
        )
        .when(
            F.col("_answered") > 0,
            F.concat(
                F.lit("LLM-as-a-Judge ("),
                T.ratio_text(F.col("_answered"), F.col("n_evaluated_replies")),
                F.lit(" successful, rest heuristic)"),
            ),
        )
        .otherwise(F.lit("Deterministic Offline Heuristic Rubric (LLM Fallback)"))
    )
    return rows.withColumns(
        {
            "autohandle_pct": half_even(ratio(F.col("n_evaluated_replies"), F.col("judged_cases")) * 100, 1),
            "judge_label": label,
        }
    ).drop("_answered")


def evaluation_cube(
    predictions: DataFrame,
    by: Sequence[str],
    *,
    gold_class: str = "gold_class",
    predicted_class: str = "class",
    gold_decision: str = "gold_decision",
    decision: str = "decision",
    scores: str = "scores",
) -> DataFrame:
    """The one wide shuffle: counts and rubric sums per combination of labels and decisions."""
    s = F.col(scores)
    applicable = s["is_applicable"] & s["overall"].isNotNull()
    return predictions.groupBy(
        *by,
        F.col(gold_class).alias("gold_class"),
        F.col(predicted_class).alias("class"),
        F.col(gold_decision).alias("gold_decision"),
        F.col(decision).alias("decision"),
    ).agg(
        F.count("*").alias("n"),
        F.count_if(applicable).alias("n_applicable"),
        F.count_if(applicable & (s["judge_type"] == "llm")).alias("n_llm"),
        *[F.coalesce(F.sum(F.when(applicable, s[d])), F.lit(0.0)).alias(f"sum_{d}") for d in RUBRIC_DIMENSIONS],
    )


def benchmark_report(cube: DataFrame, by: Sequence[str], judge_mode: str = "heuristic") -> DataFrame:
    """Classification, routing and rubric metrics side by side for every ``by`` combination."""
    labels = cube.groupBy(*by, F.col("gold_class").alias("truth"), F.col("class").alias("predicted")).agg(F.sum("n").alias("n"))
    routes = cube.groupBy(*by, F.col("gold_decision").alias("truth"), F.col("decision").alias("predicted")).agg(F.sum("n").alias("n"))
    routing = escalation_summary(routes, by)
    renamed = routing.select(
        *by, "true_positives", "true_negatives", "false_positives", "false_negatives",
        *[F.col(c).alias(f"escalation_{c}") for c in ("precision", "recall", "specificity", "f1")],
        "false_autohandle_rate", "false_escalate_rate",
    )
    return (
        classification_summary(labels, by)
        .join(renamed, list(by))
        .join(rubric_summary(cube, by, judge_mode), list(by))
    )


def agreement(
    judge: DataFrame, human: DataFrame, id_col: str = "example_id", dimensions: Sequence[str] = RUBRIC_DIMENSIONS
) -> DataFrame:
    """Agreement of two raters per dimension on half-even rounded scores.

    ``judge`` has ``is_applicable`` and one column per dimension; ``human`` one column per
    dimension. Everything follows from counts per (dimension, judge score, human score): exact
    and within-one shares, Pearson r, and quadratic kappa over score ranks. The expected kappa
    disagreement only needs the first two moments of each rater's ranks.
    """
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(d).alias("dimension"),
                    half_even(F.col(f"judge.{d}"), 0).cast("long").alias("j"),
                    half_even(F.col(f"human.{d}"), 0).cast("long").alias("h"),
                )
                for d in dimensions
            ]
        )
    )
    scored = (
        judge.alias("judge")
        .where("is_applicable")
        .join(human.alias("human"), F.col(f"judge.{id_col}") == F.col(f"human.{id_col}"))
        .select(pairs.alias("p"))
        .select("p.*")
        .where(F.col("j").isNotNull() & F.col("h").isNotNull())
        .groupBy("dimension", "j", "h")
        .agg(F.count("*").alias("n"))
    )
    # Score ranks over the union of both raters' values; one array per dimension (a rating scale).
    values = scored.groupBy("dimension").agg(
        F.array_sort(F.array_union(F.collect_set("j"), F.collect_set("h"))).alias("values")
    )
    ranks = scored.join(values, "dimension").withColumns(
        {"rj": F.array_position("values", F.col("j")), "rh": F.array_position("values", F.col("h"))}
    )
    n = F.col("n").cast("double")

    def total(value: Column) -> Column:
        return F.sum(value * n)

    j, h, rj, rh = (F.col(c).cast("double") for c in ("j", "h", "rj", "rh"))
    sums = ranks.groupBy("dimension").agg(
        F.sum("n").alias("size"),
        F.sum(F.when(F.col("j") == F.col("h"), F.col("n")).otherwise(0)).alias("exact"),
        F.sum(F.when(F.abs(F.col("j") - F.col("h")) <= 1, F.col("n")).otherwise(0)).alias("near"),
        F.min("j").alias("jmin"), F.max("j").alias("jmax"), F.min("h").alias("hmin"), F.max("h").alias("hmax"),
        total(j).alias("sj"), total(h).alias("sh"), total(j * h).alias("sjh"), total(j * j).alias("sjj"), total(h * h).alias("shh"),
        total(rj).alias("tj"), total(rh).alias("th"), total(rj * rj).alias("tjj"), total(rh * rh).alias("thh"),
        total((rj - rh) * (rj - rh)).alias("observed"),
    )
    size = F.col("size").cast("double")
    expected = F.col("tjj") + F.col("thh") - 2 * F.col("tj") * F.col("th") / size
    both_constant = (F.col("jmin") == F.col("jmax")) & (F.col("hmin") == F.col("hmax"))
    kappa = F.when(both_constant, F.when(F.col("jmin") == F.col("hmin"), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        F.coalesce(1.0 - F.try_divide(F.col("observed"), expected), F.lit(0.0))
    )
    spread = (size * F.col("sjj") - F.col("sj") * F.col("sj")) * (size * F.col("shh") - F.col("sh") * F.col("sh"))
    pearson = F.coalesce(F.try_divide(size * F.col("sjh") - F.col("sj") * F.col("sh"), F.sqrt(spread)), F.lit(0.0))
    found = sums.select(
        "dimension",
        half_even(kappa, 4).alias("cohen_kappa_quadratic"),
        half_even(ratio(F.col("exact"), F.col("size")) * 100.0, 2).alias("exact_match_pct"),
        half_even(ratio(F.col("near"), F.col("size")) * 100.0, 2).alias("within_plus_minus_one_pct"),
        half_even(pearson, 4).alias("pearson_correlation"),
        F.col("size").cast("long").alias("sample_size"),
    )
    grid = judge.sparkSession.range(1).select(F.explode(F.array(*[F.lit(d) for d in dimensions])).alias("dimension"))
    return grid.join(found, "dimension", "left").fillna(0)
