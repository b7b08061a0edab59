"""Classification, routing, rubric and agreement metrics; judge answers; reports."""

import json

import pytest
from pyspark.sql import functions as F

from parlor import defaults as D
from parlor.functions import scoring as S
from parlor.operators import metrics as M
from parlor.plans import benchmark as B
from parlor.sources import writers


def labels(spark, truth, predicted):
    return spark.createDataFrame(list(zip(truth, predicted)), "t string, p string")


def test_classification(spark):
    counts = M.confusion(labels(spark, ["bag", "delay", "other"], ["bag", "delay", "bag"]), "t", "p")
    s = M.classification_summary(counts).first()
    assert (s["total_cases"], s["accuracy"], s["macro_f1"], s["macro_precision"], s["macro_recall"], s["weighted_f1"]) == (
        3, 0.6667, 0.5556, 0.5, 0.6667, 0.5556,
    )
    report = {r["class"]: tuple(r)[1:] for r in M.class_report(counts, ["bag", "delay", "other", "absent"]).collect()}
    assert report == {"bag": (0.5, 1.0, 0.6667, 1), "delay": (1.0, 1.0, 1.0, 1), "other": (0.0, 0.0, 0.0, 1), "absent": (0.0, 0.0, 0.0, 0)}


def test_macro_counts_labels_of_prediction_too(spark):
    counts = M.confusion(labels(spark, ["a", "a"], ["a", "b"]), "t", "p")
    s = M.classification_summary(counts).first()
    assert s["macro_f1"] == 0.3333 and s["weighted_f1"] == 0.6667


def test_empty_input_gives_zeros(spark):
    counts = M.confusion(labels(spark, ["a"], ["a"]).limit(0), "t", "p")
    assert tuple(M.classification_summary(counts).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert tuple(M.escalation_summary(counts).first()) == (0, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_escalation(spark):
    counts = M.confusion(labels(spark, ["escalate", "auto_handle", "escalate"], ["escalate", "auto_handle", "auto_handle"]), "t", "p")
    r = M.escalation_summary(counts).first()
    assert (r["true_positives"], r["true_negatives"], r["false_positives"], r["false_negatives"]) == (1, 1, 0, 1)
    assert (r["precision"], r["recall"], r["f1"], r["false_autohandle_rate"], r["false_escalate_rate"]) == (1.0, 0.5, 0.6667, 0.5, 0.0)


RUBRIC = [
    ("anything", "escalate", None),
    ("The gate is B12 and boarding starts soon now.", "auto_handle", (4.0, 4.0, 4.0, 4.0, 4.0)),
    ("We can pay you $500 right away for this trip.", "auto_handle", (2.0, 2.5, 4.0, 4.0, 3.12)),
    ("Hundred DOLLARS for you, this is a promise now", "auto_handle", (2.0, 2.5, 4.0, 4.0, 3.12)),
    ("No.", "auto_handle", (4.0, 4.0, 3.0, 2.5, 3.38)),
    ("We are sorry to hear that this happened today", "auto_handle", (4.0, 4.0, 4.5, 4.0, 4.12)),
    ("Please admit the bag at the counter in time", "auto_handle", (4.0, 4.5, 4.0, 4.5, 4.25)),
    (D.GENERIC_REPLY, "auto_handle", (2.5, 3.0, 3.0, 2.5, 2.75)),
    ("DM us.", "auto_handle", (4.0, 4.5, 3.0, 3.0, 3.62)),
]


def test_rubric(spark):
    df = spark.createDataFrame([(i, r, d) for i, (r, d, _) in enumerate(RUBRIC)], "i int, r string, d string")
    rows = df.select("i", S.rubric(F.col("r"), F.col("d")).alias("s")).orderBy("i").select("s.*").collect()
    for row, (_, decision, expected) in zip(rows, RUBRIC):
        assert row["is_applicable"] == (decision != "escalate")
        got = tuple(row[d] for d in M.RUBRIC_DIMENSIONS)
        assert got == (expected or (None,) * 5)


def test_judge_answers(spark):
    reply = "The gate is B12 and boarding starts soon now."
    cases = [
        ('```json\n{"groundedness": 5, "correctness": 5, "tone_empathy": 4, "completeness": 5}\n```', "auto_handle", (4.75, "llm")),
        ('{"groundedness": "3.5", "correctness": 5, "tone_empathy": 4, "completeness": 5}', "auto_handle", (4.38, "llm")),
        ('{"groundedness": 5, "correctness": 5}', "auto_handle", (4.0, "heuristic")),
        ('{"groundedness": "high", "correctness": 5, "tone_empathy": 4, "completeness": 5}', "auto_handle", (4.0, "heuristic")),
        ("broken {", "auto_handle", (4.0, "heuristic")),
        ("", "auto_handle", (4.0, "heuristic")),
        (None, "auto_handle", (4.0, "heuristic")),
        ('{"groundedness": 5, "correctness": 5, "tone_empathy": 4, "completeness": 5}', "escalate", (None, None)),
    ]
    df = spark.createDataFrame([(i, a, d) for i, (a, d, _) in enumerate(cases)], "i int, a string, d string")
    rows = df.select("i", S.judged(F.col("a"), F.lit(reply), F.col("d")).alias("s")).orderBy("i").select("s.*").collect()
    assert [(r["overall"], r["judge_type"]) for r in rows] == [c[2] for c in cases]


def raters(spark, pairs):
    judge = [(f"e{i}", True, float(j)) for i, (j, _) in enumerate(pairs)] + [("off", False, 5.0), ("missing", True, 5.0)]
    human = [(f"e{i}", float(h)) for i, (_, h) in enumerate(pairs)] + [("off", 1.0), ("alone", 2.0)]
    return (
        spark.createDataFrame(judge, "example_id string, is_applicable boolean, x double"),
        spark.createDataFrame(human, "example_id string, x double"),
    )


def quadratic_kappa(pairs):
    values = sorted({v for p in pairs for v in p})
    n = len(pairs)
    weight = lambda a, b: (values.index(a) - values.index(b)) ** 2
    observed = sum(weight(a, b) for a, b in pairs)
    expected = sum(weight(a, b) for a, _ in pairs for _, b in pairs) / n
    return 1 - observed / expected


@pytest.mark.parametrize(
    ("pairs", "rounded", "kappa", "pearson"),
    [
        ([(4.5, 4), (3.5, 4)], [(4, 4), (4, 4)], 1.0, 0.0),
        ([(4.5, 5), (4.4, 5)], [(4, 5), (4, 5)], 0.0, 0.0),
        ([(4, 2), (4, 5)], [(4, 2), (4, 5)], 0.0, 0.0),
        # r = 5 / sqrt(6.75 * 6)
        ([(2, 2), (4, 5), (5, 5), (2, 4)], [(2, 2), (4, 5), (5, 5), (2, 4)], None, 0.7857),
    ],
)
def test_agreement(spark, pairs, rounded, kappa, pearson):
    r = M.agreement(*raters(spark, pairs), dimensions=["x"]).first()
    expected = kappa if kappa is not None else round(quadratic_kappa(rounded), 4)
    assert (r["cohen_kappa_quadratic"], r["pearson_correlation"], r["sample_size"]) == (expected, pearson, len(pairs))
    assert r["exact_match_pct"] == round(100 * sum(a == b for a, b in rounded) / len(pairs), 2)
    assert r["within_plus_minus_one_pct"] == round(100 * sum(abs(a - b) <= 1 for a, b in rounded) / len(pairs), 2)


def test_agreement_without_rows(spark):
    judge, human = raters(spark, [])
    r = M.agreement(judge.where("not is_applicable"), human, dimensions=["x"]).first()
    assert tuple(r) == ("x", 0.0, 0.0, 0.0, 0.0, 0)


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        ("a", None, "bag", "bag", "escalate", "escalate", "x" * 40),
        ("a", False, "bag", "delay", "auto_handle", "auto_handle", "We are sorry to hear that this happened today"),
        ("a", True, "delay", "delay", "escalate", "auto_handle", D.GENERIC_REPLY),
        ("b", True, "delay", "bag", "escalate", "escalate", "x"),
        ("b", False, "delay", "bag", "auto_handle", "escalate", "x"),
    ]
    df = spark.createDataFrame(rows, "system string, is_adversarial boolean, gold_class string, class string, gold_decision string, decision string, draft_reply string")
    return B.benchmark(df)


def test_benchmark_slices(results):
    got = {(r["system"], r["slice"]): r for r in results.collect()}
    assert set(got) == {(s, x) for s in "ab" for x in ("overall", "natural_heldout", "adversarial")}
    a = got["a", "overall"]
    assert (a["total_cases"], a["accuracy"], a["n_evaluated_replies"], a["avg_overall"], a["autohandle_pct"]) == (3, 0.6667, 2, 3.44, 66.7)
    assert got["a", "natural_heldout"]["total_cases"] == 2  # a missing flag counts as natural
    assert got["a", "adversarial"]["false_autohandle_rate"] == 1.0
    assert (got["b", "overall"]["avg_overall"], got["b", "overall"]["n_evaluated_replies"]) == (0.0, 0)
    for r in got.values():
        assert r["true_positives"] + r["true_negatives"] + r["false_positives"] + r["false_negatives"] == r["total_cases"]


def test_reports(spark, results, tmp_path):
    writers.write_report_csv(B.report_table(results), str(tmp_path / "csv"))
    table = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert table.columns == list(B.REPORT_COLUMNS)
    assert {r["AutoHandled_Replies_Evaluated"] for r in table.collect()} == {"2/3", "0/2"}
    writers.write_report_json(writers.report_json(B.report_rows(results), "system", B.report_fields()), str(tmp_path / "json"))
    reports = {r["system"]: r for r in map(json.loads, (x["value"] for x in spark.read.text(str(tmp_path / "json")).collect()))}
    assert reports["a"]["intent_accuracy"] == {"overall": 0.6667, "natural_heldout": 0.5, "adversarial": 1.0}
    assert reports["b"]["escalation"]["true_positives"] == 1


@pytest.mark.parametrize(
    ("kinds", "mode", "label"),
    [
        (["llm", "llm"], "llm", "LLM-as-a-Judge"),
        (["llm", "heuristic"], "llm", "LLM-as-a-Judge (1/2 successful, rest heuristic)"),
        (["heuristic"], "llm", "Deterministic Offline Heuristic Rubric (LLM Fallback)"),
        (["heuristic"], "heuristic", "Deterministic Offline Heuristic Rubric"),
    ],
)
def test_judge_label(spark, kinds, mode, label):
    good = '{"groundedness": 5, "correctness": 5, "tone_empathy": 4, "completeness": 5}'
    rows = [("s", False, "c", "c", "auto_handle", "auto_handle", "x" * 40, good if k == "llm" else "") for k in kinds]
    df = spark.createDataFrame(rows, "system string, is_adversarial boolean, gold_class string, class string, gold_decision string, decision string, draft_reply string, answer string")
    row = B.benchmark(df, judge_mode=mode, judge_answer="answer").where("slice = 'overall'").first()
    assert row["judge_label"] == label
