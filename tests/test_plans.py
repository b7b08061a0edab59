"""Triage in batch and on a stream, labelled set, audits, responses."""

import math

import pytest
from pyspark.sql import functions as F

from parlor import defaults as D
from parlor.functions import scoring as S
from parlor.operators import classify, evalsets, responses as X, vectors
from parlor.plans.labelled_set import build_labelled_set
from parlor.plans.benchmark import run_benchmark
from parlor.plans.index import build_index, train_centroids
from parlor.plans.triage import class_prompt, triage
from parlor.sources import readers, schemas, writers
from parlor.streaming.triage_stream import stream_triage

H = math.sqrt(0.5)
TABLE = [
    ("baggage_issue", [1.0, 0.0, 0.0]), ("refund_compensation_request", [0.0, 1.0, 0.0]), ("other_unclear", [0.0, 0.0, 1.0]),
]
MESSAGES = [
    (1, " My bag is gone ", [1.0, 0.0, 0.0]),
    (2, "I will sue you over my bag", [1.0, 0.0, 0.0]),
    (3, "Please refund my ticket", [0.1, 0.995, 0.0]),
    (4, "hello there", [0.0, 0.2, 0.98]),
    (5, "", [1.0, 0.0, 0.0]),
    (6, "no vector", None),
    (7, "hmm what", [0.577, 0.577, 0.577]),
    (8, "my suitcase", [0.6, 0.0, -0.8]),
]
CORPUS = [
    ("p1", [1.0, 0.0, 0.0], "baggage_issue", False, "Please file a claim at our office"),
    ("p2", [0.0, 1.0, 0.0], "refund_compensation_request", False, "short"),
    ("p3", [-math.sqrt(1 - 0.56**2), 0.0, 0.56], "other_unclear", False, "Thanks for the kind words, see you"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    df = spark.createDataFrame(CORPUS, "thread_id string, embedding array<double>, class string, is_boilerplate boolean, agent_reply string")
    return df.withColumn("customer_message", F.lit("m"))


def messages(spark):
    return spark.createDataFrame(MESSAGES, "id int, text string, embedding array<double>")


def decide(df, corpus, **options):
    return triage(df, corpus, TABLE, id_col="id", text_col="text", templates={"refund_compensation_request": "See the refund page"}, **options)


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_triage(spark, corpus, limit):
    got = {r["id"]: r for r in decide(messages(spark), corpus, max_broadcast_bytes=limit).collect()}
    assert (got[1]["decision"], got[1]["reason_code"], got[1]["draft_reply"]) == ("auto_handle", "ok", "Please file a claim at our office")
    assert got[1]["customer_message"] == "My bag is gone" and got[1]["grounding_ids"][0] == "p1"
    hit = got[2]
    assert (hit["decision"], hit["reason_code"], hit["best_similarity"], hit["grounding_ids"]) == ("escalate", "hard_rule_legal_threat", 0.0, [])
    assert hit["draft_reply"] == D.HARD_RULE_REPLY and hit["class"] == "baggage_issue"
    assert hit["trace"]["layer"] == "hard_rules" and hit["trace"]["retrieval_matches_count"] is None
    # The first precedent is too short, so the class template answers.
    assert (got[3]["reason_code"], got[3]["draft_reply"]) == ("policy_refund_agent_only", "See the refund page")
    assert got[4]["reason_code"] == "ambiguous_intent"
    assert got[5]["reason_code"] == got[6]["reason_code"] == "low_intent_confidence"
    assert got[7]["trace"]["retrieval_matches_count"] == 3 and got[7]["trace"]["hard_rule_description"] is None
    assert got[8]["class"] == "baggage_issue" and got[8]["confidence"] == 0.68
    assert not any("$" in r["draft_reply"] for r in got.values())


def test_triage_with_a_stored_class_answer(spark, corpus):
    df = messages(spark).where("id = 7").withColumn("answer", F.lit(' "Refund_Compensation_Request" '))
    row = decide(df, corpus, class_answer_col="answer").first()
    assert (row["class"], row["confidence"]) == ("refund_compensation_request", 0.75)
    empty = decide(df.withColumn("answer", F.lit("")), corpus, class_answer_col="answer").first()
    assert empty["class"] == "baggage_issue"


def test_triage_with_stored_answers(spark, corpus):
    asked = messages(spark).where("id in (1, 2, 7)")
    options = dict(class_system_text="C", reply_system_text="R", model="m")
    class_key = X.with_response_key(asked.where("id = 7"), class_prompt(F.trim("text")), F.lit("C"), F.lit("m"))
    classes = class_key.select("cache_key", "prompt", F.lit("other_unclear").alias("response"))
    grounded = {r["id"]: r for r in decide(asked, corpus, responses=classes, **options).collect()}
    assert (grounded[7]["class"], grounded[7]["confidence"]) == ("other_unclear", 0.75)
    assert grounded[1]["draft_reply"] == "Please file a claim at our office"
    prompt = S.draft_prompt(F.lit("baggage_issue"), F.lit("My bag is gone"), F.lit(
        'Precedent 1: "Please file a claim at our office"\nPrecedent 2: "short"\nPrecedent 3: "Thanks for the kind words, see you"'
    ))
    replies = X.with_response_key(spark.range(1), prompt, F.lit("R"), F.lit("m")).select("cache_key", "prompt", F.lit(' "A drafted reply" ').alias("response"))
    got = {r["id"]: r for r in decide(asked, corpus, responses=classes.unionByName(replies), **options).collect()}
    assert got[1]["draft_reply"] == "A drafted reply"
    assert got[2]["draft_reply"] == D.HARD_RULE_REPLY
    assert got[7]["draft_reply"] == grounded[7]["draft_reply"]


def test_stream_gives_the_batch_result(spark, corpus, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    messages(spark).repartition(3).write.parquet(source)
    query = stream_triage(
        spark, source, "id int, text string, embedding array<double>", lambda df: decide(df, corpus), output,
        query_name=f"triage-{tmp_path.name}", max_files_per_trigger=1,
    )
    assert query.awaitTermination(120)
    batch = decide(spark.read.parquet(source), corpus)
    assert sorted(map(str, spark.read.schema(batch.schema).parquet(output).collect())) == sorted(map(str, batch.collect()))


def test_triage_plan_is_map_only(spark, corpus):
    plan = decide(messages(spark), corpus)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    # Scores, search and reply texts: each Python stage appears once.
    assert plan.count("ArrowEvalPython") == 3


def test_reply_choice_and_snippets(spark):
    kind = "array<struct<reply:string,is_boilerplate:boolean>>"
    rows = [(0, []), (1, [("x" * 26, False), ("b", False)]), (2, [("x" * 25, False)]), (3, [("x" * 30, True)])]
    df = spark.createDataFrame(rows, f"i int, m {kind}")
    got = [r[1] for r in df.select("i", S.choose_reply(F.col("m"), F.lit("T"))).orderBy("i").collect()]
    assert got == ["T", "x" * 26, "T", "T"]
    text = [r[1] for r in df.select("i", S.precedent_snippets(F.col("m"))).orderBy("i").collect()]
    assert text[0] == "" and text[1] == f'Precedent 1: "{"x" * 26}"\nPrecedent 2: "b"'


def test_labelled_set(spark):
    fixed = spark.createDataFrame(
        [(1, "A Fixed Case that is long enough", "baggage_issue", "escalate", "r", "must", "sarcasm")],
        "position int, customer_message string, gold_class string, gold_decision string, gold_reason string, must_contain string, adversarial_type string",
    )
    rows = [(f"t{i}", f"  message number {i} about an issue  ", "baggage_issue", 0.9) for i in range(6)]
    rows += [
        ("c1", "MESSAGE number 3 about an issue", "baggage_issue", 0.9), ("c2", "a fixed case that is long enough ", "baggage_issue", 0.9),
        ("s", "too short", "baggage_issue", 0.9), ("l", "x" * 301, "baggage_issue", 0.9), ("held", "this one is in the corpus", "baggage_issue", 0.9),
        ("o", "a vague message of some length", "other_unclear", 0.3), ("u", "a class without any quota here", "unknown", 0.3),
    ]
    threads = spark.createDataFrame(rows, "thread_id string, customer_message string, class string, confidence double")
    corpus = spark.createDataFrame([("held",), (None,)], "thread_id string")
    got = build_labelled_set(
        threads, corpus, fixed, quotas={"baggage_issue": 5, "other_unclear": 2}, sketches={"baggage_issue": "claim"}, default_sketch="ask"
    )
    out = got.orderBy("example_id").collect()
    assert [r["example_id"] for r in out] == [f"gold-{i:03d}" for i in range(1, 8)]
    assert out[0]["is_adversarial"] and out[0]["thread_id"] == "adv_001" and not any(r["is_adversarial"] for r in out[1:])
    assert {c for c in got.columns} == {f.split()[0] for f in schemas.EVALUATION.split(", ")}
    sampled = {r["thread_id"]: r for r in out[1:]}
    assert sampled["o"]["gold_reason"] == "ambiguous_intent" and sampled["o"]["must_contain"] == "ask"
    assert len(sampled) == 6 and not {"c2", "s", "l", "held", "u"} & set(sampled)
    assert len({r["customer_message"].lower() for r in out}) == 7
    assert all(r["gold_reason"] == "legal_threat" for i, r in sampled.items() if i != "o")  # "sue" in "issue"


def test_leakage_audit(spark):
    corpus = spark.createDataFrame([("a", " Same TEXT "), ("b", "other")], "id string, t string")
    evaluation = spark.createDataFrame([("b", "same text"), ("c", "seed")], "id string, t string")
    seeds = spark.createDataFrame([("Seed",), ("none",)], "t string")
    audit = evalsets.leakage_audit(
        corpus, evaluation, seeds, corpus_id="id", evaluation_id="id", corpus_text="t", evaluation_text="t", seed_text="t"
    )
    assert {r["check"]: r["shared"] for r in audit.collect()} == {
        "corpus_evaluation_ids": 1, "corpus_evaluation_texts": 1, "evaluation_seed_texts": 1,
    }


def test_hold_out_with_null_ids(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    kept = evalsets.held_out(rows, spark.createDataFrame([("a",), (None,)], "id string"), "id")
    assert sorted(str(r["id"]) for r in kept.collect()) == ["None", "b"]


def test_distribution_and_audits(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 3)], "c string, n int")
    assert [(r["c"], r["n"], round(r["pct"], 2)) for r in evalsets.distribution(df, "c").collect()] == [("a", 2, 66.67), ("b", 1, 33.33)]
    row = evalsets.table_audit({"t": df}).first()
    assert (row["table_name"], row["rows"], row["columns"], row["null_cells"]) == ("t", 3, 2, 1)
    assert evalsets.missing_columns(df, {"c": "string", "n": "bigint", "x": "int"}) == ["n: bigint", "x: int"]


def test_audit_join_and_jsonl(spark, tmp_path):
    base = spark.createDataFrame([("gold-001", "m é"), ("gold-002", None)], "example_id string, customer_message string")
    scores = spark.createDataFrame([("gold-001", 5, 5, 4, 5), ("gold-009", 1, 1, 1, 1)], "example_id string, groundedness int, correctness int, tone_empathy int, completeness int")
    joined = evalsets.audit_join(base, scores)
    assert [(r["example_id"], r["human_scores"]["overall"]) for r in joined.collect()] == [("gold-001", 4.75)]
    writers.write_jsonl(joined, str(tmp_path / "a.jsonl"))
    text = spark.read.text(str(tmp_path / "a.jsonl")).first()["value"]
    assert "é" in text
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), schemas.AUDIT).first()["human_scores"]["overall"] == 4.75


def test_readers_by_format(spark, tmp_path):
    df = spark.createDataFrame([("k", "p", "r")], schemas.RESPONSES)
    writers.write_parquet(df, str(tmp_path / "r.parquet"))
    writers.write_jsonl(df, str(tmp_path / "r.jsonl"))
    for name in ("r.parquet", "r.jsonl"):
        assert readers.read_source(spark, str(tmp_path / name), schemas.RESPONSES).first()["response"] == "r"
    with pytest.raises(ValueError):
        readers.read_source(spark, "x.avro", schemas.RESPONSES)
    with pytest.raises(FileNotFoundError):
        readers.first_available(spark, [str(tmp_path / "none")])
    classes = spark.createDataFrame([("a", 0, "d")], schemas.CLASSES)
    centroids = spark.createDataFrame([("a", [1.0, 0.0])], schemas.CENTROIDS)
    writers.write_centroids(centroids, classes, str(tmp_path / "c"))
    assert readers.read_centroids(spark, str(tmp_path / "c" / "centroids")).first()["centroid"] == [1.0, 0.0]


def test_responses(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id int, t string")
    keyed = X.with_response_key(df, F.concat(F.lit("Q: "), "t"), F.lit("sys"), F.lit("m"))
    stored = keyed.where("id = 1").select("cache_key", "prompt", F.lit("answer").alias("response"))
    found = {r["id"]: r["response"] for r in X.lookup_responses(keyed, stored, F.col("id")).collect()}
    assert found == {1: "answer", 2: "", 3: "answer", 4: ""}
    pending = {r["prompt"]: r["requests"] for r in X.pending_prompts(keyed, stored).collect()}
    assert pending == {"Q: b": 1, "Q: c": 1}


def test_class_override(spark):
    rows = [(0, True, "BAG", 0.3), (1, True, "'bag'", 0.9), (2, False, "bag", 0.3), (3, True, "none", 0.3), (4, True, None, 0.3)]
    df = spark.createDataFrame(rows, "i int, f boolean, a string, p double")
    o = X.class_override(F.col("f"), F.col("a"), F.lit("other"), F.col("p"), ["bag", "other"])
    got = [tuple(r) for r in df.select("i", o.alias("o")).orderBy("i").select("o.*").collect()]
    assert got == [("bag", 0.75, True), ("bag", 0.9, True), ("other", 0.3, False), ("other", 0.3, False), ("other", 0.3, False)]


def test_from_seeds_to_reports(spark, tmp_path):
    seeds = spark.createDataFrame(
        [("baggage_issue", "my bag is lost"), ("baggage_issue", "where is my lost suitcase"), ("refund_compensation_request", "refund my ticket"),
         ("refund_compensation_request", "i want a refund now"), ("other_unclear", "hello nice weather")],
        "class string, text string",
    )
    model = vectors.hashing_encoder(seeds, "text", 512)
    encode = lambda df, text, out: vectors.hashed_vectors(df.withColumnRenamed(text, "text"), "text", out, model).withColumnRenamed("text", text)
    classes = spark.createDataFrame([(c, i, "") for i, c in enumerate(D.CLASSES)], schemas.CLASSES)
    centroids = train_centroids(seeds, classes, encode, str(tmp_path / "centroids"))
    assert centroids.count() == 3
    threads = spark.createDataFrame(
        [("t1", "my bag is lost again", "Please see the baggage office today", False), ("t2", "please refund the ticket", "Submit a refund form online please", False), ("t3", "tiny", "x", False)],
        "thread_id string, customer_message string, agent_reply string, is_boilerplate boolean",
    )
    corpus = build_index(threads, centroids, encode, str(tmp_path / "corpus"))
    assert {r["thread_id"]: r["class"] for r in corpus.collect()} == {"t1": "baggage_issue", "t2": "refund_compensation_request"}

    evaluation = spark.createDataFrame(
        [("gold-001", "where is my bag", "baggage_issue", "auto_handle", False), ("gold-002", "my lawyer will sue", "other_unclear", "escalate", True)],
        "example_id string, customer_message string, gold_class string, gold_decision string, is_adversarial boolean",
    )
    table = vectors.centroid_list(centroids, D.CLASSES)
    agent = triage(encode(evaluation, "customer_message", "embedding"), corpus, table, id_col="example_id", text_col="customer_message", min_similarity=0.1, min_confidence=0.1)
    systems = {
        "constant": classify.constant_baseline(evaluation), "keyword": classify.keyword_baseline(evaluation, "customer_message"), "agent": agent,
    }
    human = spark.createDataFrame([("gold-001", 4, 4, 4, 4, 4.0)], "example_id string, groundedness int, correctness int, tone_empathy int, completeness int, overall double")
    results = run_benchmark(evaluation, systems, human, str(tmp_path / "out"), audited_system="agent")
    got = {(r["system"], r["slice"]): r for r in results.collect()}
    assert got["agent", "overall"]["true_positives"] == 1 and got["constant", "overall"]["false_negatives"] == 1
    assert got["agent", "natural_heldout"]["accuracy"] == 1.0
    for name, rows in (("summary", 3), ("agreement", 5)):
        assert spark.read.text(str(tmp_path / "out" / name)).count() == rows
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "table")).count() == 3


def test_benchmark_reads_its_predictions_once(spark):
    """The metrics come from a stored cube; no plan behind them scans the predictions again."""
    from parlor.plans.benchmark import benchmark

    rows = [(s, "a", "ab"[i % 2], "escalate", "auto_handle", f"Sorry, reply {i}", i % 3 == 0) for s in ("x", "y") for i in range(6)]
    columns = "system string, gold_class string, class string, gold_decision string, decision string, draft_reply string, is_adversarial boolean"
    counted = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            counted.add(len(batch))
            yield batch

    predictions = spark.createDataFrame(rows, columns).repartition(2).mapInPandas(count, columns)
    assert benchmark(predictions).count() == 6 and counted.value == len(rows)
