"""Transcript parsing, thread extraction, reply pairing, profile."""

from pyspark.sql import functions as F

from parlor.operators import threads as H
from parlor.plans.ingest import run_ingest
from parlor.sources import readers, schemas, writers

TRANSCRIPTS = [
    ("a", "intro\nCustomer: My bag is lost @99\n\n still lost\r\nSUPPORT:\n Please DM us now ok\nCustomer: fine\nCustomer: thanks"),
    ("b", "Customer: only me talking here"),
    ("c", "Customer: short\nSupport: ok then, we will help"),
    ("d", "Customer: @12\nCustomer: A real question here\nSupport: A real answer here"),
    ("e", None),
]


def parsed(spark, rows):
    df = spark.createDataFrame(rows, "id string, t string")
    return {r["id"]: [(x["role"], x["text"]) for x in r["p"]] for r in df.select("id", H.parse_turns(F.col("t")).alias("p")).collect()}


def test_parse_turns(spark):
    got = parsed(spark, TRANSCRIPTS)
    assert got["a"] == [
        ("customer", "My bag is lost still lost"), ("support", "Please DM us now ok"), ("customer", "fine"), ("customer", "thanks"),
    ]
    assert got["d"] == [("customer", "A real question here"), ("support", "A real answer here")]
    assert got["e"] == []


def test_parse_turns_edges(spark):
    got = parsed(spark, [("x", "  customer: a \tSupport: b\x0bcustomer: c"), ("y", "nothing here"), ("z", "Customer:\nSupport: x"), ("w", "say Customer: no")])
    assert got["x"] == [("customer", "a"), ("support", "b"), ("customer", "c")]
    assert got["y"] == [] and got["w"] == []
    assert got["z"] == [("support", "x")]


def test_threads_from_transcripts(spark):
    df = spark.createDataFrame(TRANSCRIPTS, "id string, t string")
    rows = {r["thread_id"]: r for r in H.threads_from_transcripts(df, "id", "t").collect()}
    assert set(rows) == {"a", "d"}  # b is one-sided, c too short, e empty
    a = rows["a"]
    assert (a["turns_count"], a["num_customer_turns"], a["num_support_turns"], a["is_boilerplate"]) == (4, 3, 1, True)
    assert a["raw_turns"][0]["text"] == a["customer_message"]


def test_transcript_is_parsed_once(spark):
    df = spark.createDataFrame(TRANSCRIPTS, "id string, t string")
    plan = H.threads_from_transcripts(df, "id", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_threads_from_turns_ignores_partitioning(spark):
    rows = [(1, 2, "support", "Second answer"), (1, 0, "customer", " @1 "), (1, 1, "customer", "First question"), (1, 3, "support", "Third one here"), (2, 0, "customer", "Alone in here")]
    df = spark.createDataFrame(rows, "c int, n int, r string, t string")
    results = [
        [tuple(r) for r in H.threads_from_turns(df.repartition(k), "c", "n", "r", "t", id_prefix="t").collect()] for k in (1, 5)
    ]
    assert results[0] == results[1] == [("t1", "First question", "Second answer", 3, 1, 2, False)]


TWEETS = [
    (1, "user1", None, "My flight is delayed again"),
    (2, "ACME", 1, "@user Sorry to hear, please DM us"),
    (3, "acme", 1, "We are looking into it now"),
    (4, "acme", 2, "Answer to our own tweet"),
    (5, "acme", None, "A brand post without parent"),
    (6, "acme", 999, "Reply to an unknown tweet"),
    (7, "user2", None, None),
    (8, "acme", 7, "Reply to an empty tweet"),
    (9, "user3", None, "@acme hi"),
    (10, "acme", 9, "Reply to a short tweet"),
    (11, "user4", 1, "Another customer joins in"),
]
TWEET_SCHEMA = "tweet_id long, author_id string, in_response_to_tweet_id long, text string"


def test_reply_pairs(spark):
    df = spark.createDataFrame(TWEETS, TWEET_SCHEMA)
    rows = sorted((r["thread_id"], r["agent_reply"], r["is_boilerplate"]) for r in H.reply_pairs(df, "Acme", handles=["acme"]).collect())
    assert rows == [
        ("tw_1", "@user Sorry to hear, please DM us", True), ("tw_1", "We are looking into it now", False), ("tw_2", "Answer to our own tweet", False),
    ]
    first = H.reply_pairs(df, "acme", handles=["acme"], first_reply_only=True).collect()
    assert sorted(r["thread_id"] for r in first) == ["tw_1", "tw_2"]


def test_answered_rows(spark):
    df = spark.createDataFrame(TWEETS, TWEET_SCHEMA)
    replies = H.by_author(df, "author_id", "ACME")
    assert {r["tweet_id"] for r in H.answered_rows(df, "tweet_id", replies, "in_response_to_tweet_id").collect()} == {1, 2, 7, 9}


def test_profile_of_nothing(spark):
    empty = spark.createDataFrame([], "customer_message string, agent_reply string, turns_count long, is_boilerplate boolean")
    row = H.profile(empty).first()
    assert row["threads"] == 0 and row["boilerplate_pct"] == 0.0


def test_ingest_from_both_sources(spark, tmp_path):
    companies = [("acme", i, t) for i, t in TRANSCRIPTS] + [("other", "z", TRANSCRIPTS[0][1])]
    source = str(tmp_path / "raw.parquet")
    spark.createDataFrame(companies, "company string, conversation_id string, conversation string").write.parquet(source)
    scan = readers.read_transcripts(spark, source, "acme")
    assert "PushedFilters: [IsNotNull(company), EqualTo(company,acme)]" in scan._jdf.queryExecution().executedPlan().toString()
    out, jsonl = str(tmp_path / "t.parquet"), str(tmp_path / "t.jsonl")
    assert run_ingest(spark, ["/nowhere.parquet", source], "acme", out, jsonl).first()["threads"] == 2
    assert "raw_turns_json" in spark.read.parquet(out).columns
    back = readers.read_jsonl(spark, jsonl, schemas.THREADS)
    assert back.where("size(raw_turns) = turns_count").count() == 2

    csv = str(tmp_path / "tweets.csv")
    rows = spark.createDataFrame(TWEETS, TWEET_SCHEMA).withColumns(
        {"text": F.concat("text", F.lit('\nsecond "line", é')), "inbound": F.lit(True), "created_at": F.lit("now"), "response_tweet_id": F.lit("")}
    )
    names = ["tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id"]
    rows.select(*names).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(csv)
    summary = run_ingest(spark, csv, "acme", str(tmp_path / "p.parquet"), str(tmp_path / "p.jsonl"), max_threads=3, multi_line=True)
    assert summary.first()["threads"] == 3
    assert 'second "line", é' in spark.read.parquet(str(tmp_path / "p.parquet")).first()["customer_message"]


def test_nested_json_text(spark):
    df = spark.createDataFrame([("é", [("customer", None)])], "id string, raw_turns array<struct<role string, text string>>")
    assert writers.nested_as_json(df).first()["raw_turns_json"] == '[{"role":"customer","text":null}]'
