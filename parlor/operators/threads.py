"""Turns and threads: transcript parsing, first message of each side, reply pairing, profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parlor import defaults as D
from parlor.functions import text as T
from parlor.operators.once import evaluate_once
from parlor.operators.skew import PROBE_MIN_ROWS, PROBE_SHARE, salted_join

CUSTOMER, SUPPORT = "customer", "support"

# How a line of a transcript names its speaker.
ROLE_PREFIXES = {CUSTOMER: "customer:", SUPPORT: "support:"}

TURNS_TYPE = "array<struct<role:string,text:string>>"


def parse_turns(
    transcript: Column, prefixes: Mapping[str, str] = ROLE_PREFIXES, handles: Sequence[str] = ()
) -> Column:
    """``array<struct(role, text)>`` of a transcript.

    A line that starts with a role prefix opens a turn and the lines after it continue it.
    Lines before the first prefix and turns without text after cleaning are dropped.
    """
    turns = F.transform(turn_pieces(transcript, prefixes), lambda piece: turn_of(piece, prefixes, handles))
    return F.filter(turns, lambda t: t["role"].isNotNull() & (t["text"] != "")).cast(TURNS_TYPE)


def turn_pieces(transcript: Column, prefixes: Mapping[str, str] = ROLE_PREFIXES) -> Column:
    """The transcript cut before every line that starts with a role prefix."""
    names = "|".join(r"\Q" + p + r"\E" for p in prefixes.values())
    opens = f"(?iu)(?:^|(?:{T.LINE_BREAK})){T.WHITESPACE_CLASS}*(?={names})"
    return F.split(F.coalesce(transcript, F.lit("")), opens)


def turn_of(piece: Column, prefixes: Mapping[str, str] = ROLE_PREFIXES, handles: Sequence[str] = ()) -> Column:
    """``struct(role, text)`` of a piece, the role null if it starts with no prefix."""
    lowered = F.lower(piece)
    role = F.coalesce(*[F.when(lowered.startswith(p.lower()), F.lit(r)) for r, p in prefixes.items()])
    body = F.coalesce(*[F.when(lowered.startswith(p.lower()), F.substr(piece, F.lit(len(p) + 1))) for p in prefixes.values()])
    return F.struct(role.alias("role"), T.clean_text(body, handles).alias("text"))


def threads_from_transcripts(
    df: DataFrame,
    id_col: str,
    transcript_col: str,
    *,
    prefixes: Mapping[str, str] = ROLE_PREFIXES,
    customer: str = CUSTOMER,
    support: str = SUPPORT,
    handles: Sequence[str] = (),
    boilerplate: str = D.BOILERPLATE_PATTERN,
    min_length: int = 8,
) -> DataFrame:
    """One thread per transcript in which both sides speak. Map-only."""
    turns = evaluate_once(
        df.select(F.col(id_col).cast("string").alias("thread_id"), F.col(transcript_col).alias("_transcript")),
        {"raw_turns": parse_turns(F.col("_transcript"), prefixes, handles)},
    )

    def texts(role: str) -> Column:
        return F.transform(F.filter("raw_turns", lambda t: t["role"] == role), lambda t: t["text"])

    sides = turns.withColumns({"_customer": texts(customer), "_support": texts(support)})
    threads = sides.where((F.size("_customer") > 0) & (F.size("_support") > 0)).select(
        "thread_id",
        F.get("_customer", F.lit(0)).alias("customer_message"),
        F.get("_support", F.lit(0)).alias("agent_reply"),
        F.size("raw_turns").cast("long").alias("turns_count"),
        F.size("_customer").cast("long").alias("num_customer_turns"),
        F.size("_support").cast("long").alias("num_support_turns"),
        "raw_turns",
    )
    return long_enough(threads, ["customer_message", "agent_reply"], min_length).withColumn(
        "is_boilerplate", T.matches(F.col("agent_reply"), boilerplate)
    )


def threads_from_turns(
    df: DataFrame,
    id_col: str,
    turn_col: str,
    role_col: str,
    text_col: str,
    *,
    customer: str = CUSTOMER,
    support: str = SUPPORT,
    handles: Sequence[str] = (),
    boilerplate: str = D.BOILERPLATE_PATTERN,
    min_length: int = 8,
    id_prefix: str = "",
) -> DataFrame:
    """One thread per conversation given as turn rows.

    A single aggregation with map-side partial results: a conversation of any length sends one
    partial row per task.
    """
    turns = evaluate_once(
        df.where(F.col(role_col).isin(customer, support)).select(id_col, turn_col, role_col, text_col),
        {"_text": T.clean_text(F.col(text_col), handles)},
    )
    is_customer, is_support = F.col(role_col) == customer, F.col(role_col) == support
    order = F.col(turn_col)
    threads = (
        turns.where(F.col("_text") != "")
        .groupBy(id_col)
        .agg(
            F.min_by(F.when(is_customer, F.col("_text")), F.when(is_customer, order)).alias("customer_message"),
            F.min_by(F.when(is_support, F.col("_text")), F.when(is_support, order)).alias("agent_reply"),
            F.count("*").alias("turns_count"),
            F.count_if(is_customer).alias("num_customer_turns"),
            F.count_if(is_support).alias("num_support_turns"),
        )
        .where((F.col("num_customer_turns") > 0) & (F.col("num_support_turns") > 0))
    )
    return (
        long_enough(threads, ["customer_message", "agent_reply"], min_length)
        .withColumn("thread_id", T.prefixed_id(id_prefix, F.col(id_col)))
        .withColumn("is_boilerplate", T.matches(F.col("agent_reply"), boilerplate))
        .select(
            "thread_id", "customer_message", "agent_reply", "turns_count", "num_customer_turns",
            "num_support_turns", "is_boilerplate",
        )
    )


def long_enough(df: DataFrame, columns: Sequence[str], min_length: int) -> DataFrame:
    for c in columns:
        df = df.where(F.length(c) >= min_length)
    return df


def by_author(df: DataFrame, author_col: str, author: str) -> DataFrame:
    """Any-case equality on the author."""
    return df.where(F.lower(F.col(author_col).cast("string")) == author.lower())


def answered_rows(df: DataFrame, id_col: str, replies: DataFrame, parent_col: str) -> DataFrame:
    """Rows that some reply names as its parent."""
    parents = replies.where(F.col(parent_col).isNotNull()).select(F.col(parent_col).alias(id_col)).distinct()
    return df.join(parents, id_col, "left_semi")


def reply_pairs(
    df: DataFrame,
    brand: str,
    *,
    id_col: str = "tweet_id",
    author_col: str = "author_id",
    parent_col: str = "in_response_to_tweet_id",
    text_col: str = "text",
    handles: Sequence[str] = (),
    boilerplate: str = D.BOILERPLATE_PATTERN,
    min_length: int = 8,
    id_prefix: str = "tw_",
    first_reply_only: bool = False,
) -> DataFrame:
    """One thread per (message, brand reply to it); several replies give several threads.

    Both sides are cut to the needed columns and cleaned before the shuffle. A message with very
    many replies is split by :func:`salted_join`.
    """
    by_brand = by_author(df.dropna(subset=[parent_col]), author_col, brand).select(
        F.col(parent_col).alias("_id"), F.col(id_col).alias("_reply_id"), F.col(text_col).alias("_text")
    )
    replies = evaluate_once(by_brand, {"agent_reply": T.clean_text(F.col("_text"), handles)}).drop("_text")
    if first_reply_only:
        first = W.partitionBy("_id").orderBy("_reply_id")
        replies = replies.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    messages = evaluate_once(
        df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")),
        {"customer_message": T.clean_text(F.col("_text"), handles)},
    ).drop("_text")
    pairs = salted_join(
        long_enough(replies, ["agent_reply"], min_length),
        long_enough(messages, ["customer_message"], min_length),
        ["_id"],
        "inner",
        F.col("_reply_id"),
        probe=by_brand.select("_id").sample(PROBE_SHARE, seed=42),
        min_rows=PROBE_MIN_ROWS,
    )

    def turn(role: str, column: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(column).alias("text"))

    return pairs.select(
        T.prefixed_id(id_prefix, F.col("_id")).alias("thread_id"),
        "customer_message",
        "agent_reply",
        F.lit(2).cast("long").alias("turns_count"),
        F.lit(1).cast("long").alias("num_customer_turns"),
        F.lit(1).cast("long").alias("num_support_turns"),
        T.matches(F.col("agent_reply"), boilerplate).alias("is_boilerplate"),
        F.array(turn(CUSTOMER, "customer_message"), turn(SUPPORT, "agent_reply")).alias("raw_turns"),
    )


def profile(threads: DataFrame) -> DataFrame:
    """Summary of a thread table: counts, turn statistics, boilerplate share, mean words."""
    flag = F.col("is_boilerplate").cast("double")
    return threads.agg(
        F.count("*").alias("threads"),
        F.avg("turns_count").alias("avg_turns"),
        F.max("turns_count").alias("max_turns"),
        F.count_if("is_boilerplate").alias("boilerplate_replies"),
        (F.coalesce(F.avg(flag), F.lit(0.0)) * 100.0).alias("boilerplate_pct"),
        F.avg(T.word_count(F.col("customer_message"))).alias("avg_customer_words"),
        F.avg(T.word_count(F.col("agent_reply"))).alias("avg_reply_words"),
    )
