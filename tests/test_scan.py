"""Turns read line by line over ranges, equal to whole transcripts parsed at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlor.operators import scan, threads


def lines_of(seed, conversations, hot=0):
    order = np.random.default_rng(seed)
    starts = ["customer: hello", "support: hi there", "Customer:  ", "more text", "", "a line\n  SUPPORT: inside", "  customer: x\nand y", "support:\n", None]
    rows = []
    for c in range(conversations):
        count = hot if c == 3 and hot else int(order.integers(0, 12))
        rows += [(c if c else None, i, starts[order.integers(0, len(starts))]) for i in range(count)]
    order.shuffle(rows)
    return [(None if a is None else int(a), int(b), None if t is None else str(t)) for a, b, t in rows]


def expected(spark, rows):
    whole = {}
    for c, i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        whole.setdefault(c, []).append(text or "")
    df = spark.createDataFrame([(c, "\n".join(t)) for c, t in whole.items()], "id long, t string")
    turns = df.select("id", F.posexplode(threads.parse_turns(F.col("t"))).alias("position", "x")).select("id", "position", "x.role", "x.text")
    return sorted(map(tuple, turns.collect()), key=str)


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_lines_give_the_turns_of_whole_transcripts(spark, partitions):
    rows = lines_of(int(partitions), 40, hot=150)
    df = spark.createDataFrame(rows, "c long, i int, line string")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = scan.turns_of_lines(df, "c", ["i"], "line").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, found), key=str) == expected(spark, rows)


def test_one_turn_over_many_ranges_and_no_rows(spark):
    rows = [(1, 0, "customer: first")] + [(1, i, f"line {i}") for i in range(1, 400)] + [(1, 400, "support: last"), (0, 0, "no turn at all")]
    df = spark.createDataFrame(rows, "c long, i int, line string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = sorted(map(tuple, scan.turns_of_lines(df, "c", ["i"], "line").collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == [(1, 0, "customer", " ".join(["first", *[f"line {i}" for i in range(1, 400)]])), (1, 1, "support", "last")]
    assert scan.turns_of_lines(df.limit(0), "c", ["i"], "line").count() == 0
