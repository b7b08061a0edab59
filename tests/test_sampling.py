"""Sampling, quotas, numbering, deduplication and skew-proof joins."""

import hashlib

import pytest
from pyspark.sql import functions as F

from parlor.operators import evalsets, sampling as P
from parlor.operators.bounded import control_rows
from parlor.operators.skew import hot_keys, salted_join


def order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)))


@pytest.mark.parametrize("n", [0, 1, 17, 4999, 5000, 9000])
def test_sample_is_exact_and_seeded(numbers, n):
    got = [r["id"] for r in P.sample_n(numbers, n, "id").collect()]
    assert sorted(got) == sorted(order(range(5000))[:n])


def test_sample_ignores_partitioning(numbers):
    results = [sorted(r["id"] for r in P.sample_n(numbers.repartition(k), 100, "id", seed=7).collect()) for k in (1, 7, 50)]
    assert results[0] == results[1] == results[2] == sorted(order(range(5000), 7)[:100])


def test_shuffle_rank(numbers):
    ranks = {r["id"]: r["shuffle_rank"] for r in P.with_shuffle_rank(numbers, "id").collect()}
    assert ranks == {i: n for n, i in enumerate(order(range(5000)), 1)}


@pytest.mark.parametrize("quotas", [{"hot": 10, "k1": 3, "absent": 4}, {"hot": 1000, "k1": 5000, "k2": 0}])
def test_quota_sample(numbers, quotas):
    groups = {}
    for r in numbers.collect():
        groups.setdefault(r["g"], []).append(r["id"])
    expected = sorted(i for g, q in quotas.items() for i in order(groups.get(g, []))[:q])
    drawn = P.quota_sample(numbers, "g", quotas, "id")
    assert sorted(r["id"] for r in drawn.collect()) == expected


def test_first_per_key_combines_before_the_shuffle(numbers):
    kept = P.first_per_key(numbers, F.col("g"), "id")
    groups = {}
    for r in numbers.collect():
        groups.setdefault(r["g"], []).append(r["id"])
    assert {r["g"]: r["id"] for r in kept.collect()} == {g: order(ids)[0] for g, ids in groups.items()}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, numbers, how):
    left = numbers.select("id", F.when(F.col("id") < 4990, F.col("g")).alias("g"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("k2", 4), (None, 5)], "g string, v int")
    plain = left.join(right, "g", how)
    salted = salted_join(left, right, ["g"], how, F.col("id"), salts=8, min_rows=100)
    assert sorted(map(str, salted.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_hot_keys_are_few(numbers):
    assert [r["g"] for r in hot_keys(numbers, ["g"], share=0.1, min_rows=10).collect()] == ["hot"]


def test_salting_spreads_the_hot_key(spark, numbers):
    # Every sub-key of the hot key gets its share of the rows.
    probe = numbers.where("g = 'hot'").select(F.pmod(F.xxhash64("id"), F.lit(8)).alias("s")).groupBy("s").count()
    sizes = [r["count"] for r in probe.collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_unused_texts(spark):
    rows = spark.createDataFrame([(1, " Hello "), (2, "new"), (3, "HELLO"), (4, None)], "id int, t string")
    used = spark.createDataFrame([("hello ",), ("x",)], "u string")
    assert {r["id"] for r in evalsets.unused_texts(rows, used, "t", "u", "id").collect()} == {2, 4}


def test_bounded_tables(spark, numbers):
    assert len(control_rows(numbers.limit(5))) == 5
    with pytest.raises(ValueError):
        control_rows(numbers, max_rows=10)
