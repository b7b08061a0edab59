"""Many keywords and rules in one pass, equal to the forms that test them one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlor.functions import rules as R
from parlor.operators import manyrules


@pytest.fixture(scope="module")
def texts(spark):
    order = np.random.default_rng(12)
    parts = ["refund", "REFUND", "baggage", "ſeat", "seat", "Kelvin", "kelvin", "a.b", "12345", "straße", "İstanbul", "x", "lost item", "Ünder", " ", "\n"]
    rows = [(i, " ".join(order.choice(parts, order.integers(0, 9)))) for i in range(300)] + [(1000, None), (1001, "")]
    return spark.createDataFrame(rows, "n long, text string").withColumn("lower", F.lower("text"))


def test_keyword_classes_equal_the_conditions(texts):
    order = np.random.default_rng(3)
    letters = list("abcdefilnorstuüß. ")
    table = {f"c{i}": ["".join(order.choice(letters, order.integers(1, 4))) for _ in range(20)] for i in range(40)}
    table |= {"same": ["refund", "Refund", ""], "other": ["refund"], "none": ["zzzz"], "bags": ["bagg", "gage"]}
    plain = {k: [t for t in v if t] for k, v in table.items()}
    expected = texts.select("n", R.keyword_classes(F.col("lower"), plain).alias("classes"))
    found = manyrules.keyword_classes(texts, "lower", table).select("n", "classes")
    assert sorted(map(str, found.where("n <> 1000").collect())) == sorted(map(str, expected.where("n <> 1000").collect()))
    assert found.where("n = 1000").first().classes == []


def test_rules_equal_the_conditions(texts):
    rules = [
        R.Rule("a", r"refund\s+baggage", "x"), R.Rule("b", r"(seat|lost) (item|seat)"), R.Rule("c", r"\bkelvin\b.*12345"), R.Rule("d", r"sea[ts]{1,2} lost"),
        R.Rule("e", r"stra(ss|ß)e x"), R.Rule("f", r"a\.b"), R.Rule("g", r"[0-9]{6,}"), R.Rule("h", r"\p{Lu}nder"), R.Rule("i", r"items? refund|none"),
        R.Rule("j", r"istanbul"), R.Rule("k", r"seat"), R.Rule("l", r"x?baggage"),
    ] + [R.Rule(f"z{i}", rf"word{i}\s+again") for i in range(300)]
    expected = texts.select("n", R.first_match(F.col("text"), rules).alias("rule"))
    found = manyrules.first_match(texts, "text", rules).select("n", "rule")
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    assert manyrules.first_match(texts, "text", []).where("rule is not null").count() == 0


@pytest.mark.parametrize(("pattern", "literal"), [
    ("refunds?", "refund"), ("a|bcdef", ""), (r"abc\.def+g", "abc.def"), ("ab[cd]efgh", "efgh"), ("(?i)hello", "hello"), (r"\bword\b", "word"),
    (r"colou{0,1}r", "colo"), ("x*yz", ""), (r"(abc|def)ghi(jkl)?", "ghi"), (r"[\]abc]def", "def"), (r"a\Qb.c\E", ""), (r"\p{L}+name", "name"), (r"(a(b)c)xyz", "xyz"),
])
def test_literals_are_in_every_match(pattern, literal):
    assert manyrules.mandatory_literal(pattern) == literal


def test_tables_beyond_one_automaton(texts, monkeypatch):
    table = {f"c{i}": [t] for i, t in enumerate(["refund", "baggage", "seat", "kelvin", "12345", "lost", "item"])}
    one = sorted(map(str, manyrules.keyword_classes(texts, "lower", table).select("n", "classes").collect()))
    monkeypatch.setattr(manyrules, "GROUP_CHARS", 10)
    assert sorted(map(str, manyrules.keyword_classes(texts, "lower", table).select("n", "classes").collect())) == one


def test_keywords_of_a_table(spark, texts):
    words = spark.createDataFrame([("Refund",), ("refund",), ("fun",), ("",), (None,), ("nowhere",)], "w string")
    found = {r.n: r.keywords for r in manyrules.keywords_found(texts, "lower", words, "w").collect()}
    lower = {r.n: r.lower for r in texts.collect()}
    assert all(k == [w for w in ("fun", "refund") if lower[n] and w in lower[n]] for n, k in found.items())
    with pytest.raises(ValueError, match="more than 1 keywords"):
        manyrules.keywords_found(texts, "lower", words, "w", most=1)
