"""Evaluation sets: hold-out, unused texts, leakage checks, distributions, audits."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from parlor.functions import scoring as S, text as T
from parlor.operators.once import evaluate_once
from parlor.operators.skew import PROBE_MIN_ROWS, PROBE_SHARE, salted_join


def held_out(df: DataFrame, corpus: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is not in the corpus (null ids stay)."""
    return df.join(corpus.select(id_col).distinct(), id_col, "left_anti")


def unused_texts(df: DataFrame, used: DataFrame, text_col: str, used_col: str, id_col: str) -> DataFrame:
    """Rows whose lowered, stripped text is not among the used ones.

    Joins on fixed-width digests; copies of one text are spread by the salted join, whose hot
    texts are looked for in a hundredth of the rows to save hashing every text twice.
    """
    taken = evaluate_once(used.select(used_col), {"_digest": T.digest(T.text_key(F.col(used_col)))}).select("_digest").distinct()
    digest = T.digest(T.text_key(F.col(text_col)))
    keyed = evaluate_once(df, {"_digest": digest})
    probe = evaluate_once(df.select(text_col).sample(PROBE_SHARE, seed=42), {"_digest": digest}).select("_digest")
    return salted_join(
        keyed, taken, ["_digest"], "left_anti", F.col(id_col), probe=probe, min_rows=PROBE_MIN_ROWS
    ).select(*df.columns)


def shared_texts(a: DataFrame, b: DataFrame, a_col: str, b_col: str) -> DataFrame:
    """Texts equal after lowering and stripping: ``(digest, rows_a, rows_b)``.

    One aggregation over both sides instead of a join; copies combine before the shuffle.
    """
    digests = _tagged(a, T.digest(T.text_key(F.col(a_col))), 1).unionByName(_tagged(b, T.digest(T.text_key(F.col(b_col))), 2))
    counts = digests.groupBy(F.col("key").alias("digest")).agg(
        F.count_if(F.col("side") == 1).alias("rows_a"), F.count_if(F.col("side") == 2).alias("rows_b")
    )
    return counts.where((F.col("rows_a") > 0) & (F.col("rows_b") > 0))


def _tagged(df: DataFrame, key: Column, side: int) -> DataFrame:
    return df.select(F.inline(F.array(F.struct(key.alias("key"), F.lit(side).alias("side"))))).where(F.col("key").isNotNull())


def leakage_audit(
    corpus: DataFrame,
    evaluation: DataFrame,
    seeds: DataFrame | None = None,
    *,
    corpus_id: str,
    evaluation_id: str,
    corpus_text: str,
    evaluation_text: str,
    seed_text: str | None = None,
) -> DataFrame:
    """One row per check with the number of shared keys; 0 everywhere means no leak.

    Every table is read once. Ids and text digests are grouped together, and the sides that hold
    a key are collected as bits: 1 corpus, 2 evaluation set, 4 seeds.
    """

    def keys(df: DataFrame, side: int, text_col: str, id_col: str | None = None) -> DataFrame:
        kinds = [F.struct(F.lit("text").alias("kind"), T.digest(T.text_key(F.col(text_col))).alias("key"))]
        if id_col is not None:
            kinds.append(F.struct(F.lit("id").alias("kind"), F.col(id_col).cast("string").alias("key")))
        return df.select(F.inline(F.array(*kinds)), F.lit(side).alias("side")).where(F.col("key").isNotNull())

    tagged = keys(corpus, 1, corpus_text, corpus_id).unionByName(keys(evaluation, 2, evaluation_text, evaluation_id))
    checks = [("corpus_evaluation_ids", "id", 3), ("corpus_evaluation_texts", "text", 3)]
    if seeds is not None and seed_text is not None:
        tagged = tagged.unionByName(keys(seeds, 4, seed_text))
        checks.append(("evaluation_seed_texts", "text", 6))
    sides = tagged.groupBy("kind", "key").agg(F.bit_or("side").alias("sides"))

    def shared(kind: str, bits: int) -> Column:
        return F.count_if((F.col("kind") == kind) & (F.col("sides").bitwiseAND(F.lit(bits)) == bits))

    counts = sides.agg(
        F.array(*[F.struct(F.lit(name).alias("check"), shared(kind, bits).alias("shared")) for name, kind, bits in checks]).alias("c")
    )
    return counts.select(F.inline("c"))


def distribution(df: DataFrame, *columns: str) -> DataFrame:
    """Row count and percentage per value, largest first."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / total).orderBy(F.col("n").desc(), *columns)


def audit_join(evaluation: DataFrame, scores: DataFrame, id_col: str = "example_id") -> DataFrame:
    """Audit records: scored examples with their nested human scores and mean."""
    dims = ["groundedness", "correctness", "tone_empathy", "completeness"]
    total = F.col(dims[0]) + F.col(dims[1]) + F.col(dims[2]) + F.col(dims[3])
    joined = evaluation.join(scores, id_col)
    return joined.withColumn(
        "human_scores", F.struct(*dims, S.half_even(total / 4.0, 2).alias("overall"))
    ).drop(*dims)


def table_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows, columns, and null cells."""

    def audit(name: str, df: DataFrame) -> DataFrame:
        nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
        return df.agg(F.count("*").alias("rows"), nulls.alias("null_cells")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"), "null_cells"
        )

    return reduce(DataFrame.unionByName, [audit(n, d) for n, d in tables.items()])


def missing_columns(df: DataFrame, expected: Mapping[str, str]) -> list[str]:
    """Expected ``name: type`` pairs that the table lacks (schema check, no job)."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"{c}: {t}" for c, t in expected.items() if actual.get(c) != t]
