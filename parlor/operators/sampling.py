"""Seeded sampling, quotas and numbering: exact in size, independent of partitioning.

Rows are ordered by ``md5(seed:id)``. The first four hex digits cut that order into at most
65,536 even buckets per group, so a cut-off is found from small counts and no row set is ever
sorted in one task. ``id`` must identify a row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parlor.functions.text import digest

AFTER_LAST_BUCKET = "g"


def shuffle_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _keyed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.withColumn("_key", shuffle_key(id_col, seed)).withColumn("_bucket", F.substring("_key", 1, 4))


def _running_counts(keyed: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per group and bucket: rows, and rows in all earlier buckets."""
    counts = keyed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_rows"))
    earlier = (
        W.partitionBy(*(groups or [F.lit(0)])).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    )
    return counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))


def _rank_in_bucket(groups: Sequence[str], id_col: str) -> Column:
    return F.row_number().over(W.partitionBy(*groups, "_bucket").orderBy("_key", id_col))


def sample_n(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if there are no more than ``n``).

    Two narrow scans; only about ``n`` rows are shuffled.
    """
    keyed = _keyed(df, id_col, seed)
    cut = (
        _running_counts(keyed, [])
        .where(F.col("_before") + F.col("_rows") >= n)
        .agg(
            F.struct(
                F.coalesce(F.min("_bucket"), F.lit(AFTER_LAST_BUCKET)).alias("bucket"),
                F.coalesce(F.min("_before"), F.lit(0)).alias("before"),
            )
        )
        .scalar()
    )
    bucket, before = cut["bucket"], cut["before"]
    return (
        keyed.where(F.col("_bucket") <= bucket)
        .withColumn("_position", _rank_in_bucket([], id_col))
        .where((F.col("_bucket") < bucket) | (F.col("_position") <= F.lit(n) - before))
        .drop("_key", "_bucket", "_position")
    )


def with_shuffle_rank(
    df: DataFrame, id_col: str, seed: int = 42, groups: Sequence[str] = (), name: str = "shuffle_rank"
) -> DataFrame:
    """1-based position of every row in the seeded shuffle of its group, without a global sort."""
    groups = list(groups)
    keyed = _keyed(df, id_col, seed)
    offsets = _running_counts(keyed, groups).select(*groups, "_bucket", "_before")
    return (
        keyed.withColumn("_position", _rank_in_bucket(groups, id_col))
        .join(offsets, [*groups, "_bucket"])
        .withColumn(name, (F.col("_position") + F.col("_before")).cast("long"))
        .drop("_key", "_bucket", "_position", "_before")
    )


def quota_sample(
    df: DataFrame, class_col: str, quotas: Mapping[str, int], id_col: str, seed: int = 42
) -> DataFrame:
    """The first ``quotas[class]`` rows of each class in shuffled order; other classes drop out.

    Bucket counts give the cut of each class, so no task ever sees more than one bucket of a class.
    """
    keyed = _keyed(df.where(F.col(class_col).isin(list(quotas))), id_col, seed)
    quota = F.create_map(*[F.lit(x) for c, q in quotas.items() for x in (c, int(q))])[F.col(class_col)]
    cuts = (
        _running_counts(keyed, [class_col])
        .withColumn("_quota", quota)
        .groupBy(class_col)
        .agg(
            F.min(F.when(F.col("_before") + F.col("_rows") >= F.col("_quota"), F.col("_bucket"))).alias("_cut"),
            F.min(F.when(F.col("_before") + F.col("_rows") >= F.col("_quota"), F.col("_before"))).alias("_cut_before"),
        )
        .withColumn("_cut", F.coalesce("_cut", F.lit(AFTER_LAST_BUCKET)))
    )
    # One row per quota entry, a table passed in by the caller as a dictionary.
    return (
        keyed.join(F.broadcast(cuts), class_col)
        .where(F.col("_bucket") <= F.col("_cut"))
        .withColumn("_position", _rank_in_bucket([class_col], id_col))
        .where((F.col("_bucket") < F.col("_cut")) | (F.col("_position") <= quota - F.col("_cut_before")))
        .drop("_key", "_bucket", "_cut", "_cut_before", "_position")
    )


def first_per_key(df: DataFrame, key: Column, id_col: str, seed: int = 42) -> DataFrame:
    """Keep the first row of each key in shuffled order.

    The rank filter runs inside every map task before the shuffle, so a group of copies sends
    at most one row per task.
    """
    return first_per_digest(df.withColumn("_digest", digest(key)), "_digest", id_col, seed).drop("_digest")


def first_per_digest(df: DataFrame, digest_col: str, id_col: str, seed: int = 42) -> DataFrame:
    """:func:`first_per_key` for a key column; the result is partitioned by that column."""
    order = W.partitionBy(digest_col).orderBy("_key", id_col)
    return (
        df.withColumn("_key", shuffle_key(id_col, seed))
        .withColumn("_position", F.row_number().over(order))
        .where(F.col("_position") == 1)
        .drop("_key", "_position")
    )
