"""Equi-joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Where all rows need not be counted, hot keys are looked for in this share of them.
PROBE_SHARE = 0.01
PROBE_MIN_ROWS = 1000


def hot_keys(df: DataFrame, keys: list[str], share: float = 1e-3, min_rows: int = 100_000) -> DataFrame:
    """Keys holding more than ``share`` of all rows: fewer than ``1/share`` of them exist."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("t"))
    floor = F.greatest(total.select(F.col("t") * F.lit(share)).scalar(), F.lit(float(min_rows)))
    return counts.where(F.col("_n") > floor).select(*keys)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    salt_by: Column,
    *,
    probe: DataFrame | None = None,
    salts: int = 256,
    share: float = 1e-3,
    min_rows: int = 100_000,
) -> DataFrame:
    """Join on ``keys`` (inner, left, left_semi, left_anti) with the left side's hot keys split.

    Rows of a hot left key spread over ``salts`` sub-keys; only the right rows of those keys are
    repeated once per sub-key, so results are those of the plain join. Left rows with a null key
    match nothing and are spread as well. ``salt_by`` should differ between rows of one key.
    The broadcast set of hot keys has fewer than ``1/share`` rows by construction.

    ``probe`` is where the hot keys are looked for, by default all keys of ``left``. It only
    steers the split, so where a key is costly to compute a part of the keys will do: the join
    itself always covers every row.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    hot = F.broadcast(
        hot_keys((left if probe is None else probe).dropna(subset=keys), keys, share, min_rows)
        .select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
        .withColumn("_hot", F.lit(True))
    )

    def flagged(df: DataFrame) -> DataFrame:
        on = None
        for k in keys:
            test = df[k] == F.col(f"_hot_{k}")
            on = test if on is None else on & test
        return df.join(hot, on, "left").drop(*[f"_hot_{k}" for k in keys])

    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    salt = F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")
    spread = (
        flagged(left.withColumn("_salt", salt))
        .withColumn("_salt", F.when(F.col("_hot") | null_key, F.col("_salt")).otherwise(F.lit(0)))
        .drop("_hot")
    )
    repeated = (
        flagged(right)
        .withColumn(
            "_salt",
            F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
        )
        .drop("_hot")
    )
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")
