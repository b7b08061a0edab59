"""Clustering evaluation: silhouettes, a k-means step and the k-means sweep."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from parlor.functions.scoring import half_even
from parlor.functions.vectors import as_double
from parlor.operators import lloyd
from parlor.operators.bounded import control_rows


# Distances held at once by a task, and rows of the smallest block that is worth a task of its own.
DISTANCE_CELLS, LEAST_BLOCK = 2_000_000, 2048


def silhouette_points(
    df: DataFrame, id_col: str, cluster_col: str, vector_col: str, block_rows: int = 65_536, rows: int | None = None
) -> DataFrame:
    """``(id, cluster, a, b, silhouette)`` per point, with Euclidean distances.

    Points meet in block pairs of bounded size. A pair returns one distance sum per point and
    cluster, never the distances themselves. The work grows with the square of the row count, and each row
    is sent to every block: to a dozen, and beyond a dozen times ``block_rows`` rows to one for each ``block_rows``.
    :func:`silhouette_scores` is the linear form. ``rows`` saves counting where the number (or a bound) is known.
    """
    count = df.count() if rows is None else rows
    blocks = max(1, math.ceil(count / block_rows), min(12, math.ceil(count / LEAST_BLOCK)))
    kind = df.schema[vector_col].dataType
    # Single precision stays as it is on the way; tasks compute in double precision.
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    points = df.select(
        F.col(id_col).alias("id"),
        F.col(cluster_col).cast("string").alias("cluster"),
        (F.col(vector_col) if single else as_double(F.col(vector_col))).alias("v"),
    )
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left_side = points.withColumn("_row", block).withColumn("_col", every)
    right_side = points.withColumn("_col", block).withColumn("_row", every)
    id_type = points.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, cluster string, other string, total double, members bigint"

    def distance_sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["id", "cluster", "other", "total", "members"])
        a, ids = np.stack(left["v"].to_numpy()).astype(np.float64), left["id"].to_numpy()
        # Only a block that meets itself holds a point twice.
        itself = left["_row"].iloc[0] == left["_col"].iloc[0]
        lengths, parts = (a * a).sum(1), []
        for other, members in right.groupby("cluster"):
            b, total = np.stack(members["v"].to_numpy()).astype(np.float64), np.empty(len(a))
            squares, own = (b * b).sum(1), members["id"].to_numpy()
            step = max(1, DISTANCE_CELLS // len(b))
            for start in range(0, len(a), step):
                here = slice(start, start + step)
                distance = a[here] @ b.T
                distance *= -2.0
                distance += lengths[here, None]
                distance += squares
                np.sqrt(np.maximum(distance, 0.0, out=distance), out=distance)
                if itself:
                    # The point itself is at distance 0, whatever rounding says.
                    distance[ids[here, None] == own[None, :]] = 0.0
                total[here] = distance.sum(1)
            parts.append(
                pd.DataFrame({"id": left["id"], "cluster": left["cluster"], "other": other, "total": total, "members": len(members)})
            )
        return pd.concat(parts)

    pairs = left_side.groupBy("_row", "_col").cogroup(right_side.groupBy("_row", "_col"))
    sums = pairs.applyInPandas(distance_sums, schema)
    per_cluster = sums.groupBy("id", "cluster", "other").agg(F.sum("total").alias("total"), F.sum("members").alias("members"))
    own = F.col("cluster") == F.col("other")
    per_point = per_cluster.groupBy("id", "cluster").agg(
        F.sum(F.when(own, F.col("members"))).alias("_own"),
        F.sum(F.when(own, F.try_divide(F.col("total"), F.col("members") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("members"))).alias("b"),
    )
    score = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return per_point.withColumn(
        "silhouette", F.when(F.col("_own") > 1, F.coalesce(score, F.lit(0.0))).otherwise(F.lit(0.0))
    ).drop("_own")


def cluster_moments(df: DataFrame, cluster_col: str, vector_col: str) -> DataFrame:
    """``(cluster, members, total, squares)``: count, sum of vectors and sum of squared lengths, in one aggregate."""
    vector = array_to_vector(as_double(F.col(vector_col)))
    return df.groupBy(F.col(cluster_col).cast("string").alias("cluster")).agg(
        F.count("*").alias("members"), Summarizer.sum(vector).alias("s"), Summarizer.sum(_squared(vector_col)).alias("q")
    ).select("cluster", "members", vector_to_array("s").alias("total"), vector_to_array("q")[0].alias("squares"))


def _squared(vector_col: str):
    return array_to_vector(F.array(F.aggregate(as_double(F.col(vector_col)), F.lit(0.0), lambda t, x: t + x * x)))


def silhouette_scores(df: DataFrame, id_col: str, cluster_col: str, vector_col: str) -> DataFrame:
    """``(id, cluster, a, b, silhouette)`` of every point under squared Euclidean distances.

    The mean squared distance of a point to a cluster follows from the cluster's moments, so all points are
    scored in one map over a broadcast of the moments (a checked number of clusters): linear in the rows.
    """
    moments = control_rows(cluster_moments(df, cluster_col, vector_col).orderBy("cluster"))
    names = {r["cluster"]: i for i, r in enumerate(moments)}
    members = np.asarray([r["members"] for r in moments], dtype=np.float64)
    totals = np.asarray([r["total"] for r in moments], dtype=np.float64)
    squares = np.asarray([r["squares"] for r in moments], dtype=np.float64)
    shared = df.sparkSession.sparkContext.broadcast((names, members, totals, squares))

    @F.pandas_udf("a double, b double, silhouette double")
    def score(clusters: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        index, n, s, q = shared.value
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        own = clusters.map(index).to_numpy()
        sums = n[None, :] * (x * x).sum(axis=1)[:, None] - 2.0 * (x @ s.T) + q[None, :]
        rows = np.arange(len(x))
        a = np.where(n[own] > 1, sums[rows, own] / np.maximum(n[own] - 1, 1), 0.0)
        means = sums / n[None, :]
        means[rows, own] = np.inf
        b = means.min(axis=1)
        top = np.maximum(a, b)
        value = np.where((n[own] > 1) & np.isfinite(b) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)
        return pd.DataFrame({"a": a, "b": b, "silhouette": value})

    points = df.select(F.col(id_col).alias("id"), F.col(cluster_col).cast("string").alias("cluster"), F.col(vector_col).alias("v"))
    scored = points.withColumn("_s", score.asNondeterministic()("cluster", as_double(F.col("v"))))
    return scored.select("id", "cluster", "_s.a", "_s.b", "_s.silhouette")


def silhouette(df: DataFrame, id_col: str, cluster_col: str, vector_col: str) -> DataFrame:
    """Number of points and mean silhouette over all rows, see :func:`silhouette_scores`.

    :func:`silhouette_points` has the Euclidean form, whose work grows with the square of the rows, and
    :func:`parlor.operators.lloyd.silhouette_balls` a linear one with a bound of its error.
    """
    return _mean_silhouette(silhouette_scores(df, id_col, cluster_col, vector_col))


def _mean_silhouette(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("points"), F.avg("silhouette").alias("silhouette"))


def kmeans_step(df: DataFrame, vector_col: str, centres: Sequence[tuple[str, Sequence[float]]]) -> DataFrame:
    """``(cluster, members, cost)``: sizes and summed squared distances when every row goes to its nearest centre.

    Equally near centres go to the first one in the list.
    """
    names = [c for c, _ in centres]
    table = df.sparkSession.sparkContext.broadcast(np.asarray([v for _, v in centres], dtype=np.float64))

    @F.pandas_udf("cluster int, cost double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        x, c = np.stack(vectors.to_numpy()).astype(np.float64), table.value
        squared = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
        best = squared.argmin(axis=1)
        return pd.DataFrame({"cluster": best.astype(np.int32), "cost": np.maximum(squared[np.arange(len(x)), best], 0.0)})

    placed = df.select(nearest.asNondeterministic()(as_double(F.col(vector_col))).alias("p")).select("p.*")
    sums = placed.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("cost").alias("cost"))
    return sums.withColumn("cluster", F.get(F.array(*[F.lit(n) for n in names]), F.col("cluster")))


def cluster_sweep(
    df: DataFrame,
    id_col: str,
    vector_col: str,
    *,
    ks: Iterable[int] = range(6, 13),
    restarts: int = 5,
    seed: int = 42,
    turns: int = 20,
) -> DataFrame:
    """``(k, silhouette, cluster_distribution)`` of the best of several k-means runs per k, over all rows.

    All runs share the scans, see :func:`parlor.operators.lloyd.fit_all`: one job per iteration, and one for the silhouettes.
    """
    points, ks = lloyd.points_of(df, id_col, vector_col), list(dict.fromkeys(ks))
    fits = lloyd.fit_all(points, lloyd.drawn_starts(points, ks, restarts, seed), turns=turns)
    best = {k: min((m for (n, _), m in fits.items() if n == k), key=lambda m: m.cost) for k in ks if (k, 0) in fits}
    scores = lloyd.mean_silhouettes(points, best)
    rows = [(k, scores[k], sorted((int(n) for n in m.members if n), reverse=True)) for k, m in best.items()]
    found = df.sparkSession.createDataFrame(rows, "k int, silhouette double, cluster_distribution array<bigint>")
    return found.withColumn("silhouette", half_even(F.col("silhouette"), 4))
