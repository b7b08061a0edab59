"""Many k-means models in one scan of the points per iteration, and Euclidean silhouettes from balls.

:func:`fit_all` moves the centres of all models at once: a task multiplies a batch of points with all centres, and sends one
row per centre (members, sum, sum of squared lengths, cost) however many points it has; these are added up by a grouped
aggregation, so an iteration is one job for any number of models. Models whose centres have settled leave the scan.

:func:`silhouette_balls` is the Euclidean silhouette in linear work. Each cluster is covered by at most ``balls`` balls (its points
dealt to the nearest of some of them); the sum of distances from a point to a cluster is taken to the balls' means, each counted as
often as it has members. By the triangle inequality a mean distance is wrong by no more than the cluster's mean distance
of points to their ball's mean, which is returned as the bound; with a ball for every point the result is exact.

Null vectors are left out. Equally near centres go to the first one. A centre without members stays where it is. No rows give no
models or scores; the tables of centres and balls have a checked size.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window as W, functions as F

from parlor.functions.vectors import as_double
from parlor.operators.bounded import control_rows
from parlor.session import durable

#: Numbers in the broadcast tables of centres and balls.
MAX_NUMBERS = 16_000_000
STEP_ROWS = 4096
STATES = "model int, cluster int, members long, cost double, squares double, total array<double>"


@dataclass
class Model:
    """Centres, and what the last scan said about the points nearest to each of them."""

    centres: np.ndarray
    members: np.ndarray
    totals: np.ndarray
    squares: np.ndarray
    cost: float


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(1)[None, :], 0.0)


def _rows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    vectors = batch.column(0)
    for start in range(0, len(vectors), STEP_ROWS):
        part = vectors.slice(start, STEP_ROWS)
        yield part.flatten().to_numpy().reshape(len(part), -1)


def assignment(points: DataFrame, models: Sequence[np.ndarray]) -> DataFrame:
    """``model, cluster, members, cost, squares, total``: every point goes to the nearest centre of each model. One scan."""
    shared = points.sparkSession.sparkContext.broadcast([np.asarray(m) for m in models])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        every = np.concatenate(centres)
        starts = np.cumsum([0, *[len(m) for m in centres]])
        members, cost, squares = (np.zeros(len(every)) for _ in range(3))
        totals = np.zeros_like(every)
        for batch in batches:
            for x in _rows(batch):
                distance, lengths, here = _squared(x, every), (x * x).sum(1), np.arange(len(x))
                for a, b in zip(starts, starts[1:]):
                    own = distance[:, a:b].argmin(1)
                    members[a:b] += np.bincount(own, minlength=b - a)
                    cost[a:b] += np.bincount(own, weights=distance[here, a + own], minlength=b - a)
                    squares[a:b] += np.bincount(own, weights=lengths, minlength=b - a)
                    np.add.at(totals, a + own, x)
        held = np.flatnonzero(members)
        model = np.repeat(np.arange(len(centres)), np.diff(starts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(model[held], pa.int32()), pa.array((np.arange(len(every)) - starts[model])[held], pa.int32()), pa.array(members[held].astype(np.int64)),
             pa.array(cost[held]), pa.array(squares[held]), pa.array(list(totals[held]), pa.list_(pa.float64()))],
            names=["model", "cluster", "members", "cost", "squares", "total"],
        )

    parts = points.select("v").mapInArrow(scan, STATES)
    total = vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")
    return parts.groupBy("model", "cluster").agg(*[F.sum(c).alias(c) for c in ("members", "cost", "squares")], total)


def _states(points: DataFrame, models: Mapping[object, np.ndarray]) -> dict[object, Model]:
    names = list(models)
    found = {
        name: Model(c, np.zeros(len(c)), np.zeros_like(c), np.zeros(len(c)), 0.0) for name, c in ((n, np.asarray(models[n], dtype=np.float64)) for n in names)
    }
    for r in assignment(points, [found[n].centres for n in names]).collect():
        state = found[names[r["model"]]]
        state.members[r["cluster"]], state.squares[r["cluster"]] = r["members"], r["squares"]
        state.totals[r["cluster"]] = r["total"]
        state.cost += r["cost"]
    return found


def fit_all(points: DataFrame, starts: Mapping[object, np.ndarray], *, turns: int = 20, tolerance: float = 1e-4) -> dict[object, Model]:
    """Lloyd's iterations of all models over ``points (id, v)``, durable; the members and cost are those of the last centres.

    A model has settled when no centre moves farther than ``tolerance``.
    """
    if sum(np.asarray(c).size for c in starts.values()) > MAX_NUMBERS:
        raise ValueError("the models' centres are more than a broadcast should hold")
    moving = {name: np.asarray(c, dtype=np.float64) for name, c in starts.items()}
    done: dict[object, Model] = {}
    for turn in range(turns + 1):
        states = _states(points, moving)
        for name, state in states.items():
            held = state.members > 0
            new = state.centres.copy()
            new[held] = state.totals[held] / state.members[held, None]
            if turn == turns or np.sqrt(((new - state.centres) ** 2).sum(1)).max(initial=0.0) <= tolerance:
                done[name] = state
                moving.pop(name)
            else:
                moving[name] = new
        if not moving:
            break
    return done


def points_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return durable(df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), as_double(F.col(vector_col)).alias("v")))


def drawn_starts(points: DataFrame, ks: Sequence[int], restarts: int, seed: int) -> dict[tuple[int, int], np.ndarray]:
    """For each k and restart as many rows as it has centres, drawn by a seeded hash; fewer where there are fewer rows."""
    most = max(ks) * restarts
    rows = points.orderBy(F.xxhash64(F.lit(seed), "id", "v")).limit(most).select("v").toPandas()["v"]
    pool = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, 1))
    rng = np.random.default_rng(seed)
    return {(k, r): pool[rng.permutation(len(pool))[: min(k, len(pool))]] for k in ks for r in range(restarts) if len(pool)}


def mean_silhouettes(points: DataFrame, models: Mapping[object, Model]) -> dict[object, float]:
    """Mean silhouette (squared distances, from the clusters' moments) of several models, all in one scan."""
    names = list(models)
    shared = points.sparkSession.sparkContext.broadcast([(m.centres, m.members, m.totals, m.squares) for m in models.values()])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros(len(shared.value)), 0
        for batch in batches:
            for x in _rows(batch):
                lengths, here = (x * x).sum(1), np.arange(len(x))
                rows += len(x)
                for i, (centres, n, totals, squares) in enumerate(shared.value):
                    own, held = _squared(x, centres).argmin(1), np.maximum(n, 1)
                    sum_to = n[None, :] * lengths[:, None] - 2.0 * (x @ totals.T) + squares[None, :]
                    a = np.where(n[own] > 1, sum_to[here, own] / np.maximum(n[own] - 1, 1), 0.0)
                    means = np.where(n[None, :] > 0, sum_to / held[None, :], np.inf)
                    means[here, own] = np.inf
                    b = means.min(1)
                    top = np.maximum(a, b)
                    good = (n[own] > 1) & np.isfinite(b) & (top > 0)
                    sums[i] += np.where(good, (b - a) / np.where(good, top, 1.0), 0.0).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(sums)), pa.int32()), pa.array(sums), pa.array([rows] * len(sums), pa.int64())], names=["model", "score", "rows"]
        )

    found = points.select("v").mapInArrow(scan, "model int, score double, rows long").groupBy("model").agg(F.sum("score").alias("s"), F.sum("rows").alias("n"))
    return {names[r["model"]]: r["s"] / r["n"] for r in found.collect() if r["n"]}


def silhouette_balls(df: DataFrame, id_col: str, cluster_col: str, vector_col: str, *, balls: int = 64, seed: int = 42) -> DataFrame:
    """``(id, cluster, a, b, silhouette, bound)``: ``a`` and every mean distance behind ``b`` are wrong by ``bound`` at most.

    Work and shuffle grow with the rows: two grouped aggregations with partial results and two maps over a broadcast of balls.
    """
    points = durable(
        df.where(F.col(vector_col).isNotNull()).select(
            F.col(id_col).alias("id"), F.col(cluster_col).cast("string").alias("cluster"), as_double(F.col(vector_col)).alias("v")
        )
    )
    sizes = {r["cluster"]: r["n"] for r in control_rows(points.groupBy("cluster").agg(F.count("*").alias("n")))}
    # Some points of each cluster are the first centres: the first ones by a seeded hash, found by partial top lists.
    order = F.xxhash64(F.lit(seed), "id", "v")
    few = _first_of_each(points.withColumn("o", order), sizes, balls)
    centres: dict[str, list] = {}
    for r in few:
        centres.setdefault(r["cluster"], []).append(r["v"])
    if sum(len(c) * len(c[0]) for c in centres.values()) > MAX_NUMBERS:
        raise ValueError("the balls are more than a broadcast should hold")
    tables = {c: np.unique(np.asarray(v, dtype=np.float64), axis=0) for c, v in centres.items()}
    shared = df.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf("int")
    def ball_of(cluster: pd.Series, vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(cluster), dtype=np.int32)
        for name in cluster.unique():
            at = np.flatnonzero(cluster.isna() if name is None else cluster == name)
            out[at] = _squared(np.stack(vectors.iloc[at].to_numpy()), shared.value[name]).argmin(1)
        return pd.Series(out)

    dealt = durable(points.withColumn("ball", ball_of.asNondeterministic()("cluster", "v")))
    mean = vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("mean")
    means = control_means(dealt.groupBy("cluster", "ball").agg(F.count("*").alias("n"), mean).collect())
    summary = df.sparkSession.sparkContext.broadcast(means)

    @F.pandas_udf("array<double>")
    def sums_to(vectors: pd.Series) -> pd.Series:
        """For each cluster the sum of distances to its points, by its balls."""
        x = np.stack(vectors.to_numpy())
        columns = [(np.sqrt(_squared(x, centre)) * n[None, :]).sum(1) for _, _, n, centre in summary.value]
        return pd.Series(list(np.stack(columns, axis=1)))

    @F.pandas_udf("double")
    def to_own_mean(cluster: pd.Series, ball: pd.Series, vectors: pd.Series) -> pd.Series:
        place = {name: (balls_, centre) for name, balls_, _, centre in summary.value}
        found = np.zeros(len(cluster))
        for i, (name, b, v) in enumerate(zip(cluster, ball, vectors)):
            balls_, centre = place[name]
            found[i] = np.linalg.norm(v - centre[balls_[b]])
        return pd.Series(found)

    scored = durable(dealt.withColumns({"sums": sums_to.asNondeterministic()("v"), "radius": to_own_mean.asNondeterministic()("cluster", "ball", "v")}))
    widths = {r["cluster"]: r["w"] for r in scored.groupBy("cluster").agg(F.avg("radius").alias("w")).collect()}
    names = [name for name, *_ in means]
    at = {name: i for i, name in enumerate(names)}
    counts = np.array([float(sizes[n]) for n in names])
    spread = np.array([float(widths[n]) for n in names])

    @F.pandas_udf("a double, b double, silhouette double, bound double")
    def score(cluster: pd.Series, sums: pd.Series, radius: pd.Series) -> pd.DataFrame:
        s, own = np.stack(sums.to_numpy()), np.array([at[c] for c in cluster])
        here = np.arange(len(s))
        # A point is at no distance from itself; its ball's mean may be.
        n = counts[own]
        a = np.where(n > 1, np.maximum(s[here, own] - radius.to_numpy(), 0.0) / np.maximum(n - 1, 1), 0.0)
        mean_to = s / counts[None, :]
        mean_to[here, own] = np.inf
        b = mean_to.min(1)
        top = np.maximum(a, b)
        good = (n > 1) & np.isfinite(b) & (top > 0)
        value = np.where(good, (b - a) / np.where(good, top, 1.0), 0.0)
        wide = np.where(n > 1, spread[own] * n / np.maximum(n - 1, 1), 0.0)
        return pd.DataFrame({"a": a, "b": b, "silhouette": value, "bound": np.maximum(wide, spread.max())})

    found = scored.withColumn("s", score.asNondeterministic()("cluster", "sums", "radius"))
    return found.select("id", "cluster", "s.a", F.when(F.col("s.b") < float("inf"), F.col("s.b")).alias("b"), "s.silhouette", "s.bound")


def control_means(rows: list) -> list[tuple]:
    """Per cluster its name, the place of each ball, and the balls' members and means."""
    grouped: dict = {}
    for r in rows:
        grouped.setdefault(r["cluster"], []).append((r["ball"], r["n"], r["mean"]))
    found = []
    for name in sorted(grouped, key=lambda c: (c is not None, c or "")):
        balls = sorted(grouped[name])
        found.append((name, {b: i for i, (b, _, _) in enumerate(balls)}, np.array([float(n) for _, n, _ in balls]), np.asarray([m for _, _, m in balls], dtype=np.float64)))
    return found


def _first_of_each(points: DataFrame, sizes: Mapping[str, int], balls: int) -> list:
    """About ``balls`` points of each cluster, by the hash ``o``: those below a share of its range, exact where a cluster is small."""
    shares = [(c, min((1 << 63) - 1, int(min(1.0, 3.0 * balls / n) * (1 << 64)) - (1 << 63))) for c, n in sizes.items()]
    limits = points.sparkSession.createDataFrame(shares, "own string, most long")
    some = points.join(F.broadcast(limits), F.col("cluster").eqNullSafe(F.col("own"))).where(F.col("o") <= F.col("most"))
    # The share leaves some three times as many rows as wanted, of each cluster alike.
    rank = F.row_number().over(W.partitionBy("cluster").orderBy("o"))
    return some.withColumn("k", rank).where(F.col("k") <= balls).select("cluster", "v").collect()
