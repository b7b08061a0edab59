"""Many k-means models per scan against plain numpy and MLlib; Euclidean silhouettes within their bound."""

import numpy as np
import pytest
from pyspark.mllib.clustering import KMeans, KMeansModel
from pyspark.sql import functions as F

from parlor.operators import cluster, lloyd


@pytest.fixture(scope="module")
def cloud():
    order = np.random.default_rng(5)
    centres = order.normal(size=(7, 8)) * 3
    return centres[order.integers(0, 7, 600)] + order.normal(size=(600, 8))


@pytest.fixture(scope="module")
def points(spark, cloud):
    df = spark.createDataFrame([(i, v.tolist(), f"c{i % 3}") for i, v in enumerate(cloud)], "n long, e array<double>, label string")
    return df.repartition(5)


def plain(x, centres, turns, tolerance=1e-4):
    for _ in range(turns):
        own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(len(centres))])
        if np.sqrt(((new - centres) ** 2).sum(1)).max() <= tolerance:
            break
        centres = new
    return ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum(), centres


def test_all_models_equal_single_runs(spark, points, cloud):
    starts = {(k, r): cloud[np.random.default_rng(10 * k + r).permutation(600)[:k]] for k in (3, 7) for r in range(3)}
    found = lloyd.fit_all(lloyd.points_of(points, "n", "e"), starts, turns=15)
    for name, centres in starts.items():
        cost, last = plain(cloud, centres, 15)
        assert abs(found[name].cost - cost) < 1e-6 * cost and np.allclose(found[name].centres, last)
        assert found[name].members.sum() == 600
    rdd = spark.sparkContext.parallelize(cloud.tolist(), 4)
    model = KMeans.train(rdd, 7, maxIterations=15, epsilon=1e-4, initialModel=KMeansModel(starts[7, 0].tolist()))
    assert abs(model.computeCost(rdd) - found[7, 0].cost) < 0.01 * found[7, 0].cost


def test_an_iteration_is_one_job_for_all_models(spark, points, monkeypatch):
    table, jobs = lloyd.points_of(points, "n", "e"), []
    kept = lloyd.assignment
    monkeypatch.setattr(lloyd, "assignment", lambda p, models: jobs.append(len(models)) or kept(p, models))
    lloyd.fit_all(table, lloyd.drawn_starts(table, [2, 4, 6], 4, 1), turns=3)
    assert len(jobs) <= 4 and jobs[0] == 12 and sorted(jobs, reverse=True) == jobs


def test_sweep_scores_equal_the_silhouette_of_its_labels(spark, points, cloud):
    rows = {r.k: r for r in cluster.cluster_sweep(points, "n", "e", ks=[3, 5], restarts=2).collect()}
    table = lloyd.points_of(points, "n", "e")
    fits = lloyd.fit_all(table, lloyd.drawn_starts(table, [3, 5], 2, 42))
    for k in (3, 5):
        best = min((fits[k, r] for r in range(2)), key=lambda m: m.cost)
        own = ((cloud[:, None] - best.centres[None]) ** 2).sum(2).argmin(1)
        labelled = spark.createDataFrame([(i, int(own[i]), cloud[i].tolist()) for i in range(600)], "n long, c int, e array<double>")
        expected = cluster.silhouette(labelled, "n", "c", "e").first()["silhouette"]
        assert abs(rows[k].silhouette - expected) < 1e-4
        assert rows[k].cluster_distribution == sorted(np.bincount(own).tolist(), reverse=True)
    assert cluster.cluster_sweep(points.limit(0), "n", "e").count() == 0


# Distances come from products of vectors, whose differences near zero lose half of their digits.
ROUNDING = 1e-6


def test_silhouettes_from_balls_stay_within_their_bound(points):
    exact = {r.id: r for r in cluster.silhouette_points(points, "n", "label", "e").collect()}
    widths = []
    for balls in (4, 40, 600):
        found = lloyd.silhouette_balls(points, "n", "label", "e", balls=balls).collect()
        assert len(found) == 600
        for r in found:
            assert abs(r.a - exact[r.id].a) <= r.bound + ROUNDING and abs(r.b - exact[r.id].b) <= r.bound + ROUNDING
        widths.append(found[0].bound)
        error = abs(np.mean([r.silhouette for r in found]) - np.mean([r.silhouette for r in exact.values()]))
        assert error < 0.1
    assert widths[0] > widths[1] > widths[2] and widths[2] < 1e-6 and error < 1e-6


def test_lone_points_null_clusters_and_no_rows(spark):
    rows = [(1, [0.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [9.0, 0.0], "b"), (4, [5.0, 5.0], None), (5, None, "a")]
    df = spark.createDataFrame(rows, "n long, e array<double>, label string")
    found = {r.id: r for r in lloyd.silhouette_balls(df, "n", "label", "e").collect()}
    assert set(found) == {1, 2, 3, 4} and found[3].silhouette == 0 and found[4].silhouette == 0
    assert abs(found[1].a - 1) < 1e-9 and found[1].silhouette > 0.5
    one = lloyd.silhouette_balls(df.where("label = 'a'"), "n", "label", "e").collect()
    assert all(r.b is None and r.silhouette == 0 for r in one)
    assert lloyd.silhouette_balls(df.limit(0), "n", "label", "e").count() == 0
    assert lloyd.fit_all(lloyd.points_of(df.limit(0), "n", "e"), {}) == {}
