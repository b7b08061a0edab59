"""Centroids, classification, similarity search, retrieval, clustering, encoding."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlor import defaults as D
from parlor.functions import scoring as S
from parlor.operators import classify, cluster, knn, retrieve, vectors

RNG = np.random.default_rng(7)


def unit(a):
    return a / np.linalg.norm(a, axis=-1, keepdims=True)


@pytest.fixture(scope="module")
def points(spark):
    centres = unit(RNG.normal(size=(6, 12)))
    x = unit(centres[RNG.integers(0, 6, 400)] + 0.25 * RNG.normal(size=(400, 12)))
    x[100:140] = x[100]  # copies
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], str(i % 4)) for i in range(400)], "id long, v array<double>, c string")
    return df, x


def brute(x, n, exclude=True):
    sims = np.round(x @ x.T, knn.DIGITS)
    out = {}
    for i, row in enumerate(sims):
        order = sorted((j for j in range(len(x)) if not (exclude and j == i)), key=lambda j: (-row[j], j))[:n]
        out[i] = order
    return out


def test_centroids(spark, points):
    df, x = points
    got = dict(vectors.centroid_list(vectors.centroids(df, "c", "v")))
    for c in "0123":
        assert np.allclose(got[c], unit(x[int(c)::4].mean(0)), atol=1e-12)


def test_broadcast_search_is_exact(points):
    df, x = points
    packed = knn.Packed(df, "id", "v", ["c"])
    found = knn.search_broadcast(df, packed, 7, query_id="id", vector_col="v", exclude_same_id=True)
    expected = brute(x, 7)
    for r in found.collect():
        assert [c["id"] for c in r["candidates"]] == expected[r["id"]]
        assert all(c["c"] == str(c["id"] % 4) for c in r["candidates"])


@pytest.mark.parametrize(("cells", "block", "chunk"), [(8, 60, 150), (1, 500, 500), (20, 100, 400)])
def test_cell_search_is_exact(points, cells, block, chunk):
    df, x = points
    found = knn.search_cells(
        df, df, 7, query_id="id", corpus_id="id", vector_col="v", extra=["c"], exclude_same_id=True,
        cells=cells, block_rows=block, query_rows=chunk,
    )
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], []).append((-round(r["similarity"], knn.DIGITS), r["id"]))
    expected = brute(x, 7)
    assert {q: [i for _, i in sorted(m)] for q, m in got.items()} == expected


def test_both_searches_give_one_shape(points, spark):
    df, x = points
    options = dict(query_id="q", corpus_id="id", vector_col="v", extra=["c"])
    queries = df.limit(50).select(F.col("id").alias("q"), "v").unionByName(spark.createDataFrame([(999, None)], "q long, v array<double>"))
    small = knn.top_similar(queries, df, 5, **options)
    large = knn.top_similar(queries, df, 5, max_broadcast_bytes=0, **options)
    assert small.schema["candidates"].dataType == large.schema["candidates"].dataType
    def shown(found):
        return {r["q"]: [(c["id"], round(c["similarity"], 9), c["c"]) for c in r["candidates"]] for r in found.collect()}

    a, b = shown(small), shown(large)
    assert a == b and a[999] == []


@pytest.mark.parametrize("limit", [-1, 1 << 26])
def test_vectors_of_any_length_and_repeated_ids(spark, limit):
    order = np.random.default_rng(8)
    x = order.normal(size=(200, 4)) * order.uniform(0.1, 9, (200, 1))
    x[17] = 0.0
    rows = [(i // 2, x[i].tolist(), f"c{i}") for i in range(200)]
    corpus = spark.createDataFrame(rows, "id long, v array<double>, c string")
    queries = spark.createDataFrame([(i % 5, x[i].tolist(), i) for i in range(60)], "id long, v array<double>, n int")
    found = knn.top_similar(
        queries, corpus, 6, query_id="id", corpus_id="id", vector_col="v", extra=["c"], exclude_same_id=True, max_broadcast_bytes=limit
    )
    got = {r["n"]: [c["c"] for c in r["candidates"]] for r in found.collect()}
    size = np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round((x @ x.T) / np.maximum(size * size.T, 1e-300), knn.DIGITS)
    for i in range(60):
        others = [j for j in range(200) if j // 2 != i % 5 and j != 17]
        best = sorted(others, key=lambda j: (-sims[i, j], j // 2, f"c{j}"))[:6]
        assert got[i] == ([] if i == 17 else [f"c{j}" for j in best])


def test_chunks_hold_neighbouring_pivots():
    pivots = np.array([[np.cos(a), np.sin(a)] for a in np.linspace(0, 1.5, 40)])
    counts = np.full(40, 10)
    counts[7] = 95
    first, parts = knn._chunks(pivots, counts, 30)
    load = {}
    for p in range(40):
        for k in range(parts[p]):
            load[first[p] + k] = load.get(first[p] + k, 0) + counts[p] / parts[p]
    assert parts[7] == 4 and max(load.values()) <= 30 and sorted(load) == list(range(len(load)))
    runs = [p for p in np.argsort(first, kind="stable") if p != 7]
    assert runs == sorted(runs) or runs == sorted(runs, reverse=True) or all(abs(a - b) <= 3 or first[a] != first[b] for a, b in zip(runs, runs[1:]))


def test_blocks_go_to_the_chunks_that_visit_them(spark, monkeypatch):
    """Two far-apart groups: no block of one group is sent to the queries of the other."""
    order = np.random.default_rng(9)
    x = np.concatenate([unit(order.normal([9, 0, 0], 0.2, (150, 3))), unit(order.normal([0, 9, 0], 0.2, (150, 3)))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    seen = []
    original = type(df).join

    def spy(self, other, *args, **kwargs):
        out = original(self, other, *args, **kwargs)
        if {"_slot", "_chunk"} <= set(out.columns) and "_v" in out.columns:
            seen.append((out.count(), other.count(), df.count()))
        return out

    monkeypatch.setattr(type(df), "join", spy)
    found = knn.search_cells(df, df, 3, query_id="id", corpus_id="id", vector_col="v", cells=8, block_rows=1000, query_rows=150)
    expected = brute(x, 3, exclude=False)
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], []).append((-round(r["similarity"], knn.DIGITS), r["id"]))
    assert {q: [i for _, i in sorted(m)] for q, m in got.items()} == expected
    shipped, pairs, rows = seen[0]
    assert shipped <= rows * 1.7 < rows * 2 and pairs < 8 * 2  # with every block in every chunk it were twice the rows


def test_lsh_finds_most_pairs(points):
    df, x = points
    found = {(r["query"], r["id"]) for r in knn.lsh_similar(df, df, 0.95, query_id="id", corpus_id="id", vector_col="v").collect()}
    true = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.95))}
    assert found <= {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.95 - 1e-9))} and len(found) >= 0.8 * len(true)


def test_search_of_an_empty_corpus(points):
    df, _ = points
    for limit in (-1, 1 << 20):
        found = knn.top_similar(df, df.limit(0), 5, query_id="id", corpus_id="id", vector_col="v", max_broadcast_bytes=limit)
        assert all(r["candidates"] == [] for r in found.collect())


BOOST_CASES = [
    # ordinals (top, second), scores, hits -> class, score, boosted
    ((0, 1), (0.50, 0.40), (True, True), ("top", 0.58, True)),
    ((0, 1), (0.45, 0.40), (False, True), ("second", 0.52, True)),
    ((0, 1), (0.41, 0.40), (True, True), ("top", 0.49, True)),
    ((0, 1), (0.39, 0.38), (True, True), ("second", 0.50, True)),
    ((0, 1), (0.45, 0.40), (False, False), ("top", 0.45, False)),
    ((1, 0), (0.45, 0.40), (True, True), ("second", 0.52, True)),
    ((1, 0), (0.50, 0.40), (True, True), ("top", 0.58, True)),
    ((1, 0), (0.45, 0.40), (True, False), ("top", 0.53, True)),
    ((0, 1), (0.97, 0.40), (True, False), ("top", 1.0, True)),
]


def simulated_boost(ordinals, scores, hits, threshold=0.48):
    """Visit the classes in taxonomy order, as the rule is defined."""
    name, score, boosted = "top", scores[0], False
    for which in sorted(("top", "second"), key=lambda w: ordinals[w == "second"]):
        if not hits[which == "second"]:
            continue
        if which == name:
            score, boosted = min(1.0, score + 0.08), True
        elif score < threshold and which == "second":
            return "second", min(1.0, scores[1] + 0.12), True
    return name, score, boosted


def test_keyword_boost(spark):
    rows = []
    for o, s, h, expected in BOOST_CASES:
        place = lambda i, n: (float(s[i]), o[i], n)
        rows.append((len(rows), place(0, "top"), place(1, "second"), h[0], h[1]))
    schema = "i int, a struct<score:double,ordinal:int,class:string>, b struct<score:double,ordinal:int,class:string>, h1 boolean, h2 boolean"
    df = spark.createDataFrame(rows, schema)
    best = S.boosted(F.col("a"), F.col("b"), F.col("h1"), F.col("h2"))
    got = [tuple(r["x"]) for r in df.select("i", best.alias("x")).orderBy("i").collect()]
    for g, (o, s, h, expected) in zip(got, BOOST_CASES):
        assert g == (expected[0], pytest.approx(expected[1]), expected[2])
        assert g == (simulated_boost(o, s, h)[0], pytest.approx(simulated_boost(o, s, h)[1]), simulated_boost(o, s, h)[2])


def test_fallback_flag(spark):
    cases = [(0.55, 0.03, True), (0.61, 0.03, False), (0.47, 0.5, True), (0.48, 0.04, False), (0.55, 0.04, False)]
    df = spark.createDataFrame([(i, s, m) for i, (s, m, _) in enumerate(cases)], "i int, s double, m double")
    got = df.select("i", S.needs_fallback(F.col("s"), F.col("m")).alias("f")).orderBy("i").collect()
    assert [r["f"] for r in got] == [c[2] for c in cases]


TABLE = [("bag", [1.0, 0.0]), ("delay", [0.0, 1.0]), ("other", [math.sqrt(0.5), -math.sqrt(0.5)])]
KEYWORDS = {"bag": ["bag"], "delay": ["late"], "other": ["hola"]}


def test_nearest_centroid(spark):
    rows = [(0, "my Bag", [0.9, 0.1]), (1, "   ", [0.9, 0.1]), (2, "x", None), (3, "tie", [0.4, 0.4]), (4, "related", [0.46, 0.45]), (5, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, t string, v array<double>")
    got = {r["id"]: r for r in classify.nearest_centroid(df, "t", "v", TABLE, keywords=KEYWORDS, catch_all="other").collect()}
    assert (got[0]["class"], got[0]["confidence"], got[0]["margin"], got[0]["keyword_boosted"]) == ("bag", 0.98, 0.3343, True)
    for i in (1, 2, 5):
        assert (got[i]["class"], got[i]["confidence"], got[i]["needs_fallback"], got[i]["keyword_boosted"]) == ("other", 0.0, True, None)
        assert [s["score"] for s in got[i]["class_scores"]] == [0.0] * 3
    assert got[3]["class"] == "bag" and got[3]["margin"] == 0.0
    # "late" inside "related" lifts the runner-up.
    assert (got[4]["class"], got[4]["confidence"], got[4]["margin"]) == ("delay", 0.57, 0.01)
    assert [s["class"] for s in got[0]["class_scores"]][0] == "bag"


def test_class_scores(spark):
    df = spark.createDataFrame([([0.6, 0.8],), (None,)], "v array<double>")
    rows = df.select(vectors.class_scores(F.col("v"), TABLE).alias("s")).collect()
    assert [(s["class"], round(s["score"], 6)) for s in rows[0]["s"]] == [("bag", 0.6), ("delay", 0.8), ("other", -0.141421)]
    assert rows[1]["s"] is None


CORPUS = [
    ("p1", [1.0, 0.0], "bag", True, "Please send us a direct message"),
    ("p2", [0.9998, 0.02], "bag", False, "File a claim at the baggage office"),
    ("p3", [0.99, 0.141], "delay", False, "We will rebook you on the next one"),
    ("p4", [0.97, 0.243], "other", False, "short"),
]


def corpus(spark, rows=CORPUS):
    df = spark.createDataFrame(rows, "thread_id string, embedding array<double>, class string, is_boilerplate boolean, agent_reply string")
    return df.withColumn("customer_message", F.lit("m"))


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_retrieve_reranks_the_pool(spark, limit):
    queries = spark.createDataFrame([("q1", [1.0, 0.0], "delay"), ("q2", [1.0, 0.0], "other"), ("q3", None, "bag")], "id string, embedding array<double>, class string")
    found = retrieve.retrieve(queries, corpus(spark), query_id="id", class_col="class", catch_all="other", max_broadcast_bytes=limit)
    got = {r["id"]: r for r in found.collect()}
    assert got["q1"]["grounding_ids"] == ["p3", "p2", "p1"]
    assert [m["ranking_score"] for m in got["q1"]["matches"]] == [1.04, 0.9998, 0.97]
    assert got["q1"]["best_similarity"] == 1.0 and got["q1"]["mean_similarity"] == 0.9966
    # The catch-all class gets no boost; boilerplate loses the near tie and the last place to p4.
    assert got["q2"]["grounding_ids"] == ["p2", "p3", "p1"]
    assert (got["q3"]["grounding_ids"], got["q3"]["best_similarity"], got["q3"]["mean_similarity"]) == ([], 0.0, 0.0)


@pytest.mark.parametrize("limit", [-1, 1 << 26])
def test_every_match_has_its_own_reply(spark, limit):
    rows = [("tw_1", [1.0, 0.0], "bag", False, "the first reply of all"), ("tw_1", [0.8, 0.6], "bag", False, "the second reply of all"),
            ("tw_4", [0.6, 0.8], "bag", False, "the reply of another one")]
    queries = spark.createDataFrame([("q", [1.0, 0.0], "bag", 1), ("q", [0.6, 0.8], "bag", 2), (None, [0.0, 1.0], "bag", 3)], "id string, embedding array<double>, class string, n int")
    found = retrieve.retrieve(queries, corpus(spark, rows), query_id="id", class_col="class", max_broadcast_bytes=limit)
    got = {r["n"]: [(m["id"], m["reply"].split()[1], m["raw_similarity"]) for m in r["matches"]] for r in found.collect()}
    assert got[1] == [("tw_1", "first", 1.0), ("tw_1", "second", 0.8), ("tw_4", "reply", 0.6)]
    assert got[2] == [("tw_4", "reply", 1.0), ("tw_1", "second", 0.96), ("tw_1", "first", 0.6)]
    assert [m[2] for m in got[3]] == [0.8, 0.6, 0.0]
    assert {r["n"]: r["mean_similarity"] for r in found.collect()} == {1: 0.8, 2: 0.8533, 3: 0.4667}


def test_retrieve_from_an_empty_corpus(spark):
    queries = spark.createDataFrame([("q1", [1.0, 0.0], "delay")], "id string, embedding array<double>, class string")
    row = retrieve.retrieve(queries, corpus(spark, []), query_id="id", class_col="class").first()
    assert row["matches"] == [] and row["best_similarity"] == 0.0


def test_pool_is_cut_by_raw_similarity_first(spark):
    rows = [(f"n{i:02d}", [math.cos(i / 100), math.sin(i / 100)], "bag", False, "r") for i in range(31)]
    rows[30] = (*rows[30][:2], "delay", False, "r")
    queries = spark.createDataFrame([("q", [1.0, 0.0], "delay")], "id string, embedding array<double>, class string")
    row = retrieve.retrieve(queries, corpus(spark, rows), query_id="id", class_col="class").first()
    assert row["grounding_ids"] == ["n00", "n01", "n02"]  # n30 would win with its boost but is not in the pool


def test_silhouette_matches_the_definition(points):
    df, x = points
    distance = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    labels = np.arange(400) % 4
    scores = []
    for i in range(400):
        means = {c: distance[i, (labels == c)].sum() / ((labels == c).sum() - (c == labels[i])) for c in range(4)}
        a, b = means.pop(labels[i]), min(means.values())
        scores.append((b - a) / max(a, b))
    whole = cluster.silhouette_points(df, "id", "c", "v", block_rows=70).agg(F.avg("silhouette")).first()[0]
    assert whole == pytest.approx(np.mean(scores), abs=1e-6)
    squared, rows = distance**2, {r["id"]: r for r in cluster.silhouette_scores(df, "id", "c", "v").collect()}
    for i in range(400):
        means = {c: squared[i, (labels == c)].sum() / ((labels == c).sum() - (c == labels[i])) for c in range(4)}
        a, b = means.pop(labels[i]), min(means.values())
        assert rows[i]["silhouette"] == pytest.approx((b - a) / max(a, b), abs=1e-9)
    assert cluster.silhouette(df, "id", "c", "v").first()["points"] == 400


def test_silhouette_of_a_single_member(spark):
    df = spark.createDataFrame([(1, "a", [0.0, 0.0]), (2, "b", [1.0, 0.0]), (3, "b", [1.0, 0.1])], "id int, c string, v array<double>")
    for form in (cluster.silhouette_points, cluster.silhouette_scores):
        got = {r["id"]: r["silhouette"] for r in form(df, "id", "c", "v").collect()}
        assert got[1] == 0.0 and got[2] > 0.8


def test_cluster_sweep(points):
    df, _ = points
    rows = cluster.cluster_sweep(df, "id", "v", ks=[2, 6], restarts=2).collect()
    assert [r["k"] for r in rows] == [2, 6]
    for r in rows:
        assert len(r["cluster_distribution"]) == r["k"] and sum(r["cluster_distribution"]) == 400
        assert r["cluster_distribution"] == sorted(r["cluster_distribution"], reverse=True)
    assert rows[1]["silhouette"] > rows[0]["silhouette"]


def test_encoders(spark):
    df = spark.createDataFrame([(0, "lost my bag"), (1, None), (2, "flight is late"), (3, "lost my bag")], "id int, t string")

    def factory():
        built = [len]  # built once per worker
        return lambda batch: np.array([[built[0](t), 1.0] for t in batch])

    got = {r["id"]: r["v"] for r in vectors.encode_text(df, "t", "v", factory, batch=2).collect()}
    assert got[1] is None and got[0] == pytest.approx(unit(np.array([11.0, 1.0])), abs=1e-6)
    model = vectors.hashing_encoder(df, "t", 64)
    hashed = {r["id"]: np.array(r["v"]) for r in vectors.hashed_vectors(df, "t", "v", model).collect()}
    assert np.linalg.norm(hashed[0]) == pytest.approx(1.0, abs=1e-6) and np.allclose(hashed[0], hashed[3])


def test_baselines(spark):
    df = spark.createDataFrame([(0, "My luggage was lost and I want my lawyer"), (1, "hello")], "i int, t string")
    rows = classify.keyword_baseline(df, "t", templates={"baggage_issue": "See the office"}).orderBy("i").collect()
    assert (rows[0]["class"], rows[0]["confidence"], rows[0]["decision"], rows[0]["draft_reply"]) == ("baggage_issue", 0.7, "escalate", "See the office")
    assert (rows[1]["class"], rows[1]["confidence"], rows[1]["reason_code"], rows[1]["draft_reply"]) == ("other_unclear", 0.4, "rule_keyword_autohandle", D.GENERIC_REPLY)
    constant = classify.constant_baseline(df).orderBy("i").collect()
    assert {(r["class"], r["decision"], r["confidence"]) for r in constant} == {("other_unclear", "auto_handle", 0.5)}


def sent_queries(monkeypatch, frame):
    """The numbers of rows with queries that are grouped for the tasks that compare them."""
    seen = []
    original = type(frame).groupBy

    def spy(self, *keys):
        if "_qv" in self.columns and len(keys) > 1:
            seen.append(self.count())
        return original(self, *keys)

    monkeypatch.setattr(type(frame), "groupBy", spy)
    return seen


def test_a_query_is_sent_once_to_a_tile_of_many_cells(points, monkeypatch):
    df, x = points
    seen = sent_queries(monkeypatch, df)
    found = knn.search_cells(df, df, 7, query_id="id", corpus_id="id", vector_col="v", exclude_same_id=True, cells=20)
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], []).append((-round(r["similarity"], knn.DIGITS), r["id"]))
    assert {q: [i for _, i in sorted(m)] for q, m in got.items()} == brute(x, 7)
    assert seen and max(seen) <= 400  # once a cell they were several thousand


@pytest.mark.parametrize("floor", [-2.0, 0.5])
def test_pairs_of_a_tile(monkeypatch, floor):
    """Products in single precision, raised floors and many copies leave the exact best pairs."""
    monkeypatch.setattr(knn, "TILE_ROWS", 64)
    monkeypatch.setattr(knn, "HELD_PAIRS", 500)
    order = np.random.default_rng(12)
    x = unit(order.normal(size=(900, 6)))
    x[300:700] = x[300]
    ids = np.arange(900) // 2
    some = knn.enough_copies(x, ids, 5)
    assert len(some) < 540
    rows, columns, sims = knn.best_pairs(x[:400], ids[:400], np.full(400, floor), x[some], ids[some], 5)
    columns = some[columns]
    exact = np.round(x[:400] @ x.T, knn.DIGITS)
    for i in range(400):
        right = sorted((j for j in range(900) if ids[j] != ids[i] and exact[i, j] >= floor), key=lambda j: (-exact[i, j], j))[:5]
        at = np.flatnonzero(rows == i)
        hits = [j for _, j in sorted(zip(-np.round(sims[at], knn.DIGITS), columns[at])) if exact[i, j] >= floor]
        assert hits == right


def test_some_replies_of_a_large_corpus(spark):
    order = np.random.default_rng(6)
    x = unit(order.normal(size=(80, 6)))
    rows = [(i // 2, f"question number {i}", f"answer number {i}", "ab"[i % 2], i % 5 == 0, x[i].tolist()) for i in range(80)]
    names = "thread_id long, customer_message string, agent_reply string, class string, is_boilerplate boolean, embedding array<double>"
    corpus = spark.createDataFrame(rows, names)
    queries = corpus.select("thread_id", "class", "embedding")
    options = dict(query_id="thread_id", class_col="class", catch_all="b", exclude_same_id=True, max_broadcast_bytes=-1)

    def shown(count):
        return sorted((tuple(r[:6]) for r in retrieve.retrieve(queries, corpus, replies=count, **options).drop("embedding").collect()), key=str)

    for full, one, none in zip(shown(None), shown(1), shown(0)):
        assert full[0] == one[0] == none[0] and full[3:] == one[3:] == none[3:]
        matches, first, bare = full[2], one[2], none[2]
        assert [m["reply"] for m in first] == [matches[0]["reply"], None, None] and [m["reply"] for m in bare] == [None] * 3
        assert [m[:-1] for m in matches] == [m[:-1] for m in first] == [m[:-1] for m in bare]


def test_silhouette_rows_travel_to_a_dozen_blocks(spark, monkeypatch):
    """Blocks grow with the table, so that a row isn't sent to ever more of them."""
    order = np.random.default_rng(15)
    x = order.normal(size=(3000, 3))
    df = spark.createDataFrame([(i, v.tolist(), str(i % 3)) for i, v in enumerate(x)], "id long, v array<double>, c string")
    seen = []
    original = type(df).groupBy

    def spy(self, *keys):
        if "_row" in self.columns:
            seen.append(self.select(*keys).distinct().count())
        return original(self, *keys)

    monkeypatch.setattr(type(df), "groupBy", spy)
    few = cluster.silhouette_points(df, "id", "c", "v", rows=100_000).agg(F.avg("silhouette")).first()[0]
    assert seen and max(seen) <= 144  # 49 blocks of 2,048 rows made 2,401 pairs
    whole = np.linalg.norm(x[:, None] - x[None], axis=2)
    label = np.arange(3000) % 3
    means = np.stack([whole[:, label == c].sum(1) / ((label == c).sum() - (label == c)) for c in range(3)], axis=1)
    a = means[np.arange(3000), label]
    means[np.arange(3000), label] = np.inf
    b = means.min(1)
    assert few == pytest.approx(np.mean((b - a) / np.maximum(a, b)), abs=1e-9)
