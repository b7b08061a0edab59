"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0 .. K-1 are ordered. A text's score is the sum of the weights of the distinct hashed tokens in its
whole text, one set of weights for all grades, and P(grade <= k) = logistic(threshold_k - score) with ordered
thresholds. From these come the expected grade and the tail probability P(grade >= ``tail``) that selection
goes by. Tokens count once, however often they occur, so the score of a long text isn't diluted and a single
telling word is enough.

The model is fitted on at most about ``train_rows`` labelled rows, chosen by a seeded hash of their ids; they
are found where the documents lie and gathered, as token numbers, in one task that runs follow-the-regularised-
leader steps with an L1 penalty, which keeps the weights of ordinary words at exactly zero.

Results, all cases included:
* a null or empty text has only its length features; whole texts count, however long;
* labels with a null grade or for unknown ids are not used, several labels of one id count as their lowest;
* without any usable label scores, grades and probabilities are null and every document is kept;
* repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parlor.llm.common import text_hash

BUCKETS = 1 << 18
CAPITAL = re.compile(r"[A-Z]")
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1, one column each."""
        return _logistic(scores[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def features(text: str) -> np.ndarray:
    """Buckets of the distinct tokens, and of marks for length, capitals and repetition."""
    tokens = TOKEN.findall(text.lower())
    distinct = set(tokens)
    named = [zlib.crc32(t.encode()) % BUCKETS for t in distinct]
    capitals = len(CAPITAL.findall(text))
    marks = [f"\0length {len(tokens).bit_length()}", f"\0distinct {10 * len(distinct) // max(1, len(tokens))}",
             f"\0capitals {5 * capitals // max(1, len(text))}"]
    return np.unique(np.array(named + [zlib.crc32(m.encode()) % BUCKETS for m in marks], dtype=np.int32))


def fit(rows: list[np.ndarray], grades: np.ndarray, *, epochs: int = 15, batch: int = 64, rate: float = 3.0, l1: float | None = None,
        l2: float = 0.1, least_docs: int = 5, seed: int = 42) -> Model:
    """Weights and thresholds that make the grades likely; tokens of fewer than ``least_docs`` rows get no weight.

    ``l1`` is by default 1 for 120 rows, 25 at most.
    """
    l1 = min(25.0, len(rows) / 120) if l1 is None else l1
    kinds = int(grades.max()) + 1 if len(grades) else 1
    seen = np.bincount(np.concatenate([*rows, np.zeros(0, dtype=np.int32)]).astype(np.int64), minlength=BUCKETS)
    rows = [row[seen[row] >= least_docs] for row in rows]
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    # Thresholds as the first one and logarithms of the gaps: always ordered.
    shares = np.clip(np.cumsum(np.bincount(grades, minlength=kinds))[:-1] / max(1, len(grades)), 1e-3, 1 - 1e-3)
    start = np.log(shares / (1 - shares))
    place = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    moved = np.full(len(place), 1e-8)
    order = np.random.default_rng(seed)

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((1 + np.sqrt(n[at])) / rate + l2))

    def thresholds():
        return np.cumsum(np.concatenate([place[:1], np.exp(place[1:])]))

    for _ in range(epochs if kinds > 1 else 0):
        for some in np.array_split(order.permutation(len(rows)), max(1, len(rows) // batch)):
            lengths = np.array([len(rows[i]) for i in some])
            at, inverse = np.unique(np.concatenate([rows[i] for i in some]), return_inverse=True)
            w, of = weights(at), np.repeat(np.arange(len(some)), lengths)
            scores = np.bincount(of, weights=w[inverse], minlength=len(some))
            cuts, y = thresholds(), grades[some]
            # P(y) = F(upper - s) - F(lower - s), with F 1 above the last and 0 below the first threshold.
            upper, lower = np.append(cuts, np.inf)[y] - scores, np.append(-np.inf, cuts)[y] - scores
            fu, fl = _logistic(upper), _logistic(lower)
            likely = np.maximum(fu - fl, 1e-9)
            du, dl = fu * (1 - fu) / likely, fl * (1 - fl) / likely
            by_score = du - dl
            gradient = np.bincount(inverse, weights=by_score[of], minlength=len(at))
            sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / rate
            z[at] += gradient - sigma * w
            n[at] += gradient**2
            by_cut = np.zeros(len(cuts) + 2)
            np.add.at(by_cut, y + 1, -du)
            np.add.at(by_cut, y, dl)
            own = by_cut[1:-1]
            later = np.cumsum(own[::-1])[::-1]
            step = np.concatenate([later[:1], later[1:] * np.exp(place[1:])]) / len(some)
            moved += step**2
            place -= 0.1 * step / np.sqrt(moved)
    return Model(weights(slice(None)).astype(np.float32), thresholds() if kinds > 1 else np.zeros(0))


def _fit_in_task(options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, grades = [], []
        for batch in batches:
            rows += [np.asarray(x.values) for x in batch.column("features")]
            grades += batch.column("grade").to_pylist()
        if not rows:
            return
        by_id = np.lexsort((np.array([len(r) for r in rows]), np.array([int(r.sum()) for r in rows])))
        model = fit([rows[i] for i in by_id], np.array(grades)[by_id], **options)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.thresholds.tobytes()], pa.binary())],
            names=["weights", "thresholds"],
        )

    return run


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py() or "") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("grade"), pa.array(rows, pa.list_(pa.int32()))], names=["grade", "features"]
        )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", *,
          train_rows: int = 20_000, seed: int = 42, **options) -> Model | None:
    """Fit on the rows of ``docs`` that have a grade 0 .. K-1 in ``labels``; None if there are none."""
    rated = (
        labels.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.min(grade_col).cast("int").alias("grade"))
    )
    rows = rated.count()
    if not rows:
        return None
    place = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000))
    sample = rated.where(place < int(1_000_000 * min(1.0, train_rows / rows)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # About train_rows rows of an id and a grade.
    found = texts.join(F.broadcast(sample), "id").select("grade", "text")
    numbered = found.mapInArrow(_features, "grade int, features array<int>")
    got = numbered.repartition(1).mapInArrow(_fit_in_task(options), "weights binary, thresholds binary").first()
    if got is None:
        return None
    return Model(np.frombuffer(got.weights, dtype=np.float32), np.frombuffer(got.thresholds, dtype=np.float64))


def _score(shared, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = np.array([model.weights[features(t.as_py() or "")].sum(dtype=np.float64) for t in batch.column("text")])
            tails = model.tails(scores)
            offsets = pa.array(np.arange(len(scores) + 1) * tails.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f) for f in fields], pa.array(scores), pa.ListArray.from_arrays(offsets, pa.array(tails.ravel()))],
                names=[*fields, "score", "tails"],
            )

    return run


def grade(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", *, tail: int = 1,
          least_tail: float = 0.5) -> DataFrame:
    """One row per document: ``id, raw, score, expected_grade, tail_probability, kept``.

    ``kept`` holds where P(grade >= ``tail``) is at least ``least_tail``.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("raw"), F.col(text_col).alias("text"))
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("id", "raw", none.alias("score"), none.alias("expected_grade"), none.alias("tail_probability"),
                           F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(_score(shared, ["id", "raw"]), f"id {kind}, raw long, score double, tails array<double>")
    probability = F.coalesce(F.get("tails", F.lit(tail - 1)), F.lit(1.0 if not len(model.thresholds) else 0.0))
    return scored.select(
        "id", "raw", "score", F.aggregate("tails", F.lit(0.0), lambda a, b: a + b).alias("expected_grade"),
        probability.alias("tail_probability"), (probability >= least_tail).alias("kept"),
    )
