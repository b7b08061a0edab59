"""Vector operators: centroids, class scores, text encoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from parlor.functions.vectors import as_double, normalize
from parlor.operators.bounded import control_rows


def centroids(df: DataFrame, class_col: str, vector_col: str) -> DataFrame:
    """``(class, centroid)``: the unit-length mean vector of each class.

    The mean is a partial aggregate over whole vectors, so neither the dimensions are exploded
    nor does a large class meet in one task.
    """
    vector = array_to_vector(as_double(F.col(vector_col)))
    return (
        df.groupBy(F.col(class_col).alias("class"))
        .agg(Summarizer.mean(vector).alias("_mean"))
        .select("class", normalize(vector_to_array("_mean")).alias("centroid"))
    )


def centroid_list(table: DataFrame, order: Sequence[str] | None = None) -> list[tuple[str, list[float]]]:
    """Centroids as driver values, in taxonomy order (by name if none is given). A table of more than
    10,000 classes is refused: search it with :func:`knn.top_similar` and n = 2.
    """
    rows = {r["class"]: list(r["centroid"]) for r in control_rows(table.select("class", "centroid"))}
    return [(c, rows[c]) for c in (order or sorted(rows)) if c in rows]


def ranked_scores(vector: Column, table: Sequence[tuple[str, Sequence[float]]]) -> Column:
    """``struct(scores, best)`` of a vector against each centroid.

    ``scores`` is in taxonomy order; ``best`` lists the positions by descending score, equal
    scores in taxonomy order. One Arrow batch is one matrix product, and only the vector goes
    to Python. A null vector gives nulls.
    """
    matrix = np.asarray([c for _, c in table], dtype=np.float64).T

    @F.pandas_udf("scores array<double>, best array<int>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores, best = np.full((2, len(batch)), None, dtype=object)
            known = np.flatnonzero(batch.notna().to_numpy())
            if len(known):
                found = np.stack(batch.iloc[known].to_numpy()).astype(np.float64) @ matrix
                order = np.argsort(-found, axis=1, kind="stable").astype(np.int32)
                for i, s, o in zip(known, found, order):
                    scores[i], best[i] = s, o
            yield pd.DataFrame({"scores": scores, "best": best})

    # Declared nondeterministic so that no filter above repeats the Python stage.
    return score.asNondeterministic()(vector)


def class_scores(vector: Column, table: Sequence[tuple[str, Sequence[float]]]) -> Column:
    """``array<struct(class, score)>`` of a vector, in taxonomy order."""
    names = F.array(*[F.lit(c) for c, _ in table])
    return F.transform(
        ranked_scores(vector, table)["scores"],
        lambda s, i: F.struct(F.get(names, i).alias("class"), s.alias("score")),
    )


Encoder = Callable[[Sequence[str]], np.ndarray]


def encode_text(df: DataFrame, text_col: str, output_col: str, factory: Callable[[], Encoder], batch: int = 128) -> DataFrame:
    """Add unit vectors from an encoder that each Python worker builds once.

    ``factory`` returns a function from a list of texts to a 2-D array. Null text gives null.
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = factory()
        for texts in batches:
            out: list = [None] * len(texts)
            known = [i for i, t in enumerate(texts) if t is not None]
            for start in range(0, len(known), batch):
                part = known[start : start + batch]
                vectors = np.asarray(encoder([texts.iloc[i] for i in part]), dtype=np.float64)
                lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = np.divide(vectors, lengths, out=vectors, where=lengths > 0)
                for i, v in zip(part, vectors.astype(np.float32)):
                    out[i] = v
            yield pd.Series(out)

    return df.withColumn(output_col, encode.asNondeterministic()(F.col(text_col)))


def hashing_encoder(df: DataFrame, text_col: str, dimensions: int = 256) -> PipelineModel:
    """Fit the default offline encoder: hashed, IDF-weighted, unit-length word vectors."""
    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimensions),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(df.select(F.coalesce(F.col(text_col), F.lit("")).alias(text_col)))


def hashed_vectors(df: DataFrame, text_col: str, output_col: str, model: PipelineModel) -> DataFrame:
    """Add the vectors of a fitted :func:`hashing_encoder`."""
    encoded = model.transform(df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))))
    return encoded.withColumn(output_col, vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_idf", "_unit")
