"""A vector index on disk, searched exactly or by product-quantised codes.

Layout below one folder, which lives across runs and sessions:

* ``rows``: the corpus partitioned by ``_cell`` (the nearest of the trained pivots), with the vector, the columns carried
  along, ``_block`` (a part of a large cell), ``_pos`` (the row's number) and ``_code`` (one byte per subspace);
* ``cells``: one row per cell with its pivot, rows, blocks and radius;
* ``codebooks``: for each subspace (a run of dimensions) the centroids its codes stand for.

:func:`search_index` is exact: bounds per cell say which cells a query must visit, and only their partitions are read; no
row is assigned again. :func:`search_approximate` visits the ``probes`` nearest cells and compares codes by table lookup:
the similarity to a row is that to its pivot plus one entry per subspace, which is the product with the vector that the
code stands for; a tile of neighbouring cells is decoded once and multiplied with a chunk of queries. The best
``rerank * n`` rows that a query finds in a tile are compared by their vectors in the same task, so every similarity
returned is exact and a tile returns n rows per query. Cells travel to the chunks of ``query_rows`` queries that visit them.

Pivots and codebooks are trained on a bounded sample (``train_rows``, and ``TRAIN_BYTES`` of vectors), every row is
indexed. Vectors count by direction; null and zero vectors are neither indexed nor found and find nothing. An empty corpus gives an
index that finds nothing. Ids may repeat on both sides; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from parlor.operators.knn import (
    Cells, PRODUCT_CELLS, _matrix, assigned_to, best_of_all, block_of, by_number, by_tile, cell_summary, cut, directed, least_of_best,
    pair_type, products, same_ids, search_assigned, short_directed, slots_of, tiles_visited, unit_rows, visit_type,
)
from parlor.session import durable

TRAIN_ROWS, TRAIN_BYTES = 65_536, 64 << 20
#: Centroids per subspace; a code is one byte.
CODES = 256


def _centroids(points: np.ndarray, k: int, directions: bool, rng: np.random.Generator, turns: int = 10) -> np.ndarray:
    """Lloyd's centroids of a sample, unit vectors if ``directions``."""
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(turns):
        score = points @ centres.T
        nearest = (score if directions else score - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, points)
        held = counts > 0
        centres = centres.copy()
        centres[held] = sums[held] / counts[held, None]
        if directions:
            lengths = np.linalg.norm(centres, axis=1)
            centres[lengths > 0] /= lengths[lengths > 0, None]
    return centres


def _subspaces(dimensions: int, parts: int) -> list[slice]:
    edges = [round(dimensions * i / parts) for i in range(parts + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def train(sample: np.ndarray, cells: int, parts: int, seed: int = 42) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pivots, and for each subspace the centroids of what is left of the vectors without their pivots."""
    rng = np.random.default_rng(seed)
    pivots = _centroids(sample, cells, True, rng)
    rest = sample - pivots[(sample @ pivots.T).argmax(axis=1)]
    return pivots, [_centroids(np.ascontiguousarray(rest[:, s]), CODES, False, rng) for s in _subspaces(sample.shape[1], parts)]


def encode(vectors: np.ndarray, cell: np.ndarray, pivots: np.ndarray, codebooks: list[np.ndarray]) -> np.ndarray:
    """One byte per subspace: the nearest centroid of the vector without its pivot."""
    rest = vectors - pivots[cell]
    columns = []
    for s, book in zip(_subspaces(vectors.shape[1], len(codebooks)), codebooks):
        columns.append((rest[:, s] @ book.T - 0.5 * (book**2).sum(axis=1)).argmax(axis=1).astype(np.uint8))
    return np.stack(columns, axis=1)


def decode(codes: np.ndarray, cell: np.ndarray, pivots: np.ndarray, codebooks: list[np.ndarray]) -> np.ndarray:
    """The vectors that codes stand for."""
    vectors = pivots[cell]
    for m, (s, book) in enumerate(zip(_subspaces(vectors.shape[1], len(codebooks)), codebooks)):
        vectors[:, s] += book[codes[:, m]]
    return vectors


def write_index(corpus: DataFrame, path: str, *, id_col: str, vector_col: str, extra: Sequence[str] = (), cells: int | None = None,
                parts: int | None = None, train_rows: int = TRAIN_ROWS, block_rows: int = 131_072, seed: int = 42) -> VectorIndex:
    """Train, assign every row, write. ``parts`` is the number of subspaces, by default a quarter of the dimensions.

    ``cells`` is by default the square root of the rows, 4,096 at most.
    """
    spark = corpus.sparkSession
    known = corpus.select(F.col(id_col).alias("id"), directed(F.col(vector_col)).alias("_v"), *extra).where(F.col("_v").isNotNull())
    rows = known.count()
    first = known.select(F.size("_v").alias("n")).first()
    dimensions = first["n"] if first else 1
    some = min(train_rows, max(1, TRAIN_BYTES // (8 * dimensions)))
    sample = known.select("_v").orderBy(F.rand(seed)).limit(some).toPandas()["_v"]
    vectors = _matrix(sample) if len(sample) else np.ones((1, 1))
    pivots, codebooks = train(vectors, cells or min(4096, max(1, math.isqrt(rows))), parts or max(1, dimensions // 4), seed)
    assigned = durable(assigned_to(known, pivots))
    summary = cell_summary(assigned).withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("int")).orderBy("_cell")
    # At most 4,096 rows.
    stored = summary.collect()
    blocks = {r["_cell"]: r["blocks"] for r in stored}
    schema = T.StructType([*assigned.schema.fields, T.StructField("_code", T.BinaryType())])

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                codes = encode(_matrix(batch["_v"]), batch["_cell"].to_numpy(), pivots, codebooks)
                yield batch.assign(_code=[row.tobytes() for row in codes])

    table = assigned.mapInPandas(coded, schema).withColumn("_block", block_of(F.col("_pos"), by_number(F.col("_cell"), blocks) if blocks else F.lit(1)))
    # A task writes the blocks of few cells, so a cell has few files; large cells have one a block.
    table.repartition("_cell", "_block").write.partitionBy("_cell").mode("overwrite").parquet(f"{path}/rows")
    fields = "_cell int, rows long, radius double, blocks int, pivot array<double>"
    found = [(r["_cell"], r["rows"], r["radius"], r["blocks"], pivots[r["_cell"]].tolist()) for r in stored]
    spark.createDataFrame(found, fields).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    books = [(m, k, c.tolist()) for m, book in enumerate(codebooks) for k, c in enumerate(book)]
    spark.createDataFrame(books, "part int, code int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/codebooks")
    return open_index(spark, path)


@dataclass(frozen=True)
class VectorIndex:
    """An index that was written; ``rows`` is read lazily, cells and codebooks are on the driver."""

    cells: Cells
    codebooks: list[np.ndarray]

    @property
    def rows(self) -> DataFrame:
        return self.cells.rows


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """Read an index; only its small tables are read now."""
    cells = spark.read.parquet(f"{path}/cells").orderBy("_cell").collect()
    books: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/codebooks").orderBy("part", "code").collect():
        books.setdefault(r["part"], []).append(r["centroid"])
    layout = spark.read.parquet(f"{path}/rows") if cells else None
    found = Cells(
        layout, np.asarray([r["pivot"] for r in cells]), np.asarray([r["_cell"] for r in cells], dtype=np.int64),
        np.asarray([r["blocks"] for r in cells], dtype=np.int64), np.asarray([r["rows"] for r in cells], dtype=np.int64),
        np.asarray([r["radius"] for r in cells]),
    )
    return VectorIndex(found, [np.asarray(b) for b in books.values()])


def search_index(queries: DataFrame, index: VectorIndex, n: int, *, query_id: str, vector_col: str, row_id: str | None = None,
                 extra: Sequence[str] = (), ties: Sequence[str] = (), exclude_same_id: bool = False, query_rows: int = 131_072) -> DataFrame:
    """Exact ``(query, id, similarity, extra...)`` of the top-n; see :func:`parlor.operators.knn.search_cells`."""
    if index.rows is None:
        return _nothing(queries, row_id or query_id)
    return search_assigned(
        queries, index.cells, n, query_id=query_id, vector_col=vector_col, row_id=row_id, extra=extra, ties=ties,
        exclude_same_id=exclude_same_id, query_rows=query_rows,
    )


def _nothing(queries: DataFrame, row_id: str) -> DataFrame:
    query = queries.select(F.col(row_id).alias("query"))
    return query.select("query", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("similarity")).limit(0)


def probes_for(queries: DataFrame, index: VectorIndex, n: int, *, query_id: str, vector_col: str, exclude_same_id: bool = False,
               recall: float = 0.97, sample: int = 256, seed: int = 42) -> int:
    """The fewest cells to visit so that they hold ``recall`` of the true top-n of ``sample`` queries, searched exactly."""
    if index.rows is None:
        return 1
    asked = durable(queries.select(query_id, vector_col).orderBy(F.rand(seed)).limit(sample).withColumn("_row", F.monotonically_increasing_id()))
    options = dict(query_id=query_id, vector_col=vector_col, row_id="_row", exclude_same_id=exclude_same_id)
    pairs = search_index(asked, index, n, extra=["_pos"], **options).select("query", "_pos")
    # At most ``sample * n`` small rows.
    hits = index.rows.select("_pos", "_cell").join(F.broadcast(pairs), "_pos").select("query", "_cell").collect()
    vectors = {r["_row"]: r[vector_col] for r in asked.collect()}
    at = {c: i for i, c in enumerate(index.cells.numbers.tolist())}
    if not hits:
        return 1
    base = _matrix(pd.Series([vectors[r["query"]] for r in hits])) @ index.cells.pivots.T
    own = base[np.arange(len(hits)), [at[r["_cell"]] for r in hits]]
    ranks = np.sort((base > own[:, None]).sum(axis=1))
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1


def _scores(queries: np.ndarray, base: np.ndarray, codes: np.ndarray, codebooks: list[np.ndarray]) -> np.ndarray:
    """Approximate similarities, queries x rows: that to the pivot and one table entry per subspace."""
    total = np.repeat(base.astype(np.float32)[:, None], len(codes), axis=1)
    for m, (s, book) in enumerate(zip(_subspaces(queries.shape[1], len(codebooks)), codebooks)):
        total += (queries[:, s] @ book.T).astype(np.float32)[:, codes[:, m]]
    return total


def search_approximate(queries: DataFrame, index: VectorIndex, n: int, *, query_id: str, vector_col: str, row_id: str | None = None,
                       extra: Sequence[str] = (), ties: Sequence[str] = (), exclude_same_id: bool = False, probes: int = 24,
                       rerank: int = 10, query_rows: int = 131_072) -> DataFrame:
    """``(query, id, similarity, extra...)`` of about the top-n: from the ``probes`` nearest cells, by codes, then by vectors."""
    row_id = row_id or query_id
    if index.rows is None:
        return _nothing(queries, row_id)
    cells, codebooks, most = index.cells, index.codebooks, rerank * n
    pivots, dimensions = cells.pivots, cells.pivots.shape[1]
    pair_schema = pair_type(queries, row_id, cells.rows, "id", extra)
    slot_cell, tile = slots_of(cells, 131_072)
    asked = queries.select(
        F.col(row_id).alias("_qrow"), F.col(query_id).alias("_qid"), short_directed(queries, vector_col).alias("_qv")
    ).where(F.col("_qv").isNotNull())

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                base = _matrix(batch["_qv"]) @ pivots.T
                nearest = np.argsort(-base, axis=1, kind="stable")[:, :probes]
                visits = np.zeros(base.shape, dtype=bool)
                np.put_along_axis(visits, nearest, True, axis=1)
                slots = visits[:, slot_cell]
                yield batch.assign(
                    _near=nearest[:, 0].astype(np.int32), _floor=-1.0, _slots=[row.tobytes() for row in np.packbits(slots, axis=1)],
                    _tiles=tiles_visited(slots, tile),
                )

    planned = durable(asked.mapInPandas(plan, visit_type(asked)))
    at = {c: i for i, c in enumerate(cells.numbers.tolist())}

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        # Rows of a cell lie side by side.
        order = [(c, "ascending") for c in ("_cell", "id", "_pos")]
        right = right.take(pc.sort_indices(right, order, null_placement="at_start"))
        numbers = right["_cell"].to_numpy()
        starts = np.flatnonzero(np.r_[True, np.diff(numbers) != 0])
        edges = np.r_[starts, len(numbers)]
        own_cells = [at[c] for c in numbers[starts].tolist()]
        codes = np.frombuffer(b"".join(right["_code"].to_pylist()), dtype=np.uint8).reshape(len(numbers), len(codebooks))
        decoded = decode(codes, np.repeat(own_cells, np.diff(edges)), pivots, codebooks).astype(np.float32)
        vectors, queries_ = unit_rows(right["_v"], dimensions), unit_rows(left["_qv"], dimensions)
        bits = np.frombuffer(b"".join(left["_slots"].to_pylist()), dtype=np.uint8).reshape(len(queries_), -1)
        own, others = same_ids(left["_qid"], right["id"], exclude_same_id)
        id_order = np.argsort(others, kind="stable")
        by_id = others[id_order]
        place = np.empty(len(numbers), dtype=np.int64)
        place[pc.sort_indices(right, [(c, "ascending") for c in ("id", *ties, "_pos")], null_placement="at_start").to_numpy()] = np.arange(len(numbers))
        first = np.searchsorted(slot_cell, own_cells)
        short, out, step = queries_.astype(np.float32), [], max(1, PRODUCT_CELLS // len(numbers))
        for start in range(0, len(short), step):
            scores = short[start : start + step] @ decoded.T
            visits = np.unpackbits(bits[start : start + step], axis=1)[:, first]
            for cell in np.flatnonzero(~visits.all(axis=0)):
                scores[visits[:, cell] == 0, edges[cell] : edges[cell + 1]] = -np.inf
            if exclude_same_id:
                # Their own rows must not crowd out others.
                low, high = np.searchsorted(by_id, own[start : start + step]), np.searchsorted(by_id, own[start : start + step], side="right")
                for i in np.flatnonzero(high > low):
                    scores[i, id_order[low[i] : high[i]]] = -np.inf
            reached = scores >= least_of_best(scores, most)[:, None]
            rows, columns = np.nonzero(reached & np.isfinite(scores))
            likely = cut(rows, columns, scores[rows, columns], most)
            rows, columns = rows[likely], columns[likely]
            sims = products(queries_, vectors, start + rows, columns)
            kept = cut(rows, place[columns], sims, n)
            out.append((start + rows[kept], columns[kept], sims[kept]))
        rows, columns, sims = (np.concatenate(x) for x in zip(*out))
        hits = right.select(["id", *extra]).take(pa.array(columns))
        found = {"query": left["_qrow"].take(pa.array(rows)), "similarity": pa.array(sims)} | {c: hits[c] for c in hits.column_names}
        return pa.table({c: found[c] for c in pair_schema.names})

    per_tile = by_tile(planned, cells, slot_cell, tile, dict.fromkeys(["id", "_v", "_code", "_pos", "_cell", *extra]), match, pair_schema, query_rows)
    return best_of_all(per_tile, n, ties)
