"""Exact top-n cosine search of a query table in a corpus table.

Two ways to the same result:

* a corpus whose measured size fits a broadcast is searched map-only: one matrix product per batch of
  queries, no shuffle;
* a larger corpus is cut into cells around pivot vectors, and queries into chunks of neighbouring pivots. The n-th
  similarity to a bounded sample of the corpus is a floor under that of each query's n-th neighbour; the query leaves
  out every cell that the triangle inequality keeps below its floor, and a cell is sent to a chunk only if some query
  of it visits the cell. Cells that lie side by side make a tile, and a chunk meets a tile in one task: products of
  short matrices in single precision find the pairs that may reach the floor, and these alone are compared in
  double precision. Tiles keep n rows per query.

In many dimensions few cells are ruled out, and an exact search then compares all pairs: its cost is queries x
corpus, with a copy of each corpus row for every chunk of ``query_rows`` queries and of each query for every tile
of ``block_rows`` rows (fewer where a dozen chunks or half a dozen tiles would not be reached). Where an approximate answer will do, :mod:`parlor.operators.ivf` avoids that; it also
keeps the cells of a corpus on disk for later searches.

Vectors are compared by direction: those that don't have unit length are scaled to it, zero and null vectors are
found by nobody and find nothing. Ranking compares similarities rounded to nine decimals, ties go to the smaller
corpus id and then to the ``ties`` columns; the similarity returned is not rounded. Ids may repeat on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parlor.functions.vectors import as_double, normalize
from parlor.session import durable

DIGITS = 9
# Cells are skipped in similarity space with this much room for the rounding above.
SLACK = 1e-5
PRODUCT_CELLS = 4_000_000
# Up to this many corpus rows, sorting all rows of a product at once beats one selection per row.
SORTED_ROWS = 2048
# Sides of one product of a tile, and how many pairs are kept before they are cut to n a query.
TILE_QUERIES, TILE_ROWS, HELD_PAIRS = 512, 2048, 1 << 19
# Corpus rows and bytes of the sample that floors come from.
FLOOR_ROWS, FLOOR_BYTES = 65_536, 32 << 20
# Chunks and tiles are not made smaller than this, nor fewer than a dozen and half a dozen while they are larger.
LEAST_SIDE = 8192
# Smallest number of pairs beyond which the table of cells and chunks is not broadcast.
BROADCAST_PAIRS = 1 << 20


def _matrix(vectors: pd.Series) -> np.ndarray:
    return _units(np.stack(vectors.to_numpy()))


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows of unit length; rows that have it up to rounding are left as they are."""
    rows = rows.astype(np.float64)
    lengths = np.linalg.norm(rows, axis=1)
    off = np.abs(lengths - 1.0) > 1e-6
    rows[off] /= lengths[off, None]
    return rows


def directed(vector: Column) -> Column:
    """The vector as doubles, null if it is null or zero."""
    return F.when(F.exists(vector, lambda x: x != 0), as_double(vector))


def short_directed(df: DataFrame, name: str) -> Column:
    """:func:`directed`, but single precision stays as it is where vectors travel; tasks compute in double precision."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType):
        return F.when(F.exists(name, lambda x: x != 0), F.col(name))
    return directed(F.col(name))


def _best(sims: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n largest values, earlier positions first among equals."""
    if len(sims) > n:
        limit = -np.partition(-sims, n - 1)[n - 1]
        keep = np.flatnonzero(sims >= limit)
    else:
        keep = np.arange(len(sims))
    keep = keep[np.isfinite(sims[keep])]
    return keep[np.lexsort((keep, -sims[keep]))][:n]


def _search(query_ids, queries: np.ndarray, corpus_ids, corpus: np.ndarray, n: int, exclude_same_id: bool):
    """Yield ``(query position, corpus positions, similarities)``; the corpus is sorted by id."""
    position: dict = {}
    for i, c in enumerate(corpus_ids if exclude_same_id else ()):
        position.setdefault(c, []).append(i)
    step = max(1, PRODUCT_CELLS // max(1, len(corpus_ids)))
    for start in range(0, len(queries), step):
        sims = queries[start : start + step] @ corpus.T
        ranks = np.round(sims, DIGITS)
        if exclude_same_id:
            for i in range(len(ranks)):
                same = position.get(query_ids[start + i])
                if same is not None:
                    ranks[i, same] = -np.inf
        if len(corpus_ids) <= SORTED_ROWS:
            order = np.argsort(-ranks, axis=1, kind="stable")[:, :n]
            chosen = (row[np.isfinite(ranks[i, row])] for i, row in enumerate(order))
        else:
            chosen = (_best(row, n) for row in ranks)
        for i, best in enumerate(chosen):
            yield start + i, best, sims[i, best]


def candidate_type(corpus: DataFrame, corpus_id: str, extra: Sequence[str]) -> T.ArrayType:
    fields = [T.StructField("id", corpus.schema[corpus_id].dataType), T.StructField("similarity", T.DoubleType())]
    fields += [T.StructField(c, corpus.schema[c].dataType) for c in extra]
    return T.ArrayType(T.StructType(fields))


def corpus_size(corpus: DataFrame, vector_col: str, texts: Sequence[str] = (), others: int = 0, measured: str | None = None) -> int:
    """Bytes the corpus would take in a broadcast as Python objects: vectors, ``texts``, ``others`` short columns.

    ``measured`` names a column with the bytes of what else is carried.
    """
    size = F.size(vector_col) * 8 + 200 + 80 * others
    if measured is not None:
        size = size + F.coalesce(F.col(measured), F.lit(0))
    for c in texts:
        size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 80
    return int(corpus.agg(F.sum(size).alias("b")).first()["b"] or 0)


class Packed:
    """A measured corpus, gathered once: a broadcast for the search, and the columns carried along."""

    def __init__(self, corpus: DataFrame, corpus_id: str, vector_col: str, extra: Sequence[str], ties: Sequence[str] = (),
                 carried: Sequence[str] = ()):
        chosen = corpus.select(F.col(corpus_id), directed(F.col(vector_col)).alias("_v"), *extra, *carried)
        table = chosen.where(F.col("_v").isNotNull()).toPandas()
        table = table.sort_values([corpus_id, *ties], kind="stable").reset_index(drop=True)
        ids = table[corpus_id].tolist()
        self.table, self.extra, self.type = table.drop(columns="_v"), list(extra), candidate_type(corpus, corpus_id, extra)
        self.shared = corpus.sparkSession.sparkContext.broadcast(
            (ids, _matrix(table["_v"]) if ids else None, {c: table[c].tolist() for c in extra})
        )


def search_broadcast(
    queries: DataFrame,
    corpus: Packed,
    n: int,
    *,
    query_id: str,
    vector_col: str,
    exclude_same_id: bool = False,
    output_col: str = "candidates",
) -> DataFrame:
    """Add the top-n candidates as an array column. Map-only, so it also runs on a stream."""
    packed, extra = corpus.shared, corpus.extra

    # Only the id and the vector travel to Python; the rest of the row stays in the JVM.
    @F.pandas_udf(corpus.type)
    def search(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        corpus_ids, vectors, columns = packed.value
        for query_ids, asked in batches:
            found: list[list] = [[] for _ in range(len(asked))]
            known = np.flatnonzero(asked.notna().to_numpy())
            if len(known) and corpus_ids:
                chosen = query_ids.iloc[known].tolist()
                hits = _search(chosen, _matrix(asked.iloc[known]), corpus_ids, vectors, n, exclude_same_id)
                for i, best, sims in hits:
                    found[known[i]] = [
                        {"id": corpus_ids[j], "similarity": float(s), **{c: columns[c][j] for c in extra}}
                        for j, s in zip(best, sims)
                    ]
            yield pd.Series(found, dtype=object)

    # Declared nondeterministic so that no filter above repeats the search.
    return queries.withColumn(output_col, search.asNondeterministic()(F.col(query_id), directed(F.col(vector_col))))


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def _chunks(pivots: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Per pivot its first chunk of queries and how many it has to itself.

    Pivots are lined up along their main direction; neighbours share a chunk of at most ``most`` queries, and a
    pivot with more is cut into several.
    """
    centred = pivots - pivots.mean(axis=0)
    direction = np.linalg.svd(centred, full_matrices=False)[2][0] if len(pivots) > 1 else np.ones(pivots.shape[1])
    first, parts, chunk, held = np.zeros(len(pivots), dtype=np.int64), np.ones(len(pivots), dtype=np.int64), 0, 0
    for p in np.argsort(centred @ direction, kind="stable"):
        parts[p] = max(1, math.ceil(counts[p] / most))
        if held and held + counts[p] > most:
            chunk, held = chunk + 1, 0
        first[p] = chunk
        if parts[p] > 1:
            chunk, held = chunk + int(parts[p]), 0
        else:
            held += int(counts[p])
    return first, parts


@dataclass(frozen=True)
class Cells:
    """A corpus dealt to the cells of its pivots: ``rows (id, _v, extra..., _cell, _block)``, and the size and radius of each cell."""

    rows: DataFrame
    pivots: np.ndarray
    numbers: np.ndarray
    blocks: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray


def pair_type(queries: DataFrame, row_id: str, corpus: DataFrame, corpus_id: str, extra: Sequence[str]) -> T.StructType:
    query = T.StructField("query", queries.schema[row_id].dataType)
    return T.StructType([query, *candidate_type(corpus, corpus_id, extra).elementType.fields])


def assigned_to(known: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``known`` with the nearest pivot ``_cell`` of its vector ``_v``, the ``_angle`` to it and a number ``_pos`` of the row."""
    schema = T.StructType([*known.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_angle", T.DoubleType())])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                angles = _angles(_matrix(batch["_v"]), pivots)
                nearest = angles.argmin(axis=1)
                yield batch.assign(_cell=nearest.astype(np.int32), _angle=angles[np.arange(len(batch)), nearest])

    return known.mapInPandas(assign, schema).withColumn("_pos", F.monotonically_increasing_id())


def cell_summary(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("_cell").agg(F.count("*").alias("rows"), F.max("_angle").alias("radius"))


def block_of(pos: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(pos), blocks).cast("int")


def by_number(column: Column, values: dict[int, int]) -> Column:
    """The value of each of a bounded number of cells, 0 for others."""
    dense = [values.get(i, 0) for i in range(max(values, default=0) + 1)]
    return F.get(F.array(*[F.lit(int(x)) for x in dense]), column)


def search_cells(
    queries: DataFrame,
    corpus: DataFrame,
    n: int,
    *,
    query_id: str,
    corpus_id: str,
    vector_col: str,
    row_id: str | None = None,
    extra: Sequence[str] = (),
    ties: Sequence[str] = (),
    exclude_same_id: bool = False,
    cells: int | None = None,
    block_rows: int = 131_072,
    query_rows: int = 131_072,
    seed: int = 42,
) -> DataFrame:
    """``(query, id, similarity, extra...)`` of the top-n for a corpus of any size.

    ``query`` is the value of ``row_id``, which must tell the queries apart (by default ``query_id``). ``cells``
    is by default the square root of the corpus rows, 4,096 at most.
    """
    known = corpus.select(F.col(corpus_id).alias("id"), short_directed(corpus, vector_col).alias("_v"), *extra).where(F.col("_v").isNotNull())
    rows = known.count()
    if not rows:
        return queries.sparkSession.createDataFrame([], pair_type(queries, row_id or query_id, corpus, corpus_id, extra))
    cells = cells or min(4096, max(1, math.isqrt(rows)))
    # Any pivots will do; at most `cells` rows.
    some = known.select("_v").orderBy(F.rand(seed)).limit(cells).collect()
    pivots = _matrix(pd.Series([r["_v"] for r in some]))
    # Read twice below (cell summaries, search), so the assignment is stored once.
    assigned = durable(assigned_to(known, pivots))
    # At most `cells` rows.
    summary = cell_summary(assigned).orderBy("_cell").collect()
    numbers = np.asarray([r["_cell"] for r in summary])
    side = tile_side(rows, block_rows)
    blocks = np.asarray([math.ceil(r["rows"] / side) for r in summary])
    block = block_of(F.col("_pos"), by_number(F.col("_cell"), dict(zip(numbers.tolist(), blocks.tolist()))))
    found = Cells(
        assigned.withColumn("_block", block).drop("_pos", "_angle"), pivots[numbers], numbers, blocks,
        np.asarray([r["rows"] for r in summary]), np.asarray([r["radius"] for r in summary]),
    )
    return search_assigned(
        queries, found, n, query_id=query_id, vector_col=vector_col, row_id=row_id, extra=extra, ties=ties,
        exclude_same_id=exclude_same_id, block_rows=block_rows, query_rows=query_rows,
    )


def tile_side(rows: int, most: int) -> int:
    """Corpus rows of a tile: at least half a dozen tiles, unless they became small."""
    return min(most, max(LEAST_SIDE, math.ceil(rows / 6)))


def unit_rows(column: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    """The vectors of an Arrow column as a matrix of unit rows."""
    return _units(column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))


def error32(dimensions: int) -> float:
    """How far a product of unit vectors in single precision may be from the exact one."""
    return (dimensions + 8) * 1.2e-7


def least_of_best(scores: np.ndarray, n: int) -> np.ndarray:
    """Per row a number that at least ``n`` of its scores reach, close to the n-th largest: that of the largest of small groups."""
    rows, columns = scores.shape
    if columns < n:
        return np.full(rows, -np.inf)
    group = max(1, min(64, columns // (16 * n)))
    groups = columns // group
    largest = scores[:, : group * groups].reshape(rows, group, groups).max(axis=1)
    return np.partition(largest, groups - n, axis=1)[:, groups - n]


def cut(rows: np.ndarray, columns: np.ndarray, similarities: np.ndarray, n: int) -> np.ndarray:
    """Positions of the ``n`` best pairs of every row: by rounded similarity, then by column."""
    order = np.lexsort((columns, -np.round(similarities, DIGITS), rows))
    starts = np.flatnonzero(np.r_[True, np.diff(rows[order]) != 0]) if len(order) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < n]


def products(queries: np.ndarray, corpus: np.ndarray, rows: np.ndarray, columns: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Similarities of single pairs in double precision."""
    parts = [
        np.einsum("ij,ij->i", queries[rows[i : i + step]], corpus[columns[i : i + step]]) for i in range(0, len(rows), step)
    ]
    return np.concatenate(parts) if parts else np.zeros(0)


def enough_copies(vectors: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the rows, sorted by id, that can be among the ``n`` best of a query.

    Of equal vectors those of the first n + 1 ids, n rows each, are enough, as a query passes over one id at most.
    """
    bits = np.ascontiguousarray(vectors).view(np.uint64)
    odd = np.random.default_rng(5).integers(0, 1 << 63, bits.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    kind = (bits * odd).sum(axis=1, dtype=np.uint64)
    order = np.argsort(kind, kind="stable")
    at = np.arange(len(order))

    def starts(new: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(new, at, 0))

    new_kind = np.r_[True, np.diff(kind[order]) != 0]
    new_id = new_kind | np.r_[True, np.diff(ids[order]) != 0]
    counted = np.cumsum(new_id)
    crowded = (counted - counted[starts(new_kind)] > n) | (at - starts(new_id) >= n)
    # Equal digests of unequal vectors drop nothing.
    dropped = np.flatnonzero(crowded)
    same = (vectors[order[dropped]] == vectors[order[starts(new_kind)[dropped]]]).all(axis=1)
    keep = np.ones(len(order), dtype=bool)
    keep[order[dropped[same]]] = False
    return np.flatnonzero(keep)


def best_pairs(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, corpus: np.ndarray, corpus_ids: np.ndarray, n: int):
    """``(query positions, corpus positions, similarities)`` of each query's ``n`` best rows of a tile at or above its floor.

    The corpus is sorted by id and ties. Pairs of equal numbers that are not negative are passed over.
    """
    slack = error32(queries.shape[1])
    short_queries, short_corpus = queries.astype(np.float32), corpus.astype(np.float32)
    out = []
    for start in range(0, len(queries), TILE_QUERIES):
        stop = min(len(queries), start + TILE_QUERIES)
        bound = (floors[start:stop] - slack).astype(np.float32)
        rows, columns, sims = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for left in range(0, len(corpus), TILE_ROWS):
            scores = short_queries[start:stop] @ short_corpus[left : left + TILE_ROWS].T
            r, c = np.divmod(np.flatnonzero(scores >= bound[:, None]), scores.shape[1])
            c += left
            other = (query_ids[start + r] != corpus_ids[c]) | (corpus_ids[c] < 0)
            waiting.append((r[other], c[other]))
            held += len(waiting[-1][0])
            if held > HELD_PAIRS or left + TILE_ROWS >= len(corpus):
                r, c = (np.concatenate(x) for x in zip(*waiting))
                rows, columns = np.r_[rows, r], np.r_[columns, c]
                sims = np.r_[sims, products(queries, corpus, start + r, c)]
                kept = cut(rows, columns, sims, n)
                rows, columns, sims = rows[kept], columns[kept], sims[kept]
                full = np.flatnonzero(np.bincount(rows, minlength=stop - start) >= n)
                # The last of n kept pairs raises the floor of its row.
                last = np.searchsorted(rows, full, side="right") - 1
                bound[full] = np.maximum(bound[full], (sims[last] - slack - SLACK).astype(np.float32))
                waiting, held = [], 0
        out.append((start + rows, columns, sims))
    return tuple(np.concatenate(x) for x in zip(*out))


def same_ids(queries: pa.ChunkedArray, corpus: pa.ChunkedArray, exclude_same_id: bool) -> tuple[np.ndarray, np.ndarray]:
    """A number for each id, the same on both sides; ids that are null, or none at all unless asked for, differ from all."""
    if not exclude_same_id:
        return np.full(len(queries), -2), np.full(len(corpus), -1)
    both = pa.chunked_array([*queries.cast(corpus.type).chunks, *corpus.chunks], type=corpus.type)
    codes = pd.factorize(both.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False))[0]
    numbers = np.where(codes < 0, -1, codes)
    return np.where(numbers[: len(queries)] < 0, -2, numbers[: len(queries)]), numbers[len(queries) :]


def slots_of(cells: Cells, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks are numbered through all cells: a slot is one block of one cell. The cell and the tile of every slot."""
    slot_cell = np.repeat(np.arange(len(cells.blocks)), cells.blocks)
    rows = np.ceil(cells.sizes / cells.blocks)[slot_cell]
    return slot_cell, _chunks(cells.pivots[slot_cell], rows, tile_side(int(cells.sizes.sum()), block_rows))[0]


def visit_type(asked: DataFrame) -> T.StructType:
    """Queries with their nearest pivot, their floor, a bit for each slot they visit, and the tiles of those."""
    return T.StructType(
        [
            *asked.schema.fields,
            T.StructField("_near", T.IntegerType()),
            T.StructField("_floor", T.DoubleType()),
            T.StructField("_slots", T.BinaryType()),
            T.StructField("_tiles", T.ArrayType(T.IntegerType())),
        ]
    )


def tiles_visited(slots: np.ndarray, tile: np.ndarray) -> list[np.ndarray]:
    """Per row of a table of slots the numbers of their tiles."""
    counts = np.zeros((len(slots), int(tile.max(initial=0)) + 1), dtype=bool)
    order = np.argsort(tile, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(tile[order]) != 0])
    counts[:, tile[order][starts]] = np.logical_or.reduceat(slots[:, order], starts, axis=1)
    return [np.flatnonzero(row).astype(np.int32) for row in counts]


def by_tile(planned: DataFrame, cells: Cells, slot_cell: np.ndarray, tile: np.ndarray, columns: Sequence[str], match, schema: T.StructType,
            query_rows: int) -> DataFrame:
    """``match`` of every chunk of queries with the rows of every tile that it visits."""
    near = {r["_near"]: r["n"] for r in planned.groupBy("_near").agg(F.count("*").alias("n")).collect()}
    side = min(query_rows, max(LEAST_SIDE, math.ceil(sum(near.values()) / 12)))
    first_chunk, parts = _chunks(cells.pivots, np.asarray([near.get(i, 0) for i in range(len(cells.blocks))]), side)
    part = F.pmod(F.xxhash64("_qrow"), by_number(F.col("_near"), dict(enumerate(parts))))
    chunked = planned.withColumn("_chunk", (by_number(F.col("_near"), dict(enumerate(first_chunk))) + part).cast("int")).drop("_near")

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, own in batch.groupby("_chunk"):
                bits = np.bitwise_or.reduce(np.frombuffer(b"".join(own["_slots"]), dtype=np.uint8).reshape(len(own), -1), axis=0)
                slots = np.flatnonzero(np.unpackbits(bits)[: len(slot_cell)]).astype(np.int32)
                yield pd.DataFrame({"_slot": slots, "_chunk": np.full(len(slots), chunk, dtype=np.int32)})

    # A cell goes to the chunks that visit it and to no others.
    needed = durable(chunked.select("_chunk", "_slots").mapInPandas(pairs, "_slot int, _chunk int").distinct())
    visited = {int(cells.numbers[slot_cell[r["_slot"]]]) for r in needed.select("_slot").distinct().collect()}
    first_slot = dict(zip(cells.numbers.tolist(), (np.cumsum(cells.blocks) - cells.blocks).tolist()))
    slot = (by_number(F.col("_cell"), first_slot) + F.col("_block")).cast("int")
    dealt = cells.rows.where(F.col("_cell").isin(sorted(visited))).select(*columns, slot.alias("_slot"))
    offered = dealt.join(F.broadcast(needed) if needed.count() <= BROADCAST_PAIRS else needed, "_slot")
    placed = offered.withColumn("_tile", by_number(F.col("_slot"), dict(enumerate(tile.tolist()))))
    key, kind = ["_tile", "_chunk"], to_arrow_schema(schema)

    def matched(left: pa.Table, right: pa.Table) -> pa.Table:
        return match(left, right) if len(left) and len(right) else kind.empty_table()

    visiting = chunked.withColumn("_tile", F.explode("_tiles")).drop("_tiles")
    return visiting.groupBy(*key).cogroup(placed.groupBy(*key)).applyInArrow(matched, schema)


def search_assigned(
    queries: DataFrame,
    cells: Cells,
    n: int,
    *,
    query_id: str,
    vector_col: str,
    row_id: str | None = None,
    extra: Sequence[str] = (),
    ties: Sequence[str] = (),
    exclude_same_id: bool = False,
    block_rows: int = 131_072,
    query_rows: int = 131_072,
) -> DataFrame:
    """:func:`search_cells` in a corpus that is dealt to cells already; only the rows of visited cells are read."""
    row_id = row_id or query_id
    pair_schema = pair_type(queries, row_id, cells.rows, "id", extra)
    pivots, radius, dimensions = cells.pivots, cells.radius, cells.pivots.shape[1]
    slot_cell, tile = slots_of(cells, block_rows)
    asked = queries.select(
        F.col(row_id).alias("_qrow"), F.col(query_id).alias("_qid"), short_directed(queries, vector_col).alias("_qv")
    ).where(F.col("_qv").isNotNull())
    # A bounded sample that bounds are taken from; every row is searched.
    wanted = min(FLOOR_ROWS, FLOOR_BYTES // (8 * dimensions))
    share = min(1.0, wanted / max(1, int(cells.sizes.sum())))
    some = (cells.rows if share == 1 else cells.rows.sample(share, seed=42)).select("id", "_v").toPandas()
    owners: dict = {}
    for i, x in enumerate(some["id"].tolist() if exclude_same_id else ()):
        owners.setdefault(x, []).append(i)
    sample = _matrix(some["_v"]).astype(np.float32) if len(some) else np.zeros((0, dimensions), dtype=np.float32)
    shared = queries.sparkSession.sparkContext.broadcast((sample, owners))

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample, owners = shared.value
        step = max(1, PRODUCT_CELLS // max(1, len(sample)))
        for batch in batches:
            if not len(batch):
                continue
            vectors, ids = _matrix(batch["_qv"]), batch["_qid"].tolist()
            short, floors = vectors.astype(np.float32), []
            for start in range(0, len(batch), step):
                scores = short[start : start + step] @ sample.T
                for i in range(len(scores) if owners else 0):
                    own = owners.get(ids[start + i])
                    if own is not None:
                        scores[i, own] = -np.inf
                floors.append(least_of_best(scores, n))
            floors = np.concatenate(floors).astype(np.float64) - error32(dimensions) - SLACK
            angles = _angles(vectors, pivots)
            nearest = np.cos(np.maximum(angles - radius, 0.0))
            slots = (nearest >= floors[:, None])[:, slot_cell]
            yield batch.assign(
                _near=angles.argmin(axis=1).astype(np.int32), _floor=floors, _slots=[row.tobytes() for row in np.packbits(slots, axis=1)],
                _tiles=tiles_visited(slots, tile),
            )

    planned = durable(asked.mapInPandas(plan, visit_type(asked)))

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        order = [(c, "ascending") for c in ("id", *ties)]
        right = right.take(pc.sort_indices(right, order, null_placement="at_start"))
        own, others = same_ids(left["_qid"], right["id"], exclude_same_id)
        vectors = unit_rows(right["_v"], dimensions)
        some = enough_copies(vectors, others if exclude_same_id else np.zeros(len(vectors), dtype=np.int64), n)
        rows, columns, sims = best_pairs(unit_rows(left["_qv"], dimensions), own, left["_floor"].to_numpy(), vectors[some], others[some], n)
        hits = right.select(["id", *extra]).take(pa.array(some[columns]))
        found = {"query": left["_qrow"].take(pa.array(rows)), "similarity": pa.array(sims)} | {c: hits[c] for c in hits.column_names}
        return pa.table({c: found[c] for c in pair_schema.names})

    per_tile = by_tile(planned, cells, slot_cell, tile, ["id", "_v", *extra], match, pair_schema, query_rows)
    return best_of_all(per_tile, n, ties)


def best_of_all(pairs: DataFrame, n: int, ties: Sequence[str] = ()) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.bround("similarity", DIGITS).desc(), F.col("id"), *ties)
    return pairs.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def numbered(queries: DataFrame) -> DataFrame:
    """The queries, stored, with a number ``_row`` of each row, since their ids may repeat."""
    return durable(queries.withColumn("_row", F.monotonically_increasing_id()))


def listed_by_row(rows: DataFrame, pairs: DataFrame, kind: T.ArrayType, extra: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Add ``candidates`` to :func:`numbered` queries from pairs whose ``query`` is that number."""
    # At most n small rows per query are gathered.
    keyed = F.struct(
        (-F.bround("similarity", DIGITS)).alias("k"), F.col("id"), *[F.col(c).alias(f"t_{c}") for c in ties],
        F.struct("id", "similarity", *extra).alias("c"),
    )
    gathered = pairs.groupBy("query").agg(F.array_sort(F.collect_list(keyed)).alias("_c"))
    listed = gathered.select(F.col("query").alias("_row"), F.transform("_c", lambda x: x["c"]).alias("candidates"))
    return rows.join(listed, "_row", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(kind)))


def similar_by_row(rows: DataFrame, corpus: DataFrame, n: int, *, corpus_id: str, extra: Sequence[str] = (),
                   ties: Sequence[str] = (), **options) -> DataFrame:
    """Add ``candidates`` to :func:`numbered` queries by way of :func:`search_cells`."""
    pairs = search_cells(rows, corpus, n, row_id="_row", corpus_id=corpus_id, extra=extra, ties=ties, **options)
    return listed_by_row(rows, pairs, candidate_type(corpus, corpus_id, extra), extra, ties)


def top_similar(
    queries: DataFrame,
    corpus: DataFrame,
    n: int,
    *,
    query_id: str,
    corpus_id: str,
    vector_col: str,
    extra: Sequence[str] = (),
    exclude_same_id: bool = False,
    max_broadcast_bytes: int = 64 * 1024 * 1024,
) -> DataFrame:
    """Add ``candidates: array<struct(id, similarity, extra...)>``, best first, to every query."""
    options = dict(query_id=query_id, vector_col=vector_col, exclude_same_id=exclude_same_id)
    if corpus_size(corpus, vector_col, extra) <= max_broadcast_bytes:
        return search_broadcast(queries, Packed(corpus, corpus_id, vector_col, extra, extra), n, **options)
    return similar_by_row(numbered(queries), corpus, n, corpus_id=corpus_id, extra=extra, ties=extra, **options).drop("_row")


def lsh_similar(
    queries: DataFrame,
    corpus: DataFrame,
    least_similarity: float,
    *,
    query_id: str,
    corpus_id: str,
    vector_col: str,
    bucket_length: float = 0.5,
    tables: int = 8,
    seed: int = 42,
) -> DataFrame:
    """Approximate pairs ``(query, id, similarity)`` of at least ``least_similarity``, by locality-sensitive hashing.

    Found pairs are right, some pairs are missed; more ``tables`` or longer buckets miss fewer. No row is compared
    with rows outside its buckets.
    """

    def prepared(df: DataFrame, id_col: str, name: str) -> DataFrame:
        vector = normalize(directed(F.col(vector_col)))
        return df.select(F.col(id_col).alias(name), vector.alias("v")).where("v is not null").select(name, array_to_vector("v").alias("v"))

    left, right = prepared(queries, query_id, "query"), prepared(corpus, corpus_id, "id")
    hashing = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket_length, numHashTables=tables, seed=seed)
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * least_similarity))
    pairs = hashing.fit(right).approxSimilarityJoin(left, right, reach, distCol="d")
    return pairs.select("datasetA.query", "datasetB.id", (1.0 - F.col("d") * F.col("d") / 2.0).alias("similarity"))
