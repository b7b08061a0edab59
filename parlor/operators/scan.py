"""Turns of conversations given line by line, by a prefix scan over sorted ranges.

Lines are dealt into ranges by conversation and order, and sorted inside them. What a range does to the state of a scan
is associative: it adds the turns that it opens, and its first lines continue whatever turn was open before. So every
range is read once with a state of its own; one small row per end of a range says how many turns it opened in its first
and last conversation, their running sums over the ranges give each range's start, and only turns that cross
an end are put together from their parts. No conversation is gathered in one task, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parlor.operators.threads import ROLE_PREFIXES, turn_of, turn_pieces
from parlor.session import durable


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        columns = [pa.array([part] * n, pa.int64()), pa.array(range(place, place + n), pa.int64())]
        place += n
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "_part", "_at"])


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: the place of each row, from 0, in an order of all rows, without a sort in one task."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    placed = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_places, f"{fields}, _part long, _at long"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_start"))  # a row per partition
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def _scan(id_type: pa.DataType):
    schema = pa.schema([
        ("part", pa.int64()), ("id", id_type), ("turn", pa.int64()), ("text", pa.string()), ("first", pa.bool_()), ("last", pa.bool_()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Turns of a range, counted from its own start: 0 for lines that go on with a turn of an earlier range."""
        part, here, turn, held, first = TaskContext.get().partitionId(), object(), 0, [], True
        for batch in batches:
            rows = []
            for id_, opens, piece in zip(*[batch.column(c).to_pylist() for c in ("id", "opens", "piece")], strict=True):
                if id_ != here or opens:
                    if held:
                        rows.append((part, here, turn, "\n".join(held), first, False))
                        held = []
                    if id_ != here:
                        first = here.__class__ is object  # only the range's first conversation may have begun before
                        here, turn = id_, 0
                    turn += opens
                held.append(piece)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if held:
            row = [[part], [here], [turn], ["\n".join(held)], [first], [True]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema, strict=True)], schema=schema)

    return run


def turns_of_lines(
    df: DataFrame,
    id_col: str,
    order: Sequence[str],
    line_col: str,
    prefixes: Mapping[str, str] = ROLE_PREFIXES,
    handles: Sequence[str] = (),
) -> DataFrame:
    """``id, position, role, text``: the turns of :func:`~parlor.operators.threads.parse_turns` for transcripts given in lines.

    A conversation's lines, in ``order``, are one transcript. Lines before its first turn and turns without text are left out; a null line
    is an empty one. Null ids are one conversation. Lines that tie in ``order`` keep some order of their own.
    """
    pieces = turn_pieces(F.col(line_col), prefixes)
    exploded = df.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.posexplode(pieces).alias("k", "piece"))
    opens = turn_of(F.col("piece"), prefixes)["role"].isNotNull()
    lines = exploded.withColumn("opens", opens)
    keys = [F.col("id").asc_nulls_first(), *[F.col(f"o{i}") for i in range(len(order))], F.col("k")]
    kind = lines.schema["id"].dataType
    found = lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "opens", "piece").mapInArrow(
        _scan(to_arrow_type(kind)), f"part long, id {kind.simpleString()}, turn long, text string, first boolean, last boolean"
    )
    found = durable(found)
    # The first and the last conversation of each range: how many turns they open in it.
    ends = found.groupBy("part", "id").agg(F.max("turn").alias("opened"), F.max("first").alias("first"), F.max("last").alias("last")).where("first or last")
    before = F.coalesce(F.sum("opened").over(W.partitionBy("id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ends.withColumn("before", before).where("first").select(F.col("part").alias("_part"), "before")
    at = F.col("turn") + F.when(F.col("first"), F.coalesce("before", F.lit(0))).otherwise(0)
    placed = found.join(F.broadcast(starts), F.col("part") == F.col("_part"), "left").withColumn("at", at).where("at > 0")
    whole = placed.where("not last and not (first and turn = 0)")
    cut = placed.where("last or (first and turn = 0)")
    # A turn that crosses ends has one part in each of its ranges; where its opening is whole, it stands alone.
    parts = F.array_sort(F.collect_list(F.struct("part", "text")))
    joined = cut.groupBy("id", "at").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    texts = whole.select("id", "at", "text").unionByName(joined)
    turn = turn_of(F.col("text"), prefixes, handles)
    spoken = texts.withColumn("t", F.explode(F.array(turn))).where("t.text <> ''").select("id", "at", "t.role", "t.text")
    return _positions(spoken)


def _positions(turns: DataFrame) -> DataFrame:
    """``id, position, role, text`` from ``id, at, role, text``."""
    placed = numbered(turns, [F.col("id").asc_nulls_first(), F.col("at")], "_n")
    first = placed.groupBy("id").agg(F.min("_n").alias("_first")).withColumnRenamed("id", "_id")
    return placed.join(first, F.col("id").eqNullSafe(F.col("_id"))).select("id", (F.col("_n") - F.col("_first")).alias("position"), "role", "text")
