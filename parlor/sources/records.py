"""Text records read in parallel ranges: CSV whose quoted fields hold line feeds, and malformed records set aside.

A file is read by byte ranges, as Spark splits it, line by line. Whether a line stands inside quotes depends on all
quotes before it, so these are counted first: their parity per range, summed over the ranges before, says how each range
starts. Then every range is cut into records in one pass without a shuffle; only the pieces of records that cross a
range's end are gathered and joined, in the order of the ranges. ``from_csv`` or ``from_json`` parses a record.

Results, all cases included:
* quotes inside quoted fields are doubled, as in RFC 4180; a backslash is an ordinary character;
* lines end with ``\\n`` or ``\\r\\n``; within quotes both are kept as they are; blank records are left out;
* a quote that is never closed makes the rest of its file one record;
* a position is the file, the start of the range in it, and the number of the record's first line in that range;
* an empty file has no records; a header is the first record of each file and must name the columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

CORRUPT = "_corrupt_record"
POSITION = ["file", "range", "line"]
CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "maxCharsPerColumn": "-1", "columnPruning": "false"}
PIECES = "file string, range long, line long, starts boolean, ends boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").alias("record")
    )


def _cut(open_ranges, quote: str):
    schema = pa.schema([
        ("file", pa.string()), ("range", pa.int64()), ("line", pa.int64()), ("starts", pa.bool_()), ("ends", pa.bool_()), ("record", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines come range by range, in order. Complete records, and the pieces at the ends of a range."""
        known, here = open_ranges.value, None
        inside, line, starts, held = 0, 0, True, []

        def piece(ends: bool) -> pa.RecordBatch:
            row = [here[0]], [here[1]], [line - len(held)], [starts], [ends], ["\n".join(held)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            files, places = batch.column("file"), batch.column("range").to_numpy()
            names = pc.dictionary_encode(files).indices.to_numpy()
            cuts = np.flatnonzero((places[1:] != places[:-1]) | (names[1:] != names[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(places)], strict=True):
                now = (files[int(a)].as_py(), int(places[a]))
                if now != here:
                    if held:
                        yield piece(False)
                    here, line, held = now, 0, []
                    inside = int(now in known)
                    starts = not inside
                values = batch.column("record").slice(a, b - a)
                odd = pc.count_substring(values, quote).to_numpy() & 1
                after = (inside + np.cumsum(odd)) & 1
                closes = np.flatnonzero(after == 0)  # a record ends with these lines
                text, first, rows = values.to_pylist(), 0, []
                for stop in closes.tolist():
                    held += text[first : stop + 1]
                    rows.append((line + stop + 1 - len(held), starts, held[0] if len(held) == 1 else "\n".join(held)))
                    first, held, starts = stop + 1, [], True
                held += text[first:]
                inside, line = int(after[-1]), line + len(text)
                if rows:
                    numbers, begins, records = zip(*rows, strict=True)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([here[0]] * n), pa.array([here[1]] * n, pa.int64()), pa.array(numbers, pa.int64()), pa.array(begins), pa.array([True] * n), pa.array(records, pa.string())],
                        schema=schema,
                    )
        if held:
            yield piece(False)

    return run


def quoted_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """``file, range, line, record``: records of lines, a line feed inside quotes being part of its record.

    Runs one job, which counts quotes. One row per range travels to the tasks: its file and start, where it starts inside quotes.
    """
    lines = _lines(spark, path)
    value = F.col("record")
    quotes = F.length(value) - F.length(F.replace(value, F.lit(quote), F.lit("")))
    ranges = lines.groupBy("file", "range").agg(F.sum(quotes).alias("quotes"))
    before = F.sum("quotes").over(W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    opened = ranges.withColumn("before", before).where(F.col("before") % 2 == 1).select("file", "range").collect()
    shared = spark.sparkContext.broadcast({(r["file"], r["range"]) for r in opened})
    cut = lines.mapInArrow(_cut(shared, quote), PIECES)
    whole = cut.where("starts and ends").select(*POSITION, "record")
    if not opened:
        # A record can't cross ranges, but a quote may stay open at the end of a file.
        return whole.unionByName(cut.where("starts and not ends").select(*POSITION, "record"))
    # A piece belongs to the last range before it, or its own, where a record started that didn't end there.
    pieces = cut.where("not (starts and ends)")
    began = F.last(F.when(F.col("starts"), F.struct("range", "line")), ignorenulls=True).over(
        W.partitionBy("file").orderBy("range", "line").rowsBetween(W.unboundedPreceding, 0)
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col("range").alias("r"), F.col("line").alias("l"), "record")))
    joined = pieces.withColumn("began", began).groupBy("file", "began").agg(ordered.alias("parts")).select(
        "file", "began.range", "began.line", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record")
    )
    return whole.unionByName(joined)


def line_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, range, line, record``: one record per line."""
    return _lines(spark, path).mapInArrow(_numbered, "file string, range long, line long, record string")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, line = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        files, places = batch.column("file"), batch.column("range").to_numpy()
        names = pc.dictionary_encode(files).indices.to_numpy()
        cuts = np.flatnonzero((places[1:] != places[:-1]) | (names[1:] != names[:-1])) + 1
        numbers = []
        for a, b in zip([0, *cuts], [*cuts, len(places)], strict=True):
            now = (files[int(a)].as_py(), int(places[a]))
            line = line if now == here else 0
            here = now
            numbers.append(np.arange(line, line + b - a))
            line += int(b - a)
        yield pa.RecordBatch.from_arrays(
            [files, batch.column("range"), pa.array(np.concatenate(numbers)), batch.column("record")], names=[*POSITION, "record"]
        )


def _parsed(records: DataFrame, schema: str, parse) -> DataFrame:
    """``file, range, line, record``, the columns of ``schema`` in ``row``, and ``bad``."""
    bare = F.regexp_replace("record", r"\r\z", "")
    # The parser reads a record once and whole, also where only a filter asks for what it says.
    kept = records.withColumn("record", bare).where("record <> ''")
    row = F.explode(F.array(parse(F.col("record"), f"{schema}, {CORRUPT} STRING"))).alias("row")
    return kept.select(*POSITION, "record", row).withColumn("bad", F.col(f"row.{CORRUPT}").isNotNull())


def checked(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of good records, and the bad records with their positions."""
    fields = [f.name for f in parsed.schema["row"].dataType.fields if f.name != CORRUPT]
    good = parsed.where(~F.col("bad")).select(*[F.col(f"row.{name}").alias(name) for name in fields])
    return good, parsed.where("bad").select(*POSITION, "record")


def csv_records(spark: SparkSession, path: str, schema: str, *, header: bool = True, multi_line: bool = True,
                options: Mapping[str, str] = CSV_OPTIONS) -> DataFrame:
    """Parsed CSV records, for :func:`checked`."""
    records = quoted_records(spark, path, options["quote"]) if multi_line else line_records(spark, path)
    if header:
        names = [f.name for f in T.StructType.fromDDL(schema).fields]
        records = records.where(F.when((F.col("range") == 0) & (F.col("line") == 0), _header(F.col("record"), names)).otherwise(True))
    return _parsed(records, schema, lambda record, fields: F.from_csv(record, fields, {**options, "columnNameOfCorruptRecord": CORRUPT}))


def _header(record: Column, names: list[str]) -> Column:
    """False, so that the record is left out; another header than the names fails the read."""
    found = F.regexp_replace(record, r'["\r]', "")
    return F.when(found == ",".join(names), False).otherwise(F.raise_error(F.concat(F.lit("unexpected CSV header: "), found)).cast("boolean"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed JSON lines, for :func:`checked`."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return _parsed(line_records(spark, path), schema, lambda record, fields: F.from_json(record, fields, options))
