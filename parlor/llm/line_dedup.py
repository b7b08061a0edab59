"""Line deduplication with two Bloom filters.

Every partition hashes its lines and fills two filters: keys seen once, and keys seen in a second document.
The filters are cut into segments. A segment of two partitions merges as ``twice = twice1 | twice2 |
(once1 & once2)``: a key of both partitions has all its bits in both, so no repeated key is ever missed.
Lines whose key is in the merged twice filter are suspects, and only they are shuffled, with their full key,
which settles who repeats whom and where the first occurrence is. A falsely suspected line costs a row in that
shuffle and nothing else.

The filters have a fixed, documented size (``filter_bits``). With far more lines than bits more lines become
suspects; the result stays the same. The confirmed keys go to the documents by broadcast where their measured
number allows, else the dropped line numbers are joined to the documents by id and text hash.

Results, all cases included:
* a text is split at line feeds; a null or empty text is one empty line;
* a line's key is the line without ASCII white space at both ends, A-Z lowered; keys of fewer than
  ``least_chars`` code points never drop;
* a key's lines stay in the documents with its smallest id and go everywhere else; documents without an id come
  last, and if no document with the key has an id all of them keep it;
* rows that share the smallest id all keep the line; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parlor.llm.common import MAX_BROADCAST_ROWS, durable, text_hash

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: 16 MB for each of the two filters.
FILTER_BITS = 1 << 27
SEGMENT_BITS = 1 << 19
PROBES = 2


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def keys_of(text: Column, least_chars: int) -> Column:
    """Per line its key, null if it is too short to count."""
    return F.transform(F.transform(lines_of(text), line_key), lambda key: F.when(F.length(key) >= max(1, least_chars), key))


def _hashes(keys: Column, salt: int) -> Column:
    """Per key a 64-bit hash, 0 for none."""
    return F.transform(keys, lambda k: F.when(k.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(salt), k)))


def _positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit numbers of each hash: all in one segment. Rows are hashes."""
    h = hashes.view(np.uint64)
    segment = (h >> np.uint64(40)) % np.uint64(bits // SEGMENT_BITS)
    first, step = h & np.uint64(0xFFFFF), (h >> np.uint64(20)) & np.uint64(0xFFFFF) | np.uint64(1)
    probes = [(first + np.uint64(i) * step) % np.uint64(SEGMENT_BITS) for i in range(PROBES)]
    at = np.stack([segment * np.uint64(SEGMENT_BITS) + p for p in probes], axis=1).astype(np.int64)
    return at >> 3, np.left_shift(1, at & 7).astype(np.uint8)


def _has(bytes_: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (bytes_[at[0]] & at[1] == at[1]).all(axis=1)


def _add(bytes_: np.ndarray, at: tuple[np.ndarray, np.ndarray], which=slice(None)) -> None:
    np.bitwise_or.at(bytes_, at[0][which].ravel(), at[1][which].ravel())


def _fill(bits: int):
    schema = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The filters of one partition, as compressed segments."""
        once, twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            values, counts = np.unique(batch.column("hashes").flatten().to_numpy(), return_counts=True)
            values, counts = values[values != 0], counts[values != 0]
            at = _positions(values, bits)
            _add(twice, at, (counts > 1) | _has(once, at))
            _add(once, at)
        width = SEGMENT_BITS // 8
        for i in range(bits // SEGMENT_BITS):
            part = once[i * width : (i + 1) * width]
            if part.any():
                pair = [zlib.compress(x[i * width : (i + 1) * width].tobytes(), 1) for x in (once, twice)]
                yield pa.RecordBatch.from_pydict(
                    {"segment": [i], "once": [pair[0]], "twice": [pair[1]]}, schema=schema
                )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One segment of all partitions, read as a stream."""
    once = twice = segment = None
    for batch in batches:
        for row in batch.to_pylist():
            a, b = (np.frombuffer(zlib.decompress(row[k]), dtype=np.uint8) for k in ("once", "twice"))
            if once is None:
                segment, once, twice = row["segment"], a, b
            else:
                once, twice = once | a, twice | b | (once & a)
    yield pa.RecordBatch.from_arrays(
        [pa.array([segment], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())],
        names=["segment", "twice"],
    )


def repeated_filter(docs: DataFrame, text_col: str, least_chars: int, bits: int) -> np.ndarray:
    """The merged twice filter: ``bits / 8`` bytes on the driver, whatever the input."""
    if bits % SEGMENT_BITS:
        raise ValueError(f"the size of the filters must be a multiple of {SEGMENT_BITS} bits")
    hashes = docs.select(F.array_distinct(_hashes(keys_of(F.col(text_col), least_chars), 0)).alias("hashes"))
    merged = (
        hashes.mapInArrow(_fill(bits), "segment int, once binary, twice binary")
        .groupBy("segment").applyInArrow(_merge, "segment int, twice binary")
    )
    twice, width = np.zeros(bits // 8, dtype=np.uint8), SEGMENT_BITS // 8
    for row in merged.toLocalIterator():
        twice[row.segment * width : (row.segment + 1) * width] = np.frombuffer(zlib.decompress(row.twice), dtype=np.uint8)
    return twice


def _listed(hashes: pa.Array, flags: np.ndarray) -> pa.Array:
    offsets = hashes.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(flags))


def _suspects(twice, bits: int):
    def run(hashes: pa.Array) -> pa.Array:
        values = hashes.flatten().to_numpy()
        return _listed(hashes, _has(np.frombuffer(twice.value, dtype=np.uint8), _positions(values, bits)) & (values != 0))

    return F.arrow_udf(run, "array<boolean>")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_chars: int = 10,
                   filter_bits: int = FILTER_BITS) -> DataFrame:
    """Keys held by documents with different ids: ``key, first`` (the smallest id), confirmed on whole keys."""
    twice = repeated_filter(docs, text_col, least_chars, filter_bits)
    shared = docs.sparkSession.sparkContext.broadcast(twice.tobytes())
    keyed = docs.select(F.col(id_col).alias("id"), keys_of(F.col(text_col), least_chars).alias("keys"))
    flagged = keyed.select("id", "keys", _suspects(shared, filter_bits)(_hashes(F.col("keys"), 0)).alias("flags"))
    wanted = F.array_distinct(F.filter(F.col("keys"), lambda k, i: F.get("flags", i)))
    return (
        flagged.select("id", F.explode(wanted).alias("key"))
        .groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count_if(F.col("id").isNull()).alias("without"))
        .where("first <> last or (first is not null and without > 0)").select("key", "first")
    )


def _drops(table):
    """Whether a line's key is confirmed and belongs to an earlier document. Two 64-bit hashes name a key."""

    def run(first: pa.Array, second: pa.Array, ids: pa.Array) -> pa.Array:
        one, two, owner = table.value
        a, b = first.flatten().to_numpy(), second.flatten().to_numpy()
        offsets = first.offsets.to_numpy()
        lengths = np.diff(offsets)
        known = np.repeat(np.asarray(ids.is_valid()), lengths)
        own = np.repeat(ids.fill_null(0).to_numpy(), lengths)
        if not len(one):
            return _listed(first, np.zeros(len(a), dtype=bool))
        at = np.searchsorted(one, a)
        at[at == len(one)] = 0
        hit = (one[at] == a) & (two[at] == b) & (a != 0)
        return _listed(first, hit & (~known | (owner[at] < own)))

    return F.arrow_udf(run, "array<boolean>")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_chars: int = 10,
                filter_bits: int = FILTER_BITS, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """One row per document: ``id, n_lines, n_dropped, kept`` (the remaining lines, joined). Ids are integers."""
    confirmed = durable(
        repeated_lines(docs, id_col, text_col, least_chars=least_chars, filter_bits=filter_bits)
        .withColumn("one", F.xxhash64(F.lit(0), "key")).withColumn("two", F.xxhash64(F.lit(1), "key")),
        "confirmed",
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("raw"))
    keys = keys_of(F.col("text"), least_chars)
    if confirmed.limit(max_broadcast + 1).count() <= max_broadcast:
        held = confirmed.select("one", "two", F.col("first").cast("long")).orderBy("one").toArrow()
        columns = [held.column(i).to_numpy() for i in range(3)]
        shared = docs.sparkSession.sparkContext.broadcast(tuple(columns))
        drops = _drops(shared)(_hashes(F.col("keys"), 0), _hashes(F.col("keys"), 1), F.col("id").cast("long"))
        marked = rows.withColumn("keys", keys).select("id", "text", drops.alias("drops"))
        dropped, goes = F.size(F.filter("drops", lambda d: d)), lambda i: F.get("drops", i)
    else:
        lines = rows.select("id", "raw", F.posexplode(keys).alias("line", "key")).where("key is not null")
        later = F.col("id").isNull() | (F.col("id") > F.col("first"))
        numbers = (
            lines.join(confirmed.select("key", "first"), "key").where(later).groupBy("id", "raw")
            .agg(F.collect_set("line").alias("drops")).toDF("_id", "_raw", "drops")
        )
        joined = rows.join(numbers, F.col("id").eqNullSafe(F.col("_id")) & (F.col("raw") == F.col("_raw")), "left")
        marked = joined.withColumn("drops", F.coalesce("drops", F.array().cast("array<int>")))
        dropped, goes = F.size("drops"), lambda i: F.array_contains("drops", i)
    kept = F.filter("lines", lambda line, i: ~goes(i))
    return marked.withColumn("lines", lines_of(F.col("text"))).select(
        "id", F.size("lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept"),
    )
