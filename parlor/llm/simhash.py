"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint sums the hashes of a text's word shingles bit by bit. Two fingerprints that differ in at most k
bits agree in at least b - k of b blocks, so every choice of b - k blocks is a key that a close pair shares
for some choice. Distinct fingerprints (exact copies count once) are dealt by key, sorted inside their
partition, and compared bucket by bucket with vectorised XOR and bit counts. A bucket reports links that
connect what it found close, at most one per fingerprint, never all its pairs: what counts is the component.

The number of blocks follows the number of distinct fingerprints so that buckets of unrelated fingerprints
stay small; it changes the cost only, never a link. A bucket larger than ``tile`` (a large group of near
copies) is cut into tiles, and every pair of tiles is a bucket of its own.

Results, all cases included:
* A-Z are lowered, words are runs of other characters than ASCII white space; a text of fewer words than a
  shingle is one shingle, one without words (null, empty) has fingerprint zero, which links like any other;
* a component's id is the smallest id in it, null only if it has no other;
* repeated rows and ties are copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from parlor.llm.common import components, durable, keep_rows, text_hash

HASH_SEED = 42
#: Mean number of unrelated fingerprints in a bucket beyond which one more block is used.
BUCKET_LOAD = 2048
TILE = 8192
SCAN_ROWS = 64


def simhash(text: bytes, words: int = 4) -> int:
    """64-bit fingerprint; a bit is set if more than half of the shingle hashes have it."""
    tokens = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not tokens:
        return 0
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(words: int, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("raw", pa.int64()), ("fp0", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([simhash(t.as_py() or b"", words) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("raw"), pa.array(values)], schema=schema)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """One row per document: ``id, raw`` (hash of the text), ``fp0`` (as a signed long)."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(
        F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("raw"), F.col(text_col).cast("binary").alias("text")
    )
    kind = source.schema["id"].dataType
    return source.mapInArrow(_fingerprints(words, to_arrow_type(kind)), f"id {kind.simpleString()}, raw long, fp0 long")


def _blocks(count: int) -> list[int]:
    """Bit masks of ``count`` blocks that cover 64 bits."""
    edges = [round(64 * i / count) for i in range(count + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def key_masks(distinct: int, bits: int) -> list[int]:
    """For each choice of blocks the mask of its bits, with enough blocks for ``distinct`` fingerprints."""
    for count in range(bits + 1, 65):
        shared = count - bits
        if distinct <= BUCKET_LOAD * 2 ** (64 * shared // count) or shared == 4:
            return [sum(choice) for choice in combinations(_blocks(count), shared)]
    raise ValueError("no more blocks than bits")


def _close_links(prints: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Close row pairs that connect every group of rows connected by close pairs. Rows are fingerprints."""
    if len(prints) < 2:
        return [], []
    # Most rows of a bucket are close to no other one: a few rows at a time against all tells which are.
    alone = np.empty(len(prints), dtype=bool)
    for start in range(0, len(prints), SCAN_ROWS):
        near = np.bitwise_count(prints[start : start + SCAN_ROWS, None] ^ prints[None, :]) <= bits
        alone[start : start + SCAN_ROWS] = near.sum(axis=1) == 1
    left, a, b = np.flatnonzero(~alone), [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            near = np.flatnonzero(np.bitwise_count(prints[left] ^ prints[one]) <= bits)
            if len(near):
                found = left[near]
                left = np.delete(left, near)
                front.extend(found)
                a.extend([int(one)] * len(found))
                b.extend(found.tolist())
    return a, b


def _links(bits: int):
    def found(held: list[np.ndarray]) -> pa.RecordBatch | None:
        prints = np.concatenate(held)
        a, b = _close_links(prints.view(np.uint64), bits)
        return pa.RecordBatch.from_arrays([pa.array(prints[a]), pa.array(prints[b])], names=["a", "b"]) if a else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket may go on in the next batch."""
        open_bucket, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("mask", "bucket")], axis=1)
            prints = batch.column("fp0").to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                bucket = keys[start].tobytes()
                if bucket != open_bucket:
                    if held and (out := found(held)):
                        yield out
                    open_bucket, held = bucket, []
                held.append(prints[start:stop])
        if held and (out := found(held)):
            yield out

    return run


def links(distinct: DataFrame, bits: int = 4, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that connect all close fingerprints ``fp0`` (distinct, durable)."""
    signed = [m - (1 << 64) if m >> 63 else m for m in key_masks(distinct.count(), bits)]
    table = F.array(*[
        F.struct(F.lit(i).alias("mask"), F.col("fp0").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)
    ])
    keyed = distinct.select("fp0", F.explode(table).alias("m")).select("fp0", "m.mask", "m.key")
    # Buckets that need tiles hold at least ``tile`` rows each, so there are few of them.
    large = keyed.groupBy("mask", "key").agg(F.count("*").alias("rows")).where(F.col("rows") > tile)
    tiles = F.ceil(F.coalesce(F.col("rows"), F.lit(1)) / tile).cast("int")
    own = F.pmod(F.xxhash64("fp0", "mask"), F.col("tiles")).cast("int")
    spread = (
        keyed.join(durable(large, "large"), ["mask", "key"], "left").withColumn("tiles", tiles).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("fp0", "mask", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    # A hash names the bucket, to send little; where two buckets of a mask share it, they are compared as one.
    dealt = spread.select("mask", F.xxhash64("key", "i", "j").alias("bucket"), "fp0")
    dealt = dealt.repartition("mask", "bucket").sortWithinPartitions("mask", "bucket")
    return dealt.mapInArrow(_links(bits), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 4, bits: int = 4,
                tile: int = TILE) -> DataFrame:
    """One row per document: ``id, raw, fp0, root`` (a fingerprint of the group), ``component`` (its smallest id)."""
    hashed = durable(fingerprints(docs, id_col, text_col, words), "prints")
    distinct = durable(hashed.groupBy("fp0").agg(F.min("id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp0"), bits, tile), "a", "b").withColumnRenamed("node", "fp0")
    member = durable(distinct.join(roots, "fp0", "left").select("fp0", "first", F.coalesce("root", "fp0").alias("root")), "member")
    smallest = durable(member.groupBy("root").agg(F.min("first").alias("component")), "smallest")
    named = durable(member.join(smallest, "root").select("fp0", "root", "component"), "named")
    return hashed.join(named, "fp0", "left").select("id", "raw", "fp0", "root", "component")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                  groups: Callable[..., DataFrame] = near_groups, **options) -> DataFrame:
    """The documents, all columns, one of each component of ``groups``: the smallest id.

    Of several rows with that id (or of a component without ids) the one with the smallest text hash stays.
    """
    judged = durable(groups(docs, id_col, text_col, **options), "near")
    first = judged.where(F.col("id").eqNullSafe(F.col("component"))).groupBy("root").agg(
        F.min("raw").alias("raw_kept")
    )
    judged = judged.join(durable(first, "first"), "root", "left")
    stays = F.col("id").eqNullSafe(F.col("component")) & (F.col("raw") == F.col("raw_kept"))
    drop = durable(judged.where(~stays).select("id", "raw"), "dropped")
    repeated = judged.where(stays).groupBy("id", "raw").agg(F.count("*").alias("rows")).where("rows > 1")
    return keep_rows(docs, id_col, text_col, drop, durable(repeated, "repeated"))
