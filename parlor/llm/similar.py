"""Groups of texts with a given similarity of their shingle sets, proposed by long SimHash fingerprints.

:mod:`parlor.llm.simhash` links fingerprints that differ in a few bits of 64. At a similarity of 0.8 some 15 % of the bits
differ, which no choice of whole blocks of 64 bits covers at a useful size. So a fingerprint here is as long as it
takes: it is split into blocks, wide enough that unrelated texts rarely share one, and so many that a pair at the bound
shares at least one with a chance of ``1 - MISS``. Blocks are the join keys; pairs of a bucket are verified by their Hamming
distance over the first ``COMPARED`` words, with ``SLACK`` standard deviations above what the bound gives.

A bucket reports the lightest tree that connects what it found close, and each link in the first of their blocks
only: a few links a text, however large a group is. Links are then tested on the shingle sets themselves, the closest ones
of every group first, and those only that still connect two groups. Where a tree's links fail the test, the texts of that tree
meet once more: bucket by bucket, texts of different groups whose bitmaps (see :mod:`parlor.llm.jaccard_join`) leave the
similarity possible are tested, so a failed link never hides another one.

Results, all cases included:
* A-Z are lowered, words are runs of other characters than ASCII white space; a text of fewer words than a
  shingle is one shingle; texts with the same words are one node; those without words (null, empty) are copies of each other;
* every group is connected by pairs with the similarity; a pair that shares no block, or whose distance is beyond the
  slack, is missed (``MISS`` and some 0.3 % of the pairs at the bound itself, far fewer above it);
* a component's id is the smallest id in it, null only if it has no other;
* repeated rows and ties are copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from parlor.llm.common import MAX_BROADCAST_ROWS, components, durable, text_hash
from parlor.llm.jaccard_join import MIXERS, Shingler, _bucket_pairs, bitmap, links_if

#: Mean number of unrelated texts in a bucket; the chance that a pair at the bound shares no block.
LOAD, MISS = 1024, 0.01
#: Words of the fingerprint that are compared, and how far beyond the expected distance a pair may lie.
COMPARED, SLACK = 2, 2.75
TILE = 8192
SCAN_ROWS = 64
#: Turns that test one link of every group; then all that still connect two groups.
TURNS = 2


@dataclass(frozen=True)
class Blocks:
    """``width`` bits a block, ``count`` blocks, ``words`` of fingerprint, ``allowed`` bits of difference in the compared ones."""

    width: int
    count: int
    words: int
    allowed: int

    @staticmethod
    def of(texts: int, least: int) -> Blocks:
        # Two sets as directions: the cosine of their angle is overlap over size, its share of pi the share of unequal bits.
        differ = acos(2 * least / (100 + least)) / pi
        width = max(6, ceil(log2(max(1, texts / LOAD))))
        count = ceil(log(MISS) / log(1 - (1 - differ) ** width))
        bits = 64 * COMPARED
        allowed = int(bits * differ + SLACK * sqrt(bits * differ * (1 - differ)))
        return Blocks(width, count, max(COMPARED, ceil(width * count / 64)), allowed)


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """``64 * words`` bits, one byte each: set if more than half of the (mixed) hashes have them."""
    found, n = [], len(hashes)
    for turn in range(words):
        x = hashes + np.uint64((turn + 1) * MIXERS[0] % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIXERS[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIXERS[2])
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Sums of up to 255 rows fit a byte, which is much faster than wider sums.
        sums = sum(bits[i : i + 255].sum(axis=0, dtype=np.uint8).astype(np.int64) for i in range(0, n, 255))
        found.append((2 * sums > n).astype(np.uint8))
    return np.concatenate(found)


def block_keys(bits: np.ndarray, blocks: Blocks) -> np.ndarray:
    """One key per block: its number and its bits. Rows are fingerprints."""
    used = bits[:, : blocks.width * blocks.count].reshape(len(bits), blocks.count, blocks.width).astype(np.int64)
    values = used @ (np.int64(1) << np.arange(blocks.width, dtype=np.int64))
    return values + (np.arange(blocks.count, dtype=np.int64) << 48)


def _prints(words: int, blocks: Blocks, id_type: pa.DataType):
    schema = pa.schema([
        ("id", id_type), ("raw", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), *[(f"fp{i}", pa.int64()) for i in range(COMPARED)],
        ("keys", pa.list_(pa.int64())), ("bits", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t.as_py() or b"" for t in batch.column("text")]
            nodes, sizes, maps, bits = [], [], [], np.zeros((len(texts), 64 * blocks.words), dtype=np.uint8)
            for i, text in enumerate(texts):
                hashes = shingles(text)
                nodes.append(xxhash.xxh3_64_intdigest(b" ".join(text.lower().split())) - (1 << 63))
                sizes.append(len(hashes))
                maps.append(bitmap(hashes))
                if len(hashes):
                    bits[i] = fingerprint(hashes, blocks.words)
            prints = np.packbits(bits[:, : 64 * COMPARED], axis=1, bitorder="little").view("<i8")
            keys = block_keys(bits, blocks)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * blocks.count, pa.int32()), pa.array(keys.ravel()))
            columns = [pa.array(np.ascontiguousarray(prints[:, i])) for i in range(COMPARED)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("raw"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *columns, listed, pa.array(maps, pa.binary())],
                schema=schema,
            )

    return run


def _distances(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(rows ^ one).sum(axis=-1, dtype=np.int64)


def lightest_trees(prints: np.ndarray, allowed: int) -> tuple[list[int], list[int], list[int]]:
    """Row pairs and distances: minimum spanning trees over all pairs of rows that differ in ``allowed`` bits or fewer."""
    alone = np.empty(len(prints), dtype=bool)
    for start in range(0, len(prints), SCAN_ROWS):
        some = prints[start : start + SCAN_ROWS]
        near = sum(np.bitwise_count(some[:, None, i] ^ prints[None, :, i]).astype(np.uint16) for i in range(prints.shape[1])) <= allowed
        alone[start : start + SCAN_ROWS] = near.sum(axis=1) == 1
    left, a, b, d = np.flatnonzero(~alone), [], [], []
    if not len(left):
        return a, b, d
    one, left = left[0], left[1:]
    best, source = np.full(len(left), allowed + 1), np.full(len(left), one)
    while len(left):
        distance = _distances(prints[left], prints[one])
        closer = distance < best
        best[closer], source[closer] = distance[closer], one
        at = int(np.argmin(best))
        one = left[at]
        if best[at] <= allowed:
            a.append(int(source[at]))
            b.append(int(one))
            d.append(int(best[at]))
        left, best, source = (np.delete(x, at) for x in (left, best, source))
    return a, b, d


def _first_shared(x: np.ndarray, blocks: Blocks) -> np.ndarray:
    """The first block without a bit of difference; blocks beyond the compared words count as not shared. Rows are differences."""
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little")
    count = min(blocks.count, bits.shape[1] // blocks.width)
    free = ~bits[:, : count * blocks.width].reshape(len(x), count, blocks.width).any(axis=2)
    return np.where(free.any(axis=1), free.argmax(axis=1), blocks.count)


def _links(blocks: Blocks):
    names = ["node", *[f"fp{i}" for i in range(COMPARED)]]

    def found(block: int, held: list[np.ndarray]) -> pa.RecordBatch | None:
        rows = np.concatenate(held)
        prints = np.ascontiguousarray(rows[:, 1:]).view(np.uint64)
        a, b, d = lightest_trees(prints, blocks.allowed)
        if not a:
            return None
        new = _first_shared(prints[a] ^ prints[b], blocks) >= block
        ends = np.sort(np.stack([rows[a, 0], rows[b, 0]], axis=1), axis=1)[new]
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.array(np.array(d, dtype=np.int64)[new])], names=["a", "b", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket may go on in the next batch."""
        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            rows = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                bucket = tuple(keys[start])
                if bucket != last:
                    if held and (out := found(int(last[0]) >> 48, held)):
                        yield out
                    last, held = bucket, []
                held.append(rows[start:stop])
        if held and (out := found(int(last[0]) >> 48, held)):
            yield out

    return run


def _apart(blocks: Blocks, least: int):
    """Pairs of texts of different groups that sizes and bitmaps leave possible, each in the first of their blocks."""
    prints = [f"fp{i}" for i in range(COMPARED)]

    def found(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(held)
        node, root, n, own = (rows.column(c).to_numpy() for c in ("node", "root", "n", "own"))
        if root.min() == root.max():
            return None
        own = np.zeros(len(rows), dtype=np.int64) if rows.column("i")[0] == rows.column("j")[0] else own
        a, b = _bucket_pairs(node, root, n, own, rows.column("bits").to_pylist(), least, False)
        if not len(a):
            return None
        order = np.argsort(node)
        words = np.stack([rows.column(c).to_numpy() for c in prints], axis=1).view(np.uint64)
        x, y = (words[order[np.searchsorted(node[order], ends)]] for ends in (a, b))
        new = _first_shared(x ^ y, blocks) >= block
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[new]), pa.array(np.maximum(a, b)[new])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("token", "i", "j")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                bucket = tuple(keys[start])
                if bucket != last:
                    if held and (out := found(int(last[0]) >> 48, held)):
                        yield out
                    last, held = bucket, []
                held.append(batch.slice(start, stop - start))
        if held and (out := found(int(last[0]) >> 48, held)):
            yield out

    return run


def dealt(keyed: DataFrame, key: str, tile: int) -> DataFrame:
    """Rows by bucket, sorted, with ``i, j`` (the tiles that meet) and ``own``; every two rows of a bucket meet in one of its pairs of tiles."""
    large = durable(keyed.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > tile), "large")
    tiles = F.ceil(F.coalesce(F.col("rows"), F.lit(1)) / tile).cast("long")
    spread = (
        keyed.join(large, key, "left").withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("node", key), F.col("tiles")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("rows", "tiles", "other")
    )
    return spread.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _similar(words: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, own = Shingler(words), None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            kept = []
            for i, (a, left, right) in enumerate(zip(*[batch.column(c) for c in ("a", "left", "right")], strict=True)):
                if a.as_py() != last:
                    last, own = a.as_py(), shingles(left.as_py())
                other = shingles(right.as_py())
                common = len(np.intersect1d(own, other, assume_unique=True))
                if links_if(common, len(own), len(other), least):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return run


def _texts_of(docs: DataFrame, text_col: str, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text`` of the nodes in ``wanted``."""
    need = durable(nodes.join(wanted, "node", "left_semi").select("node", "raw"), "need")
    few = need.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    source = docs.select(text_hash(F.col(text_col)).alias("raw"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    # A copied text comes once for each copy; the aggregate folds them before its shuffle.
    return durable(source.join(F.broadcast(need) if few else need, "raw").groupBy("node").agg(F.any_value("text").alias("text")), "texts")


def _tested(pairs: DataFrame, texts: DataFrame, words: int, least: int) -> DataFrame:
    """Those of ``pairs (a, b)`` whose texts have the similarity."""
    left, right = texts.toDF("a", "left"), texts.toDF("b", "right")
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return durable(both.mapInArrow(_similar(words, least), "a long, b long"), "similar")


def _between(pairs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs whose ends no links connect, with ``ra, rb``; and the components of the links."""
    roots = components(links, "a", "b")
    ends = pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    named = ends.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})
    return durable(named.where("ra <> rb"), "between"), roots


def _roots(docs: DataFrame, text_col: str, nodes: DataFrame, proposed: DataFrame, words: int, least: int, blocks: Blocks, tile: int) -> DataFrame:
    """``node, root`` of the groups that tested links connect."""
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = _texts_of(docs, text_col, nodes, ends(proposed))
    links, left = proposed.limit(0).select("a", "b"), proposed
    for turn in range(TURNS + 1):
        left, roots = _between(left.select("a", "b", "d"), links)
        if left.isEmpty():
            return roots
        if turn < TURNS:
            best = F.min(F.struct("d", "a", "b")).alias("best")
            chosen = left.withColumn("r", F.explode(F.array("ra", "rb"))).groupBy("r").agg(best).select("best.a", "best.b").distinct()
        else:
            chosen = left.select("a", "b")
        chosen = durable(chosen, "chosen")
        links = durable(links.union(_tested(chosen, texts, words, least)), "links")
        left = left.join(chosen, ["a", "b"], "left_anti")
    # Trees with links that failed: their texts meet once more, those of different groups only.
    roots = components(links, "a", "b")
    tree = components(proposed, "a", "b").withColumnRenamed("root", "tree")
    member = tree.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = member.groupBy("tree").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("tree")
    apart = durable(member.join(several, "tree", "left_semi").select("node", "root"), "apart")
    prints = [f"fp{i}" for i in range(COMPARED)]
    keyed = nodes.join(apart, "node").select("node", "root", "n", "bits", *prints, F.explode("keys").alias("token"))
    met = dealt(durable(keyed, "keyed"), "token", tile).select("token", "i", "j", "own", "node", "root", "n", "bits", *prints)
    rest = durable(met.mapInArrow(_apart(blocks, least), "a long, b long").distinct(), "rest")
    if rest.isEmpty():
        return roots
    return components(links.union(_tested(rest, texts, words, least)), "a", "b")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, least: int = 80, tile: int = TILE) -> DataFrame:
    """One row per document: ``id, raw, root`` (a node of the group), ``component`` (its smallest id); groups of ``least`` hundredths."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("raw"), F.col(text_col).cast("binary").alias("text"))
    blocks, kind = Blocks.of(docs.count(), least), source.schema["id"].dataType
    names = [f"fp{i}" for i in range(COMPARED)]
    schema = f"id {kind.simpleString()}, raw long, node long, n long, {', '.join(f'{n} long' for n in names)}, keys array<long>, bits binary"
    hashed = durable(source.mapInArrow(_prints(words, blocks, to_arrow_type(kind)), schema), "prints")
    # Rows with the same words have the same fingerprint.
    alike = [F.any_value(c).alias(c) for c in ("n", *names, "keys", "bits")]
    nodes = durable(hashed.groupBy("node").agg(F.min("id").alias("first"), F.min("raw").alias("raw"), *alike), "nodes")
    keyed = nodes.where("n > 0").select("node", *names, F.explode("keys").alias("key"))
    links = dealt(keyed, "key", tile).select("key", "i", "j", "node", *names).mapInArrow(_links(blocks), "a long, b long, d long")
    roots = _roots(docs, text_col, nodes, durable(links.groupBy("a", "b").agg(F.min("d").alias("d")), "proposed"), words, least, blocks, tile)
    member = durable(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "member")
    smallest = member.groupBy("root").agg(F.min("first").alias("component"))
    named = durable(member.join(smallest, "root").select("node", "root", "component"), "named")
    return hashed.select("id", "raw", "node").join(named, "node", "left").select("id", "raw", "root", "component")
