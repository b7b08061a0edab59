"""N-gram Jaccard join by vertical partitioning.

Documents are sets of word shingles; equal sets are one node. A sketch of counters over all documents gives a global order of
the shingles, rare ones first: the power of two of a counter, then the hash. Cuts of equal weight divide this order into
fragments, so that a set falls into one segment per fragment. A pair's overlap is counted fragment by fragment,
each by a join of its own segments, and summed per pair; what it sums to decides the link.

Pairs come from prefixes: two sets that link share one of the first ``n - ceil(least * n) + 1`` shingles of both, in
any global order. Nodes under such a shingle form a bucket. No bucket is paired out. First, for ``TURNS`` turns, the groups of
a bucket (at first single nodes) send one node each to meet one node of another group; every node keeps its most promising pair, and
what links merges groups. Then buckets that still hold several groups compare nodes of different groups, at first to count
the most promising pair of every two groups, then all that are left. Bitmaps (parities of hashed shingles, whose differing
bits never exceed the symmetric difference) rule pairs out before they are counted. So a link is only ever passed over inside a group
that links have already connected, and a large group of near copies costs a few pairs a node. Buckets beyond ``tile``
nodes are cut into tiles, and shingles that the sketch shows to be frequent are dealt to several tasks.

Results, all cases included:
* A-Z are lowered, words are runs of other characters than ASCII white space; a text with fewer words than a
  shingle has one, of all its words; one without words (null, empty) has none and links with nothing, not even its like;
* shingles are told apart by 64 bits, sets by 128 bits of hash;
* a component's id is the smallest id in it, null only if it has no other; repeated rows and ties are copies;
* an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from parlor.llm.common import MAX_BROADCAST_ROWS, components, durable, text_hash

FRAGMENTS = 8
#: Sets shingled before their counters are added, and counters in a segment of the sketch.
CHUNK_SHINGLES, SEGMENT = 1 << 18, 1 << 16
#: Counters a document and the largest sketch: one byte a counter is broadcast, 64 MB at most.
COUNTERS_A_ROW, MAX_COUNTERS = 16, 1 << 26
#: Shingles of at least two to this power are dealt to several tasks.
SPREAD_LEVEL = 14
TILE = 4096
#: Turns that pair one node of each group of a bucket with one of another.
TURNS = 1
#: Buckets of up to so many rows are paired by a join.
SMALL = 32
MIXERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


#: Bytes that are hashed at once; a longer word is hashed whole.
HASH_BYTES = 1 << 18
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


class Shingler:
    """Sets of shingle hashes. A word's hash is a polynomial in its bytes, taken from running sums over the whole text."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.bytes = np.random.default_rng(MIXERS[0]).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, size: int) -> None:
        for name, base in (("powers", MIXERS[1]), ("inverses", pow(MIXERS[1], -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            setattr(self, name, np.cumprod(steps))

    def _words(self, part: np.ndarray) -> np.ndarray:
        """Hashes of the words of some bytes that no word crosses."""
        inside = np.concatenate([[False], ~WHITE[part], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edges[::2], edges[1::2]
        if len(part) > len(self.powers):
            self._grow(max(HASH_BYTES, 2 * len(part)))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(self.bytes[part] * self.powers[: len(part)], out=sums[1:])
        return (sums[stops] - sums[starts]) * self.inverses[starts] + (stops - starts).astype(np.uint64)

    def hashed_words(self, text: bytes) -> np.ndarray:
        """One hash for each word, in order."""
        small = text.lower()
        data = np.frombuffer(small, dtype=np.uint8)
        if len(data) <= HASH_BYTES:
            return self._words(data)
        parts, start = [], 0
        while start < len(data):
            stop = min(len(data), start + HASH_BYTES)
            while stop < len(data) and not WHITE[data[stop]]:  # to the end of the word
                ahead = np.flatnonzero(WHITE[data[stop : stop + HASH_BYTES]])
                stop = stop + int(ahead[0]) if len(ahead) else min(len(data), stop + HASH_BYTES)
            parts.append(self._words(data[start:stop]))
            start = stop
        return np.concatenate(parts)

    def __call__(self, text: bytes) -> np.ndarray:
        """Distinct hashes, ascending."""
        return self.shingles(self.hashed_words(text))

    def shingles(self, each: np.ndarray) -> np.ndarray:
        if not len(each):
            return each
        size = min(self.words, len(each))
        total = np.full(len(each) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            x = (total ^ each[i : i + len(total)]) * np.uint64(MIXERS[0])
            total = (x ^ (x >> np.uint64(29))) * np.uint64(MIXERS[1])
        total = (total ^ (total >> np.uint64(32))) * np.uint64(MIXERS[2])
        total ^= total >> np.uint64(31)
        total.sort()
        return total[np.concatenate([[True], total[1:] != total[:-1]])]


def _set_names(hashes: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), dtype="<i8").tolist())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, bytes]]:
    for batch in batches:
        for i, value in enumerate(batch.column("text")):
            yield i, batch, value.as_py() or b""


# The sketch


def _sketch(words: int, counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts, held, size = Shingler(words), np.zeros(counters, dtype=np.uint32), [], 0
        shift = np.uint64(64 - counters.bit_length() + 1)
        for _, _, text in _texts(batches):
            held.append(shingles(text))
            size += len(held[-1])
            if size >= CHUNK_SHINGLES:
                np.add.at(counts, (np.concatenate(held) >> shift).astype(np.int64), np.uint32(1))
                held, size = [], 0
        if held:
            np.add.at(counts, (np.concatenate(held) >> shift).astype(np.int64), np.uint32(1))
        width = min(SEGMENT, counters)
        for i in range(counters // width):
            part = counts[i * width : (i + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_pydict({"segment": [i], "counts": [zlib.compress(part.tobytes(), 1)]})

    return run


def _merged(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of all tasks, sorted, read as a stream: the power of two of each counter, and the weight of each power."""
        segment, total = None, None

        def done() -> pa.RecordBatch:
            levels = np.frompyfunc(int.bit_length, 1, 1)(total).astype(np.uint8)
            weights = np.bincount(levels, weights=total, minlength=65).astype(np.int64)
            return pa.RecordBatch.from_pydict({"segment": [segment], "levels": [zlib.compress(levels.tobytes(), 1)], "weights": [weights.tolist()]})

        for batch in batches:
            for row in batch.to_pylist():
                if row["segment"] != segment:
                    if segment is not None:
                        yield done()
                    segment, total = row["segment"], np.zeros(width, dtype=np.int64)
                total += np.frombuffer(zlib.decompress(row["counts"]), dtype=np.uint32)
        if segment is not None:
            yield done()

    return run


def order_sketch(texts: DataFrame, words: int, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """The level of each counter, and the weight of each level, over all documents."""
    width = min(SEGMENT, counters)
    sent = texts.mapInArrow(_sketch(words, counters), "segment long, counts binary").repartition("segment").sortWithinPartitions("segment")
    levels, weights = np.zeros(counters, dtype=np.uint8), np.zeros(65, dtype=np.int64)
    for row in sent.mapInArrow(_merged(width), "segment long, levels binary, weights array<long>").toLocalIterator():
        levels[row.segment * width : (row.segment + 1) * width] = np.frombuffer(zlib.decompress(row.levels), dtype=np.uint8)
        weights += np.array(row.weights)
    return levels, weights


class Order:
    """The global order of the shingles: the level, then the hash, as one number."""

    def __init__(self, levels: np.ndarray, weights: np.ndarray, fragments: int) -> None:
        self.levels, self.shift = levels, np.uint64(64 - len(levels).bit_length() + 1)
        # Hashes of a level lie evenly, so its weight is cut in proportion.
        ends = np.cumsum(weights)
        cuts = []
        for i in range(1, fragments):
            want = ends[-1] * i / fragments
            level = int(np.searchsorted(ends, want))
            inside = (want - (ends[level] - weights[level])) / max(1, weights[level])
            cuts.append((level << 56) + int(min(1.0, max(0.0, inside)) * ((1 << 56) - 1)))
        self.cuts = np.array(cuts, dtype=np.uint64)

    def level(self, hashes: np.ndarray) -> np.ndarray:
        return self.levels[(hashes >> self.shift).astype(np.int64)]

    def place(self, hashes: np.ndarray) -> np.ndarray:
        return (self.level(hashes).astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))


# Nodes, prefixes and bitmaps


def bitmap(hashes: np.ndarray) -> bytes:
    """Parities of the shingles at each of at least as many bits as shingles, a power of two from 64 on."""
    bits = max(64, 1 << max(0, len(hashes) - 1).bit_length())
    odd = (np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) at a smaller width: parities of the halves."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def most_common(n_a, n_b, differing):
    """The largest overlap that sizes and differing bits allow."""
    return np.minimum(np.minimum(n_a, n_b), (n_a + n_b - differing) // 2)


def links_if(common, n_a, n_b, least: int):
    """Whether this overlap gives a similarity of ``least`` hundredths."""
    return 100 * common >= least * (n_a + n_b - common)


def _prefixes(words: int, least: int, shared, fragments: int, id_type: pa.DataType):
    schema = pa.schema([
        ("row", pa.int64()), ("id", id_type), ("raw", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()),
        ("bits", pa.binary()), ("prefix", pa.list_(pa.int64())), ("spread", pa.list_(pa.int32())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, order, row = Shingler(words), Order(*shared.value, fragments), TaskContext.get().partitionId() << 36
        for batch in batches:
            found = []
            for text in batch.column("text"):
                hashes = shingles(text.as_py() or b"")
                n = len(hashes)
                first = hashes[np.argsort(order.place(hashes), kind="stable")[: n - -(-least * n // 100) + 1 if n else 0]]
                spread = np.left_shift(1, np.maximum(0, order.level(first).astype(np.int64) - SPREAD_LEVEL)).astype(np.int32)
                found.append((*_set_names(hashes), n, bitmap(hashes), first.view(np.int64), spread))
            rows = pa.array(range(row, row + len(found)), pa.int64())
            row += len(found)
            columns = [pa.array(values, f.type) for values, f in zip(zip(*found, strict=True), list(schema)[3:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows, batch.column("id"), batch.column("raw"), *columns], schema=schema)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by shingle, of shingles that more than one row has or that are dealt to several tasks."""
    last = None  # the last row and whether it was passed on
    for batch in batches:
        tokens, spread = batch.column("token").to_numpy(), batch.column("spread").to_numpy()
        if not len(tokens):
            continue
        same = tokens[1:] == tokens[:-1]
        carried = last is not None and last[0].column("token")[0].as_py() == tokens[0]
        keep = (spread > 1) | np.concatenate([[carried], same])
        open_end = keep[-1]
        keep[:-1] |= same
        if carried and not last[1]:
            yield last[0]
        yield batch.filter(pa.array(keep))
        last = (batch.slice(len(tokens) - 1, 1), bool(open_end))


# Overlaps


def _segments(words: int, shared, fragments: int):
    schema = pa.schema([("node", pa.int64()), ("fragment", pa.int32()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, order, done = Shingler(words), Order(*shared.value, fragments), set()
        for i, batch, text in _texts(batches):
            node = batch.column("node")[i].as_py()
            if node in done:
                continue
            hashes = shingles(text)
            if _set_names(hashes) != (batch.column("h1")[i].as_py(), batch.column("h2")[i].as_py()):
                continue  # another text with the same hash of its own
            done.add(node)
            place = order.place(hashes)
            fragment = np.searchsorted(order.cuts, place, "right")
            rows = [(node, f, hashes[fragment == f].view(np.int64)) for f in np.unique(fragment).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


class Join:
    """The nodes of one table and what its turns share."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, shared, words: int, least: int, fragments: int) -> None:
        self.texts, self.nodes, self.shared, self.words, self.least, self.fragments = texts, nodes, shared, words, least, fragments

    def segments(self, wanted: DataFrame) -> DataFrame:
        """``node, fragment, tokens`` of the nodes in ``wanted``, from their texts."""
        need = durable(self.nodes.join(wanted, "node", "left_semi").select("node", "raw", "h1", "h2"), "need")
        few = need.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
        source = self.texts.join(F.broadcast(need) if few else need, "raw").select("node", "h1", "h2", "text")
        cut = source.mapInArrow(_segments(self.words, self.shared, self.fragments), "node long, fragment int, tokens array<long>")
        # A copied text comes from several tasks.
        return durable(cut.groupBy("node", "fragment").agg(F.any_value("tokens").alias("tokens")), "segments")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The ``(a, b)`` of the durable ``pairs (a, b, na, nb)`` that link: overlaps counted by fragment and summed."""
        segments = self.segments(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
        left, right = segments.toDF("a", "fragment", "left"), segments.toDF("b", "fragment", "right")
        counted = pairs.join(left, "a").join(right, ["b", "fragment"]).select(
            "a", "b", "na", "nb", F.size(F.array_intersect("left", "right")).alias("common")
        )
        summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
        return durable(summed.where(links_if(F.col("common"), F.col("na"), F.col("nb"), self.least)).select("a", "b"), "linked")


def _promising(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that their bitmaps leave possible, with the largest overlap left."""
        for batch in batches:
            kept, most = [], []
            for i, (a, b, na, nb) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("bits_a", "bits_b", "na", "nb")], strict=True)):
                x, y = (np.frombuffer(m, dtype="<u8")[None, :] for m in (a, b))
                width = min(x.shape[1], y.shape[1])
                differing = int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())
                common = int(most_common(na, nb, differing))
                if links_if(common, na, nb, least):
                    kept.append(i)
                    most.append(common)
            rows = batch.select(["a", "b", "na", "nb"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(most, pa.int64())], names=["a", "b", "na", "nb", "most"])

    return run


def _bucket_pairs(node: np.ndarray, root: np.ndarray, n: np.ndarray, tile: np.ndarray, maps: list[bytes], least: int, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes with different roots (of different tiles, if it has two) that sizes and bitmaps leave possible."""
    widths = np.array([len(m) // 8 for m in maps])
    groups, sizes = np.unique(root, return_counts=True)
    largest = groups[np.argmax(sizes)]
    two, a, b, scores = tile.min() != tile.max(), [], [], []
    tables = {w: np.stack([np.frombuffer(maps[i], dtype="<u8") for i in np.flatnonzero(widths == w)]) for w in np.unique(widths).tolist()}
    within = np.zeros(len(node), dtype=np.int64)
    for w in tables:
        within[widths == w] = np.arange(len(tables[w]))
    rank = np.argsort(np.argsort(node))
    for i in np.flatnonzero(root != largest):
        own = tables[widths[i]][within[i]][None, :]
        # Two nodes outside the largest group meet once.
        fits = (root != root[i]) & ((root == largest) | (rank > rank[i]))
        fits &= links_if(np.minimum(n, n[i]), n, n[i], least)
        if two:
            fits &= tile != tile[i]
        for w, table in tables.items():
            found = np.flatnonzero(fits & (widths == w))
            if not len(found):
                continue
            width = min(w, own.shape[1])
            differing = np.bitwise_count(folded(table[within[found]], width) ^ folded(own, width)).sum(axis=1, dtype=np.int64)
            most = most_common(n[found], n[i], differing)
            keep = links_if(most, n[found], n[i], least)
            found, most = found[keep], most[keep]
            a.extend([i] * len(found))
            b.extend(found)
            scores.extend(most / (n[found] + n[i]))
    a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    if best and len(a):
        ends = np.sort(np.stack([root[a], root[b]]), axis=0)
        order = np.lexsort((-np.array(scores), ends[1], ends[0]))
        first = np.concatenate([[True], (ends[:, order[1:]] != ends[:, order[:-1]]).any(axis=0)])
        a, b = a[order[first]], b[order[first]]
    return node[a], node[b]


def _compared(least: int, best: bool = False):
    """Pairs of each bucket; with ``best`` the most promising one of every two groups."""
    names = ["token", "i", "j", "own", "node", "root", "n", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets, sorted; a bucket may go on in the next batch."""
        held, last = [], None

        def found() -> pa.RecordBatch | None:
            rows = pa.Table.from_batches(held)
            numbers = [rows.column(c).to_numpy() for c in ("node", "root", "n", "own")]
            if rows.column("i")[0] == rows.column("j")[0]:
                numbers[3] = np.zeros(len(rows), dtype=np.int64)
            if numbers[1].min() == numbers[1].max():
                return None
            a, b = _bucket_pairs(*numbers, rows.column("bits").to_pylist(), least, best)
            if not len(a):
                return None
            low, high = np.minimum(a, b), np.maximum(a, b)
            size = dict(zip(numbers[0].tolist(), numbers[2].tolist(), strict=True))
            n = [pa.array([size[x] for x in ends.tolist()], pa.int64()) for ends in (low, high)]
            return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), *n], names=["a", "b", "na", "nb"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in names[:3]], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                key = tuple(keys[start])
                if held and key != last:
                    if out := found():
                        yield out
                    held = []
                last = key
                held.append(batch.slice(start, stop - start))
        if held and (out := found()):
            yield out

    return run


class Groups:
    """What the links found so far connect, and the pairs that were counted."""

    def __init__(self, join: Join, buckets: DataFrame) -> None:
        spark = buckets.sparkSession
        self.join, self.buckets = join, buckets
        self.roots = durable(spark.createDataFrame([], "node long, root long"), "roots")
        self.counted = durable(spark.createDataFrame([], "a long, b long"), "counted")

    def mixed(self) -> DataFrame:
        """The rows of buckets with several groups, with their ``root``; smaller from turn to turn."""
        rooted = self.buckets.drop("root").join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        ends = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"))
        # Shingles of many rows are folded in the map tasks, and Spark splits the hot ones of the join.
        several = ends.where("low <> high").select("token", "rows")
        self.buckets = durable(rooted.drop("rows").join(several, "token"), "mixed")
        return self.buckets

    def count(self, pairs: DataFrame) -> None:
        """Count the overlaps of ``pairs (a, b, na, nb)`` and merge the groups that the links connect."""
        new = durable(pairs.join(self.counted, ["a", "b"], "left_anti"), "new")
        if new.isEmpty():
            return
        self.counted = self.counted.union(new.select("a", "b"))
        links = self.join.linked(new)
        a, b = self.roots.toDF("a", "ra"), self.roots.toDF("b", "rb")
        between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        merged = durable(components(between, "a", "b"), "merged").toDF("root", "to")
        moved = self.roots.join(merged, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        fresh = merged.toDF("node", "root").join(self.roots, "node", "left_anti")
        self.roots = durable(moved.union(fresh), "roots")


def _sized(pairs: DataFrame, groups: Groups) -> DataFrame:
    """Pairs ``(a, b, na, nb)`` that their sizes and bitmaps leave possible, with ``most``."""
    least, maps = groups.join.least, groups.join.nodes.select("node", "bits")
    pairs = pairs.where(links_if(F.least("na", "nb"), F.col("na"), F.col("nb"), least)).distinct()
    pairs = pairs.join(maps.toDF("a", "bits_a"), "a").join(maps.toDF("b", "bits_b"), "b")
    return pairs.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_promising(least), "a long, b long, na long, nb long, most long")


def _met(groups: Groups, turn: int) -> DataFrame:
    """Pairs of one node of each group of a bucket with one node of a group that all of the bucket meet; each node's most promising one."""
    order = F.struct(F.xxhash64(F.lit(turn), "node"), "node", "n")
    each = durable(groups.buckets.groupBy("token", "root").agg(F.min(order).alias("one")).select("token", "root", "one.node", "one.n"), "each")
    lead = each.groupBy("token").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "root"), "root", "node", "n")).alias("lead"))
    met = each.join(lead, "token").where("root <> lead.root")
    swap = F.col("node") > F.col("lead.node")
    pairs = met.select(
        F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"),
        F.when(swap, F.col("lead.n")).otherwise(F.col("n")).alias("na"), F.when(swap, F.col("n")).otherwise(F.col("lead.n")).alias("nb"),
    )
    likely = _sized(pairs, groups)
    score = F.col("most") / (F.col("na") + F.col("nb"))
    best = F.max(F.struct(score.alias("score"), F.xxhash64("a", "b").alias("h"), "a", "b", "na", "nb")).alias("best")
    both = likely.withColumn("node", F.explode(F.array("a", "b")))
    return both.groupBy("node").agg(best).select("best.a", "best.b", "best.na", "best.nb").distinct()


def _left_small(groups: Groups) -> DataFrame:
    """Promising pairs of nodes of different groups in buckets of a few rows."""
    small = groups.buckets.where(F.col("rows") <= SMALL).select("token", "node", "root", "n")
    both = small.toDF("token", "a", "ra", "na").join(small.toDF("token", "b", "rb", "nb"), "token").where("a < b and ra <> rb")
    return _sized(both.select("a", "b", "na", "nb"), groups).drop("most")


def _left_large(groups: Groups, tile: int, best: bool) -> DataFrame:
    """The same in the other buckets, compared bucket by bucket."""
    wide = groups.buckets.where(F.col("rows") > SMALL)
    tiles = F.ceil(F.col("rows") / tile).cast("long")
    dealt = (
        wide.join(groups.join.nodes.select("node", "bits"), "node").withColumn("tiles", tiles)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("long"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        .select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "n", "bits")
    )
    dealt = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return dealt.mapInArrow(_compared(groups.join.least, best), "a long, b long, na long, nb long").distinct()


def _connected(join: Join, buckets: DataFrame, tile: int) -> DataFrame:
    """``node, root`` of all linked nodes; ``buckets`` are the rows ``token, node, n`` of shared shingles, durable."""
    groups = Groups(join, buckets)
    for turn in range(TURNS):
        groups.mixed()
        groups.count(_met(groups, turn))
    if not groups.mixed().where(F.col("rows") > SMALL).isEmpty():
        groups.count(_left_large(groups, tile, best=True))
        groups.mixed()
    groups.count(_left_small(groups).union(_left_large(groups, tile, best=False)).distinct())
    return groups.roots


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, least: int = 80,
                   fragments: int = FRAGMENTS, tile: int = TILE) -> DataFrame:
    """One row per document: ``id, n_shingles, component`` (the smallest id reachable by links of ``least`` hundredths)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("raw"), F.col(text_col).cast("binary").alias("text"))
    wanted = max(1, docs.count()) * COUNTERS_A_ROW
    counters = min(MAX_COUNTERS, max(SEGMENT, 1 << (wanted - 1).bit_length()))
    shared = spark.sparkContext.broadcast(order_sketch(texts.select("text"), words, counters))
    kind = texts.schema["id"].dataType
    schema = f"row long, id {kind.simpleString()}, raw long, h1 long, h2 long, n long, bits binary, prefix array<long>, spread array<int>"
    rows = durable(texts.mapInArrow(_prefixes(words, least, shared, fragments, to_arrow_type(kind)), schema), "rows")
    # A node is the number of one of its rows.
    one = F.min(F.struct("row", "raw", "n")).alias("one")
    sets = rows.where("n > 0").groupBy("h1", "h2").agg(one, F.min("id").alias("first"))
    sets = durable(sets.select(F.col("one.row").alias("node"), "h1", "h2", "one.raw", "one.n", "first"), "sets")
    own = rows.select(F.col("row").alias("node"), "bits", "prefix", "spread")
    nodes = durable(sets.join(own, "node"), "nodes")
    listed = F.explode(F.arrays_zip("prefix", "spread")).alias("x")
    keyed = nodes.select("node", "n", listed).select(F.col("x.prefix").alias("token"), "node", "n", F.col("x.spread").alias("spread"))
    salt = F.pmod(F.xxhash64("node"), F.col("spread")).cast("int")
    dealt = keyed.withColumn("salt", salt).repartition("token", "salt").sortWithinPartitions("token", "salt")
    buckets = durable(dealt.select("token", "node", "n", "spread").mapInArrow(_shared, "token long, node long, n long, spread int").drop("spread"), "buckets")
    join = Join(texts.select("raw", "text"), nodes.select("node", "raw", "h1", "h2", "n", "bits"), shared, words, least, fragments)
    roots = _connected(join, buckets, tile)
    member = durable(sets.join(roots, "node", "left").select("h1", "h2", "first", F.coalesce("root", "node").alias("root")), "member")
    smallest = member.groupBy("root").agg(F.min("first").alias("component"))
    named = durable(member.join(smallest, "root").select("h1", "h2", "component"), "named")
    alone = F.col("n") == 0
    return rows.select("id", "h1", "h2", "n").join(named, ["h1", "h2"], "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component")
    )
