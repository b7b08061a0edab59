"""Alignment of two tokenizers' tokens on one text by pointer jumping.

Both token rows cover the same bytes. Every token points to the farthest-right token that overlaps it: one of
tokenizer A to the first B token that ends where it does or later, one of B to the first A token that ends later,
or to itself where an A token ends with it. Doubling the successors (``to = to[to]``) until nothing moves leaves
every token at the last token of its component, which names its group: the shortest stretch of bytes that both
tokenizers cut at both ends. All texts of a slice are jumped together, since no component crosses a text's end.

Every A and B token of a group are linked. How many documents hold a pair of ids linked is counted over the
corpus; the pairs lie in a durable table with one row per document, so texts are encoded once. Up to ``most``
of the commonest pairs are broadcast to look counts up where the rows lie; documents' rarer pairs, if there are any,
are joined by a shuffle, so that a bounded table serves any number of pairs and no pair is left out.

Tokenizer A is a byte-level BPE file (ids in the order of the merges), read by ``tiktoken``; where that refuses
a text, ``tokenizers`` encodes it. B is a SentencePiece file. Both travel to the tasks with the code.

Results, all cases included:
* a null or empty text, and one that the tokens of A or B don't reproduce byte for byte behind one space, has
  no tokens: zeros and an empty digest; strings of special tokens inside a text are ordinary text;
* every row counts as a document of its own, repeated rows too; null ids stay null;
* pairs that tie for the highest count of their A id are all best;
* an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from parlor.llm.common import durable

#: Fixed value: how byte-level BPE of this family splits a text before its merges.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Text that is aligned at once; a longer text is aligned alone.
SLICE_BYTES = 1 << 20
#: Pairs of ids that may be broadcast with their counts: 17 bytes each, 17 MB in all.
MAX_PAIRS = 1_000_000
#: Distinct pairs that a task counts before it passes them on.
COUNT_PAIRS = 1 << 20


@dataclass(frozen=True)
class Vocabularies:
    """The two files, as bytes, so that tasks need no path."""

    byte_bpe: bytes
    pieces: bytes

    @staticmethod
    def read(byte_bpe_path: str, pieces_path: str) -> Vocabularies:
        with open(byte_bpe_path, "rb") as a, open(pieces_path, "rb") as b:
            return Vocabularies(a.read(), b.read())


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level files: itself if it prints, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoders:
    """Both tokenizers in one worker, with the bytes of every id."""

    def __init__(self, files: Vocabularies) -> None:
        import sentencepiece
        import tiktoken

        self.file = files.byte_bpe
        letters, vocabulary = byte_letters(), json.loads(files.byte_bpe)["model"]["vocab"]
        # An entry that is no run of byte letters is a special token, which ordinary text never gives.
        entries = {bytes(letters[c] for c in entry): i for entry, i in vocabulary.items() if all(c in letters for c in entry)}
        special = {t["id"] for t in json.loads(files.byte_bpe).get("added_tokens", [])}
        ranks = {entry: i for entry, i in entries.items() if i not in special}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in ranks.items():
            self.a_bytes[i] = entry
        self.a = tiktoken.Encoding("a", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        ]
        self.a_size, self.b_size = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))
        # Two entries an id: within its group's tokens, and as the last of them.
        self.a_text, self.b_text = (
            np.array([f"{i}{sign}" for i in range(len(table)) for sign in signs], dtype=object)
            for table, signs in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))
        )

    def _slow(self):
        from tokenizers import Tokenizer

        slow = Tokenizer.from_str(self.file.decode())
        slow.encode_special_tokens = True
        return slow

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """The ids of both, or nothing if either doesn't reproduce the text."""
        spaced = f" {text}"
        try:
            a = self.a.encode_ordinary(spaced)
        except BaseException as e:  # the pattern's step limit is raised as a panic, which is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            a = self._slow().encode(spaced, add_special_tokens=False).ids
        b = self.b.encode(text)
        data = spaced.encode()
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return None
        return a, b


def jump(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers, ascending from 0, of A and B tokens that end at these bytes (strictly ascending, same last)."""
    n = len(a_ends)
    later = np.searchsorted(a_ends, b_ends)
    own = n + np.arange(len(b_ends))
    to = np.concatenate([n + np.searchsorted(b_ends, a_ends), np.where(a_ends[later] == b_ends, own, later)])
    while not np.array_equal(farther := to[to], to):
        to = farther
    # A terminal token points to itself; groups are numbered by their terminals from left to right.
    terminals = own[to[n:] == own]
    return np.searchsorted(terminals, to[:n]), np.searchsorted(terminals, to[n:])


def _distinct(groups: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each group with the times they occur: ``group, id, times``, ascending."""
    values, times = np.unique(groups * size + ids, return_counts=True)
    return values // size, values % size, times


def linked_pairs(ga: np.ndarray, a: np.ndarray, gb: np.ndarray, b: np.ndarray, a_ids: int, b_ids: int) -> tuple[np.ndarray, ...]:
    """``group, pair, times`` of the linked ids, one row per group and distinct pair; a pair is ``a * b_ids + b``."""
    ga, a, na = _distinct(ga, a, a_ids)
    gb, b, nb = _distinct(gb, b, b_ids)
    first, stop = np.searchsorted(gb, ga), np.searchsorted(gb, ga, "right")
    each = stop - first
    left = np.repeat(np.arange(len(a)), each)
    right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + first[left]
    return ga[left], a[left] * b_ids + b[right], na[left] * nb[right]


def _listed(tables: Encoders, ga: np.ndarray, a: np.ndarray, gb: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ids of all groups as text, one piece a token with the sign behind it: A tokens of a group, then its B tokens."""
    ca, cb = np.bincount(ga), np.bincount(gb)
    a_stops, b_stops = np.cumsum(ca), np.cumsum(cb)
    pieces = np.empty(len(a) + len(b), dtype=object)
    a_last, b_last = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    a_last[a_stops - 1] = b_last[b_stops - 1] = 1
    pieces[np.arange(len(a)) + (b_stops - cb)[ga]] = tables.a_text[2 * a + a_last]
    pieces[np.arange(len(b)) + a_stops[gb]] = tables.b_text[2 * b + b_last]
    return pieces


def align_texts(tables: Encoders, texts: list[str | None]) -> list[tuple]:
    """For each text ``n_a, n_b, n_groups, n_links, digest, pairs, times``."""
    results: list[tuple] = [(0, 0, 0, 0, "", [], [])] * len(texts)
    coded = [(i, ids) for i, t in enumerate(texts) if t and (ids := tables.encode(t)) and ids[0]]
    if not coded:
        return results
    a, b = (np.concatenate([np.array(ids[k], dtype=np.int64) for _, ids in coded]) for k in (0, 1))
    ga, gb = jump(np.cumsum(tables.a_size[a]), np.cumsum(tables.b_size[b]))
    groups = int(gb[-1]) + 1
    ca, cb = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
    # A text's groups end where its tokens do.
    ends = np.searchsorted(np.cumsum(ca), np.cumsum([len(ids[0]) for _, ids in coded])) + 1
    group, pair, times = linked_pairs(ga, a, gb, b, len(tables.a_bytes), len(tables.b_bytes))
    span = len(tables.a_bytes) * len(tables.b_bytes)
    held, inverse = np.unique(np.searchsorted(ends, group, "right") * span + pair, return_inverse=True)
    total = np.bincount(inverse, weights=times, minlength=len(held)).astype(np.int64)
    cuts = np.searchsorted(held, np.arange(len(coded) + 1) * span)
    held %= span
    pieces, g, i = _listed(tables, ga, a, gb, b), 0, 0
    for k, (row, (own_a, own_b)) in enumerate(coded):
        stop, x, y, j = ends[k], cuts[k], cuts[k + 1], i + len(own_a) + len(own_b)
        listed = "".join(pieces[i:j].tolist())[:-1]
        results[row] = (
            len(own_a), len(own_b), int(stop - g), int((ca[g:stop] * cb[g:stop]).sum()),
            hashlib.sha256(listed.encode()).hexdigest(), held[x:y], total[x:y],
        )
        g, i = stop, j
    return results


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, value in enumerate(column):
        size += value.as_buffer().size if value.is_valid else 0
        if size >= SLICE_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(column):
        yield start, len(column)


def _align(files: Vocabularies, id_type: pa.DataType):
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    schema = pa.schema([
        ("row", pa.int64()), ("id", id_type), *[(n, pa.int64()) for n in numbers], ("groups_sha256", pa.string()),
        ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, row = Encoders(files), TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = batch.column("text")
            for start, stop in _slices(texts):
                found = align_texts(tables, texts.slice(start, stop - start).to_pylist())
                columns = [pa.array(values, kind.type) for values, kind in zip(zip(*found, strict=True), list(schema)[2:], strict=True)]
                rows = pa.array(range(row, row + len(found)), pa.int64())
                row += len(found)
                yield pa.RecordBatch.from_arrays([rows, batch.column("id").slice(start, stop - start), *columns], schema=schema)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of the task hold each pair, passed on whenever many pairs have come together."""
    kept, size = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        pairs, n = (np.concatenate(x) for x in zip(*kept, strict=True))
        pairs, inverse = np.unique(pairs, return_inverse=True)
        return pairs, np.bincount(inverse, weights=n, minlength=len(pairs)).astype(np.int64)

    for batch in batches:
        kept.append(np.unique(batch.column("pairs").flatten().to_numpy(), return_counts=True))
        size += len(kept[-1][0])
        if size >= COUNT_PAIRS:
            kept = [merged()]
            size = len(kept[0][0])
        if size >= COUNT_PAIRS:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept[0]], names=["pair", "n"])
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["pair", "n"])


def pair_counts(aligned: DataFrame, b_ids: int) -> DataFrame:
    """``pair, n, best``: documents that hold the pair linked, and whether that is the highest count of its A id. Durable."""
    counted = aligned.select("pairs").mapInArrow(_count, "pair long, n long")
    counts = durable(counted.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a = F.floor(F.col("pair") / b_ids)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return durable(counts.withColumn("a", a).join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def _least_common(counts: DataFrame, most: int) -> int:
    """The smallest power of two so that no more than ``most`` pairs have that count, 1 if that holds for all."""
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("n")).collect()
    cut, held = 62, 0
    for k, n in sorted(sizes, reverse=True):
        held += n
        if held > most:
            break
        cut = k
    return 1 if held <= most else 1 << cut


def _looked_up(table, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the pairs that the table holds; the others are listed."""
        pairs, n, best = table.value
        for batch in batches:
            lists = batch.column("pairs")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            own, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            at = np.searchsorted(pairs, own)
            known = np.zeros(len(own), dtype=bool)
            inside = at < len(pairs)
            known[inside] = pairs[at[inside]] == own[inside]
            at, rare = at[known], ~known
            sums = [np.zeros(batch.num_rows, dtype=np.int64) for _ in range(2)]
            np.add.at(sums[0], row[known], times[known] * best[at])
            np.add.at(sums[1], row[known], times[known] * n[at])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[rare], minlength=batch.num_rows))]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[rare], pa.int64())) for x in (own, times)]
            kept = batch.drop_columns(["pairs", "times"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *[pa.array(x) for x in sums], *lists],
                names=[*kept.schema.names, "n_best", "count_sum", "pairs", "times"],
            )

    return run


def align(docs: DataFrame, files: Vocabularies, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_PAIRS) -> DataFrame:
    """One row per document: ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` (see the module's text)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType
    head = f"row long, id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    lists = "pairs array<long>, times array<long>"
    aligned = durable(source.mapInArrow(_align(files, to_arrow_type(kind)), f"{head}, {lists}"), "aligned")
    counts = pair_counts(aligned, len(Encoders(files).b_bytes))
    least = _least_common(counts, most)
    known = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    table = spark.sparkContext.broadcast(tuple(known.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))
    summed = aligned.mapInArrow(_looked_up(table, to_arrow_type(kind)), f"{head}, n_best long, count_sum long, {lists}")
    columns = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least == 1:
        return summed.select(columns)
    summed = durable(summed, "summed")
    rare = summed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    found = rare.join(counts.where(F.col("n") < least), F.col("pairs") == F.col("pair"))
    times = F.col("times")
    rest = found.groupBy("row").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).alias("b"), F.sum(times * F.col("n")).alias("s"))
    added = {"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0))}
    return summed.join(rest, "row", "left").withColumns(added).select(columns)
