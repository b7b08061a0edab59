"""Benchmark decontamination by pigeonhole edit matching.

Texts are reduced to lower-case words joined by one space. A test item may differ by up to k characters
(insertions, deletions, substitutions), k being ``error_rate`` of its length, but never so many that its
k + 1 pieces would fall below ``least_piece`` characters. Any occurrence within k errors leaves one of k + 1
pieces untouched, so an automaton over all pieces finds every place worth looking at, and Myers' bit-parallel
distance over a window around it decides.

The pieces of the items travel to the tasks, the documents stay where they are. Items are dealt into groups of
about ``group_chars`` characters, one scan of the documents each, so that an automaton keeps its size however
large the benchmark is.

Results, all cases included:
* a null or empty document matches nothing, a null item or one without words is never found;
* an item of fewer than ``least_chars`` characters is found where its words stand without any error, each such place;
* overlapping places of one item count once, with the least distance and, of equal ones, the first end;
* repeated items and repeated documents are all reported; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parlor.llm.common import durable, keep_rows, text_hash

WORD = re.compile(r"[^\W_]+")


def normalise(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def budget(length: int, error_rate: float, least_piece: int) -> int:
    return max(0, min(int(length * error_rate), length // least_piece - 1))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def character_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


def myers(masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern to any substring of the text, and the first end of such a substring."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best, end = full, 0, length, length, 0
    get = masks.get
    for i, c in enumerate(text):
        equal = get(c, 0)
        zero = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | (full & ~(zero | plus))
        down = plus & zero
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        # No carry into the first row: an occurrence may begin anywhere.
        up, down = (up << 1) & full, (down << 1) & full
        vertical = equal | minus
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, i + 1
            if not best:
                break
    return best, end


@dataclass
class Item:
    ids: list
    text: str
    errors: int
    masks: dict[str, int]
    reverse: dict[str, int]


class Matcher:
    """Automaton over the pieces of a group of items."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float, least_piece: int, least_chars: int):
        ids: dict[str, list] = defaultdict(list)
        for number, text in items:
            ids[normalise(text or "")].append(number)
        ids.pop("", None)
        self.short = ahocorasick.Automaton()
        for text, found in ids.items():
            if len(text) < least_chars:
                self.short.add_word(f" {text} ", (text, found))
        self.short.make_automaton()
        self.items = []
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for text, found in ids.items():
            if len(text) >= least_chars:
                errors = budget(len(text), error_rate, least_piece)
                for offset, piece in pieces(text, errors):
                    places[piece].append((len(self.items), offset))
                self.items.append(Item(found, text, errors, character_masks(text), character_masks(text[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def _windows(self, text: str) -> Iterator[tuple[Item, int, int]]:
        """Places where an item may occur: runs of diagonals no further apart than its errors."""
        starts: dict[int, set[int]] = defaultdict(set)
        if len(self.automaton):
            for last, (length, where) in self.automaton.iter(text):
                for number, offset in where:
                    starts[number].add(last + 1 - length - offset)
        for number, found in starts.items():
            item = self.items[number]
            ordered = sorted(found)
            first = previous = ordered[0]
            for start in [*ordered[1:], None]:
                if start is None or start - previous > 2 * item.errors + 1:
                    yield item, max(0, first - item.errors), min(len(text), previous + len(item.text) + item.errors)
                    first = start
                previous = start

    def find(self, raw: str) -> list[tuple[object, int, int, int, int]]:
        """``(item id, distance, errors allowed, start, stop)`` in code points of the original text."""
        text = normalise(raw)
        found, words = [], None
        if len(self.short):
            for last, (item, ids) in self.short.iter(f" {text} "):
                words = words or _word_places(raw)
                stop = last - 2  # the item's last character in the text, which has no space before it
                a, b = _original(words, stop - len(item) + 1), _original(words, stop)
                found += [(number, 0, 0, a[0], b[1]) for number in ids]
        for item, start, stop in self._windows(text):
            window, length = text[start:stop], len(item.text)
            distance, end = myers(item.masks, length, window)
            if distance > item.errors:
                continue
            before = window[max(0, end - length - distance) : end][::-1]
            _, back = myers(item.reverse, length, before)
            if words is None:
                words = _word_places(raw)
            a, b = _original(words, start + end - back), _original(words, start + end - 1)
            found += [(number, distance, item.errors, a[0], b[1]) for number in item.ids]
        return found


def _word_places(raw: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Per word its start in the normalised text and its span in the original one."""
    lowered = raw.lower()
    if len(lowered) != len(raw):  # a few letters grow when lowered; give each character the place it came from
        origin = [i for i, c in enumerate(raw) for _ in c.lower()] + [len(raw)]
    else:
        origin = range(len(raw) + 1)
    starts, spans, at = [], [], 0
    for match in WORD.finditer(lowered):
        starts.append(at)
        spans.append((origin[match.start()], origin[match.end() - 1] + 1))
        at += match.end() - match.start() + 1
    return starts, spans


def _original(words: tuple[list[int], list[tuple[int, int]]], place: int) -> tuple[int, int]:
    from bisect import bisect_right

    return words[1][max(0, bisect_right(words[0], place) - 1)]


def _matches(shared, options: tuple, id_type: pa.DataType, item_type: pa.DataType):
    schema = pa.schema([
        ("id", id_type), ("raw", pa.int64()), ("item", item_type), ("distance", pa.int32()), ("allowed", pa.int32()),
        ("start", pa.int64()), ("stop", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, *options)
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("text")):
                for match in matcher.find(text.as_py() or ""):
                    rows.append(i)
                    found.append(match)
            if rows:
                at = pa.array(rows)
                columns = [batch.column("id").take(at), batch.column("raw").take(at)]
                columns += [pa.array(list(c), kind) for c, kind in zip(zip(*found, strict=True), schema.types[2:], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    error_rate: float = 0.1,
    least_piece: int = 12,
    least_chars: int = 30,
    group_chars: int = 4_000_000,
) -> DataFrame:
    """One row per occurrence of an item in a document: ``id, raw, item, distance, allowed, start, stop``."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    source = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("raw"), F.col(text_col).alias("text"))
    id_type, item_type = source.schema["id"].dataType, items.schema["item"].dataType
    groups = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // group_chars))
    schema = (
        f"id {id_type.simpleString()}, raw long, item {item_type.simpleString()}, distance int, allowed int, start long, stop long"
    )
    found = None
    for group in range(groups):
        dealt = items.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == group)
        shared = spark.sparkContext.broadcast([(row.item, row.text) for row in dealt.collect()])
        run = _matches(shared, (error_rate, least_piece, least_chars), to_arrow_type(id_type), to_arrow_type(item_type))
        part = source.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, without those that hold an item; see :func:`matches`."""
    found = durable(matches(docs, benchmark, id_col, text_col, **options).select("id", "raw").distinct(), "leaks")
    return keep_rows(docs, id_col, text_col, found, found.limit(0))
