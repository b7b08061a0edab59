"""Secret scan with a trigram inverted index.

Each rule has a Boolean query over trigrams that every match must contain, derived from its pattern: a run
of literal characters gives the AND of its trigrams, alternatives give an OR, and whatever has no fixed
trigram (character classes, short literals, repeats that may be empty) gives "any". The documents of one
Arrow batch are a shard of the index: their bytes, ASCII letters lowered, are turned into trigram numbers at
once, and the rows of every wanted trigram form its postings. A rule's query intersects and unites postings;
only the texts that remain are searched with the pattern. A rule whose query is "any" searches every text.

The index lives as long as its shard, so it needs no shuffle, nothing grows with the corpus, and a lost task
is simply run again.

Results, all cases included:
* a null or empty text has no spans; whole texts are searched, however long;
* spans are code points of the text, end exclusive, per rule leftmost and non-overlapping; matches that fail
  a rule's length test are dropped after matching;
* every row is reported once, repeated rows too; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _constants as sre, _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ANY = ("any",)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``group`` (0: the match) must have ``least`` characters. ASCII patterns only."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The three base kinds and their lengths.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Further kinds with public formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"\b[a-z][a-z0-9+]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,128}@[A-Za-z0-9]"),
)


def trigram_query(rule: Rule):
    """Nested ``("and", ...)``, ``("or", ...)``, trigram strings (lowered) or ``ANY``, true for every match."""

    def both(parts):
        parts = {p for p in parts if p != ANY}
        return ANY if not parts else next(iter(parts)) if len(parts) == 1 else ("and", *sorted(parts, key=repr))

    def either(parts):
        parts = set(parts)
        return ANY if ANY in parts else next(iter(parts)) if len(parts) == 1 else ("or", *sorted(parts, key=repr))

    def of_text(text: str):
        return both(text[i : i + 3] for i in range(len(text) - 2))

    def texts(items) -> list[str] | None:
        """All strings that a short fixed sequence can be, or None."""
        found = [""]
        for op, value in items:
            if op is sre.LITERAL:
                more = [chr(value).lower()] if value < 128 else None
            elif op is sre.SUBPATTERN:
                more = texts(value[3])
            elif op is sre.BRANCH:
                options = [texts(x) for x in value[1]]
                more = None if None in options else [t for x in options for t in x]
            elif op is sre.MAX_REPEAT and value[1] == 1:
                more = texts(value[2])
                more = more if more is None or value[0] else ["", *more]
            elif op is sre.IN and len(value) <= 8 and all(o is sre.LITERAL and v < 128 for o, v in value):
                more = sorted({chr(v).lower() for _, v in value})
            elif op is sre.AT:
                more = [""]
            else:
                more = None
            if more is None or len(found) * len(more) > 64:
                return None
            found = [a + b for a in found for b in more]
        return found

    def of(items):
        items, parts, start = list(items), [], 0
        while start < len(items):
            # The longest fixed sequence from here on is one OR of whole strings.
            end, known = start, None
            while end < len(items) and (more := texts(items[start : end + 1])) is not None:
                end, known = end + 1, more
            if known is not None:
                parts.append(either(of_text(t) for t in known))
                start = end
                continue
            op, value = items[start]
            if op is sre.SUBPATTERN:
                parts.append(of(value[3]))
            elif op is sre.BRANCH:
                parts.append(either(of(x) for x in value[1]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
                parts.append(of(value[2]))
            start += 1
        return both(parts)

    return of(sre_parse.parse(rule.pattern))


def _trigrams(query) -> set[str]:
    return {query} if isinstance(query, str) else {t for part in query[1:] for t in _trigrams(part)}


class TrigramIndex:
    """Postings of the wanted trigrams over one shard of texts."""

    def __init__(self, wanted: Sequence[str]):
        self.number = {t: i + 1 for i, t in enumerate(sorted(wanted))}
        if len(self.number) > 254:
            raise ValueError("more than 254 trigrams are wanted")
        # One byte for each of the 2**21 trigrams of ASCII characters.
        self.table = np.zeros(1 << 21, dtype=np.uint8)
        for text, i in self.number.items():
            a, b, c = text.encode("ascii")
            self.table[a << 14 | b << 7 | c] = i
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[ord("A") : ord("Z") + 1] += 32
        self.fold[128:] = 0

    def postings(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """Sorted row numbers for each wanted trigram, at its number."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        data = self.fold[np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)].astype(np.uint32)
        if len(data) < 3:
            return [np.array([], dtype=np.int64)] * (len(self.number) + 1)
        found = self.table[data[:-2] << 14 | data[1:-1] << 7 | data[2:]]
        at = np.flatnonzero(found)
        pairs = np.unique(found[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, side="right"))
        cuts = np.searchsorted(pairs, np.arange(1, len(self.number) + 1) * len(texts))
        return [part % len(texts) for part in np.split(pairs, cuts)]

    def rows(self, query, postings: list[np.ndarray]) -> np.ndarray:
        if isinstance(query, str):
            return postings[self.number[query]]
        parts = sorted((self.rows(part, postings) for part in query[1:]), key=len)
        result = parts[0]
        for part in parts[1:]:
            result = np.intersect1d(result, part, True) if query[0] == "and" else np.union1d(result, part)
        return result


def _scan(rules: Sequence[Rule], id_type: pa.DataType, shard_bytes: int):
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("secret", pa.string())]))
    schema = pa.schema([("id", id_type), ("spans", spans)])
    queries = [trigram_query(rule) for rule in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TrigramIndex({t for q in queries if q != ANY for t in _trigrams(q)})
        patterns = [rule.compiled() for rule in rules]
        for batch in batches:
            rows = [t or "" for t in batch.column("text").to_pylist()]
            found: list[list] = [[] for _ in rows]
            start = 0
            while start < len(rows):
                # A shard is a run of rows of bounded size; a longer text is a shard by itself.
                shard, size = [], 0
                while start + len(shard) < len(rows) and (not shard or size + len(rows[start + len(shard)]) <= shard_bytes):
                    shard.append(rows[start + len(shard)].encode())
                    size += len(shard[-1])
                postings = index.postings(shard)
                for order, (rule, query, pattern) in enumerate(zip(rules, queries, patterns, strict=True)):
                    candidates = range(len(shard)) if query == ANY else index.rows(query, postings)
                    for row in candidates:
                        for match in pattern.finditer(rows[start + row]):
                            if len(match[rule.group]) >= rule.least:
                                found[start + row].append((match.start(), order, match.end(), match[0]))
                start += len(shard)
            lists = [[{"kind": rules[o].kind, "start": s, "stop": e, "secret": x} for s, o, e, x in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lists, spans)], schema=schema)

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         rules: Sequence[Rule] = BASE_RULES + MORE_RULES, shard_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: ``id`` and ``spans``, an array of ``(kind, start, stop, secret)`` by start and rule."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType
    result = f"id {kind.simpleString()}, spans array<struct<kind: string, start: bigint, stop: bigint, secret: string>>"
    return source.mapInArrow(_scan(tuple(rules), to_arrow_type(kind), shard_bytes), result)
