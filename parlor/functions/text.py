"""Text column functions: cleaning, trimming, counting, keys and id formatting."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The characters that count as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Where a transcript breaks into lines.
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"

# The same characters as a pattern; "(?U)" gives the Unicode whitespace.
WHITESPACE_CLASS = r"(?U:[\s\x1C-\x1F])"

# Unicode-aware, case-insensitive matching in which "." stops at a line feed only.
IGNORE_CASE = "(?iuUd)"


def any_case(pattern: str) -> str:
    return IGNORE_CASE + pattern


def strip(text: Column) -> Column:
    """Remove every kind of whitespace from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITESPACE_CLASS + "+", " "))


def mention_pattern(handles: Sequence[str]) -> str:
    """Routing mentions: the brand handles and anonymised numeric handles."""
    names = "|".join([*map(re.escape, handles), "[0-9]+"])
    return any_case(rf"@(?:{names})\b")


def clean_text(text: Column, handles: Sequence[str] = ()) -> Column:
    """Drop routing mentions, collapse whitespace, strip; null becomes the empty string."""
    no_mentions = F.regexp_replace(F.coalesce(text, F.lit("")), mention_pattern(handles), "")
    return collapse_whitespace(no_mentions)


def matches(text: Column, pattern: str) -> Column:
    """Unicode, any-case search; null gives false."""
    return F.coalesce(text.rlike(any_case(pattern)), F.lit(False))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """True if any term is a substring (no word boundaries)."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | text.contains(term)
    return F.coalesce(hit, F.lit(False))


def word_count(text: Column) -> Column:
    """Whitespace-separated words; 0 for blank or null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)[^\s\x1C-\x1F]+")), F.lit(0))


def text_key(text: Column) -> Column:
    """Case-folded, stripped form used to compare texts."""
    return F.lower(strip(text))


def digest(text: Column) -> Column:
    """Fixed-width stand-in for a long join key: shuffles 64 characters, not the text."""
    return F.sha2(text, 256)


def length_between(text: Column, low: int, high: int) -> Column:
    return F.length(strip(text)).between(low, high)


def prefixed_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def numbered_id(prefix: str, number: Column) -> Column:
    """``prefix-007``: at least three digits, never truncated."""
    return F.format_string(f"{prefix}-%03d", number.cast("long"))


def ratio_text(part: Column, total: Column) -> Column:
    return F.format_string("%d/%d", part.cast("long"), total.cast("long"))


def strip_quotes(text: Column) -> Column:
    """Strip whitespace, then wrapping double quotes."""
    return F.btrim(strip(text), F.lit('"'))


def class_answer(text: Column) -> Column:
    """Normal form of a class name given as free text."""
    return F.translate(F.lower(strip(text)), "\"'", "")


def response_key(model: Column, system_text: Column, prompt: Column) -> Column:
    """SHA-256 key of a prompt sent to a model."""
    return F.sha2(F.concat(model, F.lit(":"), system_text, F.lit("\n\n"), prompt), 256)
