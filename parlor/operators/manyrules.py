"""Rule tables with thousands of entries: one pass over a text finds what a chain of conditions would test one by one.

All literals of a table are put into one automaton, which travels to the tasks; a text is read once, whatever the number of
entries. Keywords are decided by that. A pattern has a literal that every match must contain (if one can be read
off it); only patterns whose literal occurs, and those without one, are then matched, by the same regular expressions
of Spark as :mod:`parlor.functions.rules` uses, so results are those of its forms.

A table beyond ``GROUP_CHARS`` characters is dealt into several automata, one pass over the texts each. Null texts contain nothing; empty
keywords are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from parlor.functions.rules import Rule
from parlor.functions.text import any_case

#: Characters of literals in one automaton, some 100 bytes each.
GROUP_CHARS = 2_000_000
#: Fewer characters than this are no literal worth looking for.
LEAST_LITERAL = 3

#: Letters by simple case folding, as patterns that ignore case compare them: ``ſ`` is ``s``, the Kelvin sign ``k``.
FOLD = {
    c: folded for c in range(0x10000) if not 0xD800 <= c < 0xE000 and len(folded := chr(c).upper().lower()) == 1 and folded != chr(c)
} | {0x130: "i"}


def folded(text: str) -> str:
    return text.translate(FOLD)


def mandatory_literal(pattern: str) -> str:
    """The longest run of characters that every match of a pattern contains; empty if none can be read off it."""
    runs, run, i, n = [""], "", 0, len(pattern)

    def ended() -> str:
        runs.append(run)
        return ""

    while i < n:
        c = pattern[i]
        if c == "|":
            return ""
        if c == "(":  # what a group holds may be an alternative or a look-around
            run, depth = ended(), 1
            while i + 1 < n and depth:
                i += 1
                if pattern[i] == "\\":
                    i += 1
                elif pattern[i] == "[":
                    i = _class_end(pattern, i)
                else:
                    depth += (pattern[i] == "(") - (pattern[i] == ")")
        elif c == "[":
            run, i = ended(), _class_end(pattern, i)
        elif c == "\\":
            i += 1
            if i < n and not pattern[i].isalnum():
                run += pattern[i]
            else:
                run = ended()
                if i < n and pattern[i] in "Q":
                    return ""  # quoted stretches are left to the matcher
                if i < n and pattern[i] in "pPxuNkgc0" and i + 1 < n and pattern[i + 1] == "{":
                    i = pattern.index("}", i)
                elif i < n and pattern[i] in "pPxuc0123456789":
                    return max(runs, key=len)  # what follows may belong to the escape
        elif c in "?*{":
            run = run[:-1]
            run = ended()
            if c == "{":
                i = pattern.find("}", i) if "}" in pattern[i:] else n
        elif c in "+.^$":
            run = ended()
        else:
            run += c
        i += 1
    runs.append(run)
    best = max(runs, key=len)
    return best if len(best) >= LEAST_LITERAL else ""


def _class_end(pattern: str, i: int) -> int:
    depth = 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] == "[":
            depth += 1
        elif pattern[i] == "]":
            depth -= 1
            if not depth:
                return i
        i += 1
    return i


def _groups(entries: Mapping[str, list[int]]) -> Iterator[dict[str, list[int]]]:
    group: dict[str, list[int]] = {}
    size = 0
    for literal in sorted(entries):
        if group and size + len(literal) > GROUP_CHARS:
            yield group
            group, size = {}, 0
        group[literal] = entries[literal]
        size += len(literal)
    if group:
        yield group


def _found(texts: Column, entries: Mapping[str, list[int]], df: DataFrame) -> Column:
    """The sorted numbers of the entries whose literal occurs in ``texts``."""
    parts = []
    for group in _groups(entries):
        shared = df.sparkSession.sparkContext.broadcast(list(group.items()))
        parts.append(_search(shared)(texts))
    if not parts:
        return F.array().cast("array<int>")
    return F.array_sort(F.flatten(F.array(*parts))) if len(parts) > 1 else parts[0]


def _search(shared):
    @F.pandas_udf("array<int>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for literal, numbers in shared.value:
            automaton.add_word(literal, numbers)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([sorted({i for _, numbers in automaton.iter(t) for i in numbers}) if t else [] for t in texts], dtype=object)

    return search.asNondeterministic()


def keyword_classes(df: DataFrame, lowered_col: str, keywords: Mapping[str, Sequence[str]], output_col: str = "classes") -> DataFrame:
    """Add every class with a keyword in the (lowered) text, in table order: the form for many keywords of
    :func:`parlor.functions.rules.keyword_classes`."""
    names, entries = list(keywords), {}
    for i, name in enumerate(names):
        for term in keywords[name]:
            if term:
                numbers = entries.setdefault(term.lower(), [])
                if i not in numbers:
                    numbers.append(i)
    table = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    found = df.withColumn("_found", _found(F.col(lowered_col), entries, df))
    return found.withColumn(output_col, F.transform("_found", lambda i: F.get(table, i))).drop("_found")


def keywords_found(df: DataFrame, lowered_col: str, keywords: DataFrame, keyword_col: str, output_col: str = "keywords", most: int = 1_000_000) -> DataFrame:
    """Add the distinct keywords of a table that occur in the (lowered) text, ascending. The table has at most ``most`` rows."""
    rows = keywords.select(F.lower(keyword_col).alias("k")).where("k <> ''").distinct().orderBy("k").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} keywords")
    words = [r["k"] for r in rows]
    shared = df.sparkSession.sparkContext.broadcast(words)
    found = df.withColumn("_found", _found(F.col(lowered_col), {w: [i] for i, w in enumerate(words)}, df))

    @F.pandas_udf("array<string>")
    def named(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in numbers:
            yield pd.Series([[shared.value[i] for i in row] for row in batch], dtype=object)

    return found.withColumn(output_col, F.array_sort(named.asNondeterministic()("_found"))).drop("_found")


def first_match(df: DataFrame, text_col: str, rules: Sequence[Rule], output_col: str = "rule") -> DataFrame:
    """Add ``struct(code, description)`` of the first rule that matches, else null: the form for many rules of
    :func:`parlor.functions.rules.first_match`."""
    entries: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        literal = folded(mandatory_literal(rule.pattern))
        if literal:
            entries.setdefault(literal, []).append(i)
        else:
            always.append(i)

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else folded(t))

    kind = "array<struct<pattern:string,code:string,description:string>>"
    rows = [F.struct(F.lit(any_case(r.pattern)).alias("pattern"), F.lit(r.code).alias("code"), F.lit(r.description).alias("description")) for r in rules]
    table = F.array(*rows) if rows else F.array().cast(kind)
    marked = df.withColumn("_folded", fold.asNondeterministic()(text_col))
    found = marked.withColumn("_found", _found(F.col("_folded"), entries, df)).drop("_folded")
    asked = F.array_sort(F.concat("_found", F.array(*[F.lit(i) for i in always]).cast("array<int>")))
    # Patterns are tried in order until one matches; most rows have few to try.
    hits = F.filter(asked, lambda i: F.rlike(F.col(text_col), F.get(table, i)["pattern"]))
    first = F.get(table, F.get(hits, F.lit(0)))
    return found.withColumn(output_col, F.when(first.isNotNull(), F.struct(first["code"].alias("code"), first["description"].alias("description")))).drop("_found")
