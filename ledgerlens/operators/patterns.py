"""Many patterns against many names in one pass: an automaton of all patterns in each task."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that an automaton is made of at most; names that a task remembers; patterns that one column expression tries in turn.
MOST_PATTERNS, REMEMBERED, FEW_PATTERNS = 200_000, 100_000, 32


def like(pattern: str) -> re.Pattern:
    """LIKE '%' + pattern + '%': % stands for any characters, _ for one, a backslash for the next character itself."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        else:
            out.append({"%": ".*", "_": "."}.get(c) or re.escape(c))
        at += 1
    return re.compile("".join(out), re.DOTALL)


class Matcher:
    """The numbers of the patterns that a name contains."""

    def __init__(self, patterns: list[str]):
        self.always = [i for i, p in enumerate(patterns) if not p]
        self.wild = [(i, like(p)) for i, p in enumerate(patterns) if re.search(r"[%_\\]", p)]
        self.automaton = ahocorasick.Automaton()
        special = {i for i, _ in self.wild} | set(self.always)
        for i, p in enumerate(patterns):
            if i not in special:
                self.automaton.add_word(p, i)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.known: dict[str, list[int]] = {}

    def __call__(self, name: str | None) -> list[int]:
        if name is None:
            return []
        if name not in self.known:
            found = {*self.always, *(i for i, p in self.wild if p.search(name))}
            if len(self.automaton):
                found.update(i for _, i in self.automaton.iter(name))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[name] = sorted(found)
        return self.known[name]


def pattern_numbers(patterns: list[str]) -> Callable:
    """A column function: names to the sorted numbers of the (distinct) patterns they contain; none for null."""

    @F.pandas_udf("array<int>")
    def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(patterns)  # once a task
        for names in batches:
            yield pd.Series([matcher(None if name is None or name != name else name) for name in names], index=names.index)

    return numbers


def contained_numbers(patterns: list[str]) -> Callable[[Column], Column]:
    """What pattern_numbers() gives, for a few patterns without backslashes, as an expression of their LIKEs."""

    def numbers(name: Column) -> Column:
        return F.array_compact(F.array(F.lit(None).cast("int"), *[F.when(name.like(f"%{p}%"), F.lit(i)) for i, p in enumerate(patterns)]))

    return numbers
