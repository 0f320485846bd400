"""Many phrases in one pass over a text: an automaton per task instead of a test per phrase."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGED = re.compile(r"(\\b)?((?:[^\\\[\](){}.*+?|^$]|\\[-' ])+)(\\b)?")


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M"


def stands_alone(text: str, start: int, end: int, left: bool = True, right: bool = True) -> bool:
    """Whether no letter or digit touches [start, end) on the given sides."""
    return not (left and start and _is_word(text[start - 1])) and not (right and end < len(text) and _is_word(text[end]))


class Phrases:
    """Numbered patterns: plain text, with ``\\b`` at either end where a word must end there; other
    regular expressions are tried one by one."""

    def __init__(self, patterns: list[str]):
        import ahocorasick

        plain: dict[str, list[tuple[int, bool, bool]]] = {}
        self.others: list[tuple[int, re.Pattern]] = []
        for i, p in enumerate(patterns):
            if m := _EDGED.fullmatch(p):
                plain.setdefault(m.group(2).replace("\\", ""), []).append((i, bool(m.group(1)), bool(m.group(3))))
            else:
                self.others.append((i, re.compile(p)))
        self.automaton = ahocorasick.Automaton()
        for phrase, uses in plain.items():
            self.automaton.add_word(phrase, (len(phrase), uses))
        if plain:
            self.automaton.make_automaton()
        self.empty = not plain

    def found(self, text: str) -> list[int]:
        """Numbers of the patterns that occur."""
        ids: set[int] = set()
        if not self.empty:
            for last, (size, uses) in self.automaton.iter(text):
                for i, left, right in uses:
                    if i not in ids and stands_alone(text, last + 1 - size, last + 1, left, right):
                        ids.add(i)
        ids.update(i for i, p in self.others if p.search(text))
        return sorted(ids)


def phrase_ids(text: Column, patterns: list[str]) -> Column:
    """Sorted numbers of the ``patterns`` that occur in ``text``; none for null."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        phrases = Phrases(patterns)
        for texts in batches:
            yield pd.Series([phrases.found(t) if t else [] for t in texts], dtype=object)

    return ids(text)
