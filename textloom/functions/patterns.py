"""Removal of very many literals: an automaton tells which of them a text has, so only those are applied."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Literals:
    """Literals to be removed in the order given, each everywhere in what the ones before it have left."""

    def __init__(self, literals: Sequence[str]):
        self.literals = list(literals)
        first: dict[str, int] = {}
        again: dict[int, int] = {}  # the next place of the same literal in the list
        for k in range(len(self.literals) - 1, -1, -1):
            x = self.literals[k]
            if x in first:
                again[k] = first[x]
            first[x] = k
        self.again = again
        self.longest = max(map(len, self.literals), default=0)
        self.automaton = ahocorasick.Automaton()
        for x, k in first.items():
            if x:
                self.automaton.add_word(x, k)
        self.automaton.make_automaton()

    def within(self, text: str, after: int) -> set[int]:
        """The literals in ``text``, each by its first place in the list behind ``after``."""
        out = set()
        for _, k in self.automaton.iter(text):
            while k is not None and k <= after:
                k = self.again.get(k)
            if k is not None:
                out.add(k)
        return out

    def remove(self, text: str) -> str:
        """``text`` without them. What a removal brings together may hold a later literal: it is looked for at the cuts."""
        if not text or not len(self.automaton):
            return text
        todo = list(self.within(text, -1))
        heapq.heapify(todo)
        done = -1
        while todo:
            k = heapq.heappop(todo)
            if k <= done:
                continue
            done = k
            parts = text.split(self.literals[k])
            if len(parts) > 1:
                text = "".join(parts)
                for x in self.within(self.cuts(parts, text), k):
                    heapq.heappush(todo, x)
            if (k := self.again.get(k)) is not None:
                heapq.heappush(todo, k)
        return text

    def cuts(self, parts: list[str], text: str) -> str:
        """The surroundings of the cuts, apart from each other; the text itself where they are most of it."""
        reach = self.longest - 1
        if 2 * reach * len(parts) >= len(text):
            return text
        spans: list[list[int]] = []
        at = 0
        for p in parts[:-1]:
            at += len(p)
            a, b = max(0, at - reach), at + reach
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        # what lies between two spans may seem to hold a literal that the text does not have; applying it is harmless
        return "".join(text[a:b] for a, b in spans)


def remove_literals(c: Column, literals: Sequence[str]) -> Column:
    """A column without the literals, in the order given; null stays null, empty literals do nothing."""
    cache: list[Literals] = []

    def run(column: pa.Array) -> pa.Array:
        if not cache:
            cache.append(Literals(literals))
        return pa.array([None if t is None else cache[0].remove(t) for t in column.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(c)
