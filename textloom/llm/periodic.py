"""Periodic runs of words: found by block matching, and collapsed to their first period.

A run of period q and at least three periods repeats itself at distance q over so many words
that one whole block of 2^j words, aligned to its size, lies in the repeated part. For each
size the aligned blocks of a document go into one Aho-Corasick automaton over the numbers of
their parts, and the document is searched once; where a block occurs again at a distance that fits its
size, the match is extended word by word both ways. A block within a run of a smaller period
is not tried again, so runs of one word cost no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm._columns import words
from textloom.llm._text import U64, mix, ranges, slices

#: A run has at least LEAST words and PERIODS periods.
LEAST, PERIODS = 24, 3
#: The smallest block; it stands for all periods below twice its size, larger ones for size to 2 * size - 1.
#: A stretch that repeats at distance q has max(LEAST - q, 2q) words, so 15 or more for this block.
BLOCK = 8

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def may_have_runs(w: np.ndarray) -> bool:
    """Whether any BLOCK words occur twice, as they do in every run."""
    n = len(w) - BLOCK + 1
    if n <= 0 or len(w) < LEAST:
        return False
    h = np.zeros(n, U64)
    x = w.astype(U64)
    for k in range(BLOCK):
        h = mix(h + x[k : k + n])
    return len(np.unique(h)) < n


def occurrences(names: np.ndarray, width: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block of each of ``places``, block and start of each place where one of them occurs).

    names: for each place the number of the ``width`` words from there. A block is BLOCK such
    numbers, ``width`` places apart, so a key has BLOCK integers whatever the size of the block,
    and the automaton never follows a long chain of suffixes.
    """
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    at = []
    for key in map(tuple, names[places[:, None] + width * np.arange(BLOCK)].tolist()):
        number = automaton.get(key, -1)
        if number < 0:
            number = len(automaton)
            automaton.add_word(key, number)
        at.append(number)
    automaton.make_automaton()
    # places that are ``width`` apart follow each other; what parts the sequences is no name
    rest = len(names) % width
    order = np.concatenate([np.arange(len(names)), np.full((width - rest) % width + width, -1)]).reshape(-1, width).T.ravel()
    sequence = np.where(order < 0, names.max() + 1, names[order])
    found = np.fromiter(chain.from_iterable(automaton.iter(tuple(sequence.tolist()))), np.int64).reshape(-1, 2)
    return np.array(at, np.int64), found[:, 1], order[found[:, 0] - (BLOCK - 1)]


def extended(w: np.ndarray, q: int, left: int, right: int) -> tuple[int, int]:
    """The greatest stretch around [left, right) whose words are equal to those q places on."""
    for step in (1, -1):
        size = 32
        while True:
            a, b = (right, min(right + size, len(w) - q)) if step > 0 else (max(left - size, 0), left)
            if a >= b:
                break
            odd = np.flatnonzero(w[a:b] != w[a + q : b + q])
            if len(odd):
                left, right = (left, a + int(odd[0])) if step > 0 else (a + int(odd[-1]) + 1, right)
                break
            left, right = (left, b) if step > 0 else (a, right)
            size *= 2
    return left, right


def runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word numbers ``w``, by start, then period."""
    n = len(w)
    if not may_have_runs(w):
        return []
    found: list[tuple[int, int, int]] = []
    #: For each place, where the furthest run of a period up to the block's size that holds it ends.
    reach = np.zeros(n, np.int64)
    size, width, names = BLOCK, 1, w
    while size == BLOCK or PERIODS * size <= n:
        first = 1 if size == BLOCK else size
        places = np.arange(0, n - size + 1, size)
        places = places[reach[places] < np.minimum(places + 3 * size - 1, n)]  # others are within a run, as far as they matter
        if len(places):
            at, number, start = occurrences(names, width, places)
            keys = np.sort(number * (n + 1) + start)
            low = np.searchsorted(keys, at * (n + 1) + np.minimum(places + first, n))
            high = np.searchsorted(keys, at * (n + 1) + np.minimum(places + 2 * size, n))
            search(w, size, np.repeat(places, high - low), keys[ranges(low, high - low)] % (n + 1), reach, found)
        for left, length, period in found:
            if size < period <= 2 * size:  # from the next size on they count
                np.maximum(reach[left : left + length], left + length, out=reach[left : left + length])
        names = np.unique(names[: len(names) - width] * (n + 1) + names[width:], return_inverse=True)[1]
        size, width = 2 * size, 2 * width
    return sorted(found, key=lambda r: (r[0], r[2]))


def search(w: np.ndarray, size: int, s: np.ndarray, other: np.ndarray, reach: np.ndarray, found: list[tuple[int, int, int]]) -> None:
    """Extend the seeds (blocks of ``size`` words at ``s`` that occur at ``other`` too); add the runs to ``found``."""
    q = other - s
    new = reach[s] < other + size  # the others have a smaller period, and so has all that they extend to
    s, q = s[new], q[new]
    order = np.lexsort((s, q))
    s, q = s[order], q[order]
    bounds = np.flatnonzero(np.diff(q, prepend=-1, append=-1))
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        period = int(q[i])
        seeds = s[i:j]
        seeds = seeds[reach[seeds] < seeds + period + size]
        k = 0
        while k < len(seeds):
            left, right = extended(w, period, int(seeds[k]), int(seeds[k]) + size)
            length = right - left + period
            if length >= max(LEAST, PERIODS * period):
                found.append((left, length, period))
                if period <= size:
                    np.maximum(reach[left : left + length], left + length, out=reach[left : left + length])
            k = int(np.searchsorted(seeds, right - size, "right"))


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, exactly; ties by start, then period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those in no run behind its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def collapse(df: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, n_words, runs, best (the strongest run) and collapsed (the words that stay).

    A run is a stretch of words with smallest period q, as long as it can be, of LEAST words
    and PERIODS periods at least. Runs may overlap. Words of collapsed are joined by one space.
    Whole texts in their rows, no shuffle; memory follows the longest text, not the batch.
    A null or empty text has no words, no runs, a null best and an empty collapsed. One row for
    each input row, repeated ones included; other columns are left out, whatever their names.
    """
    out = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("best", RUN), T.StructField("collapsed", T.StringType())]
    schema = T.StructType([df.schema[k] for k in keep] + out)
    run_type = pa.struct([(name, pa.int64()) for name in RUN.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch.column(0)):
                n_words, all_runs, best, texts = [], [], [], []
                for k in range(len(rows)):
                    part = rows.data[rows.bounds[k] : rows.bounds[k + 1]].tobytes().split()
                    numbers: dict[bytes, int] = {}
                    w = np.array([numbers.setdefault(x, len(numbers)) for x in part], np.int64)
                    found = runs(w)
                    if found:
                        part = [part[i] for i in np.flatnonzero(kept(len(part), found)).tolist()]
                    n_words.append(len(w))
                    all_runs.append([dict(zip(RUN.names, r, strict=True)) for r in found])
                    top = strongest(found)
                    best.append(top and dict(zip(RUN.names, top, strict=True)))
                    texts.append(b" ".join(part).decode("utf-8", "replace"))
                kept_columns = [batch.column(k + 1).slice(rows.first, len(rows)) for k in range(len(keep))]
                made = [pa.array(n_words, pa.int64()), pa.array(all_runs, pa.list_(run_type)), pa.array(best, run_type), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*kept_columns, *made], names=[*keep, *(f.name for f in out)])

    return df.select(F.col(text).alias("__text"), *keep).mapInArrow(run, schema)


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """A text whose tail repeats itself, for one in ten ids; the others as they are.

    h = crc32 of the decimal id, g = floor(h / 10); where h % 10 = 0 and there are n > 0 words, the
    words from place a = g % n on become copies of the first p = 1 + floor((n - a) / (3 + g % 8)) of
    them. A null id changes nothing.
    """
    w, h = words(text), F.crc32(doc_id.cast("string"))
    n, g = F.size(w).cast("long"), F.floor(h / 10)
    a = g % n
    rest = n - a
    p = F.lit(1) + F.floor(rest / (F.lit(3) + g % 8))
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), F.ceil(rest / p).cast("int"))), F.lit(1), rest.cast("int"))
    new = F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), new).otherwise(text)
