"""Decontamination by long items and by benchmarks whose items begin alike."""

import random
import resource
import time

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import _text as text_arrays
from textloom.llm import decontaminate


def edited(words, edits, rng):
    out = list(words)
    for k in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = f"new{k}"
        elif kind == 1:
            out.insert(at, f"put{k}")
        else:
            del out[at]
    return out


def found(index, texts, free=True):
    out = {}
    for rows in text_arrays.slices(pa.array([" ".join(t) for t in texts])):
        for row, item, start, n, distance in decontaminate.search(index, rows, free):
            out[rows.first + row, int(item)] = (int(start), int(n), int(distance))
    return out


def test_long_items_are_found():
    """Items of 65 to 5,000 words, with up to a fifth of their words edited, spread or in one place."""
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (5000, 1200, 1200, 600, 300, 129, 128, 100, 80, 65)]
    index = decontaminate.build([(k, " ".join(x)) for k, x in enumerate(items)], 0.2)
    for trial in range(3):
        texts = []
        for k, item in enumerate(items):
            e = len(item) // 5
            copy = edited(item, e, rng) if trial < 2 else [*item[: len(item) - e], *(f"z{i}" for i in range(e))]
            texts.append([f"a{i}" for i in range(rng.randrange(30))] + copy + [f"b{i}" for i in range(rng.randrange(30))])
        got = found(index, texts)
        assert all((k, k) in got and got[k, k][2] <= len(items[k]) // 5 for k in range(len(items)))
        assert len(got) == len(items)
    beyond = [edited(x, int(0.3 * len(x)), rng) for x in items[1:]]
    assert all(d <= len(items[i]) // 5 for (_, i), (_, _, d) in found(index, beyond).items())
    strangers = [[rng.choice(vocabulary) for _ in range(2000)] for _ in range(5)]
    assert found(index, strangers) == {}


@pytest.mark.parametrize("free", [False, True])
def test_long_items_against_all_windows(free):
    """Distances of items of more than a piece, against brute force over every run or window."""
    rng = random.Random(3)
    items = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(n)] for n in (70, 90, 131)]
    index = decontaminate.build([(k, " ".join(x)) for k, x in enumerate(items)], 0.1)
    for _ in range(12):
        k = rng.randrange(3)
        text = [f"x{i}" for i in range(rng.randrange(9))] + edited(items[k], rng.randrange(len(items[k]) // 8), rng) + [f"y{i}" for i in range(9)]
        n, e = len(items[k]), len(items[k]) // 10
        runs = [(s, s + m) for s in range(len(text)) for m in (range(n - e, n + e + 1) if free else [n]) if s + m <= len(text)]
        least = min(levenshtein(items[k], text[a:b], e) for a, b in runs)
        got = found(index, [text], free)
        assert ((0, k) in got) == (least <= e) and (least > e or got[0, k][2] == least)


def levenshtein(a, b, most):
    row = np.arange(len(b) + 1)
    b = np.array(b)
    for i, x in enumerate(a):
        new = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        new = np.concatenate([[i + 1], new])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        if row.min() > most:
            return most + 1
    return int(row[-1])


def test_common_openings_take_flat_memory():
    """20,000 questions that begin alike, and a text with that opening 3,000 times: hits don't meet every owner."""
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(20_000)]
    opening = "which of the following is the best answer to".split()
    items = [(k, " ".join(opening + [rng.choice(vocabulary) for _ in range(20)])) for k in range(20_000)]
    index = decontaminate.build(items, 0.2)
    longest = int((index.owner_end - index.owner_start).max())
    assert longest < 2_000  # the opening's pairs lead to no item
    text = [x for _ in range(3000) for x in [*opening, rng.choice(vocabulary)]]
    copies = [items[k][1].split() for k in (5, 19_999)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    start = time.time()
    got = found(index, [text + edited(copies[0], 5, rng) + text, copies[1]])
    assert {(0, 5), (1, 19_999)} <= set(got)
    assert time.time() - start < 30
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # kB
