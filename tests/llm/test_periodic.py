"""Periodic runs against a brute force over all periods, and on odd rows."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def has_period(w, d):
    return all(w[k] == w[k + d] for k in range(len(w) - d))


def brute(w):
    """Every maximal run, by trying all periods."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q) and not any(has_period(w[i : j + q], d) for d in range(1, q)):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.randoms(use_true_random=False))
def test_runs_are_those_of_brute_force(rng):
    kinds, n = rng.choice([1, 2, 3, 5, 50]), rng.randrange(400)
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 10 else 0):
        a, share = rng.randrange(n), rng.choice([2, 3, 4, 9])
        p = 1 + rng.randrange(max(1, (n - a) // share))
        for i in range(a, rng.randrange(a, n)):
            w[i] = w[a + (i - a) % p]
    assert periodic.runs(np.array(w, np.int64)) == brute(w)


@pytest.mark.parametrize("q", [1, 7, 8, 15, 16, 17, 31, 32, 63, 64, 100])
@pytest.mark.parametrize("extra", [-1, 0, 1])
def test_shortest_runs_at_every_scale(q, extra):
    rng = random.Random(q)
    for before in range(0, 40, 3):
        block = list(range(1, q + 1))
        w = [-k - 1 for k in range(before)] + [block[k % q] for k in range(max(24, 3 * q) + extra)] + [-k - 1000 for k in range(rng.randrange(9))]
        want = [] if extra < 0 else [(before, max(24, 3 * q) + extra, q)]
        assert periodic.runs(np.unique(w, return_inverse=True)[1]) == want


def test_long_texts_in_near_linear_time():
    n = 200_000
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 5000, n)
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    fibonacci = np.frombuffer(b.encode(), np.uint8).astype(np.int64) - 97
    start = time.time()
    assert periodic.runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periodic.runs(np.arange(n) % 77) == [(0, n, 77)]
    assert periodic.runs(np.concatenate([np.zeros(n // 2, np.int64), noise + 1])) == [(0, n // 2, 1)]
    assert periodic.runs(np.tile(noise[: n // 4], 4)) == [(0, n, n // 4)]
    assert len(periodic.runs(fibonacci)) > 10_000
    assert time.time() - start < 60


def planted(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, text):
    w = planted(doc_id, text)
    found = brute(w)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
    top = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
    digests = ("".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(x for i, x in enumerate(w) if i not in dropped))
    return (doc_id, len(found), *top, *(hashlib.sha256(d.encode()).hexdigest() for d in digests))


def test_op13_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " \t".join(rng.choice(["a", "b é", "漢\n字", f"w{k}"]) for k in range(rng.randrange(250)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "x " * 5000), (1003, "x " * 5000), (None, "y " * 30), (1004, "no \x1c break"), (-7, "tok " * 24)]
    frame = spark.createDataFrame([(i, t, "r", "s") for i, t in rows], "doc_id long, text string, runs string, __text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op13_periodic(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and r[1] for i, r in ((r[0], r) for r in map(tuple, out.collect())))
    assert periodic.collapse(frame.where("doc_id = 99999")).count() == 0


def test_overlapping_runs_collapse_together():
    w = np.array([1, 2] * 14 + [1, 1] + [1] * 30, np.int64)
    found = periodic.runs(w)
    assert found == brute(w.tolist()) and len(found) == 2
    assert periodic.strongest(found) == max(found, key=lambda r: r[1] / r[2])
    assert periodic.kept(len(w), found).sum() == len(w) - len({i for s, n, q in found for i in range(s + q, s + n)})
