"""Hard negatives and vector near-duplicates against brute force, with ties, copies and odd rows."""

import math
from collections import Counter

import numpy as np
import pytest

from textloom.llm import _columns as columns
from textloom.llm import hardneg, queries, vecdup


def vectors(rng, n, d=8, copies=40):
    """Random unit vectors with near copies, and one vector that a third of the rows have."""
    x = rng.normal(size=(n, d))
    for k in range(copies):
        x[rng.integers(n)] = x[rng.integers(n)] + 0.1 * rng.normal(size=d)
    x[rng.permutation(n)[: n // 3]] = x[0]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, rows, path=None):
    frame = spark.createDataFrame([(i, y, v, "x", 0, "w") for i, y, v in rows], "vec_id long, label int, embedding array<float>, id string, w int, rank string")
    if path:
        frame.write.parquet(f"{path}/embeddings.parquet")
    return frame


def taking_part(rows):
    size = Counter(len(v) for i, y, v in rows if v).most_common(1)[0][0]
    return [r for r in rows for i, y, v in [r] if i is not None and y is not None and v and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]


def hard_negatives(rows, k=5):
    use = [(i, (y + 1) % 10 if i % 7 == 0 else y, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, y, v in taking_part(rows)]
    out = []
    for i, y, q in use:
        if i % 100:
            continue
        scored = sorted(((int(q @ p), j, z) for j, z, p in use if j != i), key=lambda s: (-s[0], s[1]))
        for s, j, _ in [x for x in scored if x[2] == y][:k]:
            some = [x for x in scored if x[2] != y and 80 * s <= 100 * x[0] <= 100 * s][:k]
            out += [(i, j, r + 1, t, s, u) for r, (u, t, _) in enumerate(some)]
    return sorted(out)


ODD = [(5000, None, [0.5] * 8), (5001, 1, None), (5002, 1, [0.1] * 7 + [None]), (5003, 1, [0.1] * 7 + [math.nan]), (5004, 1, [math.inf] * 8), (None, 1, [0.3] * 8), (5005, 2, []), (5006, 2, [0.1] * 3), (5100, 3, [0.0] * 8), (-100, 3, [0.2, -0.3] * 4)]


@pytest.mark.parametrize("block", [3, 2048])
def test_hard_negatives(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(hardneg, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(int(k), int(rng.integers(10)), v.tolist()) for k, v in enumerate(vectors(rng, 900))] + ODD
    rows += [(77, rows[77][1], rows[77][2])] * 3
    table(spark, rows, tmp_path)
    got = queries.op11_hardneg(spark, str(tmp_path))
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    want = hard_negatives(rows)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_hard_negatives_of_few_and_large_values(spark):
    rows = [(0, 1, [1e9, -1e9]), (1, 1, [1e9, -1e9]), (2, 2, [9e8, -9e8]), (3, 2, [5e8, -5e8])]
    got = hardneg.mine(table(spark, rows), hardneg.F.col("id") % 100 == 0).collect()
    assert [(r["positive_id"], r["negative_id"]) for r in got] == [(1, 2), (1, 3)]  # components are clipped alike
    assert hardneg.mine(table(spark, rows[1:]), hardneg.F.col("id") % 100 == 0).count() == 0
    assert hardneg.mine(table(spark, rows[:0]), hardneg.F.col("id") % 100 == 0).count() == 0


def test_more_digits_than_one(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(k % 3), (v * 1000).tolist()) for k, v in enumerate(vectors(rng, 300))]
    got = hardneg.mine(table(spark, rows), hardneg.F.col("id") % 100 == 0)
    use = [(i, y, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, y, v in rows]
    for r in got.collect():
        a, p, n = (use[r[c]] for c in ("anchor_id", "positive_id", "negative_id"))
        assert r["positive_score"] == int(a[2] @ p[2]) and r["negative_score"] == int(a[2] @ n[2]) and a[1] == p[1] != n[1]
    assert got.where("anchor_id = 0").count() > 0


def links_of(rows, least=0.93):
    """(id, n_links, component, kept) of each row, and the links, by comparing all pairs."""
    part = {id(r) for r in taking_part(rows) if any(r[2])}
    use = [r for r in rows if id(r) in part]
    x = np.array([np.array(r[2], np.float32).astype(float) for r in use])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([r[1] for r in use])
    linked = (x @ x.T >= least) & (y[:, None] == y[None, :])
    np.fill_diagonal(linked, False)
    ids = np.array([r[0] for r in use])
    linked_ids = linked | (ids[:, None] == ids[None, :])
    component = ids.copy()
    while True:
        new = np.where(linked_ids, component[None, :], np.iinfo(np.int64).max).min(1)
        if (new == component).all():
            break
        component = new
    out = [(i, int(n), int(c), bool(i == c)) for i, n, c in zip(ids.tolist(), linked.sum(1), component, strict=True)]
    return sorted(out + [(r[0], 0, r[0], True) for r in rows if id(r) not in part], key=repr), linked


def near_copies(rng, n, d, spread, third=0):
    """Random unit vectors; chains and groups of near copies at ``spread``, and one group of ``third`` rows."""
    x = rng.normal(size=(n, d)) / np.sqrt(d)
    for k in range(n // 5):
        x[rng.integers(n)] = x[rng.integers(n)] + spread * rng.normal(size=d) / np.sqrt(d)
    where = rng.permutation(n)[:third]
    x[where] = x[0] + 0.1 * rng.normal(size=(third, d)) / np.sqrt(d)
    return x * rng.uniform(0.5, 3, size=(n, 1))


@pytest.mark.parametrize(("spread", "third", "members"), [(0.35, 0, 1024), (0.2, 400, 1024), (0.38, 400, 50)])
def test_vector_links(spark, tmp_path, monkeypatch, spread, third, members):
    monkeypatch.setattr(vecdup, "MEMBERS", members)
    rng = np.random.default_rng(int(100 * spread))
    x = near_copies(rng, 1200, 64, spread, third)
    rows = [(int(k), int(rng.integers(3)), v.tolist()) for k, v in enumerate(x)]
    rows += [(9000, None, rows[0][2]), (9001, 1, None), (9002, 1, [math.nan] + [0.1] * 63), (9003, 1, [0.0] * 64), (9004, 1, [1.0] * 3), (None, 1, rows[5][2]), (9005, 2, [])]
    rows += [rows[7], rows[7], (9006, rows[7][1], [2 * c for c in rows[7][2]])]
    table(spark, rows, tmp_path)
    out = queries.op12_vecdup(spark, str(tmp_path))
    assert out.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    want, linked = links_of(rows)
    got = sorted(map(tuple, out.collect()), key=repr)
    assert linked.sum() > (30_000 if third else 100)
    assert sum(r[1] for r in got) >= 0.999 * linked.sum()
    assert sum(g != w for g, w in zip(got, want, strict=True)) <= len(want) // 200


def test_vectors_around_a_ball(spark):
    """Vectors at every angle to a dense group: within it, linked with all, some or none of it."""
    rng = np.random.default_rng(4)
    base, d = np.eye(16)[0], 16
    rows = [(int(k), 1, v.tolist()) for k, v in enumerate(base + 0.15 * rng.normal(size=(300, d)) / 4)]
    for k, angle in enumerate(np.linspace(0, 0.7, 200)):
        side = rng.normal(size=d) * (np.arange(d) > 0)
        rows.append((1000 + k, 1 + (k % 20 == 0), (math.cos(angle) * base + math.sin(angle) * side / np.linalg.norm(side)).tolist()))
    model = vecdup.fit(table(spark, rows).selectExpr("vec_id id", "cast(label as long) y", "embedding x").toArrow(), len(rows), 0.93)
    assert len(model.balls)
    want, _ = links_of(rows)
    assert sorted(map(tuple, vecdup.link(table(spark, rows)).collect()), key=repr) == want


def test_one_vector_everywhere(spark):
    rows = [(int(k), 1, [1.0, 2.0, 3.0]) for k in range(500)] + [(500, 2, [1.0, 2.0, 3.0])]
    got = {tuple(r[1:]) for r in vecdup.link(table(spark, rows)).where("vec_id < 500").collect()}
    assert got == {(499, 0, True), (499, 0, False)}
    assert vecdup.link(table(spark, rows[:0])).count() == 0


@pytest.mark.parametrize("copies", [0, 1000, 100_000])
def test_sample_is_bounded_and_never_empty(spark, copies):
    rows = spark.range(2000).selectExpr("id", "cast(id as string) text").union(spark.range(copies).selectExpr("cast(-1 as long)", "'copy'"))
    one = columns.sampled(rows, 2000 + copies, 300).collect()
    assert 200 <= len(one) <= 300 and len({r["id"] for r in one}) > 1
    assert one == columns.sampled(rows.repartition(7), 2000 + copies, 300).collect()
    if copies:
        only = columns.sampled(rows.where("id = -1"), copies, 300).collect()
        assert 1 <= len(only) <= 300
