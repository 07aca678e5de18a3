"""Runs in series that are cut over several tasks, against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import sequences


def plain(cells):
    lines = {}
    for r, c, v in cells:
        for kind, s, p in (("row", r, c), ("column", c, r), ("diagonal", c - r, r)):
            lines.setdefault((kind, s), []).append((p, v))
    out = {}
    for key, line in lines.items():
        best = n = 0
        before = None
        for _, v in sorted(line):
            n = n + 1 if before is not None and v == before + 1 else 1
            best, before = max(best, n), v
        out[key] = best
    return out


def got(df):
    return {(r["kind"], r["series"]): r["longest"] for r in sequences.longest_by_series(df).collect()}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_runs_against_a_loop(spark, batch):
    rng = random.Random(batch)
    cells = [(r, c, rng.randrange(3) + (r + c if rng.random() < 0.8 else 0)) for r in range(40) for c in range(40) if rng.random() < 0.95]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(cells, "row int, col int, value int")
        assert got(df) == plain(cells)
        assert got(df.where("row > 99")) == {}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture
def uncoalesced(spark):
    """Small parts stay apart, as parts of more than the advisory size do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_series_over_several_tasks(spark, uncoalesced):
    values = [*range(500), *range(7), *range(2000, 9000), 5, *range(6, 900)]
    cells = [(0, k, v) for k, v in enumerate(values)]
    df = spark.createDataFrame(cells, "row long, col long, value int")
    parts = sequences.summaries(df).where("kind = 'row'")
    assert parts.count() >= 2 and parts.agg(F.sum("n")).first()[0] == len(values)  # no task has the whole series
    want = plain(cells)
    assert got(df) == want and want["row", 0] == 7000
    whole = spark.createDataFrame([(0, k, k) for k in range(20_000)], "row int, col int, value int")
    assert got(whole)["row", 0] == 20_000
    assert sequences.summaries(whole).where("kind = 'row'").count() >= 2


def test_unknown_values_end_a_run(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, None), (0, 3, 3), (0, 4, 4), (0, 5, 5)], "row int, col int, value int")
    assert got(df)["row", 0] == 3
