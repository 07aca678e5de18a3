"""Longest runs of values that rise by one, along the lines of a grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is known of a stretch of a series; of two that follow each other it is known from theirs.
SUMMARY = "part int, first long, last long, n long, prefix long, suffix long, best long"


def series(cells: DataFrame) -> DataFrame:
    """U4. (kind, series, pos, value): rows, columns and both ways of numbering, from one scan."""
    three = F.array(
        F.struct(F.lit("row").alias("kind"), F.col("row").alias("series"), F.col("col").alias("pos")),
        F.struct(F.lit("column").alias("kind"), F.col("col").alias("series"), F.col("row").alias("pos")),
        F.struct(F.lit("diagonal").alias("kind"), (F.col("col") - F.col("row")).alias("series"), F.col("row").alias("pos")),
    )
    return cells.select(F.inline(three), "value")


def _stretches(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Of each stretch of one series in sorted rows: kind, series, first and last value (and whether known), n, prefix, suffix, best."""
    kind, line, value = (batch.column(k) for k in range(3))
    kind, line = kind.to_numpy(zero_copy_only=False), line.to_numpy(zero_copy_only=False)
    known = ~np.asarray(value.is_null())
    value = value.fill_null(0).to_numpy(zero_copy_only=False)
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (line[1:] != line[:-1])
    breaks = new.copy()
    breaks[1:] |= ~(known[1:] & known[:-1] & (value[1:] == value[:-1] + 1))
    run, start = np.flatnonzero(breaks), np.flatnonzero(new)
    length = np.diff(run, append=len(kind))
    at = np.searchsorted(run, start)  # the first run of each stretch
    end = np.append(start[1:], len(kind)) - 1
    last = np.append(at[1:], len(run)) - 1
    return [kind[start], line[start], value[start], known[start], value[end], known[end], end - start + 1, length[at], length[last], np.maximum.reduceat(length, at)]


def summaries(cells: DataFrame) -> DataFrame:
    """(kind, series, and SUMMARY): a row for each series and part of the range sort that holds some of it.

    A series of any length is cut into as many parts as its rows need; no task has to hold one.
    """
    rows = series(cells).select("kind", F.col("series").cast("long").alias("series"), F.col("value").cast("long").alias("value"), "pos")
    order = ("kind", "series", "pos", "value")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            kind, line, first, first_known, last, last_known, *counts = rows
            values = [pa.array(first, pa.int64(), mask=~first_known), pa.array(last, pa.int64(), mask=~last_known)]
            columns = [pa.array(kind, pa.string()), pa.array(line, pa.int64()), pa.array(np.full(len(kind), part), pa.int32()), *values, *(pa.array(c, pa.int64()) for c in counts)]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "series", "part", "first", "last", "n", "prefix", "suffix", "best"])

        for batch in batches:
            if not len(batch):
                continue
            rows = _stretches(batch)
            if held is not None:
                if held[0] == rows[0][0] and held[1] == rows[1][0]:
                    for column, x in zip(rows, _joined(held, [c[0] for c in rows]), strict=True):
                        column[0] = x
                else:
                    yield out([np.array([x]) for x in held])
            held = [c[-1] for c in rows]
            if len(rows[0]) > 1:
                yield out([c[:-1] for c in rows])
        if held is not None:
            yield out([np.array([x]) for x in held])

    return ordered.mapInArrow(run, f"kind string, series long, {SUMMARY}")


def _joined(a: list, b: list) -> list:
    """The summary of two stretches in a row, as :func:`_stretches` has them."""
    kind, line, first, first_known, last, last_known, n, prefix, suffix, best = a
    _, _, first_b, first_b_known, last_b, last_b_known, n_b, prefix_b, suffix_b, best_b = b
    meet = last_known and first_b_known and first_b == last + 1
    across = suffix + prefix_b if meet else 0
    return [kind, line, first, first_known, last_b, last_b_known, n + n_b, prefix + prefix_b if meet and prefix == n else prefix, suffix_b + suffix if meet and suffix_b == n_b else suffix_b, max(best, best_b, across)]


def merged(parts: Column) -> Column:
    """The longest run of a series from the array of its summaries, in order of part."""

    def join(a: Column, b: Column) -> Column:
        meet = F.coalesce(b["first"] == a["last"] + 1, F.lit(False))
        across = F.when(meet, a["suffix"] + b["prefix"]).otherwise(F.lit(0))
        suffix = F.when(meet & (b["suffix"] == b["n"]), b["suffix"] + a["suffix"]).otherwise(b["suffix"])
        return F.struct(b["last"].alias("last"), suffix.alias("suffix"), F.greatest(a["best"], b["best"], across).alias("best"))

    none = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("suffix"), F.lit(0).cast("long").alias("best"))
    return F.aggregate(parts, none, join, lambda s: s["best"])


def longest_by_series(cells: DataFrame) -> DataFrame:
    """(kind, series, longest). A series meets as one summary for each part, never as rows.

    Rows of one place are taken by value; a null value ends a run and is a run of one itself.
    """
    packed = summaries(cells).groupBy("kind", "series").agg(F.array_sort(F.collect_list(F.struct("part", "first", "last", "n", "prefix", "suffix", "best"))).alias("parts"))
    return packed.select("kind", "series", merged(F.col("parts")).alias("longest"))


def longest_runs(cells: DataFrame) -> DataFrame:
    """W8. (kind, longest): longest run of values that each are the one before plus one.

    The intent of the reference's loop, which as written looks at single cells only.
    """
    return longest_by_series(cells).groupBy("kind").agg(F.max("longest").alias("longest"))
