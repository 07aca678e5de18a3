"""Hashed n-gram indicators of texts, and linear scores over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._text import NOT_ALNUM, U64, Rows, mix, slices, span_hash, words

BITS = 18
BUCKETS = 1 << BITS


def folded(h: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of 64-bit hashes; kind keeps families of features apart."""
    return (mix(h + U64(kind)) >> U64(64 - BITS)).astype(np.int64)


def byte_grams(rows: Rows, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each run of ``size`` bytes, and where each row's runs begin (runs do not cross rows)."""
    data, bounds = rows.data, rows.bounds
    n = len(data)
    packed = np.zeros(n, np.uint32)
    for k in range(size):
        packed[: n - k] |= data[k:].astype(np.uint32) << np.uint32(8 * k)
    packed += np.uint32(0x9E3779B1 * size & 0xFFFFFFFF)
    packed ^= packed >> np.uint32(15)
    packed *= np.uint32(0x2C1B3C6D)
    packed ^= packed >> np.uint32(12)
    packed *= np.uint32(0x297A2D39)
    return packed >> np.uint32(32 - BITS), np.maximum(bounds[1:] - size + 1, bounds[:-1])


def quality_features(rows: Rows) -> Iterator[np.ndarray]:
    """Distinct buckets of each row: byte 1- to 4-grams, and the forms of repetition.

    A bigram of equal words and a pair of equal lines are n-grams too, but of endless
    variety; each counts as one feature whatever the word or line is.
    """
    parts = [byte_grams(rows, size) for size in (1, 2, 3, 4)]
    w = words(rows)
    same = np.zeros(len(w), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    streak = same.copy()
    streak[1:] &= same[:-1]
    breaks = np.flatnonzero(rows.data == 10)
    flags = np.zeros(BUCKETS, bool)
    special = folded(np.arange(16, dtype=U64), 77)
    for k in range(len(rows)):
        a, b = rows.bounds[k], rows.bounds[k + 1]
        for bucket, last in parts:
            flags[bucket[a : last[k]]] = True
        i, j = w.first[k], w.first[k + 1]
        n = j - i
        if n > 1:
            share = same[i:j].sum() / n
            flags[special[0 if share == 0 else 1 if share < 0.1 else 2 if share < 0.3 else 3]] = True
            flags[special[4]] |= streak[i:j].any()
            distinct = len(np.unique(w.hash[i:j])) / n
            flags[special[5 + min(4, int(distinct * 5))]] = True
        cut = breaks[np.searchsorted(breaks, a) : np.searchsorted(breaks, b)]
        if len(cut) > 1:
            begin, end = np.concatenate([[a], cut + 1]), np.concatenate([cut, [b]])
            full = end - begin > 1
            if full.sum() > 1:
                line = span_hash(rows.data[a:b], begin[full] - a, end[full] - a)
                flags[special[10 if len(np.unique(line)) == len(line) else 11]] = True
        flags[special[12 + min(3, int(n > 4) + int(n > 20) + int(n > 60))]] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        yield found


def word_features(rows: Rows) -> Iterator[np.ndarray]:
    """Distinct buckets of each row: its words of letters and digits, in lower case."""
    rows = rows.lowered()
    w = words(rows, gap=NOT_ALNUM)
    bucket = folded(w.hash, 5)
    for k in range(len(rows)):
        yield np.unique(bucket[w.first[k] : w.first[k + 1]])


Features = Callable[[Rows], Iterator[np.ndarray]]


def class_counts(df: DataFrame, features: Features, text: str, label: str) -> DataFrame:
    """(bucket, label, n): in how many rows of each label a bucket occurs, over all rows.

    Partial sums in each task have at most 2 * BUCKETS rows, so neither shuffle nor
    result grows with the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS + 1), np.int64)  # the last counts rows
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for rows in slices(batch.column(0)):
                for k, found in enumerate(features(rows)):
                    y = int(labels[rows.first + k])
                    total[y, found] += 1
                    total[y, BUCKETS] += 1
        y, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(y), pa.array(total[y, bucket])], names=["bucket", "label", "n"])

    part = df.select(F.col(text).alias("__text"), F.col(label).cast("int").alias("__label")).mapInArrow(run, "bucket long, label long, n long")
    return part.groupBy("bucket", "label").agg(F.sum("n").alias("n"))


def counts_array(counts: DataFrame) -> np.ndarray:
    """The (at most 2 * BUCKETS) class counts as an array; the last column counts rows."""
    out = np.zeros((2, BUCKETS + 1))
    got = counts.toPandas()
    out[got["label"].to_numpy(int), got["bucket"].to_numpy(int)] = got["n"].to_numpy()
    return out


def sparse_rows(df: DataFrame, features: Features, text: str, label: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of a bounded sample, as the caller has limited it.

    Sorted by label and features, so a fit takes the same rows in the same order however they arrive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch.column(0)):
                found = [f.astype(np.int32).tobytes() for f in features(rows)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(rows.first, len(rows)), pa.array(found, pa.binary())], names=["label", "found"])

    got = df.select(F.col(text).alias("__text"), F.col(label).cast("int").alias("__label")).mapInArrow(run, "label int, found binary").toPandas()
    got = got.sort_values(["label", "found"])
    return [np.frombuffer(x, np.int32) for x in got["found"]], got["label"].to_numpy(int)


def linear_score(weights: np.ndarray, features: Features, finish: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A column function: sums of weights over each text's features, then ``finish(sum, count)``."""

    def score(text: pa.Array) -> pa.Array:
        out = []
        for rows in slices(text):
            found = list(features(rows))
            total = np.array([weights[f].sum(dtype=np.float64) for f in found])
            out.append(finish(total, np.array([len(f) for f in found])))
        return pa.array(np.concatenate([*out, np.zeros(0)]), pa.float64())

    return F.arrow_udf(score, "double")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))
