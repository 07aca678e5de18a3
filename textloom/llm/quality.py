"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the class log-count ratio of their bucket, counted
over all labelled rows; a linear hinge-loss model is then fitted to the scaled
indicators by dual coordinate descent, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._columns import materialize, sampled
from textloom.llm._linear import BUCKETS, class_counts, counts_array, quality_features, sigmoid, sparse_rows
from textloom.llm._text import slices

#: Labelled rows that the hinge-loss fit takes at most, chosen by hash; counts take all.
FIT_ROWS = 6000


@dataclass
class Model:
    """Weights over buckets (ratio and fitted weight in one), their ratios, and the scale of the score."""

    weights: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float


def log_count_ratio(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of the smoothed, normalised counts of label 1 over those of label 0, per bucket."""
    p, q = counts[1, :BUCKETS] + smooth, counts[0, :BUCKETS] + smooth
    seen = counts[:, :BUCKETS].sum(0) > 0
    ratio = np.log(p / (counts[1, BUCKETS] + 2 * smooth)) - np.log(q / (counts[0, BUCKETS] + 2 * smooth))
    return np.where(seen, ratio, 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge loss, L2: one dual variable for each row, exact steps, clipped to [0, cost]."""
    w, bias = np.zeros(BUCKETS), 0.0
    x = [(r, v / norm) if (norm := np.sqrt((v := values[r]) @ v)) > 0 else (r, v) for r in rows]
    q = np.array([v @ v + 1.0 for _, v in x])
    alpha = np.zeros(len(rows))
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            r, v = x[i]
            new = min(max(alpha[i] - (y[i] * (w[r] @ v + bias) - 1) / q[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[r] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of the logistic score of a margin (Newton steps, smoothed targets)."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margin + b)
        d, h = p - t, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margin + 1e-3 * (a - 1), d.sum()])
        m = np.array([[h @ margin**2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(train: DataFrame, *, text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, cost: float = 4.0, epochs: int = 30) -> Model:
    """Fit to labelled rows (label 0 or 1; rows with another or no label are left out).

    Log-count ratios take every labelled row. The hinge-loss fit takes at most
    ``fit_rows`` rows, chosen by the hash of the row. With one class only, or none,
    the model gives that class's share (0.5 for none) to every text.
    """
    others = [c for c in train.columns if c not in (text, label)]
    rows = train.where(F.col(label).isin(0, 1)).select(F.col(text).alias("__t"), F.col(label).cast("int").alias("__y"), F.xxhash64(*others).alias("__k") if others else F.lit(0).alias("__k"))
    rows = materialize(rows, "labelled")
    counts = counts_array(class_counts(rows, quality_features, "__t", "__y"))
    n0, n1 = counts[0, BUCKETS], counts[1, BUCKETS]
    if not n0 or not n1:
        share = float(np.clip(n1 / (n0 + n1), 0.01, 0.99)) if n0 + n1 else 0.5
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    ratio = log_count_ratio(counts)
    sample = sampled(rows, int(n0 + n1), fit_rows)
    found, y = sparse_rows(sample, quality_features, "__t", "__y")
    y = 2.0 * y - 1
    if len(set(y.tolist())) < 2:
        w, bias = ratio, 0.0
    else:
        # the rarer class costs more, so that the margin is not all the commoner one's
        share = (y > 0).mean()
        w, bias = dual_coordinate_descent(found, ratio, y, np.where(y > 0, cost * 0.5 / share, cost * 0.5 / (1 - share)), epochs)
    margin = np.array([(w[r] @ ratio[r]) / max(np.sqrt(ratio[r] @ ratio[r]), 1e-9) + bias for r in found])
    slope, offset = platt(margin, y)
    return Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, slope, offset)


def score(df: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """The input with a column ``name``: probability that a text is of label 1, in 0 to 1.

    Whole texts; null and empty texts get the score of a text without n-grams. Rows,
    repeated ones too, stay as they are; an input column of that name is replaced.
    The model is three numbers and two arrays of 2^18 floats, whatever the data.
    """
    both = model.weights.astype(np.float64) + 1j * model.square

    def run(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for rows in slices(texts):
            for f in quality_features(rows):
                total = both[f].sum()
                margin = total.real / max(np.sqrt(total.imag), 1e-9) + model.bias
                out.append(sigmoid(np.array([model.slope * margin + model.offset])))
        return pa.array(np.concatenate(out), pa.float64())

    return df.withColumn(name, F.arrow_udf(run, "double")(F.col(text)))
