"""Toxicity: non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; unlabelled text is a mixture of both
classes. The risk estimator corrects the mixture by the class prior and is kept from
going below zero. The classifier is a numpy linear model over word indicators.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._columns import materialize, sampled
from textloom.llm._linear import BUCKETS, class_counts, counts_array, linear_score, sigmoid, sparse_rows, word_features

#: Positive and unlabelled rows that training takes at most, chosen by hash; counts take all.
POSITIVE_ROWS = 3000
UNLABELLED_ROWS = 9000


@dataclass
class Model:
    """Weights over word buckets (indicator scale and fitted weight in one) and the bias."""

    weights: np.ndarray
    bias: float


def indicator_scale(counts: np.ndarray, smooth: float = 3.0) -> np.ndarray:
    """log of how much likelier a word's bucket is in positives than in unlabelled text, smoothed.

    Rare words keep a scale near 0, so that the fit can't learn single texts by heart.
    """
    p = (counts[1, :BUCKETS] + smooth * 0.2) / (counts[1, BUCKETS] + smooth)
    u = (counts[0, :BUCKETS] + smooth * 0.2) / (counts[0, BUCKETS] + smooth)
    trust = counts[1, :BUCKETS] / (counts[1, :BUCKETS] + smooth)
    return np.maximum(np.log(p / u), 0.0) * trust


def _sums(rows: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    return np.array([values[r].sum() for r in rows])


def risk_terms(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """Positive and negative risk of margins of positives and unlabelled texts, sigmoid loss l(g) = sigmoid(-g).

    prior * E_p[l(g)], and E_u[l(-g)] - prior * E_p[l(-g)], which may come out below zero.
    """
    return prior * sigmoid(-gp).mean(), sigmoid(gu).mean() - prior * sigmoid(gp).mean()


def descent(positive: list[np.ndarray], unlabelled: list[np.ndarray], scale: np.ndarray, w: np.ndarray, bias: float, prior: float) -> np.ndarray:
    """Gradient by weights and bias of the batch's risk; where its second term is negative, of that term reversed."""
    gp, gu = _sums(positive, w * scale) + bias, _sums(unlabelled, w * scale) + bias
    dp, du = (sigmoid(g) * sigmoid(-g) / len(g) for g in (gp, gu))
    above = risk_terms(gp, gu, prior)[1] >= 0
    out = np.zeros(len(w) + 1)
    for rows, slope in ((positive, -2 * prior * dp if above else prior * dp), (unlabelled, du if above else -du)):
        for r, d in zip(rows, slope, strict=True):
            out[r] += d * scale[r]
        out[-1] += slope.sum()
    return out


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], scale: np.ndarray, prior: float, epochs: int = 60, batch: int = 512, rate: float = 0.05, decay: float = 1e-4, seed: int = 11) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with sigmoid loss.

    risk = prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]); where the second
    term is negative in a batch, the step goes against it.
    """
    draw = np.random.default_rng(seed)
    used = np.unique(np.concatenate([*positive, *unlabelled, np.zeros(0, np.int64)])).astype(np.int64)
    used = used[scale[used] > 0]
    place = np.full(BUCKETS, -1, np.int64)
    place[used] = np.arange(len(used))
    small = [[place[r][place[r] >= 0] for r in rows] for rows in (positive, unlabelled)]
    s = scale[used]
    w, bias = np.full(len(used), 0.1), -2.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    step = 0

    n_batches = max(1, -(-len(unlabelled) // batch))
    for _ in range(epochs):
        ps, us = np.array_split(draw.permutation(len(positive)), n_batches), np.array_split(draw.permutation(len(unlabelled)), n_batches)
        for pi, ui in zip(ps, us, strict=True):
            if not len(pi) or not len(ui):
                continue
            g = descent([small[0][i] for i in pi], [small[1][i] for i in ui], s, w, bias, prior)
            g[:-1] += decay * w
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, bias = w - move[:-1], bias - move[-1]
    out = np.zeros(BUCKETS)
    out[used] = w * s
    return out, float(bias)


def fit(positive: DataFrame, unlabelled: DataFrame, *, text: str = "text", prior: float = 0.1, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model:
    """Fit to confirmed positives and unlabelled texts.

    Word counts take every row of both; the risk takes at most ``positive_rows`` and
    ``unlabelled_rows`` of them, chosen by the hash of the row. ``prior`` is the share of
    positives in unlabelled text. Without positives or unlabelled rows the model gives
    every text the prior.
    """
    both = [materialize(positive, "positives"), unlabelled]
    both = [df.withColumnRenamed(text, "__t").withColumn("__y", F.lit(y)) for df, y in zip(both, (1, 0), strict=True)]
    counts = sum(counts_array(class_counts(df, word_features, "__t", "__y")) for df in both)
    prior = float(np.clip(prior, 1e-3, 0.95))
    if not counts[0, BUCKETS] or not counts[1, BUCKETS]:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    sizes = (int(counts[1, BUCKETS]), positive_rows), (int(counts[0, BUCKETS]), unlabelled_rows)
    taken = [sparse_rows(sampled(df, *size), word_features, "__t", "__y")[0] for df, size in zip(both, sizes, strict=True)]
    if not taken[0] or not taken[1]:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    weights, bias = fit_nnpu(*taken, indicator_scale(counts), prior)
    return Model(weights.astype(np.float32), bias)


def score(df: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """The input with a column ``name``: how likely a text is toxic, in 0 to 1.

    Whole texts; a null or empty text scores as one without words. Rows, repeated ones
    too, stay as they are; an input column of that name is replaced. The model is one
    array of 2^18 floats, whatever the data.
    """
    return df.withColumn(name, linear_score(model.weights, word_features, lambda total, _: sigmoid(total + model.bias))(F.col(text)))
