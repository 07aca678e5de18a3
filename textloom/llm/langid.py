"""Language ID by Bayesian evidence fusion.

Four kinds of evidence are combined: the likelihood of the text under byte n-gram
models, the declared markup language, the address suffix, and a host prior that is
smoothed towards its suffix, and that towards the whole corpus. All counts come from
grouped aggregations over all rows; none is kept on the driver but the n-gram models,
which have FOLDS * LANGUAGES * BUCKETS cells at most.

No row is evidence about itself: its text is scored by a model of the rows of the other
fold (equal texts share a fold), so its own declaration counts once, as a declaration; and
its own vote is left out of its host's, suffix's and corpus's counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._columns import discard, materialize
from textloom.llm._text import Rows, slices

GRAM = 3
BITS = 16
BUCKETS = 1 << BITS
#: Languages with a text model, at most: the model's size has this bound. Of more declared tags
#: the commonest count; rows of the others are identified among these.
LANGUAGES = 256
FOLDS = 2
#: Copies of a host's prior, so that rows of one host spread over tasks.
SALTS = 16


@dataclass
class TextModel:
    """For each fold: log-probability of each n-gram bucket in each language, learned from the other folds."""

    languages: list[str]
    log_prob: np.ndarray  # FOLDS x languages x BUCKETS


def fold_of(text: Column) -> Column:
    """Fold of a text; equal texts share it."""
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def gram_buckets(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte of lower-cased rows, and how many each row has."""
    data, bounds = rows.lowered().data, rows.bounds
    n = len(data)
    packed = np.zeros(n, np.uint32)
    for k in range(GRAM):
        packed[: n - k] |= data[k:].astype(np.uint32) << np.uint32(8 * k)
    packed *= np.uint32(0x9E3779B1)
    return packed >> np.uint32(32 - BITS), np.maximum(np.diff(bounds) - GRAM + 1, 0)


def fit_text(df: DataFrame, *, text: str = "text", declared: str = "lang", smooth: float = 0.5) -> TextModel:
    """N-gram counts of each declared language in each fold, over all rows that declare one.

    The declarations are taken as noisy labels; :func:`identify` may overrule them.
    """
    tag = F.lower(F.trim(F.col(declared)))
    rows = df.select(tag.alias("__lang"), fold_of(F.col(text)).alias("__fold"), F.col(text).alias("__text")).where("__lang is not null and __lang <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            tags = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for part in slices(batch.column(2)):
                bucket, size = gram_buckets(part)
                for k in range(len(part)):
                    total = totals.setdefault(tags[part.first + k], np.zeros(BUCKETS + 1, np.int64))
                    a = part.bounds[k]
                    some = bucket[a : a + size[k]]
                    if len(some) > 4096:
                        total[:BUCKETS] += np.bincount(some, minlength=BUCKETS)
                    else:
                        np.add.at(total, some, 1)
                    total[BUCKETS] += 1
                    if len(totals) > LANGUAGES:
                        yield from emit(totals)
                        totals = {}
        yield from emit(totals)

    def emit(totals: dict[tuple[str, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (lang, fold), total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), fold)), pa.array(at), pa.array(total[at])], names=["lang", "fold", "bucket", "n"])

    counted = rows.mapInArrow(run, "lang string, fold long, bucket long, n long").groupBy("lang", "fold", "bucket").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "language-grams")
    common = counted.where(F.col("bucket") == BUCKETS).groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    languages = sorted(r["lang"] for r in common.collect())
    # at most LANGUAGES * FOLDS * BUCKETS rows
    cells = counted.where(F.col("lang").isin(languages) & (F.col("bucket") < BUCKETS)).toArrow()
    discard(counted)
    table = np.zeros((FOLDS, len(languages), BUCKETS), np.float32)
    if languages:
        place = {lang: k for k, lang in enumerate(languages)}
        at = np.array([place[x] for x in cells["lang"].to_pylist()], int)
        table[cells["fold"].to_numpy(), at, cells["bucket"].to_numpy()] = cells["n"].to_numpy()
        table = np.float32(smooth) + table.sum(0)[None] - table  # the other folds
        table = np.log(table / table.sum(2, dtype=np.float64)[..., None]).astype(np.float32)
    return TextModel(languages, table)


def text_evidence(model: TextModel, text: Column, temper: float = 0.25) -> Column:
    """Array of log-likelihoods, one for each language, tempered because n-grams overlap.

    A text without n-grams gives no evidence: zeros.
    """
    n = len(model.languages)

    def run(column: pa.Array, folds: pa.Array) -> pa.Array:
        out = [np.zeros((0, n))]
        fold = folds.to_numpy(zero_copy_only=False)
        for rows in slices(column):
            bucket, size = gram_buckets(rows)
            total = np.zeros((len(rows), n))
            for f in range(FOLDS):
                full = np.flatnonzero((size > 0) & (fold[rows.first : rows.first + len(rows)] == f))
                if not len(full):
                    continue
                a = rows.bounds[:-1][full]
                for k in range(n):  # one language at a time, so that memory does not follow their number
                    sums = np.zeros(len(bucket) + 1)
                    np.cumsum(np.take(model.log_prob[f, k], bucket), out=sums[1:], dtype=np.float64)
                    total[full, k] = sums[a + size[full]] - sums[a]
            out.append(total * temper)
        flat = np.concatenate(out)
        bounds = np.arange(len(flat) + 1) * n
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.ravel(), pa.float64()))

    return F.arrow_udf(run, "array<double>")(text, fold_of(text))


def suffix(host: Column) -> Column:
    """The last label of a host name, or '' for a host without a dot."""
    return F.when(F.instr(host, ".") > 0, F.lower(F.substring_index(host, ".", -1))).otherwise("")


def _added(counts: str, n: int) -> Column:
    """Sums of the elements of an array column, as an array."""
    return F.array(*(F.coalesce(F.sum(F.col(counts)[k]), F.lit(0.0)) for k in range(n)))


def votes(rows: DataFrame, n: int) -> DataFrame:
    """(__host, __salt, __n, __ns, __na): how many texts of a host, its suffix and the corpus are likeliest in each language.

    ``rows`` has __host, __suffix and __best (the index, null where the text says nothing).
    Counted by grouped sums, so one host may hold any share of rows; each host's row is there
    SALTS times, so that its rows spread over tasks. A null host has the corpus's counts only.
    """
    counts = [F.count_if(F.col("__best") == k).cast("double") for k in range(n)]
    by_host = rows.groupBy("__host", "__suffix").agg(F.array(*counts).alias("__n"))
    by_host = materialize(by_host, "host-votes")
    named = by_host.where("__host is not null")
    by_suffix = named.groupBy("__suffix").agg(_added("__n", n).alias("__ns"))
    overall = F.broadcast(by_host.agg(_added("__n", n).alias("__na")))  # one row
    none = F.array(*(F.lit(0.0) for _ in range(n)))
    hosts = named.join(by_suffix, "__suffix").select("__host", "__n", "__ns")
    nameless = by_host.where("__host is null").select(F.lit(None).cast("string").alias("__host"), none.alias("__n"), none.alias("__ns"))
    every = hosts.unionByName(nameless).join(overall)
    return every.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def prior(n: int, own: Column, strength: float) -> Column:
    """Shares of each language at a row's host, smoothed to its suffix, and that to the corpus.

    share(host) = (n(host, l) + strength * share(suffix)) / (n(host) + strength), and the same
    one level up, to even shares in the end; ``own``, the row's own vote, is left out of all counts.
    """

    def level(counts: Column, parent: Column) -> Column:
        others = F.transform(F.zip_with(counts, own, lambda c, o: c - o), lambda c: F.greatest(c, F.lit(0.0)))
        size = F.aggregate(others, F.lit(0.0), lambda x, y: x + y)
        return F.zip_with(others, parent, lambda c, p: (c + strength * p) / (size + strength))

    even = F.array(*(F.lit(1.0 / n) for _ in range(n)))
    return level(F.col("__n"), level(F.col("__ns"), level(F.col("__na"), even)))


def identify(df: DataFrame, model: TextModel, *, text: str = "text", declared: str = "lang", host: str | None = "source", declared_trust: float = 0.9, least_posterior: float = 0.5, strength: float = 20.0, accepted: tuple[str, ...] | None = None) -> DataFrame:
    """The input with lang_id, lang_posterior and lang_accepted.

    lang_id is the language of highest posterior (the first by name among equals),
    lang_posterior its probability. A row is accepted if its text has an n-gram (three
    bytes or more), the posterior reaches ``least_posterior`` and the language is among
    ``accepted`` (None: any). Null and empty texts give no text evidence, so they are
    identified by declaration and host but not accepted. An unknown or null declaration,
    and a null host, give no evidence. Every input row stays, repeated ones too; input
    columns of the three names are replaced. Without any language all rows are rejected.

    The text evidence of each row is made once and written with the row; the votes of hosts
    are joined to it, by broadcast if their table is small, else by host and salt.
    """
    languages = model.languages
    out = ("lang_id", "lang_posterior", "lang_accepted")
    kept = [c for c in df.columns if c not in out]
    if not languages:
        return df.select(*kept, F.lit(None).cast("string").alias(out[0]), F.lit(0.0).alias(out[1]), F.lit(False).alias(out[2]))
    n = len(languages)
    name = F.array(*map(F.lit, languages))
    host_column = F.col(host).cast("string") if host else F.lit(None).cast("string")
    # the input's columns travel as one struct, so no name can clash with those made here
    rows = df.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__row"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))) >= GRAM).alias("__any"),
        text_evidence(model, F.col(text)).alias("__text"),
        F.array_position(name, F.lower(F.trim(F.col(declared)))).alias("__said"),
        host_column.alias("__host"),
        suffix(host_column).alias("__suffix"),
        F.pmod(F.xxhash64(F.col(text), F.col(declared)), F.lit(SALTS)).cast("int").alias("__salt"),
    )
    rows = materialize(rows, "language-evidence")
    rows = rows.withColumn("__best", F.when(F.col("__any"), F.array_position("__text", F.array_max("__text")) - 1))
    counted = materialize(votes(rows, n), "votes").withColumnsRenamed({"__host": "__h", "__salt": "__s"})
    rows = rows.join(counted, F.col("__host").eqNullSafe(F.col("__h")) & (F.col("__salt") == F.col("__s")), "left")
    own = F.transform(name, lambda _, k: F.when(F.coalesce(F.col("__best") == k, F.lit(False)), 1.0).otherwise(0.0))
    wrong = max((1 - declared_trust) / max(1, n - 1), 1e-6)
    said = F.transform(name, lambda _, k: F.when(F.coalesce(F.col("__said"), F.lit(0)) == 0, 0.0).when(F.col("__said") == k + 1, float(np.log(declared_trust))).otherwise(float(np.log(wrong))))
    fused = F.zip_with(F.zip_with("__text", said, lambda a, b: a + b), prior(n, own, strength), lambda a, p: a + F.log(p))
    rows = rows.withColumn("__sum", fused)
    top = F.array_max("__sum")
    rows = rows.withColumn("__norm", F.aggregate(F.transform("__sum", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, b: a + b))
    found = F.element_at(name, F.array_position("__sum", top).cast("int"))
    posterior = 1.0 / F.col("__norm")
    ok = F.col("__any") & (posterior >= least_posterior)
    if accepted is not None:
        ok = ok & found.isin(*accepted)
    return rows.select("__row.*", found.alias(out[0]), posterior.alias(out[1]), F.coalesce(ok, F.lit(False)).alias(out[2]))


def page_evidence(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Web pages with the columns that :func:`identify` takes: text, lang, source.

    lang is the lang attribute of the html element (first subtag), source the host of the
    address, text the markup's visible text. Nulls give nulls. A script, style, comment or tag
    that is never closed goes on to the end of the page, as browsers read it; a < before
    anything but a name is text. So no part of a page is read twice, however long it is.
    """
    body = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)", " ")
    return pages.select(
        "*",
        F.regexp_replace(body, r"</?[a-zA-Z!?][^>]*+(?:>|\z)", " ").alias("text"),
        F.nullif(F.lower(F.regexp_extract(F.col(html), r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,8})", 1)), F.lit("")).alias("lang"),
        F.nullif(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit("")).alias("source"),
    )
