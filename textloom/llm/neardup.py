"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of five-word shingles. Sets that are equal form one class. Bands of
the classes' MinHash signatures give candidate buckets; within a bucket, signatures are
compared batch by batch, and a pair is dropped as soon as the posterior probability that
it reaches the threshold falls below the chosen miss probability. Survivors are verified
exactly on their full sets.

Links are needed only as far as they connect. First the spanning forest of greatest
estimated similarity of each bucket's survivors is verified. A bucket of more than BLOCK
members is cut into blocks in a ring; each is compared with itself and the next. That
joins copies, and leaves pairs that are never in one small bucket: these meet again in
narrower bands of SUB_ROWS hashes, as many as the miss probability asks for, and only where
such a bucket holds members that are not joined yet. The forests' components are
clusters; where a cluster falls into several components of verified links, the pairs
between these are compared in blocks, verified in the tasks that hold them, and again only
a spanning forest is handed on. So a large group of near copies, or a passage that many
different documents share, makes rows by its members, not by its pairs, and no link between
different components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm._columns import discard, hot_keys, materialize, spread_join
from textloom.llm._text import U64, Rows, grams, mix, ranges, slices, span_hash, words
from textloom.llm.components import smallest_reachable

SHINGLE = 5
HASHES = 256
#: 25 bands of 5 hashes miss a pair of similarity 0.85 with probability 4e-7 (0.8: 5e-5).
BANDS, BAND_ROWS = 25, 5
STAGES = (64, 128, 192, 256)
#: A bucket of more members is cut into blocks of about this size.
BLOCK = 256
MISS = 1e-5
#: Hashes of a narrow band; a pair at the threshold misses all narrow bands with the miss probability.
SUB_ROWS = 8


def shingle_sets(rows: Rows) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row; A-Z are lower-cased first."""
    w = words(rows.lowered())
    h, at = grams(w, SHINGLE)
    begin = np.searchsorted(at, w.first)
    counts = w.counts
    for k in range(len(rows)):
        if counts[k] >= SHINGLE:
            yield np.unique(h[begin[k] : begin[k + 1]])
        elif counts[k]:
            a, b = w.first[k], w.first[k + 1]
            yield span_hash(w.hash[a:b], np.array([0]), np.array([b - a]), 1)
        else:
            yield np.zeros(0, U64)


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240501)
    return draw.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signature(values: np.ndarray) -> np.ndarray:
    """HASHES minima of a set of 64-bit hashes, as uint32."""
    a, b = _family()
    low, high = (values & U64(0xFFFFFFFF)).astype(np.uint32), (values >> U64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(values), 1024):  # a table of hashes by values, small enough for the cache
        v = low[k : k + 1024] * a[:, None]
        v += b[:, None]
        v ^= high[k : k + 1024]
        v *= np.uint32(0x85EBCA6B)
        np.minimum(out, v.min(1), out=out)
    return out


def fingerprints(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n, h1, h2, sig, bands): set size, 128-bit set hash, signature bytes, band keys.

    sig has the low byte of each minimum. Rows without words have n = 0 and no sig.
    """
    schema = T.StructType(
        [T.StructField("doc_id", df.schema[doc_id].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("n", "h1", "h2")]
        + [T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch.column(1)):
                n, h1, h2, sig, bands = [], [], [], [], []
                for values in shingle_sets(rows):
                    n.append(len(values))
                    if not len(values):
                        h1.append(None), h2.append(None), sig.append(None), bands.append(None)
                        continue
                    ends = np.array([0]), np.array([len(values)])
                    h1.append(int(span_hash(values, *ends, 0)[0].astype(np.int64)))
                    h2.append(int(span_hash(mix(values), *ends, 2)[0].astype(np.int64)))
                    s = signature(values)
                    sig.append(s.astype(np.uint8).tobytes())
                    lines = s[: BANDS * BAND_ROWS].astype(np.uint64)
                    at = np.arange(BANDS) * BAND_ROWS
                    bands.append(span_hash(lines, at, at + BAND_ROWS, 1).astype(np.int64))
                ids = batch.column(0).slice(rows.first, len(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=schema.names)

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")).mapInArrow(run, schema)


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For each stage, the fewest matches at which P(similarity >= threshold | matches) >= miss.

    The prior of the similarity is uniform; equal bytes of unequal minima are allowed for.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = []
    for n in STAGES:
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        post = np.exp(log - log.max(1, keepdims=True))
        tail = post[:, s >= threshold].sum(1) / post.sum(1)
        out.append(int(np.argmax(tail >= miss)))
    return tuple(out)


def surviving_pairs(sig: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, miss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of ``sig`` left after every stage, and their matches."""
    matches, at = np.zeros(len(left), np.int32), 0
    for end, least in zip(STAGES, least_matches(threshold, miss), strict=True):
        matches = matches + (sig[left, at:end] == sig[right, at:end]).sum(1)
        keep = matches >= least
        left, right, matches = left[keep], right[keep], matches[keep]
        at = end
    return left, right, matches


def spanning_forest(n: int, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of the edges of a forest of greatest weight (Boruvka's rounds, whole arrays)."""
    order = np.lexsort((right, left, -weight))
    a, b = left[order], right[order]
    label, chosen = np.arange(n), np.zeros(len(a), bool)
    rank = np.arange(len(a))
    while True:
        la, lb = label[a], label[b]
        live = la != lb
        if not live.any():
            return order[chosen]
        best = np.full(n, len(chosen))
        np.minimum.at(best, la[live], rank[live])
        np.minimum.at(best, lb[live], rank[live])
        pick = np.unique(best[best < len(chosen)])
        chosen[rank.searchsorted(pick)] = True
        parent = np.arange(n)
        x, y = label[a[pick]], label[b[pick]]
        while True:  # labels of the merged trees: smallest label over the picked edges
            low = np.minimum(parent[x], parent[y])
            before = parent.copy()
            np.minimum.at(parent, x, low)
            np.minimum.at(parent, y, low)
            parent = parent[parent]
            if (before == parent).all():
                break
        label = parent[label]


KEYS = ("band", "key", "i", "j")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def by_groups(blocks: DataFrame, columns: list[str], function: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``function`` over the rows of ``blocks``, some whole groups (rows of equal KEYS) at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            # hold back the last group: it may go on in the next batch
            last = [batch.column(k)[len(batch) - 1].as_py() for k in range(4)]
            same = np.logical_and.reduce([batch.column(k).to_numpy() == v for k, v in enumerate(last)])
            cut = len(batch) - int(same.sum())
            if cut or (held and any(held[-1].column(k)[len(held[-1]) - 1].as_py() != v for k, v in enumerate(last))):
                whole = pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
                if len(whole):
                    yield function(whole)
            held.append(batch.slice(cut))
        if held:
            yield function(pa.Table.from_batches(held))

    spread = blocks.repartition(*KEYS).sortWithinPartitions(*KEYS, "rep").select(*KEYS, *columns)
    return spread.mapInArrow(run, schema)


def survivors(table: pa.Table, threshold: float, miss: float, percent: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of whole groups (KEYS, own, rep, comp, sig, and set with ``percent``) that survive, and their matches."""
    group = [table.column(k).to_numpy() for k in range(4)]
    block, rep, comp = (table.column(k).to_numpy() for k in (4, 5, 6))
    sig = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint8).reshape(-1, HASHES)
    sets = [np.frombuffer(x, np.uint64) for x in table.column(8).to_pylist()] if percent else []
    change = np.ones(len(rep), bool)
    change[1:] = np.logical_or.reduce([g[1:] != g[:-1] for g in group])
    start = np.flatnonzero(change)
    size = np.diff(np.append(start, len(rep)))
    after = np.repeat(start + size, size) - np.arange(len(rep)) - 1
    found = [[], [], []]
    at = 0
    while at < len(rep):  # in pieces of about 2^18 pairs
        to = max(at + 1, int(np.searchsorted(np.cumsum(after[at:]), 1 << 18, "right")) + at)
        left = np.repeat(np.arange(at, to), after[at:to])
        right = ranges(np.arange(at, to) + 1, after[at:to])
        # a pair within one block of several belongs to the group of that block alone
        keep = (comp[left] != comp[right]) & ((group[2][left] == group[3][left]) | (block[left] != block[right]))
        got = surviving_pairs(sig, left[keep], right[keep], threshold, miss)
        if percent:
            ok = np.array([100 * (c := common(sets[x], sets[y])) >= percent * (len(sets[x]) + len(sets[y]) - c) for x, y in zip(got[0], got[1], strict=True)], bool)
            got = tuple(g[ok] for g in got)
        for out, g in zip(found, got, strict=True):
            out.append(g)
        at = to
    return tuple(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in found)


def compared(blocks: DataFrame, threshold: float, miss: float, percent: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b: spanning forests of the pairs that survive within each group.

    blocks: KEYS, own, rep, comp, sig and, if ``percent`` is given, set. A group is the rows
    of equal KEYS: one block of a bucket (i = j) or two. Pairs within one ``comp`` are left
    out. Survivors of the signatures are verified on the sets if they are there.
    """

    def pairs(table: pa.Table) -> pa.RecordBatch:
        rep = table.column(5).to_numpy()
        left, right, matches = survivors(table, threshold, miss, percent)
        if len(left):
            pick = spanning_forest(len(rep), left, right, matches)
            left, right = left[pick], right[pick]
        a, b = np.minimum(rep[left], rep[right]), np.maximum(rep[left], rep[right])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return by_groups(blocks, ["own", "rep", "comp", "sig", *(["set"] if percent else [])], pairs, "a long, b long").distinct()


def met(blocks: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The rows of ``blocks`` (KEYS, own, rep, comp) that survive with another by their signatures: only these need their sets."""

    def rows(table: pa.Table) -> pa.RecordBatch:
        left, right, _ = survivors(table, threshold, miss)
        some = table.select([*KEYS, "own", "rep", "comp"]).take(pa.array(np.union1d(left, right), pa.int64())).combine_chunks()
        return some.to_batches()[0] if len(some) else pa.RecordBatch.from_pylist([], some.schema)

    types = dict(blocks.dtypes)
    return by_groups(blocks, ["own", "rep", "comp", "sig"], rows, ", ".join(f"{c} {types[c]}" for c in (*KEYS, "own", "rep", "comp")))


def bucket_blocks(buckets: DataFrame, sigs: DataFrame) -> DataFrame:
    """Groups for :func:`compared`, one for each bucket; large buckets are cut into a ring of blocks.

    Each block is compared with itself and the next, so a member is there three times at most.
    """
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", "band"), F.col("parts")).cast("int")
    blocks = buckets.withColumn("parts", parts).withColumn("own", own)
    others = F.array_distinct(F.array("own", F.pmod(F.col("own") + 1, F.col("parts")), F.pmod(F.col("own") - 1, F.col("parts"))))
    blocks = blocks.select("band", "key", "rep", "own", F.explode(others).alias("other"))
    blocks = blocks.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", F.col("rep").alias("comp"))
    return blocks.join(sigs.hint("merge"), "rep")


@lru_cache(maxsize=4)
def sub_picks(threshold: float, miss: float) -> np.ndarray:
    """Positions of the signature that make up each narrow band."""
    count = int(np.ceil(np.log(miss) / np.log1p(-(threshold**SUB_ROWS))))
    draw = np.random.default_rng(8)
    return np.stack([draw.choice(HASHES, SUB_ROWS, replace=False) for _ in range(count)])


def sub_keys(sig: Column, threshold: float, miss: float) -> Column:
    """Keys of the narrow bands of a signature."""

    def run(column: pa.Array) -> pa.Array:
        picks = sub_picks(threshold, miss)
        out = []
        for at in range(0, len(column), 1024):
            some = np.frombuffer(b"".join(column.slice(at, 1024).to_pylist()), np.uint8).reshape(-1, HASHES)
            lines = some[:, picks.ravel()].ravel().astype(np.uint64)
            start = np.arange(0, len(lines), SUB_ROWS)
            out.append(span_hash(lines, start, start + SUB_ROWS, 1).astype(np.int64))
        flat = np.concatenate([*out, np.zeros(0, np.int64)])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * len(picks), pa.int32()), pa.array(flat))

    return F.arrow_udf(run, "array<long>")(sig)


def narrow_groups(buckets: DataFrame, sigs: DataFrame, near: DataFrame, threshold: float, miss: float) -> tuple[DataFrame, list[DataFrame]]:
    """(band, key, comp, rep), and the tables that it reads: narrow buckets of the members of large buckets that hold several components of ``near``.

    A member is in as many as there are narrow bands. While these hold fewer than BLOCK
    different pages the rows grow with the members; beyond that, with pairs of blocks.
    """
    hot = buckets.where(F.col("size") > BLOCK).select("rep").distinct()
    labels = smallest_reachable(near)
    joined = labels.withColumnsRenamed({"node": "rep", "component": "comp"})
    keys = sigs.join(hot.hint("merge"), "rep").select("rep", F.posexplode(sub_keys(F.col("sig"), threshold, miss)).alias("band", "key"))
    rows = materialize(keys.join(joined.hint("merge"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "narrow")
    mixed = rows.groupBy("band", "key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("band", "key")
    discard(labels)
    return rows.join(mixed.hint("merge"), ["band", "key"]).select("band", "key", "comp", "rep"), [rows]


def component_blocks(members: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Groups of the components that share a (band, key): (KEYS, own, rep, comp) from (band, key, comp, rep), and the tables that they read.

    A component larger than BLOCK has blocks of its own, which are not compared with each
    other; smaller ones share blocks. So a group that is one component needs nothing, and
    one with few outliers meets them with each of its members once.
    """
    by = ["band", "key"]
    sizes = members.groupBy(*by, "comp").agg(F.count("*").alias("n")).withColumn("big", F.col("n") > BLOCK)
    parts = F.when(F.col("big"), F.ceil(F.col("n") / BLOCK)).otherwise(0).cast("int")
    sizes = materialize(sizes.withColumn("parts", parts), "sizes")
    groups = sizes.groupBy(*by).agg(F.ceil(F.sum(F.when(~F.col("big"), F.col("n")).otherwise(0)) / BLOCK).cast("int").alias("shared"), F.sum("parts").cast("int").alias("own_blocks"), F.count("*").alias("comps")).where("comps > 1")
    before = F.sum("parts").over(Window.partitionBy(*by).orderBy("comp")) - F.col("parts")
    placed = sizes.where("big").withColumn("before", before).select(*by, "comp", "parts", "before")  # big components: a 256th of the rows
    rows = members.join(groups, by).join(placed, [*by, "comp"], "left")
    low = (F.col("shared") + F.col("before")).cast("int")
    own = F.coalesce(low + F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("comp"), F.col("shared")).cast("int"))
    rows = rows.select(*by, "comp", "rep", own.alias("own"), low.alias("low"), (low + F.col("parts")).alias("high"), (F.col("shared") + F.col("own_blocks")).alias("total"))
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda x: F.coalesce((x < F.col("low")) | (x >= F.col("high")), F.lit(True)))
    rows = rows.select(*by, "comp", "rep", "own", F.explode(others).alias("other"))
    return rows.select(*by, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "comp"), [sizes]


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets satisfy 100 * intersection >= percent * union."""

    def shared(x: pa.Array, y: pa.Array) -> pa.Array:
        both = zip(x.to_pylist(), y.to_pylist(), strict=True)
        return pa.array([common(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in both], pa.int64())

    one = sets.select(F.col("rep").alias("a"), F.col("set").alias("__a"))
    two = sets.select(F.col("rep").alias("b"), F.col("set").alias("__b"))
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").withColumn("__n", F.arrow_udf(shared, "long")("__a", "__b"))
    union = (F.octet_length("__a") + F.octet_length("__b")) / 8 - F.col("__n")
    return both.where(100 * F.col("__n") >= percent * union).select("a", "b")


def components(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", percent: int = 85, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``df``.

    Two documents are linked if 100 * intersection >= percent * union of their shingle
    sets; component_id is the smallest id reachable over links, kept tells whether it is
    the document's own. A text of fewer than five words is one shingle; a null or empty
    text has none and is linked with nothing. Rows of one id count as one document (so
    repeated rows share their fate). Rows with a null id are linked with nothing, have a
    null component_id and are kept. Other columns are left out, whatever their names.
    ``percent`` may be 70 to 100: the bands are laid out for such similarities.
    """
    threshold = percent / 100
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = materialize(fingerprints(rows), "fingerprints")
    linked = prints.where("n > 0 and doc_id is not null")
    classes = materialize(linked.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    copied = hot_keys(classes, ["h1", "h2"], prints.count())
    classes = classes.drop("n")
    reps = linked.join(classes.withColumnRenamed("rep", "doc_id").hint("merge"), ["h1", "h2", "doc_id"]).select(F.col("doc_id").alias("rep"), "sig", "bands")
    reps = materialize(reps.dropDuplicates(["rep"]), "classes")
    banded = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    multi = banded.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = materialize(banded.join(multi.hint("merge"), ["band", "key"]), "buckets")
    members = buckets.select("rep").distinct()
    sigs = materialize(reps.select("rep", "sig").join(members.hint("merge"), "rep"), "signatures")
    sets = materialize(shingle_table(rows.join(members.hint("merge"), F.col("doc_id") == F.col("rep"), "left_semi")), "sets")

    first = materialize(compared(bucket_blocks(buckets, sigs), threshold, miss), "near")
    narrow, read = narrow_groups(buckets, sigs, first, threshold, miss)
    apart, also = component_blocks(narrow)
    near = materialize(first.unionAll(compared(apart.join(sigs.hint("merge"), "rep"), threshold, miss)).distinct(), "near")
    discard(buckets, first, *read, *also)
    links = materialize(verified(near, sets, percent), "links")
    clusters, found = smallest_reachable(near), smallest_reachable(links)
    named = clusters.withColumnRenamed("component", "super").withColumnRenamed("node", "rep")
    parts = materialize(named.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("super", F.coalesce("component", "rep").alias("comp"), "rep"), "parts")
    discard(near, clusters, found)
    again, read = component_blocks(parts.select(F.lit(0).alias("band"), F.col("super").alias("key"), "comp", "rep"))
    # signatures by themselves first; sets go to the rows that are left
    some = materialize(met(again.join(sigs.hint("merge"), "rep"), threshold, miss), "met")
    more = materialize(compared(some.join(sigs.hint("merge"), "rep").join(sets.hint("merge"), "rep"), threshold, miss, percent), "links")
    found = smallest_reachable(links.unionAll(more))

    labelled = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    labelled = materialize(labelled, "labelled")
    out = spread_join(prints.select("doc_id", "n", "h1", "h2"), labelled, ["h1", "h2"], copied, "left")
    discard(reps, sigs, sets, links, parts, some, more, found, *read)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def shingle_table(rows: DataFrame) -> DataFrame:
    """(rep, set): the sorted shingle hashes of each row, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                found = [s.tobytes() for s in shingle_sets(part)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.array(found, pa.binary())], names=["rep", "set"])

    return rows.select("doc_id", "text").mapInArrow(run, "rep long, set binary")


def oracle(table: str = "documents", percent: int = 85) -> str:
    """DuckDB SQL of op6's rows, pair by pair over common shingles."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE split AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= {SHINGLE}
    THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM split)
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= {percent} * (s.n + t.n - c)
), reach AS (
  SELECT doc_id, doc_id AS r FROM {table} UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = r
), component AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM {table} d JOIN component USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
