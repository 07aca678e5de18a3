"""Substring deduplication: winnowed seeds, extended both ways to maximal repeats.

Seeds. Every window of WINDOW words picks one anchor: the smallest k-gram hash in it,
the rightmost of equals. Equal windows pick equal anchors, so documents that share a
window meet when they are joined on anchors. Consecutive windows with the same anchor
are one block, about one for twenty words.

Extension. Blocks of equal content are one; a block whose anchor has no other block is
matched as a whole. Where an anchor has several blocks, each distinct block is extended
from the anchor to both sides, window by window: windows of equal content are grouped
and get the smallest document they start in. A passage that thousands of documents
share is so extended once for each distinct surrounding, never pair by pair. Anchors,
blocks and windows that hold a large share of all rows are joined by broadcast of their
few keys, so a passage on every page makes no large task.

Maximal repeats are the unions of the windows found in an earlier document, so none is
shorter than WINDOW words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm._columns import discard, hot_keys, materialize, split_by_slots, spread_join
from textloom.llm._text import U64, Words, ranges, slices, span_hash, words

WINDOW = 50
GRAM = 10


def rightmost_minimum(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the index of its smallest, the rightmost of equals."""
    at = np.arange(len(g))
    step = 1
    while 2 * step <= width:
        a, b = at[:-step], at[step:]
        at = np.where(g[b] <= g[a], b, a)
        step *= 2
    if step < width:
        a, b = at[: len(at) - (width - step)], at[width - step :]
        at = np.where(g[b] <= g[a], b, a)
    return at


def blocks_of(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash) of each block."""
    n = len(w) - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty.astype(U64)
    start = np.arange(len(w) - gram + 1)
    g = span_hash(w.hash, start, start + gram, 1)
    anchor = rightmost_minimum(g, window - gram + 1)[:n]
    valid = w.row[:n] == w.row[window - 1 :]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (w.row[1:n] != w.row[: n - 1])
    s = np.flatnonzero(new)
    number = np.cumsum(new)
    count = np.bincount(number[valid], minlength=len(s) + 1)[1:]
    return s, count, g[anchor[s]]


def two_hashes(w: Words, other: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each run of words; ``other`` is a second hash of the words themselves."""
    return span_hash(w.hash, start, end, 0).astype(np.int64), span_hash(other, start, end, 2).astype(np.int64)


def seeds(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, mark, s, c, a, b1, b2): blocks of each document: first window, windows, anchor, content."""
    schema = "id long, mark int, s int, c int, a long, b1 long, b2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in slices(batch.column(2)):
                w = words(part)
                s, c, a = blocks_of(w, window, gram)
                b1, b2 = two_hashes(w, span_hash(part.data, w.start, w.end, 1), s, s + c + window - 1)
                row = w.row[s]
                columns = ids[part.first + row], marks[part.first + row], (s - w.first[row]).astype(np.int32), c.astype(np.int32), a.astype(np.int64), b1, b2
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["id", "mark", "s", "c", "a", "b1", "b2"])

    return rows.where("id is not null").select("id", "mark", "text").mapInArrow(run, schema)


def _lists(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Lengths and flat fields of a list<struct> column; nulls are empty lists."""
    size = np.array(column.value_lengths().fill_null(0))
    flat = column.flatten()
    return size, {n: flat.field(k).to_numpy(zero_copy_only=False) for k, n in enumerate(names)}


def extended(texts: DataFrame, window: int) -> DataFrame:
    """(b1, b2, off, w1, w2, first): every window of each block; texts: text, blocks list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, flat = _lists(batch.column(1), ("s", "c", "b1", "b2", "first"))
            ends = np.cumsum(size)
            for part in slices(batch.column(0)):
                w = words(part)
                lo, hi = ends[part.first] - size[part.first], ends[part.first + len(part) - 1]
                row = np.repeat(np.arange(len(part)), size[part.first : part.first + len(part)])
                s, c = flat["s"][lo:hi] + w.first[row], flat["c"][lo:hi]
                which = np.repeat(np.arange(lo, hi), c)
                start = ranges(s.astype(np.int64), c.astype(np.int64))
                w1, w2 = two_hashes(w, span_hash(part.data, w.start, w.end, 1), start, start + window)
                off = (start - np.repeat(s, c)).astype(np.int32)
                columns = flat["b1"][which], flat["b2"][which], off, w1, w2, flat["first"][which]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["b1", "b2", "off", "w1", "w2", "first"])

    return texts.select("text", "blocks").mapInArrow(run, "b1 long, b2 long, off int, w1 long, w2 long, first long")


def earlier_windows(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, mark, found): windows of each document that also start in one of a smaller id.

    found is a list of (s, c): c windows from word s on.
    """
    made = materialize(seeds(rows, window, gram), "seeds")
    total = made.count()
    anchors = materialize(made.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    # seeds that meet another
    cuts = materialize(spread_join(made, anchors.select("a"), ["a"], hot_keys(anchors, ["a"], total)), "meeting")
    discard(made, anchors)
    blocks = materialize(cuts.groupBy("a", "b1", "b2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")), "blocks")
    several = materialize(blocks.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"), "several")
    hot = hot_keys(several, ["a"], blocks.count())
    differing = materialize(spread_join(blocks, several.select("a"), ["a"], hot).select("b1", "b2", "first"), "differing")
    whole = spread_join(blocks.where("last > first"), several.select("a"), ["a"], hot, "left_anti").select("b1", "b2", "first")
    copied = hot_keys(blocks, ["b1", "b2"], total)

    # each distinct block that needs it, in the document where it comes first
    once = cuts.join(differing.withColumnRenamed("first", "id").hint("merge"), ["b1", "b2", "id"]).dropDuplicates(["b1", "b2"])
    once = once.groupBy("id", "mark").agg(F.collect_list(F.struct("s", "c", "b1", "b2", F.col("id").alias("first"))).alias("blocks"))
    once = materialize(once, "once")
    hosts, _ = split_by_slots(rows, once, "id")
    windows = materialize(extended(hosts.join(once.hint("merge"), ["id", "mark"]), window), "windows")
    earliest = materialize(windows.groupBy("w1", "w2").agg(F.min("first").alias("earliest"), F.count("*").alias("n")), "earliest")
    common = hot_keys(earliest, ["w1", "w2"], windows.count())
    parts = spread_join(windows, earliest.drop("n"), ["w1", "w2"], common).groupBy("b1", "b2").agg(F.min("first").alias("first"), F.collect_set(F.struct("off", "earliest")).alias("parts"))
    known = whole.select("b1", "b2", "first", F.lit(None).cast("array<struct<off:int,earliest:bigint>>").alias("parts")).unionByName(parts)

    some = F.transform(F.filter("parts", lambda p: p["earliest"] < F.col("id")), lambda p: F.struct((F.col("s") + p["off"]).alias("s"), F.lit(1).alias("c")))
    every = F.when(F.col("first") < F.col("id"), F.array(F.struct("s", "c")))
    known = materialize(known, "known")
    discard(windows, earliest)
    met = spread_join(cuts, known, ["b1", "b2"], copied).select("id", "mark", F.coalesce(some, every).alias("found")).where("size(found) > 0")
    return met.groupBy("id", "mark").agg(F.flatten(F.collect_list("found")).alias("found"))


def deduplicate(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_text), one row for each row of ``df``.

    A word goes if it lies in a window of ``window`` words whose sequence also starts in a
    document of a smaller id; windows are judged on the input. removed lists the maximal
    runs (start, end) of removed words, kept_text the kept words joined by one space.
    Words are runs without the white space U+0009 to U+000D and U+0020; a null text has
    none. Repeats within one document, and between rows of one id, are not removed. Rows
    with a null id are compared with nothing and stay whole. Repeated rows each get their
    row. Other columns are left out, whatever their names.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.hash(F.col(text)).alias("mark"), F.col(text).alias("text"))
    found = materialize(earlier_windows(rows, window, gram), "repeats")
    some, none = split_by_slots(rows, found, "id")
    joined = some.join(found.hint("merge"), ["id", "mark"], "left").select("id", "text", "found")
    joined = joined.unionByName(none.select("id", "text", F.lit(None).cast(found.schema["found"].dataType).alias("found")))
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", spans), T.StructField("kept_text", T.StringType())]
    )
    arrow = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, flat = _lists(batch.column(2), ("s", "c"))
            ends = np.cumsum(size)
            for part in slices(batch.column(1)):
                w = words(part)
                n = len(w)
                lo, hi = ends[part.first] - size[part.first], ends[part.first + len(part) - 1]
                row = np.repeat(np.arange(len(part)), size[part.first : part.first + len(part)])
                start = flat["s"][lo:hi] + w.first[row]
                stop = start + flat["c"][lo:hi] + window - 1
                depth = np.bincount(start, minlength=n + 1) - np.bincount(stop, minlength=n + 1)
                gone = np.cumsum(depth)[:n] > 0
                # runs of removed words, cut where a row ends
                cut = np.zeros(n + 1, bool)
                cut[w.first] = True
                begins = np.flatnonzero(gone & (cut[:n] | ~np.concatenate([[False], gone])[:n]))
                finish = np.flatnonzero(gone & (cut[1:] | ~np.concatenate([gone, [False]])[1:])) + 1
                home = w.row[begins] if n else begins
                bounds = np.searchsorted(home, np.arange(len(part) + 1))
                runs = pa.StructArray.from_arrays([pa.array((begins - w.first[home]).astype(np.int32)), pa.array((finish - w.first[home]).astype(np.int32))], fields=list(arrow))
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(w.first[:-1], n)) * (w.counts > 0)
                kept = np.flatnonzero(~gone)
                # kept words and one space between them, as one buffer
                length = w.end[kept] - w.start[kept]
                last = np.ones(len(kept), bool)
                last[:-1] = w.row[kept][1:] != w.row[kept][:-1]
                room = length + ~last
                before = np.cumsum(room) - room
                data = np.full(int(room.sum()), 32, np.uint8)
                data[ranges(before, length)] = part.data[ranges(w.start[kept], length)]
                text_ends = np.bincount(w.row[kept], weights=room, minlength=len(part)).astype(np.int64).cumsum()
                texts = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(np.concatenate([[0], text_ends]).astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
                ids = batch.column(0).slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([ids, pa.array(w.counts), pa.array(removed), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), texts], names=schema.names)

    return joined.mapInArrow(run, schema)


def oracle(table: str = "documents", window: int = WINDOW) -> str:
    """DuckDB SQL of op1's rows: every window of every document."""
    return f"""
WITH split AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}
), windows AS MATERIALIZED (
  SELECT doc_id, s, md5(array_to_string(w[s : s + {window - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS s FROM split WHERE len(w) >= {window})
), firsts AS (SELECT h, min(doc_id) AS f FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, s + d AS p FROM windows JOIN firsts USING (h), (SELECT unnest(range(0, {window})) AS d) WHERE f < doc_id
), lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY 1
), numbered AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM split
), kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM numbered ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT split.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
