"""Hard negatives of anchors by distributed radix selection over integer scores.

Each anchor and positive gives a window of scores, and of the rows of another label within it
the k best are wanted. Each task counts, for each window, how many of its rows fall into each of
BINS score buckets; the sums tell which bucket holds the kth row. That bucket is counted again,
digit by digit, until one score is left; a last pass gathers the rows at or above it. The
positives of an anchor are found in the same way in a window without bounds.

Anchors go along with the tasks in blocks of bounded size and meet all rows where these lie, so
no vector is shuffled and a label or a copy that holds a third of all rows is no hot group. A
task sends its first k buckets or rows of a window only, since no later one can hold the kth.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._columns import discard, materialize
from textloom.sources.shared import new_path

#: Bits of a digit of a score, and the buckets of a window.
BITS = 9
BINS = 1 << BITS
#: Anchors that go along with the tasks at a time, on average; so windows, buckets and what the driver gets are bounded.
BLOCK = 2048
#: Scores that a task holds at a time.
SCORES = 1 << 21
#: Parts into which the gathered rows of a window are dealt before they meet.
SALTS = 32
#: Scores below this are exact in double precision.
EXACT = 1 << 53


@dataclass
class Block:
    """Some anchors: ids, labels and integer vectors, one in each row."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    bound: int

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Integer inner products of rows with the anchors."""
        if self.bound < EXACT:
            return (vectors.astype(np.float64) @ self.vectors.astype(np.float64).T).astype(np.int64)
        return vectors.astype(np.int64) @ self.vectors.astype(np.int64).T


@dataclass
class Windows:
    """Windows [low, high] of scores, each of the anchor ``at``, over rows of its label or of others."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool

    def __len__(self) -> int:
        return len(self.at)

    def slots(self) -> list[np.ndarray]:
        """The windows in groups that hold each anchor once."""
        order = np.argsort(self.at, kind="stable")
        at = self.at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        return [order[place == k] for k in range(int(place.max(initial=-1)) + 1)]


def members(block: Block, windows: Windows, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, window, high - score) of the rows that lie in windows, some at a time."""
    slots = windows.slots()
    step = max(1, SCORES // max(1, len(block.ids)))
    for batch in batches:
        ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        for a in range(0, len(ids), step):
            i, y = ids[a : a + step], labels[a : a + step]
            scores = block.scores(vectors[a : a + step])
            meets = y[:, None] == block.labels[None, :]
            meets = meets & (i[:, None] != block.ids[None, :]) if windows.same else ~meets
            for some in slots:
                at, high = windows.at[some], windows.high[some]
                s = scores[:, at]
                row, column = np.nonzero(meets[:, at] & (s >= windows.low[some]) & (s <= high))
                yield i[row], some[column], high[column] - s[row, column]


def first_of_each(w: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k rows of each window, by v, then id."""
    order = np.lexsort((ids, v, w))
    w, v, ids = w[order], v[order], ids[order]
    some = np.arange(len(w)) - np.searchsorted(w, w) < k
    return w[some], v[some], ids[some]


def kth(rows: DataFrame, block: Block, windows: Windows, k: int) -> np.ndarray:
    """For each window the distance of its kth score from ``high``; its whole width where it has fewer rows."""
    width = windows.high - windows.low
    rounds = max(1, -(-int(width.max(initial=0)).bit_length() // BITS))
    prefix, need = np.zeros(len(windows), np.int64), np.full(len(windows), k, np.int64)
    live = width >= 0
    spark = rows.sparkSession
    for digit in range(rounds - 1, -1, -1):
        shift = digit * BITS
        state = spark.sparkContext.broadcast((block, windows, prefix, need, live))

        def count(batches: Iterator[pa.RecordBatch], state=state, shift=shift) -> Iterator[pa.RecordBatch]:
            block, windows, prefix, need, live = state.value
            total = np.zeros(len(windows) * BINS, np.int64)
            for _, w, v in members(block, windows, batches):
                here = live[w] & (v >> shift >> BITS == prefix[w])
                np.add.at(total, w[here] * BINS + (v[here] >> shift & BINS - 1), 1)
            total = total.reshape(-1, BINS)
            before = np.cumsum(total, axis=1) - total
            w, b = np.nonzero((total > 0) & (before < need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(b), pa.array(total[w, b])], names=["w", "bin", "n"])

        summed = rows.mapInArrow(count, "w long, bin long, n long").groupBy("w", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("w").orderBy("bin"))
        wanted = spark.createDataFrame(pa.table({"w": np.arange(len(windows)), "need": need}))
        met = summed.withColumn("upto", upto).join(F.broadcast(wanted), "w").where("upto >= need and upto - n < need")
        got = met.selectExpr("w", "bin", "upto - n as before").toPandas()
        w = got["w"].to_numpy(np.int64)
        live = np.isin(np.arange(len(windows)), w)
        prefix[w] = prefix[w] << BITS | got["bin"].to_numpy(np.int64)
        need[w] -= got["before"].to_numpy(np.int64)
        state.unpersist()
    return np.where(live, prefix, width)


def best(rows: DataFrame, block: Block, windows: Windows, k: int) -> DataFrame:
    """(w, rank, id, v): the first k rows of each window, by score, then id; v = high - score."""
    limit = kth(rows, block, windows, k)
    state = rows.sparkSession.sparkContext.broadcast((block, windows, limit))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows, limit = state.value
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        for ids, w, v in members(block, windows, batches):
            here = v <= limit[w]
            held = tuple(np.concatenate([x, y[here]]) for x, y in zip(held, (w, v, ids), strict=True))
            if len(held[0]) > 2 * k * len(windows) + SCORES // 8:
                held = first_of_each(*held, k)
        w, v, ids = first_of_each(*held, k)
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(v), pa.array(ids)], names=["w", "v", "id"])

    def firsts() -> Column:
        return F.slice(F.array_sort(F.flatten(F.collect_list("r"))), 1, k).alias("r")

    found = rows.mapInArrow(gather, "w long, v long, id long").withColumn("r", F.array(F.struct("v", "id")))
    some = found.groupBy("w", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).agg(firsts())
    return some.groupBy("w").agg(firsts()).select("w", F.posexplode("r").alias("rank", "x")).selectExpr("w", "rank + 1 as rank", "x.id", "x.v")


def prepared(df: DataFrame, id: str, vector: str, label: str, scale: int) -> tuple[DataFrame, int]:
    """(id, label, vector as integers) of the rows that take part, written; and the square of the greatest norm."""
    usable = F.col("id").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull()
    odd = F.exists("x", lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("y"), F.col(vector).cast("array<double>").alias("x")).where(usable & (F.size("x") > 0)).where(~odd)
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    size = sizes["d"] if sizes else 1
    most = min(2**31 - 1, int((2**62 // size) ** 0.5) - 1)
    whole = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(most))), F.lit(float(-most)))).cast("int"))
    rows = materialize(rows.where(F.size("x") == size).select("id", "y", whole.alias("q")), "vectors")
    norm = F.aggregate("q", F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * c)
    return rows, rows.agg(F.max(norm)).first()[0] or 0


def mine(df: DataFrame, anchors: Column, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, least_percent: int = 80, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all but rank long.

    ``anchors`` tells by ``id`` which rows are anchors. Components become floor(scale * x); a score
    is the integer inner product with the anchor. Positives: the first rows of the anchor's label,
    by score, then smaller id. For each, the first rows of other labels with a score of
    ``least_percent`` % of the positive's or more, and not above it.

    Labels are integers. Rows with a null id, label or vector, an empty vector, a null or
    non-finite component, or a length other than the commonest (of two, the longer) take no
    part. Repeated rows each count; none of the anchor's id is its positive, and rows of one id
    are one anchor (the least by label and vector). Negative scores have empty windows. Components
    are clipped so that scores fit 64 bits. Empty tables, and tables without anchors, give no rows.
    Extra columns are left out, whatever their names.
    """
    spark = df.sparkSession
    rows, square = prepared(df, id, vector, label, scale)
    chosen = rows.where(anchors).groupBy("id").agg(F.min(F.struct("y", "q")).alias("a"))
    blocks = -(-rows.where(anchors).select("id").distinct().count() // BLOCK)
    chosen = materialize(chosen.select("id", "a.y", "a.q", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))).cast("int").alias("block")), "anchors")
    out = new_path(spark, "negatives")
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], columns).write.parquet(out)
    for number in range(blocks):
        got = chosen.where(F.col("block") == number).orderBy("id").select("id", "y", "q").toPandas()
        if not len(got):
            continue
        block = Block(got["id"].to_numpy(np.int64), got["y"].to_numpy(np.int64), np.stack(got["q"].to_numpy()), square)
        a = np.arange(len(got))
        near = Windows(a, np.full(len(got), -square, np.int64), np.full(len(got), square, np.int64), True)
        first = best(rows, block, near, positives).toPandas()
        at, score = first["w"].to_numpy(np.int64), square - first["v"].to_numpy(np.int64)
        hard = Windows(at, -(-least_percent * score // 100), score, False)
        pairs = pa.table({"w": np.arange(len(at)), "anchor_id": block.ids[at], "positive_id": first["id"].to_numpy(np.int64), "positive_score": score})
        found = best(rows, block, hard, negatives).join(F.broadcast(spark.createDataFrame(pairs)), "w")
        found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", (F.col("positive_score") - F.col("v")).alias("negative_score")).write.mode("append").parquet(out)
    discard(rows, chosen)
    return spark.read.schema(columns).parquet(out)


def oracle(table: str = "embeddings") -> str:
    """DuckDB SQL of op11's rows."""
    return f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM {table} WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.y = r.y AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS s
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, s AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, s AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * s AND s <= positive_score
QUALIFY rank <= 5
"""
