"""Vector near-duplicates of one label by product quantisation.

A coarse quantiser deals vectors to inverted lists, and the residual in a list is coded in
subspaces. A vector is a member of its nearest list, and its code is entered in every list
that a near-duplicate of it may be a member of (the probes). So vectors stay, and only codes,
some tens of bytes each, travel. In a list, each member's table of inner products with the code
words gives its distances to all entries; an entry is dropped where even its own error of
quantisation can't bring it within reach. What is left, few rows unless there are duplicates,
fetches its vectors for the exact cosine in double precision. Tasks hand on counts of links and
a star for each component, never pairs.

A group of near copies that holds a good part of all rows would still meet itself in full.
Its densest balls are found in the sample: two vectors within half the threshold's angle of
a centre are linked whatever they are, so the members of a ball are counted, not compared. By
its angle to the centre and the ball's radius another vector is linked with all of a ball, with
none of it, or is at its boundary; only the last are compared with its members, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm._columns import discard, materialize, sampled
from textloom.llm.components import smallest_reachable

#: Rows, at most, that the quantisers are fitted on.
SAMPLE = 20_000
#: Bounds of the number of lists; between them the root of the number of rows.
LISTS = (4, 4096)
#: Dimensions of a subspace, and code words of each.
WIDTH, WORDS = 8, 256
#: Probes reach lists that a vector at the threshold is nearest to with this many standard deviations of a random direction.
DEVIATIONS = 4.0
#: A ball holds at least one in BALL of the sample's rows, and at least BALL_ROWS of them.
BALL, BALL_ROWS = 400, 32
#: Members of a list, and entries, that are compared at a time.
MEMBERS, ENTRIES = 1024, 2048
#: Room for rounding.
TINY = 1e-9


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([np.zeros(0, np.int64), *((x[a : a + 2048] @ centres.T - half).argmax(1) for a in range(0, len(x), 2048))])


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres of Lloyd's rounds from random distinct rows; a centre without rows stays."""
    start = np.unique(x, axis=0)
    centres = start[rng.permutation(len(start))[:k]]
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def balls_of(x: np.ndarray, labels: np.ndarray, inner: float) -> tuple[np.ndarray, np.ndarray]:
    """(centres, labels) of the balls of cosine ``inner`` that hold enough of the sample's rows."""
    least = max(BALL_ROWS, len(x) // BALL)
    centres, of = [np.zeros((0, x.shape[1]))], []
    for y in np.unique(labels):
        rows = x[labels == y]
        if len(rows) < least:
            continue
        n = np.concatenate([(rows[a : a + 1024] @ rows.T >= inner).sum(1) for a in range(0, len(rows), 1024)])
        while len(rows) and n.max() >= least:
            near = rows @ rows[n.argmax()] >= inner
            centre = rows[near].mean(0)
            centre /= np.linalg.norm(centre)
            inside = rows @ centre >= inner
            if inside.sum() >= near.sum():
                near = inside
            else:
                centre = rows[n.argmax()]
            centres.append(centre[None])
            of.append(y)
            gone = rows[near]
            n = np.concatenate([n[a : a + 1024] - (rows[a : a + 1024] @ gone.T >= inner).sum(1) for a in range(0, len(rows), 1024)])[~near]
            rows = rows[~near]
    return np.concatenate(centres), np.array(of, np.int64)


@dataclass
class Model:
    """Centres of lists and code words, and centres of balls; bounded in size by the constants above."""

    least: float
    lists: np.ndarray
    words: list[np.ndarray]
    balls: np.ndarray
    ball_labels: np.ndarray

    @property
    def reach(self) -> float:
        """The distance of unit vectors at the threshold."""
        return float(np.sqrt(max(0.0, 2 - 2 * self.least)))

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.words), axis=1)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, probes as a matrix, codes, squared norm of the decoded vector, error) of unit vectors."""
        inner = x @ self.lists.T
        score = inner - 0.5 * (self.lists**2).sum(1)
        home = score.argmax(1)
        apart = np.linalg.norm(self.lists[:, None, :] - self.lists[None, :, :], axis=2) if len(self.lists) <= 512 else None
        gap = apart[home] if apart is not None else np.sqrt(np.maximum(0, (self.lists[home] ** 2).sum(1)[:, None] - 2 * self.lists[home] @ self.lists.T + (self.lists**2).sum(1)))
        probes = score[np.arange(len(x)), home][:, None] - score <= DEVIATIONS * self.reach / np.sqrt(x.shape[1]) * gap
        residual = x - self.lists[home]
        codes = np.stack([nearest(r, w) for r, w in zip(self.parts(residual), self.words, strict=True)], axis=1).astype(np.uint8)
        decoded = self.lists[home] + np.concatenate([w[codes[:, k]] for k, w in enumerate(self.words)], axis=1)
        return home, probes, codes, (decoded**2).sum(1), np.linalg.norm(x - decoded, axis=1)

    def distances(self, x: np.ndarray, home: np.ndarray, codes: np.ndarray, square: np.ndarray) -> np.ndarray:
        """Squared distances of unit vectors to coded ones, by table look-up."""
        inner = (x @ self.lists.T)[:, home]
        for k, part in enumerate(self.parts(x)):
            inner += (part @ self.words[k].T)[:, codes[:, k]]
        return 1 + square - 2 * inner

    def ball(self, x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The nearest ball of the label that holds each vector, or -1."""
        if not len(self.balls):
            return np.full(len(x), -1)
        cosine = np.where(labels[:, None] == self.ball_labels[None, :], x @ self.balls.T, -2)
        return np.where(cosine.max(1) >= self.inner, cosine.argmax(1), -1)

    @property
    def inner(self) -> float:
        """Cosine of half the threshold's angle: vectors as near as this to one centre are linked."""
        return float(np.cos(np.arccos(self.least) / 2)) + TINY


def fit(sample: pa.Table, total: int, least: float) -> Model:
    """A model for ``total`` rows from a sample (id, y, x) of them."""
    rng = np.random.default_rng(0)
    sample = sample.sort_by([("id", "ascending"), ("y", "ascending")])
    x, labels = unit(matrix(sample["x"])), numbers(sample["y"])
    k = int(min(LISTS[1], max(LISTS[0], 2 ** round(np.log2(max(1, total)) / 2))))
    lists = k_means(x, k, rng)
    residual = x - lists[nearest(x, lists)]
    words = [k_means(r, WORDS, rng) for r in np.array_split(residual, max(1, x.shape[1] // WIDTH), axis=1)]
    balls, of = balls_of(x, labels, float(np.cos(np.arccos(least) / 2)) + TINY)
    return Model(least, lists, words, balls, of)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def stars(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges from each linked id to the smallest of its component within a block of links."""
    most = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    some, other = linked.any(1), linked.any(0)
    while True:
        x = np.minimum(a, np.where(linked, b[None, :], most).min(1, initial=most))
        y = np.minimum(b, np.where(linked, x[:, None], most).min(0, initial=most))
        if (x == a).all() and (y == b).all():
            break
        a, b = x, y
    yield left[some], a[some]
    yield right[other], b[other]


COUNTS = "kind int, a long, b long"
#: Kinds of rows of COUNTS: links of a row (a: rid), an edge of two ids, links of all of a ball, a row at the boundary of a ball.
LINKS, EDGE, BALL_LINKS, BOUNDARY = range(4)


def counted(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    kind = np.concatenate([np.zeros(0, np.int32), *(np.full(len(a), k, np.int32) for k, a, _ in parts)])
    a, b = (np.concatenate([np.zeros(0, np.int64), *(p[i].astype(np.int64) for p in parts)]) for i in (1, 2))
    return pa.table({"kind": pa.array(kind, pa.int32()), "a": a, "b": b})


def compare(least: float, left: pa.Table, right: pa.Table, both: np.ndarray) -> pa.Table:
    """Exact links of two groups (rid, node, x): counts of the left, of the right where ``both``, and stars."""
    x, y = unit(matrix(left["x"])), unit(matrix(right["x"]))
    rid, other = numbers(left["rid"]), numbers(right["rid"])
    node, other_node = numbers(left["node"]), numbers(right["node"])
    total, parts = np.zeros(len(x), np.int64), []
    for a in range(0, len(y), ENTRIES):
        some = slice(a, a + ENTRIES)
        linked = (x @ y[some].T >= least) & (rid[:, None] != other[None, some])
        total += linked.sum(1)
        back = (linked & both[:, some]).sum(0)
        parts.append((LINKS, other[some][back > 0], back[back > 0]))
        parts += [(EDGE, p, q) for p, q in stars(linked, node, other_node[some])]
    return counted([(LINKS, rid[total > 0], total[total > 0]), *parts])


def coded(rows: DataFrame, model: Model) -> DataFrame:
    """rid, id, y, x and ball, home, probes, code, square, error of each vector."""
    state = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("ball int, home int, probes array<int>, code binary, square double, error double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = state.value
        for whole in batches:
            for a in range(0, len(whole), MEMBERS):
                batch = whole.slice(a, MEMBERS)
                x = unit(matrix(batch.column(3)))
                home, probes, codes, square, error = model.code(x)
                bounds = np.concatenate([[0], np.cumsum(probes.sum(1))])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.nonzero(probes)[1], pa.int32()))
                ball = model.ball(x, numbers(batch.column(2)))
                made = [pa.array(ball, pa.int32()), pa.array(home, pa.int32()), lists, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(square), pa.array(error)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def met_with(left: DataFrame, right: DataFrame, key: list[str], function, schema: str) -> DataFrame:
    """``function`` (key, left rows, right rows) for each key; both sides may be of one table."""
    return left.groupBy(*key).cogroup(right.toDF(*right.columns).groupBy(*key)).applyInArrow(function, schema)


def chunk(n: Column | str, size: int) -> Column:
    return F.ceil(F.col(n) / size).cast("int")


def list_links(table: DataFrame, model: Model) -> DataFrame:
    """COUNTS of the links of the rows of ``table``, by lists, codes and exact cosines."""
    state = table.sparkSession.sparkContext.broadcast(model)
    sizes = materialize(table.groupBy("y", "home").agg(F.count("*").alias("n")).where(F.col("n") > MEMBERS).select("y", F.col("home").alias("list"), chunk("n", MEMBERS).alias("chunks")), "list-sizes")
    chunks = F.coalesce("chunks", F.lit(1))

    def member(df: DataFrame) -> DataFrame:
        return df.join(sizes, ["y", "list"], "left").withColumn("chunk", F.pmod(F.xxhash64("rid"), chunks).cast("int")).drop("chunks")

    members = member(table.select("y", F.col("home").alias("list"), "rid", "x"))
    entries = table.select("y", F.explode("probes").alias("list"), "rid", "home", "code", "square", "error").join(sizes, ["y", "list"], "left")
    entries = entries.select("y", "list", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "rid", "home", "code", "square", "error")
    key = ["y", "list", "chunk"]

    def near(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        model = state.value
        rid, other = numbers(left["rid"]), numbers(right["rid"])
        met, back = np.zeros(len(rid), bool), np.zeros(len(other), bool)
        if len(rid) and len(other):
            x = unit(matrix(left["x"]))
            home, square = numbers(right["home"]), numbers(right["square"])
            limit = (model.reach + numbers(right["error"]) + TINY) ** 2
            codes = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(len(other), -1)
            for a in range(0, len(other), ENTRIES):
                some = slice(a, a + ENTRIES)
                here = (model.distances(x, home[some], codes[some], square[some]) <= limit[some]) & (rid[:, None] != other[None, some])
                met |= here.any(1)
                back[some] = here.any(0)
        n, m = int(met.sum()), int(back.sum())
        columns = [np.full(n + m, k.as_py()) for k in key]
        return pa.table({"y": pa.array(columns[0], pa.int64()), "list": pa.array(columns[1], pa.int32()), "chunk": pa.array(columns[2], pa.int32()), "rid": np.concatenate([rid[met], other[back]]).astype(np.int64), "entry": np.repeat([False, True], [n, m])})

    found = met_with(members, entries, key, near, "y long, list int, chunk int, rid long, entry boolean")
    found = materialize(found, "near")
    full = found.join(table.select("rid", F.col("id").alias("node"), "home", "probes", "x").hint("merge"), "rid")

    def exact(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        homes, of = np.unique(numbers(right["home"]), return_inverse=True)
        has = np.array([np.isin(homes, p) for p in left["probes"].to_pylist()]).reshape(len(left), len(homes))
        # a pair is met again in the other's list, where that counts the other's link, unless it isn't probed
        return compare(state.value.least, left, right, ~has[:, of]) if len(left) and len(right) else counted([])

    out = met_with(full.where("not entry"), full.where("entry"), key, exact, COUNTS)
    out = materialize(out, "links")
    discard(sizes, found)
    return out


def ball_links(table: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """(COUNTS of the links between balls and what is outside them, (ball, n, node) of the balls)."""
    spark = table.sparkSession
    least, angle = model.least, float(np.arccos(model.least))
    state = spark.sparkContext.broadcast(model)

    def radius(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ball = numbers(batch.column(1))
            cosine = (unit(matrix(batch.column(2))) * state.value.balls[ball]).sum(1) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.arccos(np.clip(cosine, -1, 1)))], names=["id", "ball", "radius"])

    inside = table.where("ball >= 0")
    stats = inside.select("id", "ball", "x").mapInArrow(radius, "id long, ball int, radius double").groupBy("ball").agg(F.count("*").alias("n"), F.max("radius").alias("radius"), F.min("id").alias("node"))
    stats = materialize(stats, "balls")
    known = stats.orderBy("ball").toPandas()
    numbers_of, sizes, radii, nodes = (known[c].to_numpy() for c in ("ball", "n", "radius", "node"))
    place = np.full(len(model.balls) + 1, -1)
    place[numbers_of] = np.arange(len(known))
    around = spark.sparkContext.broadcast((numbers_of, sizes, radii, nodes, place))

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (of, n, r, node, place) = state.value, around.value
        touched, edges = np.zeros(len(of), np.int64), set()
        for batch in batches:
            rid, id, y, ball = (numbers(batch.column(k)) for k in range(4))
            if not len(rid):
                continue
            x = unit(matrix(batch.column(4)))
            own = place[ball]
            d = np.arccos(np.clip(x @ model.balls[of].T, -1, 1))
            other = (y[:, None] == model.ball_labels[of][None, :]) & (own[:, None] != np.arange(len(of))[None, :])
            full = other & (d + r <= angle - TINY)
            edge = other & ~full & (d - r <= angle + TINY)
            total = full @ n
            touched += (full & (own < 0)[:, None]).sum(0)
            i, b = np.nonzero(full)
            edges |= {*zip(np.where(own[i] < 0, id[i], node[own[i]]).tolist(), node[b].tolist(), strict=True)}
            i, b = np.nonzero(edge)
            made = [(LINKS, rid[total > 0], total[total > 0]), (BOUNDARY, rid[i], of[b])]
            yield from counted(made).to_batches()
        pairs = np.array(sorted(edges), np.int64).reshape(-1, 2)
        yield from counted([(EDGE, pairs[:, 0], pairs[:, 1]), (BALL_LINKS, of[touched > 0], touched[touched > 0])]).to_batches()

    made = materialize(table.select("rid", "id", "y", "ball", "x").mapInArrow(outside, COUNTS), "around")
    at = made.where(F.col("kind") == BOUNDARY).select(F.col("a").alias("rid"), F.col("b").cast("int").alias("of"))
    sides = materialize(at.groupBy("of").agg(F.count("*").alias("m")).join(stats.select(F.col("ball").alias("of"), "n"), "of").select("of", chunk("m", MEMBERS).alias("left"), chunk("n", MEMBERS).alias("right")), "boundaries")
    node = F.coalesce("node", "id").alias("node")
    vectors = table.join(stats.select("ball", "node"), "ball", "left").select("rid", node, "ball", "x")
    outer = at.join(vectors.hint("merge"), "rid").join(sides, "of")
    outer = outer.select("of", F.pmod(F.xxhash64("rid"), F.col("left")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("right") - 1)).alias("j"), "rid", "node", "ball", "x")
    inner = vectors.withColumn("of", F.col("ball")).join(sides, "of")
    inner = inner.select("of", F.explode(F.sequence(F.lit(0), F.col("left") - 1)).alias("i"), F.pmod(F.xxhash64("rid"), F.col("right")).cast("int").alias("j"), "rid", "node", "x")

    def exact(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        loose = np.broadcast_to((numbers(left["ball"]) < 0)[:, None], (len(left), len(right)))
        return compare(least, left, right, loose) if len(left) and len(right) else counted([])

    key = ["of", "i", "j"]
    met = materialize(met_with(outer, inner, key, exact, COUNTS), "boundary-links")
    discard(sides)
    return made.where(F.col("kind") != BOUNDARY).unionByName(met), stats


def link(df: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept): one row for each vector; links are of equal labels and cosine ``least`` or more.

    n_links counts the other rows that a row is linked with, component_id is the smallest id
    that it reaches, kept tells that this is its own. All but the search for candidates is exact: a
    link is found where one of the two probes the other's list, which for random directions of
    the difference fails less than once in 10,000 at the threshold.

    Labels are integers. Rows with a null id, label or vector, an empty vector, one of zeros, a
    null or non-finite component, or a length other than the commonest (of two, the longer)
    link with nothing: no links, their own id as component, kept. Repeated rows are vectors of
    their own, and those of one id share its component. Empty tables give no rows. Extra columns
    are left out, whatever their names.
    """
    taken = df.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("y"), F.col(vector).alias("x"))
    odd = F.exists("x", lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("y").isNotNull() & (F.size("x") > 0) & ~odd & F.exists("x", lambda c: c != 0), F.lit(False))
    marked = taken.withColumn("usable", usable)
    sizes = marked.where("usable").groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    size, total = (sizes["d"], sizes["n"]) if sizes else (0, 0)
    fits = F.col("usable") & (F.size("x") == size)
    alone = marked.where(~fits).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    names = [id, "n_links", "component_id", "kept"]
    if not total:
        return alone.toDF(*names)
    rows = materialize(marked.where(fits).select(F.monotonically_increasing_id().alias("rid"), "id", "y", "x"), "vectors")
    model = fit(sampled(rows.select("id", "y", "x"), total, SAMPLE).toArrow(), total, least)
    table = materialize(coded(rows, model), "coded")
    found = list_links(table.where("ball < 0"), model)
    if len(model.balls):
        around, balls = ball_links(table, model)
        found = found.unionByName(around)
    else:
        balls = df.sparkSession.createDataFrame([], "ball int, n long, radius double, node long")
    parts = smallest_reachable(found.where(F.col("kind") == EDGE).select("a", "b"))
    links = found.where(F.col("kind") == LINKS).groupBy(F.col("a").alias("rid")).agg(F.sum("b").alias("links"))
    touched = found.where(F.col("kind") == BALL_LINKS).groupBy(F.col("a").cast("int").alias("ball")).agg(F.sum("b").alias("touched"))
    ball = balls.join(touched, "ball", "left").join(parts, "node", "left")
    ball = materialize(ball.select("ball", (F.col("n") - 1 + F.coalesce("touched", F.lit(0))).alias("more"), F.coalesce("component", "node").alias("ball_component")), "ball-parts")
    each = table.select("rid", "id", "ball").join(links, "rid", "left").join(F.broadcast(ball), "ball", "left")  # at most BALL rows
    node = F.when(F.col("ball") < 0, F.col("id"))
    done = each.withColumn("node", node).join(parts, "node", "left")
    component = F.coalesce("ball_component", "component", "id")
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce("more", F.lit(0))
    out = done.select("id", n_links.cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
    discard(rows)
    return out.unionByName(alone).toDF(*names)


def oracle(table: str = "embeddings", least: float = 0.93) -> str:
    """DuckDB SQL of op12's rows."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS q FROM {table}
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.q, b.q) / sqrt(list_dot_product(a.q, a.q)) / sqrt(list_dot_product(b.q, b.q)) >= {least}
), reached AS (
  SELECT vec_id, vec_id AS other FROM {table}
  UNION
  SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a
), parts AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
), counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM {table} e JOIN parts USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
