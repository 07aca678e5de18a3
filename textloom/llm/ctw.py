"""LM scoring by context-tree weighting over bytes, with a word unigram base.

A byte is eight binary decisions; each decision has a context tree whose branches are the
preceding bytes, up to DEPTH of them. Every node keeps a Krichevsky-Trofimov estimate, and
the tree mixes the estimates of all depths: P_w = 1/2 P_kt + 1/2 product of the children's
P_w. Spark counts the (DEPTH + 1)-byte runs of the whole training corpus; the counts of
every shorter context are sums of these.

All contexts are kept, in tables: contexts of TOP bytes part the trees into subtrees, which
tasks weigh one by one; the few nodes above are weighed on the driver (at most 2^24 byte
triples, whatever the corpus), and a second pass carries the mixture down to every run. The
scores of the commonest runs go along with the tasks, those of the others are joined with
the runs of each text, so the model grows with the corpus and no score depends on a bound.
A task holds the distinct runs of one context of TOP bytes at least.

Texts end with byte 0xFF, which UTF-8 has not, and start in a context of such bytes; the
score is the log10 probability of a whole text and its end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._columns import materialize
from textloom.llm._text import Rows, mix, slices, span_hash, words

DEPTH = 5
END = 0xFF
#: Bytes of the contexts that part the trees into subtrees.
TOP = 2
#: Byte runs whose scores go along with the tasks, at most; the scores of others are joined.
HEAD_RUNS = 1_000_000
#: Runs of whole subtrees that a task weighs at a time, unless one subtree has more.
WEIGHED = 200_000
#: Words whose counts go along with the tasks, at most; the counts of others are joined.
HEAD_WORDS = 300_000
#: Counts of one kind that a task holds before it sends them on.
HELD = 700_000


def byte_runs(rows: Rows, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Run of depth + 1 bytes ending at each byte of each text and at its end, as int64; bounds of the rows."""
    size = np.diff(rows.bounds) + 1
    bounds = np.concatenate([[0], np.cumsum(size)])
    data = np.full(int(bounds[-1]), END, np.uint8)
    inside = np.ones(len(data), bool)
    inside[bounds[1:] - 1] = False
    data[inside] = rows.data
    out = data.astype(np.int64)
    age = np.arange(len(data)) - np.repeat(bounds[:-1], size)
    for k in range(1, depth + 1):
        before = np.full(len(data), END, np.int64)
        before[k:] = data[:-k]
        before[age < k] = END
        out |= before << (8 * k)
    return out, bounds


def word_keys(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes (96 bits) of each lower-cased word, and where the words of each row begin."""
    rows = rows.lowered()
    w = words(rows)
    other = span_hash(rows.data, w.start, w.end, 1)
    return w.hash.astype(np.int64), (mix(other).astype(np.int64) >> 32), w.first


def _summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each distinct key (one or two columns) with the sums of its rows."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(x[order], at) if len(at) else x for x in sums]


class _Held:
    """Counts of one kind in a task: summed now and then, sent on when they are many."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, keys: list[np.ndarray], count: np.ndarray, learn: bool, scored: bool) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, [count * learn, count * scored]))
        self.size += len(count)
        if self.size > HELD:
            self.sum()
            if self.size > HELD // 2:
                yield from self.send()

    def sum(self) -> None:
        columns = list(zip(*(k for k, _ in self.parts), strict=True)), list(zip(*(x for _, x in self.parts), strict=True))
        part = _summed(*([np.concatenate(c) for c in group] for group in columns))
        self.parts, self.size = [part], len(part[0][0])

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self.sum()
            (keys, sums), size = self.parts[0], self.size
            k2 = keys[1] if len(keys) > 1 else np.zeros(size, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(size, self.kind), keys[0], k2, *sums)], names=["kind", "k1", "k2", "n", "m"])
        self.parts, self.size = [], 0


def corpus_counts(rows: DataFrame, depth: int) -> DataFrame:
    """(kind, k1, k2, n, m): kind 0 byte runs, 1 words, 2 texts; counted over all rows.

    ``rows`` has text, learn and scored (booleans); n counts in rows to learn from, m in rows
    to score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_Held(0), _Held(1)]
        texts = np.zeros(2, np.int64)
        for batch in batches:
            learns, scores = (batch.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (1, 2))
            texts += learns.sum(), scores.sum()
            for learn, scored in ((True, True), (True, False), (False, True)):
                mask = (learns == learn) & (scores == scored)
                for part in slices(batch.column(0) if mask.all() else batch.column(0).filter(pa.array(mask))):
                    u, n = np.unique(byte_runs(part, depth)[0], return_counts=True)
                    yield from held[0].add([u], n, learn, scored)
                    k1, k2, _ = word_keys(part)
                    keys, (n,) = _summed([k1, k2], [np.ones(len(k1), np.int64)])
                    yield from held[1].add(keys, n, learn, scored)
        for h in held:
            yield from h.send()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (2, 0, 0, *texts)], names=["kind", "k1", "k2", "n", "m"])

    part = rows.select("text", "learn", "scored").mapInArrow(run, "kind long, k1 long, k2 long, n long, m long")
    return part.groupBy("kind", "k1", "k2").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _limit_by_count(binned: DataFrame, most: int) -> int:
    """Smallest bin (of log counts) from which up the ``size`` of all rows is within ``most``; 0 takes all."""
    total, least = 0, 10_000
    for r in sorted(binned.collect(), key=lambda r: -r["bin"]):  # a few hundred bins
        total += r["size"]
        if total > most:
            break
        least = r["bin"]
    else:
        return 0
    return least


def _bin(n: str) -> Column:
    return F.floor(F.log2(F.col(n).cast("double")) * 8).cast("int")


_SMALL = np.array([math.lgamma(k / 2) if k else 0.0 for k in range(4096)])


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of multiples of 1/2: a table, and Stirling's series beyond it."""
    out = np.empty_like(x)
    small = x < 2047
    out[small] = _SMALL[np.rint(2 * x[small]).astype(np.int64)]
    y = x[~small]
    out[~small] = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - math.log(math.pi) - lgamma(a + b + 1)


def bit_nodes(runs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Node key of bit k of each run's last byte (context, then the bits so far), and the bit."""
    byte = runs & 0xFF
    return (runs >> 8) << 8 | (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1


def node_counts(runs: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of bit k of sorted runs, with their zeros and ones; runs in order give nodes in order."""
    key, bit = bit_nodes(runs, k)
    if not len(key):
        return key, np.zeros(0), np.zeros(0)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    both, one = np.add.reduceat(n, at), np.add.reduceat(n * bit, at)
    return key[at], both - one, one


def subtree_levels(runs: np.ndarray, n: np.ndarray, depth: int, top: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted runs with counts for each depth from ``top`` to ``depth``, of the deepest runs."""
    out = []
    for d in range(top, depth + 1):
        u, back = np.unique(runs & ((1 << (8 * (d + 1))) - 1), return_inverse=True)
        out.append((u, np.bincount(back, weights=n, minlength=len(u))))
    return out


def weigh(nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]], top: int, weighted: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Bottom-up over levels from ``top``, all contexts kept: log P_w of the first level; parents; share of each node's own estimate."""
    parent = [np.zeros(0, np.int64)] + [np.searchsorted(nodes[i - 1][0], nodes[i][0] & ((1 << (8 * (top + i))) - 1)) for i in range(1, len(nodes))]
    stop = [np.ones(len(x[0])) for x in nodes]
    for i in range(len(nodes) - 2, -1, -1):
        below = np.bincount(parent[i + 1], weights=weighted, minlength=len(nodes[i][0]))
        own = log_kt(nodes[i][1], nodes[i][2])
        stop[i] = 1 / (1 + np.exp(-np.clip(own - below, -700, 700)))
        weighted = math.log(0.5) + np.logaddexp(own, below)
    return weighted, parent, stop


def carry(nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parent: list[np.ndarray], stop: list[np.ndarray], mixed: np.ndarray) -> np.ndarray:
    """Top-down: rows P(0), P(1) and the weight that is left below, at the nodes of the last level.

    Both probabilities are summed by themselves: 1 - P would lose the small one.
    """
    for i, (_, zeros, ones) in enumerate(nodes):
        if i:
            mixed = mixed[:, parent[i]]
        here = mixed[2] * stop[i] / (zeros + ones + 1)
        mixed = np.stack([mixed[0] + here * (zeros + 0.5), mixed[1] + here * (ones + 0.5), mixed[2] * (1 - stop[i])])
    return mixed


def run_scores(runs: DataFrame, depth: int) -> DataFrame:
    """(k1, m, gain): log10 probability of the last byte of each run, under the trees of all contexts.

    ``runs`` has k1, n and m. Runs with n = 0 are scored and change no other score: an unseen
    node has probability 1.
    """
    spark = runs.sparkSession
    top = min(TOP, depth)
    low = (1 << (8 * top)) - 1
    parts = runs.select("k1", "n", "m", F.shiftright("k1", 8).bitwiseAND(F.lit(low)).alias("c"))
    grouped = parts.repartition("c").sortWithinPartitions("c")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Rows of whole subtrees: k1, n and m."""
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]))
            if sum(x.shape[1] for x in held) > WEIGHED:
                rows = np.concatenate(held, 1)
                cut = int(np.searchsorted(rows[3], rows[3, -1]))
                held = [rows[:, cut:]]
                if cut:
                    yield rows[:3, :cut]
        if held and (rows := np.concatenate(held, 1)).shape[1]:
            yield rows[:3]

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run_, n, _ in chunks(batches):
            levels = subtree_levels(run_, n.astype(np.float64), depth, top)
            for k in range(8):
                nodes = [node_counts(*x, k) for x in levels]
                w, _, _ = weigh(nodes, top, log_kt(*nodes[-1][1:]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), k)), *(pa.array(x) for x in nodes[0]), pa.array(w)], names=["k", "key", "zeros", "ones", "w"])

    got = grouped.mapInArrow(summary, "k long, key long, zeros double, ones double, w double").toArrow()
    got = {c: got[c].to_numpy() for c in ("k", "key", "zeros", "ones", "w")}
    starts = []
    for k in range(8):
        mine = np.flatnonzero(got["k"] == k)
        mine = mine[np.argsort(got["key"][mine])]
        key, zeros, ones, w = (got[c][mine] for c in ("key", "zeros", "ones", "w"))
        nodes = []
        for d in range(top):
            u, back = np.unique(key & ((1 << (8 * (d + 1))) - 1), return_inverse=True)
            nodes.append((u, np.bincount(back, weights=zeros, minlength=len(u)), np.bincount(back, weights=ones, minlength=len(u))))
        nodes.append((key, zeros, ones))
        _, parent, stop = weigh(nodes, 0, w)
        begin = np.repeat([[0.0], [0.0], [1.0]], len(nodes[0][0]), 1)
        starts.append((key, carry(nodes[:-1], parent, stop, begin)[:, parent[-1]] if top else begin))
    del got
    shared = spark.sparkContext.broadcast(starts)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            run_, n, m = rows[:, np.argsort(rows[0])]
            levels = subtree_levels(run_, n.astype(np.float64), depth, top)
            total = np.zeros(len(run_))
            for k, (key, begin) in enumerate(shared.value):
                nodes = [node_counts(*x, k) for x in levels]
                _, parent, stop = weigh(nodes, top, log_kt(*nodes[-1][1:]))
                p = carry(nodes, parent, stop, begin[:, np.searchsorted(key, nodes[0][0])])
                mine, bit = bit_nodes(run_, k)
                total += np.log10(p[bit, np.searchsorted(nodes[-1][0], mine)])
            yield pa.RecordBatch.from_arrays([pa.array(run_), pa.array(m), pa.array(total)], names=["k1", "m", "gain"])

    return materialize(grouped.mapInArrow(finish, "k1 long, m long, gain double"), "run-scores")


class Scorer:
    """Scores of the commonest runs in a task, as a hash table."""

    def __init__(self, runs: np.ndarray, gain: np.ndarray):
        bits = max(8, int(len(runs)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.value = np.zeros(1 << bits, np.float64)
        todo, step = np.arange(len(runs)), 0
        while len(todo):
            slot = (self.slot(runs[todo]) + step) & self.mask
            free = np.flatnonzero(self.key[slot] == -1)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.key[slot[put]], self.value[slot[put]] = runs[todo[put]], gain[todo[put]]
            todo = np.delete(todo, put)
            step += 1
        self.probes = step

    def slot(self, runs: np.ndarray) -> np.ndarray:
        return ((runs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def known(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the runs (0 where unknown), and the places of those that the table has not."""
        slot = self.slot(runs)
        out = self.value[slot]
        todo = np.flatnonzero(self.key[slot] != runs)
        for step in range(1, self.probes):
            if not len(todo):
                break
            at = (slot[todo] + step) & self.mask
            hit = self.key[at] == runs[todo]
            out[todo[hit]] = self.value[at[hit]]
            todo = todo[~hit]
        out[todo] = 0.0
        return out, todo


_SCORERS: dict[str, Scorer] = {}


def score(df: DataFrame, *, learn: Column | None = None, train: DataFrame | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), depth: int = DEPTH, head_words: int = HEAD_WORDS, head_runs: int = HEAD_RUNS) -> DataFrame:
    """Columns ``keep``, n_bytes, score, bits_per_byte, n_tokens, n_known, train_tokens, base_score.

    Learns from the rows of ``df`` where ``learn`` holds (None: all), or from another table
    ``train``; scores every row of ``df``, whole texts. score is the model's log10 probability
    of a text and its end, bits_per_byte its code length for each byte (the end counted as
    one). n_tokens counts words (A-Z lower-cased) and one end; base_score is the sum of
    log10((c + 1) / (N + V + 1)) over them. A null text is empty: one token, the end. Repeated
    rows each get their row; other columns are left out, whatever their names. Nothing to
    learn from gives even decisions and c = 0.

    The commonest words' counts go along with the tasks (``head_words`` at most); the
    other words of each text are joined with the counts, so the vocabulary has no bound
    and no word is a hot key. So are the scores of byte runs (``head_runs`` at most).
    """
    spark = df.sparkSession
    if train is None:
        rows = df.select(F.col(text).alias("text"), F.coalesce(F.lit(True) if learn is None else learn, F.lit(False)).alias("learn"), F.lit(True).alias("scored"))
    else:
        rows = train.select(F.col(text).alias("text"), F.lit(True).alias("learn"), F.lit(False).alias("scored"))
        rows = rows.unionByName(df.select(F.col(text).alias("text"), F.lit(False).alias("learn"), F.lit(True).alias("scored")))
    counts = materialize(corpus_counts(rows, depth), "counts")
    gains = run_scores(counts.where("kind = 0"), depth).where("m > 0")
    low = _limit_by_count(gains.groupBy(_bin("m").alias("bin")).agg(F.count("*").alias("size")), head_runs)
    head = gains.where(_bin("m") >= low).select("k1", "gain").toArrow()
    run_head = head["k1"].to_numpy(), head["gain"].to_numpy()
    rare_runs = gains.where(_bin("m") < low).select("k1", "gain")
    word_counts = counts.where("kind = 1")
    ends = counts.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n_train, vocabulary = size["n"] + ends, size["v"] + (1 if ends else 0)
    divisor = math.log10(n_train + vocabulary + 1)
    asked = word_counts.where("m > 0")
    least = _limit_by_count(asked.groupBy(_bin("m").alias("bin")).agg(F.count("*").alias("size")), head_words)
    head = asked.where(_bin("m") >= least).select("k1", "k2", "n").toArrow()
    order = np.lexsort((head["k2"].to_numpy(), head["k1"].to_numpy()))
    shared = spark.sparkContext.broadcast((*run_head, *(head[c].to_numpy()[order] for c in ("k1", "k2", "n"))))
    del head, run_head
    name = str(id(shared)) + str(shared.id if hasattr(shared, "id") else "")
    end_score = math.log10(ends + 1) - divisor
    tail_type = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("m", pa.int64())]))
    run_type = pa.list_(pa.struct([("k1", pa.int64()), ("m", pa.int64())]))
    fields = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep]
    out_schema = ", ".join([*fields, "rid long", "n_bytes long", "score double", "n_tokens long", "head_known long", "head_base double", "tail array<struct<k1: bigint, k2: bigint, m: bigint>>", "runs array<struct<k1: bigint, m: bigint>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_run, head_gain, h1, h2, hn = shared.value
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(head_run, head_gain)
        scorer = _SCORERS[name]
        gain = np.log10(hn + 1.0) - divisor
        for batch in batches:
            for part in slices(batch.column(0)):
                runs, bounds = byte_runs(part, depth)
                value, far = scorer.known(runs)
                total = np.add.reduceat(value, bounds[:-1])
                # runs not in the head, once for each row
                far_row = np.searchsorted(bounds, far, "right") - 1
                order = np.lexsort((runs[far], far_row))
                far_run, far_row = runs[far][order], far_row[order]
                new = np.ones(len(far), bool)
                new[1:] = (far_row[1:] != far_row[:-1]) | (far_run[1:] != far_run[:-1])
                v = np.flatnonzero(new)
                far_type = list(run_type.value_type)
                far_runs = pa.StructArray.from_arrays([pa.array(far_run[v]), pa.array(np.diff(np.append(v, len(far))))], fields=far_type)
                far_bounds = np.searchsorted(far_row[v], np.arange(len(part) + 1))
                k1, k2, first = word_keys(part)
                at = np.searchsorted(h1, k1)
                known = np.zeros(len(k1), bool)
                learned = np.zeros(len(k1), bool)
                base = np.zeros(len(k1))
                if len(h1):
                    at = np.minimum(at, len(h1) - 1)
                    known = (h1[at] == k1) & (h2[at] == k2)
                    base[known] = gain[at[known]]
                    learned[known] = hn[at[known]] > 0
                row = np.repeat(np.arange(len(part)), np.diff(first))
                n = len(part)
                # words not in the head, once for each row
                t = np.flatnonzero(~known)
                order = np.lexsort((k2[t], k1[t], row[t]))
                t = t[order]
                new = np.ones(len(t), bool)
                new[1:] = (row[t][1:] != row[t][:-1]) | (k1[t][1:] != k1[t][:-1]) | (k2[t][1:] != k2[t][:-1])
                u = np.flatnonzero(new)
                m = np.diff(np.append(u, len(t)))
                tail_bounds = np.searchsorted(row[t][u], np.arange(n + 1))
                tail = pa.StructArray.from_arrays([pa.array(k1[t][u]), pa.array(k2[t][u]), pa.array(m)], fields=list(tail_type.value_type))
                values = [
                    pa.array(np.diff(part.bounds)),
                    pa.array(total),
                    pa.array(np.diff(first) + 1),
                    pa.array(np.bincount(row[learned], minlength=n)),
                    pa.array(np.bincount(row, weights=base, minlength=n) + end_score),
                    pa.ListArray.from_arrays(pa.array(tail_bounds, pa.int32()), tail),
                    pa.ListArray.from_arrays(pa.array(far_bounds, pa.int32()), far_runs),
                ]
                kept = [batch.column(k + 1).slice(part.first, n) for k in range(len(keep) + 1)]
                yield pa.RecordBatch.from_arrays([*kept, *values], names=[*keep, "rid", "n_bytes", "score", "n_tokens", "head_known", "head_base", "tail", "runs"])

    scored = df.select(F.col(text).alias("__text"), *keep, F.monotonically_increasing_id().alias("rid")).mapInArrow(run, out_schema)
    scored = materialize(scored, "scored")
    tail = scored.select("rid", F.explode("tail").alias("t")).select("rid", "t.k1", "t.k2", "t.m")
    rare = asked.where((_bin("m") < least) & (F.col("n") > 0)).select("k1", "k2", "n")
    joined = tail.join(rare.hint("merge"), ["k1", "k2"], "left")
    gain = F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)) - F.lit(divisor)
    sums = joined.groupBy("rid").agg(F.sum(F.col("m") * gain).alias("tail_base"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("tail_known"))
    both = scored.drop("tail", "runs").join(sums.hint("merge"), "rid", "left")
    far = scored.select("rid", F.explode("runs").alias("t")).select("rid", "t.k1", "t.m")
    added = far.join(rare_runs.hint("merge"), "k1").groupBy("rid").agg(F.sum(F.col("m") * F.col("gain")).alias("far_score"))
    both = both.join(added.hint("merge"), "rid", "left")
    total = F.col("score") + F.coalesce("far_score", F.lit(0.0))
    return both.select(
        *keep,
        "n_bytes",
        total.alias("score"),
        (-total * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
    )
