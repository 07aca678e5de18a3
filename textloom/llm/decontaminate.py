"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit distance.

Texts are sequences of words (runs of letters and digits, A-Z lower-cased; each character
of a script without spaces, such as Japanese, is a word). A document
is contaminated by an item if some run of its words (with ``free_ends``; otherwise some
window of the item's length) lies within ``tolerance`` edits a word of the item. A CGK random walk turns edit distance into
Hamming distance: step j emits the word under the pointer, which moves on if a random
function of the step and the word says so. A few sampled positions of the embedding are
one hash key; walks are repeated until the target recall is reached, and around every
window that meets an item in a key the exact edit distance is computed.

An edit spoils two word pairs at most, so of the 2 * edits + 1 rarest pairs of an item a copy
still has one. Only those lead from a text to the item, and only windows go to the embedding
that hold as many of the item's pairs as a copy must. This loses nothing.
An item of more than PIECE words is searched for by pieces of about equal size: of a copy, one
piece at least has no more than its share of the edits. Where that piece meets, the whole item is
compared. Items too short for an edit are looked up as they are, by the hash of their words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom.llm._columns import materialize
from textloom.llm._text import NOT_ALNUM, U64, Rows, Words, grams, mix, ranges, slices, span_hash, words

#: Pieces of items that one pass over the documents holds at most, on average; more take more passes.
PASS_ITEMS = 20_000
#: Words of an item or piece that is searched for whole, so that walks stay few.
PIECE = 64
#: Pairs of a text and owners, and cells of a table, that are held at a time.
OWNERS, CELLS = 1 << 18, 1 << 20
SAMPLED = 2
RECALL = 0.9999
#: Walks that are tried to estimate how often an edited copy meets its item.
TRIED_WALKS = 96
_PAD = U64(0x5851F42D4C957F2D)


@dataclass
class Items:
    """Items of one length: ids, word hashes (one item in each line), allowed edits, least common pairs."""

    n: int
    ids: np.ndarray
    symbols: np.ndarray
    edits: int
    least: int


@dataclass
class Pieces(Items):
    """Pieces of one length and number of edits; of each the item (length group, line there) and the place in it."""

    whole: np.ndarray
    of: np.ndarray
    offset: np.ndarray


@dataclass
class Index:
    items: list[Items]
    pieces: list[Pieces]
    pairs: np.ndarray
    salts: np.ndarray
    picks: np.ndarray  # walks x SAMPLED, as shares of the 2n steps in which words are emitted
    keys: list[np.ndarray]  # for each group of pieces: pieces x the walks of its length
    owners: np.ndarray  # the pieces that have each word pair among their rarest, pair by pair
    places: np.ndarray  # and where in the piece
    owner_start: np.ndarray
    owner_end: np.ndarray
    has: np.ndarray  # piece * len(pairs) + pair for all pairs of each piece, sorted
    group: np.ndarray  # of each piece: its group, line there, length, edits and least common pairs
    line: np.ndarray
    length: np.ndarray
    edits: np.ndarray
    least: np.ndarray
    runs: np.ndarray  # pairs that follow themselves in some piece
    exact: list[tuple[int, np.ndarray, np.ndarray]]  # items without edits, by length: sorted hashes, and ids


def normalized(rows: Rows) -> Words:
    return words(rows.lowered(), gap=NOT_ALNUM, characters=True)


def pair_hash(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * U64(3) + mix(h[1:]))


def embed_keys(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, n: int, salts: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Keys (window x walk) of the CGK embeddings of symbols[start:start+length]; 0 if they sample padding only.

    A walk uses its words up after about 2n steps; positions are sampled before that.
    """
    walks = len(picks)
    steps = np.sort((picks * 2 * n).astype(np.int64), axis=1)
    pointer = np.zeros((len(start), walks), np.int64)
    key = np.zeros((len(start), walks), U64)
    some = np.zeros((len(start), walks), bool)
    last = len(symbols) - 1
    for j in range(int(steps.max()) + 1):
        inside = pointer < length[:, None]
        s = np.where(inside, symbols[np.minimum(start[:, None] + pointer, last)], _PAD)
        for k in range(SAMPLED):
            hit = np.flatnonzero(steps[:, k] == j)
            if len(hit):
                key[:, hit] = mix(key[:, hit] * U64(5) + s[:, hit] + U64(k + 1))
                some[:, hit] |= inside[:, hit]
        moves = ((s ^ salts[None, :] ^ U64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * U64(0xD6E8FEB86659FD93)) >> U64(63)
        pointer += moves.astype(np.int64)
    return np.where(some, mix(key + np.arange(walks, dtype=U64)[None, :]) | U64(1), U64(0))


def same_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether keys meet; those of padding alone do not."""
    return (a == b) & (a != 0)


def nearest(a: np.ndarray, b: np.ndarray, length: np.ndarray, free: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Least Levenshtein distance of each line of ``a`` to any run of the same line of ``b``, and where the first such run starts.

    Runs lie in the first ``length`` symbols and may have any size: both ends in ``b`` are
    free. Without ``free`` all ``length`` symbols are the run.
    """
    m, n = b.shape
    unit = n + 1  # a cell holds distance * unit + start
    column = np.arange(n + 1) * unit
    row = np.broadcast_to(np.arange(n + 1) if free else column, (m, n + 1)).copy()
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = row[:, 0] + unit
        new[:, 1:] = np.minimum(row[:, 1:] + unit, row[:, :-1] + (a[:, i : i + 1] != b) * unit)
        row = np.minimum.accumulate(new - column, axis=1) + column
    if not free:
        return row[np.arange(m), length] // unit, np.zeros(m, np.int64)
    row[np.arange(n + 1) > length[:, None]] = np.iinfo(np.int64).max
    best = row.min(axis=1)
    return best // unit, best % unit


def draw_walks(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Salts and sampled positions of the first ``count`` walks; more walks begin with the same ones."""
    draws = [np.random.default_rng((3, k)) for k in range(count)]
    salts = np.array([d.integers(0, 1 << 63, dtype=np.uint64) for d in draws], U64)
    return salts, np.array([d.random(SAMPLED) for d in draws]).reshape(count, SAMPLED)


def edited(symbols: np.ndarray, edits: int, draw: np.random.Generator) -> np.ndarray:
    """A copy with random edits, as long as the item again."""
    c = symbols.tolist()
    for _ in range(edits):
        kind, at = draw.integers(3), int(draw.integers(len(c)))
        if kind == 0:
            c[at] = int(draw.integers(1 << 62))
        elif kind == 1:
            c.insert(at, int(draw.integers(1 << 62)))
        elif len(c) > 2:
            del c[at]
    return np.array((c + [1] * len(symbols))[: len(symbols)], U64)


def walks_needed(g: Items, recall: float) -> int:
    """Walks that meet a copy edited to the tolerance with probability ``recall``, for one length, by trial.

    Up to 40 items are edited at random, four copies of each; the share of walks in which a
    copy meets its item is taken, and the lower decile of these shares decides. There is no
    upper limit; a length whose copies meet in none of the tried walks is an error.
    """
    draw = np.random.default_rng(5)
    salts, picks = draw_walks(TRIED_WALKS)
    some = np.repeat(g.symbols[:40], 4, axis=0)
    copies = np.concatenate([edited(s, g.edits, draw) for s in some])
    start, size = np.arange(len(some)) * g.n, np.full(len(some), g.n)
    a, b = (embed_keys(x, start, size, g.n, salts, picks) for x in (some.ravel(), copies))
    p = float(np.quantile(same_keys(a, b).mean(1), 0.1))
    if p <= 0:
        raise ValueError(f"edited items of {g.n} words do not meet in {TRIED_WALKS} walks: lower the tolerance or the recall")
    return 1 if p >= 1 else int(np.ceil(np.log(1 - recall) / np.log(1 - p)))


def least_pairs(n: int, edits: int) -> int:
    """Word pairs that an edited copy of ``n`` words still has."""
    return max(1, n - 1 - 2 * edits)


def build(items: list[tuple[object, str | None]], tolerance: float, recall: float = RECALL, least_words: int = 1) -> Index:
    """Index of some items: word pairs, walks and keys."""
    column = pa.array([t or "" for _, t in items], pa.string())
    by_length: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
    for rows in slices(column):
        w = normalized(rows)
        for k in range(len(rows)):
            h = w.hash[w.first[k] : w.first[k + 1]]
            if len(h) >= max(1, least_words):
                by_length[len(h)].append((items[rows.first + k][0], h))
    items_by_length, exact = [], []
    cut: dict[tuple[int, int], list[tuple[np.ndarray, int, int, int]]] = defaultdict(list)
    for n, found in sorted(by_length.items()):
        edits = int(np.floor(tolerance * n + 1e-9))
        if not edits:
            h = span_hash(np.concatenate([h for _, h in found]), n * np.arange(len(found)), n * np.arange(1, len(found) + 1))
            order = np.argsort(h, kind="stable")
            exact.append((n, h[order], np.array([i for i, _ in found])[order]))
            continue
        bounds = [n * k // -(-n // PIECE) for k in range(-(-n // PIECE) + 1)]
        for line, (_, h) in enumerate(found):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                cut[b - a, edits // (len(bounds) - 1)].append((h[a:b], len(items_by_length), line, a))
        items_by_length.append(Items(n, np.array([i for i, _ in found]), np.stack([h for _, h in found]), edits, least_pairs(n, edits)))
    pieces = [Pieces(n, np.arange(len(some)), np.stack([x[0] for x in some]), edits, least_pairs(n, edits), *(np.array([x[k] for x in some], np.int64) for k in (1, 2, 3))) for (n, edits), some in sorted(cut.items())]
    counts = [walks_needed(g, recall) for g in pieces]
    salts, picks = draw_walks(max(counts, default=1))
    keys = [embed_keys(g.symbols.ravel(), np.arange(len(g.ids)) * g.n, np.full(len(g.ids), g.n), g.n, salts[:count], picks[:count]) for g, count in zip(pieces, counts, strict=True)]
    flat = [(k, j, g) for k, g in enumerate(pieces) for j in range(len(g.ids))]
    hashes = [pair_hash(g.symbols[j]) for _, j, g in flat]
    sizes = np.array([len(h) for h in hashes], np.int64)
    every, piece = np.concatenate(hashes or [np.zeros(0, U64)]), np.repeat(np.arange(len(hashes)), sizes)
    place = ranges(np.zeros(len(sizes), np.int64), sizes)
    pairs, pair = np.unique(every, return_inverse=True)
    has = np.unique(piece * max(1, len(pairs)) + pair)
    held_by = np.bincount(has % max(1, len(pairs)), minlength=len(pairs))
    runs = np.isin(np.arange(len(pairs)), pair[1:][(pair[1:] == pair[:-1]) & (piece[1:] == piece[:-1])])
    rank = np.lexsort((place, held_by[pair], piece))  # the rarest pairs of each piece first
    most = np.array([2 * g.edits + 1 for *_, g in flat], np.int64)
    rare = rank[np.arange(len(rank)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < most[piece[rank]]]
    rare = rare[np.argsort(pair[rare], kind="stable")]
    begin, end = (np.searchsorted(pair[rare], np.arange(len(pairs)), side) for side in ("left", "right"))
    facts = (np.array(list(column), np.int64) for column in ([k for k, *_ in flat], [j for _, j, _ in flat], *([f(g) for *_, g in flat] for f in (lambda g: g.n, lambda g: g.edits, lambda g: g.least))))
    return Index(items_by_length, pieces, pairs, salts, picks, keys, piece[rare], place[rare], begin, end, has, *facts, runs, exact)


def candidates(index: Index, known: np.ndarray, hits: np.ndarray, pair: np.ndarray, w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(piece, position) of the pieces' pairs in a text near each of their rarest pairs, where they are as many as a copy has.

    known: positions of word pairs of the pieces; hits: those that count towards a copy, in
    order; pair: which pair is at each position. All in bounded parts.
    """
    counts = np.zeros(len(w) + 1, np.int64)
    counts[hits + 1] = 1
    counts = np.cumsum(counts)
    size = index.owner_end[pair[known]] - index.owner_start[pair[known]]
    ends = np.cumsum(size)
    a = 0
    while a < len(known):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + OWNERS, "right")))
        some = ranges(index.owner_start[pair[known[a:b]]], size[a:b])
        owner, at = index.owners[some], np.repeat(known[a:b], size[a:b])
        n, edits, row = index.length[owner], index.edits[owner], w.row[at]
        begin = np.maximum(at - index.places[some] - edits, w.first[row])
        end = np.minimum(at - index.places[some] + n + 2 * edits, w.first[row + 1])
        fits = counts[np.maximum(end - 1, begin)] - counts[begin] >= index.least[owner]
        code = np.unique(owner[fits] * (len(w) + 1) + begin[fits])
        owner, begin = code // (len(w) + 1), code % (len(w) + 1)
        n, edits = index.length[owner], index.edits[owner]
        end = np.minimum(begin + n + 3 * edits, w.first[w.row[begin] + 1])
        a = b
        reach = np.cumsum(end - begin)
        c = 0
        while c < len(owner):
            d = max(c + 1, int(np.searchsorted(reach, (reach[c - 1] if c else 0) + CELLS, "right")))
            # the hits of each stretch
            low, high = np.searchsorted(hits, begin[c:d]), np.searchsorted(hits, end[c:d] - 1)
            at, of = hits[ranges(low, high - low)], np.repeat(owner[c:d], high - low)
            code = of * len(index.pairs) + pair[at]
            there = index.has[np.minimum(np.searchsorted(index.has, code), len(index.has) - 1)] == code
            found = np.unique(of[there] * (len(w) + 1) + at[there])
            yield found // (len(w) + 1), found % (len(w) + 1)
            c = d


def windows(index: Index, known: np.ndarray, hits: np.ndarray, pair: np.ndarray, w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of pieces, with lines and starts where a copy may begin: enough word pairs of that piece follow.

    A copy has from n - edits to n + edits words.
    """
    for owner, at in candidates(index, known, hits, pair, w):
        least, n, edits = index.least[owner], index.length[owner], index.edits[owner]
        i = np.arange(len(at))
        j = i + least - 1
        i, j = i[j < len(at)], j[j < len(at)]
        fits = (owner[i] == owner[j]) & (at[j] - at[i] <= n[i] + edits[i] - 2) & (w.row[at[i]] == w.row[at[j]])
        i, j = i[fits], j[fits]
        n, edits, row = n[i], edits[i], w.row[at[i]]
        begin, end = w.first[row], w.first[row + 1]
        low = np.maximum(at[j] - (n + edits - 2), begin)
        high = np.minimum(at[i], end - (n - edits))
        count = np.maximum(high - low + 1, 0)
        code = np.unique(np.repeat(owner[i], count) * (len(w) + 1) + ranges(low, count))
        piece, start = code // (len(w) + 1), code % (len(w) + 1)
        group = index.group[piece]
        for k in np.unique(group).tolist():
            yield k, index.line[piece[group == k]], start[group == k]


def spans(line: np.ndarray, low: np.ndarray, high: np.ndarray, g: Items, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item line, begin, end) of the words around candidates, from ``low`` to ``high``.

    Overlapping ones of an item are one, then cut into bounded pieces that share the words
    of a whole copy.
    """
    order = np.lexsort((low, line))
    line, low, high = line[order], low[order], high[order]
    row = w.row[low]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1]) | (low[1:] > high[:-1])
    at = np.flatnonzero(new)
    line, low, high = line[at], low[at], high[np.append(at[1:], len(new)) - 1]
    reach = g.n + g.edits
    pieces = np.maximum(1, -(-(high - low - reach) // (3 * reach)))
    begin = np.repeat(low, pieces) + ranges(np.zeros(len(at), np.int64), pieces) * 3 * reach
    return np.repeat(line, pieces), begin, np.minimum(begin + 4 * reach, np.repeat(high, pieces))


def compared(g: Items, line: np.ndarray, begin: np.ndarray, end: np.ndarray, w: Words, free: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least distance of each item to the runs of a stretch of words (without ``free``: to all of it), and where the run starts."""
    distance, first = np.zeros(len(line), np.int64), np.zeros(len(line), np.int64)
    width = int((end - begin).max(initial=1))
    step = max(1, min(512, CELLS // width))
    for a in range(0, len(line), step):
        some = slice(a, a + step)
        size = (end - begin)[some]
        grid = np.minimum(begin[some, None] + np.arange(size.max()), len(w) - 1)
        distance[some], first[some] = nearest(g.symbols[line[some]], w.hash[grid], size, free)
    return distance, begin + first


def search(index: Index, rows: Rows, free_ends: bool = False) -> Iterator[tuple[int, object, int, int, int]]:
    """(row, item id, first word, item words, distance) of each item found in each row, at its best place."""
    w = normalized(rows)
    for n, keys, ids in index.exact:
        h, at = grams(w, n)
        lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        _, first = np.unique(w.row[at] * (len(keys) + 1) + lo, return_index=True)  # at is in order
        for at, lo, hi in zip(at[first].tolist(), lo[first].tolist(), hi[first].tolist(), strict=True):
            row = int(w.row[at])
            for item in ids[lo:hi]:
                yield row, item, at - int(w.first[row]), n, 0
    if len(w) < 2 or not len(index.pairs):
        return
    h = pair_hash(w.hash)
    at = np.minimum(np.searchsorted(index.pairs, h), len(index.pairs) - 1)
    known = (index.pairs[at] == h) & (w.row[1:] == w.row[:-1])
    # one word repeated on and on is no copy, unless an item has such a run: count its first and last pair
    again = np.zeros(len(h) + 1, bool)
    again[1:-1] = (h[1:] == h[:-1]) & (w.row[2:] == w.row[:-2])
    hits = np.flatnonzero(known & ~(again[:-1] & again[1:] & ~index.runs[at]))
    met: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
    for which, line, start in windows(index, np.flatnonzero(known), hits, at, w):
        g, keys = index.pieces[which], index.keys[which]
        walks = keys.shape[1]
        same = np.zeros(len(start), bool)
        for a in range(0, len(start), 4096):
            s, back = np.unique(start[a : a + 4096], return_inverse=True)
            got = embed_keys(w.hash, s, np.minimum(g.n, w.first[w.row[s] + 1] - s), g.n, index.salts[:walks], index.picks[:walks])
            same[a : a + 4096] = same_keys(got[back], keys[line[a : a + 4096]]).any(1)
        line, start = line[same], start[same]
        for whole in np.unique(g.whole[line]).tolist():
            here = g.whole[line] == whole
            item, one = index.items[whole], index.items[whole].n == g.n
            row, begin = w.row[start[here]], start[here] - g.offset[line[here]]
            low = np.maximum(begin - item.edits, w.first[row])
            high = np.minimum(begin + item.n + item.edits * (1 if one else 2), w.first[row + 1])
            met[whole].append((g.of[line[here]], start[here] if one else low, low, high))
    for which, found in sorted(met.items()):
        g = index.items[which]
        line, start, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        if free_ends or g.n > PIECE:
            line, low, high = spans(line, low, high, g, w)
            distance, begin = compared(g, line, low, high, w, True)
        if not free_ends:
            if g.n > PIECE:  # only where some run is near enough can a window of the item's length be
                near = distance <= g.edits
                count = np.maximum(high - low - g.n + 1, 1)[near]
                line, start = np.repeat(line[near], count), ranges(low[near], count)
            first, last = w.first[w.row[start]], w.first[w.row[start] + 1]
            low = np.maximum(np.minimum(start, last - g.n), first)
            distance, begin = compared(g, line, low, np.minimum(low + g.n, last), w, False)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for k in np.flatnonzero(distance <= g.edits):
            key = int(w.row[begin[k]]), int(line[k])
            best[key] = min(best.get(key, (1 << 30, 0)), (int(distance[k]), int(begin[k])))
        for (row, item), (least, s) in sorted(best.items()):
            yield row, g.ids[item], s - int(w.first[row]), g.n, least


def contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", tolerance: float = 0.2, recall: float = RECALL, least_words: int = 1, pass_items: int = PASS_ITEMS, free_ends: bool = False) -> DataFrame:
    """(doc_id, item_id, start_word, item_words, distance): every item found in every document.

    One row for each pair, at the place of the smallest distance (the first of equals);
    repeated input rows give repeated rows. distance is in words, at most
    tolerance * item_words. With ``free_ends`` it is that to any run of words of the text,
    without it that to the windows of item_words words, where a word that is taken out or
    put in counts about twice. Texts without the words of an item, null and empty texts give
    none; items without words, and of fewer than ``least_words`` words if that is asked for, are not
    searched for, nor are null items. At the default tolerance items of fewer than five words allow no edit.
    Other columns are left out, whatever their names. Narrow over the documents: items go
    along with the tasks, about ``pass_items`` pieces of them in one pass. Further passes follow one
    by one, each written before the next is built, so driver and tasks hold one index.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    passes = passes_of(items, pass_items)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", benchmark.schema[item_id].dataType)] + [T.StructField(c, T.LongType()) for c in ("start_word", "item_words", "distance")])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))

    def one(index: Index) -> DataFrame:
        state = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch.column(1)):
                    found = list(search(state.value, part, free_ends))
                    if found:
                        row, item, *rest = zip(*found, strict=True)
                        ids = batch.column(0).take(pa.array([part.first + r for r in row]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(list(item)).cast(items_type), *(pa.array(x, pa.int64()) for x in rest)], names=schema.names)

        return rows.mapInArrow(run, schema)

    items_type = to_arrow_type(benchmark.schema[item_id].dataType)
    out = None
    for some in item_passes(items, passes):
        found = one(build(some, tolerance, recall, least_words))
        if passes > 1:
            found = materialize(found, "contaminated")
        out = found if out is None else out.unionAll(found)
    return out


def passes_of(items: DataFrame, pass_items: int) -> int:
    """Passes in which each has about ``pass_items`` pieces."""
    words = F.regexp_count("text", F.lit(r"[A-Za-z0-9]+|[^\x00-\x7f]"))
    return max(1, -(-(items.agg(F.sum(F.greatest(F.lit(1), F.ceil(words / PIECE)))).first()[0] or 0) // pass_items))


def item_passes(items: DataFrame, passes: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items in ``passes`` parts, one at a time on the driver."""
    for k in range(passes):
        some = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        yield [(r[0], r[1]) for r in some.collect()]


def leaked(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", name: str = "leaked", item_id: str = "item_id", item_text: str = "text", tolerance: float = 0.2, recall: float = RECALL, least_words: int = 1, pass_items: int = PASS_ITEMS, free_ends: bool = False) -> DataFrame:
    """The input with a boolean column ``name``: whether a text has an item of the benchmark.

    The same search as :func:`contaminated`, for filters: rows stay as they are, nothing is
    shuffled. Null and empty texts have none; an input column of that name is replaced.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    passes = passes_of(items, pass_items)

    def one(index: Index, searched: Column) -> Column:
        state = docs.sparkSession.sparkContext.broadcast(index)

        def run(column: pa.Array) -> pa.Array:
            out = np.zeros(len(column), bool)
            for part in slices(column):
                out[[part.first + r[0] for r in search(state.value, part, free_ends)]] = True
            return pa.array(out)

        return F.arrow_udf(run, "boolean")(searched)

    for k, some in enumerate(item_passes(items, passes)):
        search_in = F.col(text) if k == 0 else F.when(~F.col(name), F.col(text))  # what is found need not be read again
        hit = one(build(some, tolerance, recall, least_words), search_in)
        docs = docs.withColumn(name, hit if k == 0 else F.col(name) | hit)
        if passes > 1:
            docs = materialize(docs, "leaked")
    return docs
